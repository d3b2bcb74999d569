"""Language-model scores by a weighted back-off automaton.

The model is a hierarchical Dirichlet bigram model. Its automaton has a state for every word seen in training, one of
which, a text's end, is also where texts start, and an empty state. A word's arc from state v weighs
log((c(v, w) + MU * p(w)) / (c(v) + MU)) where the bigram was seen; else v's failure arc to the empty state weighs
log(MU / (c(v) + MU)) and the empty state's arc weighs log p(w), with p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), so the
weights of each state sum to one. An arc by w leads to w's state, or to the empty state if w was never seen. A text is
scored by one traversal from its start that carries the state and adds up the weights.

The automaton is as large as the corpus and is never in one place. Texts are dealt to blocks. Each block asks for the
arcs its texts can use: its distinct n-grams as sorted arrays of hashes, cut by ranges of the hash, with its own
training counts. Each range adds up what the blocks sent and answers every block in the order it asked, so answers
carry no keys. Each block then holds the part of the automaton it needs. Hashes spread frequent n-grams evenly; a
block sends an n-gram once, however frequent it is. Blocks and ranges grow with the square root of the corpus beyond
BLOCK characters, so messages between them grow in proportion to the corpus and never get small.

Words are told apart by 64-bit hashes, bigrams by 40 bits within a range. Defined results: null text counts as empty
and is its end token alone; rows with null doc_id are training rows; rows that repeat count as often as they occur and
score alike; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filled, ship

FOLDS, HELD_OUT = 5, 1
MU = 20.0
#: Characters of text in a block, and behind a range, in corpora up to SPREAD; fewer in small ones, so that there are
#: PARTS at least.
BLOCK, RANGE, PARTS = 8_000_000, 16_000_000, 48
#: Characters at which blocks begin to grow: 128 times BLOCK at the ten-thousandfold.
SPREAD = 400_000_000_000
#: Tokens of a text that one lane of a traversal takes.
LANE = 256
CACHE = 300_000
_END, _START = np.uint64(1), np.uint64(2)
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of an Arrow array of texts, A-Z lower-cased, the number of each token's, and each text's tokens."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    held = split.flatten().dictionary_encode()
    full = np.asarray(pc.binary_length(held.dictionary)) > 0  # space at either end makes an empty word
    word, text = held.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = full[word]
    words = held.dictionary.filter(pa.array(full)).to_pylist()
    return [w.encode() for w in words], (np.cumsum(full) - 1)[word[real]], np.bincount(text[real], minlength=len(texts))


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_keys(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = state * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def range_edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where the sorted keys of each range begin, and the end."""
    number = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(number, np.arange(ranges + 1, dtype=np.uint64))


def small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, and places and values of those over 254."""
    at = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([at, counts[at]]).astype("<u4").tobytes()


def large(low: bytes, over: bytes) -> np.ndarray:
    counts, (at, value) = np.frombuffer(low, np.uint8).astype(np.int64), np.frombuffer(over, "<u4").reshape(2, -1)
    counts[at] = value
    return counts


class Block:
    """Texts as states and words, and their distinct n-grams."""

    def __init__(self, texts):
        words, number, n = tokens(texts)
        self.lengths = n + 1
        self.start = np.cumsum(self.lengths) - self.lengths
        self.word = np.insert(hashed(words)[number], np.cumsum(n), _END)
        state = np.r_[_START, self.word[:-1]] if len(self.word) else self.word
        state[self.start] = _START
        self.words, self.word_at = np.unique(self.word, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair_keys(state, self.word), return_inverse=True)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.repeat(train, self.lengths).astype(np.float64)
        return tuple(np.bincount(at, weight, len(keys)).astype(np.int64) for at, keys in ((self.word_at, self.words), (self.pair_at, self.pairs)))


class Automaton:
    """The states and arcs that a block's texts can use.

    State 0 is empty, state k + 1 is that of the block's word k, where its texts end being where they start. Arcs are
    numbered as the block's n-grams are; weights are log10. ``known`` tells whether an arc is there.
    """

    def __init__(self, block: Block, c_word: np.ndarray, c_pair: np.ndarray, total: int, kinds: int, mu: float):
        p = (c_word + 0.5) / (total + 0.5 * (kinds + 1))
        self.single, self.next = np.log10(p), np.where(c_word > 0, np.arange(len(c_word)) + 1, 0)
        self.begin = 1 + int(np.searchsorted(block.words, _END))
        c_state = np.r_[0, c_word]
        self.fail = np.log10(mu / (c_state + mu))
        self.fail[0] = 0.0
        last = np.zeros(len(c_pair), np.int64)  # a bigram's second word
        last[block.pair_at] = block.word_at
        before = np.r_[self.begin, block.word_at[:-1] + 1]
        before[block.start] = self.begin
        first = np.zeros(len(c_pair), np.int64)  # the state it leaves
        first[block.pair_at] = before
        self.known = c_pair > 0
        self.pair = np.log10((c_pair + mu * p[last]) / (c_state[first] + mu))

    def traverse(self, block: Block) -> np.ndarray:
        """Each text's sum of weights, from left to right in all texts at once.

        A long text is dealt to several lanes. A lane begins in the state in which the lane before it ends, which the
        last word there tells: its own state, or the empty one.
        """
        n = -(-block.lengths // LANE)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = block.start[text] + place * LANE
        size = np.minimum(block.lengths[text] - place * LANE, LANE)
        state = np.where(place == 0, self.begin, self.next[block.word_at[begin - 1]]) if len(text) else begin
        order = np.argsort(-size, kind="stable")
        begin, size, state, sums = begin[order], size[order], state[order], np.zeros(len(order))
        alive = len(order)
        for step in range(int(size[0]) if alive else 0):
            alive = int(np.searchsorted(-size[:alive], -step, "left"))  # lanes with more than ``step`` tokens come first
            at = begin[:alive] + step
            word, pair = block.word_at[at], block.pair_at[at]
            sums[:alive] += np.where(self.known[pair], self.pair[pair], self.fail[state[:alive]] + self.single[word])
            state[:alive] = self.next[word]
        return np.bincount(text[order], sums, len(n))


def training_size(docs: DataFrame, ranges: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            edges = range_edges(keys, ranges)
            rows = [(r, keys[edges[r] : edges[r + 1]].tobytes(), int(n[edges[r] : edges[r + 1]].sum())) for r in np.flatnonzero(np.diff(edges)).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64()))], names=["range", "keys", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000).column(0)
                words, number, _ = tokens(part)
                held.append((np.r_[hashed(words), _END], np.r_[np.bincount(number, minlength=len(words)), len(part)]))
                if sum(len(k) for k, _ in held) > CACHE:
                    yield out()
                    held = []
        if held:
            yield out()

    def add(frame):
        import pandas as pd

        keys = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in frame["keys"]]))
        return pd.DataFrame({"n": [int(frame["n"].sum())], "v": [len(keys)]})

    found = docs.filter(~F.col("held_out")).select("text").mapInArrow(run, "range int, keys binary, n long").groupBy("range").applyInPandas(add, "n long, v long")
    n, v = found.agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def scored(docs: DataFrame, mu: float = MU) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False)))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    grown = max(1.0, (chars / SPREAD) ** 0.5)
    blocks, ranges = max(PARTS, -(-chars // int(BLOCK * grown))), max(PARTS, -(-chars // int(RANGE * grown)))
    total, kinds = training_size(rows, ranges)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int"))

    def ask(frame):
        import pandas as pd
        import pyarrow as pa

        block = Block(pa.array(frame["text"], pa.string()))
        n_word, n_pair = block.counts(~frame["held_out"].to_numpy(bool))
        we, pe, out = range_edges(block.words, ranges), range_edges(block.pairs, ranges), []
        for r in np.flatnonzero(np.diff(we) + np.diff(pe)).tolist():
            w, p = slice(we[r], we[r + 1]), slice(pe[r], pe[r + 1])
            keys = block.pairs[p]
            out.append((int(frame["block"].iloc[0]), r, block.words[w].tobytes(), n_word[w].astype("<u4").tobytes(), keys.astype("<u4").tobytes(), (keys >> np.uint64(32)).astype(np.uint8).tobytes(), *small(n_pair[p])))
        return pd.DataFrame(out, columns=["block", "range", "words", "n_words", "low", "high", "n_pairs", "more"])

    def answer(frame):
        import pandas as pd

        words = [np.frombuffer(x, np.uint64) for x in frame["words"]]
        pairs = [np.frombuffer(a, "<u4").astype(np.uint64) | (np.frombuffer(b, np.uint8).astype(np.uint64) << np.uint64(32)) for a, b in zip(frame["low"], frame["high"])]
        sums = []
        for keys, counts in ((words, [np.frombuffer(x, "<u4") for x in frame["n_words"]]), (pairs, [large(a, b) for a, b in zip(frame["n_pairs"], frame["more"])])):
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            whole = np.bincount(at, np.concatenate(counts)) if len(at) else np.zeros(0)
            sums.append(np.split(whole[at].astype(np.int64), np.cumsum([len(k) for k in keys])[:-1]))
        out = [(b, r, w.astype("<u4").tobytes(), *small(p)) for b, r, w, p in zip(frame["block"], frame["range"], *sums)]
        return pd.DataFrame(out, columns=["block", "range", "n_words", "n_pairs", "more"])

    def score(frame, told):
        import pandas as pd
        import pyarrow as pa

        if not len(frame):
            return pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])
        block, told = Block(pa.array(frame["text"], pa.string())), told.sort_values("range")
        c_word = np.concatenate([np.frombuffer(x, "<u4") for x in told["n_words"]]).astype(np.int64)
        c_pair = np.concatenate([large(a, b) for a, b in zip(told["n_pairs"], told["more"])])
        machine = Automaton(block, c_word, c_pair, total, kinds, mu)
        known, base = (np.add.reduceat(x[block.word_at], block.start) for x in ((c_word > 0).astype(np.int64), machine.single))
        full = machine.traverse(block)
        return pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "n_tokens": block.lengths, "n_known": known, "train_tokens": total, "base_score": base, "score": full})

    asked = dealt.groupBy("block").applyInPandas(ask, "block int, range int, words binary, n_words binary, low binary, high binary, n_pairs binary, more binary")
    answers = asked.groupBy("range").applyInPandas(answer, "block int, range int, n_words binary, n_pairs binary, more binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, _OUT)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


QUERIES, SQL = {"op4_lm_score": op4_lm_score}, {}
