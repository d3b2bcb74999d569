"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents go to the tier of the shortest window that holds them; what is longer than the longest window is cut into
full windows and a remainder. Each tier is packed best-fit, longest first; gaps of the longer windows are filled from
the shorter tiers, whole documents first and then by cutting one to size, so that only a packer's very last window can
be padded. Packing runs where the rows are read: no shuffle, memory bounded by CHUNK_TOKENS, and a lost task is
repeated on the same rows. Windows of a chunk are dealt to step groups with nearly equal numbers of tokens.

Defined results: null text counts as empty, which is the end mark alone; rows that repeat are packed as often as they
occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filled, ship

TIERS = (256, 512, 1024, 2048)
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Tokens packed together; a packer keeps their ids in memory (4 bytes each).
CHUNK_TOKENS = 2_000_000
#: Windows in a step group, on average.
GROUP = 32
#: Words a process remembers while a task runs, about 200 bytes each; when full, the KEEP first met stay.
CACHE, KEEP = 300_000, 150_000
#: Parts that the merge rules get in one string, and texts that are encoded together.
LINE, TEXTS = 500, 2000
#: Characters other than ASCII letters, digits and marks, and Latin letters; these the rules neither compose
#: nor treat as one. An apostrophe may start a part of its own.
_ODD = re.compile("[^!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\t-\r ]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"


class Encoder:
    """Token ids of texts, remembered by word.

    The vocabulary's rules drop white space, lower-case, and part letters, digits and other marks from each other, so a
    text may be encoded word by word. Plain words are cut into such parts here and new parts meet the merge rules alone,
    many in one string: a part's last token is known by the mark of word ends. Words with any other character are
    encoded by the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.merges, self.known = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = {chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}

    def spelled(self, line: str) -> str:
        """Letters of two bytes as the vocabulary spells them."""
        if not line.isascii():
            for letter, two in self.spell.items():
                line = line.replace(letter, two)
        return line

    def learn(self, new: list[str]) -> None:
        odd = [w for w in new if _ODD.search(w) or "<|" in w]
        plain = list(set(new).difference(odd)) if odd else new
        cuts = [_PARTS.findall(w.lower()) for w in plain]
        parts = list(set().union(*cuts))
        lines = [self.spelled(" ".join(parts[at : at + LINE])) for at in range(0, len(parts), LINE)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
        stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stops) != len(parts):
            raise ValueError("a part of a word has another number of ends than one")
        raw = ids.tobytes()
        look = {p: raw[a:b] for p, a, b in zip(parts, [0, *stops[:-1].tolist()], stops.tolist())}.__getitem__
        self.known.update((w, look(cut[0]) if len(cut) == 1 else b"".join(map(look, cut))) for w, cut in zip(plain, cuts))
        for w, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.known[w] = array("I", e.ids).tobytes()

    def __call__(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow array without nulls, the end mark last."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        held = split.flatten().dictionary_encode()
        words = held.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known = dict(islice(self.known.items(), KEEP))
        self.learn([w for w in words if w not in self.known])
        each = [*map(self.known.__getitem__, words), array("I", [END]).tobytes()]
        flat = np.frombuffer(b"".join(each), "<u4")
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(sizes) - sizes
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        word = np.insert(held.indices.to_numpy(), ends, len(words))
        n = sizes[word]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(starts[word] - before, n) + np.arange(n.sum())]
        return np.split(ids, (before + n)[ends + np.arange(len(ends))][:-1]) if len(ends) else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a process; what it has learnt of words is dropped at the end of a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Shelf:
    """Pieces of one tier, by length; takes the longest that fits."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []  # length, doc, start

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.rows, (length, doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.rows, (most + 1, -1, -1))
        return self.rows.pop(at - 1) if at else None


def pack(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows as (window length, [(document number, start, length)]); every token of every document is in one piece."""
    top, windows = tiers[-1], []
    shelves = {t: Shelf() for t in tiers}
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % top, top):
            windows.append((top, [(doc, start, top)]))
        if n % top:
            shelves[next(t for t in tiers if n % top <= t)].add(n % top, doc, n - n % top)
    for tier in reversed(tiers):
        under = [shelves[t] for t in reversed(tiers) if t <= tier]
        while shelves[tier].rows:
            gap, pieces = tier, []
            for shelf in under:
                while gap and (x := shelf.take(gap)):
                    pieces.append((x[1], x[2], x[0]))
                    gap -= x[0]
            if gap:  # the shortest piece of the shortest tier is longer than the gap: cut it
                shelf = next((s for s in reversed(under) if s.rows), None)
                if shelf is None:  # all else is packed
                    window = tier - gap if (tier - gap) & (tier - gap - 1) == 0 else top
                    windows.append((window, pieces))
                    continue
                n, doc, start = shelf.rows.pop(0)
                pieces.append((doc, start, gap))
                shelves[next(t for t in tiers if n - gap <= t)].add(n - gap, doc, start + gap)
            windows.append((tier, pieces))
    return windows


def step_groups(windows: list[tuple[int, list]], size: int = GROUP) -> list[int]:
    """A group for each window, longest first into the group with the fewest tokens."""
    loads = [(0, g) for g in range(max(1, round(len(windows) / size)))]
    out = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        load, g = heapq.heappop(loads)
        out[i] = g
        heapq.heappush(loads, (load + windows[i][0], g))
    return out


def packed(docs: DataFrame, vocabulary: str, tiers=TIERS) -> DataFrame:
    """One row per piece; sequence_id and step_group carry the partition's number, so packers need no agreement."""

    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        encode, base = encoder(vocabulary), TaskContext.get().partitionId() << 36
        sequence = group = 0

        def flush(ids: list, tokens: list) -> pd.DataFrame:
            nonlocal sequence, group
            rows, windows = [], pack([len(x) for x in tokens], tiers)
            groups = step_groups(windows)
            for (window, pieces), g in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    x = tokens[doc]
                    rows.append((ids[doc], start, n, zlib.crc32(x[start : start + n].tobytes()), len(x), base + sequence, offset, window, base + group + g))
                    offset += n
                sequence += 1
            group += max(groups, default=-1) + 1
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            out = pd.DataFrame(rows, columns=columns)
            return out.astype({c: "int64" for c in columns if c != "doc_id"} | {"doc_id": "Int64"})

        ids, tokens, held = [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), TEXTS):
                for key, x in zip(keys[at : at + TEXTS], encode(texts.slice(at, TEXTS)), strict=True):
                    ids.append(key)
                    tokens.append(x)
                    held += len(x)
                    if held >= CHUNK_TOKENS:
                        yield from arrow(flush(ids, tokens))
                        ids, tokens, held = [], [], 0
        yield from arrow(flush(ids, tokens))
        encode.known.clear()  # a worker process outlives its task

    def arrow(frame) -> Iterator:
        import pyarrow as pa

        yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches(max_chunksize=50_000)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).mapInArrow(run, SCHEMA)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), vocabulary_path())


QUERIES, SQL = {"op3_tiered_packing": op3_tiered_packing}, {}
