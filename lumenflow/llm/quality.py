"""Quality rules: line, symbol and repetition counts, and bands of n-gram perplexity by language.

Each language has a modified Kneser-Ney model of order four over the bytes of its running texts, words parted by one
space, so n-grams reach across words and know their order, their case and their marks. A word's probability mixes its
language's model with one of all languages, for texts hold passages in others. The n-grams of all documents are counted: tasks count within batches, Spark adds the counts up, and continuations, contexts, counts of counts and
probabilities are aggregates and joins over that table; every n-gram of the texts has its own. Models are arrays sorted by
n-gram code. They go to the workers together while they take MODEL_BYTES or less, else languages are judged in several
passes, each over the documents of the languages whose models fit. Of a model that takes over half of MODEL_BYTES, workers
hold the n-grams of order three or four from KEEP_SHARE of the language's n-grams on, so no corpus makes it larger; words
with any other n-gram meet its probability in a join and have the same measure as from the whole model.

A document's measure is its negative log probability a word. Each language has a band around its median, as wide as the
spread between its quartiles asks for, and wider for short texts, whose means scatter and which one key may lift.

Defined results: null text has no words, fails the base rules and is not kept; null language is a language of its own;
languages with fewer than ENOUGH rows are one language together, and if that has fewer rows, too, the base rules alone
decide; rows that repeat are judged alike; an empty table gives no rows; further columns, of any name, are passed through
by ``passing`` only. The list of languages with ENOUGH rows is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import attach, documents, filled, packed_rows, ship, stored

SYMBOLS = "#*$%&|<>"
#: Reach of a band below and above the median: in half distances between the quartiles; what a text of n words is
#: granted more, over sqrt(n); and over n, the nats of a key or address that a clean text may hold.
BELOW, ABOVE = (3.0, 6.0, 0.0), (6.0, 8.0, 150.0)
#: Least reach in nats a word.
LEAST = 0.3
#: Rows from which on a language has a model and a band of its own.
ENOUGH = 50
#: Order of the model, and share of a language's n-grams from which on workers hold one of a model too large for them.
ORDER, KEEP_SHARE = 4, 2.0**-20
#: Bytes of models that a worker holds at once, the one of all languages included.
MODEL_BYTES = 128 << 20
#: Rows read at once, and counts a task holds before it passes them on.
ROWS, HELD = 2000, 400_000
#: Bytes that no word holds: between words, and before the first.
_SPACE, _START = 0x20, 0x0A
RARE, ALL = "*", "**"
#: Weight of the model of all languages in the mixture.
GENERAL = 0.25
_COUNTS = "key string, code long, n long"
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, key string, nats double"
_OPEN = "array<struct<own: double, general: double, times: long, codes: array<long>>>"
WINDOW = 5
_ODD = np.random.default_rng(23).integers(0, 1 << 63, WINDOW + 1, np.uint64) * np.uint64(2) + np.uint64(1)


class Tokens:
    """Words of an Arrow array of texts: distinct words, and for each token the number of its word and of its text."""

    def __init__(self, texts):
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(texts)
        held = split.flatten().dictionary_encode()
        full = np.asarray(pc.binary_length(held.dictionary)) > 0  # space at either end makes an empty word
        word, text = held.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        real = full[word]
        self.distinct, self.word = held.dictionary.filter(pa.array(full)), (np.cumsum(full) - 1)[word[real]]
        self.text, self.texts = text[real], len(texts)
        self.n = np.bincount(self.text, minlength=self.texts)
        self.first = np.cumsum(self.n) - self.n

    def per_text(self, value: np.ndarray) -> np.ndarray:
        """Sum of a distinct word's value over the tokens of each text."""
        return np.bincount(self.text, value[self.word], self.texts)


def repeat_words(ids: np.ndarray, size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that the text has twice or more."""
    n = len(ids)
    if n <= size:
        return 0
    _, code = np.unique(ids, return_inverse=True)
    ids, code = code.astype(np.int64), code.astype(np.int64)
    for k in range(1, size):  # pairs with the next word, numbered again: exact
        code = np.unique(code[: n - k] * n + ids[k:], return_inverse=True)[1].astype(np.int64)
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[: len(twice)] += twice
    edge[size : size + len(twice)] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def repeats(tokens: Tokens, size: int = WINDOW) -> np.ndarray:
    """``repeat_words`` of each text; counted only in texts with two windows of one hash, as others have no such windows."""
    out = np.zeros(tokens.texts, np.int64)
    w, t = tokens.word.astype(np.uint64), tokens.text
    if len(w) <= size:
        return out
    last = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = t[:last].astype(np.uint64) * _ODD[size]
        for k in range(size):
            h = (h ^ (h >> np.uint64(29))) * _ODD[k] + w[k : last + k]
    inside = t[:last] == t[size - 1 :]
    h, at = h[inside], t[:last][inside]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    for i in np.unique(at[order[1:][same]]).tolist():
        out[i] = repeat_words(tokens.word[tokens.first[i] : tokens.first[i] + tokens.n[i]])
    return out


def dup_lines(texts) -> np.ndarray:
    """Lines with a word that are equal to an earlier line, of each text of an Arrow array."""
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, "\n")
    held = split.flatten().dictionary_encode()
    line, text = held.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(held.dictionary)))[line] > 0 if len(line) else np.zeros(0, bool)
    line, text = line[real], text[real]
    distinct = np.unique(text * max(1, len(held.dictionary)) + line)
    return np.bincount(text, minlength=len(texts)) - np.bincount(distinct // max(1, len(held.dictionary)), minlength=len(texts))


def base_counts(texts, tokens: Tokens) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each text."""
    import pyarrow.compute as pc

    chars = tokens.per_text(np.asarray(pc.utf8_length(tokens.distinct)))
    marks = sum(np.asarray(pc.count_substring(tokens.distinct, c)) for c in SYMBOLS) if len(tokens.distinct) else np.zeros(0)
    n, repeated = tokens.n.astype(np.int64), repeats(tokens)
    return n, chars.astype(np.int64), tokens.per_text(marks).astype(np.int64), dup_lines(texts).astype(np.int64), repeated, (n < 10) | (100 * repeated > 20 * n)


def inner_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams within the words, a space at either end, and where each word's begin: len(word) - 1 each."""
    x = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.r_[0, np.cumsum(lengths + 2)]
    code = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    keep = np.ones(len(code) + 3, bool)
    for back in (1, 2, 3):  # the n-grams that span two words
        keep[starts[1:] - back] = False
    return code[keep[: len(code)]], np.r_[0, np.cumsum(lengths - 1)]


def edges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last two bytes of each word behind a space, and the first two before a space, as numbers."""
    last = np.frombuffer(b"".join([(b" " + w)[-2:] for w in words]), ">u2").astype(np.int64)
    first = np.frombuffer(b"".join([(w + b" ")[:2] for w in words]), ">u2").astype(np.int64)
    return last, first


def junctions(tokens: Tokens, words: list[bytes]) -> np.ndarray:
    """For each token, the two bytes before the space before it and its own first two: 32 bits."""
    last, first = edges(words)
    before = np.r_[0, last[tokens.word[:-1]]] if len(tokens.word) else np.zeros(0, np.int64)
    before[tokens.first[tokens.n > 0]] = _START << 8 | _START
    return (before << 16) | first[tokens.word]


def outer_codes(junction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two n-grams across a junction: (a, b, space, c) and (b, space, c, d)."""
    return (junction >> 16 << 16) | (_SPACE << 8) | (junction >> 8 & 0xFF), ((junction >> 16 & 0xFF) << 24) | (_SPACE << 16) | (junction & 0xFFFF)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of one, two, and three or more; counts of counts of zero pass as one."""
    n1, n2, n3, n4 = (max(1, int(n)) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.1, [0.95, 1.9, 2.8])


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class Model:
    """Log probabilities of n-grams in arrays sorted by code and, for those not in them, of their contexts' back-off.

    An n-gram's code is its bytes, the last one lowest: the context is the code above it, the next lower order's n-gram
    the code without the highest byte.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """tables: of all orders the codes, their probabilities, and the back-off of their contexts."""
        (codes, p, back), self.levels = tables[0], []
        self.single = np.full(256, np.log(back[0] / 256))
        self.single[codes] = np.log(p)
        for codes, p, back in tables[1:]:
            by = np.argsort(codes)
            codes, p, back = codes[by], p[by], back[by]
            context, first = np.unique(codes >> 8, return_index=True)
            self.levels.append((codes, np.log(p), context, np.log(back[first])))

    def has(self, codes: np.ndarray) -> np.ndarray:
        """Whether n-grams of the highest order are in the arrays."""
        return find(self.levels[-1][0], codes)[1]

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each code behind the others."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        for order in range(len(self.levels) + 1, 1, -1):
            keys, p, context, back = self.levels[order - 2]
            x = codes[open_] & ((1 << 8 * order) - 1)
            at, hit = find(keys, x)
            out[open_[hit]] += p[at[hit]]
            x, open_ = x[~hit], open_[~hit]
            at, hit = find(context, x >> 8)
            out[open_[hit]] += back[at[hit]]
        out[open_] += self.single[codes[open_] & 0xFF]
        return out


def nats(tokens: Tokens, own: Model, general: Model, whole: bool = True):
    """Mean negative log probability of the words of each text, NaN without words; and, unless the models are ``whole``,
    an Arrow array of each text's words with an n-gram that one of them lacks, which count as zero in the mean: what both
    models give for the rest of the word, how often the text has it, and the codes that are lacking."""
    words = [w.encode() for w in tokens.distinct.to_pylist()]
    codes, starts = inner_codes(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    junction, inverse = np.unique(junctions(tokens, words), return_inverse=True)
    outer = outer_codes(junction)
    lacking = [np.zeros(len(x), bool) if whole else ~(own.has(x) & general.has(x)) for x in (codes, *outer)]

    def log_p(model: Model) -> np.ndarray:
        inner, *across = (np.where(gone, 0.0, model.log_p(x)) for x, gone in zip((codes, *outer), lacking))
        each = np.r_[0.0, np.cumsum(inner)]
        return (each[starts[1:]] - each[starts[:-1]])[tokens.word] + sum(across)[inverse]

    each, all_ = log_p(own), log_p(general)
    mixed = np.logaddexp(each + np.log(1 - GENERAL), all_ + np.log(GENERAL))
    gone = np.r_[0, np.cumsum(lacking[0])][starts]
    open_ = (np.diff(gone) > 0)[tokens.word] | (lacking[1] | lacking[2])[inverse]
    mean = np.where(tokens.n > 0, -np.bincount(tokens.text, np.where(open_, 0.0, mixed), tokens.texts) / np.maximum(tokens.n, 1), np.nan)
    return mean, None if whole else _open_words(tokens, np.flatnonzero(open_), inverse, each, all_, codes[lacking[0]], gone, outer, lacking[1:])


def _open_words(tokens: Tokens, at: np.ndarray, junction: np.ndarray, own: np.ndarray, general: np.ndarray, inner: np.ndarray, starts: np.ndarray, outer, lacking):
    """The Arrow array of ``nats``; at: the tokens in it; inner, starts: codes that words lack, and where each word's begin."""
    import pyarrow as pa

    which = np.stack([tokens.text[at], tokens.word[at], junction[at]])
    (text, word, across), first, times = np.unique(which, axis=1, return_index=True, return_counts=True)
    codes = [np.r_[inner[starts[w] : starts[w + 1]], [x[j] for x, gone in zip(outer, lacking) if gone[j]]].astype(np.int64) for w, j in zip(word, across)]
    ends = np.r_[0, np.cumsum([len(x) for x in codes], dtype=np.int64)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *codes])))
    values = pa.StructArray.from_arrays([pa.array(own[at[first]]), pa.array(general[at[first]]), pa.array(times.astype(np.int64)), lists], names=["own", "general", "times", "codes"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(tokens.texts + 1)).astype(np.int32)), values)


#: A model of no texts.
NONE = Model([(np.zeros(0, np.int64), np.zeros(0), np.ones(1)), *[(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * (ORDER - 1)])


class Tally:
    """Counts of n-grams by language within a task, passed on when they are many."""

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, key: str, codes: np.ndarray, n: np.ndarray) -> None:
        code, inverse = np.unique(codes, return_inverse=True)
        self.parts.setdefault(key, []).append((code, np.bincount(inverse, n).astype(np.int64)))
        self.held += len(code)

    def flush(self):
        import pyarrow as pa

        for key, parts in self.parts.items():
            code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["key", "code", "n"])
        self.parts, self.held = {}, 0


def by_language(keys: list[str | None], known) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch and its rows; languages that aren't ``known`` are one."""
    names = np.array([k if k in known else RARE for k in (("" if x is None else f"={x}") for x in keys)], object)
    for name in dict.fromkeys(names):
        yield name, np.flatnonzero(names == name)


def counted(docs: DataFrame, known) -> DataFrame:
    """key, code, n: how often each language's texts hold each n-gram of the highest order."""

    def run(batches: Iterator) -> Iterator:
        tally = Tally()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for name, rows in by_language(part.column(0).to_pylist(), known):
                    count(tally, name, Tokens(part.column(1).take(_places(rows))))
                if tally.held > HELD:
                    yield from tally.flush()
        yield from tally.flush()

    rows = docs.select(F.col("lang").cast("string").alias("lang"), filled(F.col("text")).alias("text"))
    return rows.mapInArrow(run, _COUNTS).groupBy("key", "code").agg(F.sum("n").alias("n"))


def _places(rows: np.ndarray):
    import pyarrow as pa

    return pa.array(rows)


def count(tally: Tally, name: str, tokens: Tokens) -> None:
    if len(tokens.word):
        often = np.bincount(tokens.word, minlength=len(tokens.distinct))
        words = [w.encode() for w in tokens.distinct.to_pylist()]
        codes, starts = inner_codes(words)
        junction, n = np.unique(junctions(tokens, words), return_counts=True)
        one, two = outer_codes(junction)
        weights = np.r_[np.repeat(often, np.diff(starts)), n, n]
        codes = np.r_[codes, one, two]
        tally.add(name, codes[weights > 0], weights[weights > 0])


def add(sizes: dict[str, int], rows: DataFrame) -> None:
    """Adds to each language's bytes in a model what its ``rows`` take."""
    for r in rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["key"]] = sizes.get(r["key"], 0) + 32 * r["n"]


def _key(lang: Column) -> Column:
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang.cast("string")))


class Judge:
    """Models of all languages of ``docs``, fitted on all rows, in groups that a worker can hold."""

    def __init__(self, docs: DataFrame):
        ship(docs.sparkSession)
        rows = docs.groupBy(_key(F.col("lang")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        self.known = frozenset(r["key"] for r in rows.filter(F.col("n") >= ENOUGH).select("key").collect())
        grams = stored(counted(docs, self.known), "grams")
        orders = [stored(grams.unionByName(grams.groupBy("code").agg(F.sum("n").alias("n")).withColumn("key", F.lit(ALL))), "ngrams")]
        for order in range(ORDER - 1, 0, -1):  # continuations; ``often`` is how often the texts hold the n-gram
            often = F.sum("often" if "often" in orders[0].columns else "n").alias("often")
            lower = orders[0].groupBy("key", F.col("code").bitwiseAND((1 << 8 * order) - 1).alias("code")).agg(F.count(F.lit(1)).alias("n"), often)
            orders.insert(0, stored(lower, f"order{order}"))
        orders[-1] = orders[-1].withColumn("often", F.col("n"))
        self.orders: list[DataFrame] = []
        for order, grams in enumerate(orders, 1):
            self.orders.append(stored(self.probabilities(grams, order), f"p{order}"))
        sizes: dict[str, int] = {}
        for rows in self.orders[1:]:
            add(sizes, rows)
        large = [k for k in sizes if sizes[k] > MODEL_BYTES // 2]
        #: Of languages with a large model, how often the texts hold an n-gram that workers have.
        self.least = {r["key"]: KEEP_SHARE * r["whole"] for r in self.orders[0].filter(F.col("key").isin(large)).groupBy("key").agg(F.sum("often").alias("whole")).collect()}
        if large:
            sizes = dict.fromkeys(sizes, 0)
            for order in range(2, ORDER + 1):
                add(sizes, self.held(order))
        self.groups = self.shelves(sizes)

    def probabilities(self, grams: DataFrame, order: int) -> DataFrame:
        """key, code, often, p and the back-off of the context, of every n-gram of an order. A context and an n-gram of the
        next lower order have 256 rows at most in a language, so no key is hot."""
        once = grams.groupBy("key").agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()
        cuts = grams.sparkSession.createDataFrame([(r["key"], *discounts(*r[1:]).tolist()) for r in once], "key string, c1 double, c2 double, c3 double")
        context = Window.partitionBy("key", F.shiftright("code", 8))
        cut = F.when(F.col("n") == 1, F.col("c1")).when(F.col("n") == 2, F.col("c2")).otherwise(F.col("c3"))
        rows = grams.join(F.broadcast(cuts), "key").select("key", "code", "often", "n", cut.alias("cut"))  # a row a language
        total = F.sum("n").over(context)
        rows = rows.select("key", "code", "often", ((F.col("n") - F.col("cut")) / total).alias("kept"), (F.sum("cut").over(context) / total).alias("back"))
        rows = rows.withColumn("short", F.col("code").bitwiseAND((1 << 8 * (order - 1)) - 1))
        if order == 1:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.join(self.orders[-1].select("key", F.col("code").alias("short"), F.col("p").alias("below")), ["key", "short"])
        return rows.select("key", "code", "often", (F.col("kept") + F.col("back") * F.col("below")).alias("p"), "back")

    def frequent(self, key: Column, often: Column) -> Column:
        """Whether workers hold an n-gram of order three or four."""
        pairs = [F.lit(x) for pair in self.least.items() for x in pair]
        return often >= F.coalesce(F.create_map(*pairs)[key], F.lit(0.0)) if pairs else F.lit(True)

    def held(self, order: int) -> DataFrame:
        """The n-grams of an order that workers hold."""
        rows = self.orders[order - 1]
        return rows.filter(self.frequent(F.col("key"), F.col("often"))) if order > 2 else rows

    def shelves(self, sizes: dict[str, int]) -> list[list[str]]:
        """Languages dealt to groups of MODEL_BYTES or less with the model of all, but for languages that need more alone."""
        out, room = [[]], MODEL_BYTES - sizes.get(ALL, 0)
        for name in sorted(set(sizes).difference([ALL])):
            if out[-1] and sizes[name] > room:
                out.append([])
                room = MODEL_BYTES - sizes[ALL]
            out[-1].append(name)
            room -= sizes[name]
        return out

    def of(self, at: int, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` in the languages of a group; in the first one also those of languages without a word."""
        key = _key(F.col("lang"))
        key = F.when(key.isin(list(self.known)), key).otherwise(RARE)
        if len(self.groups) == 1:
            return docs
        return docs.filter(key.isin(self.groups[at]) if at else ~key.isin([k for group in self.groups[1:] for k in group]))

    def models(self, names: list[str]) -> dict[str, Model]:
        """What workers hold of the models of some languages and that of all."""
        keys = [*names, ALL]
        number = F.array_position(F.array(*map(F.lit, keys)), F.col("key")).cast("int")

        def by_key(order: int) -> dict[str, tuple[np.ndarray, ...]]:
            got = self.held(order).filter(F.col("key").isin(keys)).select(number.alias("key"), "code", "p", "back").toArrow()
            key, *columns = (c.to_numpy() for c in got.columns)
            return {keys[k - 1]: tuple(c[key == k] for c in columns) for k in np.unique(key)}

        tables = [by_key(order) for order in range(1, ORDER + 1)]
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return {key: Model([t.get(key, none) for t in tables]) for key in keys if key in tables[0]}

    def others(self, names: list[str]) -> DataFrame:
        """key, code and both models' log probabilities of the n-grams that workers lack in one of them."""
        top = self.orders[-1]
        general = top.filter(F.col("key") == ALL).select("code", F.col("often").alias("often_all"), F.log("p").alias("p_all"))
        both = top.filter(F.col("key").isin(names)).select("key", "code", "often", F.log("p").alias("p_own")).join(general, "code")
        return both.filter(~(self.frequent(F.col("key"), F.col("often")) & self.frequent(F.lit(ALL), F.col("often_all")))).select("key", "code", "p_own", "p_all")

    def closed(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """Adds the words in ``open`` to the mean. None of the n-grams that meet here is frequent, so no key is hot."""
        rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "open")
        words = rows.filter(F.size("open") > 0).select("place", "key", F.posexplode("open").alias("word", "it")).select("place", "key", "word", "it.*")
        met = words.select("place", "word", "key", "own", "general", "times", F.explode("codes").alias("code")).join(self.others(names), ["key", "code"])
        by = met.groupBy("place", "word").agg(*(F.first(c).alias(c) for c in ("own", "general", "times")), F.sum("p_own").alias("p_own"), F.sum("p_all").alias("p_all"))
        a, b = F.col("own") + F.col("p_own") + float(np.log(1 - GENERAL)), F.col("general") + F.col("p_all") + float(np.log(GENERAL))
        mixed = F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))
        more = by.groupBy("place").agg(F.sum(-F.col("times") * mixed).alias("more"))
        total = F.col("nats") + F.coalesce(F.col("more") / F.col("n_words"), F.lit(0.0))
        return rows.join(more, "place", "left").withColumn("nats", total).drop("place", "open", "more")

    def measured(self, docs: DataFrame, carried: DataFrame) -> DataFrame:
        """``carried`` (its first column, then lang and text) with base counts, language key and nats in place of both."""
        first = carried.schema[0]
        schema = StructType([StructField(first.name, first.dataType), *StructType.fromDDL(_STATS).fields])
        known, out = self.known, None
        for at, group in enumerate(self.groups):
            shared = docs.sparkSession.sparkContext.broadcast(self.models(group))  # MODEL_BYTES or so
            whole = not self.least.keys() & {*group, ALL}
            made = schema if whole else StructType([*schema.fields, StructField("open", StructType.fromDDL(f"o {_OPEN}")["o"].dataType)])

            def run(batches: Iterator, shared=shared, whole=whole, names=made.fieldNames()) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    for at in range(0, batch.num_rows, ROWS):
                        part = batch.slice(at, ROWS)
                        for name, rows in by_language(part.column(1).to_pylist(), known):
                            mine = part.take(_places(rows))
                            tokens = Tokens(mine.column(2))
                            # without a model no text of the language has a word, so any model serves
                            n, open_ = nats(tokens, *(shared.value.get(k, NONE) for k in (name, ALL)), whole)
                            base = base_counts(mine.column(2), tokens)
                            columns = [mine.column(0), *map(pa.array, base), pa.array([name] * len(rows), pa.string()), pa.array(n, mask=np.isnan(n))]
                            if not whole:
                                columns.append(open_)
                            yield pa.RecordBatch.from_arrays(columns, names=names)

            some = self.of(at, carried).mapInArrow(run, made)
            some = some if whole else self.closed(some, group)
            out = some if out is None else out.unionByName(some)
        return out


def bands(measured: DataFrame) -> DataFrame:
    """key, band_rows, band_low, band_high of every language, before the grant for short texts; null: no band."""
    value = F.when(F.col("nats").isNotNull() & ~F.col("base_failed"), F.col("nats"))
    by = measured.groupBy("key").agg(F.percentile_approx(value, [0.25, 0.5, 0.75], 2000).alias("q"), F.count(F.lit(1)).alias("band_rows"))
    q = F.when(F.col("band_rows") >= ENOUGH, F.col("q"))
    half = (q[2] - q[0]) / 2
    return by.select("key", "band_rows", (q[1] - F.greatest(F.lit(LEAST), BELOW[0] * half)).alias("band_low"), (q[1] + F.greatest(F.lit(LEAST), ABOVE[0] * half)).alias("band_high"))


def verdicts(measured: DataFrame) -> DataFrame:
    """``measured``, which must be stored, with low, high and kept."""
    banded = attach(measured, stored(bands(measured), "bands"), "key", "band_rows").drop("band_rows", "key")
    n = F.greatest("n_words", F.lit(1))
    low, high = (reach[1] / F.sqrt(n) + reach[2] / n for reach in (BELOW, ABOVE))
    limits = banded.withColumn("low", F.col("band_low") - low).withColumn("high", F.col("band_high") + high).drop("band_low", "band_high")
    return limits.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, verdict, nats a word and the band of every row of ``docs``."""
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), filled(F.col("text")).alias("text"))
    return verdicts(stored(Judge(docs).measured(docs, carried), "measured"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Measured rows are stored, so no text is shuffled
    but those of languages with less than one row in HOT_SHARE, which meet their bands there."""
    rows = packed_rows(docs)
    carried = rows.select("row", F.col("row.lang").cast("string").alias("lang"), filled(F.col("row.text")).alias("text"))
    return verdicts(stored(Judge(docs).measured(docs, carried), "measured")).filter("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nats", "low", "high")


QUERIES, SQL = {"op7_quality_rules": op7_quality_rules}, {}
