"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows of a bounded sample of labelled training rows: one on the windows of
ordinary texts, one on those windows of toxic texts that hold a fragment far more common there, as the rest of a toxic
text reads like any other. A window is a word of letters and digits, or a piece of a long one, pieces overlapping by
half; its bytes are widened four times so that even a short match outweighs the fixed cost of a match. The triple
(bytes, bytes under the ordinary dictionary, bytes under the toxic one) of a window has thresholds calibrated on other
rows of the sample, as a log ratio of how often toxic and ordinary texts hold it. The ratios of all windows of a text
go into a logistic regression, fitted on a third part of the sample and weighted to the labels' real shares.

SAMPLE bounds the rows used for fitting by class; rows that repeat a doc_id with other texts may fill it up. Scoring
reads every whole text. Defined results: null text is empty and scores as a text with no window does; without a labelled
row of either class in each of the sample's three parts every score is the share of toxic labels (0 without labels);
where samples are too few for the dictionary trainer their windows are the dictionary as they stand; labels that repeat
count once, as toxic if one of them says so, and null labels are left out; documents that repeat score alike, one row
each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filled, ship

#: Labelled rows used for fitting: toxic, ordinary.
SAMPLE = (1500, 3000)
FOLDS, HELD_OUT = 4, 2
LIMIT = 0.3
#: Bytes of a dictionary, of widened text; how many times as common a fragment must be in toxic texts; level of compression.
DICTIONARY, RATIO, LEVEL = 32768, 20.0, 3
GRAM = 5
CACHE = 200_000
#: Bytes of a window at most; a longer word is cut every PIECE / 2 bytes.
PIECE = 16
_WORD = re.compile(r"[^\W_]+")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def windows(text: str) -> list[bytes]:
    out = []
    for word in _WORD.findall(text.lower()):
        w = word.encode()
        out += [w] if len(w) <= PIECE else [w[at : at + PIECE] for at in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


def _grams(word: bytes) -> set[bytes]:
    x = b" " + word + b" "
    return {x[i : i + GRAM] for i in range(max(1, len(x) - GRAM + 1))}


def _distinct(texts: list[list[bytes]]) -> list[set[bytes]]:
    """Word sets of the texts; of near copies, which share their least shingle, mostly one."""
    import xxhash

    least = {min((xxhash.xxh3_64_intdigest(b" ".join(t[i : i + 5])) for i in range(max(1, len(t) - 4))), default=0): set(t) for t in texts}
    return list(least.values())


def dictionary(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """A dictionary trained on samples, and whether it could be; else the samples themselves, the commonest last."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, d=8, k=64, level=LEVEL).as_bytes(), True
    except z.ZstdError:
        n = Counter(samples)
        return b"".join(sorted(n, key=lambda w: (n[w], w)))[-size:], False


class Distance:
    """Compressed sizes of windows under two dictionaries."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]):
        self.wide = [x.tobytes() for x in np.random.default_rng(5).integers(0, 256, (256, 4), dtype=np.uint8)]
        self.parts = tuple(dictionary([self.widened(b" " + w + b" ") for w in ws], DICTIONARY) for ws in (ordinary, toxic))
        self.open()

    def open(self) -> None:
        import zstandard as z

        settings = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3)
        self.shrink, self.seen = [], {}
        for part, trained in self.parts:
            held = z.ZstdCompressionDict(part, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.shrink.append(z.ZstdCompressor(dict_data=held, compression_params=settings).compress)

    def widened(self, x: bytes) -> bytes:
        return b"".join([self.wide[b] for b in x])

    def __getstate__(self):
        return self.parts, self.wide

    def __setstate__(self, state):
        self.parts, self.wide = state
        self.open()

    def cells(self, words: list[bytes]) -> dict[tuple[int, int, int], int]:
        """How many of the distinct windows have each triple."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        out, seen = {}, self.seen
        for w in set(words):
            cell = seen.get(w)
            if cell is None:
                x = self.widened(b" " + w + b" ")
                cell = seen[w] = (len(w), *(len(f(x)) for f in self.shrink))
            out[cell] = out.get(cell, 0) + 1
        return out


def train_distance(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Distance:
    a, b = _distinct(toxic), _distinct(ordinary)
    in_a, in_b = (Counter(g for ws in docs for g in {g for w in ws for g in _grams(w)}) for docs in (a, b))
    good = {g for g, k in in_a.items() if k >= max(3, 0.005 * len(a)) and k / len(a) >= RATIO * (in_b[g] + 0.5) / (len(b) + 1)}
    return Distance([w for ws in b for w in sorted(ws)], [w for ws in a for w in sorted(ws) if not good.isdisjoint(_grams(w))])


class Scorer:
    def __init__(self, prior: float):
        self.prior, self.distance, self.ratios, self.weights = prior, None, {}, None

    def features(self, words: list[bytes]) -> list[float]:
        cells = self.distance.cells(words)
        most = max((self.ratios.get(c, 0.0) for c in cells), default=0.0)
        total = sum(max(0.0, self.ratios.get(c, 0.0)) * n for c, n in cells.items())
        return [1.0, most, max(0.0, most - 4.0), np.log1p(total), total / (1 + len(words)), np.log1p(len(words))]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(windows(text)), self.weights), -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-1, rounds: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(toxic: list[str], ordinary: list[str], shares: tuple[int, int]) -> Scorer:
    """toxic and ordinary texts in a random order; shares: how many rows of each class there really are."""
    total = sum(shares)
    scorer = Scorer(shares[0] / total if total else 0.0)
    a, b = ([windows(t) for t in texts] for texts in (toxic, ordinary))
    if min(len(a), len(b)) < 4:  # no part may be empty
        return scorer
    (a1, a2, a3), (b1, b2, b3) = ((x[: len(x) // 2], x[len(x) // 2 : len(x) * 3 // 4], x[len(x) * 3 // 4 :]) for x in (a, b))
    scorer.distance = train_distance(a1, b1)
    in_a, in_b = (Counter(c for t in x for c in scorer.distance.cells(t)) for x in (a2, b2))
    n, m = len(a2) + 0.6, len(b2) + 0.6
    scorer.ratios = {c: float(np.log(((in_a[c] + 0.3) / n) / ((in_b[c] + 0.3) / m))) for c in {*in_a, *in_b}}
    x = np.array([scorer.features(t) for t in a3 + b3])
    y = np.r_[np.ones(len(a3)), np.zeros(len(b3))]
    scorer.weights = logistic(x, y, np.where(y > 0, shares[0] / len(a3), shares[1] / len(b3)) * len(y) / total)
    return scorer


def train(docs: DataFrame, labels: DataFrame, sample=SAMPLE) -> Scorer:
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(F.col("doc_id")) != HELD_OUT).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("bad"))
    shares = {r["bad"]: r["count"] for r in known.groupBy("bad").count().collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = known.filter("bad").orderBy(order, "doc_id").limit(sample[0]).unionByName(known.filter("NOT bad").orderBy(order, "doc_id").limit(sample[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")  # sum(sample) rows at most
    rows = sorted({(r["doc_id"], r["bad"], r["text"]) for r in texts.withColumn("o", order).orderBy("o").limit(2 * sum(sample)).collect()})
    mixed = [rows[i] for i in np.random.default_rng(3).permutation(len(rows))]
    return fit([t for _, bad, t in mixed if bad], [t for _, bad, t in mixed if not bad], (shares.get(True, 0), shares.get(False, 0)))


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shared.value.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES, SQL = {"op9_toxicity": op9_toxicity}, {}
