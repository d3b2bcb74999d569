"""Near-duplicate groups by SuperMinHash, banding, verification and union by least label.

1. Every document's set of five-word shingles gets a SuperMinHash signature: each element deals its ranks to slots in
   the order of its own random permutation, and stops as soon as no slot can fall further. Documents with equal sets
   are one class, so exact copies are never compared.
2. Classes that agree on a band of the signature share a bucket. Within a bucket all are compared with one center only.
3. Pairs are verified on full sets, regrouped by center in portions of PORTION members, so no task holds a large group.
4. Verified links are joined to components by least labels with pointer jumps.
5. Buckets that still hold several components are searched completely, in blocks: chunks of members by chunks of those
   outside the bucket's largest component. A first search by signatures keeps the members with a candidate in their
   block; a second one verifies candidates on full sets where they meet, joins components as it goes, and returns only
   links that join two. So members that resemble each other but not their center are found, too, and no list of pairs
   is written. Each pair is met in the first band that both share.

A link is missed if no band of the two signatures agrees, or if they agree on less than HOPELESS of their slots. At
similarity 0.85, with 20 bands of 5 and independent slots, that is 8e-6 and 5e-10.

Defined results: null text counts as empty; texts without words have no shingles, no links and stay, each by itself; a
text of fewer than five words has one shingle, all of it; rows that repeat doc_id are in one component if their sets
are linked, and with other texts each has its own; a null doc_id is larger than any other; an empty table gives no rows; further columns, of any name, are ignored by
``components`` and passed through by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, documents, filled, packed_rows, ship, stored

SHINGLE = 5
SLOTS, BANDS = 100, 20
#: Link two sets when PERCENT * union <= 100 * intersection.
PERCENT = 85
#: Pairs whose signatures agree on a smaller part of the slots aren't verified. Of pairs at the threshold 5e-10 fall
#: below it, counting slots as independent, which is the worst case: far fewer than share no band.
HOPELESS = 0.6
PORTION = 64
#: Shingles in a chunk of members; a member counts LEAST at least.
VOLUME, LEAST = 250_000, 250
#: Members searched by one call, or those of one block if they are more.
ROWS = 1000
CACHE = 300_000
#: Shingles whose permutations are held at once.
ELEMENTS = 250_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(17).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self):
        self.seen = _Hashes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        look = self.seen.__getitem__
        split = [t.encode().lower().split() for t in texts]  # bytes: ASCII letters and ASCII white space only
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        x = np.fromiter((h for words in split for h in map(look, words)), np.uint64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            h = np.zeros(max(0, len(x) - SHINGLE + 1), np.uint64)
            for k, c in enumerate(_ODD):
                h += x[k : len(h) + k] * c
            h = _mix(h)
            return [self.short(x[end - n : end]) if n < SHINGLE else np.unique(h[end - n : end - SHINGLE + 1]) for n, end in zip(sizes.tolist(), ends.tolist())]

    @staticmethod
    def short(x: np.ndarray) -> np.ndarray:
        return _mix(np.array([len(x)], np.uint64) + (x * _ODD[: len(x)]).sum(keepdims=True)) if len(x) else np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash ranks of non-empty sets: step in the high half, draw in the low half of a 64-bit number."""
    sizes = np.array([len(s) for s in sets])
    rank = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    dealt = None
    with np.errstate(over="ignore"):
        for j in range(slots):
            z = _mix(x + np.uint64(j + 1) * _GOLD)
            at = j + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            if dealt is None:
                slot = at
            else:  # the permutation of each element, drawn one place at a time
                rows = np.arange(len(x))
                slot = dealt[rows, at].astype(np.int64)
                dealt[rows, at] = dealt[:, j]
            np.minimum.at(rank, owner * slots + slot, (np.uint64(j) << np.uint64(32)) | (z >> np.uint64(32)))
            open_ = rank.reshape(-1, slots).max(1) >= np.uint64(j + 1) << np.uint64(32)
            stay = open_[owner]
            if not stay.any():
                break
            if dealt is None:
                x, owner, at = x[stay], owner[stay], at[stay]
                dealt = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
                dealt[np.arange(len(x)), at] = dealt[:, 0]
            elif not stay.all():
                x, owner, dealt = x[stay], owner[stay], dealt[stay]
    return rank.reshape(-1, slots)


def band_keys(rank: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = rank.shape[1] // bands
    parts = rank.reshape(len(rank), bands, rows)
    h = np.tile(np.arange(bands, dtype=np.uint64), (len(rank), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = _mix(h * _GOLD + parts[:, :, k])
    return h.astype(np.int64)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), filled(text)).alias("key")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key that finds the row again, also where a doc_id stands for several texts."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text"), row_key(F.col("doc_id"), F.col("text")))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, and for texts with words: node (digest of the set), bands, sig (a byte for each slot)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingle = Shingler()

        def out(ids, finds, sets):
            full = [s for s in sets if len(s)]
            rank = signatures(full) if full else np.empty((0, SLOTS), np.uint64)
            keys, sig = band_keys(rank), _mix(rank).astype(np.uint8)
            node, bands, sigs, k = [], [], [], 0
            for s in sets:
                if len(s):
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(keys[k])
                    sigs.append(sig[k].tobytes())
                    k += 1
                else:
                    node, bands, sigs = [*node, None], [*bands, None], [*sigs, None]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(finds, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "key", "n_shingles", "node", "bands", "sig"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                ids, finds, sets, held = [], [], [], 0
                doc_ids, texts, keys = (part.column(i).to_pylist() for i in range(3))
                for doc_id, key, found in zip(doc_ids, keys, shingle(texts), strict=True):
                    ids.append(doc_id)
                    finds.append(key)
                    sets.append(found)
                    held += len(sets[-1])
                    if held >= ELEMENTS:
                        yield out(ids, finds, sets)
                        ids, finds, sets, held = [], [], [], 0
                if ids:
                    yield out(ids, finds, sets)

    return keyed(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, node binary, bands array<long>, sig binary")


def hopeful(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (node, center) whose sizes and signatures allow a link; centers of many pairs are broadcast."""
    pairs = stored(pairs, "near")
    b = nodes.select(F.col("node").alias("center"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    centers = stored(pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n")).join(b, "center"), "centers")
    a = nodes.select("node", F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    agree = F.aggregate(F.sequence(F.lit(1), F.lit(SLOTS)), F.lit(0), lambda n, i: n + F.when(F.substring("sig_a", i, F.lit(1)) == F.substring("sig_b", i, F.lit(1)), 1).otherwise(0))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    return attach(pairs, centers, "center", "n").join(a, "node").filter(fits & (agree >= HOPELESS * SLOTS)).select("node", "center")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (node, center) whose full sets are linked. Portions of centers share tasks of PORTION pairs or so."""
    pairs = stored(pairs.distinct(), "pairs")
    loads = stored(pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n")), "centers")
    tasks = max(1, pairs.count() // PORTION)
    task = F.pmod(F.xxhash64("center", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PORTION))), F.lit(tasks))
    dealt = stored(attach(pairs, loads, "center", "n").select("node", "center", task.alias("task")), "portions")
    need = dealt.unionByName(dealt.select(F.col("center").alias("node"), "center", "task").distinct())
    rows = need.join(nodes.select("node", "key"), "node").join(keyed(docs).select("key", "text"), "key").select("node", "center", "task", "text")

    def compare(frame):
        import pandas as pd
        import xxhash

        shingle, sets, out = Shingler(), {}, []
        one = frame.drop_duplicates(["node", "text"])
        for at in range(0, len(one), 50):
            part = one.iloc[at : at + 50]
            for node, found in zip(part["node"], shingle(part["text"].tolist()), strict=True):
                if xxhash.xxh3_128_digest(found.tobytes()) == node:
                    sets[node] = found
        for node, center in set(zip(frame["node"], frame["center"], strict=True)):
            if node != center:
                a, b = sets[center], sets[node]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= PERCENT * (len(a) + len(b) - both):
                    out.append((node, center))
        return pd.DataFrame(out, columns=["node", "center"])

    return stored(rows.groupBy("task").applyInPandas(compare, "node binary, center binary"), "links")


def labels(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; label is the least node of its component. Stored."""
    both = stored(links.select(F.col("node").alias("a"), F.col("center").alias("b")).unionByName(links.select(F.col("center").alias("a"), F.col("node").alias("b"))).distinct(), "edges")
    now = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = stored(now.join(near, "node").select("node", "label", F.least("label", "near").alias("next")), "step")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stored(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved")), "labels")
        now = after.select("node", "label")
        if after.filter("moved").limit(1).count() == 0:
            return now


def candidates(one: np.ndarray, k: int, size, sig, bands, band: int) -> np.ndarray:
    """Those of ``one`` whose sizes and signatures allow a link with k, and that share no earlier band than ``band``."""
    fits = one[100 * np.minimum(size[one], size[k]) >= PERCENT * np.maximum(size[one], size[k])]
    fits = fits[(sig[fits] == sig[k]).mean(1) >= HOPELESS] if len(fits) else fits
    same = bands[fits] == bands[k]
    return fits[bands[k][same.argmax(1)] == band] if len(fits) else fits


def blocks(frame):
    """(band, a, b, members of the chunk, others) of each block in a frame with a row per block and member."""
    frame = frame.sort_values(["band", "a", "b"], kind="stable")
    band, a, b, role, at = (frame[c].to_numpy() for c in ("band", "a", "b", "role", "at"))
    edges = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True])
    for lo, hi in zip(edges, edges[1:]):
        yield band[lo], a[lo], b[lo], at[lo:hi][role[lo:hi] < 2], set(at[lo:hi][role[lo:hi] == 1]), at[lo:hi][role[lo:hi] == 2]


def arrays(frame):
    """Sizes, signatures and bands of a frame's rows."""
    return frame["n_shingles"].to_numpy(), np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(len(frame), -1), np.array(frame["bands"].tolist(), np.int64)


def leftovers(members: DataFrame, nodes: DataFrame, label: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join the components left in a bucket: of each block's links between components, a spanning forest."""
    sized = members.join(nodes.select("node", "n_shingles"), "node")
    named = sized.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("vol", F.greatest("n_shingles", F.lit(LEAST)))
    parts = stored(named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("vol").alias("vol")), "parts")
    mixed = parts.groupBy("band").agg(F.sum("n").alias("size"), F.sum("vol").alias("vol"), F.max(F.struct("n", "label", "vol")).alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    chunks = lambda vol: F.ceil(vol / VOLUME).cast("int")
    mixed = stored(mixed.select("band", "size", F.col("top.label").alias("main"), chunks(F.col("vol")).alias("na"), chunks(F.col("vol") - F.col("top.vol")).alias("nb")), "mixed")
    if mixed.limit(1).count() == 0:
        return members.select("node", F.col("node").alias("center")).limit(0)
    rows = stored(attach(named.select("band", "node", "label"), mixed, "band", "size"), "mixed_rows")
    rest = F.col("label") != F.col("main")
    left = rows.select("band", F.pmod(F.hash("node"), "na").alias("a"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), "node", "label", rest.cast("int").alias("role"))
    right = rows.filter(rest).select("band", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("a"), F.pmod(F.hash("node"), "nb").alias("b"), "node", "label", F.lit(2).alias("role"))
    both = left.unionByName(right)
    about = nodes.select("node", "sig", "bands", "n_shingles")

    def search(frame):
        """Members of each block with a candidate there."""
        import pandas as pd

        frame = frame.reset_index(drop=True)
        frame["at"] = np.arange(len(frame))
        size, sig, bands = arrays(frame)
        kind, name = pd.factorize(frame["label"])[0], pd.factorize(frame["node"], sort=True)[0]
        hit = np.zeros(len(frame), bool)
        for band, _, _, one, odd, many in blocks(frame):
            for k in many:
                found = candidates(one[kind[one] != kind[k]], k, size, sig, bands, band)
                found = [i for i in found if i not in odd or name[i] < name[k]]
                hit[found] = True
                hit[k] |= bool(found)
        return frame.loc[hit, ["band", "a", "b", "node", "label", "role"]]

    tasks = max(1, rows.count() // ROWS)
    found = both.join(about, "node").withColumn("task", F.pmod(F.xxhash64("band", "a", "b"), F.lit(tasks))).groupBy("task")
    found = stored(found.applyInPandas(search, "band long, a int, b int, node binary, label binary, role int"), "found")
    tasks = max(1, found.count() // ROWS)
    places = found.withColumn("task", F.pmod(F.xxhash64("band", "a", "b"), F.lit(tasks))).groupBy("task", "node", "label").agg(F.collect_list(F.struct("band", "a", "b", "role")).alias("places"))
    full = stored(places, "places").join(nodes.select("node", "key", "sig", "bands", "n_shingles"), "node").join(keyed(docs).select("key", "text"), "key")

    def compare(frame):
        import pandas as pd
        import xxhash

        frame, shingle, keep, sets = frame.drop_duplicates(["node", "text"]), Shingler(), [], []
        seen = set()
        for lo in range(0, len(frame), 50):  # a key may find other texts than the node's
            part = frame.iloc[lo : lo + 50]
            for i, (node, x) in enumerate(zip(part["node"], shingle(part["text"].tolist()), strict=True), lo):
                if node not in seen and xxhash.xxh3_128_digest(x.tobytes()) == node:
                    seen.add(node)
                    keep.append(i)
                    sets.append(x)
        frame = frame.iloc[keep].reset_index(drop=True)
        size, sig, bands = arrays(frame)
        kind, name, node = pd.factorize(frame["label"])[0], pd.factorize(frame["node"], sort=True)[0], frame["node"].to_numpy()
        out = []
        table = pd.DataFrame([(p["band"], p["a"], p["b"], p["role"], at) for at, each in enumerate(frame["places"]) for p in each], columns=["band", "a", "b", "role", "at"])
        for band, _, _, one, odd, many in blocks(table):
            for k in many:
                for i in candidates(one[kind[one] != kind[k]], k, size, sig, bands, band):
                    if kind[i] == kind[k] or i in odd and name[i] >= name[k]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if 100 * both >= PERCENT * (len(sets[i]) + len(sets[k]) - both):
                        out.append((node[k], node[i]))
                        kind[kind == kind[k]] = kind[i]  # one component from here on
        return pd.DataFrame(out, columns=["node", "center"])

    return full.groupBy("task").applyInPandas(compare, "node binary, center binary")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return grouped(docs).drop("key")


def grouped(docs: DataFrame) -> DataFrame:
    """``components`` with the rows' keys."""
    ship(docs.sparkSession)
    seen = stored(signed(docs), "signed")
    some = seen.filter("node IS NOT NULL")
    nodes = stored(some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stored(members.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = stored(attach(members, buckets, "band", "n").select("band", "node", "center"), "members")
    links = verified(hopeful(shared.filter("node <> center").select("node", "center").distinct(), nodes), nodes, docs)
    label = labels(links)
    more = stored(leftovers(shared.select("band", "node"), nodes, label, docs), "leftovers")
    if more.limit(1).count():
        label = labels(links.unionByName(more))
    named = stored(nodes.select("node", "rep", "n_rows").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    least = stored(named.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    answer = stored(attach(named.select("node", "n_rows", "label"), least, "label", "n").select("node", "n_rows", "component_id"), "classes")
    linked = attach(some.select("doc_id", "n_shingles", "node", "key"), answer, "node", "n_rows").select("doc_id", "n_shingles", "component_id", "key")
    alone = seen.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key")
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = stored(grouped(docs).filter("kept").select("key").distinct(), "kept")
    rows = packed_rows(docs).select("row", row_key(F.col("row.doc_id"), F.col("row.text")))
    return rows.join(kept, "key", "left_semi").select("row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))


QUERIES, SQL = {"op10_near_duplicates": op10_near_duplicates}, {}
