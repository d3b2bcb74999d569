"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / source_size times. The whole part of that rate is certain; the
fractional part is rounded by pivotal steps: two documents exchange mass (words) until one of them is all in or all
out, with probabilities that keep both expectations. Words, not counts, are conserved, so a source's total misses its
target by less than one document. The few documents large within their source are rounded first, and what the last of
them leaves over is spread on the probabilities of all others, so that a total misses by one BIG-th of its source at most, unless nearly all its
documents are large. Documents are dealt to small blocks, each reduced to one unfinished document by a
fold over an ordered array; the unfinished ones are dealt to blocks of blocks, and so on: a reduction tree of depth
log(documents) / log(FAN). Draws are hashes of ids and a seed, so reruns agree.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own, ordered last; rows that
repeat doc_id, source and size share one decision, as one item of their joint mass; sources without words have target
0; an empty table gives no rows; further columns, of any name, are ignored by ``allot`` and passed through by
``repeated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, attach, documents, packed_rows, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Items a block holds on average.
FAN = 64
#: A document with more than one BIG-th of its source's words is rounded first; fewer than BIG of them exist.
BIG = 64
_ITEM = "struct<id:bigint,size:bigint,n:bigint,w:double,m:double>"
_DONE = "array<struct<id:bigint,size:bigint,full:boolean>>"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]+", "x"), f"[{SPACE}]+", ""))).otherwise(0).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the number of the source in code-point order, from 0: counted by ranges of sources."""
    order = F.col("source").asc_nulls_last()
    dealt = stored(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, before))
        before += n
    offsets = sizes.sparkSession.createDataFrame(offsets, "part int, before long")  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("before")
    return dealt.join(F.broadcast(offsets), "part").withColumn("place", place).drop("part", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size and more, a row a source) with target; weights dealt in code-point order.

    The excess of capped sources goes to the others by weight, which is a water level: it rises round by round, as
    sources that it covers are capped, until a round caps no other. All sums are of whole numbers, so reruns agree.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    one = stored(ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "weighted")
    whole, level, capped = share * (one.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        low = F.col("cap") < level * F.col("weight")
        r = one.agg(F.count_if(low).alias("n"), F.sum(F.when(low, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(low, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if r["n"] == capped:
            break
        capped, level = r["n"], (whole - r["cap"]) / r["weight"] if r["weight"] else float("inf")
    return one.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("place", "weight", "cap")


def _draw(seed: int, a: Column, b: Column) -> Column:
    return (F.xxhash64(F.lit(seed), a, b).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")


def _fold(items: Column, seed: int) -> Column:
    """struct(left, done): pivotal steps along an array of items with 0 < m < w; left is the one unfinished or null."""
    none = F.lit(None).cast(_ITEM)

    def done(item: Column, full: Column) -> Column:
        return F.array(F.struct(item["id"].alias("id"), item["size"].alias("size"), full.alias("full"))).cast(_DONE)

    def item(x: Column, mass: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["n"].alias("n"), x["w"].alias("w"), mass.alias("m")).cast(_ITEM)

    def step(acc: Column, b: Column) -> Column:
        a, out = acc["left"], acc["done"]
        up, down = F.least(a["w"] - a["m"], b["m"]), F.least(a["m"], b["w"] - b["m"])
        rise = _draw(seed, a["id"], b["id"]) * (up + down) < down
        ma, mb = F.when(rise, a["m"] + up).otherwise(a["m"] - down), F.when(rise, b["m"] - up).otherwise(b["m"] + down)
        a_ends = F.when(rise, a["w"] - a["m"] <= b["m"]).otherwise(a["m"] <= b["w"] - b["m"])
        b_ends = (mb <= 1e-9) | (mb >= b["w"] - 1e-9)
        first = F.struct(b.alias("left"), out.alias("done"))
        both = F.struct(none.alias("left"), F.concat(out, done(a, rise), done(b, mb > b["w"] / 2)).alias("done"))
        only_a = F.struct(item(b, mb).alias("left"), F.concat(out, done(a, rise)).alias("done"))
        only_b = F.struct(item(a, ma).alias("left"), F.concat(out, done(b, ~rise)).alias("done"))
        return F.when(a.isNull(), first).when(a_ends & b_ends, both).when(a_ends, only_a).otherwise(only_b)

    return F.aggregate(items, F.struct(none.alias("left"), F.array().cast(_DONE).alias("done")), step)


def allot(docs: DataFrame, seed: int = 7, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), "sizes")
    sized = sized.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    totals = sized.groupBy("source", "sid").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = stored(targets(totals), "targets")
    rated = attach(sized, goal.drop("source"), "sid", "n_rows").withColumn("rate", F.col("target") / F.col("source_size")).drop("n_rows")
    rated = rated.withColumn("sure", F.when(F.col("size") > 0, F.floor(F.col("rate") + 1e-12)).otherwise(0)).withColumn("part", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0))).otherwise(0.0))
    grouped = rated.filter("part > 1e-9").groupBy("sid", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("part"), F.first("source_size").alias("source_size"))
    grouped = stored(grouped.withColumn("w", (F.col("size") * F.col("n")).cast("double")).withColumn("big", F.col("w") * BIG > F.col("source_size")), "items")

    def as_item(part: Column) -> Column:
        return F.struct(F.col("doc_id").alias("id"), "size", "n", "w", (F.col("w") * part).alias("m")).cast(_ITEM)

    big = grouped.filter("big").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("by"), as_item(F.col("part")).alias("item")))).alias("all"))
    big = stored(big.select("sid", _fold(F.transform("all", lambda x: x["item"]), seed - 1).alias("r")), "big")
    pool = grouped.filter("NOT big").groupBy("sid").agg(F.sum("w").alias("pool"))
    full = _draw(seed - 1, F.col("r.left.id"), F.col("sid")) * F.col("r.left.w") < F.col("r.left.m")
    over = big.filter("r.left IS NOT NULL").select("sid", F.col("r.left.id").alias("id"), F.col("r.left.size").alias("size"), full.alias("full"), (F.col("r.left.m") - F.when(full, F.col("r.left.w")).otherwise(0.0)).alias("owed"))
    over = stored(over.join(pool, "sid", "left").withColumn("shift", F.col("owed") / F.col("pool")), "over")
    small = grouped.filter("NOT big").join(over.select("sid", "shift"), "sid", "left").withColumn("part", F.col("part") + F.coalesce("shift", F.lit(0.0)))
    items = small.filter("part > 1e-9 AND part < 1 - 1e-9").select("sid", as_item(F.col("part")).alias("item"))
    items = items.withColumn("key", F.xxhash64(F.lit(seed), "item.id", "item.size"))
    sure = small.filter("part >= 1 - 1e-9").select("sid", F.col("doc_id").alias("id"), "size", F.lit(True).alias("full"))
    finished = [sure, over.select("sid", "id", "size", "full"), big.select("sid", F.explode("r.done").alias("d")).select("sid", "d.*")]
    most = goal.agg(F.max("n_rows")).first()[0] or 0
    blocks, level = max(1, -(-most // fan)), 0
    while True:
        # A block is a slice of the hash: the next level's blocks are unions of this level's.
        dealt = items.withColumn("block", F.pmod("key", F.lit(blocks)))
        folded = dealt.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct(F.col("item")["w"].alias("by"), "item", "key"))).alias("all"))
        fold = stored(folded.select("sid", "block", _fold(F.transform("all", lambda x: x["item"]), seed + level).alias("r")), f"fold{level}")
        finished.append(fold.select("sid", F.explode("r.done").alias("d")).select("sid", "d.*"))
        items = fold.filter("r.left IS NOT NULL").select("sid", F.col("r.left").alias("item"), F.xxhash64(F.lit(seed + level + 1), "block").alias("key"))
        level += 1
        if blocks == 1:
            break
        blocks = -(-blocks // fan)
    # The last unfinished document of a source is drawn alone.
    last = items.select("sid", F.col("item")["id"].alias("id"), F.col("item")["size"].alias("size"), (_draw(seed, F.col("item")["id"], F.col("sid")) * F.col("item")["w"] < F.col("item")["m"]).alias("full"))
    decided = last
    for part in finished:
        decided = decided.unionByName(part)
    decided = decided.filter("full").select(F.col("sid").alias("d_sid"), F.col("id").alias("d_id"), F.col("size").alias("d_size"))
    match = (F.col("sid") == F.col("d_sid")) & F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("size") == F.col("d_size"))
    mixed = rated.join(decided, match, "left").withColumn("copies", (F.col("sure") + F.col("d_sid").isNotNull().cast("int")).cast("int"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as allotted, none, once or more, with all its columns."""
    plan = allot(docs, seed).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    rows = packed_rows(docs).select("row", words(F.col("row.text")).alias("n"))
    match = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    return rows.join(plan, match).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allot(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES, SQL = {"op5_source_mix": op5_source_mix}, {}
