"""Secret scan over an incremental ledger of blobs.

Each text is addressed by its SHA-256. The ledger holds every (blob, rule version) pair that was scanned; only pairs
it lacks are scanned, each blob once however many documents hold it, and the findings table is joined back to all
documents. Matches are found by the JVM's regular expressions, which read a text only where one alternation of all rules
matches it at all; the places of matches are running sums of the lengths of matches and of the pieces between them, in
code points, so a text with many matches costs little more than its reading.

Defined results: null text counts as empty and has no spans; documents that repeat are one blob and get the same
findings; a text may consist of matches only; an empty table gives no rows; further columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bucketed, attach, bucket_count, documents, filled, running_sums, scratch, stored

#: kind, pattern, least length of the group checked, that group. The first three are the base kinds.
RULES = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", r"[0-9a-f]{24,}+", 24, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", 40, 0),
    ("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+", 15, 0),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 0),
    ("urlauth", r"(?<![a-z])[a-z][a-z0-9+]{1,20}://[^\x00-\x20:/@]{1,64}:[^\x00-\x20:/@]{3,128}@", 0, 0),
)
BASE_KINDS = 3
RULE_VERSION = 2
#: Blobs in a bucket of the ledger, and the least number of buckets.
EACH, LEAST = 1_000_000, 16
_SPAN = "array<struct<at:int,rank:int,end:int,kind:string>>"


def find(texts: DataFrame, rules=RULES) -> DataFrame:
    """``texts`` with ``found`` in place of ``text``: an array of (at, rank, end, kind) by place.

    Of each rule the leftmost matches that do not overlap count, those too short left out. The steps are columns of
    their own, so that none is computed for each match.
    """
    pieces = texts.withColumn("any", F.col("text").rlike("|".join(f"(?:{r[1]})" for r in rules)))
    others = [c for c in texts.columns if c != "text"]
    cut = pieces.select(*others, *(c for k, rule in enumerate(rules) for c in _lengths(k, *rule[1:])))
    summed = cut.select("*", *(_whole(k) for k in range(len(rules))))
    started = summed.select("*", *(F.when(F.size(f"both{k}") > 0, running_sums(f"both{k}")).alias(f"start{k}") for k in range(len(rules))))
    return started.select(*others, F.array_sort(F.concat(*(_spans(k, rule[0], rule[2]) for k, rule in enumerate(rules)))).alias("found"))


def _lengths(k: int, pattern: str, least: int, group: int) -> list[Column]:
    """Lengths of the pieces between matches, of the matches, and of their checked parts; null where nothing matches."""
    here = F.col("any") & F.col("text").rlike(pattern)
    hit = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    parts = {"gap": F.split("text", pattern, -1), "hit": hit, "part": F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else hit}
    return [F.when(here, F.transform(x, lambda s: F.length(s).cast("long"))).alias(f"{name}{k}") for name, x in parts.items()]


def _whole(k: int) -> Column:
    return F.when(F.size(f"hit{k}") > 0, F.zip_with(f"gap{k}", f"hit{k}", lambda g, h: g + F.coalesce(h, F.lit(0)))).alias(f"both{k}")


def _spans(k: int, kind: str, least: int) -> Column:
    """(at, rank, end, kind) of a rule's matches, from where each piece starts."""
    zipped = F.zip_with(F.arrays_zip(F.col(f"gap{k}").alias("g"), F.col(f"hit{k}").alias("h"), F.col(f"part{k}").alias("p")), f"start{k}", lambda x, s: F.struct((x["g"] + s).alias("at"), x["h"].alias("h"), x["p"].alias("p")))
    good = F.filter(zipped, lambda x: x["h"].isNotNull() & (x["p"] >= least))
    one = F.transform(good, lambda x: F.struct(x["at"].alias("at"), F.lit(k).alias("rank"), (x["at"] + x["h"]).alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.size(f"hit{k}") > 0, one.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


class Ledger(Bucketed):
    """Scanned (blob, rule version) pairs and their findings. ``expected``: blobs it is to hold, when it is new."""

    def __init__(self, spark: SparkSession, path: str, expected: int = 0):
        super().__init__(spark, path, f"digest BINARY, version INT, found {_SPAN}", "digest", bucket_count(expected, EACH, LEAST))

    def of(self, version: int) -> DataFrame:
        return self.rows().filter(F.col("version") == version)


def scan(docs: DataFrame, ledger: Ledger, rules=RULES, version: int = RULE_VERSION) -> DataFrame:
    """doc_id and found (array of at, rank, end, kind by place) of every row; blobs in the ledger aren't read again."""
    addressed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), filled(F.col("text")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    paths = stored(addressed.select("doc_id", "digest"), "paths")
    blobs = stored(paths.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")), "blobs")
    unseen = blobs.join(ledger.of(version).select("digest").hint("merge"), "digest", "left_anti").select(F.col("digest").alias("blob"), "first_id")
    chosen = addressed.join(unseen, (F.col("digest") == F.col("blob")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    found = find(chosen.select("digest", "text"), rules)
    ledger.append(found.groupBy("digest").agg(F.first("found").alias("found")).withColumn("version", F.lit(version)))
    answers = stored(blobs.select("digest", "n_rows").join(ledger.of(version).select("digest", "found"), "digest"), "answers")
    return attach(paths, answers, "digest", "n_rows").select("doc_id", "found")


def digested(found: DataFrame) -> DataFrame:
    base = F.filter("found", lambda s: s["rank"] < BASE_KINDS)

    def count(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    counts = [count(k).alias(f"n_{RULES[k][0]}") for k in range(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark, scratch(spark, "ledger"), docs.count())
    report = digested(scan(docs, ledger))
    ledger.close()
    return report


QUERIES, SQL = {"op2_secret_scan": op2_secret_scan}, {}
