import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, words, n):
    """Sentences: a capital first, a stop last."""
    out = []
    while len(out) < n:
        s = list(rng.choice(words, rng.integers(4, 9)))
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


def vocabulary(rng, letters, n=300):
    return ["".join(rng.choice(list(letters), k)) for k in rng.integers(2, 8, n)]


class Brute:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts):
        self.n = {4: collections.Counter(g for t in texts for g in grams(t))}
        for k in (3, 2, 1):
            self.n[k] = collections.Counter(g[1:] for g in self.n[k + 1])
        self.cut = {k: quality.discounts(*(sum(v == j for v in self.n[k].values()) for j in (1, 2, 3, 4))) for k in self.n}
        self.total = {k: collections.Counter() for k in self.n}
        self.kept = {k: collections.Counter() for k in self.n}
        for k in self.n:
            for g, n in self.n[k].items():
                self.total[k][g[:-1]] += n
                self.kept[k][g[:-1]] += n - self.cut[k][min(n, 3) - 1]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 256
        total = self.total[k][g[:-1]]
        if not total:
            return self.p(g[1:])
        n = self.n[k][g]
        return ((n - self.cut[k][min(n, 3) - 1] if n else 0) + (total - self.kept[k][g[:-1]]) * self.p(g[1:])) / total


def stream(text):
    return b"\n\n" + b"".join(b" " + w for w in text.encode().split()) + b" "


def grams(text):
    x = stream(text)
    return [x[i - 3 : i + 1] for i in range(3, len(x))] if text.split() else []


def brute_nats(text, own, general):
    each, at, out = grams(text), 0, 0.0
    words = text.encode().split()
    for w in words:
        part = each[at : at + len(w) + 1]
        at += len(w) + 1
        out -= math.log(0.75 * math.prod(map(own.p, part)) + 0.25 * math.prod(map(general.p, part)))
    return out / len(words)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    known = {"en": vocabulary(rng, "aeinrstlo"), None: vocabulary(rng, "бгджзклмпфхц"), "yy": vocabulary(rng, "xyzw")}
    out = [(i, prose(rng, known[lang], 40), lang) for i, lang in enumerate(["en"] * 70 + [None] * 60 + ["yy"] * 5)]
    return out + [(900, "a", "en"), (901, "", "en"), (902, None, "zz"), (903, "!", None)]


@pytest.mark.parametrize("room", [quality.MODEL_BYTES, 1])  # one pass for all languages, and one for each
def test_perplexity_equals_brute_force(spark, monkeypatch, rows, room):
    monkeypatch.setattr(quality, "MODEL_BYTES", room)
    got = {r["doc_id"]: r["nats"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    group = lambda lang: lang if lang in ("en", None) else "*"
    models = {k: Brute([t or "" for _, t, lang in rows if group(lang) == k]) for k in ("en", None, "*")}
    general = Brute([t or "" for _, t, _ in rows])
    assert len(got) == len(rows) and got[901] is None and got[902] is None
    for i, t, lang in rows:
        if t:
            assert got[i] == pytest.approx(brute_nats(t, models[group(lang)], general), rel=1e-6)


def test_probabilities_sum_to_one(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "KEEP_SHARE", 2.0**-10)  # most n-grams are left to the back-off
    judge = quality.Judge(spark.createDataFrame(rows, SCHEMA))
    model = judge.models([k for g in judge.groups for k in g])["=en"]
    for context in (b"ing", b"a. ", b"e r", b"zzz", b"\n\n "):
        codes = (int.from_bytes(context, "big") << 8) | np.arange(256)
        assert np.exp(model.log_p(codes)).sum() == pytest.approx(1, abs=1e-6)


def test_shuffled_texts_score_worse(spark):
    rng = np.random.default_rng(9)
    words = vocabulary(rng, "aeinrstlo")
    texts = [prose(rng, words, 120) for _ in range(80)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, " ".join(rng.permutation(t.split())), "en") for i, t in enumerate(texts[:20])]
    got = {r["doc_id"]: r["nats"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    worse = [got[100 + i] - got[i] for i in range(20)]
    assert min(worse) > 0 and np.mean(worse) > 5 * np.std(worse) / 20**0.5


def test_bands(spark):
    rng = np.random.default_rng(5)
    common, rare = vocabulary(rng, "aeinrst"), vocabulary(rng, "бгджзклмпфхц")
    rows = [(i, prose(rng, common, 60), "en") for i in range(400)] + [(500 + i, prose(rng, rare, 60), "xx") for i in range(60)] + [(600 + i, prose(rng, rare, 60), "yy") for i in range(5)]
    rows += [(700 + i, " ".join(w + "***" + "#%&"[k % 3] * 6 for k, w in enumerate(prose(rng, common, 60).split())), "en") for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("row", F.lit(1)).withColumn("nats", F.lit("n"))
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert len(kept & set(range(400))) >= 396 and len(kept & set(range(500, 560))) >= 58
    assert kept >= set(range(600, 605))  # too few rows for a band
    assert not kept & set(range(700, 708))
    passed = quality.passing(docs)
    assert passed.columns == docs.columns and {r["doc_id"] for r in passed.collect()} == kept
    assert {(r["key"], r["row"], r["nats"]) for r in passed.collect()} == {("k", 1, "n")}


@pytest.mark.parametrize("room, large", [(quality.MODEL_BYTES, set()), (150_000, {"=en", quality.ALL}), (1, {"=en", "", quality.RARE, quality.ALL})])
def test_rare_ngrams_count_whatever_workers_hold(spark, monkeypatch, rows, room, large):
    monkeypatch.setattr(quality, "KEEP_SHARE", 2.0**-8)
    monkeypatch.setattr(quality, "MODEL_BYTES", room)
    rows = [*rows, (904, "zq zqzqzq " * 3 + "a1b2c3", "en"), (905, "Ω", "yy")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    judge = quality.Judge(docs)
    left = {k: judge.others([k]).count() for k in ("=en", "", quality.RARE)}
    assert judge.least.keys() == large and all(left.values()) == any(left.values()) == bool(large)
    carried = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r["nats"] for r in judge.measured(docs, carried).collect()}
    group = lambda lang: lang if lang in ("en", None) else "*"
    models = {k: Brute([t or "" for _, t, lang in rows if group(lang) == k]) for k in ("en", None, "*")}
    general = Brute([t or "" for _, t, _ in rows])
    assert got.keys() == {i for i, _, _ in rows} and got[901] is None and got[902] is None
    for i, t, lang in rows:
        if t:
            assert got[i] == pytest.approx(brute_nats(t, models[group(lang)], general), rel=1e-6)


def test_languages_without_words_keep_their_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(quality, "MODEL_BYTES", 1)  # a pass for each language
    blank = [(2000 + i, [None, "", " \n"][i % 3], "bb" if i < 60 else "cc") for i in range(62)]
    for some in (blank, [r for r in rows if r[2] != "yy"] + blank):
        got = quality.judge(spark.createDataFrame(some, SCHEMA)).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in some)
        assert not any(r["kept"] or r["n_words"] for r in got if r["doc_id"] >= 2000)
