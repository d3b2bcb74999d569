"""The five stages against plain Python, each on what the stage before it kept."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from lumenflow.llm import mixing, packing, quality
from lumenflow.llm.common import packed_rows
from test_mixing import brute_targets
from test_operators import brute_components
from test_quality import Brute, brute_nats, prose, vocabulary

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, copies long"


def documents():
    rng = np.random.default_rng(12)
    words = {"en": vocabulary(rng, "aeinrstlo"), "de": vocabulary(rng, "bcdfghkmou")}
    rows = [(i, prose(rng, words[lang], int(rng.integers(8, 120))), lang) for i in range(150) for lang in [("en", "de")[i % 2]]]
    rows += [(200 + i, re.sub(" ", "  ", rows[i][1], count=3), rows[i][2]) for i in range(12)]  # exact copies
    rows += [(300 + i, f"{rows[i % 8][1]} end{i}", rows[i % 8][2]) for i in range(16)]  # near copies
    rows += [(400 + i, "spam spam spam spam spam " * 5, "en") for i in range(3)] + [(500, None, "en"), (501, "", None), (502, "short text", "xx")]
    rows += [(600, " ".join("".join(rng.choice(list("Q7#*$%&@!^+=~ZXJ"), 30)) for _ in range(60)), "en"), (601, " ".join(["\U0001f600 ünï"] * 3 + [f"wörd{k}" for k in range(30)]), None)]
    return [(i, t, lang, ("s1", None, "s2", "s3")[i % 4], len(t or ""), "r", "k", 7) for i, t, lang in rows]


def judged(rows):
    """ids that pass the base rules and their language's band."""
    counts = collections.Counter(r[2] for r in rows)
    group = lambda lang: lang if counts[lang] >= quality.ENOUGH else "*"
    models = {k: Brute([r[1] or "" for r in rows if group(r[2]) == k]) for k in {group(r[2]) for r in rows}}
    general, nats, failed = Brute([r[1] or "" for r in rows]), {}, {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        failed[r[0]] = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        nats[r[0]] = brute_nats(r[1], models[group(r[2])], general) if w else None
    kept = set()
    for k in models:
        mine = [r for r in rows if group(r[2]) == k]
        scores = sorted(nats[r[0]] for r in mine if nats[r[0]] is not None and not failed[r[0]])
        q = [scores[math.ceil(p * len(scores)) - 1] for p in (0.25, 0.5, 0.75)] if len(mine) >= quality.ENOUGH else None
        for r in mine:
            n = max(1, len(WORD.findall(r[1] or "")))
            reach = lambda side: max(quality.LEAST, side[0] * (q[2] - q[0]) / 2) + side[1] / n**0.5 + side[2] / n  # noqa: B023, E731
            if not failed[r[0]] and (q is None or q[1] - reach(quality.BELOW) <= nats[r[0]] <= q[1] + reach(quality.ABOVE)):
                kept.add(r[0])
    return kept


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    by_id = {r[0]: r for r in rows}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mix", "packing"]

    def after(name, given):
        path = str(tmp_path / name.replace(" ", "-"))
        stages[name](spark, given, "").write.parquet(path)
        return spark.read.parquet(path)

    good = after("quality rules", docs)
    expected = judged(rows)
    assert sorted(map(tuple, good.collect())) == sorted(by_id[i] for i in expected) and 600 not in expected and 601 in expected

    unique = after("exact dedup", good)
    first = {}
    for i in sorted(expected):
        first.setdefault(hashlib.sha256(SPACE.sub(" ", by_id[i][1]).encode()).digest(), i)
    assert sorted(map(tuple, unique.collect())) == sorted(by_id[i] for i in first.values()) and len(first) < len(expected)

    apart = after("near dedup", unique)
    left = [(i, by_id[i][1]) for i in sorted(first.values())]
    alone = {i for i, _, least in brute_components(left) if i == least}
    assert sorted(map(tuple, apart.collect())) == sorted(by_id[i] for i in alone) and len(alone) < len(left)

    mixed = after("source mix", apart)
    copies = collections.Counter(map(tuple, mixed.collect()))
    sizes = collections.Counter()
    for i in alone:
        sizes[by_id[i][3]] += len(WORD.findall(by_id[i][1]))
    goals = brute_targets(sizes)
    assert set(copies) <= {by_id[i] for i in alone}
    for i in alone:
        rate = goals[by_id[i][3]] / sizes[by_id[i][3]]
        assert math.floor(rate) <= copies[by_id[i]] <= math.ceil(rate)
    for source, goal in goals.items():
        taken = sum(n * len(WORD.findall(r[1])) for r, n in copies.items() if r[3] == source)
        assert abs(taken - goal) <= max(sizes[source] / mixing.BIG, 120)

    pieces = after("packing", mixed).toPandas()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    for r, n in copies.items():
        ids = np.array([*whole.encode(r[1], add_special_tokens=False).ids, packing.END], "<u4")
        mine = pieces[pieces.doc_id == r[0]]
        assert mine.length.sum() == n * len(ids) and (mine.doc_tokens == len(ids)).all()
        covered = collections.Counter(k for a, m in zip(mine.start, mine.length) for k in range(a, a + m))
        assert covered == {k: n for k in range(len(ids))}
        assert all(zlib.crc32(ids[a : a + m].tobytes()) == c for a, m, c in zip(mine.start, mine.length, mine.ids_crc32))
    assert set(pieces.doc_id) == {r[0] for r in copies}
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def test_rows_packed_and_unpacked_are_the_same(spark):
    docs = spark.createDataFrame([(1, "a", 2.0)], "`doc id` long, row string, `a.b` double")
    again = packed_rows(docs).select("row.*")
    assert again.columns == docs.columns and again.collect() == docs.collect()
