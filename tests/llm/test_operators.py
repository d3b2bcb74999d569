import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.llm import exact_dedup, extract, licenses, lm_score, mixing, near_dedup, packing, quality, secrets, toxicity
from lumenflow.llm.common import scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = "AKIA" + "Q7" * 10
NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
TEXTS = [
    None, "", "   ", "a b  c", "a b c", "a\tb\nc", "a b c", LONG, LONG + " end", "A B c D e F", "a b c d e f",
    f"token = 'abcdef1' and {KEY} 0123456789abcdef01234567 é token:abc", "All rights reserved.\nCC BY and the\nThis work is licensed under the GNU General Public License, version 3.",
    "line\nline\nother\n\nline", "one two three four five six one two three four five six seven eight nine ten", "\U0001f600 ünï\x85code \xa0 x", "x" * 70_000,
]
CLASH = ("digest", "key", "n", "row", "size", "source_size", "nats", "component_id", "found", "copies", "_keep", "_id", "_words", "padded", "held_out", "block")
MORE = tuple("x" for _ in CLASH)
ROWS = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2", "s1"][i % 4], len(t or ""), *MORE) for i, t in enumerate(TEXTS)] + [(3, "a b  c", "en", "s2", 6, *MORE), (None, "nobody", None, None, 6, *MORE)]
#: The last columns clash with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in ROWS]


def test_exact_dedup(spark, docs, none):
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[SPACE.sub(" ", t)].append(i)
    expected = sorted((i if i is not None else -1, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    got = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, scratch(spark, "index"))).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert exact_dedup.deduplicate(none, exact_dedup.DigestIndex(spark, scratch(spark, "index"))).count() == 0
    assert exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, scratch(spark, "index"))).count() == len(groups)
    assert exact_dedup.drop_copies(docs, exact_dedup.DigestIndex(spark, scratch(spark, "index"))).columns == docs.columns


def test_exact_dedup_in_batches(spark):
    index = exact_dedup.DigestIndex(spark, scratch(spark, "index"))
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.deduplicate(make((5, "x"), (6, "y")), index)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(make((1, "x"), (2, "z")), index).collect()}
    assert got == {1: (5, False), 2: (2, True)}
    assert {r["digest"] for r in index.rows().collect()} == {hashlib.sha256(x.encode()).digest() for x in "xyz"}


def test_exact_dedup_counts_all_batches(spark):
    path = scratch(spark, "index")
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string, _keep string, key string, row string")
    sizes = []
    for name, i in (("a", 5), ("b", 1), ("c", 7), ("c", 7)):  # the last batch is repeated
        index = exact_dedup.DigestIndex(spark, path, 10_000_000)
        sizes.append([(r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(make((i, "x", "", "", "")), index, name).collect()])
        index.close()
    assert sizes == [[(5, 1, True)], [(5, 2, False)], [(5, 3, False)], [(5, 3, False)]]
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 16 and index.rows().count() == 3
    left = exact_dedup.drop_copies(make((1, "x", "", "", ""), (2, "new", "p", "q", "r"), (2, "new", "p", "q", "r"), (3, "new", "", "", "")), index).collect()
    assert [tuple(r) for r in left] == [(2, "new", "p", "q", "r")]


BASE = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6, 2), ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile("[0-9a-f]+"), 24, 0))


def brute_secrets(text):
    """Counts of the base kinds, digest of their spans, all spans."""
    found = [(m.start(), k, m.end(), name) for k, (name, p, least, group) in enumerate(BASE) for m in p.finditer(text) if len(m.group(group)) >= least]
    more = [(m.start(), k, m.end(), name) for k, (name, p, least, group) in enumerate(secrets.RULES) if k >= len(BASE) for m in re.finditer(p, text) if len(m.group(group)) >= least]
    shown = lambda rows: ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(rows))
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(shown(found).encode()).hexdigest(), shown(found + more))


def test_secrets_of_whole_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in secrets.op2_secret_scan(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: brute_secrets(r["text"] or "") for r in docs}
    assert sum(x[0] for x in got.values()) and sum(x[2] for x in got.values())


def test_many_secrets_in_a_text(spark):
    texts = ["token=abcdef " * 100_000, "AKIA" + "A" * 500_000, "0123456789abcdef" * 20_000 + "x", "eyJ" * 50_000, "\U0001f600token:abcdef\U0001f600" * 300, KEY + KEY]
    got = {r["doc_id"]: tuple(r)[1:] for r in secrets.digested(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secrets.Ledger(spark, scratch(spark, "ledger")))).collect()}
    assert got == {i: brute_secrets(t) for i, t in enumerate(texts)}


def test_secrets(spark, docs, none):
    got = {tuple(r) for r in secrets.digested(secrets.scan(docs, secrets.Ledger(spark, scratch(spark, "ledger")))).collect()}
    assert got == {(i, *brute_secrets(t)) for i, t in texts()}
    assert secrets.scan(none, secrets.Ledger(spark, scratch(spark, "ledger"))).count() == 0


def test_secrets_scan_a_blob_once(spark):
    ledger = secrets.Ledger(spark, scratch(spark, "ledger"))
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    secrets.scan(make((1, KEY), (2, KEY)), ledger)
    assert [len(r["found"]) for r in secrets.scan(make((7, KEY), (8, "z")), ledger).orderBy("doc_id").collect()] == [1, 0]
    assert ledger.of(secrets.RULE_VERSION).count() == 2


def test_packing(docs, none):
    rows = packing.packed(docs, packing.vocabulary_path()).toPandas()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    for i, t in dict((i, t) for i, t in texts() if i not in (None, 3)).items():
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        pieces = rows[rows.doc_id == i].sort_values("start")
        assert pieces.doc_tokens.unique().tolist() == [len(ids)] and pieces.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.packed(none, packing.vocabulary_path()).count() == 0


def test_packing_pads_one_window_at_most():
    lengths = np.random.default_rng(0).integers(1, 5000, 400).tolist()
    windows = packing.pack(lengths)
    assert sum(sum(x[2] for x in pieces) for _, pieces in windows) == sum(lengths)
    assert sum(w != sum(x[2] for x in pieces) for w, pieces in windows) <= 1


def test_language_model(docs, none):
    tokens = lambda t: [w.translate({a: a + 32 for a in range(65, 91)}) for w in WORD.findall(t)] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for i, t in texts():
        if not held(i):
            w = tokens(t)
            one.update(w)
            two.update(zip(["^", *w], w))
            starts += 1
    n, z = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    expected = collections.Counter()
    for i, t in texts():
        w = tokens(t)
        p = [(one[x] + 0.5) / z for x in w]
        full = sum(np.log10((two[v, x] + lm_score.MU * q) / ((starts if v == "^" else one[v]) + lm_score.MU)) for v, x, q in zip(["^", *w], w, p))
        expected[i, held(i), len(w), sum(one[x] > 0 for x in w), n, round(float(np.log10(p).sum()), 4), round(float(full), 4)] += 1
    got = collections.Counter((r[0], *r[1:5], round(r[5], 4), round(r[6], 4)) for r in lm_score.scored(docs).collect())
    assert got == expected
    assert lm_score.scored(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.allot(docs).collect()
    assert len(rows) == len(ROWS) and all(r["size"] == len(WORD.findall(t)) for r in rows for i, t in texts() if i == r["doc_id"] and i != 3)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.allot(docs.repartition(5)).collect()))
    assert mixing.allot(none).count() == 0 and mixing.repeated(docs).columns == docs.columns


def test_mixing_comes_near_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.lognormal(4, 1))), f"s{i % 3}") for i in range(3000)]
    got = mixing.allot(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= by["size"] / mixing.BIG).all()  # what is drawn last is no large document


def test_licenses(docs, none):
    for r in licenses.scan(docs).collect():
        if r["doc_id"] in (None, 3):
            continue
        words = [w for w in re.split(licenses.GAP, (ROWS[r["doc_id"]][1] or "").translate({a: a + 32 for a in range(65, 91)})) if w]
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    assert licenses.scan(none).count() == 0


def brute_licenses(text):
    """Labels of all templates that some run of words meets."""
    words, labels = licenses.split_words(text), set()
    for label, t in licenses.TEMPLATES:
        known, n = set(licenses.split_words(t)), licenses.reach(t)
        if max(len(known & set(words[i : i + n])) for i in range(max(1, len(words) - n + 1))) >= licenses.THRESHOLD * len(known) - 1e-9:
            labels.add(label)
    return labels


def test_license_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    lines = []
    for _, text in licenses.TEMPLATES:
        words = text.split()
        for share in (0.6, 0.75, 0.8, 0.9, 1.0):
            lines.append(" ".join([*rng.permutation(words)[: round(share * len(words))], "more", "words"]))
    lines += [("filler " * k + lines[k % len(lines)] + " filler" * 600) for k in range(490, 530)]  # across the edges of pieces
    for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect():
        assert set(filter(None, r["labels"].split(","))) == brute_licenses(lines[r["doc_id"]]) | set(filter(None, r["base_labels"].split(",")))


def test_many_licenses_in_a_text(spark):
    texts = ["all rights reserved " * 30_000, "apache " * 100_000, NOTICE * 3000, "general public license cc by\n" * 20_000]
    began = time.time()
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["labels"]) for i in range(4)] == [(30_000, 0, 89_997, "reserved"), (0, None, None, ""), (0, None, None, "mit"), (40_000, 0, 99_998, "cc-by,gpl")]
    assert [len(got[i]["at"]) for i in range(4)] == [30_000, 0, 0, 40_000] and time.time() - began < 60


def test_quality(docs, none):
    for r in quality.judge(docs).collect():
        t = ROWS[r["doc_id"]][1] or "" if r["doc_id"] not in (None, 3) else None
        if t is None:
            continue
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        flags = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(flags))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(flags) > 20 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(none).count() == 0 and quality.passing(none).count() == 0
    assert quality.passing(docs).columns == docs.columns


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class="site"><h1>Shop</h1></header><nav><a href="/">Home</a></nav>
<article><h1>Head</h1><p>First &amp; <b>bold</b>
 text<p>Second<br>line</p><aside>See also</aside><section id="comments"><p>Nice post</p></section></article><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body>"""


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (5, "u", "<b>" * 3000 + "x", "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extracted(pages).collect()}
    assert got[1] == ("Head First & bold text Second line", 34)
    assert got[2] == got[3] == got[4] == ("", 0)
    assert extract.extracted(pages.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, None), (None, 0, 1), (1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        rows = toxicity.scored(docs, toxicity.train(docs, table)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.scored(none, toxicity.train(none, labels)).count() == 0


def test_toxicity_on_held_out_texts():
    rng = np.random.default_rng(4)
    plain = lambda: ["".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "ran", "sel"], 3)) for _ in range(60)]
    bad = lambda: [*plain(), *rng.choice(["grumpf", "zwackel", "horrid"], 4)]
    make = lambda f, n: [" ".join(rng.permutation(f())) for _ in range(n)]
    scorer = toxicity.fit(make(bad, 200), make(plain, 400), (200, 400))
    right = sum(scorer.score(t) >= 0.3 for t in make(bad, 50)) + sum(scorer.score(t) < 0.3 for t in make(plain, 50))
    assert right >= 95


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x.translate({a: a + 32 for a in range(65, 91)}) for x in WORD.findall(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if (least.get(find(k)), i) != (None, None) else None
    return collections.Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_near_duplicates(docs, none):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.components(docs).collect())
    assert got == brute_components(texts())
    assert near_dedup.components(none).count() == 0 and near_dedup.one_of_each(docs).columns == docs.columns


@pytest.mark.parametrize("volume", [near_dedup.VOLUME, 5000])  # buckets of one block and of many
def test_near_duplicates_of_a_spread_group(spark, monkeypatch, volume):
    monkeypatch.setattr(near_dedup, "VOLUME", volume)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 160)]
    rows = []
    for i in range(120):  # edits of one text: many pairs are just above or below the threshold
        t = list(base)
        for k in rng.integers(0, len(t), rng.integers(1, 5)):
            t[k] = f"e{rng.integers(0, 5000)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " ".join(f"o{x}" for x in rng.integers(0, 500, 50))) for i in range(30)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


WRAPPED = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal',
    "mit ": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,',
    "apache": '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.',
    "apache ": ' * distributed under the License is distributed on an "AS IS" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express\n * or implied.',
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


def test_wrapped_licenses(spark):
    apart = "\n".join(w + " filler" * 9 for w in WRAPPED["bsd"].split())  # the words of a notice, too far from each other
    texts = [f"some prose\n{t}\nmore prose" for t in WRAPPED.values()] + [apart]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == [x.strip() for x in WRAPPED] + [""]


def test_license_runs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _, text in licenses.TEMPLATES:
        for drop in (0.0, 0.1, 0.2, 0.3):
            words = [w for w in text.split() if rng.random() >= drop]
            for at in sorted(rng.integers(0, len(words) + 1, 3), reverse=True):
                words.insert(at, "odd")
            texts.append("\n".join(["head", "the"] * 40 + words + ["tail", "of"] * 40))
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert set(filter(None, r["labels"].split(","))) == brute_licenses(texts[r["doc_id"]]) | set(filter(None, r["base_labels"].split(",")))


NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "reserved", "Licensed under CC BY-NC 4.0.": "cc-by",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the MIT License": "mit", "Licensed under the Apache License": "apache",
    "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.": "bsd", "Licensed under the BSD License": "bsd", "under the terms of the Mozilla Public\nLicense, v. 2.0": "mpl",
    "a Creative Commons Attribution 4.0 License": "cc-by", "// SPDX-License-Identifier: Apache-2.0": "apache", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd", "SPDX-License-Identifier: MPL-2.0": "mpl", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl",
}


def test_short_notices(spark):
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(i, f"some prose\n{t}\nmore prose") for i, t in enumerate(NOTICES)], "doc_id long, text string")).collect()}
    assert {t: found[i] for i, t in enumerate(NOTICES)} == NOTICES
