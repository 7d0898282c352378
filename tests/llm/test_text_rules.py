"""Quality rules, co-training, toxicity, licences."""

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA

from tidewell.llm import cotraining, license_scan, quality_rules, toxicity
from tidewell.llm._common import table


@pytest.fixture(scope="module")
def odd_tables(odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd") / "documents")
    odd.write.parquet(at)
    return {"documents": f"{at}/*.parquet"}


def test_rules_equal_sql(spark, same_as_sql, odd, odd_tables):
    same_as_sql(quality_rules.op1(table(spark, DATA, "documents")), quality_rules.SQL)
    same_as_sql(quality_rules.op1(odd), quality_rules.SQL, odd_tables)


def test_rules_by_hand(spark):
    text = "a b c d\nx y z\na b c d\n#!\nx y z"
    got = quality_rules.op1(spark.createDataFrame([(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string")).first()
    assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (15, 16, 1, 2, 14)
    assert got.base_failed and not got.kept


def test_rules_on_odd_input(empty, clashing):
    assert quality_rules.op1(empty).count() == 0
    got = {(r.doc_id, r.n_words) for r in quality_rules.op1(clashing).collect()}
    assert (3, 0) in got and (6, 30000) in got


def test_sketches_merge(spark, odd):
    m = quality_rules.measures(odd)
    parts = quality_rules.sketches(m.where("doc_id % 2 = 0")).unionByName(quality_rules.sketches(m.where("doc_id % 2 = 1 or doc_id is null")))
    whole = quality_rules.sketches(m)
    by = ["lang", "source"]
    assert sorted(map(str, quality_rules.merge(parts, by).collect())) == sorted(map(str, quality_rules.merge(whole, by).collect()))


def test_repeated_windows_do_not_rest_on_hashes(spark):
    """With hashes that fall together the windows themselves decide."""
    from pyspark.sql import functions as F

    texts = ["a b c a b c d", "a b c d e f", "a b c x b c a b c", "x x x x", "a b", "q a b c q d b c q a b c"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")

    def slow(t):
        w = t.split()
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({p + k for x in at.values() if len(x) > 1 for p in x for k in range(3)})

    for hashed in (F.xxhash64, lambda a, b, c: F.lit(0).cast("bigint") + 0 * F.length(a), lambda a, b, c: F.length(F.concat(a, b, c)).cast("bigint") * 65536 + F.ascii(a).cast("bigint") * 4096):
        assert [r[0] for r in df.select(quality_rules.repeat_words(F.col("w"), hashed)).collect()] == [slow(t) for t in texts]


def test_groups_have_their_own_fences(spark):
    """A group's thresholds move with its own documents, at any size, and its language's draw them less the larger it is."""
    from pyspark.sql import functions as F

    measured = lambda n, size: [("en", f"s{n}-{size}", size)] * n
    rows = measured(20_000, 500) + [x for n in (3, 30, 300, 3000) for x in measured(n, 900)]
    df = spark.createDataFrame(rows, "lang string, source string, b_length bigint").withColumns({"base_failed": F.lit(False), **{f"b_{m}": F.lit(0).cast("bigint") for m in quality_rules.MEASURES if m != "length"}})
    high = {r._source: r.length_high for r in quality_rules.fences(quality_rules.sketches(df)).collect()}
    assert high["s20000-500"] < high["s3-900"] < high["s30-900"] < high["s300-900"] < high["s3000-900"] <= 900 + 3 * 400
    # at sf0.1 most groups' fences are not those of their language
    m = quality_rules.measures(table(spark, "/root/testdata/sf0.1", "documents"))
    f = quality_rules.fences(quality_rules.sketches(m)).collect()
    assert len({(r._lang, r.length_high, r.length_low, r.repeats_high) for r in f}) > 0.9 * len(f)


def test_long_words_have_bins(spark):
    """Of texts without spaces one that is far longer is rejected."""
    rows = [(i, " ".join(["x" * (60 + i % 7) + str(k) for k in range(60)]), "zz", "s") for i in range(200)] + [(999, " ".join(["y" * 5000 + str(k) for k in range(60)]), "zz", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.op1(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not got.pop(999) and all(got.values())


def test_classifier_holds_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    half = labels.where("doc_id % 2 = 0")
    rows = {r.doc_id: r for r in cotraining.scored(docs, cotraining.train(docs, half)).collect()}
    assert len(rows) == docs.count()
    unseen = [(r.quality, rows[r.doc_id]._kept) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([bool(q) == k for q, k in unseen]) > 0.95


def test_classifier_on_odd_input(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    none = labels.where("false")
    assert cotraining.op2(empty, none).count() == 0
    got = cotraining.op2(odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept and r.score == 1.0 for r in got)  # no labels of both kinds
    assert cotraining.keep_good(clashing, none).columns == clashing.columns


def _pool(n=3000, sources=40, seed=1):
    """The text says a little of every document; a source says all of its own, but the labels show few of the sources."""
    r = np.random.default_rng(seed)
    of = r.integers(0, sources, n)
    y = of % 2
    a = (2 * y - 1 + 1.2 * r.normal(size=n))[:, None].astype(np.float32)
    known = np.flatnonzero(of < 4)[:160]
    return a, [("en", f"s{k}", 1000) for k in of], y, known, np.setdiff1d(np.arange(n), known)


def _proposer(rid, a, b, calls):
    def propose(views, taken):
        calls.append(1)
        free = np.flatnonzero(~np.isin(rid, taken))
        return [(v, label, float(z), int(rid[free[i]]), a[free[i]], b[free[i]]) for v, label, zs, at in cotraining.surest(views, rid[free], a[free], [b[i] for i in free]) for z, i in zip(zs, at, strict=True)]

    return propose


def test_views_exchange_labels(monkeypatch):
    """What the text is sure of teaches the metadata sources without a label; without the exchange it cannot."""
    a, b, y, known, rest = _pool()

    def right():
        calls = []
        m = cotraining.cotrain(known, a[known], [b[i] for i in known], y[known], np.arange(len(known)) % 4 == 0, _proposer(rest, a[rest], [b[i] for i in rest], calls))
        _, q, p = m.score(a[rest], [b[i] for i in rest])
        return np.mean((p >= 0.5) == y[rest]), np.mean((q >= 0.5) == y[rest]), len(calls)

    with_, meta, calls = right()
    monkeypatch.setattr(cotraining, "ROUNDS", 0)
    without, blind, none = right()
    assert calls > 1 and none == 0
    assert with_ > 0.93 and with_ > without + 0.08 and meta > blind + 0.2


def slow_cotraining(rows, labels, fold):
    """The same by plain loops over all rows in memory: rows (rid, doc_id, measures, metadata), labels by doc_id, fold: doc_ids kept for calibration."""
    rows = sorted(rows, key=lambda r: r[0])
    known = [r for r in rows if r[1] in labels]
    own = [[(r[2], r[3], labels[r[1]]) for r in known if r[1] not in fold] for _ in range(2)]
    taken = set()
    for k in range(cotraining.ROUNDS + 1):
        text = cotraining.Linear(np.stack([x for x, _, _ in own[0]]), np.array([t for _, _, t in own[0]], float))
        seen = cotraining.Meta([m for _, m, _ in own[1]], np.array([t for _, _, t in own[1]], float))
        meta = cotraining.Linear(seen([m for _, m, _ in own[1]]), np.array([t for _, _, t in own[1]], float))
        odds = lambda r: (float(text.logit(r[2][None])[0]), float(meta.logit(seen([r[3]]))[0]))
        if k == cotraining.ROUNDS:
            break
        free = [(r, odds(r)) for r in rows if r[1] not in labels and r[0] not in taken]
        given = []
        for view in (0, 1):
            for label in (0, 1):
                sure = sorted((-(z[view] if label else -z[view]), r[0], r) for r, z in free if (z[view] if label else -z[view]) >= np.log(cotraining.CONFIDENT / (1 - cotraining.CONFIDENT)))
                given += [(view, label, r) for _, _, r in sure[: cotraining.PER_ROUND]]
        for view, label, r in given:
            if not any(q[0] == r[0] and x != label for _, x, q in given):
                own[1 - view].append((r[2], r[3], label))
        if not given:
            break
        taken |= {r[0] for _, _, r in given}
    held = [r for r in known if r[1] in fold]
    y = np.array([labels[r[1]] for r in held], float)
    z = np.array([odds(r) for r in held])
    scale = [cotraining.Linear(z[:, [k]], y) for k in (0, 1)]
    both = cotraining.Linear(np.column_stack([scale[k].logit(z[:, [k]]) for k in (0, 1)]), y)
    out = {}
    for r in rows:
        la, lb = (float(scale[k].logit(np.array([[odds(r)[k]]]))[0]) for k in (0, 1))
        out[r[1]] = 1 / (1 + np.exp(-float(both.logit(np.array([[la, lb]]))[0])))
    return out


def test_classifier_equals_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(cotraining, "PER_ROUND", 15)
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 500"), table(spark, "/root/testdata/sf0.01", "labels").where("doc_id < 500")
    rows = [(r.rid, r.doc_id, np.array(r.a, np.float32), (r.lang, r.source, r.n_chars)) for r in cotraining.measured(docs).collect()]
    fold = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0).collect()}
    want = slow_cotraining(rows, {r.doc_id: r.quality for r in labels.collect()}, fold)
    got = {r.doc_id: r for r in cotraining.op2(docs, labels).collect()}
    assert got.keys() == want.keys() and all(got[d].score == pytest.approx(want[d], abs=1e-6) and got[d].kept == (got[d].score >= 0.5) for d in want)
    kept = {r.doc_id for r in cotraining.keep_good(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.kept}


def test_toxicity_holds_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = {r.doc_id: r for r in toxicity.op8(docs, labels).collect()}
    held = [(r.toxic, rows[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for _, r in held) and all(0 <= r.score <= 1 for _, r in held)
    assert np.mean([bool(t) == (r.predicted == 1) for t, r in held]) > 0.96


def _toxic_rows(n=400):
    words = ["calm", "kind", "plain", "quiet", "soft", "warm", "mild"]
    return [(i, ". ".join(" ".join(words[(i + j + k) % 7] for k in range(5)) for j in range(4)) + (". you vile crook" if i % 3 == 0 else "."), int(i % 3 == 0)) for i in range(n)]


def _toxic_model(spark, rows=None):
    rows = rows or _toxic_rows()
    return toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))


def slow_bags(text):
    """Sentences of a text as sets of features, by plain string work: terms, and their first 2 to 8 bytes."""
    fold = lambda c: c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c
    out = []
    for sentence in re.split(r"[.!?\n]", text or ""):
        terms = ["".join(t).encode() for t in re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(map(fold, sentence)))]
        if terms:
            out.append({t for t in terms} | {(t[:n], n) for t in terms for n in range(2, 9) if len(t) > n})
    return out


def slow_toxicity(rows, score):
    """Scores of texts from a dense noisy-or model of plain strings; ``rows``: doc_id, text, label."""
    rows = sorted(r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1)
    bags, y = [slow_bags(t) for _, t, _ in rows], np.array([r[2] for r in rows])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    names = []
    for f in sorted({f for b in bags for s in b for f in s}, key=repr):
        a = sum(any(f in s for s in b) for b, t in zip(bags, y, strict=True) if t)
        c = sum(any(f in s for s in b) for b, t in zip(bags, y, strict=True) if not t)
        cells = ((a, n1, a + c), (c, n0, a + c), (n1 - a, n1, n1 + n0 - a - c), (n0 - c, n0, n1 + n0 - a - c))
        ratio = 2 * sum(x * np.log(x * (n1 + n0) / (n * k)) for x, n, k in cells if x)
        if a + c >= toxicity.LEAST_DOCS and a * n0 > 2 * c * n1 and ratio >= toxicity.LEAST_RATIO:
            names.append(f)
    dense = lambda b: np.array([[f in s for f in names] for s in b], float).reshape(len(b), len(names))
    x = [dense(b) for b in bags]
    theta, m, v = np.r_[np.zeros(len(names)), -5.0], 0, 0
    weight = np.where(y == 1, y.mean() / n1, (1 - y.mean()) / n0)
    for k in range(1, toxicity.ROUNDS + 1):
        grad = np.r_[toxicity.DECAY / max(1, len(names)) * theta[:-1], 0.0]
        for d, t, w in zip(x, y, weight, strict=True):
            s = 1 / (1 + np.exp(-(d @ theta[:-1] + theta[-1])))
            none = np.prod(1 - s)
            # d loss / d z = s * d loss / d log(1 - p), negated for the toxic
            dz = s * w * (-none / max(1 - none, 1e-9) if t else 1.0)
            grad += np.r_[d.T @ dz, dz.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - toxicity.RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return [1 - np.prod(1 - 1 / (1 + np.exp(-(dense(b) @ theta[:-1] + theta[-1])))) for b in map(slow_bags, score)]


def test_toxicity_equals_brute_force(spark):
    rows = _toxic_rows(90)
    rows = [(i, t + (" ÜBEL crooked" if i % 6 == 0 else ""), y) for i, t, y in rows]
    asked = [t for _, t, _ in rows] + ["", None, "Vile. vile! kind", "vi crooks\nübel", "x × vile×crook"]
    got = toxicity.op8(spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(asked[90:])], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    by = {r.doc_id: r.score for r in got.collect()}
    want = slow_toxicity(rows, asked)
    assert [by[i] for i in range(90)] + [by[1000 + i] for i in range(5)] == pytest.approx(want, abs=1e-6)
    assert max(want[:90]) > 0.9 and min(want[:90]) < 0.1


def test_toxicity_locates_sentences(spark):
    m = _toxic_model(spark)
    text = "Ünder calm kind. Soft vile crook here! Warm."
    [s], [[(a, b, one)]] = m.read([text.encode()])
    assert text[a:b] == "Soft vile crook here" and one >= 0.5
    assert s == pytest.approx(1 - np.prod(1 - m.sentences(toxicity.Bags([text.encode()]))))
    long = "é kind. " * 20_000 + text + " You vile crook"
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([(1, text), (2, None), (3, long)], "doc_id bigint, text string"), m).collect()}
    assert [text[x.begin : x.end] for x in got[1].offending] == ["Soft vile crook here"] and got[2].offending == []
    assert [long[x.begin : x.end] for x in got[3].offending] == ["Soft vile crook here", "You vile crook"]


def test_toxicity_query_tells_where(spark):
    """Of documents called toxic the query names sentences; on rows held out most of these are read from the text alone."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in toxicity.op8(docs, labels).collect() if r.predicted]
    assert rows and sum(bool(r.offending) for r in rows) >= 0.9 * len(rows)
    assert all(0 <= x.begin < x.end <= len(text[r.doc_id]) for r in rows for x in r.offending)


def test_toxicity_learns_one_row_of_a_doc_id(spark):
    rows = _toxic_rows()
    many = rows + [rows[0]] * 300 + [(rows[0][0], "another text", 0)] * 200
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    m = toxicity.train(spark.createDataFrame([r[:2] for r in many], "doc_id bigint, text string").repartition(5), labels)
    one = _toxic_model(spark, rows)
    t = [b"soft vile crook", b"kind"]
    assert m.read(t)[0] == pytest.approx(one.read(t)[0], abs=0.02)


def test_toxicity_on_odd_input(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    assert toxicity.op8(empty, labels).count() == 0
    got = toxicity.op8(clashing, labels).collect()
    assert len(got) == odd.count() and all(r.score == 0 for r in got)
    assert [toxicity.Bags([b"", b" .. ", b"a.b\nc"]).doc.tolist()] == [[2, 2, 2]]
    m = _toxic_model(spark)
    assert all(r.score == 0 for r in toxicity.scored(odd, m).collect() if r.doc_id in (3, 4, 5))


def test_licences_equal_sql(spark, same_as_sql, odd, odd_tables):
    same_as_sql(license_scan.op6(table(spark, "/root/testdata/sf0.01", "documents")), license_scan.SQL, {"documents": "/root/testdata/sf0.01/documents.parquet"})
    same_as_sql(license_scan.op6(odd), license_scan.SQL, odd_tables)


def test_essential_terms_lose_nothing():
    _, _, notices = license_scan.vectors()
    need = set(license_scan.essential(notices))
    for _, v in notices:
        assert sum(x * x for t, x in v.items() if t not in need) < license_scan.THRESHOLD**2


def test_licences_by_hand(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/x.py", "# Licensed under the Apache License, Version 2.0.\nprint()"), ("r/a/y.py", "print()"), ("r/a/b/z.py", "the work is mine"), ("r/c/COPYING.txt", "Licensed under CC BY-NC 4.0."),
        ("r/c/d/w.py", None), ("q/v.py", ""), (None, "x"), ("r/a/y.py", "print()"), ("top.py", "x"),
    ]
    got = license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, text string"))).collect()
    by = {r.path: (r.licence, r.inherited_from) for r in got}
    assert len(got) == len(rows)
    assert by["r/LICENSE"] == ("MIT", None) and by["r/a/x.py"] == ("Apache-2.0", None) and by["r/a/y.py"] == ("MIT", "r") and by["r/a/b/z.py"] == ("MIT", "r")
    assert by["r/c/d/w.py"] == ("CC-BY-NC-4.0", "r/c") and by["q/v.py"] == (None, None) and by[None] == (None, None) and by["top.py"] == (None, None)


@pytest.mark.parametrize("top", ["", "/"])
def test_a_licence_at_the_top_is_inherited(spark, top):
    rows = [(f"{top}LICENSE", MIT), (f"{top}src/a.py", "x"), (f"{top}src/deep/er/b.py", "x"), (f"{top}b.py", "x"), (f"{top}p/COPYING", "Licensed under CC BY 4.0."), (f"{top}p/q/c.py", "x"), (None, "x")]
    got = {r.path: (r.licence, r.inherited_from) for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, text string"))).collect()}
    assert [got[f"{top}{p}"] for p in ("src/a.py", "src/deep/er/b.py", "b.py")] == [("MIT", "")] * 3
    assert got[f"{top}p/q/c.py"] == ("CC-BY-4.0", f"{top}p") and got[None] == (None, None)


MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_wrapped_headers_and_whole_licence_texts(spark):
    gpl = """# mod.py - {}
#
# This {} is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.

import os
"""
    bsd = "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */\nint x;"
    # full texts by their counts of terms: order has no weight
    full = {n: " ".join(f"{t} " * c for t, c in v.items()) for n, v in json.loads(Path(license_scan.__file__).with_name("licence_texts.json").read_text()).items()}
    rows = [("a/m.py", gpl.format("a tool", "program", "", "3")), ("a/n.py", gpl.format("a tool", "program", "", "2")), ("a/l.py", gpl.format("a tool", "library", "Lesser ", "2.1")), ("b/x.c", bsd), ("c/LICENSE", MIT), ("c/d/x.txt", "hello")]
    rows += [(f"{n}/COPYING", t) for n, t in full.items()]
    got = {r.path: r.licence for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "path string, text string"))).collect()}
    assert [got[p] for p in ("a/m.py", "a/n.py", "a/l.py", "b/x.c", "c/LICENSE", "c/d/x.txt")] == ["GPL-3.0", "GPL-2.0", "LGPL-2.1", "BSD-3-Clause", "MIT", "MIT"]
    assert all(got[f"{n}/COPYING"] == n for n in full)


def test_a_full_licence_text_is_a_licence_file(spark):
    docs = spark.createDataFrame([(1, MIT, "en", "a", 1), (70, "hello there", "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in license_scan.op6(docs).collect()}
    assert got[1].path == "a/en/0/LICENSE.1" and got[1].licence == "MIT" and (got[70].licence, got[70].inherited_from) == ("MIT", "a/en/0")


BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation."""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software."""


def test_like_licences_are_told_apart(spark):
    commented = lambda s: "\n".join(f" * {x}" for x in s.splitlines())
    want = {
        "a/two.c": (commented(BSD_2) + "\nint x;", "BSD-2-Clause"), "a/three.c": (commented(BSD_3) + "\nint x;", "BSD-3-Clause"), "a/open.c": ("// " + BSD_2.split(":")[0].replace("\n", " ") + ":", "BSD-3-Clause"),
        "b/app.min.js": ("/*! " + MIT.replace("\n", " ") + " */\n!function(){}()", "MIT"), "c/UNLICENSE": ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy", "Unlicense"), "c/x.py": ("pass", "Unlicense"),
        "d/MIT-LICENSE.txt": (MIT, "MIT"), "d/x/y.py": ("pass", "MIT"), "e/b.hpp": ("//  Distributed under the Boost Software License, Version 1.0. (See\n//  accompanying file LICENSE_1_0.txt or copy at\n//  http://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
        "f/E.java": ("/*\n * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n */", "EPL-2.0"), "g/licensed.py": ("pass", None), "h/relicense.md": ("text", None), "h/k.py": ("pass", None),
    }
    got = {r.path: r.licence for r in license_scan.inherit(license_scan.scan(spark.createDataFrame([(p, t) for p, (t, _) in want.items()], "path string, text string"))).collect()}
    assert got == {p: l for p, (_, l) in want.items()}


def test_licences_on_odd_input(empty, clashing, odd):
    assert license_scan.op6(empty).count() == 0
    assert license_scan.op6(clashing).count() == odd.count()
    assert not re.search("(?i)licen", "".join(r.text or "" for r in odd.collect()))
