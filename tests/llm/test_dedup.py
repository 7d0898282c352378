"""SimHash near-dedup, substring dedup, decontamination, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import DATA

from tidewell.llm import components, decontamination, simhash, substring_dedup
from tidewell.llm._common import table

from .conftest import SCHEMA, prose


# ---- SimHash ----
def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    w = [x for x in words.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            k = top(i)
            least[k] = d if least[k] is None else min(least[k], d)
    return sorted(((d, f"{fp[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def check(docs):
    got = sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in simhash.op5(docs).collect()), key=repr)
    assert got == slow_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_simhash_equals_brute_force(spark, odd):
    check(odd)
    check(table(spark, DATA, "documents"))


def test_simhash_near_copies(spark):
    r = random.Random(5)
    base = prose(9, 400).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(400)] = "edit"
        rows.append((i, " ".join(w), "en", "a", 1))
    check(spark.createDataFrame(rows, SCHEMA))


def test_blocks_lose_no_pair(spark, monkeypatch):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(c) for c in centre]
    for c in centre:
        for _ in range(6):
            x = int(c)
            for b in r.choice(64, r.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "p0 bigint")

    def groups(edges):
        up = {x: x for x in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[top(a)] = top(b)
        out = defaultdict(set)
        for x in fps:
            out[top(x)].add(x)
        return sorted(map(sorted, out.values()))

    want = groups([(a, b) for a in fps for b in fps if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4])
    assert groups([tuple(x) for x in simhash.links(df).collect()]) == want
    monkeypatch.setattr(simhash, "BUCKET", 3)  # buckets over the bound are blocked again, more finely
    assert groups([tuple(x) for x in simhash.links(df).collect()]) == want


def test_links_of_wide_fingerprints_are_exact(spark, monkeypatch):
    """Chains of members that only meet their neighbours, in buckets far over the bound."""
    r = np.random.default_rng(5)
    rows = []
    for _ in range(4):
        x = [int(v) for v in r.integers(0, 1 << 63, 4, dtype=np.uint64)]
        for _ in range(60):
            for k, most in ((0, 7), (1, 12), (2, 12), (3, 12)):
                for b in r.choice(24 if k == 0 else 64, r.integers(1, most + 1), replace=False):
                    x[k] ^= 1 << int(b)
            rows.append(tuple(x))
    rows = sorted(set(rows))
    node = [int(v) for v in simhash.nodes(np.array(rows, np.uint64)).view(np.int64)]
    df = spark.createDataFrame([tuple(v - (1 << 64) if v >> 63 else v for v in x) for x in rows], "p0 bigint, p1 bigint, p2 bigint, p3 bigint").repartition(3)

    def groups(edges):
        up = {x: x for x in node}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[top(a)] = top(b)
        out = defaultdict(set)
        for x in node:
            out[top(x)].add(x)
        return sorted(map(sorted, out.values()))

    def close(x, y):
        apart = [(a ^ b).bit_count() for a, b in zip(x, y, strict=True)]
        return apart[0] <= simhash.NEAR.distance and sum(apart[1:]) <= simhash.NEAR.rest

    want = groups([(node[i], node[j]) for i in range(len(rows)) for j in range(i) if close(rows[i], rows[j])])
    assert 4 <= len(want) < len(rows) / 2
    for bucket in (20_000, 24, 4):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert groups([tuple(x) for x in simhash.links(df, simhash.NEAR).collect()]) == want


def test_masks_cover_every_close_pair():
    for rule in (simhash.CONTRACT, simhash.NEAR):
        for blocks, _ in rule.splits:
            own = simhash.masks(blocks, rule.distance)
            r = random.Random(blocks)
            for _ in range(200):
                x = sum(1 << b for b in r.sample(range(64), rule.distance))
                assert any(x & m == 0 for m in own)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, 100 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in range(100, 130)} | {got[200]}) == 1 and got[0] != got[200]
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert components.components(spark.createDataFrame([(None, 1), (2, None), (None, None), (3, 3)], "a bigint, b bigint")).count() == 0


def test_components_of_sorted_chains_take_few_rounds(spark, monkeypatch):
    seeds = []
    plain = components.contract
    monkeypatch.setattr(components, "contract", lambda left, seed: seeds.append(seed) or plain(left, seed))
    n = 2000
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(n)], "a bigint, b bigint")).collect()
    assert len(got) == n + 1 and len({r.root for r in got}) == 1
    assert len(seeds) <= 2 * n.bit_length()


def slow_wide(text):
    """The 256 bits of one text, from plain loops over the module's word hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return (0, 0, 0, 0)
    own = [int(h) for h in simhash.word_hashes(np.frombuffer(b" ".join(w) + b" ", np.uint8), *simhash.word_bounds(np.frombuffer(b" ".join(w) + b" ", np.uint8)))]
    out = []
    for n, k in ((2, 0), (5, 1), (5, 2), (5, 3)):
        votes, total = [0] * 64, 0
        for i in range(max(1, len(w) - n + 1)):
            h = simhash.Spans(np.array(own[i : i + n], np.uint64), simhash.WORD_BASE)(np.array([0]), np.array([len(own[i : i + n])]))
            h = int((simhash.mix(h + np.uint64(k * simhash.MIX_1 % (1 << 64))) if k else h)[0])
            total += 1
            for b in range(64):
                votes[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * votes[b] > total))
    return tuple(out)


def slow_near(rows):
    """doc_ids that near_dedup keeps, from all pairs."""
    fp = [slow_wide(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            apart = [(x ^ y).bit_count() for x, y in zip(fp[i], fp[j], strict=True)]
            if apart[0] <= simhash.NEAR.distance and sum(apart[1:]) <= simhash.NEAR.rest:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        k = top(i)
        if least.get(k) is None or d is not None and d < least[k]:
            least[k] = d
    return sorted(least.values(), key=lambda x: (x is None, x))


def kept_ids(out):
    return sorted((r.doc_id for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_near_dedup(odd, empty, clashing):
    assert simhash.op5(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    kept = simhash.near_dedup(clashing)
    assert kept.columns == clashing.columns
    ids = kept_ids(kept)
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and 3 in ids and ids.count(None) == 1
    assert ids == slow_near([(r.doc_id, r.text) for r in odd.collect()])


def test_near_dedup_equals_all_pairs(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    assert kept_ids(simhash.near_dedup(docs)) == slow_near([tuple(r) for r in docs.collect()])


def test_near_dedup_finds_what_is_alike(spark):
    """Of pairs with 0.8 of their 5-word shingles in common at least 0.9 lose one document; no document goes without a like one."""
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in rows}
    where = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            where[g].add(d)
    shared = defaultdict(int)
    for g in where.values():
        if len(g) < 200:
            for a in g:
                for b in g:
                    if a < b:
                        shared[a, b] += 1
    alike = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    kept = set(kept_ids(simhash.near_dedup(table(spark, "/root/testdata/sf0.01", "documents"))))
    pairs = [p for p, x in alike.items() if x >= 0.8]
    assert len(pairs) > 50 and np.mean([not (a in kept and b in kept) for a, b in pairs]) >= 0.9
    close = {d for p, x in alike.items() if x >= 0.5 for d in p}
    assert {d for d in sets if d not in kept} <= close


def test_hot_buckets_of_near_copies(spark, monkeypatch):
    """Buckets over the bound are linked in parts, to the same groups."""
    r = random.Random(11)
    rows = []
    for g in range(3):
        base = prose(700 + g, 300).split()
        for i in range(40):
            w = list(base)
            w[r.randrange(300)] = f"edit{i}"
            rows.append((1000 * g + i, " ".join(w)))
    rows += [(5000 + i, prose(800 + i, 100)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [0, 1000, 2000, *range(5000, 5020)]
    assert kept_ids(simhash.near_dedup(df)) == want
    monkeypatch.setattr(simhash, "BUCKET", 8)
    assert kept_ids(simhash.near_dedup(df)) == want
    monkeypatch.setattr(simhash, "SHIFTED", 4)
    assert kept_ids(simhash.near_dedup(df)) == want


# ---- substrings ----
def slow_substrings(rows, window=50):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def check_substrings(docs):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in substring_dedup.op3(docs).collect()), key=repr)
    want = slow_substrings([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == want
    return want


def test_substrings_equal_brute_force(spark, odd, clashing):
    assert any(n for _, _, n, _ in check_substrings(odd))
    check_substrings(clashing)
    check_substrings(table(spark, DATA, "documents"))


def test_substrings_with_shared_passages(spark):
    r = random.Random(7)
    passages = [prose(50 + i, n).split() for i, n in enumerate((49, 50, 51, 60, 99, 150, 400))]
    rows = []
    for d in range(80):
        w = []
        for k in range(r.randint(1, 4)):
            w += prose(1000 + 7 * d + k, r.randint(0, 60)).split() + r.choice(passages)
        if r.random() < 0.3:
            w[r.randrange(len(w))] = "edit"
        rows.append((d, " ".join(w), "en", "a", 1))
    # texts that differ in one word alone, of the pattern of Thue and Morse, whose polynomial hashes modulo 2**64 are equal
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    some = prose(1, 60).split()
    rows += [(200 + i, " ".join([*some[:30], t, *some[30:]]), "en", "a", 1) for i, t in enumerate((thue, thue.translate(str.maketrans("ab", "ba"))))]
    # and texts whose words follow that pattern
    rows += [(300 + i, " ".join("xy"[(k.bit_count() + i) % 2] for k in range(2048)), "en", "a", 1) for i in range(2)]
    rows.append((99, " ".join(["same"] * 200), "en", "a", 1))
    rows.append((98, " ".join(["same"] * 120), "en", "a", 1))
    want = check_substrings(spark.createDataFrame(rows, SCHEMA))
    assert sum(n > 0 for _, _, n, _ in want) > 30


def test_substrings_meet_others_once_a_document(spark):
    """Texts that repeat a word or a sentence: as many rows as other texts of their kind, however often they repeat it."""
    from pyspark.sql import functions as F

    made = []
    for times in (4, 24):
        said = prose(5, 31).split()
        texts = [["same"] * 60 * times, ["same"] * 50 * times + ["end"], said * 2 * times, [*prose(6, 20).split(), *said * times], ["a", "b"] * 40 * times, ["b", "a"] * 30 * times]
        docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
        assert sum(n > 0 for _, _, n, _ in check_substrings(docs)) == 3
        named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
        anchors = {r.doc_id: r.hash for r in substring_dedup.first_pass(named).collect()}
        assert all(len(h) == len(set(h)) for h in anchors.values())
        alive = named.withColumn("starts", F.sequence(F.lit(0), F.size(F.split("text", " ")) - 50))
        runs = [(r.doc_id, r.anchor, r.whole) for r in substring_dedup._runs(alive).collect()]
        assert len(runs) == len(set(runs))
        made.append((sum(map(len, anchors.values())), len(runs)))
    assert made[0] == made[1]


def test_substrings_sql(spark, same_as_sql):
    same_as_sql(substring_dedup.op3(table(spark, DATA, "documents")), substring_dedup.SQL)


def test_remove_repeats(odd, empty, clashing):
    assert substring_dedup.op3(empty).count() == 0 and substring_dedup.remove_repeats(empty).count() == 0
    out = substring_dedup.remove_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    by = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert by[3] is None and by[2] == "" and by[7].split()[-1] == "tail" and len(by[10].split()) == 60


# ---- decontamination ----
def slow_scores(items, passage):
    """BM25 of a passage's distinct terms against every item, as a share of the item's score with itself."""
    terms = lambda t: [x for x in "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t or "").split()]
    docs = [(i, terms(t)) for i, t in items]
    docs = [(i, t) for i, t in docs if t]
    n, mean = len(docs), np.mean([len(t) for _, t in docs])
    df = defaultdict(int)
    for _, t in docs:
        for x in set(t):
            df[x] += 1

    def impact(x, t):
        tf = t.count(x)
        return np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) if tf else 0.0

    asked = set(terms(passage))
    return {i: sum(impact(x, t) for x in asked) / sum(impact(x, t) for x in set(t)) for i, t in docs}


def test_search_equals_brute_force(spark):
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()] + [(900, None), (901, ""), (902, "too short"), (0, "another item of the same id and of its own words")]
    index = decontamination.Index([(*x, 1) for x in items])
    terms_of = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t or "").split()
    kept = [x for x in items if len(terms_of(x[1])) >= decontamination.SHINGLE]
    assert index.ids == [i for i, _ in kept] and len(kept) == len(items) - 3
    numbered = [(k, t) for k, (_, t) in enumerate(kept)]
    stride = max(decontamination.STRIDE, index.longest)
    texts = [r.text for r in table(spark, DATA, "documents").where("text is not null").orderBy("doc_id").limit(40).collect()] + [t for _, t in kept[:10]] + [f"{kept[0][1]} {prose(5, 80)} {kept[1][1]}"]
    seen = 0
    for text in texts:
        got = defaultdict(dict)
        for _, p, i, s, _, _ in index.search([text.encode()]):
            got[p][i] = s
        words = terms_of(text)
        for p in range(max(1, -(-len(words) // stride) - 1)):
            scores = slow_scores(numbered, " ".join(words[p * stride : (p + 2) * stride]))
            want = {k: v for k, v in scores.items() if v >= decontamination.THRESHOLD}
            assert got[p].keys() == want.keys() and all(got[p][k] == pytest.approx(want[k]) for k in want)
            seen += len(want)
    assert seen >= 12


def test_all_copies_are_found(spark):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontamination.op4(docs, items).collect()}
    want = {(r.doc_id, r.item_id) for r in docs.crossJoin(items.withColumnRenamed("text", "t")).where("contains(text, t)").collect()}
    assert want and want <= got
    clean = decontamination.decontaminate(docs, items)
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()} == {d for d, _ in got}


def test_question_and_answer():
    f = decontamination.question_and_answer
    assert f("What is the name of it? The name of it is known.") == ("What is the name of it?", " The name of it is known.")
    assert f("One two three four five. Six seven eight nine ten.") == ("One two three four five.", " Six seven eight nine ten.")
    assert f("Too short. To cut") == ("Too short. To cut",) * 2


def test_decontamination_on_odd_input(spark, odd, empty, clashing):
    text = prose(2, 120)
    items = spark.createDataFrame([(1, " ".join(text.split()[30:70])), (2, None), (3, ""), (1, "zz yy xx ww vv uu")], "item_id bigint, text string")
    assert decontamination.op4(empty, items).count() == 0 and decontamination.op4(odd, items.where("false")).count() == 0
    got = {(r.doc_id, r.item_id) for r in decontamination.op4(clashing, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (10, 1)}
    left = decontamination.decontaminate(clashing, items)
    assert left.columns == clashing.columns and left.count() == clashing.count() - 5


def test_short_items_match_nothing(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "a b - c d")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "he said yes to that, a b - c d and more")], "doc_id bigint, text string")
    assert decontamination.op4(docs, items).count() == 0 and decontamination.decontaminate(docs, items).count() == 1


@pytest.mark.parametrize("bound", ["SHARD_ITEMS", "SHARD_BYTES"])
def test_shards_agree(spark, monkeypatch, bound):
    """Scores and passages do not depend on how many shards there are; copies of an item count as items."""
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    items = items.unionByName(items.where("item_id % 3 = 0")).unionByName(items.where("item_id % 5 = 0").withColumn("item_id", items["item_id"] + 1000))
    rows = lambda: sorted(tuple(r) for r in decontamination.op4(docs, items).collect())
    want = rows()
    assert len(want) > 3
    monkeypatch.setattr(decontamination, bound, {"SHARD_ITEMS": 20, "SHARD_BYTES": 2000}[bound])
    got = rows()
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-6)
