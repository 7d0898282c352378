"""Filter interaction audit, line dedup, cross-tokenizer alignment."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import DATA

from tidewell.llm import filter_audit, line_dedup, token_align
from tidewell.llm._common import table

from .conftest import SCHEMA, prose

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (6, 1, 0), (8, 0, 1), (100, 1, 1)], LABELS)


@pytest.fixture(scope="module")
def odd_tables(odd, said, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd3")
    odd.write.parquet(str(at / "documents"))
    said.write.parquet(str(at / "labels"))
    return {t: f"{at}/{t}/*.parquet" for t in ("documents", "labels")}


# ---- filter audit ----
def test_audit_equals_sql(spark, same_as_sql, odd, said, odd_tables):
    same_as_sql(filter_audit.op11(table(spark, DATA, "documents"), table(spark, DATA, "labels")), filter_audit.SQL)
    same_as_sql(filter_audit.op11(odd, said), filter_audit.SQL, odd_tables)


def test_audit_equals_a_replay_by_hand(spark, odd_rows, odd, said):
    """Each document walks through each order by itself."""
    labels = {(r.doc_id, k) for r in said.collect() for k in ("quality", "toxic") if r.doc_id is not None and r[k] == 1}
    want = Counter()
    own = Counter()
    parts = set()
    for d, text, _, source, _ in odd_rows:
        t, part = text or "", source or ""
        parts.add(part)
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        again = d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in odd_rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": again}
        for order in permutations("ABCDE"):
            name, gone = "".join(order), False
            for k, f in enumerate(order, 1):
                key = (part, name, k)
                want[key, "redundant"] += gone and fails[f]
                want[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                if not gone and fails[f]:
                    gone = True
                    want[key, "removed"] += 1
                    want[key, "good_lost"] += (d, "quality") in labels
                    want[key, "toxic_lost"] += (d, "toxic") in labels
                    own[part, f] += 1
                want[key, "kept"] += not gone
    rows = filter_audit.op11(odd, said).collect()
    assert len(rows) == 600 * len(parts)
    for r in rows:
        assert all(r[c] == want[(r.part, r.filter_order, r.step), c] for c in filter_audit.COUNTS) and r.shapley == own[r.part, r.filter_order[r.step - 1]]


def test_audit_on_odd_input(spark, empty, clashing, said):
    assert filter_audit.op11(empty, said).count() == 0
    plain = {tuple(r) for r in filter_audit.op11(clashing.select("doc_id", "text", "source"), said).collect()}
    more = said.withColumns({c: said.doc_id for c in ("part", "digest", "flags", "least")})
    assert {tuple(r) for r in filter_audit.op11(clashing, more).collect()} == plain


# ---- line dedup ----
def test_lines_equal_sql(spark, same_as_sql, odd, odd_tables):
    same_as_sql(line_dedup.op12(table(spark, DATA, "documents")), line_dedup.SQL)
    same_as_sql(line_dedup.op12(odd), line_dedup.SQL, odd_tables)


def _lines_by_hand(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and d is not None:
                held.setdefault(key(line), set()).add(d)
    least = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or least.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined():
    r = random.Random(5)
    pool = [prose(k, 6).replace(" ", r.choice([" ", "\t", "  "])) for k in range(40)] + ["short", "123456789", "1234567890", "ÄÖÜäöüßéèê", "äöüßéèê", "x" * 39 + "é", "\x00 nul line here", "a\rb inner return", "e" + "　" * 12]
    dress = lambda s: r.choice(["", " ", "\t\v"]) + r.choice([s, s.upper(), s.title()]) + r.choice(["", "\r", " \f"])
    rows = [(k, "\n".join(dress(r.choice(pool)) if r.random() < 0.5 else prose(1000 * k + i, 5) for i in range(r.randint(0, 60)))) for k in range(120)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (None, None), (500, None), (501, ""), (502, "\n\n"), (-5, pool[0] + "\n" + pool[0]), (503, rows[4][1]), (504, "x" * 300_000 + "\n" + pool[1]), (505, "\n".join([pool[2]] * 5000))]
    return rows


@pytest.mark.parametrize("bounds", [(1 << 20, 1_000_000), (16, 700)])
def test_lines_equal_brute_force(spark, lined, bounds, monkeypatch):
    """Also with many small shards, and with texts that are split in many pieces."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", bounds[0])
    if bounds[1] < 1000:  # in this process: workers have their own module
        monkeypatch.setattr(line_dedup, "PIECE", bounds[1])
        for text in (t.encode() for _, t in lined if t):
            assert [x for p in line_dedup._pieces(text) for x in p] == text.split(b"\n")
    df = spark.createDataFrame(lined, "doc_id bigint, text string").repartition(5)
    want = _lines_by_hand(lined)
    got = sorted((tuple(r) for r in line_dedup.op12(df).collect()), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want), key=repr)
    texts = sorted(((r.doc_id, r.text) for r in line_dedup.drop_lines(df.withColumn("keep", df.doc_id)).collect()), key=repr)
    assert texts == sorted(((d, t if k else old) for (d, _, k, t), (_, old) in zip(want, lined, strict=True)), key=repr)


def test_lines_on_odd_input(empty, clashing):
    assert line_dedup.op12(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0
    assert line_dedup.drop_lines(clashing).columns == clashing.columns
    assert line_dedup.op12(clashing).count() == clashing.count()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_the_hash_is_minimal_and_perfect(n):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
    if n > 10:  # keys that agree in one half
        keys[: n // 3, 0] = keys[0, 0]
        keys[n // 3 : n // 2, 1] = keys[-1, 1]
        keys = np.unique(keys, axis=0)
    counts = r.integers(1, 300, len(keys)).clip(max=255).astype(np.uint8)
    made = line_dedup.Shard.built(keys, counts, np.arange(len(keys)))
    shard = line_dedup.Shard(made["keys"], made["sizes"], made["bits"], made["spare"], made["fingerprints"], made["counts"], made["least"])
    assert sorted(shard.slots(keys).tolist()) == list(range(len(keys)))
    count, least = shard.find(keys)
    assert (count == counts).all() and (least[counts > 1] == np.arange(len(keys))[counts > 1]).all()
    assert len(made["bits"]) * 8 <= 5 * max(len(keys), 64)
    strange = r.integers(0, 1 << 63, (5000, 2)).astype(np.uint64) + np.uint64(1 << 63)
    assert not shard.find(strange)[0].any()


def test_keys_left_after_all_levels_are_found(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, (300, 2)).astype(np.uint64), axis=0)
    made = line_dedup.Shard.built(keys, np.full(len(keys), 2, np.uint8), np.arange(len(keys)))
    shard = line_dedup.Shard(made["keys"], made["sizes"], made["bits"], made["spare"], made["fingerprints"], made["counts"], made["least"])
    assert len(shard.spare) and (shard.find(keys)[1] == np.arange(len(keys))).all()


# ---- token alignment ----
def _aligned_by_hand(rows):
    """Each whole text by itself, without cuts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = token_align.paths()
    a, b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    byte = token_align.byte_level()
    name = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, total = [], Counter()
    for d, text in rows:
        want = f" {text or ''}".encode()
        ids = (a.encode(f" {text or ''}", add_special_tokens=False).ids, b.encode(text or ""))
        names = [[f(i) for i in x] for f, x in zip((name, piece), ids, strict=True)]
        if not text or any(b"".join(x) != want for x in names):
            out.append((d, [], [], [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in n]).tolist(), i, strict=True)) for n, i in zip(names, ids, strict=True)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        rest = [sorted(e) for e in ends]
        for c in cuts:
            sides = []
            for k in (0, 1):
                own = []
                while at[k] < len(rest[k]) and rest[k][at[k]] <= c:
                    own.append(str(ends[k][rest[k][at[k]]]))
                    at[k] += 1
                sides.append(",".join(own))
            groups.append("|".join(sides))
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        total.update(links)
        out.append((d, *ids, links, ";".join(groups)))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    done = [(d, len(x), len(y), len(g.split(";")) if g else 0, len(m), sum(total[p] == top[p[1]] for p in m), sum(total[p] for p in m), digest(g)) for d, x, y, m, g in out]
    return sorted(done, key=repr), total, {d: g for d, _, _, _, g in out}


ODD_TEXTS = [
    "a  b\tc\n d ", None, "", " ", "<s> <|endoftext|> </s> x", "ÄÖ ß x 　y 你好 世界 😀 \x00 z", "▁x y", "x" * 5000, "don't can't 'll we've  's", "one two", "one two", "\n\nlead trail \n", "a   b  c \x1c d \x85 e \xa0 f", "1234567 890 12,3 4.5",
    " lead", "trail ", "é é ﬁ", "word " * 3000, "a b   c​ d", "I'M HE'LL  it's", "\t \t", "x \n y", "x\n y", "x\r\n\r\ny  z", "🏳️‍🌈 flags 👩‍👩‍👧 ퟿", "<0x41> <unk> ▁", "the the the", "  " * 40 + "end",
]


def test_alignment_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None if k % 5 == 0 else -k, t) for k, t in enumerate(ODD_TEXTS)]
    want, total, groups = _aligned_by_hand(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted((tuple(r) for r in token_align.op13(df).collect()), key=repr) == want
    assert {(r.a_id, r.b_id): r.n for r in token_align.links(df).collect()} == total
    assert {r.doc_id: r.groups for r in token_align.align(df.where("doc_id is not null"), groups=True).collect()} == {d: g for d, g in groups.items() if d is not None}


def test_long_texts_are_aligned_in_parts(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").limit(40).collect()]
    rows = [(1, " ".join(t for t in texts if t)), (2, texts[0]), (3, "y" * 3000), (4, "bad ▁ " * 900), (5, "  ".join(texts[:9]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    whole = sorted(map(tuple, token_align.align(df, groups=True).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups").collect()))
    small = sorted(map(tuple, token_align.align(df, groups=True, run=500).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups").collect()))
    assert small == whole and whole[3][1:6] == (0, 0, 0, 0, "")
    tiny = {r.doc_id: sum(r.times) for r in token_align.align(df, run=500).collect()}
    assert tiny == {d: n for d, _, _, _, n, _, _ in whole}


def test_the_table_of_parts_may_start_anew(sf, monkeypatch):
    one = token_align.aligner(*(open(p, "rb").read() for p in token_align.paths()))
    text = prose(3, 400)
    first = one.run([text])
    monkeypatch.setattr(token_align, "MEMO", 5)
    again = one.run([text])
    assert all((first[k] == again[k]).all() for k in first)


def test_pairs_are_those_that_can_end_together():
    one = token_align.aligner(*(open(p, "rb").read() for p in token_align.paths()))
    a, b = one.of_a.tokens, one.of_b.tokens
    assert 100_000 < len(one.pairs) < sum(map(len, a)) + sum(map(len, b)) + 256 * 8
    r = random.Random(1)
    for p in r.sample(one.pairs.tolist(), 2000):
        x, y = a[p >> 32], b[p & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)


def test_alignment_on_odd_input(odd, empty, clashing):
    assert token_align.op13(empty).count() == 0
    got = sorted((tuple(r) for r in token_align.op13(odd).collect()), key=repr)
    assert sorted((tuple(r) for r in token_align.op13(clashing).collect()), key=repr) == got and len(got) == odd.count()


def test_schema_of_small_tables(spark):
    assert token_align.op13(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
