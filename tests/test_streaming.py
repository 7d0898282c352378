"""Streams replayed from files equal their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import events as E

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def replay(spark, tmp_path, rows, schema, operator, name):
    """``rows`` in files, in order of time, through ``operator``; what came out."""
    src, out = tmp_path / "src", tmp_path / "out"
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(src))
    q = operator(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(str(out))


def test_pairing(spark, tmp_path):
    r = random.Random(4)
    schema = "run_id string, phase string, ts timestamp, tool string, args string"
    rows = []
    for i in range(20):
        start, end = r.randint(0, 500), r.randint(501, 900)
        if i % 5:
            rows.append((f"r{i}", "start", at(start), f"t{i}", "{}"))
        if i % 4:
            rows.append((f"r{i}", "end", at(end), "?", None))
    rows.sort(key=lambda x: x[2])
    want = sorted(map(tuple, E.paired_batch(spark.createDataFrame(rows, schema)).collect()))
    got = sorted(map(tuple, replay(spark, tmp_path, rows, schema, E.paired, "pair").select("run_id", "tool", "args", "started", "ended", "duration_ms").collect()))
    assert got == want and any(x[5] is None for x in want) and any(x[5] for x in want)


def test_approvals(spark, tmp_path):
    schema = "request_id string, type string, ts timestamp"
    rows = [("a", "request", at(0)), ("b", "request", at(1)), ("c", "request", at(2)), ("a", "approve", at(30)), ("b", "deny", at(40)), ("d", "approve", at(50)), ("e", "request", at(60)), ("e", "close", at(70)), ("c", "approve", at(200)), ("z", "request", at(400)), ("y", "deny", at(900)), ("x", "deny", at(1000)), ("w", "deny", at(1001)), ("v", "deny", at(1002)), ("u", "deny", at(1003))]
    want = {r.request_id: (r.outcome, r.settled) for r in E.approvals_batch(spark.createDataFrame(rows, schema), F.lit(at(700))).collect()}
    assert want == {"a": ("approved", at(30)), "b": ("denied", at(40)), "c": ("timeout", at(92)), "e": ("closed", at(70)), "z": ("timeout", at(490))}
    got = {r.request_id: (r.outcome, r.settled) for r in replay(spark, tmp_path, rows, schema, E.approvals, "ok").collect()}
    assert got == want


def test_settled_requests_are_forgotten(spark, tmp_path):
    """Once the watermark has passed their limits, only open requests are left in the state."""
    schema = "request_id string, type string, ts timestamp"
    rows = [x for i in range(10) for x in ((f"r{i}", "request", at(i)), (f"r{i}", "approve", at(i + 20)))]
    rows.sort(key=lambda x: x[2])
    rows += [("open", "request", at(2000)), ("n", "deny", at(2001)), ("late", "request", at(2040)), ("n", "deny", at(2050))]
    src = tmp_path / "src"
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(src))
    q = E.approvals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(240)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, q.recentProgress) if p["stateOperators"]]
    assert max(held) >= 8 and held[-1] == 2
    assert {r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"approved"}


def test_frames_in_pieces(spark, tmp_path):
    """Cut inside a frame, a line break or a character, out of order and repeated: the payloads are those of the whole text."""
    from tidewell.functions import text as T

    r = random.Random(7)
    texts = {
        "a": "".join(f'data: {{"n": {i}, "t": "{"é锁😀"[i % 3] * 3}"}}\r\n\r\n' for i in range(12)),
        "b": ": note\n\ndata: one\ndata: two\n\nid: 4\n\n\n\ndata:x\r\r\ndata: y\n\r\n\ndata: end\n\n",
        "c": "data: 1\n\n" * 9,
    }
    rows = []
    for k, s in texts.items():
        raw, cuts = s.encode(), [0]
        while cuts[-1] < len(raw):
            cuts.append(min(len(raw), cuts[-1] + r.choice([1, 1, 2, 3, 7, 40])))
        rows += [(k, i, raw[x:y], at(i)) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows.sort(key=lambda x: (x[1] // 6, r.random()))  # out of order by a few
    rows += [rows[3], rows[10]]
    got = {}
    out = replay(spark, tmp_path, rows, "stream_id string, seq bigint, piece binary, ts timestamp", E.decoded, "frames")
    for x in out.orderBy("stream_id", "number").collect():
        got.setdefault(x.stream_id, []).append(x.payload)
    want = {k: spark.range(1).select(T.sse_events(F.lit(s)).alias("p")).first().p for k, s in texts.items()}
    assert got == want and len(got["a"]) == 12


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    from tidewell.operators import stores

    schema = stores.MESSAGES
    rows = [(i, f"t{i % 2}", "user", f"m{i}", at(i)) for i in range(12)]
    src, log = tmp_path / "src", stores.messages(spark, str(tmp_path / "log"))
    for i in range(0, 12, 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    E.into_log(stream(), log, "chat", str(tmp_path / "cp")).awaitTermination(240)
    assert log.read().count() == 12 and log.batches() == {"chat-0", "chat-1", "chat-2"}
    # the checkpoint is lost: all batches come again
    E.into_log(stream(), log, "chat", str(tmp_path / "cp2")).awaitTermination(240)
    assert log.read().count() == 12
    assert stores.delete_thread(log, "t1") == 6 and not log.append(spark.createDataFrame(rows[:4], schema), "chat-0") and log.read().count() == 6
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame(rows[:4], schema), "a/b")


def test_two_writers_of_a_log(spark, tmp_path):
    """A batch that arrives while rows are removed is not lost, and what removes begins anew."""
    from tidewell.operators import stores

    one, two = (stores.messages(spark, str(tmp_path / "log")) for _ in range(2))
    make = lambda *ids: spark.createDataFrame([(i, "t", "user", "x", at(i)) for i in ids], stores.MESSAGES)
    one.append(make(1, 2, 3))
    calls = []

    def chosen(rows):
        if not calls:
            two.append(make(4), "meanwhile")
        calls.append(1)
        return rows.where("id > 1")

    assert one.keep(chosen) == 1 and len(calls) == 2 and sorted(r.id for r in two.read().collect()) == [2, 3, 4]
    # an append whose version moves on before it is in
    plain, moved = two._version, []

    def version():
        if len(moved) == 1:
            one.keep(lambda rows: rows.where("id > 2"))
        moved.append(1)
        return plain()

    two._version = version
    assert two.append(make(9), "b9")
    assert sorted(r.id for r in one.read().collect()) == [3, 4, 9]


def test_incremental_chunks(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("a.md", "## S\nx\n## T\ny"), ("b.md", "z")], "path string, text string").write.parquet(str(src))
    seen = []
    q = E.incremental_chunks(spark.readStream.schema("path string, text string").parquet(str(src)), lambda df, n: seen.extend(df.select("path", "section").collect()), str(tmp_path / "cp"))
    q.awaitTermination(240)
    assert sorted(map(tuple, seen)) == [("a.md", "S"), ("a.md", "T"), ("b.md", "正文")]


def test_frames(spark):
    assert E.frames(spark.createDataFrame([("done", 1)], "type string, id bigint")).first().frame == 'data: {"type":"done","id":1}\n\n'


@pytest.mark.parametrize("event,text,want", [("tool_start", False, "status"), ("text", True, "delta"), ("text", False, None), ("x", True, None)])
def test_kinds(spark, event, text, want):
    assert spark.range(1).select(E.kind_of(F.lit(event), F.lit(text)).alias("x")).first().x == want
