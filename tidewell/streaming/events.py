"""Event streams: pairing of tool starts and ends, approvals with a time limit, classification, frames from pieces, logs, incremental chunks.

``pair`` and ``approvals`` come in two forms with one result: a batch form (windows or joins, for replay and for checking) and a
streaming form with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import duration_ms
from ..functions.text import frame_payload

PAIR = "run_id string, tool string, args string, started timestamp, ended timestamp, duration_ms bigint"
APPROVAL = "request_id string, outcome string, requested timestamp, settled timestamp"
APPROVAL_SECONDS = 90


def kind_of(event: Column, has_text: Column) -> Column:
    """status for starts, delta for texts, null for what is dropped."""
    return F.when(event.endswith("_start"), "status").when((event == "text") & has_text, "delta")


# ---- pairing of starts and ends ----
def paired_batch(events: DataFrame) -> DataFrame:
    """``events``: run_id, phase (start, end), ts, tool, args.  A row for every end: with its start, or without a duration if it has none; starts alone give none."""
    w = Window.partitionBy("run_id").orderBy("ts", F.col("phase") == "end")
    start = F.last(F.when(F.col("phase") == "start", F.struct("ts", "tool", "args")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    prior_end = F.max(F.when(F.col("phase") == "end", F.col("ts"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = events.withColumn("_s", start).withColumn("_e", prior_end).where(F.col("phase") == "end")
    # a start is used up by the first end after it
    open_ = F.when(F.col("_e").isNull() | (F.col("_s.ts") > F.col("_e")), F.col("_s"))
    out = out.withColumn("_s", open_)
    return out.select(
        "run_id", F.coalesce("_s.tool", "tool").alias("tool"), F.col("_s.args").alias("args"), F.col("_s.ts").alias("started"), F.col("ts").alias("ended"), duration_ms(F.col("_s.ts"), F.col("ts")).alias("duration_ms")
    )


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    rows = []
    every = pd.concat(list(frames)).sort_values(["ts", "phase"], ascending=[True, False])
    for r in every.itertuples():
        if r.phase == "start":
            held = (int(r.ts.value // 1000), r.tool, r.args)
            continue
        began = pd.Timestamp(held[0], unit="us") if held else pd.NaT
        rows.append((key[0], held[1] if held else r.tool, held[2] if held else None, began, r.ts, int((r.ts - began) / pd.Timedelta(milliseconds=1)) if held else None))
        held = None
    if held:
        state.update(held)
        state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs()) + 3_600_000)
    elif state.exists:
        state.remove()
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])
    yield out.astype({"duration_ms": "Int64", "started": "datetime64[ns]", "ended": "datetime64[ns]"})


def paired(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream, in append mode: an open start is kept for an hour of event time beyond the watermark."""
    own = events.withWatermark("ts", late).groupBy("run_id")
    return own.applyInPandasWithState(_pair, PAIR, "ts bigint, tool string, args string", "append", GroupStateTimeout.EventTimeTimeout)


# ---- approvals ----
def approvals_batch(events: DataFrame, now: Column, seconds: int = APPROVAL_SECONDS) -> DataFrame:
    """``events``: request_id, type (request, approve, deny, close), ts.  A row per request: the first answer within ``seconds``, or timeout; requests still open at ``now`` give none."""
    asked = events.where(F.col("type") == "request").groupBy("request_id").agg(F.min("ts").alias("requested"))
    answers = events.where(F.col("type") != "request").select("request_id", "type", "ts")
    limit = F.col("requested") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    both = asked.join(answers, "request_id", "left").withColumn("_in", (F.col("ts") >= F.col("requested")) & (F.col("ts") <= limit))
    one = both.groupBy("request_id", "requested").agg(F.min(F.when(F.col("_in"), F.struct("ts", "type"))).alias("_a"))
    word = F.when(F.col("_a.type") == "approve", "approved").when(F.col("_a.type") == "deny", "denied").when(F.col("_a.type") == "close", "closed").otherwise("timeout")
    return one.where(F.col("_a").isNotNull() | (limit < now)).select("request_id", word.alias("outcome"), "requested", F.coalesce("_a.ts", limit).alias("settled"))


def _approve(seconds: int):
    words = {"approve": "approved", "deny": "denied", "close": "closed"}
    names = [c.split()[0] for c in APPROVAL.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if began < 0:  # settled long ago: no event that could meet it gets past the watermark now
                return
            at = pd.Timestamp(began, unit="us")
            yield pd.DataFrame([(key[0], "timeout", at, at + pd.Timedelta(seconds=seconds))], columns=names)
            return
        every = pd.concat(list(frames)).sort_values("ts")
        asked = every[every["type"] == "request"]
        if began is None and len(asked):
            began = int(asked["ts"].iloc[0].value // 1000)
        if began is None or began < 0:  # an answer to nothing, or settled already
            return
        at = pd.Timestamp(began, unit="us")
        until = at + pd.Timedelta(seconds=seconds)
        answers = every[(every["type"] != "request") & (every["ts"] >= at)]
        if len(answers):
            first = answers.iloc[0]
            state.update((-1,))
            state.setTimeoutTimestamp(max(int(until.value // 1_000_000), state.getCurrentWatermarkMs()) + 1)
            got = (key[0], words[first["type"]], at, first["ts"]) if first["ts"] <= until else (key[0], "timeout", at, until)
            yield pd.DataFrame([got], columns=names)
            return
        state.update((began,))
        state.setTimeoutTimestamp(max(int(until.value // 1_000_000), state.getCurrentWatermarkMs() + 1))

    return run


def approvals(events: DataFrame, seconds: int = APPROVAL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """The same over a stream: a request without an answer times out once the watermark has passed its limit.

    A settled request is remembered until the watermark has passed its limit, so that no second answer settles it again, and then forgotten:
    state is that of the requests of the last ``seconds`` of event time.  A request_id asked again after that is a new request."""
    own = events.withWatermark("ts", late).groupBy("request_id")
    return own.applyInPandasWithState(_approve(seconds), APPROVAL, "began bigint", "append", GroupStateTimeout.EventTimeTimeout)


# ---- frames in pieces ----
DECODED = "stream_id string, number bigint, payload string"
_BUFFER = "buffer binary, cr boolean, next bigint, number bigint, early_at array<bigint>, early array<binary>"


def _reframe(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whole frames of a stream of bytes: what is left of the last piece waits in the state, and so do pieces that come before their turn."""
    if state.hasTimedOut:
        state.remove()
        return
    buffer, cr, turn, number, at, early = state.get if state.exists else (b"", False, 0, 0, [], [])
    waiting = {int(k): bytes(v) for k, v in zip(at, early, strict=True)}
    last = 0
    for f in frames:
        for r in f.itertuples():
            last = max(last, int(r.ts.value // 1_000_000))
            if r.seq >= turn:  # else it has been read before
                waiting.setdefault(int(r.seq), bytes(r.piece))
    found, buffer = [], bytes(buffer)
    while turn in waiting:
        data = (b"\r" if cr else b"") + waiting.pop(turn)
        cr = data.endswith(b"\r")  # perhaps half of a line break
        *whole, buffer = (buffer + data[: len(data) - cr].replace(b"\r\n", b"\n")).split(b"\n\n")
        found += [(key[0], number + k, x.decode("utf-8", "replace")) for k, x in enumerate(whole)]
        number += len(whole)
        turn += 1
    order = sorted(waiting)
    state.update((buffer, cr, turn, number, order, [waiting[k] for k in order]))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame(found, columns=["stream_id", "number", "frame"])


def decoded(pieces: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``pieces``: stream_id, seq (from 0), piece (binary), ts; in append mode, stream_id, number, payload of every whole frame.

    Pieces may be cut anywhere, in a frame, a line break or a character, come in any order and more than once.  What an hour of event time
    beyond the watermark has not completed is forgotten.  Frames without data are numbered and give nothing."""
    own = pieces.withWatermark("ts", late).groupBy("stream_id")
    whole = own.applyInPandasWithState(_reframe, "stream_id string, number bigint, frame string", _BUFFER, "append", GroupStateTimeout.EventTimeTimeout)
    return whole.select("stream_id", "number", frame_payload(F.col("frame")).alias("payload")).where("payload is not null")


# ---- sinks ----
def frames(events: DataFrame) -> DataFrame:
    """Server-sent frames of events."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("frame"))


def into_log(events: DataFrame, log, writer: str, checkpoint: str, shape=lambda rows: rows):
    """A stream into a log of ``operators.stores``: each micro-batch is recorded under ``writer`` and its number with its rows, so one that is
    replayed adds nothing.  Returns the running query."""
    return events.writeStream.foreachBatch(lambda batch, n: log.append(shape(batch), f"{writer}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_chunks(files: DataFrame, update, checkpoint: str):
    """A stream of files (path, text) into an index: ``update`` takes each batch's chunks.  Returns the running query."""
    from ..operators.chunks import payloads

    return files.writeStream.foreachBatch(lambda batch, n: update(payloads(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
