"""Quality classifier by co-training.

Two views of a document: its text (shape measures of the whole text) and its metadata (language, source, length).
A classifier per view starts from the labelled sample; in each round both score all documents without a label, and each hands
those it is most confident of, up to ``PER_ROUND`` of each kind, with its labels for them, to the other's training set (documents on
which the views hand over contrary labels stay out).  At the end each view is calibrated on labelled rows that took no part in
training (Platt scaling), and the calibrated views are combined by a logistic layer fitted on the same rows.  Every document of the
input is scored.

Labels are fitted on at most ``LABELLED`` labelled rows, those with the least hash of doc_id.  The measures of every row are written
once, some hundred bytes each; rounds read these and leave a bounded number of rows a task.  Languages and sources enter
as the log odds of their training rows, drawn to none as if ``PRIOR`` rows had the mean.

Defined results: null or empty text has zero measures and is scored like any other; null lang, source and n_chars
are values of their own; rows that share a doc_id are rows of their own; several labels of a document count
as the least; without labels of both kinds every score is 1 and all is kept; an empty table gives an empty
result; other columns pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD_BASE, Spans, joined, sigmoid, slabs, stored, word_bounds, word_hashes

LABELLED = 12_000
ROUNDS, PER_ROUND = 5, 400
CONFIDENT = 0.95
CUT = 0.5
PRIOR = 20.0

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 prose mark, 5 symbol, 6 line end, 7 space, 8 non-ASCII
for _set, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:'\"()-?", 4), (b"#*$%&|<>~^_=+@\\/{}[]!", 5), (b"\n", 6), (b" \t\r\x0b\x0c", 7), (bytes(range(128, 256)), 8)):
    _CLASS[list(_set)] = _kind
KINDS = 9


def text_view(texts: list[bytes]) -> np.ndarray:
    """Shape measures of each text, one row each."""
    n = len(texts)
    buf, at = joined(texts)
    doc_of_byte = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(doc_of_byte * KINDS + _CLASS[buf], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    size = np.maximum(np.diff(at) - 1, 1).astype(float)
    begin, end = word_bounds(buf)
    first = np.searchsorted(begin, at)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    h = word_hashes(buf, begin, end)
    many = np.maximum(words, 1).astype(float)

    def distinct(h, doc):
        """Share of repeated values in each document, and of its most frequent one."""
        order = np.lexsort((h, doc))
        hs, ds = h[order], doc[order]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))) if len(hs) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate((begin, [len(hs)])))
        top = np.zeros(n)
        np.maximum.at(top, ds[begin], count)
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        return 1 - np.bincount(ds[begin], minlength=n) / total, top / total

    repeated, top = distinct(h, doc)
    three = np.flatnonzero(np.arange(len(begin)) + 3 <= first[1:][doc])
    repeated3, top3 = distinct(Spans(h, WORD_BASE)(three, three + 3), doc[three])
    last_kind = _CLASS[buf[end - 1]] if len(end) else np.zeros(0, int)
    upper = (_CLASS[buf[begin]] == 2) & (_CLASS[buf[np.minimum(begin + 1, end - 1)]] == 2) if len(begin) else np.zeros(0, bool)
    share = lambda x: np.bincount(doc, x, n) / many
    lengths = (end - begin).astype(float)
    mean = share(lengths)
    cols = [
        np.log1p(words), np.log1p(mean), np.sqrt(np.maximum(share(lengths**2) - mean**2, 0)), repeated, top, repeated3, top3, share(last_kind == 5), share(upper), share(lengths == 1),
        np.log1p(kinds[:, 6]), np.log1p(words / (kinds[:, 6] + 1)), *(kinds[:, k] / size for k in range(KINDS)), np.minimum(kinds[:, 5] / size, 0.02) * 50,
    ]
    return np.stack(cols, axis=1).astype(np.float32)


class Meta:
    """Columns of language, source and length: log odds of the values seen in training, over those of all; 0 for others."""

    def __init__(self, rows: list[tuple], y: np.ndarray):
        base = (y.sum() + 1) / (len(y) + 2)
        self.odds: list[dict] = []
        for k in range(2):
            seen: dict = {}
            for row, good in zip(rows, y.tolist(), strict=True):
                n = seen.setdefault(row[k], [0.0, 0.0])
                n[0] += good
                n[1] += 1
            self.odds.append({v: float(np.log((g + PRIOR * base) / (n - g + PRIOR * (1 - base))) - np.log(base / (1 - base))) for v, (g, n) in seen.items()})

    def __call__(self, rows: list[tuple]) -> np.ndarray:
        out = np.zeros((len(rows), 6))
        size = np.array([np.nan if r[2] is None else max(0, r[2]) for r in rows], float)
        out[:, 0], out[:, 1] = ([odds.get(r[k], 0.0) for r in rows] for k, odds in enumerate(self.odds))
        out[:, 2], size = np.isnan(size), np.log1p(np.nan_to_num(size))
        out[:, 3], out[:, 4], out[:, 5] = size, np.maximum(0, 6 - size), np.maximum(0, size - 9)
        return out


class Linear:
    """Logistic regression on standardised columns, by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        x = x.astype(float)
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        self.w = np.zeros(z.shape[1])
        damp = np.full(z.shape[1], ridge)
        damp[-1] = 1e-6
        for _ in range(25):
            p = sigmoid(z @ self.w)
            grad = z.T @ (weight * (p - y)) + damp * self.w
            step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(damp), grad)
            self.w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(float) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class Views:
    """A classifier of the text's measures and one of the metadata."""

    def __init__(self, a: np.ndarray, ya: np.ndarray, b: list[tuple], yb: np.ndarray):
        self.text, self.seen = Linear(a, ya), Meta(b, yb)
        self.meta = Linear(self.seen(b), yb)

    def logits(self, a: np.ndarray, b: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return self.text.logit(a), self.meta.logit(self.seen(b))


class Model:
    """Two views, each with its calibration, and the layer that combines them."""

    def __init__(self, views: Views, a: np.ndarray, b: list[tuple], y: np.ndarray):
        self.views = views
        raw = [x[:, None] for x in views.logits(a, b)]
        self.scale = [Linear(x, y) for x in raw]
        self.both = Linear(np.column_stack([s.logit(x) for s, x in zip(self.scale, raw, strict=True)]), y)

    def score(self, a: np.ndarray, b: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        la, lb = (s.logit(x[:, None]) for s, x in zip(self.scale, self.views.logits(a, b), strict=True))
        return sigmoid(la), sigmoid(lb), sigmoid(self.both.logit(np.column_stack((la, lb))))


#: A row handed over: view that is sure of it, label, how sure (log odds), row id, its measures, its metadata.
Handed = tuple[int, int, float, int, np.ndarray, tuple]


def surest(views: Views, rid: np.ndarray, a: np.ndarray, b: list[tuple]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(view, label, log odds, which rows) of the rows that each view is most confident of, by log odds, then row id."""
    out = []
    least = np.log(CONFIDENT / (1 - CONFIDENT))
    for view, z in enumerate(views.logits(a, b)):
        for label in (1, 0):
            sure = z if label else -z
            some = np.flatnonzero(sure >= least)
            some = some[np.lexsort((rid[some], -sure[some]))][:PER_ROUND]
            out.append((view, label, sure[some], some))
    return out


def cotrain(rid: np.ndarray, a: np.ndarray, b: list[tuple], y: np.ndarray, fold: np.ndarray, propose: Callable[[Views, np.ndarray], list[Handed]]) -> Model | None:
    """``fold``: true for labelled rows kept for calibration.  ``propose`` gives the surest unlabelled rows but those of given ids; None if there is nothing to learn."""
    train = np.flatnonzero(~fold)
    if not len(y) or any(len(set(y[m].tolist())) < 2 for m in (~fold, fold)):
        return None
    own = [[(a[i], b[i], int(y[i])) for i in train] for _ in range(2)]
    taken = np.zeros(0, np.int64)
    for k in range(ROUNDS + 1):
        views = Views(np.stack([r[0] for r in own[0]]), np.array([r[2] for r in own[0]], float), [r[1] for r in own[1]], np.array([r[2] for r in own[1]], float))
        if k == ROUNDS:
            break
        handed = sorted(propose(views, taken), key=lambda h: (h[0], h[1], -h[2], h[3]))
        labels: dict[int, set[int]] = {}
        for h in handed:
            labels.setdefault(h[3], set()).add(h[1])
        for view, label, _, r, x, m in handed:
            if len(labels[r]) == 1:
                own[1 - view].append((x, m, label))
        if not handed:
            break
        taken = np.unique(np.concatenate((taken, np.array(list(labels), np.int64))))
    held = np.flatnonzero(fold)
    return Model(views, a[held], [b[i] for i in held], y[held].astype(float))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars, rid (a hash of the row) and a, the text's measures: a row for each of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [text_view(part) for _, part in slabs(batch.column(1))]
            a = np.concatenate(a) if a else np.zeros((0, 1), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in (2, 3, 4, 5)), lists], ["doc_id", "lang", "source", "n_chars", "rid", "a"])

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text", "lang", "source", "n_chars"))
    return rows.mapInArrow(run, "doc_id bigint, lang string, source string, n_chars bigint, rid bigint, a array<float>")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _metadata(batch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True))


def _proposals(rows: DataFrame) -> Callable[[Views, np.ndarray], list[Handed]]:
    """From all unlabelled rows: each task hands on its surest, and the surest of these are taken."""
    cols = ["rid", "lang", "source", "n_chars", "a"]
    kinds = "view int, label int, sure double, rid bigint, lang string, source string, n_chars bigint, a array<float>"

    def propose(views: Views, taken: np.ndarray) -> list[Handed]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[pa.Table] = []
            for batch in batches:
                batch = batch.filter(pa.array(~np.isin(batch.column("rid").to_numpy(zero_copy_only=False), taken)))
                if batch.num_rows:
                    found = surest(views, batch.column("rid").to_numpy(zero_copy_only=False), _matrix(batch.column("a")), _metadata(batch))
                    best.append(pa.concat_tables([pa.Table.from_batches([batch.take(pa.array(at))]).add_column(0, "sure", pa.array(z)).add_column(0, "label", pa.array(np.full(len(at), label, np.int32))).add_column(0, "view", pa.array(np.full(len(at), view, np.int32))) for view, label, z, at in found]))
                if len(best) > 16:
                    best = [_top(pa.concat_tables(best))]
            if best:
                yield from _top(pa.concat_tables(best)).to_batches()

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[pa.Table] = []
            for batch in batches:
                best = [_top(pa.concat_tables([*best, pa.Table.from_batches([batch])]))]
            if best:
                yield from best[0].to_batches()

        some = rows.select(*cols).mapInArrow(run, kinds)
        # at most 4 * PER_ROUND rows of each task; of many tasks' rows the surest are taken in two steps
        got = _top(pa.concat_tables([stored(some).repartition(16, "rid").mapInArrow(again, kinds).toArrow()]))
        return list(zip(got["view"].to_pylist(), got["label"].to_pylist(), got["sure"].to_pylist(), got["rid"].to_pylist(), _matrix(got["a"].combine_chunks()), _metadata(got), strict=True))

    return propose


def _top(table: pa.Table) -> pa.Table:
    """The first ``PER_ROUND`` of each view and label, by log odds, then row id."""
    view, label, sure, rid = (table[c].to_numpy() for c in ("view", "label", "sure", "rid"))
    order = np.lexsort((rid, -sure, label, view))
    kind = (view * 2 + label)[order]
    place = np.arange(len(order)) - np.searchsorted(kind, kind)
    return table.take(pa.array(order[place < PER_ROUND]))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and the measures of all rows."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    every = stored(measured(docs))
    rows = stored(every.join(known, "doc_id", "left"))
    order = ["_order", "rid"]
    first = rows.where("quality is not null").withColumn("_order", F.xxhash64("doc_id")).orderBy(*order).limit(LABELLED)
    got = first.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 0).drop("_order").toArrow()
    rid = got["rid"].to_numpy()
    at = np.argsort(rid, kind="stable")
    got = got.take(pa.array(at)).combine_chunks()
    y, fold = got["quality"].to_numpy().astype(np.int64), got["fold"].to_numpy().astype(bool)
    return cotrain(rid[at], _matrix(got["a"].combine_chunks()), _metadata(got), y, fold, _proposals(rows.where("quality is null"))), every


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return learn(docs, labels)[0]


EXTRA = [("_text_score", pa.float64()), ("_meta_score", pa.float64()), ("_score", pa.float64()), ("_kept", pa.bool_())]


def _scores(model: Model | None, a: np.ndarray, b: list[tuple]) -> list[np.ndarray]:
    p, q, s = model.score(a, b) if model is not None and len(a) else (np.ones(len(a)),) * 3
    return [p, q, s, s >= CUT]


def from_measures(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` as ``measured`` gives them.  doc_id, _text_score, _meta_score, _score, _kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(model, _matrix(batch.column("a")), _metadata(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, kind) for x, (_, kind) in zip(found, EXTRA, strict=True))], ["doc_id", *(n for n, _ in EXTRA)])

    return rows.mapInArrow(run, "doc_id bigint, _text_score double, _meta_score double, _score double, _kept boolean")


def scored(docs: DataFrame, model: Model | None, only_kept: bool = False) -> DataFrame:
    """All columns, and _text_score, _meta_score, _score, _kept, instead of any of these names (with ``only_kept``: kept rows, columns unchanged); rows pass where they are read."""
    if not only_kept:
        docs = docs.drop(*(n for n, _ in EXTRA))
    names = docs.columns
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]
    schema = docs.schema if only_kept else T.StructType(docs.schema.fields + [T.StructField(n, T.BooleanType() if n == "_kept" else T.DoubleType()) for n, _ in EXTRA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.concatenate([text_view(part) for _, part in slabs(batch.column(at[0]))])
            found = _scores(model, a, list(zip(*(batch.column(i).to_pylist() for i in at[1:]), strict=True)))
            if only_kept:
                yield batch.filter(pa.array(found[3]))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kind) for x, (_, kind) in zip(found, EXTRA, strict=True))], [*names, *(n for n, _ in EXTRA)])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels), only_kept=True)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, rows = learn(docs, labels)
    out = from_measures(rows, model)
    return out.select("doc_id", F.col("_text_score").alias("text_score"), F.col("_meta_score").alias("meta_score"), F.col("_score").alias("score"), F.col("_kept").alias("kept"))
