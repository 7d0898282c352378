"""The best hits of many queries, kept while rows go by in a task.

Rows meet a whole query set in products of matrices, and a task gives on only what can be among the best of all: at most ``pool`` rows
for each query, whatever it has read.  Neither (query, row) pairs nor rows are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers in one product of rows and queries, and hits beyond twice the wanted ones that are held before they are cut.
CELLS, HELD = 2_000_000, 1_000_000


def rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as ``round`` of columns."""
    return np.copysign(np.floor(np.abs(score) * 10**digits + 0.5) / 10**digits, score)


class Best:
    """The best ``pool`` rows of each query: greatest score first (NaN above all, as columns have it), then least key."""

    def __init__(self, queries: int, pool: int, digits: int):
        self.pool, self.digits = pool, digits
        self.least = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        order = np.where(np.isnan(score), np.inf, rounded(score, self.digits))
        ok = order >= self.least[query]
        self.parts.append((query[ok], key[ok], score[ok], order[ok]))
        self.held += int(ok.sum())
        if self.held > HELD + 2 * self.pool * len(self.least):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, key and score of what is kept."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, key, score, order = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        by = np.lexsort((key, -order, query))
        query = query[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.pool
        last = np.flatnonzero(place == self.pool - 1)
        self.least[query[last]] = order[by][last]
        by, query = by[keep], query[keep]
        self.parts, self.held = [(query, key[by], score[by], order[by])], len(by)
        return self.parts[0][:3]

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        """query_id, pk, score of what is kept."""
        query, key, score = self.cut()
        return pa.RecordBatch.from_arrays([ids.take(pa.array(query, pa.int64())), pa.array(key, pa.int64()), pa.array(score, pa.float64())], ["query_id", "pk", "score"])


class Questions:
    """A query set as the distinct terms it has and who asks for each; small enough to be sent to every task."""

    def __init__(self, asked: pa.Table):
        """``asked``: query_id, term, each pair once."""
        query, term = (asked.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        self.ids, self.terms = query.dictionary, term.dictionary.cast(pa.string())
        of, at = query.indices.to_numpy().astype(np.int64), term.indices.to_numpy().astype(np.int64)
        by = np.argsort(of, kind="stable")
        of, at = of[by], at[by]
        first = np.searchsorted(of, np.arange(len(self.ids) + 1))
        # blocks of queries whose terms and queries make at most CELLS numbers
        self.blocks: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(self.ids):
            b = a + 1
            while b < len(self.ids) and (b + 1 - a) * (first[b + 1] - first[a]) <= 2 * CELLS:
                b += 1
            own = np.unique(at[first[a] : first[b]])
            pair = np.stack([np.searchsorted(own, at[first[a] : first[b]]), of[first[a] : first[b]] - a])
            self.blocks.append((a, b, own, pair))
            a = b

    def sums(self, rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """For steps of rows and blocks of queries: the first row, the first query, and the sums of the values (of a row and a term) by row and query."""
        by = np.argsort(row, kind="stable")
        row, term, value = row[by], term[by], value[by]
        for a, b, own, pair in self.blocks:
            weights = np.zeros((len(own), b - a))
            weights[pair[0], pair[1]] = 1.0
            place = np.full(len(self.terms), -1)
            place[own] = np.arange(len(own))
            step = max(1, CELLS // max(len(own), b - a))
            for s in range(0, rows, step):
                x, y = np.searchsorted(row, (s, s + step))
                at = place[term[x:y]]
                ok = at >= 0
                dense = np.zeros((min(step, rows - s), len(own)))
                dense[row[x:y][ok] - s, at[ok]] = value[x:y][ok]
                yield s, a, dense @ weights

    def best(self, found: Best, key: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Let rows (their ``key``) be hits of the queries whose terms they have."""
        for s, a, score in self.sums(len(key), row, term, value):
            r, q = np.nonzero((score > 0) & (score >= found.least[a : a + score.shape[1]] - 10.0**-found.digits))
            found.add(q + a, key[s + r], score[r, q])


class Vectors:
    """The vectors of a query set, by their dimension."""

    def __init__(self, asked: pa.Table):
        """``asked``: query_id, vector."""
        self.ids = asked.column("query_id").combine_chunks()
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim, at, m in matrices(asked.column("vector").combine_chunks()):
            size = lengths(m)
            ok = ~(size <= 0)
            self.by[dim] = at[ok], m[ok], size[ok]

    def best(self, found: Best, key: np.ndarray, vectors: pa.Array, among: np.ndarray | None = None) -> None:
        """Let rows be hits of the queries (of those ``among`` alone) by their cosine; rows without a length, or of another dimension, are none."""
        for dim, at, m in matrices(vectors):
            if dim not in self.by:
                continue
            query, asked, size = self.by[dim]
            if among is not None:
                own = among[query]
                query, asked, size = query[own], asked[own], size[own]
            length = lengths(m)
            ok = ~(length <= 0)
            at, m, length = at[ok], m[ok], length[ok]
            if not len(query) or not len(at):
                continue
            with np.errstate(invalid="ignore", over="ignore"):
                unit = (asked / size[:, None]).T
                step = max(1, CELLS // len(query))
                for s in range(0, len(at), step):
                    near = (m[s : s + step] / length[s : s + step, None]) @ unit
                    # the product tells what cannot be a hit; what is left is added up as columns do
                    r, q = np.nonzero(~(near < found.least[query] - 2 * 10.0**-found.digits))
                    for x in range(0, len(r), CELLS // 4):
                        i, j = r[x : x + CELLS // 4] + s, q[x : x + CELLS // 4]
                        dot = np.zeros(len(i))
                        for d in range(dim):
                            dot += m[i, d] * asked[j, d]
                        found.add(query[j], key[at[i]], dot / (length[i] * size[j]))


def lengths(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for d in range(m.shape[1]):
        total += m[:, d] * m[:, d]
    return np.sqrt(total)


def matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, places and matrix of the vectors of each dimension; a vector that is null or holds a null is in none."""
    flat = vectors.flatten()
    size = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    holes = np.add.reduceat(np.append(flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64), 0), np.minimum(first[:-1], len(flat))) if flat.null_count else np.zeros(len(size), np.int64)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero((size == dim) & (holes == 0))
        if len(at):
            yield dim, at, values[first[at][:, None] + np.arange(dim)]
