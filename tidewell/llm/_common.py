"""Shared helpers: table reads, shared-folder tables, byte-level word arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this package: a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in one process (tests) one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidewell-"))
        at = _own[0]
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables ``stored`` has written: ``release(mark)`` later deletes those that came after."""
    return len(_written)


def release(since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``stored`` wrote after ``mark`` but the last ``keep``; call it once their results are written."""
    kept = _written[len(_written) - keep :] if keep else []
    del _written[len(_written) - keep if keep else len(_written) :]
    try:
        _delete(since)
    finally:
        _written.extend(kept)


def _delete(since: int) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its folder goes with it
            return


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table of rows of fixed width as one side of a join: sent to every executor up to ``rows`` rows, and merged beyond."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def words(text):
    """Column: array of words; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value, body):
    """Evaluate a column once and use it many times inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- numpy side -------------------------------------------------------------------------------
#: Odd multipliers of the rolling hashes and of the 64-bit finaliser (splitmix64).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have


class Spans:
    """Hashes of short spans of a sequence of well-mixed values: the polynomial sum over [a, b) moved to a common power, then mixed.

    With B odd, B**-a exists modulo 2**64, so equal content hashes equally wherever it stands.  Long sequences that alternate
    two values after the pattern of Thue and Morse collide here: spans of hundreds of values are to be told apart by other means."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = pow(base, -1, 1 << 64)
        self.down = powers(self.inverse, n)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n)[:n], dtype=np.uint64, out=self.sum[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sum[b] - self.sum[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(MIX_2))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _placed(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A mixed value of each byte and its place in its word."""
    return mix((place.astype(np.uint64) << np.uint64(8) | byte) * np.uint64(BYTE_BASE) + np.uint64(WORD_BASE))


def _named(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(total + size.astype(np.uint64) * np.uint64(MIX_2))


def word_hashes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, [begin, end) of a byte buffer: sums over a word's bytes of a mixed value of (byte, place in the word).

    Values of different places have nothing in common, so no pattern within a word makes sums equal but by chance.
    Bytes are worked on in pieces of ``SLAB``."""
    total = np.zeros(len(begin), np.uint64)
    k = 0
    while k < len(begin):
        upto = max(k + 1, int(np.searchsorted(end, begin[k] + SLAB, side="right")))
        for lo in range(int(begin[k]), int(end[upto - 1]), SLAB):  # more than one piece only for a word beyond it
            hi = min(lo + SLAB, int(end[upto - 1]))
            first = np.zeros(hi - lo, np.int64)
            own = begin[k:upto] - lo
            first[own[own > 0]] = own[own > 0]
            place = np.arange(hi - lo) - np.maximum.accumulate(first) + (lo - int(begin[k]) if upto == k + 1 else 0)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_placed(buf[lo:hi], place), dtype=np.uint64, out=sums[1:])
            total[k:upto] += sums[np.minimum(end[k:upto] - lo, hi - lo)] - sums[np.maximum(own, 0)]
        k = upto
    return _named(total, end - begin)


def prefix_hashes(buf: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the words that are the first ``n`` bytes from each ``begin``."""
    total = np.zeros(len(begin), np.uint64)
    for k in range(n):
        total += _placed(buf[begin + k], np.full(len(begin), k))
    return _named(total, np.full(len(begin), n))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a space after each, and where each begins."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, at


def text_bytes(column) -> list[bytes]:
    """Arrow string column to UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


#: Bytes of text that are worked on at once; the arrays made of them take some sixty times as much.
SLAB = 1_000_000


def slabs(column, most: int = SLAB):
    """Runs of rows of a batch whose texts come to about ``most`` bytes (a longer text is a run of its own): where each begins, and its texts.

    Only one run is held beside the batch."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(size.tolist()):
        if i > begin and held + n > most:
            yield begin, text_bytes(column.slice(begin, i - begin))
            begin, held = i, 0
        held += n
    if len(size):
        yield begin, text_bytes(column.slice(begin))


#: Lower-case ASCII letters, digits and every byte of a non-ASCII character stand for themselves; all else separates terms.
TERM_BYTE = np.zeros(256, np.uint8)
TERM_BYTE[128:] = np.arange(128, 256)
for _a, _b, _to in ((48, 57, 48), (97, 122, 97), (65, 90, 97)):
    TERM_BYTE[_a : _b + 1] = np.arange(_to, _to + _b - _a + 1)


class Terms:
    """Terms (runs of letters and digits, A-Z folded, with ``latin`` also À-Þ) of some texts laid end to end."""

    def __init__(self, texts: list[bytes], latin: bool = False):
        self.buf, self.at = joined(texts)
        folded = TERM_BYTE[self.buf]
        if latin:  # C3 80 .. C3 9E but for the times sign, C3 97
            low = self.buf[1:]
            folded[1:] += ((self.buf[:-1] == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)).astype(np.uint8) * np.uint8(0x20)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], folded != 0, [0])).astype(np.int8)))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.folded = folded
        self.hash = word_hashes(folded, self.begin, self.end)
        self.first = np.searchsorted(self.begin, self.at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (count[0] of them), begin[1], .."""
    total = int(count.sum())
    shift = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    return np.repeat(begin - shift, count) + np.arange(total)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))
