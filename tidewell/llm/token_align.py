"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Texts are encoded by A (byte-level BPE, of a space and the text) and B (pieces, which add the space).  Runs of whole documents are laid
end to end; the ends of the tokens of A and B, as byte offsets in the run, are counted once each by ``bincount``; groups are cut where
both occur, and prefix sums over the run, read at the documents' bounds, give each document's groups and links.

* Tokens: a text is cut at every single space between characters that are no white space.  Neither tokenizer has a token across such a
  place (A's pattern starts a word at the space; no piece of B has a space but in front, which is checked), so each part is encoded
  as it would be in the text.  Parts are kept in a table of bounded size in each Python worker, as most come again.
* Links: tokens that end together are one the end of the other, so the pairs that can ever be linked follow from the vocabularies
  alone (some hundred thousand, whatever the corpus).  A document holds its pairs and how often it links each.
* Counts: the documents' pairs are added up to at most one row a pair in each task, and then by pair.  The sums, bounded by the
  vocabularies, are sent to the executors, where each document reads the counts of its pairs.

Defined results: null and empty texts, and texts whose tokens do not give a space and the text, byte by byte (as with U+2581, or what is not
UTF-8), have no tokens: zeros, and '' for the groups; each row is a document of its own, also with a null or repeated doc_id, and counts;
a long text is worked on in parts of about a megabyte and has one result; an empty table gives an empty result; other columns
are left aside."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ranges, stored, text_bytes

#: Characters of text that are worked on at once.
RUN = 1_000_000
#: Parts of texts whose tokens a Python worker keeps, at about 300 bytes each; beyond it starts anew.
MEMO = 250_000
#: A place where a text can be cut for both tokenizers.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_MARK = "▁"


def paths() -> tuple[str, str]:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: visible ones of Latin-1 for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Bytes and decimal digits of a tokenizer's ids."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.size) - self.size
        width = len(str(len(tokens)))
        self.digits = np.frombuffer("".join(str(i).ljust(width) for i in range(len(tokens))).encode(), np.uint8).reshape(-1, width)
        self.places = np.array([len(str(i)) for i in range(len(tokens))], np.int64)


    def spells(self, ids: np.ndarray, many: np.ndarray, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each run of ``many`` ids gives its ``size`` bytes of ``text``, both laid end to end."""
        of = np.repeat(np.arange(len(many)), many)
        right = np.bincount(of, self.size[ids], len(many)).astype(np.int64) == size
        if not right.all():
            keep = np.repeat(right, size)
            text, ids, of = text[keep], ids[right[of]], of[right[of]]
        got = self.flat[ranges(self.at[ids], self.size[ids])] if len(ids) else np.zeros(0, np.uint8)
        wrong = np.flatnonzero(got != text)
        right[np.repeat(of, self.size[ids])[wrong]] = False
        return right


class Aligner:
    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        byte = byte_level()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        decode = lambda t: bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode()
        self.of_a = Vocabulary([decode(names.get(i, "")) for i in range(max(names) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_b = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        self.apart = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.pairs = self._pairs()
        self.forget()

    def _pairs(self) -> np.ndarray:
        """a << 32 | b of all pairs of which one's bytes are the end of the other's, in order."""
        ids: dict[bytes, list[int]] = {}
        for b, t in enumerate(self.of_b.tokens):
            ids.setdefault(t, []).append(b)
        of_a: dict[bytes, list[int]] = {}
        for a, t in enumerate(self.of_a.tokens):
            of_a.setdefault(t, []).append(a)
        found = {a << 32 | b for t, own in of_a.items() for k in range(len(t)) for b in ids.get(t[k:], ()) for a in own}
        found |= {a << 32 | b for t, own in ids.items() for k in range(len(t)) for a in of_a.get(t[k:], ()) for b in own}
        return np.array(sorted(found), np.int64)

    # ---- tokens of parts ----
    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.pool = (array("i"), array("i"))
        self.start = (array("q", [0]), array("q", [0]))
        self.sound, self.edged = array("b"), array("b")

    def learn(self, parts: list[str]) -> None:
        """Tokens of parts that are not in the table."""
        spaced = [" " + p for p in parts]
        coded = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)], self.b.encode(parts, num_threads=1)
        raw = [p.encode() for p in spaced]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        text, sound = np.frombuffer(b"".join(raw), np.uint8), np.ones(len(parts), bool)
        for pool, start, vocabulary, lists in zip(self.pool, self.start, (self.of_a, self.of_b), coded, strict=True):
            many = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(many.sum()))
            sound &= vocabulary.spells(ids, many, text, size)
            start.frombytes((start[-1] + np.cumsum(many)).tobytes())
            pool.frombytes(ids.tobytes())
        self.ids.update(zip(parts, range(len(self.sound), len(self.sound) + len(parts)), strict=True))
        self.sound.frombytes(sound.astype(np.int8).tobytes())
        # strip() gives the text itself where no white space is at its ends
        self.edged.extend([not p or p.strip() is not p for p in parts])

    def looked_up(self, parts: list[str]) -> np.ndarray:
        get = self.ids.get
        at = list(map(get, parts))
        if None in at:
            self.learn(list(dict.fromkeys(p for p, k in zip(parts, at, strict=True) if k is None)))
            at = list(map(get, parts))
        return np.array(at, np.int64)

    def parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table of the texts' parts, and how many of these each text has."""
        if len(self.ids) > MEMO or len(self.pool[0]) > 8 * MEMO:
            self.forget()
        if not self.apart:
            return self.looked_up(texts), np.ones(len(texts), np.int64)
        split = [t.split(" ") for t in texts]
        n = np.array([len(x) for x in split], np.int64)
        at = self.looked_up([p for x in split for p in x])
        # where a space stands beside white space the plain split is too fine
        odd = np.add.reduceat(np.frombuffer(self.edged, np.int8)[at], np.cumsum(n) - n, dtype=np.int64) > 0
        if odd.any():
            own = np.split(at, np.cumsum(n)[:-1])
            for k in np.flatnonzero(odd):
                own[k] = self.looked_up(CUT.split(texts[k]))
                n[k] = len(own[k])
            at = np.concatenate(own)
        return at, n

    # ---- a run ----
    def run(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Of texts laid end to end: tokens, groups, links and group digits of each.  A text that is not sound has none."""
        at, n = self.parts(texts)
        of = np.repeat(np.arange(len(texts)), n)
        sound = np.bincount(of, np.frombuffer(self.sound, np.int8)[at], len(texts)) == n
        at, of = at[sound[of]], of[sound[of]]
        token, text, end = [], [], []
        for pool, start, vocabulary in zip(self.pool, self.start, (self.of_a, self.of_b), strict=True):
            first = np.frombuffer(start, np.int64)
            many = first[at + 1] - first[at]
            token.append(np.frombuffer(pool, np.int32)[ranges(first[at], many)].astype(np.int64) if len(at) else np.zeros(0, np.int64))
            text.append(np.repeat(of, many))
            end.append(np.cumsum(vocabulary.size[token[-1]]))
        (a, b), (end_a, end_b) = token, end
        total = int(end_a[-1]) if len(end_a) else 0
        bounds = [np.searchsorted(x, np.arange(len(texts) + 1)) for x in text]
        offset = np.concatenate(([0], end_a))[bounds[0]]  # in bytes, of each text
        both = np.bincount(end_a, minlength=total + 1) * np.bincount(end_b, minlength=total + 1)
        before = np.concatenate(([0], np.cumsum(both[1:] > 0)))  # cuts up to each byte
        links = np.concatenate(([0], np.cumsum(both[1:])))
        out = {"sound": sound, "n_a": np.diff(bounds[0]), "n_b": np.diff(bounds[1]), "n_groups": np.diff(before[offset]), "n_links": np.diff(links[offset])}
        # links: every token has a byte, so one token of each ends at a cut
        last_a, last_b = both[end_a] > 0, both[end_b] > 0
        pair = a[last_a] << 32 | b[last_b]
        kinds, pair = np.unique(pair, return_inverse=True)
        known = np.searchsorted(self.pairs, kinds)
        key, times = np.unique(text[0][last_a] << 32 | known[pair], return_counts=True)
        out |= {"pair": (key & 0xFFFFFFFF).astype(np.int32), "times": times.astype(np.int32), "first": np.searchsorted(key, np.arange(len(texts) + 1) << 32)}
        # decimal ids: A's of a group, B's of the group, and so on
        group_a, group_b = before[end_a - 1], before[end_b - 1]
        groups = int(before[-1])
        many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        width = max(self.of_a.digits.shape[1], self.of_b.digits.shape[1])
        rows, places = np.zeros((len(a) + len(b), width + 1), np.uint8), np.zeros(len(a) + len(b), np.int64)
        for ids, place, last, vocabulary, ends in ((a, place_a, last_a, self.of_a, b"|"), (b, place_b, last_b, self.of_b, b";")):
            rows[place, : vocabulary.digits.shape[1]] = vocabulary.digits[ids]
            places[place] = vocabulary.places[ids]
            rows[place, vocabulary.places[ids]] = np.where(last, ends[0], b","[0])
        digits = rows[np.arange(width + 1) <= places[:, None]]
        at_token = np.concatenate(([0], np.cumsum(places + 1)))
        return out | {"digits": digits, "cut": at_token[bounds[0] + bounds[1]]}


_aligners: dict[bytes, Aligner] = {}


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    """One for each pair of files in a process."""
    key = hashlib.sha256(a_file).digest() + hashlib.sha256(b_file).digest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a_file, b_file)
    return _aligners[key]


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _pieces(text: str, most: int, apart: bool) -> Iterator[str]:
    """A long text in parts, cut where a text can be."""
    begin = 0
    while apart and len(text) - begin > most and (cut := CUT.search(text, begin + most)):
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


def _runs(texts: list[bytes], most: int, apart: bool) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of some ``most`` characters: which text each part belongs to, and the parts."""
    own, parts, held = [], [], 0
    for i, raw in enumerate(texts):
        for part in _pieces(text, most, apart) if (text := _text(raw)) else ():
            if parts and held + len(part) > most:
                yield own, parts
                own, parts, held = [], [], 0
            own.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield own, parts


class Result:
    """What is known of a document so far."""

    def __init__(self, groups: bool):
        self.sound, self.n, self.pairs, self.times = True, np.zeros(4, np.int64), [], []
        self.hash, self.groups, self.begun = hashlib.sha256(), [] if groups else None, False

    def add(self, r: dict, k: int) -> None:
        self.sound &= bool(r["sound"][k])
        self.n += [int(r[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")]
        a, b = r["first"][k : k + 2]
        self.pairs.append(r["pair"][a:b])
        self.times.append(r["times"][a:b])
        text = r["digits"][r["cut"][k] : r["cut"][k + 1]].tobytes()[:-1]
        for x in (b";" if self.begun else b"", text):
            self.hash.update(x)
            if self.groups is not None:
                self.groups.append(x)
        self.begun = True

    def row(self) -> tuple:
        if not self.sound or not self.begun:
            return (0, 0, 0, 0, "", [], [], "")
        return (*self.n.tolist(), self.hash.hexdigest(), np.concatenate(self.pairs), np.concatenate(self.times), b"".join(self.groups or ()).decode())


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair array<int>, times array<int>, groups string"
KINDS = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]


def align(docs: DataFrame, files: tuple[str, str] | None = None, groups: bool = False, run: int = RUN) -> DataFrame:
    """Per document: numbers of tokens, groups and links, the digest of the groups, its pairs (by their place in ``Aligner.pairs``) and how often
    each is linked; with ``groups`` also the groups themselves, as `a1,a2|b1;a3|b2,b3`.  ``files``: the vocabularies of A and B, read by the driver."""
    a_file, b_file = (open(p, "rb").read() for p in files or paths())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_file, b_file)
        for batch in batches:
            size = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(1)).to_pylist()])
            begin = 0
            while begin < batch.num_rows:  # rows are converted and returned some megabytes at a time
                end = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), 4 * run, side="right")))
                texts = text_bytes(batch.column(1).slice(begin, end - begin))
                done = [Result(groups) for _ in texts]
                for own, parts in _runs(texts, run, one.apart):
                    r = one.run(parts)
                    for k, i in enumerate(own):
                        done[i].add(r, k)
                columns = zip(*[d.row() for d in done], strict=True)
                ids = batch.column(0).slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), kind) for c, kind in zip(columns, KINDS, strict=True))], [c.split()[0] for c in ALIGNED.split(", ")])
                begin = end

    return docs.select("doc_id", "text").mapInArrow(work, ALIGNED)


def totals(aligned: DataFrame) -> DataFrame:
    """pair, n: how often the documents link each pair; a task adds up what it reads first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            pair, times = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            more = np.bincount(pair, times, len(n)).astype(np.int64)
            more[: len(n)] += n
            n = more
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["pair", "n"])

    return aligned.select("pair", "times").mapInArrow(add, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def links(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """a_id, b_id, n: how often each pair of ids is linked in all documents."""
    pairs = aligner(*(open(p, "rb").read() for p in files or paths())).pairs
    spark = docs.sparkSession
    named = spark.createDataFrame(pa.table({"pair": pa.array(np.arange(len(pairs)), pa.int32()), "a_id": pa.array(pairs >> 32, pa.int32()), "b_id": pa.array(pairs & 0xFFFFFFFF, pa.int32())}))
    return totals(align(docs, files)).join(named, "pair").select("a_id", "b_id", "n")


def scored(aligned: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``aligned`` (a stored table) with n_best and count_sum instead of its pairs."""
    pairs = aligner(*(open(p, "rb").read() for p in files or paths())).pairs
    sums = totals(aligned).toArrow()  # a row for each pair that the vocabularies allow, at most
    n, b = np.zeros(len(pairs), np.int64), pairs & 0xFFFFFFFF
    n[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    top = np.zeros(int(b.max()) + 1, np.int64)
    np.maximum.at(top, b, n)
    sent = aligned.sparkSession.sparkContext.broadcast((n, n == top[b]))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            pair, times = (batch.column(c).flatten().to_numpy() for c in (6, 7))
            at = np.concatenate(([0], np.cumsum(batch.column(6).value_lengths().to_numpy())))
            summed = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[at]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], summed(times * best[pair]), summed(times * count[pair])], [*plain, "n_best", "count_sum"])

    kinds = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return aligned.select(*plain, "pair", "times").mapInArrow(read, kinds)


def op13(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    out = scored(stored(align(docs, files).drop("groups")), files)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
