"""Alignment of two tokenizers over a corpus, by a sweep over the ends of their tokens.

Both tokenizers read space + text. The end of each token is an event (document, offset, side, id). Events of A and B are one
relation; they are dealt by document, sorted by offset inside partitions and streamed through a machine that holds one
document's open group: between two events one A token and one B token lie over each other, which is a link; where both end
at one offset, the group closes. What the machine keeps is the open group, running counts and a running hash, so its
memory does not grow with a document (but for the distinct links that it reports).

* Events travel packed: a row holds the ids of one side that end in one stretch of STRETCH bytes, with the offset of the
  first; the lengths of tokens, hence the offsets of all, follow from the ids.
* A text is cut at seams, spaces between two characters that are no white space. No token of A goes over a seam (its splitting pattern
  allows white space at a token's front alone, after white space only) and none of B (checked in its vocabulary). So equal
  pieces of a batch are encoded once. Equal texts are one document with a weight, found by a partial aggregation.
* Corpus-wide counts: a task reports the distinct id pairs of a whole batch of documents, with the number of documents that hold each,
  so a pair that every document has is one row a batch. Counts are summed by pair, joined back to the batches, and each
  batch's documents are settled from its own part. Only the highest count of each A id is broadcast: a row an entry of A's vocabulary.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte (such as U+2581 for B),
have no tokens: zeros and an empty hash. Rows that repeat a text, with whatever doc_id, are documents of their own with equal
results, and each counts in the counts. Ties for the highest count all count. A very long text is encoded in pieces and swept in
stretches; its events are one task's, as its order is. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, parts_for, prefix_sums, slice_hashes, sliced, stash, utf8

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Limits:
    """Bytes of text whose events are one row; bytes of text that are encoded at once; distinct (document, pair) of a batch, at least;
    pieces that a generation of a worker's memory holds, and bytes of the longest of them."""

    stretch: int = 1 << 16
    piece: int = 2 << 20
    pairs: int = 1 << 20
    known: int = 1 << 18
    word: int = 48


#: Pieces that a tokenizer gets in one call; what it returns is much larger than the ids that stay.
_CALL = 2048


#: Bits of a pair that hold the B id.
_B_BITS = 32

#: Kinds of rows in the relation of events; a refusal sorts before all events of its document.
_REFUSED, _A, _B = -1, 0, 1


def _byte_level() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE read from a tokenizers file; special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        code = _byte_level()
        vocabulary = held["model"]["vocab"] | {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            self.bytes[k] = bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError(f"{path} has pieces that go over a space; texts cannot be encoded piece by piece")
        self.bytes = [bytes([int(name[3:-1], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def loaded(kind: type, path: str) -> tuple[ByteLevel | Pieces, np.ndarray]:
    """A tokenizer and the bytes of each of its tokens, once a worker."""
    t = kind(path)
    return t, np.array([len(b) for b in t.bytes], np.int64)


def packed_as(*sizes: np.ndarray) -> str:
    """How ids travel: two bytes each if both vocabularies fit."""
    return "<u2" if max(map(len, sizes)) <= 1 << 16 else "<u4"


def seams(data: np.ndarray) -> np.ndarray:
    """Places of the spaces at which a text can be cut: behind a visible ASCII character or one of a block without white space, before no blank."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at >= 1) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    safe = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (at >= 2) & (two >= 0xC3) & (two < 0xE0)) | ((before >= 0x80) & (at >= 3) & (two < 0xC0) & (two >= 0x80) & (three >= 0xE4) & (three < 0xF0))
    return at[safe & (after > 0x20) & (after != 0x7F)]


class Known:
    """What a worker remembers of pieces: (ids of A, ids of B), packed, both empty if either side does not give the piece back.

    A full generation takes the place of the older one, and what is found there comes over: pieces that recur stay.
    """

    def __init__(self) -> None:
        self.new: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}

    def put(self, found: dict[bytes, tuple[bytes, bytes]], limits: Limits) -> None:
        for piece, ids in found.items():
            if len(piece) <= limits.word:
                if len(self.new) >= limits.known:
                    self.old, self.new = self.new, {}
                self.new[piece] = ids


@lru_cache(maxsize=2)
def known(a: str, b: str) -> Known:
    """One memory a worker and pair of vocabularies."""
    return Known()


def _expanded(tokens: list[bytes], packed: str, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of all pieces in order, and how many each has, from those of the distinct pieces."""
    flat = np.frombuffer(b"".join(tokens), packed).astype(np.int64)
    count = np.fromiter(map(len, tokens), np.int64, len(tokens)) // np.dtype(packed).itemsize
    n = count[inverse]
    start = (np.cumsum(count) - count)[inverse]
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return flat[at], n


class Encoder:
    def __init__(self, a: str, b: str, limits: Limits) -> None:
        self.limits = limits
        self.sides = [loaded(ByteLevel, a), loaded(Pieces, b)]
        self.packed = packed_as(*(sizes for _, sizes in self.sides))
        self.known = known(a, b)

    def encoded(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """ids of both sides for distinct pieces. Only what the worker does not remember is encoded."""
        got = list(map(self.known.new.get, texts))
        found: dict[bytes, tuple[bytes, bytes]] = {}
        fresh: list[int] = []
        for k in (k for k, ids in enumerate(got) if ids is None):
            ids = got[k] = self.known.old.get(texts[k])
            if ids is None:
                fresh.append(k)
            else:
                found[texts[k]] = ids
        for at in range(0, len(fresh), _CALL):
            part = fresh[at : at + _CALL]
            held = [texts[k] for k in part]
            words = [t.decode() for t in held]
            for k, t, *ids in zip(part, held, *(self._checked(tokenizer, sizes, words, held) for tokenizer, sizes in self.sides), strict=True):
                got[k] = found[t] = tuple(ids) if all(ids) else (b"", b"")
        self.known.put(found, self.limits)
        return got

    def _checked(self, tokenizer: ByteLevel | Pieces, sizes: np.ndarray, words: list[str], held: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; none where they do not give it back. The pieces are compared in one go, and one by one only if that fails."""
        tokens, back = tokenizer.encode(words), tokenizer.bytes
        flat = list(chain.from_iterable(tokens))
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        ids = np.array(flat, np.int64)
        long = np.concatenate([[0], np.cumsum(sizes[ids])])[ends]
        packed, ends = ids.astype(self.packed).tobytes(), (ends * np.dtype(self.packed).itemsize).tolist()
        out = [packed[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        want = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)
        if np.array_equal(long, want) and b"".join(map(back.__getitem__, flat)) == b" " + b" ".join(held):
            return out
        return [x if b"".join([back[i] for i in t]) == b" " + h else b"" for x, t, h in zip(out, tokens, held, strict=True)]

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each side ids and their number in each text [starts[i], starts[i + 1]) of data; and whether both give it back."""
        cuts = seams(data)
        first = starts[:-1]
        # A seam next to a border would look at the neighbour's bytes, and none is needed there.
        row = np.searchsorted(starts, cuts, "right") - 1
        cuts = cuts[(cuts - starts[row] >= 3) & (cuts + 1 < starts[row + 1])]
        begin = np.concatenate([first, cuts + 1])
        order = np.argsort(begin, kind="stable")
        begin = begin[order]
        end = np.append(begin[1:] - 1, starts[-1])
        last = np.searchsorted(begin, starts[1:]) - 1
        end[last] = starts[1:]
        hashes = slice_hashes(prefix_sums(BYTE_CODES[data]), begin, end)
        _, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        tokens = self.encoded([raw[s:e] for s, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
        of = np.searchsorted(starts, begin, "right") - 1
        good, out = np.ones(len(first), bool), []
        for side in zip(*tokens, strict=True):
            ids, n = _expanded(side, self.packed, inverse)
            good[of[n == 0]] = False
            out.append((ids, np.bincount(of, n, len(first)).astype(np.int64)))
        return out, good

    def events(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = utf8(batch.column("text"))
        keys = [batch.column(c).to_numpy() for c in ("h1", "h2", "n")]
        if batch.num_rows == 1 and len(data) > self.limits.piece:
            at, done = 0, 0
            while at < len(data):
                # A piece ends at the last seam within the next bytes of a piece, or at the first one behind them.
                size = self.limits.piece
                while True:
                    cuts = seams(data[at : at + size])
                    cuts = cuts[cuts >= 3]
                    if len(cuts) or at + size >= len(data):
                        break
                    size *= 2
                stop = at + (int(cuts[-1]) if len(cuts) and at + size < len(data) else len(data) - at)
                piece = data[at:stop]
                sides, good = self.pieces(piece, np.array([0, len(piece)]))
                yield from self._rows(keys, sides, good, np.array([done]))
                done += len(piece) + 1
                at = stop + 1 if stop < len(data) else stop
            return
        some = np.flatnonzero(np.diff(offsets) > 0)
        if len(some):
            sides, good = self.pieces(data, np.append(offsets[some], offsets[some[-1] + 1]))
            yield from self._rows([k[some] for k in keys], sides, good, np.zeros(len(some), np.int64))

    def _rows(self, keys: list[np.ndarray], sides: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of events of texts that begin at offsets base of their documents; a refusal for each that is not good."""
        bad = np.flatnonzero(~good)
        if len(bad):
            none = np.full(len(bad), _REFUSED)
            yield _event_rows([k[bad] for k in keys], none, none, none, np.zeros(len(bad) + 1, np.int64), np.zeros(0, self.packed))
        for side, ((ids, n), (_, sizes)) in enumerate(zip(sides, self.sides, strict=True)):
            keep = np.repeat(good, n)
            ids, n = ids[keep], np.where(good, n, 0)
            of = np.repeat(np.arange(len(n)), n)
            length = sizes[ids]
            total = np.concatenate([[0], np.cumsum(length)])
            start = total[:-1] - total[np.cumsum(n) - n][of] + base[of]
            stretch = (start + length - 1) // self.limits.stretch
            new = np.ones(len(ids), bool)
            new[1:] = (of[1:] != of[:-1]) | (stretch[1:] != stretch[:-1])
            first = np.flatnonzero(new)
            if len(first):
                yield _event_rows([k[of[first]] for k in keys], stretch[first], np.full(len(first), side), start[first], np.append(first, len(ids)), ids.astype(self.packed))


def _event_rows(keys: list[np.ndarray], stretch: np.ndarray, side: np.ndarray, start: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    packed = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in (*keys, stretch)), pa.array(side, pa.int32()), pa.array(start, pa.int64()), packed], [*_KEY, "stretch", "side", "start", "ids"])


_KEY = ["h1", "h2", "n"]
_EVENT = "h1 long, h2 long, n long, stretch long, side int, start long, ids binary"
_SWEPT = "batch long, h1 long, h2 long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, docs array<long>"


def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the ids under size, as rows of bytes with room for one more, and their number."""
    text = [str(k).encode() for k in range(size)]
    wide = max(map(len, text)) + 1
    return np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in text), np.uint8).reshape(size, wide), np.array([len(t) for t in text])


class Machine:
    """The sweep over one document's events: the open group of both sides, and what closed groups have added up to."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], written: tuple[np.ndarray, np.ndarray]) -> None:
        self.sizes, (self.digits, self.wide) = sizes, written
        self.open = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.n = [0, 0]
        self.groups = self.links = 0
        self.hash = hashlib.sha256()
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, rows: dict[int, tuple[int, np.ndarray]]) -> None:
        """Takes the events of one stretch, by side (start, ids), and closes all groups that end in it."""
        for side, (start, ids) in rows.items():
            ends, held = self.open[side]
            self.open[side] = np.concatenate([ends, start + np.cumsum(self.sizes[side][ids])]), np.concatenate([held, ids])
            self.n[side] += len(ids)
        (ends_a, ids_a), (ends_b, ids_b) = self.open
        both = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        if not len(both):
            return
        stop = [int(np.searchsorted(e, both[-1], "right")) for e in (ends_a, ends_b)]
        self.open = [(ends_a[stop[0] :], ids_a[stop[0] :]), (ends_b[stop[1] :], ids_b[stop[1] :])]
        ends_a, ids_a, ends_b, ids_b = ends_a[: stop[0]], ids_a[: stop[0]], ends_b[: stop[1]], ids_b[: stop[1]]
        events = np.union1d(ends_a, ends_b)
        pair = (ids_a[np.searchsorted(ends_a, events)] << _B_BITS) | ids_b[np.searchsorted(ends_b, events)]
        self._write(np.searchsorted(both, ends_a), ids_a, np.searchsorted(both, ends_b), ids_b, len(both))
        self.groups += len(both)
        self.links += len(events)
        pairs, times = np.unique(pair, return_counts=True)
        if len(self.pairs):
            pairs, inverse = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([self.times, times]), len(pairs)).astype(np.int64)
        self.pairs, self.times = pairs, times

    def _write(self, group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, groups: int) -> None:
        """Closed groups as a1,a2|b1;a3|b2 into the hash. Each id is written with the sign behind it, the last one without."""
        count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        before_a, before_b = np.cumsum(count_a), np.cumsum(count_b)
        place_a = np.arange(len(ids_a)) + (before_b - count_b)[group_a]
        place_b = np.arange(len(ids_b)) + before_a[group_b]
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        sign[place_a[before_a - 1]], sign[place_b[before_b - 1]] = ord("|"), ord(";")
        text, size = self.digits[ids], self.wide[ids]
        text[np.arange(len(ids)), size] = sign
        out = text[np.arange(text.shape[1]) <= size[:, None]]
        if self.groups:
            self.hash.update(b";")
        self.hash.update(out[:-1].tobytes())


class _Batch:
    """Settled documents, until their distinct pairs are enough for a batch."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.held = 0

    def add(self, key: tuple, m: Machine) -> None:
        self.docs.append((*key, m.n[0], m.n[1], m.groups, m.links, m.hash.hexdigest(), m.pairs, m.times))
        self.held += len(m.pairs)

    def rows(self, batch: int) -> pa.RecordBatch:
        h1, h2, n, n_a, n_b, groups, links, hashed, pairs, times = zip(*self.docs, strict=True)
        count = np.array([len(p) for p in pairs])
        all_pairs, at = np.unique(np.concatenate(pairs), return_inverse=True)
        docs = np.bincount(at, np.repeat(np.array(n), count), len(all_pairs)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(count)])
        ragged = lambda x: pa.array([x[a:b].astype("<i4" if x is at else "<i8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        first = lambda x: pa.array([x] + [None] * (len(n) - 1), pa.list_(pa.int64()))
        longs = [pa.array(x, pa.int64()) for x in ([batch] * len(n), h1, h2, n_a, n_b, groups, links)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(hashed), ragged(at), ragged(np.concatenate(times)), first(all_pairs), first(docs)], [f.split()[0] for f in _SWEPT.split(", ")])


def _sweep(a: str, b: str, limits: Limits):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [loaded(ByteLevel, a), loaded(Pieces, b)]
        sizes = tuple(s for _, s in sides)
        written, packed = _written(max(map(len, sizes))), packed_as(*sizes)
        task, made = TaskContext.get().partitionId(), 0
        batch, key, machine, stretch, rows = _Batch(), None, None, None, {}

        def close() -> None:
            if machine is not None:
                machine.feed(rows)
                batch.add(key, machine)

        for part in batches:
            cols = [part.column(c).to_pylist() for c in (*_KEY, "stretch", "side", "start")]
            for h1, h2, n, at, side, start, ids in zip(*cols, part.column("ids"), strict=True):
                if (h1, h2, n) != key:
                    close()
                    if batch.held >= limits.pairs:
                        yield batch.rows((task << 32) | made)
                        batch, made = _Batch(), made + 1
                    key, machine, stretch, rows = (h1, h2, n), Machine(sizes, written), at, {}
                if side == _REFUSED:
                    machine = None
                if machine is None:
                    continue
                if at != stretch:
                    machine.feed(rows)
                    stretch, rows = at, {}
                ids = np.frombuffer(ids.as_buffer(), packed).astype(np.int64)
                rows[side] = (rows[side][0], np.concatenate([rows[side][1], ids])) if side in rows else (start, ids)
        close()
        if batch.docs:
            yield batch.rows((task << 32) | made)

    return run


_DONE = "h1 long, h2 long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _settled(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of a batch's documents, from the counts of the batch's pairs."""
    order = np.argsort(counts.column("pair").to_numpy())
    count, best = counts.column("count").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
    sums, bests = [], []
    for at, times in zip(docs.column("at").to_pylist(), docs.column("times").to_pylist(), strict=True):
        at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i8")
        sums.append(int((count[at] * times).sum()))
        bests.append(int(times[best[at]].sum()))
    names = [f.split()[0] for f in _DONE.split(", ")]
    known = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table([known[c] if c in known else docs.column(c) for c in names], names=names)


def events(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, limits: Limits = Limits()) -> DataFrame:
    """Token ends of both sides over the distinct texts: (h1, h2) names a text, n rows hold it; rows of side -1 refuse a text."""
    text = docs.where("text <> ''").select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text", F.octet_length("text")).alias("h2"), "text")
    distinct = text.groupBy("h1", "h2").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(a, b, limits)
        for batch in sliced(batches, limit=limits.piece):
            yield from encoder.events(batch)

    return distinct.select("h1", "h2", "n", "text").mapInArrow(run, _EVENT)


def aligned(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, limits: Limits = Limits()) -> DataFrame:
    """One row a distinct text with tokens: h1, h2, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    e = events(docs, a, b, limits)
    dealt = e.repartition(parts_for(e), "h1", "h2").sortWithinPartitions("h1", "h2", "stretch", "start", "side")
    swept = stash(dealt.mapInArrow(_sweep(a, b, limits), _SWEPT))
    pairs = swept.where("pairs is not null").select("batch", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("batch", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    of_a = F.shiftright("pair", _B_BITS).alias("a")
    # Tables of their own: batches and counts meet from two exchanges, so a pair that all batches hold can be split.
    counts = stash(pairs.groupBy("pair").agg(F.sum("docs").alias("count")))
    highest = counts.groupBy(of_a).agg(F.max("count").alias("highest"))
    judged = counts.select("pair", "count", of_a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = pairs.select(F.col("batch").alias("of"), "pair").join(judged, "pair")
    return swept.drop("pairs", "docs").groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(_settled, _DONE)


def op11(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, limits: Limits = Limits()) -> DataFrame:
    out = stash(aligned(docs, a, b, limits))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text", F.octet_length("text")).alias("h2"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return keyed.join(out, ["h1", "h2"], "left").select("doc_id", *(zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
