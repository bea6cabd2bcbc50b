"""Benchmark decontamination by n-gram windows.

Every window of N consecutive normalised words of a benchmark item (the whole item, if it is shorter) is hashed into a
set; training texts are scanned window by window, hits are compared word for word, and covered words are marked.

The set is flat arrays: per window its hash, its bytes' place in the normalised items, and its item, under 30 bytes a word
beside the text itself. Up to MAX_BROADCAST_BYTES of benchmark text (checked before anything is collected), so up to about
5 times that in memory, it is broadcast and the corpus is read once without a shuffle. A larger benchmark is hashed to
partitions instead: blocks of the item table, each about half the bound, are scanned in turn and each pass adds its hits.

Defined results: null or word-less text has no words and no hits; a null item has no windows; repeated items count as
separate item_ids; repeated rows are kept, each judged alone; an empty benchmark leaves every document clean.
A text of any length is scanned whole, alone in its slice; an empty table gives no rows; columns named like a result's are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, covered, map_text, prefix_sums, slice_hashes, stash, utf8, word_bounds

WINDOW = 10
MAX_BROADCAST_BYTES = 32 << 20
#: Passes over the corpus, for a benchmark beyond the bound, that go into one plan.
PASSES_A_PLAN = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class WindowSet:
    """Windows of benchmark items by length: sorted hashes with a bitmap in front; behind each its bytes and its item."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.item_ids = [i for i, _ in items]
        raw = [(t or "").encode() for _, t in items]
        offsets = np.cumsum([0, *map(len, raw)])
        low = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        starts, ends, bounds = word_bounds(low, offsets, _WORD)
        count = np.diff(bounds)
        row = np.repeat(np.arange(len(items)), count)
        # All words of all items, one blank behind each: a window is one stretch of these bytes.
        self.text = b"".join(low[a:b].tobytes() + b" " for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        at_byte = np.cumsum(np.concatenate([[0], ends - starts + 1])).astype(np.int64)
        sums = prefix_sums(slice_hashes(prefix_sums(BYTE_CODES[low]), starts, ends))
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        size_of = np.minimum(window, count)[row]
        within = np.arange(len(starts)) - bounds[:-1][row]
        for n in sorted(set(size_of.tolist())):
            at = np.flatnonzero((size_of == n) & (within + n <= count[row]))
            h = slice_hashes(sums, at, at + n)
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            bits = np.zeros(1 << 20, bool)
            bits[(h >> np.uint64(44)).astype(np.int64)] = True
            self.parts[n] = (bits, h, at_byte[at], at_byte[at + n] - 1, row[at].astype(np.int32))

    def items_at(self, n: int, h: int, words: bytes) -> set[str]:
        """Items with a window of n words that reads `words`, word for word."""
        _, known, a, b, item = self.parts[n]
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        return {self.item_ids[item[k]] for k in range(lo, hi) if self.text[a[k] : b[k]] == words}


def scan(batch: pa.RecordBatch, windows: WindowSet) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, set[str]]]:
    """Per row: word starts and ends (bytes of the row), hit mask by word, items hit."""
    data, offsets = utf8(batch.column("text"))
    low = _LOWER[data]
    starts, ends, bounds = word_bounds(low, offsets, _WORD)
    raw, n = low.tobytes(), len(starts)
    h = slice_hashes(prefix_sums(BYTE_CODES[low]), starts, ends)
    sums = prefix_sums(h)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    from_, to_ = [], []
    items: dict[int, set[str]] = {}
    for size, (bits, known, *_) in windows.parts.items():
        if n < size:
            continue
        at = np.arange(n - size + 1)
        wh = slice_hashes(sums, at, at + size)
        at = at[bits[(wh >> np.uint64(44)).astype(np.int64)]]
        at = at[(row[at] == row[at + size - 1]) & np.isin(wh[at], known)]
        for i in at.tolist():
            got = windows.items_at(size, wh[i], b" ".join(raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True)))
            if got:
                from_.append(i)
                to_.append(i + size)
                items.setdefault(int(row[i]), set()).update(got)
    hit = covered(n, np.array(from_, np.int64), np.array(to_, np.int64))
    return [(starts[a:b] - o, ends[a:b] - o, hit[a:b], items.get(i, set())) for i, (a, b, o) in enumerate(zip(bounds[:-1], bounds[1:], offsets[:-1], strict=True))]


def _cleaned(text: str, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its runs of hit words and without what stands between the words of a run."""
    raw, out, at = text.encode(), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("clean_text", T.StringType()),
]


def _scan_with(docs: DataFrame, items: list[tuple[str, str | None]], window: int, keep: list[str], prior: bool = False) -> DataFrame:
    """One pass. prior: docs has hit_items and hit_spans of earlier passes, to which this one adds."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, window))

    def kernel(batch: pa.RecordBatch) -> dict:
        texts, out = batch.column("text"), {f.name: [] for f in FIELDS}
        for k, (s, e, hit, got) in enumerate(scan(batch, shared.value)):
            if prior:
                old = batch.column("hit_spans")[k].as_py()
                hit = hit | covered(len(hit), np.array(old[::2], np.int64), np.array(old[1::2], np.int64))
                got = got | set(batch.column("hit_items")[k].as_py())
            out["n_words"].append(len(s))
            out["n_hit"].append(int(hit.sum()))
            out["hit_items"].append(sorted(got))
            out["hit_spans"].append(np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist())
            out["clean_text"].append(_cleaned(texts[k].as_py(), s, e, hit) if hit.any() else texts[k].as_py())
        return out

    return map_text(docs, kernel, FIELDS, keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Columns of `keep` (all of docs by default) with n_words, n_hit, hit_items (sorted), hit_spans and clean_text.

    hit_spans holds start and end (exclusive) of each maximal run of hit words, flat. docs needs `text`; benchmark needs
    item_id and text. Same-named columns of docs are replaced.
    """
    keep = docs.columns if keep is None else keep
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= max_bytes:
        return _scan_with(docs, [(r.item_id, r.text) for r in items.collect()], window, keep)
    # Over the bound: blocks of items by hash, each about half the bound; one pass a block, each carrying the hits so far.
    blocks, names = 2 * -(-total // max_bytes), {f.name for f in FIELDS}
    keep = [c for c in keep if c not in names]
    out = docs.select(*keep, *([] if "text" in keep else ["text"]))
    for b in range(blocks):
        part = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        out = _scan_with(out, part, window, [c for c in out.columns if c not in names], prior=b > 0)
        if b % PASSES_A_PLAN == PASSES_A_PLAN - 1:
            out = stash(out)
    return out.select(*keep, *(f.name for f in FIELDS))


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
