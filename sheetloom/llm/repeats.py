"""Exact repeats of a fixed length over a whole corpus, at the cost of a few anchors per window instead of every window.

A window is WINDOW consecutive tokens of one document. The least hashed GRAM-token gram inside a window is its anchor;
equal windows have equal anchors at equal offsets, so a window can recur only where its anchor's gram recurs. Neighbouring
windows with the same anchor form a run, whose context is all their tokens. Then, without loss:

* a gram that occurs once drops out with all its windows (one aggregation with partial sums);
* of the rest, a context that recurs whole has only recurring windows (no text moves);
* only contexts whose gram recurs in other surroundings need their tokens: one copy of each distinct context is fetched,
  and a resolver that the operator brings finds which of its windows start elsewhere too.

A gram with more than HOT_CONTEXTS distinct contexts, too many for one task, goes another exact way: windows of its contexts are counted by hash
in one aggregation, so no task holds a hot group. Equality of contexts and grams is equality of two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, parts_for, prefix_sums, slice_hashes, sliced, stash, utf8

#: Distinct contexts of a gram up to which one resolver gets them all: at twice the window each, some 3 MB of bytes and a hundred
#: of tries.
HOT_CONTEXTS = 1 << 12
#: Tokens of contexts that a resolver gets at once.
SHARD_BYTES = 4 << 20
_POSITION_BITS = np.uint64(28)
#: Tokens of which the runs are looked for at once: their places fit the position bits.
RUN_TOKENS = 1 << 27


@dataclass
class Context:
    """One distinct context: tokens as bytes, windows' starts 0..last, the anchor's place, how often it occurs."""

    gram: int
    ctx: int
    times: int
    anchor: int
    last: int
    data: bytes


@dataclass
class Tokens:
    """How an operator reads a text. read: bytes and row offsets to token hashes and row bounds; cut: tokens a..b of a row as bytes."""

    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, object]]
    cut: Callable[[np.ndarray, object, int, int], bytes]
    window: int
    gram: int
    slice_bytes: int
    #: Contexts of a shard to (index of the context, first window, last window) of windows that start elsewhere too.
    resolve: Callable[[list[Context]], list[tuple[int, int, int]]]
    #: Bytes of a context to its token hashes.
    hashes: Callable[[bytes], np.ndarray]


def runs(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int, most: int = RUN_TOKENS) -> tuple[np.ndarray, ...]:
    """Row, first window, last window, anchor (all as token positions in the slice), gram hash, context hash of each run.

    A longer slice is taken in stretches of `most` windows. A run that a border cuts is two runs, each as good as any other.
    """
    if len(codes) < most + window:
        return _runs(codes, bounds, window, gram)
    parts = []
    for at in range(0, len(codes) - window + 1, most):
        size = min(most + window - 1, len(codes) - at)
        row, lo, hi, anchor, grams, ctx = _runs(codes[at : at + size], np.clip(bounds - at, 0, size), window, gram)
        parts.append((row, lo + at, hi + at, anchor + at, grams, ctx))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    n, w = len(codes), window - gram + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < window:
        return empty
    sums = prefix_sums(codes)
    at = np.arange(n - gram + 1)
    grams = slice_hashes(sums, at, at + gram)
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    least = (grams & ~low) | at.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    room = np.diff(bounds) - window + 1
    room[room < 0] = 0
    starts = np.repeat(bounds[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    if not len(starts):
        return empty
    row = np.repeat(np.arange(len(room)), room)
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    lo, hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    return row[first], lo, hi, anchor[first], grams[anchor[first]], mix(slice_hashes(sums, lo, hi + window) + (anchor[first] - lo).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit key of the two (k1, k2): repeated rows share it, and share their result."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(5), "text", "doc_id").alias("k2"))


def _anchors(tokens: Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=tokens.slice_bytes):
            codes, bounds, _ = tokens.read(*utf8(batch.column("text")))
            row, lo, hi, anchor, gram, ctx = runs(codes, bounds, tokens.window, tokens.gram)
            take = pa.array(row)
            base = bounds[row]
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array((anchor - base).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64))], ["k1", "k2", "lo", "hi", "at", "gram", "ctx"])

    return run


def _fetch(tokens: Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, limit=tokens.slice_bytes):
            data, offsets = utf8(batch.column("text"))
            _, bounds, places = tokens.read(data, offsets)
            out: list[tuple] = []
            for row, wants in enumerate(batch.column("want").to_pylist()):
                b = int(bounds[row])
                out += [(w["gram"], w["ctx"], w["times"], w["at"] - w["lo"], w["hi"] - w["lo"], tokens.cut(data, places, b + w["lo"], b + w["hi"] + tokens.window)) for w in wants]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["gram", "ctx", "times", "at", "last", "data"])

    return run


_FOUND = "gram long, ctx long, a int, b int"


def _resolver(tokens: Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by gram; whole groups are gathered into shards of about SHARD_BYTES."""

    def solved(shard: list[Context]) -> pa.RecordBatch:
        found = tokens.resolve(shard)
        return pa.RecordBatch.from_arrays([pa.array([shard[i].gram for i, _, _ in found], pa.int64()), pa.array([shard[i].ctx for i, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], ["gram", "ctx", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, last = [], 0, None
        for batch in batches:
            for gram, ctx, times, at, end, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "times", "at", "last", "data")), strict=True):
                if gram != last and held > SHARD_BYTES:
                    yield solved(shard)
                    shard, held = [], 0
                shard.append(Context(gram, ctx, times, at, end, data))
                held, last = held + len(data), gram
        if shard:
            yield solved(shard)

    return run


def _windows(tokens: Tokens) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hash of every window of the contexts of hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for gram, ctx, times, last, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "ctx", "times", "last", "data")), strict=True):
                at = np.arange(last + 1)
                parts.append((np.full(last + 1, gram), np.full(last + 1, ctx), np.full(last + 1, times), at.astype(np.int32), slice_hashes(prefix_sums(tokens.hashes(data)), at, at + tokens.window).view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["gram", "ctx", "times", "a", "w"])

    return run


def repeated_spans(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """(k1, k2, spans): per document key its [a, b) token spans, each made of windows that start elsewhere too."""
    w = tokens.window
    keyed = _keyed(docs)
    found = stash(keyed.mapInArrow(_anchors(tokens), "k1 long, k2 long, lo int, hi int, at int, gram long, ctx long"))
    # A table of its own: the join below then reads anchors and grams from two exchanges, and a hot gram's part can be split.
    recur = stash(found.groupBy("gram").agg(F.count("*").alias("n"), (F.min("ctx") == F.max("ctx")).alias("pure")).where("n > 1").select("gram", "pure"))
    rows = stash(found.join(recur, "gram"))
    mixed = rows.where("not pure")
    contexts = stash(mixed.groupBy("gram", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("one")))
    wants = contexts.select("one.k1", "one.k2", F.struct("gram", "ctx", "times", "one.lo", "one.hi", "one.at").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("want"))
    one = keyed.join(wants, ["k1", "k2"]).select("k1", "k2", "text", "want")
    texts = one.mapInArrow(_fetch(tokens), "gram long, ctx long, times long, at int, last int, data binary").dropDuplicates(["gram", "ctx"])
    hot = contexts.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > HOT_CONTEXTS).select("gram")
    texts = stash(texts.join(hot.withColumn("hot", F.lit(True)), "gram", "left"))
    plain = texts.where("hot is null").drop("hot").repartition(parts_for(texts), "gram").sortWithinPartitions("gram")
    partial = plain.mapInArrow(_resolver(tokens), _FOUND)
    if not hot.isEmpty():
        each = stash(texts.where("hot").drop("hot").mapInArrow(_windows(tokens), "gram long, ctx long, times long, a int, w long"))
        again = each.groupBy("gram", "w").agg(F.sum("times").alias("n")).where("n > 1").select("gram", "w")
        # Contexts that occur again whole are removed whole anyway; of the others, neighbouring windows become one stretch.
        hits = each.where("times = 1").join(again, ["gram", "w"]).select("gram", "ctx", "a")
        order = Window.partitionBy("gram", "ctx").orderBy("a")
        starts = hits.withColumn("new", F.coalesce(F.col("a") - F.lag("a").over(order) > 1, F.lit(True)).cast("int"))
        partial = partial.unionByName(starts.withColumn("run", F.sum("new").over(order)).groupBy("gram", "ctx", "run").agg(F.min("a").alias("a"), F.max("a").alias("b")).drop("run"))
    partial = stash(partial)
    whole = rows.where("pure").select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + w).alias("b"))
    more = mixed.join(contexts.where("times > 1").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select("k1", "k2", F.col("lo").alias("a"), (F.col("hi") + w).alias("b"))
    some = mixed.join(partial, ["gram", "ctx"]).select("k1", "k2", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") + w).alias("b"))
    return whole.union(more).union(some).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, tokens: Tokens, also: Tokens | None = None) -> DataFrame:
    """doc_id, text, spans (null: none), and spans of `also` as more: one row a row of docs."""
    out = _keyed(docs).join(repeated_spans(docs, tokens), ["k1", "k2"], "left")
    if also is not None:
        out = out.join(repeated_spans(docs, also).withColumnRenamed("spans", "more"), ["k1", "k2"], "left")
    return out.select("doc_id", "text", "spans", *(["more"] if also is not None else []))
