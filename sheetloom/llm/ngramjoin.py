"""Documents linked by the Jaccard similarity of their n-grams: an exact join by trees of count vectors.

A document is the set of its distinct SHINGLE-word shingles (A-Z lower-cased; fewer words are one shingle). Its shingles are
hashed into groups, about one for two shingles, and the count in each group is a point. The overlap of two
documents is at most the sum of the smaller counts of each group, and the overlap of anything below two nodes of a tree at most
that sum over the nodes' upper corners; a pair, or a pair of subtrees, whose bound is below what a link needs is dropped,
and the pairs that survive are verified on whole sets. Larger vectors fold onto smaller ones by adding halves.

Which points share a tree: similar documents share one of the first n - ceil(0.8 n) + 1 shingles of each in any one order,
here the rarest first (rarity from counts of all shingles in RANK_BUCKETS buckets, a table of fixed size). A shingle that one
document alone has there drops out in an aggregation, and of shingles with the same documents one stands for all.

1. Documents with equal sets are one point.
2. The points of a shingle meet its first one; pairs that pass the bound are verified, and links joined to classes.
3. Shingles whose points are then of several classes get their trees, one for each step of sizes, as a partner is in the same
   or the next step. Of two classes up to FEW candidates of a shingle are verified as pairs, once however many shingles they share. Where there are
   more, the points are set aside, and if their classes are still apart, their sets meet in tasks that stop at the first link of two classes.
   A shingle with over BLOCK points is cut by step and hash, and pairs of cuts are tasks of their own. What is one class costs
   nothing more, so copies are never expanded into pairs, and no link that would join two classes is passed over.

Defined results: null, empty and blank texts have no shingles and are components of their own; a component is named after
its smallest doc_id (null only if all are null); repeated rows and ids are rows of their own; ties at exactly 0.8 link; a text of any length is one set, held whole in
its task; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_stash, mix, sliced, stash, utf8
from .graph import components
from .neardup import shingles

#: A link needs PER_CENT * union <= 100 * intersection.
PER_CENT = 80
RANK_BUCKETS = 1 << 16
#: Shingles for each group of a count vector, and the fewest and most groups.
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 2, 16, 1 << 15
#: Points of a leaf; points of a task's block; candidates between two classes that are verified as pairs.
LEAF, BLOCK, FEW = 32, 2048, 4

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-PER_CENT * (a + b) // (100 + PER_CENT))


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, by row and hash."""
    data, offsets = utf8(column)
    row, h, _ = shingles(LOWER[data], offsets)
    return row, h


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of the count vector of a set of n: a power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / PER_GROUP)).clip(0).astype(np.int64), LEAST_GROUPS, MOST_GROUPS)


def packed_counts(counts: np.ndarray) -> bytes:
    """A count vector in bytes of one, or of four where a count needs it."""
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def unpacked_counts(packed: bytes | pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u1" if len(packed) == groups_of(np.array([n]))[0] else "<u4").astype(np.int64)


def step_of(n: np.ndarray) -> np.ndarray:
    """Steps of sizes: linked sets are at most two apart (one, but for rounding)."""
    return np.floor(np.log(n) / np.log(100 / PER_CENT)).astype(np.int64)


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors (last axis) over fewer groups."""
    while vectors.shape[-1] > groups:
        half = vectors.shape[-1] // 2
        vectors = vectors[..., :half] + vectors[..., half:]
    return vectors


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(a.shape[-1], b.shape[-1])
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= PER_CENT * (len(a) + len(b) - both)


@dataclass
class Tree:
    """A packed tree over points of one dimension: halves along the coordinate of widest spread, LEAF points a leaf."""

    high: np.ndarray
    least: int
    most: int
    label: int | None
    points: np.ndarray
    below: tuple[Tree, Tree] | None

    @classmethod
    def over(cls, points: np.ndarray, vectors: np.ndarray, n: np.ndarray, label: np.ndarray) -> Tree:
        mine, of = vectors[points], label[points]
        one = int(of[0]) if (of == of[0]).all() else None
        below = None
        if len(points) > LEAF:
            # The size is a coordinate too: it is the sum of the others, and the widest where sizes differ.
            spread = np.append(mine.max(axis=0) - mine.min(axis=0), n[points].max() - n[points].min())
            widest = int(spread.argmax())
            key = n[points] if widest == mine.shape[1] else mine[:, widest]
            order = np.argsort(key, kind="stable")
            half = len(points) // 2
            below = (cls.over(points[order[:half]], vectors, n, label), cls.over(points[order[half:]], vectors, n, label))
        return cls(mine.max(axis=0), int(n[points].min()), int(n[points].max()), one, points, below)

    def may_meet(self, other: Tree) -> bool:
        if self.label is not None and self.label == other.label:
            return False
        if 100 * self.most < PER_CENT * other.least or 100 * other.most < PER_CENT * self.least:
            return False
        return int(np.minimum(self.high, other.high).sum()) >= needed(self.least, other.least)


def candidates(n: np.ndarray, label: np.ndarray, vectors: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of a point of left and one of right, of different labels, whose overlap may be enough: trees of a step against those of the next.

    With left and right the same array, each pair comes once.
    """
    itself = left is right
    of_left = {s: left[step_of(n[left]) == s] for s in np.unique(step_of(n[left]))}
    of_right = of_left if itself else {s: right[step_of(n[right]) == s] for s in np.unique(step_of(n[right]))}
    for s, points in of_left.items():
        for d in range(0 if itself else -2, 3):
            if s + d in of_right:
                yield from _between(n, label, vectors, points, of_right[s + d])


def _between(n: np.ndarray, label: np.ndarray, vectors: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """candidates() of two sets of about one size: two trees against each other."""
    some = np.concatenate([left, right])
    groups = min(v.shape[0] for v in (vectors[k] for k in some))
    coarse = np.zeros((len(vectors), groups), np.int64)
    for k in some:
        coarse[k] = folded(vectors[k], groups)
    itself = left is right
    one = Tree.over(left, coarse, n, label)
    two = one if itself else Tree.over(right, coarse, n, label)
    stack = [(one, two)]
    while stack:
        u, v = stack.pop()
        if not u.may_meet(v):
            continue
        if u.below is None and v.below is None:
            x, y = u.points, v.points
            bound = np.minimum(coarse[x][:, None, :], coarse[y][None, :, :]).sum(axis=2)
            ok = (bound >= needed(n[x][:, None], n[y][None, :])) & (label[x][:, None] != label[y][None, :]) & (100 * np.minimum(n[x][:, None], n[y][None, :]) >= PER_CENT * np.maximum(n[x][:, None], n[y][None, :]))
            if itself and u is v:
                ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            for i, j in zip(*np.nonzero(ok), strict=True):
                p, q = int(x[i]), int(y[j])
                if min(vectors[p].shape[0], vectors[q].shape[0]) == groups or overlap_bound(vectors[p], vectors[q]) >= needed(n[p], n[q]):
                    yield p, q
        elif itself and u is v:
            a, b = u.below
            stack += [(a, a), (b, b), (a, b)]
        elif v.below is None or (u.below is not None and len(u.points) >= len(v.points)):
            stack += [(w, v) for w in u.below]
        else:
            stack += [(u, w) for w in v.below]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and a 128-bit name of each row's set."""
    for batch in sliced(batches):
        row, h = sets(batch.column("text"))
        n = np.bincount(row, minlength=batch.num_rows)
        names = []
        for salt in (np.uint64(0), np.uint64(0x9FB21C651E98DF25)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt), dtype=np.uint64)])
            ends = np.cumsum(n)
            names.append(mix(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "h1", "h2")] + [pa.array(n, pa.int64()), *map(pa.array, names)], ["doc_id", "h1", "h2", "n", "s1", "s2"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each bucket, in one task."""
    n = np.zeros(RANK_BUCKETS, np.int64)
    for batch in sliced(batches):
        n += np.bincount((sets(batch.column("text"))[1] >> np.uint64(48)).astype(np.int64), minlength=RANK_BUCKETS)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["bucket", "n"])


def _pointed(rank: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count vector and first shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            row, h = sets(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            groups = groups_of(n)
            begin = np.concatenate([[0], np.cumsum(groups)])
            counts = np.bincount(begin[row] + (h & (groups[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(begin[-1]))
            order = np.lexsort((h, rank[(h >> np.uint64(48)).astype(np.int64)], row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = order[place < (n - -(-PER_CENT * n // 100) + 1)[row]]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=batch.num_rows))]).astype(np.int32)
            vectors = pa.array([packed_counts(counts[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), vectors, pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[first].view(np.int64)))], ["node", "n", "vector", "first"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        row, h = sets(batch.column("text"))
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["node", "packed"])


def _view(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bound is enough."""
    for batch in batches:
        a, b = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        ok = 100 * np.minimum(a, b) >= PER_CENT * np.maximum(a, b)
        for k in np.flatnonzero(ok):
            ok[k] = overlap_bound(unpacked_counts(batch.column("va")[k].as_buffer(), a[k]), unpacked_counts(batch.column("vb")[k].as_buffer(), b[k])) >= needed(a[k], b[k])
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [linked(_view(a, "<u8"), _view(b, "<u8")) for a, b in zip(batch.column("pa"), batch.column("pb"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """n, label, vectors of a task's points, and which of them are in its two blocks."""
    get = lambda c: group.column(c).to_numpy()
    own, cell, other = get("cell"), get("i")[0], get("j")[0]
    left = np.flatnonzero(own == cell)
    return get("n"), get("label"), [unpacked_counts(v.as_buffer(), k) for v, k in zip(group.column("vector"), get("n"), strict=True)], left, left if cell == other else np.flatnonzero(own == other)


def _possible(group: pa.Table, most: int = FEW) -> pa.Table:
    """Candidates (a, b) between classes, `most` of two classes; and of classes with more, each point as a, with b null."""
    n, label, vectors, left, right = _sides(group)
    node, token = group.column("node").to_numpy(), group.column("token")[0].as_py()
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    many: set[int] = set()
    if len(left) and len(right):
        for p, q in candidates(n, label, vectors, left, right):
            held = pairs.setdefault((min(label[p], label[q]), max(label[p], label[q])), [])
            if len(held) < most:
                held.append((p, q))
            else:
                many |= {p, q, *(x for pair in held for x in pair)}
    out = [(int(node[p]), int(node[q])) for held in pairs.values() for p, q in held] + [(int(node[p]), None) for p in sorted(many)]
    return pa.table({"token": pa.array([token] * len(out), pa.int64()), "a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _links(group: pa.Table) -> pa.Table:
    """Verified links between classes, as many as join them."""
    n, label, vectors, left, right = _sides(group)
    above = {int(x): int(x) for x in label}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    node, held = group.column("node").to_numpy(), [_view(p, "<u8") for p in group.column("packed")]
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        for p, q in candidates(n, label, vectors, left, right):
            a, b = find(int(label[p])), find(int(label[q]))
            if a != b and linked(held[p], held[q]):
                above[max(a, b)] = min(a, b)
                out.append((int(node[p]), int(node[q])))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


class _Join:
    def __init__(self, docs: DataFrame) -> None:
        text = docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        self.keyed = text.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text", F.octet_length("text")).alias("h2"))
        self.kind = dict(self.keyed.dtypes)["doc_id"]
        self.rows = stash(self.keyed.mapInArrow(_described, f"doc_id {self.kind}, h1 long, h2 long, n long, s1 long, s2 long"))
        one = self.rows.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h1", "h2")).alias("one"))
        self.nodes = stash(one.select("s1", "s2", "least", "one.*").withColumn("node", F.monotonically_increasing_id()))
        self.points = stash(self._texts(self.nodes.select("node")).mapInArrow(_pointed(self._rank()), "node long, n long, vector binary, first array<long>").dropDuplicates(["node"]))

    def _rank(self) -> np.ndarray:
        """Rarity of each bucket: the logarithm, in eighths of a bit, of the number of shingles of all documents in it."""
        out = np.zeros(RANK_BUCKETS, np.int64)
        for r in self.keyed.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # RANK_BUCKETS rows at most
            out[r.bucket] = int(8 * np.log2(r.n + 1))
        return out

    def _texts(self, of: DataFrame) -> DataFrame:
        """(node, text), a row or more for each of these nodes."""
        need = self.nodes.join(of, "node").select("node", "h1", "h2", F.col("doc_id").alias("d"))
        return self.keyed.join(need, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")

    def packed(self, of: DataFrame) -> DataFrame:
        return self._texts(of.distinct()).mapInArrow(_packed, "node long, packed binary").dropDuplicates(["node"])

    def members(self) -> DataFrame:
        """(token, node, k, center): shingles that several points have among their first, one for each set of points."""
        each = self.points.select("node", F.explode("first").alias("token"))
        of = each.groupBy("token").agg(F.count("*").alias("k"), F.min("node").alias("center"), F.bit_xor(F.xxhash64("node")).alias("all"))
        lists = of.where("k > 1").groupBy("k", "center", "all").agg(F.min("token").alias("token"))
        return stash(each.join(stash(lists.select("token", "k", "center")), "token"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        packed = stash(self.packed(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        side = lambda s: packed.select(F.col("node").alias(s), F.col("packed").alias(f"p{s}"))
        out = stash(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "pa", "pb").mapInArrow(_verified, "a long, b long"))
        drop_stash(packed)
        return out

    def star_links(self, members: DataFrame) -> DataFrame:
        """Verified pairs of a shingle's first point and its others."""
        point = lambda s: self.points.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("vector").alias(f"v{s}"))
        pairs = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
        return self.verified(stash(pairs.join(point("a"), "a").join(point("b"), "b").select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bounded, "a long, b long")))

    def _tasks(self, rows: DataFrame) -> DataFrame:
        """Rows (token, node, n, ...) once for each task (token, i, j) that compares two blocks, cell naming their own.

        Up to BLOCK points are one block. More are cut by steps of size, within which and to the next of which partners lie, and by hash.
        """
        step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PER_CENT))).cast("long")
        total = rows.groupBy("token").agg(F.count("*").alias("points"))
        stepped = rows.join(total, "token").withColumn("step", F.when(F.col("points") > BLOCK, step).otherwise(F.lit(0).cast("long")))
        blocks = stepped.groupBy("token", "step").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        near = blocks.select("token", F.explode(F.array(*(F.struct((F.col("step") - d).alias("step"), F.lit(d).alias("d"), "blocks") for d in (-2, -1, 0, 1, 2)))).alias("x")).select("token", "x.*")
        known = near.groupBy("token", "step").agg(F.map_from_entries(F.collect_list(F.struct("d", "blocks"))).alias("near"))
        name = lambda s, b: s * F.lit(1 << 32) + b
        placed = stepped.join(known, ["token", "step"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("near")[F.lit(0)])).withColumn("cell", name(F.col("step"), F.col("block")))
        others = F.flatten(F.transform(F.map_entries("near"), lambda e: F.transform(F.sequence(F.lit(0).cast("long"), e["value"] - 1), lambda b: name(F.col("step") + e["key"], b))))
        dealt = placed.withColumn("other", F.explode(others))
        return dealt.select(*rows.columns, "cell", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"))

    def _mixed(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(token, node, label, n) of shingles whose points are of several classes."""
        named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("token", "node", "label")
        split = named.groupBy("token").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("token")
        return stash(named.join(split, "token").join(self.points.select("node", "n"), "node").select("token", "node", "label", "n"))

    def cross_links(self, members: DataFrame, edges: DataFrame) -> DataFrame:
        """Verified links across the classes that edges make, of shingles with three points or more (two are settled)."""
        mixed = self._mixed(members.where("k > 2"), components(edges))
        vectors = self.points.select("node", "vector")
        possible = _possible
        found = stash(self._tasks(mixed).join(vectors, "node").groupBy("token", "i", "j").applyInArrow(lambda group: possible(group), "token long, a long, b long"))
        few = self.verified(stash(found.where("b is not null").select("a", "b").distinct()))
        many = found.where("b is null").select("token", F.col("a").alias("node")).distinct()
        if many.isEmpty():
            return few
        apart = self._mixed(many, components(edges.union(few)))
        packed = stash(self.packed(apart.select("node")))
        held = self._tasks(apart).join(vectors.join(packed, "node"), "node")
        return few.union(stash(held.groupBy("token", "i", "j").applyInArrow(_links, "a long, b long")))


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row a row of docs."""
    j = _Join(docs)
    members = j.members()
    edges = j.star_links(members)
    labels = components(edges.union(j.cross_links(members, edges)))
    named = j.nodes.select("node", "s1", "s2", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named)
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # A table of its own: rows and components meet from two exchanges, so the part of a set that many rows have can be split.
    of_set = stash(named.join(ids, "label").select("s1", "s2", "component_id"))
    out = j.rows.join(of_set, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.unionByName(blank.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13(docs: DataFrame) -> DataFrame:
    return linked_components(docs)
