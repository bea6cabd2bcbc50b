"""Near-duplicate documents: DartMinHash signatures of weighted word shingles, banded joining, exact verification.

A document is the weighted set of its shingles of SHINGLE words (weight: how often each occurs; a shorter text is one
shingle). Darts are thrown at the plane over each shingle: along the weight axis a unit at a time, along the rank axis as
a Poisson stream whose gaps are hashed from the shingle, the unit and the dart's number, so equal regions of two
documents get equal darts. A dart picks one of COORDINATES by hash; the earliest dart of each coordinate is kept. Only
darts under a threshold set by the total weight are thrown, about COORDINATES * (ln COORDINATES + 2) of them whatever the
size; a document with an empty coordinate doubles its threshold. Two signatures agree in a coordinate with the
documents' weighted Jaccard similarity.

Links: exact copies collapse first. Documents that share a band are compared with the band's first document, exactly, and
joined; then all documents of a band that are still in different classes are compared with each other, block by block,
and only links that join two classes leave the task. A band that is one class costs nothing more, and no link that would
join two classes is passed over. A pair at similarity 0.8 shares no band with probability 3e-6.

Defined results: a text without words (null, empty, blank) is a class of its own row; a class is named after its smallest
doc_id (null only if every doc_id in it is null); equal rows are one class. An empty table gives no rows.
A text of any length is one set, held whole in its task; only doc_id and text are looked at, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, NON_SPACE, cut, mix, prefix_sums, slice_hashes, sliced, stash, utf8, word_bounds
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 5
COORDINATES = BANDS * BAND_ROWS
#: Estimated similarity under which a pair is not verified: five standard deviations under the threshold.
ESTIMATE_FLOOR = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / COORDINATES) ** 0.5
#: Members of a band that one comparison task holds.
BLOCK = 2048


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles, by row and hash."""
    starts, ends, bounds = word_bounds(data, offsets, NON_SPACE)
    words = slice_hashes(prefix_sums(BYTE_CODES[data]), starts, ends)
    n = np.diff(bounds)
    row_of_word = np.repeat(np.arange(len(n)), n)
    room = bounds[1:][row_of_word] - np.arange(len(words))
    first = np.arange(len(words)) == bounds[:-1][row_of_word]
    at = np.flatnonzero((room >= SHINGLE) | first)
    h = slice_hashes(prefix_sums(words), at, at + np.minimum(SHINGLE, room[at]))
    row = row_of_word[at]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def signatures(rows: int, row: np.ndarray, h: np.ndarray, weight: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """rows x coordinates dart numbers (0 in rows without shingles). weight may be fractional: the last unit is cut short."""
    out = np.zeros((rows, coordinates), np.uint64)
    units = np.ceil(weight).astype(np.int64)
    total = np.bincount(row, weight, rows)
    e = np.repeat(np.arange(len(h)), units)
    u = np.arange(len(e)) - np.repeat(np.cumsum(units) - units, units)
    key, of = mix(h[e] + u.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), row[e]
    part = weight[e] - u
    limit = coordinates * (np.log(coordinates) + 2) / np.maximum(total, 1e-12)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        live = np.isin(of, todo) if len(todo) < rows else np.ones(len(of), bool)
        k, r, p, rank, t = key[live], of[live], part[live], np.zeros(int(live.sum())), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(k):
            dart = mix(k + np.uint64((0x9FB21C651E98DF25 * (t + 1)) & (2**64 - 1)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            ok = rank < limit[r]
            k, r, p, rank, dart, t = k[ok], r[ok], p[ok], rank[ok], dart[ok], t + 1
            inside = p >= 1
            if not inside.all():
                inside |= (mix(dart ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < p
            found.append((r[inside], rank[inside], dart[inside]))
        r, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-rank, kind="stable")
        cell = r * coordinates + (mix(dart + np.uint64(77)) % np.uint64(coordinates)).astype(np.int64)
        flat = out.reshape(-1)
        flat[cell[order]] = dart[order] | np.uint64(1)
        todo = todo[(out[todo] == 0).any(axis=1)]
        out[todo] = 0
        limit[todo] *= 2
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """rows x BANDS hashes; the band's number is part of the hash."""
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), BANDS)).copy()
    for i in range(BAND_ROWS):
        h = mix(h * np.uint64(31) + sig[:, i::BAND_ROWS][:, :BANDS])
    return h


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed shingle tables."""
    (ha, ca), (hb, cb) = unpack(a), unpack(b)
    at = np.searchsorted(ha, hb)
    at[at == len(ha)] = 0
    same = ha[at] == hb if len(ha) else np.zeros(len(hb), bool)
    both = np.minimum(ca[at[same]], cb[same]).sum()
    return float(both / (ca.sum() + cb.sum() - both)) if len(ha) + len(hb) else 0.0


def pack(h: np.ndarray, count: np.ndarray) -> bytes:
    return h.astype("<u8").tobytes() + count.astype("<u4").tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 12
    return np.frombuffer(packed, "<u8", n), np.frombuffer(packed, "<u4", n, 8 * n).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        row, h, count = shingles(*utf8(batch.column("text")))
        sig = signatures(batch.num_rows, row, h, count.astype(np.float64))
        some = np.bincount(row, minlength=batch.num_rows) > 0
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)), pa.array(band_hashes(sig[some]).view(np.int64).reshape(-1)))
        short = (sig & np.uint64(0xFFFF)).astype("<u2")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h1"), batch.column("h2"), bands, pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "h1", "h2", "bands", "sig"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        row, h, count = shingles(*utf8(batch.column("text")))
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([pack(h[a:b], count[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["node", "packed"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similarity(a.as_py(), b.as_py()) >= THRESHOLD for a, b in zip(batch.column("pa"), batch.column("pb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def _links(group: pa.Table) -> pa.Table:
    """Verified links between the classes of one block (or block pair) of a band, as many as join them and no more.

    A pair is taken up in the first band that it shares, only while its ends are in different classes, and only if its
    estimate reaches the floor; whole shingle tables decide.
    """
    get = lambda c: group.column(c).to_pylist()
    node, packed, label, block = group.column("node").to_numpy(), get("packed"), get("label"), group.column("block").to_numpy()
    mine, theirs, band = get("i")[0], get("j")[0], get("band")[0]
    sig = np.frombuffer(b"".join(get("sig")), "<u2").reshape(len(node), -1)
    bands = np.array(get("bands"), np.int64)
    here = int(np.flatnonzero(bands[0] == band)[0])
    above = {x: x for x in label}

    def find(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out: list[tuple[int, int]] = []
    left, right = np.flatnonzero(block == mine), np.flatnonzero(block == theirs)
    for x in left:
        rest = right[node[right] > node[x]] if mine == theirs else right
        rest = rest[(bands[rest, :here] != bands[x, :here]).all(axis=1)]
        if not len(rest):
            continue
        same = (sig[rest] == sig[x]).mean(axis=1)
        for y in rest[np.argsort(-same, kind="stable")][: int((same >= ESTIMATE_FLOOR).sum())]:
            one, two = find(label[x]), find(label[y])
            if one != two and similarity(packed[x], packed[y]) >= THRESHOLD:
                above[max(one, two)] = min(one, two)
                out.append((min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))))
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([p for _, p in out], pa.int64())})


class _Nodes:
    """The distinct texts of a table and their shared bands."""

    def __init__(self, docs: DataFrame) -> None:
        text = docs.select("doc_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        self.keyed = text.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text", F.octet_length("text")).alias("h2"))
        kind = dict(self.keyed.dtypes)["doc_id"]
        sketched = self.keyed.mapInArrow(_sketch, f"doc_id {kind}, h1 long, h2 long, bands array<long>, sig binary")
        self.rows = cut(sketched.withColumn("rid", F.monotonically_increasing_id()))
        nodes = self.rows.groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_doc"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
        self.nodes = cut(nodes)
        each = self.nodes.select("node", F.explode("bands").alias("band"))
        shared = each.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1")
        self.members = cut(each.join(shared, "band"))

    def packed(self, ends: DataFrame) -> DataFrame:
        """(node, packed) of these nodes: the texts are read again, one copy of each, and only its digest moves on."""
        need = self.nodes.join(ends.distinct(), "node").select("node", "h1", "h2", F.col("first_doc").alias("d"))
        one = self.keyed.join(need, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("d"))).select("node", "text")
        return one.mapInArrow(_packed, "node long, packed binary").dropDuplicates(["node"])

    def star_links(self) -> DataFrame:
        """Verified pairs of a band's first document with its others."""
        pairs = cut(self.members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())
        packed = cut(self.packed(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
        a = packed.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
        b = packed.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "pa", "pb").mapInArrow(_verify, "a long, b long")

    def cross_links(self, labels: DataFrame) -> DataFrame:
        """Verified links across classes in bands of three documents or more; one class or two documents are settled."""
        named = self.members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = named.groupBy("band").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("band")
        rows = cut(named.join(split, "band").select("band", "n", "node", "label"))
        held = self.nodes.select("node", "sig", "bands").join(self.packed(rows.select("node")), "node")
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        rows = rows.join(held, "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.select("band", "node", "label", "sig", "bands", "packed", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return rows.groupBy("band", "i", "j").applyInArrow(_links, "a long, b long")


def _labelled(docs: DataFrame) -> tuple[_Nodes, DataFrame]:
    """The distinct texts of docs that have words, and (node, h1, h2, first_doc, label): the class of each."""
    n = _Nodes(docs)
    edges = cut(n.star_links())
    labels = components(edges)
    more = cut(n.cross_links(labels))
    if not more.isEmpty():
        labels = components(edges.union(more))
    return n, n.nodes.select("node", "h1", "h2", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _blank(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_class): one row a row of docs."""
    n, named = _labelled(docs)
    ids = named.groupBy("label").agg(F.min("first_doc").alias("class_id"))
    of_text = named.join(ids, "label").select("h1", "h2", "class_id", "label")
    # Tables of their own: rows and sizes then meet from two exchanges, and the part of a hot class can be split.
    with_words = stash(n.rows.join(of_text, ["h1", "h2"]).select("doc_id", "class_id", "label"))
    size = stash(with_words.groupBy("label").agg(F.count("*").alias("n_class")))
    out = with_words.join(size, "label").select("doc_id", "class_id", "n_class")
    blank = _blank(docs).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    return out.unionByName(blank)


def op9(docs: DataFrame) -> DataFrame:
    return classes(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, by the least doc_id and its text, so null or repeated ids keep no other row; and the rows without words."""
    _, named = _labelled(docs)
    least = F.struct(F.col("first_doc").isNull(), "first_doc", "node")
    first = named.groupBy("label").agg(F.min_by(F.struct("first_doc", "h1", "h2"), least).alias("f")).select(F.col("f.first_doc").alias("_d"), F.col("f.h1").alias("_h1"), F.col("f.h2").alias("_h2"))
    same = docs["doc_id"].eqNullSafe(first["_d"]) & (F.xxhash64(docs["text"]) == first["_h1"]) & (F.xxhash64(F.lit(7), docs["text"], F.octet_length(docs["text"])) == first["_h2"])
    return docs.join(first, same, "left_semi").unionByName(_blank(docs)).dropDuplicates(["doc_id", "text"])
