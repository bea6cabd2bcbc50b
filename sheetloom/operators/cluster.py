"""Single-linkage clusters of points and boxes: runs of grid cells, connected components, bounding boxes.

Joins of points and labels are merge joins: a small file can hold many rows, and Spark would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import text as X
from sheetloom.sources.stages import checkpointed

MIN_MEMBERS = 5
#: Rounds of label propagation; label jumps halve paths, so so many reach across 2**MAX_ROUNDS nodes.
MAX_ROUNDS = 60
#: Edges whose components are found in one task, and how often a task's share of more edges is cut to a forest before rounds begin.
FEW, CUTS = 250_000, 4
#: Mean boxes beside each other that a box may span and still be spelled out into cells.
MAX_CELLS = 8
KEYS = ["job_id", "place"]
#: Width of a cell in gaps: two cells side by side are less than a gap wide. Beyond so many cells from 0 a coordinate is too rough for that.
CELL, FARTHEST = 0.49, float(2**45)


def _keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each end of the edges that came by, but the least of its component, and that least one."""
    up: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if kind is not None:
        ends = [x for x in up if up[x] != x]
        yield pa.RecordBatch.from_arrays([pa.array(ends, kind.field(0).type), pa.array([root(x) for x in ends], kind.field(1).type)], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes (node): the least node of its component.

    Few edges are joined in one task. Of more, each task keeps a forest of its share, which joins the same nodes; if that does not make them few, rounds settle them.
    """
    kind = dict(nodes.dtypes)["node"]
    forest = lambda df: df.mapInArrow(_rooted, f"a {kind}, b {kind}")
    edges = checkpointed(edges.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = edges.count()
    for _ in range(CUTS):
        if n <= FEW:
            break
        edges = checkpointed(forest(edges.repartition(-(-n // FEW), "a")))
        n, before = edges.count(), n
        if n > before // 2:
            break
    if n > FEW:
        return _in_rounds(nodes, edges)
    labels = forest(edges.coalesce(1)).toDF("node", "least")
    return checkpointed(nodes.join(labels.hint("merge"), "node", "left").select("node", F.coalesce("least", "node").alias("label")))


def _in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """components of any number of edges. Least neighbouring labels and label jumps.

    A node's own label is an edge as well, so a round is one join and one aggregation: the least label beside a node or at its label, which never exceeds its own.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("a", "b"))
    labels = checkpointed(nodes.select("node", F.col("node").alias("label")))
    for _ in range(MAX_ROUNDS):
        asks = both.select("a", "b", F.lit(None).cast(labels.schema["label"].dataType).alias("own")).union(labels.select("node", "label", "label"))
        fresh = checkpointed(asks.join(labels.hint("merge"), asks["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("new"), F.max("own").alias("label")))
        labels = fresh.select(F.col("a").alias("node"), F.col("new").alias("label"))
        if fresh.where("new <> label").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _grid(points: DataFrame, gap: Column | float) -> DataFrame:
    """points with their cell (_cx, _cy) and the gap; a place that is not finite is a cell of its own, which _odd names."""
    g = points.where(F.col("px").isNotNull() & F.col("py").isNotNull()).withColumn("_gap", gap if isinstance(gap, Column) else F.lit(float(gap))).where("_gap is not null")
    q = [F.col(c) / (CELL * F.col("_gap")) for c in ("px", "py")]
    finite = (F.abs("px") < float("inf")) & (F.abs("py") < float("inf"))
    far = F.when(F.greatest(F.abs(q[0]), F.abs(q[1])) > FARTHEST, F.raise_error(F.lit("coordinates are too large for the gap between points"))).otherwise("")
    g = g.withColumn("_odd", F.when(finite, far.cast("string")).otherwise(F.concat_ws("|", F.col("px") + 0.0, F.col("py") + 0.0)))
    return g.withColumns({f"_c{a}": F.when(F.col("_odd") == "", F.floor(c)).otherwise(0).cast("long") for a, c in zip("xy", q, strict=True)})


def _beside(cells: DataFrame, keys: list[str], offsets: list[tuple[int, int]], here: list[str], there: list[str]) -> DataFrame:
    """Pairs of filled cells at these offsets: columns `here` of a cell, `there` of the one beside it with o_ before them."""
    d = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in offsets)))
    a = cells.withColumn("d", d).select(*keys, "d.dx", "d.dy", (F.col("_cx") + F.col("d.dx")).alias("_cx"), (F.col("_cy") + F.col("d.dy")).alias("_cy"), *here)
    return a.join(cells.select(*keys, "_cx", "_cy", *(F.col(c).alias(f"o_{c}") for c in there)).hint("merge"), [*keys, "_cx", "_cy"])


def _corners(met: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of cells that meet over a corner, if a point of one and a point of the other are near on both axes.

    Only a cell's points that no other point of it exceeds on both axes, towards the corner, can be needed.
    """
    pair = [*keys, "_cx", "_cy", "dx", "dy"]
    pts = grid.where("_odd = ''").select(*keys, "_cx", "_cy", "px", "py").distinct()
    up = F.signum(F.col("dy"))
    m = met.select(*pair, "a", "b", "_gap")
    first = m.withColumns({"_cx": F.col("_cx") - F.col("dx"), "_cy": F.col("_cy") - F.col("dy")}).join(pts.hint("merge"), [*keys, "_cx", "_cy"]).withColumns({"_cx": F.col("_cx") + F.col("dx"), "_cy": F.col("_cy") + F.col("dy")})
    other = m.select(*pair).join(pts.hint("merge"), [*keys, "_cx", "_cy"])
    front = lambda df, x, y: df.withColumn("most", F.max(y).over(Window.partitionBy(*pair).orderBy(x, F.desc(y)).rowsBetween(Window.unboundedPreceding, -1))).where(F.col("most").isNull() | (y > F.col("most"))).drop("most")
    near = front(first, F.desc("px"), F.col("py") * up).join(front(other, F.col("px").asc(), -F.col("py") * up).select(*pair, F.col("px").alias("ox"), F.col("py").alias("oy")).hint("merge"), pair)
    return near.where((F.abs(F.col("px") - F.col("ox")) <= F.col("_gap")) & (F.abs(F.col("py") - F.col("oy")) <= F.col("_gap"))).select("a", "b")


def clusters(points: DataFrame, gap: Column | float, links: DataFrame | None = None) -> DataFrame:
    """points (job_id, place, node, px, py; the keys if there) with the label of their cluster, inside a job and place; node is unique over all.

    Points no farther apart than gap on either axis belong together: a number, or a column that is the same for all points of a job and
    place. links (a, b): nodes that belong together whatever their distance.

    No pairs of points: cells are less than half a gap wide, so points of a cell and of the cells around it belong together. Filled cells on end are one
    run, runs side by side are joined. Cells two or three steps apart are near if their extents are, or, over a corner, if two of their outer points are.
    """
    grid, cells, at = _cells(points, gap, links)
    return grid.join(cells.select(*at, "label").hint("merge"), at).drop("_gap", "_cx", "_cy", "_odd")


def boxes_of_clusters(points: DataFrame, gap: Column | float, least: int = MIN_MEMBERS, group: list[str] | None = None) -> DataFrame:
    """cluster_boxes of clusters, from cells alone: no point is given its label. A point counts n times if points has that column.

    group: columns of points that belong together whatever their distance.
    """
    keys = _keys(points)
    _, cells, _ = _cells(points, gap, group=group)
    out = cells.groupBy(*keys, "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n"))
    return out.where(F.col("n") >= least).withColumnRenamed("label", "box")


def _cells(points: DataFrame, gap: Column | float, links: DataFrame | None = None, group: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points in the grid of clusters; its filled cells with the label, extent and number of their points; the key of a cell."""
    keys = _keys(points)
    grid = _grid(points, gap)
    at = [*keys, "_cx", "_cy", "_odd"]
    count = F.sum("n") if "n" in points.columns else F.count("*")
    cells = grid.groupBy(*at).agg(count.alias("n"), F.min("node").alias("node"), F.first("_gap").alias("_gap"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    column = Window.partitionBy(*keys, "_odd", "_cx").orderBy("_cy")
    opens = F.coalesce(F.col("_cy") - F.lag("_cy").over(column) > 1, F.lit(True))
    cells = cells.withColumn("opens", opens).withColumn("_run", F.sum(F.col("opens").cast("long")).over(column))
    cells = checkpointed(cells.withColumn("run", F.min("node").over(Window.partitionBy(*keys, "_odd", "_cx", "_run"))).drop("opens", "_run", "node"))
    even = cells.where("_odd = ''")
    pairs = _beside(even, keys, [(1, -1), (1, 0), (1, 1)], ["run"], ["run"]).select(F.col("run").alias("a"), F.col("o_run").alias("b")).distinct()
    if links is not None:
        heads = grid.select(*at, "node").join(cells.select(*at, "run").hint("merge"), at).select("node", "run")
        ends = links.join(heads.select(F.col("node").alias("a"), F.col("run").alias("ra")).hint("merge"), "a").join(heads.select(F.col("node").alias("b"), F.col("run").alias("rb")).hint("merge"), "b")
        pairs = pairs.union(ends.where("ra <> rb").select("ra", "rb").distinct())
    if group is not None:
        there = " and ".join(f"{c} is not null" for c in group)
        held = grid.where(there).select(*at, *(c for c in group if c not in at)).distinct().join(cells.select(*at, "run").hint("merge"), at).select(*group, "run").distinct()
        first = F.min("run").over(Window.partitionBy(*group))
        pairs = pairs.union(held.select(first.alias("a"), F.col("run").alias("b")).where("a <> b").distinct())
    labels = components(cells.select(F.col("run").alias("node")).distinct(), pairs)
    cells = checkpointed(cells.join(labels.withColumnRenamed("node", "run").hint("merge"), "run").drop("run"))
    # What is not joined yet, but may be near.
    ring = [(i, j) for i in range(4) for j in range(-3, 4) if max(i, abs(j)) > 1 and (i or j > 0)]
    c = F.col
    met = _beside(cells.where("_odd = ''"), keys, ring, ["_gap", "label", "x1", "y0", "y1"], ["label", "x0", "y0", "y1"])
    beside = (c("dx") < 2) | (c("o_x0") - c("x1") <= c("_gap"))
    level = F.when(c("dy") > 1, c("o_y0") - c("y1") <= c("_gap")).when(c("dy") < -1, c("y0") - c("o_y1") <= c("_gap")).otherwise(True)
    met = checkpointed(met.where(c("label") != c("o_label")).where(beside & level).select(*keys, "_cx", "_cy", "dx", "dy", "_gap", F.least("label", "o_label").alias("a"), F.greatest("label", "o_label").alias("b")))
    over = (c("dx") > 1) & (F.abs("dy") > 1)
    sure = met.where(~over).select("a", "b").distinct()
    apart = met.where(over).join(sure.hint("merge"), ["a", "b"], "left_anti")
    # Points are read again only if cells meet over corners.
    pairs = checkpointed(sure if met.where(over).isEmpty() else sure.union(_corners(apart, grid, keys)).distinct())
    if not pairs.isEmpty():
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        joined = components(ends, pairs).select(F.col("node").alias("label"), F.col("label").alias("least"))
        cells = cells.join(joined.hint("merge"), "label", "left").withColumn("label", F.coalesce("least", "label")).drop("least")
    return grid, cells, at


def cluster_boxes(clustered: DataFrame, least: int = MIN_MEMBERS) -> DataFrame:
    out = clustered.groupBy(*_keys(clustered), "label").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least).withColumnRenamed("label", "box")


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """Overlapping boxes of a job and place become one, until none overlap: each round at least halves what overlaps."""
    keys = _keys(boxes)
    for _ in range(MAX_ROUNDS):
        boxes = checkpointed(boxes.select(*keys, "box", "x0", "y0", "x1", "y1", "n"))
        # Boxes meet in the cells of a grid as wide as the mean box, in which a box stands in about four; those far wider meet all of their job and place.
        side = boxes.groupBy(*keys).agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0")), F.lit(1e-9)).alias("size"))
        sized = boxes.join(side, keys) if keys else boxes.join(F.broadcast(side), F.lit(True))  # one row
        sized = sized.withColumn("wide", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > MAX_CELLS * F.col("size"))
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("size")).cast("long"), F.floor(F.col(hi) / F.col("size")).cast("long")))
        a = sized.where("not wide").withColumn("cx", span("x0", "x1")).withColumn("cy", span("y0", "y1")).drop("size", "n", "wide")
        other = lambda df: df.select(*keys, *(c for c in ("cx", "cy") if c in df.columns), *(F.col(c).alias(f"o_{c}") for c in ("box", "x0", "y0", "x1", "y1")))
        hit = (F.col("x0") <= F.col("o_x1")) & (F.col("o_x0") <= F.col("x1")) & (F.col("y0") <= F.col("o_y1")) & (F.col("o_y0") <= F.col("y1"))
        ends = lambda df: df.where(hit & (F.col("box") != F.col("o_box"))).select(F.least("box", "o_box").alias("a"), F.greatest("box", "o_box").alias("b"))
        wide, every = sized.where("wide").select(*keys, "box", "x0", "y0", "x1", "y1"), other(boxes)
        far = wide.join(every, keys) if keys else wide.join(every, F.lit(True))
        pairs = checkpointed(ends(a.join(other(a), [*keys, "cx", "cy"])).union(ends(far)).distinct())
        if pairs.isEmpty():
            return boxes
        labels = components(boxes.select(F.col("box").alias("node")), pairs)
        boxes = boxes.join(labels, boxes["box"] == labels["node"]).groupBy(*keys, "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n")).withColumnRenamed("label", "box")
    raise RuntimeError(f"boxes did not settle in {MAX_ROUNDS} rounds")


def at_ranks(rows: DataFrame, keys: list[str], column: str, **ranks: Callable[[Column], Column]) -> DataFrame:
    """(keys, total, one column a rank): the values of a column that stand at these places of its order, from 1; ranks follow from the number of rows.

    Equal values are counted before they are sorted, so a group's rows never meet. A row counts n times if rows has that column.
    """
    counts = rows.groupBy(*keys, F.col(column).alias("value")).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("of"))
    total = counts.groupBy(*keys).agg(F.sum("of").alias("total"))
    upto = F.sum("of").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    z = counts.withColumn("upto", upto).join(total, keys)
    out = z.groupBy(*keys, "total").agg(*(F.min(F.when(F.col("upto") >= rank(F.col("total")), F.struct("upto", "value"))).alias(name) for name, rank in ranks.items()))
    return out.select(*keys, "total", *(F.col(f"{name}.value").alias(name) for name in ranks))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def sheet_gap(items: DataFrame, extent: DataFrame) -> DataFrame:
    """(job_id, place, gap): how far apart texts of one sheet may stand: 25 upper-median heights, or 1.5 % of the trimmed extent if that is more."""
    h = at_ranks(items, KEYS, "height", h=upper_middle)
    return h.join(extent, KEYS).select(*KEYS, F.greatest(25 * F.col("h"), 0.015 * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("gap"))


def text_extent(items: DataFrame, trim: float = 0.02, padding: float = 0.0) -> DataFrame:
    """(job_id, place, x0, y0, x1, y1): where texts stand, the outermost share `trim` at each end left out; padding in shares of the extent."""
    out = None
    for axis in ("x", "y"):
        ends = at_ranks(items, KEYS, axis, lo=lambda n: F.least(F.floor(n * trim) + 1, n), hi=lambda n: F.greatest(F.floor(n * (1 - trim)), F.lit(1)))
        pad = padding * (F.col("hi") - F.col("lo"))
        ends = ends.select(*KEYS, (F.col("lo") - pad).alias(f"{axis}0"), (F.col("hi") + pad).alias(f"{axis}1"))
        out = ends if out is None else out.join(ends, KEYS)
    return out.select(*KEYS, "x0", "y0", "x1", "y1")


def frame_gap(vertices: DataFrame, min_size: float) -> DataFrame:
    """(job_id, place, gap): half the least frame, or 1 % of the span of all vertices if that is more."""
    g = vertices.groupBy(*KEYS).agg(F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("span"))
    return g.select(*KEYS, F.greatest(F.lit(0.5 * min_size), 0.01 * F.col("span")).alias("gap"))


def frames_by_layer(vertices: DataFrame, min_size: float = 5000.0) -> DataFrame:
    """(job_id, place, box, x0, y0, x1, y1, n) of frames drawn as lines: vertices (job_id, place, entity, node, px, py) on frame layers.

    Vertices of an entity belong together, and those that are near each other; components of min_size both ways are frames.
    """
    gapped = vertices.join(frame_gap(vertices, min_size), KEYS)
    boxes = boxes_of_clusters(gapped, F.col("gap"), 1, ["job_id", "entity"])
    return boxes.where((F.col("x1") - F.col("x0") >= min_size) & (F.col("y1") - F.col("y0") >= min_size))


def on_frame_layer(layer: Column) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in X.FRAME_WORDS)), lambda w: F.contains(F.lower(layer), w))
