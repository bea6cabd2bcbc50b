"""Range joins on drawings: neighbours on a row, rules beside a text, clear space below, sheets beside sheets, points in boxes.

What asks for the nearest thing compares a place of a drawing at once, in one task, as long as the place is small: its rows are moved one
time and nothing is multiplied. In larger ones it does not pair up with all that meet it, as their number grows with the square of what
stands there: `best_met` sorts both sides along one axis inside the nodes of a binary tree over the other. Points in boxes
meet in the cells of a grid. Keys of a job keep every join inside one drawing set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import measure as M
from sheetloom.sources.stages import checkpointed

KEYS = ["job_id", "place"]
MEASURED = ["TEXT", "ATTRIB", "MTEXT", "PDF"]


#: A group of rows is compared at once up to so many comparisons a row, and so many rows; a block of comparisons is so large.
AT_ONCE, MOST_ROWS, BLOCK = 4096, 1 << 18, 1 << 20
#: Places of rules that are sent to every task.
SENT = 10_000

OPTIONAL = {"width_factor": 1.0, "rotation": 0.0, "vertical": False, "halign": 0, "ax": 0.0}


def measured(items: DataFrame, *carried: str | Column) -> DataFrame:
    """Geometry alone, with own_w and em: widths come from the letters of whole texts, so they are measured once and kept as a table. carried: what else to keep."""
    if "own_w" in items.columns:
        return items
    for name, value in OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(value))
    wide = items.select(*KEYS, "handle", "kind", "height", "x", "y", *OPTIONAL, *carried, M.em_width(F.col("plain")).alias("em"))
    own = F.col("em") * F.col("height") * F.when(F.coalesce("width_factor", F.lit(0.0)) > 0, F.col("width_factor")).otherwise(1.0)
    return checkpointed(wide.withColumn("own_w", own))


def placed(items: DataFrame) -> DataFrame:
    """Adds w (at least the height), l and r (edges), and the optional columns that are missing."""
    for name, value in OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(value))
    if "own_w" not in items.columns:
        items = items.withColumn("own_w", M.rendered_width(F.col("plain"), F.col("height"), F.col("width_factor")))
    out = items.withColumn("w", F.greatest("own_w", "height"))
    return out.withColumn("l", M.left_edge(F.col("x"), F.col("ax"), F.col("w"), F.col("halign"))).withColumn("r", F.col("l") + F.col("w"))


def _cells(lo: Column, hi: Column, size: Column | float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")))


def _sizes(items: DataFrame, times: float) -> DataFrame:
    """(job_id, place, size): cell sizes from the tallest text of a place, so one odd text widens the cells of its place alone."""
    return items.groupBy(*KEYS).agg((F.max("height") * times).alias("size"))


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    new = np.zeros(len(table), dtype=bool)
    for k in keys:
        codes = pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[:1] = True
    return np.append(np.flatnonzero(new), len(table))


def _at_once(rows: DataFrame, keys: list[str], keep: list[str], numbers: list[str], asks: str, run: Callable[..., tuple], results: list[str]) -> DataFrame:
    """(keep, results): rows dealt by their keys; run gets the numbers of one group, a dictionary of arrays, and gives rows of it and their results.

    Groups stream by in order, so a task holds a batch and a group.
    """
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not len(rest):
                continue
            ends = _groups(rest, keys)
            # The last group may go on in the next batch.
            whole = ends if batch is None else ends[:-1]
            columns = {c: rest.column(c).to_numpy() for c in (*numbers, asks)}
            found = [(at + z[0], *z[1:]) for at, to in zip(whole[:-1].tolist(), whole[1:].tolist(), strict=True) for z in [run({c: x[at:to] for c, x in columns.items()})] if len(z[0])]
            if found:
                rows_, *values = (np.concatenate(x) for x in zip(*found, strict=True))
                out = rest.select(keep).take(pa.array(rows_))
                for name, x in zip(results, values, strict=True):
                    out = out.append_column(name, pa.array(x, pa.float64(), from_pandas=True))
                yield from out.combine_chunks().to_batches()
            rest = rest.slice(whole[-1])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(fold, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}` double" for c in results)]))


def _split(rows: DataFrame, keys: list[str], cost: Column) -> DataFrame | None:
    """Keys of the groups that are too large to be compared at once; none: nothing."""
    large = checkpointed(rows.groupBy(*keys).agg(cost.alias("large")).where("large").select(*keys))
    return None if large.isEmpty() else F.broadcast(large)  # less than a row in AT_ONCE


def _meeting(closed: bool, strict: bool) -> Callable[[dict], tuple]:
    def run(v: dict) -> tuple:
        q, p = np.flatnonzero(v["asks"]), np.flatnonzero(~v["asks"])
        if not len(q) or not len(p):
            return q[:0], v["at"][:0]
        # The best first: the first that is met is the best.
        p = p[np.argsort(-v["value"][p], kind="stable")]
        lo, hi, at, value = (v[c][p] for c in ("lo", "hi", "at", "value"))
        first = np.empty(len(q), dtype=np.int64)
        met = np.empty(len(q), dtype=bool)
        step = max(1, BLOCK // len(p))
        for i in range(0, len(q), step):
            l, h, t = (v[c][q[i : i + step], None] for c in ("lo", "hi", "at"))
            m = (at < t) if strict else (at <= t)
            m &= (lo <= h) if closed else (lo < h)
            m &= (hi >= l) if closed else (hi > l)
            n = m.argmax(axis=1)
            first[i : i + step], met[i : i + step] = n, m[np.arange(len(n)), n]
        return q[met], value[first[met]]

    return run


def best_met(a: DataFrame, b: DataFrame, keys: list[str], closed: bool, strict: bool, best: Callable[[str], Column] = F.max, of: list[str] | None = None) -> DataFrame:
    """(keys, lo, hi, at, best) for the distinct rows of a (keys, lo, hi, at): the best value of the rows of b (keys, lo, hi, at, value) with the same
    keys whose stretch meets theirs and that come before them: b.at < a.at, or <= if not strict. Rows that nothing meets are left out.
    of: columns of a that come along; then each of its rows has one.

    Small groups are compared at once if the greatest number is best; the others by a tree.
    """
    stretch = ["lo", "hi", "at"]
    there = " and ".join(f"{c} is not null" for c in [*keys, *stretch])
    a, b = a.where(there), b.where(there)
    keep = [*keys, *(of or []), *stretch]
    if best is not F.max or any(dict(df.dtypes)[c] != "double" for df, cs in ((a, stretch), (b, [*stretch, "value"])) for c in cs):
        found = _met_by_tree(a, b, keys, closed, strict, best)
        return a.select(*keep).join(found, [*keys, *stretch]).select(*keep, "best") if of else found
    q = a.select(*keep, F.lit(None).cast("double").alias("value"), F.lit(True).alias("asks"))
    if not of:
        q = q.distinct()
    p = b.where("value is not null").select(*keys, *(F.lit(None).cast(dict(a.dtypes)[c]).alias(c) for c in of or []), *stretch, "value", F.lit(False).alias("asks"))
    both = q.unionByName(p)
    nq, np_, n = F.count_if("asks").cast("double"), F.count_if(~F.col("asks")).cast("double"), F.count("*")
    odd = F.coalesce(F.bool_or(F.isnan("lo") | F.isnan("hi") | F.isnan("at") | F.isnan("value")), F.lit(False))
    large = _split(both, keys, odd | (n > MOST_ROWS) | (nq * np_ > AT_ONCE * n))
    rest = both if large is None else both.join(large, keys, "left_anti")
    out = _at_once(rest, keys, keep, [*stretch, "value"], "asks", _meeting(closed, strict), ["best"])
    if large is None:
        return out
    a, b = (df.join(large, keys, "left_semi") for df in (a, b))
    found = _met_by_tree(a, b, keys, closed, strict, best)
    return out.unionByName(a.select(*keep).join(found, [*keys, *stretch]).select(*keep, "best") if of else found)


def _met_by_tree(a: DataFrame, b: DataFrame, keys: list[str], closed: bool, strict: bool, best: Callable[[str], Column] = F.max) -> DataFrame:
    """best_met in groups of any size.

    Stretches with common ends alone meet only if closed; otherwise those of a must not be empty. Two stretches meet either where b begins behind
    the beginning of a and inside it, or where a begins inside b. Both are points in ranges of ranks: a range is made of at most two nodes a level
    of a binary tree, a point lies in one node a level. Inside a node all pairs meet, so what is best so far in the order of `at` is a
    running aggregate. The rows grow with n log n, whatever lies on top of each other.
    """
    q = a.select(*keys, "lo", "hi", "at").distinct()
    # Of stretches that begin at one end with the same value, the longest one meets all that the others meet.
    p = b.groupBy(*keys, "lo", "at", "value").agg(F.max("hi").alias("hi"))
    ends = lambda df: df.select(*keys, F.explode(F.array("lo", "hi")).alias("c"))
    of = Window.partitionBy(*keys)
    coords = ends(q).union(ends(p)).distinct()
    ranks = checkpointed(coords.select(*keys, "c", (F.row_number().over(of.orderBy("c")) - 1).cast("long").alias("rank"), F.ceil(F.log2(F.count("*").over(of))).cast("int").alias("levels")))
    of_lo, of_hi = ranks.select(*keys, F.col("c").alias("lo"), F.col("rank").alias("r0"), "levels"), ranks.select(*keys, F.col("c").alias("hi"), F.col("rank").alias("r1"))
    q, p = (df.join(of_lo, [*keys, "lo"]).join(of_hi, [*keys, "hi"]) for df in (q, p))
    last = 0 if closed else 1

    def points(df: DataFrame) -> DataFrame:
        return df.withColumn("level", F.explode(F.sequence(F.lit(0), "levels"))).withColumn("node", F.expr("shiftright(r0, level)"))

    def ranges(df: DataFrame, begin: str) -> DataFrame:
        z = df.withColumns({"i": F.expr(begin).cast("long"), "j": F.col("r1") - last}).where("i <= j")
        z = z.withColumn("level", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("j") - F.col("i") + 1)).cast("int"))))
        z = z.withColumns({"i": F.expr("shiftright(i + shiftleft(1L, level) - 1, level)"), "j": F.expr("shiftright(j + 1, level) - 1")}).where("i <= j")
        # Whole nodes whose parents are not whole.
        return z.withColumn("node", F.explode(F.array(F.when(F.col("i") % 2 == 1, F.col("i")), F.when(F.col("j") % 2 == 0, F.col("j"))))).where("node is not null")

    first, then = (0, 1) if strict else (1, 0)
    asking = lambda df, kind: df.select(*keys, F.lit(kind).alias("kind"), "level", "node", "at", F.lit(first).alias("turn"), "lo", "hi", F.lit(None).cast(dict(b.dtypes)["value"]).alias("value"))
    none = F.lit(None).cast("double")
    # Of the values at one place of a node only the best counts.
    giving = lambda df, kind: df.groupBy(*keys, "level", "node", "at").agg(best("value").alias("value")).select(*keys, F.lit(kind).alias("kind"), "level", "node", "at", F.lit(then).alias("turn"), none.alias("lo"), none.alias("hi"), "value")
    rows = asking(ranges(q, "r0 + 1"), 0).union(asking(points(q), 1)).union(giving(points(p), 0)).union(giving(ranges(p, "r0"), 1))
    so_far = Window.partitionBy(*keys, "kind", "level", "node").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("best", best("value").over(so_far)).where((F.col("turn") == first) & F.col("best").isNotNull())
    return found.groupBy(*keys, "lo", "hi", "at").agg(best("best").alias("best"))


def neighbours(items: DataFrame) -> DataFrame:
    """(job_id, place, handle, gap_r, gap_l): distance to the nearest text on the same row, from edge to edge; null: none in reach. No row: neither."""
    p = placed(measured(items)).where((F.col("height") > 0) & F.col("kind").isin(MEASURED) & M.is_flat(F.col("rotation"), F.lit(False)) & F.col("job_id").isNotNull() & F.col("place").isNotNull())
    rows = p.select(*KEYS, "handle", "y", F.col("height").alias("h"), "l", "r", F.greatest(6 * F.col("w"), 60 * F.col("height")).alias("reach"), M.is_flat(F.col("rotation"), F.col("vertical")).alias("asks"))
    rows = rows.select(*KEYS, "handle", *(F.col(c).cast("double").alias(c) for c in ("y", "h", "l", "r", "reach")), "asks")
    large = _split(rows, KEYS, F.count("*") > AT_ONCE)
    rest = rows if large is None else rows.join(large, KEYS, "left_anti")
    out = _at_once(rest, KEYS, [*KEYS, "handle"], ["y", "h", "l", "r", "reach"], "asks", _gaps, ["gap_r", "gap_l"])
    # A handle that stands twice in a place has the least of its gaps; rows of a place are in one task, so few move.
    if large is not None:
        out = out.unionByName(_neighbours_in_rows(p.join(large, KEYS, "left_semi")))
    return out.groupBy(*KEYS, "handle").agg(F.min("gap_r").alias("gap_r"), F.min("gap_l").alias("gap_l"))


def _gaps(v: dict) -> tuple:
    """Rows of a place that have a neighbour, and its distance to the right and to the left."""
    by = np.argsort(v["y"], kind="stable")
    q = by[v["asks"][by]]
    oy, oh, ol, or_ = (v[c][by] for c in ("y", "h", "l", "r"))
    out = np.full((2, len(q)), np.nan)
    step = max(1, min(256, BLOCK // len(by)))
    for i in range(0, len(q), step):
        at = q[i : i + step]
        y, h, l, r, reach = (v[c][at, None] for c in ("y", "h", "l", "r", "reach"))
        # Bases lie no more than three heights apart; one height more for what rounding takes.
        far = 4 * h.max()
        j, k = np.searchsorted(oy, [y[0, 0] - far, y[-1, 0] + far])
        dy = np.abs(oy[j:k] - y)
        row = (dy <= 3 * h) & (dy < 0.7 * np.maximum(h, oh[j:k]))
        for n, d in enumerate((ol[j:k] - l, r - or_[j:k])):
            near = np.where(row & (d >= 0.5 * h) & (d <= reach), d, np.inf).min(axis=1, initial=np.inf)
            out[n, i : i + step] = np.where(np.isinf(near), np.nan, near)
    some = ~np.isnan(out).all(axis=0)
    return q[some], out[0, some], out[1, some]


def _neighbours_in_rows(p: DataFrame) -> DataFrame:
    """neighbours in places of any size: p are placed texts.

    Heights and bases make rows; rows that lie beside each other meet as rows. In each, the nearest edge at least half a height away comes next
    in a sorted order. To the left is to the right with all signs turned.
    """
    sides = lambda df, edge: df.withColumn("z", F.explode(F.array(F.struct(F.lit("r").alias("side"), F.col("l").alias(edge)), F.struct(F.lit("l").alias("side"), (-F.col("r")).alias(edge)))))
    a = p.where(M.is_flat(F.col("rotation"), F.col("vertical"))).select(*KEYS, "handle", "y", F.col("height").alias("h"), "l", "r", F.greatest(6 * F.col("w"), 60 * F.col("height")).alias("reach"))
    b = p.where(M.is_flat(F.col("rotation"), F.lit(False))).select(*KEYS, F.col("y").alias("oy"), F.col("height").alias("oh"), "l", "r")
    sizes = _sizes(p, 3.0)
    rows_a = a.select(*KEYS, "y", "h").distinct().join(sizes, KEYS).withColumn("cell", _cells(F.col("y") - F.col("size"), F.col("y") + F.col("size"), F.col("size"))).drop("size")
    rows_b = b.select(*KEYS, "oy", "oh").distinct().join(sizes, KEYS).withColumn("cell", F.floor(F.col("oy") / F.col("size")).cast("long")).drop("size")
    dy = F.abs(F.col("oy") - F.col("y"))
    beside = rows_a.join(rows_b, [*KEYS, "cell"]).where((dy <= 3 * F.col("h")) & (dy < 0.7 * F.greatest("h", "oh"))).drop("cell").distinct()
    beside = checkpointed(beside)
    row = [*KEYS, "y", "h", "side"]
    asking = sides(a, "edge").select(*KEYS, "y", "h", "z.side", "z.edge", "reach").distinct()
    # All edges that a row of texts may meet, each once, whichever rows they are in.
    edges = sides(b, "edge").select(*KEYS, "oy", "oh", "z.side", "z.edge").distinct().join(beside, [*KEYS, "oy", "oh"]).select(*row, "edge").distinct()
    # A difference is rounded, so the first edge found may be too near by a last digit; then one of the next two is it.
    next_ = lambda n: F.lead("edge", n).over(Window.partitionBy(*row).orderBy("edge"))
    edges = edges.select(*row, F.col("edge").alias("at"), F.col("edge").alias("e"), next_(1).alias("n1"), next_(2).alias("n2"), F.lit(None).cast("double").alias("edge"), F.lit(None).cast("double").alias("reach"))
    near = F.col("edge") + 0.5 * F.col("h")
    none = F.lit(None).cast("double")
    asked = asking.select(*row, (near - 1e-15 * (F.abs("edge") + F.col("h"))).alias("at"), none.alias("e"), none.alias("n1"), none.alias("n2"), "edge", "reach")
    # The last edge so far, from the far end: edges that stand where the search begins come before it.
    onward = Window.partitionBy(*row).orderBy(F.desc("at"), F.col("e").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    held = lambda c: F.last(F.when(F.col("e").isNotNull(), F.struct("e", "n1", "n2")), ignorenulls=True).over(onward)[c].alias(f"v_{c}")
    got = asked.unionByName(edges).select("*", *(held(c) for c in ("e", "n1", "n2"))).where(F.col("edge").isNotNull() & F.col("v_e").isNotNull())
    d = lambda c: F.when(F.col(c) - F.col("edge") >= 0.5 * F.col("h"), F.col(c) - F.col("edge"))
    gap = got.withColumn("d", F.coalesce(d("v_e"), d("v_n1"), d("v_n2"))).where("d <= reach").select(*row, "edge", "reach", "d")
    every = sides(a, "edge").select(*KEYS, "handle", "y", "h", "z.side", "z.edge", "reach").join(gap, [*KEYS, "y", "h", "side", "edge", "reach"])
    return every.groupBy(*KEYS, "handle").agg(*(F.min(F.when(F.col("side") == s, F.col("d"))).alias(f"gap_{s}") for s in "rl"))


def wall_gaps(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(job_id, place, handle, crosses, wall_r, wall_l): rules through the text, and the nearest beside it where none is. No row: no rule at its height."""
    rules = checkpointed(rules.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in ("pos", "lo", "hi"))).distinct())
    # Texts of a place without rules go before anything is measured or moved.
    ruled = checkpointed(rules.select(*KEYS).distinct())
    items = items.join(F.broadcast(ruled) if ruled.count() <= SENT else ruled, KEYS, "left_semi")
    p = placed(measured(items)).where((F.col("height") > 0) & F.col("kind").isin(MEASURED) & M.is_flat(F.col("rotation"), F.col("vertical")))
    h = F.col("height")
    inner, outer = F.col("l") + 0.3 * h, F.col("r") - 0.3 * h
    a = p.select(*KEYS, "handle", "l", "r", (F.col("y") - 0.2 * h).alias("lo"), (F.col("y") + 1.2 * h).alias("hi"), F.greatest(6 * F.col("w"), 60 * h).alias("reach"), inner.alias("inner"), outer.alias("outer"))
    keys = [*KEYS, "side"]
    # The first rule from inner on, the first from outer on: with signs turned, the last up to there. The last rule before inner.
    after = lambda df, side, at: df.withColumns({"side": F.lit(side), "at": at})
    asked = after(a, "cross", -F.col("inner")).unionByName(after(a, "r", -F.col("outer")))
    back = after(a, "l", F.col("inner"))
    r = rules.select(*KEYS, "pos", "lo", "hi")
    right = after(r, "cross", -F.col("pos")).unionByName(after(r, "r", -F.col("pos"))).withColumn("value", F.col("at"))
    of = ["handle", "l", "r", "reach", "outer"]
    met = best_met(asked, right, keys, closed=True, strict=False, of=of).unionByName(best_met(back, after(r, "l", F.col("pos")).withColumn("value", F.col("pos")), keys, closed=True, strict=True, of=of))
    per = met.groupBy(*KEYS, "handle").agg(*(F.first(c).alias(c) for c in ("l", "r", "reach", "outer")), *(F.max(F.when(F.col("side") == s, F.when(F.lit(s == "l"), F.col("best")).otherwise(-F.col("best")))).alias(f"at_{s}") for s in ("cross", "r", "l")))
    crosses = F.coalesce(F.col("at_cross") < F.col("outer"), F.lit(False))
    in_reach = lambda d: F.when(~F.col("crosses") & (d <= F.col("reach")), d)
    return per.withColumn("crosses", crosses).select(*KEYS, "handle", "crosses", in_reach(F.col("at_r") - F.col("l")).alias("wall_r"), in_reach(F.col("r") - F.col("at_l")).alias("wall_l"))


def available_widths(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(job_id, place, handle, avail): room of a flat text up to its neighbour or cell wall; no row: nothing limits it."""
    items = measured(items)
    p = placed(items).select(*KEYS, "handle", "halign", "w", "height")
    both = p.join(neighbours(items), [*KEYS, "handle"], "left").join(wall_gaps(items, rules), [*KEYS, "handle"], "left")
    r, l, m = F.least("gap_r", "wall_r"), F.least("gap_l", "wall_l"), 0.3 * F.col("height")
    room = F.when(F.col("halign").isin(1, 4), F.col("w") + 2 * (F.least(r, l) - m)).when(F.col("halign") == 2, F.col("w") + l - m).otherwise(r - m)
    return both.select(*KEYS, "handle", F.when(room.isNotNull(), F.greatest(room, F.col("w"))).alias("avail")).where("avail is not null")


def room_below(items: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """(job_id, place, handle, clear): clear height under a text, to the next text or rule that shares some of its width."""
    p = placed(measured(items))
    lo, hi = F.col("x").alias("lo"), (F.col("x") + F.col("own_w")).alias("hi")
    a = p.where(M.is_flat(F.col("rotation"), F.col("vertical")) & (F.col("height") > 0) & (F.col("own_w") > 0)).select(*KEYS, "handle", "y", lo, hi, (F.col("y") - 1e-9).alias("at"))
    b = p.select(*KEYS, lo, hi, F.col("y").alias("at"), (F.col("y") + F.col("height")).alias("value"))
    if floors is not None:
        b = b.unionByName(floors.select(*KEYS, "lo", "hi", F.col("pos").alias("at"), (F.col("pos") + F.lit(0.0)).alias("value")))
    top = best_met(a, b, KEYS, closed=False, strict=True, of=["handle", "y"])
    return top.groupBy(*KEYS, "handle").agg(F.first("y").alias("y"), F.max("best").alias("top")).select(*KEYS, "handle", F.greatest(F.col("y") - F.col("top"), F.lit(0.0)).alias("clear"))


def _jobs(df: DataFrame) -> list[str]:
    return ["job_id"] if "job_id" in df.columns else []


def in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (px, py, …) with the boxes (box, x0, y0, x1, y1) of their job that hold them, through cells of the job's mean box size."""
    keys = _jobs(boxes)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    size = boxes.groupBy(*keys).agg(F.greatest(F.avg(side), F.lit(1e-9)).alias("size"))
    sized = lambda df: df.join(size, keys) if keys else df.join(F.broadcast(size), F.lit(True))  # noqa: E731  one row
    b = sized(boxes).withColumn("wide", side > 8 * F.col("size"))
    near = b.where("not wide").withColumn("cx", _cells(F.col("x0"), F.col("x1"), F.col("size"))).withColumn("cy", _cells(F.col("y0"), F.col("y1"), F.col("size"))).drop("size", "wide")
    a = sized(points).withColumn("cx", F.floor(F.col("px") / F.col("size")).cast("long")).withColumn("cy", F.floor(F.col("py") / F.col("size")).cast("long")).drop("size")
    holds = (F.col("px") >= F.col("x0")) & (F.col("px") <= F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") <= F.col("y1"))
    # A box far wider than the others meets the points of its job, instead of being spelled out into cells without bound.
    wide = b.where("wide").drop("size", "wide")
    far = points.join(wide, keys) if keys else points.join(wide, F.lit(True))
    return a.join(near, [*keys, "cx", "cy"]).drop("cx", "cy").where(holds).unionByName(far.where(holds))


def sheet_numbers(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box, number): the text shaped like a sheet number that lies farthest to the lower right; ties to the earlier."""
    from sheetloom.functions.text import SHEET_NUMBER

    found = items.where(F.col("plain").rlike(SHEET_NUMBER)).select(*_jobs(boxes), F.col("x").alias("px"), F.col("y").alias("py"), "ord", F.concat(F.regexp_extract("plain", SHEET_NUMBER, 1), F.lit("-"), F.regexp_extract("plain", SHEET_NUMBER, 2)).alias("number"))
    score = (F.col("px") - F.col("x0")) / (F.col("x1") - F.col("x0")) - (F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return in_boxes(found, boxes).groupBy(*_jobs(boxes), "box").agg(F.max_by("number", F.struct(score, -F.col("ord"))).alias("number"))


def side_gaps(boxes: DataFrame) -> DataFrame:
    """(box, right, left, above, below): distance to the nearest box that overlaps or touches on the other axis; null: none."""
    keys = _jobs(boxes)
    by = [*keys, "side"]
    # Each side as if it were the right one: the stretch on the other axis, the box's own edge there, and where a box beside it begins. A flat box begins where it ends.
    side = lambda name, lo, hi, edge, start: F.struct(F.lit(name).alias("side"), F.col(lo).cast("double").alias("lo"), F.col(hi).cast("double").alias("hi"), edge.cast("double").alias("edge"), start.cast("double").alias("start"))
    c = F.col
    four = [side("right", "y0", "y1", c("x1"), c("x0")), side("left", "y0", "y1", -c("x0"), -c("x1")), side("above", "x0", "x1", c("y1"), c("y0")), side("below", "x0", "x1", -c("y0"), -c("y1"))]
    s = boxes.select(*keys, "box", F.explode(F.array(*four)).alias("z")).select(*keys, "box", "z.*")
    starts = s.select(*by, "lo", "hi", (-c("start")).alias("at"), (-c("start")).alias("value"))
    # A flat box must not find itself: it looks behind its edge here, and for another box that begins at its edge below.
    asked = s.withColumns({"flat": c("start") == c("edge"), "at": -c("edge")})
    ahead = best_met(asked.where("not flat"), starts, by, closed=True, strict=False).withColumn("flat", F.lit(False)).unionByName(best_met(asked.where("flat"), starts, by, closed=True, strict=True).withColumn("flat", F.lit(True)))
    there = [*by, "edge"]
    level = asked.where("flat").withColumn("at", F.lit(0.0))
    same = s.withColumn("edge", c("start")).join(level.select(*there).distinct(), there, "left_semi").select(*there, "lo", "hi", F.lit(0.0).alias("at"), c("box").alias("value"))
    ids = [best_met(level, same, there, closed=True, strict=False, best=f).withColumnRenamed("best", n).drop("at") for f, n in ((F.min, "least"), (F.max, "most"))]
    touched = level.join(ids[0], [*there, "lo", "hi"]).join(ids[1], [*there, "lo", "hi"]).where("least <> box or most <> box").select(*by, "box", F.lit(0.0).alias("gap"))
    gaps = asked.join(ahead, [*by, "lo", "hi", "at", "flat"]).select(*by, "box", (-c("best") - c("edge")).alias("gap")).unionByName(touched)
    near = gaps.groupBy(*keys, "box").agg(*(F.min(F.when(c("side") == n, c("gap"))).alias(n) for n in ("right", "left", "above", "below")))
    return boxes.select(*keys, "box").join(near, [*keys, "box"], "left")
