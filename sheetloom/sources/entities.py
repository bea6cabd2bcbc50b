"""Scans of drawing entities and page spans that a reader outside has extracted into tables (see schema.ENTITY, SPAN)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom import schema
from sheetloom.functions import text as X

from . import blocks

#: Types with a projection here, and types whose text cannot be reached.
HANDLED = ["TEXT", "MTEXT", "INSERT", "DIMENSION", "ARC_DIMENSION", "LARGE_RADIAL_DIMENSION", "ACAD_TABLE", "ATTDEF", "TOLERANCE", "MULTILEADER", "MLEADER"]
UNREACHABLE = ["ACAD_PROXY_ENTITY", "OLE2FRAME"]


def is_space_block(name: Column) -> Column:
    return F.upper(F.ltrim(name, F.lit("*$"))).rlike("^(MODEL_SPACE|PAPER_SPACE)")


#: Columns that an entity table may bring along, with what stands for them where it does not.
CARRIED = {"width_factor": 1.0, "rotation": 0.0, "box_width": None, "vertical": False, "halign": 0, "ax": None}


def _branches(e: DataFrame) -> list[DataFrame]:
    """One projection a type: (sub, kind, handle, raw, plain) beside what every item has."""
    base = ["job_id", "ord", F.col("space").alias("place"), "layer", "style", "height", "x", "y", *(c for c in CARRIED if c in e.columns)]
    item = lambda df, kind, handle, raw, plain, sub: df.select(*base, sub.alias("sub"), F.lit(kind).alias("kind"), handle.alias("handle"), raw.alias("raw"), plain.alias("plain"))
    text, none = F.coalesce("text", F.lit("")), F.lit(0)
    plain_dim = F.replace(text, F.lit("<>"), F.lit(" "))
    attribs = e.where("type = 'INSERT'").select("*", F.posexplode("attribs").alias("sub", "a"))
    # Blank cells keep their number, so the index is taken before the filter.
    cells = e.where("type = 'ACAD_TABLE'").select("*", F.posexplode("cells").alias("sub", "cell"))
    return [
        item(e.where("type = 'TEXT'"), "TEXT", F.col("handle"), text, text, none),
        item(e.where("type = 'MTEXT'"), "MTEXT", F.col("handle"), text, X.mtext_plain(text), none),
        item(attribs, "ATTRIB", F.concat_ws(":", "handle", "a.tag"), F.col("a.text"), F.col("a.text"), F.col("sub")),
        item(e.where(F.col("type").isin("DIMENSION", "ARC_DIMENSION", "LARGE_RADIAL_DIMENSION") & (text != "<>")), "DIMENSION", F.col("handle"), text, plain_dim, none),
        item(cells, "TABLE_CELL", F.concat_ws(":", "handle", F.col("sub").cast("string")), F.col("cell"), X.mtext_plain(F.col("cell")), F.col("sub")),
        item(e.where((F.col("type") == "ATTDEF") & (F.col("flags").bitwiseAND(2) != 0)), "ATTDEF", F.col("handle"), text, text, none),
        item(e.where("type = 'TOLERANCE'"), "TOLERANCE", F.col("handle"), text, text, none),
        item(e.where(F.col("type").isin("MULTILEADER", "MLEADER")), "MLEADER", F.col("handle"), text, X.mtext_plain(text), none),
    ]


def defects(e: DataFrame) -> Column:
    """array<string>: why an entity cannot be read, by what its type needs; empty if it can. Types without a projection need nothing.

    The tag reader leaves null what it could not read as a number and puts a note in `bad`, if the table has that column.
    """
    text, height = F.col("type").isin("TEXT", "MTEXT"), F.col("height")
    wrong = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = [
        F.when(F.col("handle").isNull() | (F.col("handle") == ""), "no handle"),
        F.when(text & (wrong(height) | (height < 0)), "height is not a number"),
        F.when(text & (wrong(F.col("x")) | wrong(F.col("y"))), "place is not a number"),
        F.when(F.col("type").isin("LINE", "LWPOLYLINE", "POLYLINE") & (F.coalesce(F.size("vertices"), F.lit(0)) < 2), "too few vertices"),
        F.when(F.col("type").isin("LINE", "LWPOLYLINE", "POLYLINE") & F.exists("vertices", lambda v: v.isNull() | wrong(v["x"]) | wrong(v["y"])), "vertex is not a number"),
        F.when((F.col("type") == "ACAD_TABLE") & F.col("cells").isNull(), "no cells"),
        F.when((F.col("type") == "ACAD_TABLE") & F.exists("cells", lambda c: c.isNull()), "cell without value"),
        F.when((F.col("type") == "INSERT") & F.exists("attribs", lambda a: a.isNull() | a["tag"].isNull()), "attribute without tag"),
    ]
    return F.array_compact(F.array(*found, *([F.col("bad")] if "bad" in e.columns else [])))


def items(entities: DataFrame, tolerant: bool = False) -> DataFrame:
    """Text items of all spaces in scan order: one branch a type, blanks and placeholders dropped, blocks of spaces left out.

    tolerant: an entity that cannot be read gives one row `[unreadable: reasons]` of its type, without language, in its place of
    the order, and never stops the scan; without it such entities give what they can.
    """
    e = entities.where(~is_space_block(F.regexp_replace("space", "^block:", "")))
    odd = None
    if tolerant:
        e = e.withColumn("defects", defects(e))
        odd, e = e.where(F.size("defects") > 0), e.where(F.size("defects") == 0)
    parts = _branches(e)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(X.strip(F.coalesce("raw", F.lit(""))) != "").withColumn("lang", X.detect_lang(F.when(F.col("kind") == "DIMENSION", F.col("raw")).otherwise(F.col("plain"))))
    # Rich text says its own width inside.
    own = F.when(F.col("kind").isin("MTEXT", "MLEADER"), X.mtext_width_factor(F.col("raw")))
    out = out.withColumn("width_factor", F.coalesce(own, "width_factor", F.lit(1.0)) if "width_factor" in entities.columns else F.coalesce(own, F.lit(1.0)))
    for name in set(CARRIED) & set(entities.columns) - {"width_factor"}:
        if CARRIED[name] is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(CARRIED[name])))
    if odd is None:
        return out
    said = F.concat(F.lit("[unreadable: "), F.array_join("defects", "; "), F.lit("]"))
    zero = {"height": F.lit(0.0), "x": F.lit(0.0), "y": F.lit(0.0), "width_factor": F.lit(1.0), "layer": F.lit(""), "style": F.lit(""), "raw": F.lit("")}
    bad = {"place": F.col("space"), "sub": F.lit(0), "kind": F.coalesce("type", F.lit("?")), "handle": F.coalesce("handle", F.lit("?")), "plain": said, "lang": F.lit("none")}
    return out.unionByName(odd.select(*((zero | bad).get(c, F.col(c) if c in odd.columns else F.lit(None)).cast(t).alias(c) for c, t in out.dtypes)))


def rule_lines(entities: DataFrame, vertical: bool = True, limit: int | None = None, levels: int = blocks.LEVELS, bases: DataFrame | None = None) -> DataFrame:
    """(job_id, place, pos, lo, hi): edges of lines within 1 % of upright (level), closing edges included.

    Lines inside blocks count in their own space, and wherever a reference puts them, through as many levels as said. All rules are kept
    unless there is a limit: then of a space that has `limit` rules the entities that follow are not read, as in a scan that stops there.
    """
    v = blocks.placed_shapes(entities, ["LINE", "LWPOLYLINE", "POLYLINE"], bases, levels)
    ring = F.when(F.col("closed"), F.concat("vertices", F.slice("vertices", 1, 1))).otherwise(F.col("vertices"))
    pairs = v.withColumn("ring", ring).select("job_id", "place", "ord", F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))).alias("e"))
    across, along = ("x", "y") if vertical else ("y", "x")
    a, b = F.col("e.a"), F.col("e.b")
    straight = F.abs(b[across] - a[across]) <= 0.01 * F.greatest(F.abs(b[along] - a[along]), F.lit(1e-9))
    out = pairs.where(straight).select("job_id", "place", "ord", a[across].alias("pos"), F.least(a[along], b[along]).alias("lo"), F.greatest(a[along], b[along]).alias("hi"))
    if limit is None:
        return out.drop("ord")
    before = F.rank().over(Window.partitionBy("job_id", "place").orderBy("ord"))
    return out.withColumn("before", before).where(F.col("before") <= limit).drop("before", "ord")


def frames_by_block(inserts: DataFrame, min_size: float = 5000.0) -> DataFrame:
    """Placed blocks (name, x0, y0, x1, y1) whose name holds a frame word and whose sides are long enough."""
    named = F.exists(F.array(*(F.lit(w) for w in X.FRAME_WORDS)), lambda w: F.contains(F.lower("name"), w))
    return inserts.where(named & (F.col("x1") - F.col("x0") >= min_size) & (F.col("y1") - F.col("y0") >= min_size))


def paper_layouts(entities: DataFrame) -> DataFrame:
    """Paper spaces with anything but viewports on them."""
    return entities.where("space like 'paper:%' and type <> 'VIEWPORT'").select("job_id", "space").distinct()


def linked_files(definitions: DataFrame, blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """Images and underlays, and external references without content: (path), sorted."""
    empty = blocks.join(entities.select("job_id", F.regexp_replace("space", "^block:", "").alias("name")).distinct(), ["job_id", "name"], "left_anti").select("path")
    return definitions.select("path").union(empty).where("path <> ''").distinct().orderBy("path")


def unreachable(entities: DataFrame) -> DataFrame:
    """(type, n, spaces): entities whose text cannot be reached, spaces in first-seen order."""
    g = entities.where(F.col("type").isin(UNREACHABLE)).groupBy("type").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "space"))), lambda z: z["space"])).alias("spaces"))
    return g.orderBy(F.desc("n"), "first").drop("first")


def uncollected(entities: DataFrame) -> DataFrame:
    """(type, n, spaces, sample): other types that carry a text after all."""
    e = entities.where(~F.col("type").isin([*HANDLED, *UNREACHABLE]) & (X.strip(F.coalesce("text", F.lit(""))) != ""))
    g = e.groupBy("type").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "space"))), lambda z: z["space"])).alias("spaces"), F.substring(F.min_by("text", "ord"), 1, 60).alias("sample"))
    return g.orderBy(F.desc("n"), "first").drop("first")


def cell_texts(tags: DataFrame) -> DataFrame:
    """(handle, cell, value) from a table's tag stream (handle, pos, code, value): what stands between each start and end,
    the code-2 pieces before the code-1 tail."""
    w = Window.partitionBy("handle").orderBy("pos")
    start, end = (F.col("code") == 301) & (F.col("value") == "CELL_VALUE"), (F.col("code") == 304) & (F.col("value") == "ACVALUE_END")
    t = tags.withColumn("cell", F.sum(start.cast("int")).over(w) - 1).withColumn("ended", F.sum(end.cast("int")).over(w))
    inside = t.where((F.col("cell") >= 0) & (F.col("ended") == F.col("cell")) & F.col("code").isin(1, 2))
    piece = F.struct(F.when(F.col("code") == 2, 0).otherwise(1).alias("rank"), "pos", "value")
    texts = inside.groupBy("handle", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda z: z["value"]), "").alias("value"))
    return t.where("cell >= 0").select("handle", "cell").distinct().join(texts, ["handle", "cell"], "left").select("handle", "cell", F.coalesce("value", F.lit("")).alias("value"))


def _glyph_rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
    """Rows of glyphs that are sorted by span and ord; held is [span, row, the row's first baseline, the last x], carried over batches."""
    span, row, first, last = held
    out = []
    numbers = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("y", "x", "size"))  # null: not a number
    for s, y, x, size in zip(batch.column("span").to_pylist(), *numbers, strict=True):
        if s != span:
            span, row, first = s, 0, y
        elif abs(y - first) > 0.3 * size or x < last - 0.5 * size:
            row, first = row + 1, y
        last = x
        out.append(row)
    held[:] = span, row, first, last
    return pa.RecordBatch.from_arrays([batch.column("span"), batch.column("ord"), pa.array(out, pa.int32())], names=["span", "ord", "row"])


def glyph_rows(glyphs: DataFrame) -> DataFrame:
    """(span, ord, row) of glyphs (span, ord, x, y, size): a new row where the baseline leaves the row's first or the pen jumps back.

    That is a fold, as it depends on the row's first glyph. Spans are dealt whole and sorted, and a task folds them one after the other as they
    stream by, so there is no call a span and no span is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [..., 0, 0.0, 0.0]  # no span yet; null is one
        for batch in batches:
            yield _glyph_rows(batch, held)

    dealt = glyphs.select(F.col("span").cast("long").alias("span"), F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "size")))
    return dealt.repartition("span").sortWithinPartitions("span", "ord").mapInArrow(run, "span long, ord long, row int")


def _holds(span: Column, line: Column, slack: float) -> Column:
    """A line runs the way of a span and, with some slack, holds its centre."""
    cx, cy = (span["x0"] + span["x1"]) / 2, (span["y0"] + span["y1"]) / 2
    return (span["dir"] == line["dir"]) & cx.between(line["x0"] - slack, line["x1"] + slack) & cy.between(line["y0"] - slack, line["y1"] + slack)


def home_lines(spans: DataFrame, lines: DataFrame, slack: float = 1.0) -> DataFrame:
    """spans (page, span, x0, y0, x1, y1, dir) with the first line (page, line, …, dir) that holds their centre.

    A span that no line holds opens one with its own box, behind all lines of the page, and spans after it can join that. Which of the
    opened lines are there depends on the spans before, so the leftover spans of a page, and they alone, are folded in order.
    """
    l = lines.select("page", "line", F.col("dir").alias("l_dir"), *(F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    span = F.struct("x0", "y0", "x1", "y1", "dir")
    at = F.struct(*(F.col(f"l_{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "dir")))
    first = spans.join(l, "page").where(_holds(span, at, slack)).groupBy("page", "span").agg(F.min("line").alias("line"))
    known = spans.join(first, ["page", "span"], "left")
    left = known.where("line is null").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("span", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "dir"))).alias("spans"))

    def take(a: Column, s: Column) -> Column:
        # homes: for each span so far the number of its line among those opened; opened: the spans that opened them.
        home = F.array_position(F.transform(a["opened"], lambda o: _holds(s, o, slack)), F.lit(True)).cast("int") - 1
        opens = home < 0
        return F.struct(F.array_append(a["homes"], F.when(opens, F.size(a["opened"])).otherwise(home)).alias("homes"), F.when(opens, F.array_append(a["opened"], s)).otherwise(a["opened"]).alias("opened"))

    kind = left.schema["spans"].dataType.simpleString()
    start = F.struct(F.array().cast("array<int>").alias("homes"), F.array().cast(kind).alias("opened"))
    homes = left.select("page", F.explode(F.arrays_zip("spans", F.aggregate("spans", start, take)["homes"].alias("homes"))).alias("z")).select("page", F.col("z.spans.span").alias("span"), F.col("z.homes").alias("nth"))
    last = lines.groupBy("page").agg(F.max("line").alias("last"))
    opened = homes.join(last, "page", "left").select("page", "span", (F.coalesce("last", F.lit(-1)) + 1 + F.col("nth")).cast(dict(lines.dtypes)["line"]).alias("new_line"))
    return known.join(opened, ["page", "span"], "left").withColumn("line", F.coalesce("line", "new_line")).drop("new_line")


def line_texts(spans: DataFrame) -> DataFrame:
    """(page, line, text): spans from left to right, a blank where the gap is over a quarter of the size."""
    w = Window.partitionBy("page", "line").orderBy("x0", "span")
    gap = F.col("x0") - F.lag("x1").over(w) > 0.25 * F.col("size")
    s = spans.withColumn("piece", F.concat(F.when(gap, " ").otherwise(""), "text"))
    g = s.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span", "piece"))), lambda z: z["piece"]), "").alias("text"))
    return g.withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))


def page_rules(drawings: DataFrame) -> DataFrame:
    """Upright rules of a page (page, kind, x0, y0, x1, y1): lines over 2 long, both sides of boxes over 2 high; y is turned up."""
    line = drawings.where("kind = 'line' and x0 = x1 and abs(y1 - y0) > 2").select("page", F.col("x0").alias("pos"), (-F.greatest("y0", "y1")).alias("lo"), (-F.least("y0", "y1")).alias("hi"))
    box = drawings.where("kind = 'rect' and abs(y1 - y0) > 2").select("page", F.explode(F.array("x0", "x1")).alias("pos"), (-F.greatest("y0", "y1")).alias("lo"), (-F.least("y0", "y1")).alias("hi"))
    return line.unionByName(box)


def read_stage(spark: SparkSession, path: str, like: schema.T.StructType, strict: bool = True) -> DataFrame:
    """A stage document: strict reading fails on a bad one, tolerant reading leaves it out."""
    return spark.read.schema(like).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_jobs(spark: SparkSession, pattern: str) -> DataFrame:
    return read_stage(spark, pattern, schema.JOB, strict=False)


def workspace_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files without their front matter."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return t.withColumn("text", F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "")).where("trim(text) <> ''")


def glossary(texts: DataFrame) -> DataFrame:
    """(term, translation) from lines `a → b · a → b`."""
    pair = F.explode(F.regexp_extract_all("text", F.lit(r"([^·→\n|]+?\s*→\s*[^·\n|]+)"), F.lit(1)))
    return texts.select(pair.alias("p")).select(F.trim(F.split("p", "→")[0]).alias("term"), F.trim(F.split("p", "→")[1]).alias("translation"))
