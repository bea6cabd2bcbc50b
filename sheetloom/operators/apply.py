"""Writing a plan into the entities of a drawing, and proving that nothing else changed.

A write names its target by key: an entity, an attribute of a block reference (handle:tag) or a cell of a table (handle:n).
All writes are joined to the entities once; of several updates of one target the last by seq stands, as in a scan
that writes in order, and the others come back as conflicts, like writes whose target is not there or takes no text. A line
inserted below an entity is a copy of it with its own handle, farther down. Keys are unique, so no task gets more than the writes of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import text as X

from . import review

#: Types whose own text can be replaced, those that count as pieces of text, and those left out of the geometry.
WRITABLE = ["TEXT", "MTEXT", "ATTDEF", "DIMENSION", "ARC_DIMENSION", "LARGE_RADIAL_DIMENSION", "TOLERANCE", "MULTILEADER", "MLEADER"]
COUNTED = ["TEXT", "MTEXT"]
TEXTUAL = ["TEXT", "MTEXT", "ATTRIB", "ATTDEF", "MLEADER"]
#: Kinds of items that are wrapped as lines; the others take their whole text.
LINE_KINDS = ["TEXT", "ATTRIB", "MTEXT"]
#: Kinds of items that are parts of an entity, named behind its handle.
PARTS = ["ATTRIB", "TABLE_CELL"]

OPTIONAL = {"width_factor": "double", "box_width": "double"}


def with_optional(entities: DataFrame) -> DataFrame:
    """Entities with the columns that a plain scan may leave out."""
    for name, kind in OPTIONAL.items():
        if name not in entities.columns:
            entities = entities.withColumn(name, F.lit(None).cast(kind))
    return entities


def writes(lines: DataFrame, table: DataFrame, instances: DataFrame, items: DataFrame, fine: list[str] | None = None, face: str = "Noto") -> DataFrame:
    """(job_id, handle, kind, seq, action, text, width, box, below, y, new_font): everything that a run writes.

    lines: review.line_writes. Lines, attributes and rich text without a box follow the wrap; rich text that stands alone takes
    its whole answer with its codes put back; dimensions, cells, tolerances and leaders take the answer as it is, in every
    place that the segment has. items needs kind, raw, width_factor, box_width, style and font.
    """
    approved = table.where("approved and target <> ''").select("id", X.unmask(F.col("target"), F.coalesce("codes", F.array().cast("array<string>"))).alias("restored"))
    alone = instances.where(F.size("handles") == 1).select("job_id", F.col("handles")[0].alias("handle"), F.lit(True).alias("alone"))
    own = items.select("job_id", "handle", F.col("kind").alias("of_kind"))
    named = lines.join(own, ["job_id", "handle"], "left").withColumn("kind", F.coalesce("of_kind", "kind")).drop("of_kind")
    whole = named.join(alone, ["job_id", "handle"], "left").join(approved, "id", "left")
    other = ~F.coalesce(F.col("kind").isin(LINE_KINDS), F.lit(True))
    keeps_codes = other | (F.coalesce(F.col("kind") == "MTEXT", F.lit(False)) & F.coalesce("alone", F.lit(False)))
    plan = whole.withColumns({"new_text": F.when(keeps_codes, F.col("restored")).otherwise(F.col("new_text")), "width_mult": F.when(other, 1.0).otherwise(F.col("width_mult"))})
    # A line that the wrap left empty is blanked if it is drawn, and not drawn if it would be new.
    plan = plan.where("action <> 'insert' or trim(new_text) <> ''").drop("alone", "restored")
    out = review.refined(plan, items, fine, face)
    return out.select("job_id", "handle", "kind", "seq", "action", F.col("written").alias("text"), "width", "box", "below", "y", "new_font")


def _addressed(w: DataFrame) -> DataFrame:
    part = F.col("kind").isin(PARTS)
    return w.withColumns({"base": F.when(part, F.regexp_replace("handle", r":[^:]*$", "")).otherwise(F.col("handle")), "sub": F.when(part, F.regexp_extract("handle", r":([^:]*)$", 1)).otherwise("")})


def _targets(entities: DataFrame) -> DataFrame:
    """(job_id, base, sub, takes): every place of a drawing that could be written, once."""
    parts = F.when(F.col("type") == "INSERT", F.transform(F.coalesce("attribs", F.array().cast(entities.schema["attribs"].dataType)), lambda a: F.coalesce(a["tag"], F.lit(""))))
    parts = parts.when(F.col("type") == "ACAD_TABLE", F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c, i: i.cast("string")))
    one = entities.select("job_id", F.col("handle").alias("base"), F.lit("").alias("sub"), F.col("type").isin(WRITABLE).alias("takes"))
    many = entities.where(F.col("type").isin("INSERT", "ACAD_TABLE")).select("job_id", F.col("handle").alias("base"), F.explode(F.array_distinct(parts)).alias("sub"), F.lit(True).alias("takes"))
    return one.unionByName(many)


def applied(entities: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(after, conflicts). plan: writes(); after has the columns of entities, width_factor, box_width and added (0: was there before).

    conflicts: (job_id, handle, seq, reason) of each write that is not in force. Skips are no writes. A null text leaves what is drawn.
    """
    e = with_optional(entities)
    w = _addressed(plan.where("action <> 'skip' and text is not null"))
    known = w.join(_targets(e), ["job_id", "base", "sub"], "left")
    reason = F.when(F.col("takes").isNull(), "no such entity").when(~F.col("takes"), "takes no text")
    judged = known.withColumn("reason", reason).drop("takes")
    good = judged.where("reason is null")
    updates = good.where("action = 'update'")
    held = updates.groupBy("job_id", "base", "sub").agg(F.max_by(F.struct("text", "width", "box", "seq"), "seq").alias("z"))
    lost = updates.join(held.select("job_id", "base", "sub", F.col("z.seq").alias("last")), ["job_id", "base", "sub"]).where("seq < last").withColumn("reason", F.lit("written over"))
    conflicts = judged.where("reason is not null").select("job_id", "handle", "seq", "reason").unionByName(lost.select("job_id", "handle", "seq", "reason"))
    each = held.groupBy("job_id", F.col("base").alias("handle")).agg(F.map_from_entries(F.collect_list(F.struct("sub", "z"))).alias("new"))
    j = e.join(each, ["job_id", "handle"], "left")
    new = lambda sub, field, old: F.coalesce(F.try_element_at("new", sub)[field], old)
    own = F.lit("")
    changed = {
        "text": new(own, "text", F.col("text")),
        "width_factor": new(own, "width", F.col("width_factor")),
        "box_width": new(own, "box", F.col("box_width")),
        "attribs": F.transform("attribs", lambda a: F.struct(a["tag"].alias("tag"), new(F.coalesce(a["tag"], own), "text", a["text"]).alias("text"))),
        "cells": F.transform("cells", lambda c, i: new(i.cast("string"), "text", c)),
    }
    kept = j.withColumns({c: F.when(F.col("new").isNull(), F.col(c)).otherwise(v) for c, v in changed.items()}).select(*e.columns, F.lit(0).alias("added"))
    below = good.where("action = 'insert'").groupBy("job_id", "handle", "below").agg(F.max_by(F.struct("text", "width", "y"), "seq").alias("z"))
    lines = e.join(below, ["job_id", "handle"])
    moved = {"handle": F.concat("handle", F.lit("+"), "below"), "text": F.col("z.text"), "width_factor": F.coalesce("z.width", "width_factor"), "y": F.col("z.y")}
    new_rows = lines.select(*(moved.get(c, F.col(c)).alias(c) for c in e.columns), F.col("below").cast("int").alias("added"))
    return kept.unionByName(new_rows), conflicts


# ---------------------------------------------------------------- proof


def _geometry(entities: DataFrame) -> list[Column | str]:
    """What must not change of an entity that is no text: its kind, layer and places."""
    json = [F.to_json(F.struct(c)).alias(c) for c in ("vertices",) if c in entities.columns]
    return ["space", "type", "layer", "x", "y", *json, *(c for c in ("closed", "block") if c in entities.columns)]


def measures(entities: DataFrame) -> DataFrame:
    """One row a job (n, h_sum, h_xor, texts): the multiset of what is drawn besides text, whatever its order, and the number of texts."""
    solid = ~F.col("type").isin(TEXTUAL)
    h = F.when(solid, F.xxhash64(*_geometry(entities)))
    return entities.groupBy("job_id").agg(F.count_if(solid).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h_sum"), F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("h_xor"), F.count_if(F.col("type").isin(COUNTED)).alias("texts"))


def verified(before: DataFrame, after: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """(job_id, ok, problems, new_lines): each job's entities before and after, held against each other.

    new_lines: lines that the plan put in, from planned (job_id, planned), else the added rows of after. A job that only one
    side has is a problem too.
    """
    if planned is None:
        planned = after.groupBy("job_id").agg(F.count_if((F.col("added") > 0) & F.col("type").isin(COUNTED)).alias("planned"))
    b, a = (measures(t).select("job_id", F.struct("n", "h_sum", "h_xor", "texts").alias(s)) for t, s in ((before, "b"), (after, "a")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("h_sum"), F.lit(0).cast("long").alias("h_xor"), F.lit(0).cast("long").alias("texts"))
    both = b.join(a, "job_id", "full").join(planned, "job_id", "left").select("job_id", F.coalesce("b", zero).alias("b"), F.coalesce("a", zero).alias("a"), F.coalesce("planned", F.lit(0).cast("long")).alias("new_lines"))
    count = F.when(F.col("b.n") != F.col("a.n"), F.concat(F.lit("entities: "), "b.n", F.lit(" before, "), "a.n", F.lit(" after")))
    moved = F.when((F.col("b.h_sum") != F.col("a.h_sum")) | (F.col("b.h_xor") != F.col("a.h_xor")), "geometry changed")
    more = F.col("a.texts") - F.col("b.texts")
    texts = F.when(more != F.col("new_lines"), F.concat(F.lit("texts: "), more, F.lit(" more, "), "new_lines", F.lit(" expected")))
    problems = F.array_compact(F.array(count, moved, texts))
    return both.select("job_id", (F.size(problems) == 0).alias("ok"), problems.alias("problems"), "new_lines")
