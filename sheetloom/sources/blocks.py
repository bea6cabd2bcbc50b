"""Block references spelled out: where the entities of a block stand in the spaces that refer to it.

A reference puts a block's points through a scale, a rotation and a shift. References inside a block compose with the one that
holds them, so a placement is a 2 x 3 matrix that grows by one join a level: the placements of a level meet the references
inside their blocks. The number of levels is a parameter, and a block that is already on the way is not entered again, so
a cycle ends. All joins carry the job and the block, and only references travel; what they place is joined once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import checkpointed

#: Levels of references inside references that are entered below a space.
LEVELS = 2
#: The matrix of a placement: x' = a x + c y + e, y' = b x + d y + f.
MATRIX = ["a", "b", "c", "d", "e", "f"]


def with_reference(entities: DataFrame) -> DataFrame:
    """Adds what a reference may leave out: block, xscale, yscale, rotation."""
    for name, value in (("block", F.lit(None).cast("string")), ("xscale", F.lit(1.0)), ("yscale", F.lit(1.0)), ("rotation", F.lit(0.0))):
        entities = entities.withColumn(name, F.coalesce(name, value)) if name in entities.columns else entities.withColumn(name, value)
    return entities


def _turn(degrees: Column) -> tuple[Column, Column]:
    """Cosine and sine, exact at right angles, which most references have."""
    r = F.pmod(degrees, F.lit(360.0))
    cos = F.when(r == 0, 1.0).when(r == 180, -1.0).when(r.isin(90.0, 270.0), 0.0).otherwise(F.cos(F.radians(degrees)))
    sin = F.when(r == 90, 1.0).when(r == 270, -1.0).when(r.isin(0.0, 180.0), 0.0).otherwise(F.sin(F.radians(degrees)))
    return cos, sin


def references(entities: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(job_id, space, ord, name, a..f): the references of every space. bases (job_id, name, bx, by): a block's base point, else 0, 0."""
    e = with_reference(entities).where("type = 'INSERT' and block is not null").select("job_id", "space", "ord", F.col("block").alias("name"), "x", "y", "xscale", "yscale", "rotation")
    e = e.join(bases, ["job_id", "name"], "left") if bases is not None else e.withColumns({"bx": F.lit(0.0), "by": F.lit(0.0)})
    cos, sin = _turn(F.col("rotation"))
    turned = e.select("job_id", "space", "ord", "name", "x", "y", F.coalesce("bx", F.lit(0.0)).alias("bx"), F.coalesce("by", F.lit(0.0)).alias("by"), (cos * F.col("xscale")).alias("a"), (sin * F.col("xscale")).alias("b"), (-sin * F.col("yscale")).alias("c"), (cos * F.col("yscale")).alias("d"))
    shift = lambda p, q, at: F.col(at) - (F.col(p) * F.col("bx") + F.col(q) * F.col("by"))
    return turned.select("job_id", "space", "ord", "name", "a", "b", "c", "d", shift("a", "c", "x").alias("e"), shift("b", "d", "y").alias("f"))


def placements(entities: DataFrame, bases: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """(job_id, place, ord, name, level, way, a..f): every block that stands in a place, through one reference or several.

    ord is that of the reference in the place itself; way the blocks on the way, the placed one last.
    """
    refs = checkpointed(references(entities, bases))
    level = refs.withColumn("place", F.col("space")).withColumn("way", F.array("name")).where(F.col("place") != F.concat(F.lit("block:"), F.col("name")))
    columns = ["job_id", "place", "ord", "name", "way", *MATRIX]
    level = level.select(*columns)
    out = level.withColumn("level", F.lit(1))
    inner = refs.select("job_id", F.regexp_extract("space", "^block:(.*)$", 1).alias("name"), F.col("name").alias("to"), *(F.col(m).alias(f"i_{m}") for m in MATRIX)).where("name <> ''")
    for n in range(2, levels + 1):
        met = level.join(inner, ["job_id", "name"]).where(~F.array_contains("way", F.col("to")) & (F.col("place") != F.concat(F.lit("block:"), F.col("to"))))
        m, i = {k: F.col(k) for k in MATRIX}, {k: F.col(f"i_{k}") for k in MATRIX}
        put = {
            "a": m["a"] * i["a"] + m["c"] * i["b"], "b": m["b"] * i["a"] + m["d"] * i["b"], "c": m["a"] * i["c"] + m["c"] * i["d"], "d": m["b"] * i["c"] + m["d"] * i["d"],
            "e": m["a"] * i["e"] + m["c"] * i["f"] + m["e"], "f": m["b"] * i["e"] + m["d"] * i["f"] + m["f"],
        }
        level = met.select("job_id", "place", "ord", F.col("to").alias("name"), F.array_append("way", F.col("to")).alias("way"), *(v.alias(k) for k, v in put.items()))
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out


def placed_shapes(entities: DataFrame, types: list[str], bases: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """(job_id, place, ord, part, closed, vertices) of lines of these types, in their own space and in every place that refers to their block.

    part tells shapes of one reference apart, in the order of a scan: by level, then way, then their own order.
    """
    held = entities.where(F.col("type").isin(types) & (F.size("vertices") > 1)).select("job_id", "space", F.col("ord").alias("own"), "closed", "vertices")
    own = held.select("job_id", F.col("space").alias("place"), F.col("own").alias("ord"), F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("way"), F.col("own")).alias("part"), "closed", "vertices")
    if "block" not in entities.columns:
        return own
    at = placements(entities, bases, levels)
    inside = held.withColumn("name", F.regexp_extract("space", "^block:(.*)$", 1)).where("name <> ''").drop("space")
    moved = F.transform("vertices", lambda v: F.struct((F.col("a") * v["x"] + F.col("c") * v["y"] + F.col("e")).alias("x"), (F.col("b") * v["x"] + F.col("d") * v["y"] + F.col("f")).alias("y")))
    return own.unionByName(at.join(inside, ["job_id", "name"]).select("job_id", "place", "ord", F.struct("level", "way", "own").alias("part"), "closed", moved.alias("vertices")))
