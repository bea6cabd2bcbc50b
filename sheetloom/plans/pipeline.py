"""The whole run: prepare, translate, fit, approve, plan over a table of items, then write into the entities and verify.

Nothing is collected; what several steps read is kept as a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X
from sheetloom.operators import apply, fit, review, segments, spatial, translation
from sheetloom.sources import entities as scans
from sheetloom.sources.stages import checkpointed


@dataclass
class Run:
    items: DataFrame
    units: DataFrame
    segments: DataFrame
    instances: DataFrame
    translations: DataFrame
    fits: DataFrame
    table: DataFrame
    plan: DataFrame
    cjk: bool = False


@dataclass
class Finished:
    """A run carried through: what was written, the entities after it, the writes that are not in force, and each job's verdict."""

    run: Run
    writes: DataFrame
    after: DataFrame
    conflicts: DataFrame
    verdicts: DataFrame


def prepare(items: DataFrame, rules: DataFrame, target: str = "en", floors: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, segments, instances). A unit is a paragraph or a lone text; an instance has a cap a line, its own or the paragraph's."""
    wanted = segments.translatable(items, segments.sources_for(target))
    # Read three times below, and the dearest part: kept as a table.
    joined = checkpointed(segments.paragraphs(wanted).select("job_id", "handle", "paragraph", "line"))
    units = checkpointed(segments.masked(segments.paragraph_units(wanted, joined)))
    seg = checkpointed(segments.segments(units, ["ord"]).withColumn("id", F.concat_ws("-", "job_id", "id")))
    geometry = spatial.measured(items, "lang", X.is_translatable(F.col("kind"), F.col("plain"), F.col("lang"), segments.sources_for(target)).alias("wanted"))
    # Searches over whole drawings, which what follows would plan and run again at every use.
    avail, clear = checkpointed(spatial.available_widths(geometry, rules)), checkpointed(spatial.room_below(geometry, floors))
    # Of whole texts only the widths are joined.
    lines = geometry.where("wanted").drop("wanted").join(joined, ["job_id", "handle"], "left").withColumns({"paragraph": F.coalesce("paragraph", "handle"), "line": F.coalesce("line", F.lit(0))})
    shared = segments.paragraph_capacity(lines, avail)
    alone = segments.single_capacity(F.col("em"), F.col("lang"), F.col("height"), F.lit(1.0), F.col("avail"))
    room = lines.join(avail, ["job_id", "place", "handle"], "left").join(clear, ["job_id", "place", "handle"], "left").join(shared.select("job_id", "handle", F.col("cap").alias("p_cap"), "cap_max"), ["job_id", "handle"])
    room = room.select("job_id", F.col("paragraph").alias("handle"), F.struct("line", alone.alias("alone"), "p_cap", "cap_max", M.spare_lines(F.coalesce("clear", F.lit(0.0)), F.col("height")).alias("spare")).alias("r"))
    caps = room.groupBy("job_id", "handle").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    one = F.size("rs") == 1
    each = lambda f, g: F.transform("rs", lambda r: F.when(one, r[f]).otherwise(r[g]))
    at = units.join(seg.select("job_id", F.col("source").alias("marked"), "id"), ["job_id", "marked"]).join(caps, ["job_id", "handle"])
    inst = at.select("job_id", "id", F.col("handle").alias("inst"), "handles", each("alone", "p_cap").alias("caps"), each("alone", "cap_max").alias("caps_max"), F.col("n_lines").alias("max_lines"), F.element_at("rs", -1)["spare"].alias("spare"))
    return units, seg, inst


def shortened(seg: DataFrame, inst: DataFrame, answers: DataFrame, fits: DataFrame, shorter: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answers with those that overflow shortened to the least room any of their instances has; a column shortened."""
    room = inst.groupBy("id").agg(F.min(F.aggregate("caps", F.lit(0.0), lambda a, c: a + c)).alias("room"))
    long = answers.join(fits.where("flag = 'overflow'").select("id"), "id", "left_semi").join(seg.select("id", "source"), "id").join(room, "id")
    cut = translation.shorten(long.select("id", "source", "target", segments.shorten_budget(F.col("room")).alias("budget")), shorter)
    new = cut.where("shortened").select("id", F.col("target").alias("new"))
    return answers.join(new, "id", "left").withColumns({"target": F.coalesce("new", "target"), "shortened": F.col("new").isNotNull()}).drop("new")


def run_all(items: DataFrame, rules: DataFrame, memory: DataFrame, target: str = "en", approve: bool = True, shorter: Callable[[DataFrame], DataFrame] | None = None, floors: DataFrame | None = None) -> Run:
    """items needs job_id, ord, handle, kind, place, layer, plain, lang, height, x, y. The mock translator stands in for a model.

    shorter (rows id, source, target, budget to id, target): answers that overflow are asked for again and assessed anew.
    rules stand upright beside texts, floors lie level below them.
    """
    units, seg, inst = prepare(items, rules, target, floors)
    remembered = translation.hits(seg, memory).select("id", "target")
    fresh = translation.mock(translation.misses(seg, memory), target.upper())
    answers = translation.reassemble(seg, remembered, fresh)
    cjk = target in ("ja", "zh")
    # Each is read several times by what follows; as one plan it would grow with every pass.
    inst, answers = checkpointed(inst), checkpointed(answers)
    fits = checkpointed(fit.assess(seg, inst, answers, cjk=cjk))
    if shorter is not None:
        answers = checkpointed(shortened(seg, inst, answers, fits, shorter))
        fits = checkpointed(fit.assess(seg, inst, answers, cjk=cjk))
    none = seg.sparkSession.createDataFrame([], "id string, text string, approved boolean, width_factor double")
    table = review.review_table(seg, answers, fits, none)
    if approve:
        table = review.review_table(seg, answers, fits, review.approve_all_ok(table, none))
    return Run(items, units, seg, inst, answers, fits, table, review.patch_plan(table, inst, items, cjk=cjk), cjk)


def run_drawing(entities: DataFrame, memory: DataFrame, fonts: DataFrame | None = None, target: str = "en", fine: list[str] | None = None, face: str = "Noto", shorter: Callable[[DataFrame], DataFrame] | None = None) -> Finished:
    """From the entities of drawings to the entities after: scan, rules and floors, the run, writes of all kinds, and the proof.

    fonts: (job_id, style, font); styles without one count as neither fine nor known.
    """
    found = checkpointed(scans.items(entities))
    walls, floors = (checkpointed(scans.rule_lines(entities, vertical)) for vertical in (True, False))
    run = run_all(found, walls, memory, target, shorter=shorter, floors=floors)
    return finish(run, entities, fonts, fine, face)


def finish(run: Run, entities: DataFrame, fonts: DataFrame | None = None, fine: list[str] | None = None, face: str = "Noto") -> Finished:
    """Refines the plan of a run, writes it into the entities and verifies each job."""
    table, inst = checkpointed(run.table), checkpointed(run.instances)
    own = apply.with_optional(entities).select("job_id", F.col("handle").alias("base"), "width_factor", "box_width")
    base = F.when(F.col("kind").isin(apply.PARTS), F.regexp_replace("handle", r":[^:]*$", "")).otherwise(F.col("handle"))
    items = run.items.drop("width_factor", "box_width", "font").withColumn("base", base).join(own, ["job_id", "base"], "left").drop("base")
    items = items.join(fonts, ["job_id", "style"], "left") if fonts is not None else items.withColumn("font", F.lit(None).cast("string"))
    lines = review.line_writes(table, inst, items, cjk=run.cjk)
    plan = checkpointed(apply.writes(lines, table, inst, items, fine, face))
    after, conflicts = apply.applied(entities, plan)
    after = checkpointed(after)
    return Finished(run, plan, after, conflicts, apply.verified(entities, after))
