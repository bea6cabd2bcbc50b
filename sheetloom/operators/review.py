"""The review table, reviewer edits, and what they lead to: patch plan, verification, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import text as X

from . import fit as fits


def review_table(segments: DataFrame, translations: DataFrame, fit: DataFrame, review: DataFrame) -> DataFrame:
    """One row a segment: reviewer over model over default. A null review column means the key is absent."""
    t = translations.select("id", F.col("target").alias("model_target"), F.col("ok").alias("t_ok"), F.col("note").alias("t_note"))
    f = fit.select("id", F.col("flag").alias("f_flag"), F.col("ratio").alias("f_ratio"), F.col("suggested_width_factor").alias("f_wf"))
    r = review.select("id", F.col("text").alias("r_text"), F.col("approved").alias("r_ok"), F.col("width_factor").alias("r_wf"))
    j = segments.join(t, "id", "left").join(f, "id", "left").join(r, "id", "left")
    target = F.coalesce("r_text", "model_target", F.lit(""))
    return j.select(
        *segments.columns, target.alias("target"), X.display_text(target).alias("display"), F.coalesce("model_target", F.lit("")).alias("model_target"),
        F.coalesce("t_ok", F.lit(False)).alias("ok"), F.coalesce("t_note", F.lit("")).alias("note"), F.coalesce("f_flag", F.lit("")).alias("fit"), F.coalesce("f_ratio", F.lit(1.0)).alias("ratio"),
        F.coalesce("r_wf", "f_wf", F.lit(1.0)).alias("width_factor"), F.col("r_wf").isNotNull().alias("width_override"), F.coalesce("r_ok", F.lit(False)).alias("approved"), F.col("r_text").isNotNull().alias("edited"),
    )


def totals(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("total"), F.count_if("approved").alias("approved"), F.count_if(~F.col("ok")).alias("need_human"), F.count_if(F.col("fit") != "").alias("to_check"), F.count_if(F.col("note") == "from memory").alias("from_memory"))


def needs_attention(table: DataFrame) -> DataFrame:
    return table.where(~F.col("ok") | F.col("fit").isin("overflow", "tight"))


def set_review(review: DataFrame, edits: DataFrame, reverted: DataFrame | None = None) -> DataFrame:
    """Non-null fields of edits replace; ids in reverted lose their text."""
    e = edits.select("id", *(F.col(c).alias(f"n_{c}") for c in ("text", "approved", "width_factor")))
    out = review.join(e, "id", "full").select("id", *(F.coalesce(f"n_{c}", c).alias(c) for c in ("text", "approved", "width_factor")))
    if reverted is not None:
        out = out.join(reverted.select("id", F.lit(True).alias("gone")), "id", "left").withColumn("text", F.when(F.col("gone"), None).otherwise(F.col("text"))).drop("gone")
    return out


def approve_all_ok(table: DataFrame, review: DataFrame) -> DataFrame:
    new = table.where("ok and not approved").select("id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("approved"), F.lit(None).cast("double").alias("width_factor"))
    return set_review(review, new)


def to_remember(table: DataFrame) -> DataFrame:
    return table.where("approved and trim(target) <> ''").select("source", "target")


#: Texts of a place and kind that a report carries; n counts all.
SHOWN = 50


def to_check(table: DataFrame, flags: DataFrame | None = None, keep: int = SHOWN) -> DataFrame:
    """(place, kind, n, shown): what is worth a look, by place; table has places array<string>; flags (place, note). shown: the first `keep` by id."""
    kinds = F.array_compact(F.array(F.when(F.col("fit") == "overflow", "wider than the space"), F.when(~F.col("approved"), "not approved, so left in the original language").when(~F.col("ok"), "the model was unsure")))
    shown = X.excerpt(F.when(F.col("display") != "", F.col("display")).otherwise(F.col("source")))
    places = F.when(F.size(F.coalesce("places", F.array().cast("array<string>"))) > 0, F.col("places")).otherwise(F.array(F.lit("somewhere not recorded")))
    rows = table.select("id", F.explode(places).alias("place"), kinds.alias("kinds"), shown.alias("shown")).select("id", "place", F.explode("kinds").alias("kind"), "shown")
    if flags is not None:
        note = F.when(F.trim("note") == "", "no note given").otherwise(F.trim("note"))
        rows = rows.unionByName(flags.select(F.lit("").alias("id"), "place", F.lit("flagged by the reviewer").alias("kind"), note.alias("shown")))
    sizes = rows.groupBy("place", "kind").agg(F.count("*").alias("n"))
    # The limit on the rank is applied in every task before rows move.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("place", "kind").orderBy("id", "shown"))).where(F.col("nth") <= keep)
    texts = first.groupBy("place", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda z: z["shown"]).alias("shown"))
    return sizes.join(texts, ["place", "kind"])


def report_lines(checks: DataFrame, sample: int = 4) -> DataFrame:
    """(place, kind, line): the first few of each list, and how many more."""
    head = F.array_join(F.slice("shown", 1, sample), "; ")
    more = F.when(F.col("n") > sample, F.concat(F.lit(" and "), F.col("n") - sample, F.lit(" more"))).otherwise("")
    return checks.select("place", "kind", F.concat(F.col("place"), F.lit(": "), F.col("kind"), F.lit(" ("), F.col("n"), F.lit("): "), head, more).alias("line"))


def notes_by_page(checks: DataFrame) -> DataFrame:
    page = F.regexp_extract("place", r"^page (\d+)$", 1)
    return checks.where(page != "").select(page.try_cast("int").alias("page"), "kind", "n", "shown").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("kind", "n", "shown"))).alias("notes"))


def report(result: DataFrame, checks: DataFrame) -> DataFrame:
    """(line_no, line): verdict first, then what to look at. result: one row (patched, skipped, ok, problems)."""
    verdict = result.select(F.lit(0).alias("line_no"), F.concat(F.when(F.col("ok"), "verified").otherwise("NOT verified"), F.lit(": "), F.col("patched"), F.lit(" written, "), F.col("skipped"), F.lit(" left"), F.when(F.size("problems") > 0, F.concat(F.lit("; "), F.array_join("problems", "; "))).otherwise("")).alias("line"))
    order = F.row_number().over(Window.orderBy(*X.place_order(F.col("place")), "kind"))
    return verdict.unionByName(report_lines(checks).select(order.alias("line_no"), "line"))


# ---------------------------------------------------------------- patch plan


def line_writes(table: DataFrame, instances: DataFrame, items: DataFrame, only_approved: bool = True, cjk: bool = False) -> DataFrame:
    """(job_id, id, inst, handle, kind, seq, below, action, new_text, width_mult, y): updates of every line, and inserts for lines below the last of a text.

    instances: (job_id, id, inst, handles, caps, caps_max, max_lines, spare). A reviewer's width factor wraps at that factor
    and folds the rest into the last line; otherwise the best wrap decides. A line that is no longer needed becomes blank.
    seq orders the writes of a job: by segment, then text, then line.
    """
    want = table.where((F.col("target") != "") & (F.col("approved") | F.lit(not only_approved))).select("id", "width_factor", "width_override", F.col("display").alias("text"))
    best = fits.wrap_at(fits.wrap_best(want.join(instances, "id"), cjk), cjk)
    best = best.withColumns({"lines": F.when(F.col("width_override"), F.col("forced")).otherwise(F.col("fit.lines")), "mult": F.when(F.col("width_override"), F.col("width_factor")).otherwise(F.col("fit.wf"))})
    rows = best.select("job_id", "id", "inst", "handles", "mult", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("handles"), F.size("lines")) - 1), lambda i: F.struct(F.get("handles", i).alias("handle"), F.coalesce(F.get("lines", i), F.lit("")).alias("line")))).alias("line_no", "z"))
    rows = rows.select("job_id", "id", "inst", "line_no", "mult", F.coalesce("z.handle", F.element_at("handles", -1)).alias("handle"), F.when(F.col("z.handle").isNull(), F.col("line_no") - F.size("handles") + 1).alias("below"), F.col("z.line").alias("line"))
    at = items.select("job_id", "handle", "kind", "height", "y")
    out = rows.join(at, ["job_id", "handle"], "left").where(F.col("below").isNull() | (F.col("kind") == "TEXT"))
    action = F.when(F.col("kind").isNull(), "skip").when(F.col("below").isNotNull(), "insert").otherwise("update")
    return out.select("job_id", "id", "inst", "handle", "kind", F.struct("id", "inst", "line_no").alias("seq"), "below", action.alias("action"), F.col("line").alias("new_text"), F.col("mult").alias("width_mult"), (F.col("y") - 1.45 * F.col("height") * F.coalesce("below", F.lit(0))).alias("y"))


def patch_plan(table: DataFrame, instances: DataFrame, items: DataFrame, only_approved: bool = True, cjk: bool = False) -> DataFrame:
    """(id, inst, handle, action, new_text, width_mult, y) of line_writes."""
    return line_writes(table, instances, items, only_approved, cjk).select("id", "inst", "handle", "action", "new_text", "width_mult", "y")


def refined(plan: DataFrame, items: DataFrame, fine: list[str] | None = None, face: str = "Noto") -> DataFrame:
    """The plan with what the drawn text already has taken into account: items (job_id, handle, kind, raw, width_factor, box_width, style, font).

    width is the text's own factor times the plan's; narrowed rows with wide
    gaps are padded again; rich text gets its width as a code and its fonts changed; a box only ever shrinks. A style is
    pointed to `face` unless its font holds one of `fine`; full-width forms of a style that is pointed anew become plain.
    """
    fine = fine or []
    p = plan.join(items.select("job_id", "handle", "raw", "width_factor", "box_width", "style", "font"), ["job_id", "handle"], "left")
    rich = F.col("kind").isin("MTEXT", "MLEADER", "TABLE_CELL")
    keep = F.exists(F.array(*(F.lit(x) for x in fine)), lambda x: F.contains(F.lower("font"), F.lower(x))) if fine else F.lit(False)
    text = F.when(F.coalesce(keep, F.lit(False)), F.col("new_text")).otherwise(X.ascii_forms(F.col("new_text")))
    padded = repad_narrowed(text, F.col("width_mult"))
    coded = X.narrow_mtext(X.swap_fonts(padded, face, fine)["text"], F.col("width_mult"))
    own = F.when(F.coalesce("width_factor", F.lit(0.0)) > 0, F.col("width_factor")).otherwise(1.0)
    box = F.when(rich & (F.coalesce("box_width", F.lit(0.0)) > 0), F.least(F.col("box_width"), F.col("box_width") * F.col("width_mult")))
    return p.select(*plan.columns, F.when(rich, coded).otherwise(padded).alias("written"), F.when(rich, own).otherwise(own * F.col("width_mult")).alias("width"), box.alias("box"), F.when(keep, F.col("font")).otherwise(face).alias("new_font"))


def page_plan(plan: DataFrame, places: DataFrame) -> DataFrame:
    """(job_id, page, writes): what is written on each page, from the top and the left; places (job_id, handle, page, x, y0)."""
    w = plan.join(places, ["job_id", "handle"]).where("action <> 'skip'")
    return w.groupBy("job_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x", "handle", "new_text"))).alias("writes"))


def other_kinds_plan(table: DataFrame, handle_map: DataFrame) -> DataFrame:
    """The same text for every handle of a segment, codes put back; table has id, target, codes."""
    return table.join(handle_map, "id").select("id", "handle", F.lit("update").alias("action"), X.unmask(F.col("target"), F.col("codes")).alias("new_text"))


def repad_narrowed(line: Column, factor: Column) -> Column:
    """Widens the first wide gap so that a narrowed row keeps its column."""
    label, gap, rest = (F.regexp_extract(line, r"(?s)^(.*?\S)([ 　]{3,})(.*)$", i) for i in (1, 2, 3))
    blanks = F.ceil((F.length(label) + F.length(gap)) / factor).cast("int") - F.length(label)
    return F.when((gap == "") | (F.abs(factor - 1) <= 0.01), line).otherwise(F.concat(label, F.repeat(F.lit(" "), blanks), rest))


def cell_chunks(value: Column, size: int = 250) -> Column:
    """A table cell's text in pieces that its format can hold."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(value) - 1) / size), F.lit(0)).cast("int")), lambda i: F.substr(value, i * size + 1, F.lit(size)))


def mirror_cells(drawn: DataFrame, changed: DataFrame) -> DataFrame:
    """Drawn copies (block, handle, text) of changed cells (block, old_text, new_text)."""
    return drawn.join(changed.select("block", F.col("old_text").alias("text"), "new_text"), ["block", "text"]).select("block", "handle", "new_text")


def restyled(items: DataFrame, plan: DataFrame, fine: list[str], face: str) -> DataFrame:
    """(style, old_font, new_font): styles of written texts, kept if their font holds one of `fine`; items has style, font."""
    used = items.join(plan.where("action <> 'skip'").select("handle"), "handle", "left_semi").select("style", "font").distinct()
    keep = F.exists(F.array(*(F.lit(x) for x in fine)), lambda x: F.contains(F.lower("font"), F.lower(x)))
    return used.select("style", F.col("font").alias("old_font"), F.when(keep, F.col("font")).otherwise(face).alias("new_font"))


# ---------------------------------------------------------------- verification


def fingerprint(geometry: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, h_sum, h_xor): the multiset of rows, whatever their order."""
    h = F.xxhash64(*columns)
    return geometry.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h_sum"), F.bit_xor(h).alias("h_xor"))


def ordered_fingerprint(geometry: DataFrame, space: str, order: str, columns: list[str]) -> DataFrame:
    """(space, n, sha): order counts."""
    g = geometry.groupBy(space).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*columns)).alias("j")))).alias("rows"))
    return g.select(space, "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["j"]), "\n").cast("binary"), 256).alias("sha"))


def verify(before: DataFrame, after: DataFrame, texts_before: int, texts_after: int, added: int = 0) -> DataFrame:
    """One row (ok, problems) from two fingerprints and the counts of texts."""
    b, a = before.select(*(F.col(c).alias(f"b_{c}") for c in ("n", "h_sum", "h_xor"))), after.select(*(F.col(c).alias(f"a_{c}") for c in ("n", "h_sum", "h_xor")))
    texts = F.when(F.lit(texts_after) != F.lit(texts_before + added), F.lit(f"texts: {texts_before} before, {texts_after} after, {added} added"))
    both = b.join(a, F.lit(True))
    problems = F.array_compact(F.array(F.when(F.col("b_n") != F.col("a_n"), F.concat(F.lit("geometry: "), "b_n", F.lit(" before, "), "a_n", F.lit(" after"))), F.when((F.col("b_n") == F.col("a_n")) & ((~F.col("b_h_sum").eqNullSafe(F.col("a_h_sum"))) | (~F.col("b_h_xor").eqNullSafe(F.col("a_h_xor")))), "geometry moved"), texts))
    return both.select((F.size(problems) == 0).alias("ok"), problems.alias("problems"))
