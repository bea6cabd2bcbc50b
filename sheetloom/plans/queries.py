"""Named queries over the driver's tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X
from sheetloom.operators import cluster, fit, jobs, review, segments, spatial, translation
from sheetloom.sources import tables as S
from sheetloom.sources.tables import table
from sheetloom.streaming import spend

from . import pipeline
from .registry import QUERIES, SQL, Query, query
from .shape_sql import components_sql, merged_sql, paragraph_sql
from .wrap_sql import wrap_sql

TAG = r"(<[^>]+>)"
TI, RULE, USAGE = S.TEXT_ITEM_SQL, S.RULE_SQL, S.USAGE_SQL


def _ti(s: SparkSession, d: str) -> DataFrame:
    return S.text_items(table(s, d, "documents"))


def _ord(df: DataFrame) -> DataFrame:
    """A stable scan order from the keys."""
    return df.withColumn("ord", F.col("doc_id") * (1 << 32) + F.col("pos"))


# ---------------------------------------------------------------- inventory


@query(f"with {TI} select lang, count(*) n from ti group by lang")
def inventory_by_lang(s, d):
    return _ti(s, d).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"with {TI} select kind, count(*) n, count(distinct plain) n_unique from ti group by kind")
def inventory_by_kind(s, d):
    return _ti(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("plain").alias("n_unique"))


@query(f"with {TI} select lang, kind, count(*) n, count(distinct plain) n_unique from ti group by grouping sets ((), (lang), (kind))")
def inventory_summary(s, d):
    return segments.summary(_ti(s, d)).select("lang", "kind", "n", "n_unique")


_PLACE = "case when place = 'model' then 'model space' when place like 'page:%' then 'page ' || substring(place, 6) when place like 'paper:%' then 'sheet ' || substring(place, 7) when place like 'block:%' then 'block ' || substring(place, 7) else place end"


@query(f"with {TI} select {_PLACE} place, lang, count(*) n, count(distinct plain) n_unique from ti group by 1, 2")
def unique_strings_by_place(s, d):
    return _ti(s, d).groupBy(X.place_name(F.col("place")).alias("place"), "lang").agg(F.count("*").alias("n"), F.count_distinct("plain").alias("n_unique"))


_WS = r"[\s\x{3000}\x{00A0}]"
_OK = rf"""(regexp_replace(plain, '{_WS}', '', 'g') <> '' and not regexp_matches(plain, '^{_WS}*([А-ЯЁ]|[А-ЯЁ]{{1,2}}[0-9]{{1,3}}){_WS}*$')
 and not regexp_matches(plain, '^{_WS}*[А-ЯЁ]{{1,3}}-?[0-9]+([.,][0-9]+)*[а-яё*]?{_WS}*$')
 and (kind = 'DIMENSION' or not regexp_matches(plain, '^{_WS}*([-+±%.,:/0-9\s\x{{3000}}×xX*#°''"()\[\]φΦ@=<>~_]|%%[cCdDpPuUoO]|mm|cm|m|kg|kN|MPa|Hz|V|A|W|kW|kVA|Ø|DN|PN|№)+{_WS}*$')) and lang in ('ru', 'ja'))"""


@query(f"with {TI} select kind, lang, count(*) n from ti where {_OK} group by kind, lang")
def translatable_filter(s, d):
    return segments.translatable(_ti(s, d), ["ru", "ja"]).groupBy("kind", "lang").agg(F.count("*").alias("n"))


@query(f"with {TI} select handle from ti where not {_OK}")
def skipped_items(s, d):
    return segments.skipped(_ti(s, d), ["ru", "ja"]).select("handle")


_SEG = f"""{TI}, sg as (select job_id, plain source, min(doc_id * 4294967296 + pos) first, arg_min(lang, doc_id * 4294967296 + pos) lang, max(height) max_height, count(*) n from ti where {_OK} group by 1, 2),
seg as (select *, 's' || lpad(cast(row_number() over (partition by job_id order by first) as varchar), 5, '0') id from sg)"""


def _segments(s, d):
    units = segments.masked(segments.translatable(_ord(_ti(s, d)), ["ru", "ja"]))
    return segments.segments(units, ["ord"])


@query(f"with {_SEG} select job_id, id, source, lang, max_height, n from seg")
def segments_dedup(s, d):
    return _segments(s, d).select("job_id", "id", "source", "lang", "max_height", F.col("count").alias("n"))


@query(f"with {_SEG}, l as (select job_id, plain source, layer, min(doc_id * 4294967296 + pos) o from ti where {_OK} group by 1, 2, 3) select seg.job_id, id, string_agg(layer, ', ' order by o) layers from seg join l on seg.job_id = l.job_id and seg.source = l.source group by 1, 2")
def segment_context(s, d):
    return _segments(s, d).select("job_id", "id", F.array_join("layers", ", ").alias("layers"))


@query(f"with {TI} select lang, count(*) n from ti where lang not in ('ru', 'none') group by lang order by n desc, lang desc limit 1")
def wrong_source_diagnosis(s, d):
    return segments.wrong_source(_ti(s, d), ["ru"])


@query(f"with {_SEG}, b as (select job_id, cast(floor((row_number() over (partition by job_id order by id) - 1) / 60) as bigint) batch from seg) select job_id, batch, count(*) n from b group by 1, 2")
def translation_batches(s, d):
    return translation.batches(_segments(s, d), "id").groupBy("job_id", "batch").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text


_PARTS = "with p as (select page_id, html, string_split_regex(html, '<[^>]+>') parts from pages)"


@query(f"{_PARTS} select page_id, array_to_string(list_transform(parts, lambda p, i: case when i < len(parts) then p || '⟦' || i || '⟧' else p end), '') marked, len(parts) - 1 n_codes from p")
def mask_tokens(s, d):
    html = F.col("html")
    return table(s, d, "pages").select("page_id", X.mask(html, TAG).alias("marked"), F.size(X.codes(html, TAG)).cast("long").alias("n_codes"))


@query(r"select page_id, case page_id % 3 when 0 then html when 1 then coalesce(regexp_extract(html, '<[^>]+>'), '') || regexp_replace(html, '<[^>]+>', '') else html || regexp_extract(html, '<[^>]+>') end restored, page_id % 3 = 0 or not contains(html, '<') ok from pages".replace("html || regexp_extract(html, '<[^>]+>') end", "html end"))
def unmask_tokens(s, d):
    """A marker that is lost gives its code to the front; one that is repeated counts once."""
    p = table(s, d, "pages").select("page_id", "html", X.mask(F.col("html"), TAG).alias("m"), X.codes(F.col("html"), TAG).alias("c"))
    k = F.col("page_id") % 3
    edited = F.when(k == 0, F.col("m")).when(k == 1, F.replace("m", F.lit("⟦1⟧"), F.lit(""))).otherwise(F.concat("m", F.when(F.contains("m", F.lit("⟦1⟧")), "⟦1⟧").otherwise("")))
    return p.withColumn("e", edited).select("page_id", X.unmask(F.col("e"), F.col("c")).alias("restored"), X.markers_ok(F.col("m"), F.col("e")).alias("ok"))


@query(f"{_PARTS} select page_id, (page_id % 2 = 1 or len(parts) = 1) ok from p")
def marker_multiset_ok(s, d):
    m = X.mask(F.col("html"), TAG)
    p = table(s, d, "pages").select("page_id", m.alias("m"))
    return p.select("page_id", X.markers_ok(F.col("m"), F.when(F.col("page_id") % 2 == 0, F.replace("m", F.lit("⟦1⟧"), F.lit(""))).otherwise(F.col("m"))).alias("ok"))


@query("select page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) n from pages")
def visible_text_length(s, d):
    return table(s, d, "pages").select("page_id", F.length(X.display_text(X.mask(F.col("html"), TAG))).cast("long").alias("n"))


@query(f"with {TI} select handle, case when regexp_replace(plain, '{_WS}', '', 'g') = '' then plain else '[EN]' || plain || '[/EN]' end target from ti")
def mock_translate(s, d):
    return _ti(s, d).select("handle", X.mock_translate(F.col("plain")).alias("target"))


@query(f"with {TI} select handle, {M.em_width_sql('plain')} em from ti")
def em_width(s, d):
    return _ti(s, d).select("handle", M.em_width(F.col("plain")).alias("em"))


_WIDE = r"\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}"


@query(f"with {TI}, r as (select handle, regexp_extract_all(plain, '[{_WIDE}]+|[^{_WIDE}]+') rs from ti) select handle, cast(len(rs) as bigint) n_runs, array_to_string(list_transform(rs, lambda x: case when regexp_matches(x, '^[{_WIDE}]') then 'w' else 'n' end || length(x)), ' ') runs from r")
def script_runs(s, d):
    t = _ti(s, d).select("handle", X.script_runs(F.col("plain")).alias("rs"))
    show = F.transform("rs", lambda z: F.concat(F.when(z["cjk"], "w").otherwise("n"), F.length(z["text"]).cast("string")))
    return t.select("handle", F.size("rs").cast("long").alias("n_runs"), F.array_join(show, " ").alias("runs"))


@query(f"with {TI} select handle, plain decoded from ti where lang = 'ru' and not regexp_matches(plain, '[^\\x{{0000}}-\\x{{007E}}\\x{{0400}}-\\x{{04FF}}]')")
def shift_decode(s, d):
    letters = "аеинорсту"
    away = "".join(chr(c.encode("cp1251")[0] + X.CODEPAGE_SHIFTS[0]) for c in letters)
    t = _ti(s, d).where((F.col("lang") == "ru") & ~F.col("plain").rlike(r"[^\u0000-~Ѐ-ӿ]"))
    return t.select("handle", X.decode_shift(F.translate("plain", letters, away)).alias("decoded"))


_FINE = r"[ -~\x{0400}-\x{045F}\x{00A0}\x{00B0}-\x{00B3}\x{00B9}\x{00D7}\x{00F7}\x{00AB}\x{00BB}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}\x{2116}\x{2022}\x{2032}\x{2033}\x{2103}\x{2205}\x{00D8}\x{00F8}\x{2300}]"


@query(f"with {TI} select handle, cast(length(plain) - length(regexp_replace(plain, '{_FINE}', '', 'g')) as double) / length(plain) sane from ti")
def sanity_score(s, d):
    return _ti(s, d).select("handle", X.sanity(F.col("plain")).alias("sane"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_props_extract(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"with {TI}, q as (select distinct place from ti union select distinct 'page:' || (doc_id % 30) from ti), p as (select {_PLACE} place from q) select place, row_number() over (order by not starts_with(place, 'page '), case when starts_with(place, 'page ') then cast(substring(place, 6) as int) else 0 end, place) n from p")
def place_listing(s, d):
    from pyspark.sql.window import Window

    t = _ti(s, d)
    p = t.select("place").union(t.select(F.concat(F.lit("page:"), (F.col("doc_id") % 30).cast("string")))).distinct().select(X.place_name(F.col("place")).alias("place"))
    return p.select("place", F.row_number().over(Window.orderBy(*X.place_order(F.col("place")))).cast("long").alias("n"))


@query()
def latinized(s, d):
    return _ti(s, d).where("lang <> 'en'").select("handle", X.latinize(F.col("plain")).alias("latin"), X.ascii_forms(F.col("plain")).alias("ascii"))


# ---------------------------------------------------------------- memory


_MEM = """seed as (select distinct text source, 'seed' target from documents where doc_id % 4 = 0), learned as (select text source, max('item ' || item_id) target from benchmark group by text),
mem as (select coalesce(l.source, s.source) source, coalesce(l.target, s.target) target from seed s full join learned l on s.source = l.source), seg as (select doc_id id, text source from documents)"""


def _memory(s, d):
    docs, bench = table(s, d, "documents"), table(s, d, "benchmark")
    seed = docs.where("doc_id % 4 = 0").select(F.col("text").alias("source"), F.lit("seed").alias("target")).distinct()
    learned = bench.select(F.col("text").alias("source"), F.concat(F.lit("item "), "item_id").alias("target"))
    return translation.layered(seed, learned), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source"))


@query(f"with {_MEM} select target, count(*) n from mem group by target")
def memory_layered(s, d):
    return _memory(s, d)[0].groupBy("target").agg(F.count("*").alias("n"))


@query(f"with {_MEM} select id, target from seg join mem using (source)")
def memory_hits(s, d):
    m, seg = _memory(s, d)
    return translation.hits(seg, m).select("id", "target")


@query(f"with {_MEM} select id from seg where source not in (select source from mem)")
def memory_misses(s, d):
    m, seg = _memory(s, d)
    return translation.misses(seg, m).select("id")


@query("with mem as (select text source, max(role) target from conversations where conv_id % 2 = 0 and trim(text) <> '' group by text), fresh as (select text source, max(upper(role)) target from conversations where conv_id % 2 is distinct from 0 and trim(text) <> '' group by text) select count(*) n from fresh left join mem using (source) where mem.target is distinct from fresh.target")
def memory_upsert_count(s, d):
    c, known = table(s, d, "conversations"), F.coalesce(F.col("conv_id") % 2 == 0, F.lit(False))
    mem = translation.learn(s.createDataFrame([], "source string, target string"), c.where(known).select(F.col("text").alias("source"), F.col("role").alias("target")))
    return translation.learned_count(mem, c.where(~known).select(F.col("text").alias("source"), F.upper("role").alias("target")))


# ---------------------------------------------------------------- review


_REV = """rv as (select d.doc_id id, source place, text source, case when d.doc_id % 11 = 0 then 'edited' when d.doc_id % 3 <> 0 then text else '' end target,
 coalesce(d.doc_id % 3 <> 0, false) ok, case when d.doc_id % 3 <> 0 and d.doc_id % 5 = 0 then 'from memory' else '' end note, case when n_chars > 4000 then 'overflow' when n_chars > 2000 then 'tight' else '' end fit,
 coalesce(l.quality = 1, false) approved, d.doc_id % 11 = 0 edited, case when d.doc_id % 13 = 0 then 0.9 when n_chars > 2000 then 0.8 else 1.0 end width_factor from documents d left join labels l on d.doc_id = l.doc_id)"""


def _review(s, d):
    docs, k = table(s, d, "documents"), F.col("doc_id")
    seg = docs.select(k.alias("id"), F.col("source").alias("place"), F.array("source").alias("places"), F.col("text").alias("source"))
    t = docs.where(k % 3 != 0).select(k.alias("id"), F.col("text").alias("target"), F.lit(True).alias("ok"), F.when(k % 5 == 0, "from memory").otherwise("").alias("note"))
    n = F.col("n_chars")
    f = docs.select(k.alias("id"), F.when(n > 4000, "overflow").when(n > 2000, "tight").otherwise("").alias("flag"), F.lit(1.0).alias("ratio"), F.when(n > 2000, 0.8).otherwise(1.0).alias("suggested_width_factor"))
    r = docs.join(table(s, d, "labels"), "doc_id", "left").select(k.alias("id"), F.when(k % 11 == 0, "edited").alias("text"), (F.col("quality") == 1).alias("approved"), F.when(k % 13 == 0, 0.9).alias("width_factor"))
    return review.review_table(seg, t, f, r), r


@query(f"with {_REV} select id, target, ok, note, fit, approved, edited, cast(width_factor as double) width_factor from rv")
def review_table(s, d):
    return _review(s, d)[0].select("id", "target", "ok", "note", "fit", "approved", "edited", "width_factor")


@query(f"with {_REV} select count(*) total, count(*) filter (approved) approved, count(*) filter (not ok) need_human, count(*) filter (fit <> '') to_check, count(*) filter (note = 'from memory') from_memory from rv")
def review_counts(s, d):
    return review.totals(_review(s, d)[0])


@query(f"with {_REV} select id from rv where not ok or fit in ('overflow', 'tight')")
def review_filter_attention(s, d):
    return review.needs_attention(_review(s, d)[0]).select("id")


@query(f"with {_REV} select count(*) n from rv where approved or ok")
def approve_all_ok(s, d):
    t, r = _review(s, d)
    return review.approve_all_ok(t, r).where("approved").agg(F.count("*").alias("n"))


@query(f"with {_REV} select source, target from rv where approved and trim(target) <> ''")
def remembered_pairs(s, d):
    return review.to_remember(_review(s, d)[0])


_CHECK = f"{_REV}, kinds as (select place, 'wider than the space' kind from rv where fit = 'overflow' union all select place, case when not approved then 'not approved, so left in the original language' else 'the model was unsure' end from rv where not approved or not ok)"


@query(f"with {_CHECK} select place, kind, count(*) n from kinds group by 1, 2")
def to_check_rollup(s, d):
    return review.to_check(_review(s, d)[0]).select("place", "kind", "n")


@query(f"with {_CHECK} select place, kind, count(*) n, greatest(count(*) - 4, 0) more from kinds group by 1, 2")
def report_sample(s, d):
    c = review.to_check(_review(s, d)[0])
    return c.join(review.report_lines(c), ["place", "kind"]).select("place", "kind", "n", F.coalesce(F.regexp_extract("line", r" and (\d+) more$", 1).try_cast("long"), F.lit(0)).alias("more"))


# ---------------------------------------------------------------- space


_W = f"{TI}, it as (select *, {M.em_width_sql('plain')} * height own_w from ti), m as (select *, greatest(own_w, height) w, x l, x + greatest(own_w, height) r, greatest(6 * greatest(own_w, height), 60 * height) reach from it where kind in ('TEXT', 'MTEXT', 'ATTRIB'))"
_NB = f"""{_W}, nb as (select a.job_id, a.place, a.handle, min(case when b.l - a.l >= 0.5 * a.height and b.l - a.l <= a.reach then b.l - a.l end) gap_r, min(case when a.r - b.r >= 0.5 * a.height and a.r - b.r <= a.reach then a.r - b.r end) gap_l
 from m a join m b on a.job_id = b.job_id and a.place = b.place and a.handle <> b.handle and abs(b.y - a.y) <= 3 * a.height and abs(b.y - a.y) < 0.7 * greatest(a.height, b.height) group by 1, 2, 3)"""
_WL = f"""wl0 as (select a.job_id, a.place, a.handle, max(case when rule.pos >= a.l + 0.3 * a.height and rule.pos < a.r - 0.3 * a.height then 1 else 0 end) crosses, min(case when rule.pos >= a.r - 0.3 * a.height and rule.pos - a.l <= a.reach then rule.pos - a.l end) wr, min(case when rule.pos < a.l + 0.3 * a.height and a.r - rule.pos <= a.reach then a.r - rule.pos end) wl
 from m a join rule on a.job_id = rule.job_id and a.place = rule.place and lo <= a.y + 1.2 * a.height and hi >= a.y - 0.2 * a.height group by 1, 2, 3), wl as (select job_id, place, handle, crosses = 1 crosses, case when crosses = 0 then wr end wall_r, case when crosses = 0 then wl end wall_l from wl0)"""


def _rules(s, d):
    return S.rules(table(s, d, "lineitem"))


@query(f"with {_NB} select handle, gap_r from nb where gap_r is not null")
def right_neighbour(s, d):
    return spatial.neighbours(_ti(s, d)).where("gap_r is not null").select("handle", "gap_r")


@query(f"with {_NB} select handle, gap_l from nb where gap_l is not null")
def left_neighbour(s, d):
    return spatial.neighbours(_ti(s, d)).where("gap_l is not null").select("handle", "gap_l")


@query(f"with {_W}, {RULE}, {_WL} select handle, wall_r, wall_l from wl where wall_r is not null or wall_l is not null")
def nearest_wall(s, d):
    return spatial.wall_gaps(_ti(s, d), _rules(s, d)).where("wall_r is not null or wall_l is not null").select("handle", "wall_r", "wall_l")


@query(f"with {_W}, {RULE}, {_WL} select handle from wl where crosses")
def crosses_wall(s, d):
    return spatial.wall_gaps(_ti(s, d), _rules(s, d)).where("crosses").select("handle")


_AV = f"{_NB}, {RULE}, {_WL}, av as (select m.handle, greatest(least(coalesce(gap_r, wall_r), coalesce(wall_r, gap_r)) - 0.3 * height, w) avail from m left join nb using (job_id, place, handle) left join wl using (job_id, place, handle) where coalesce(gap_r, wall_r) is not null)"


@query(f"with {_AV} select handle, avail from av")
def available_width(s, d):
    return spatial.available_widths(_ti(s, d), _rules(s, d)).select("handle", "avail")


@query(f"with {_W} select a.handle, greatest(min(a.y - (b.y + b.height)), 0.0) clear from it a join it b on a.job_id = b.job_id and a.place = b.place and a.handle <> b.handle and b.y < a.y - 1e-9 and b.x < a.x + a.own_w and b.x + b.own_w > a.x where a.own_w > 0 group by 1")
def clearance_below(s, d):
    return spatial.room_below(_ti(s, d)).select("handle", "clear")


@query(f"with {_AV} select it.handle, case when avail is not null then greatest(avail * 0.93 / (height * 1.0), {M.em_width_sql('plain')}) else {M.em_width_sql('plain')} * (case when lang = 'ja' then 2.4 else 1.4 end) end cap from it left join av on it.handle = av.handle")
def capacity_single(s, d):
    # Whole texts stay where they are: their widths, counted once, are joined.
    t = spatial.measured(_ti(s, d), "lang")
    av = spatial.available_widths(t, _rules(s, d)).select("handle", "avail")
    cap = segments.single_capacity(F.col("em"), F.col("lang"), F.col("height"), F.lit(1.0), F.col("avail"))
    return t.join(av, "handle", "left").select("handle", cap.alias("cap"))


_BOX = "box as (select * from (values (1, 0.0::double, 0.0::double, 5.0::double, 5.0::double), (2, 4.0::double, 4.0::double, 9.0::double, 9.0::double)) t(box, x0, y0, x1, y1))"


@query(f"with {_BOX}, p as (select c_custkey ord, 'A-' || (c_custkey % 100) number, cast(c_custkey % 10 as double) px, cast(c_nationkey % 10 as double) py from customer) select box, arg_max(number, (px - x0) / (x1 - x0) - (py - y0) / (y1 - y0) - ord * 1e-9) number from p join box on px between x0 and x1 and py between y0 and y1 group by box")
def sheet_number_topbox(s, d):
    boxes = s.createDataFrame([(1, 0.0, 0.0, 5.0, 5.0), (2, 4.0, 4.0, 9.0, 9.0)], "box int, x0 double, y0 double, x1 double, y1 double")
    c = table(s, d, "customer")
    p = c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit(" A - "), (F.col("c_custkey") % 100).cast("string")).alias("plain"), (F.col("c_custkey") % 10).cast("double").alias("x"), (F.col("c_nationkey") % 10).cast("double").alias("y"))
    return spatial.sheet_numbers(p, boxes)


def _points(s, d):
    return _ti(s, d).select("job_id", "place", (F.col("doc_id") * (1 << 32) + F.col("pos")).alias("node"), F.col("x").alias("px"), F.col("y").alias("py"))


_PTS = f"{TI}, pts as (select job_id, place, doc_id * 4294967296 + pos node, x px, y py from ti)"


@query(f"with recursive {_PTS}, {components_sql('30.0')} select node, label from labelled")
def sheet_clusters(s, d):
    return cluster.clusters(_points(s, d), 30.0).select("node", "label")


@query(f"with recursive {_PTS}, {components_sql('30.0')}, {merged_sql()} select job_id, place, box, x0, y0, x1, y1, n from mbox")
def merged_boxes(s, d):
    return cluster.merge_boxes(cluster.cluster_boxes(cluster.clusters(_points(s, d), 30.0))).select("job_id", "place", "box", "x0", "y0", "x1", "y1", "n")


@query(f"with {TI} select job_id, list_sort(list(x))[least(cast(floor(count(*) * 0.02) as bigint) + 1, count(*))] x_low, list_sort(list(x))[greatest(cast(floor(count(*) * 0.98) as bigint), 1)] x_high from ti group by job_id")
def trimmed_extent(s, d):
    g = _ti(s, d).groupBy("job_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("job_id", M.nearest_rank(F.col("xs"), 0.02).alias("x_low"), F.get("xs", F.greatest(F.floor(F.size("xs") * 0.98).cast("int") - 1, F.lit(0))).alias("x_high"))


@query(f"with {TI} select job_id, list_sort(list(height))[cast(floor(count(*) / 2) as bigint) + 1] height from ti group by job_id")
def upper_median(s, d):
    return _ti(s, d).groupBy("job_id").agg(M.upper_median(F.collect_list("height")).alias("height"))


_PI = f"pi as (select job_id, place, layer, handle, doc_id * 4294967296 + pos ord, plain, lang, height, x, y, {M.em_width_sql('plain')} * height w from ti where kind in ('TEXT', 'MTEXT'))"


@query(f"with recursive {TI}, {_PI}, {paragraph_sql('pi')} select handle, paragraph, line from para")
def paragraphs(s, d):
    return segments.paragraphs(_ord(_ti(s, d))).select("handle", "paragraph", "line")


# ---------------------------------------------------------------- fit, patch, verify


def _wrapped(s, d):
    c = table(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return fit.wrap_best(c.select("id", "text", F.array(F.lit(22.0), F.lit(24.0)).alias("caps"), F.array(F.lit(30.0), F.lit(30.0)).alias("caps_max"), F.lit(2).alias("max_lines"), (F.length("text") % 2).alias("spare")))


_WRAPPED = f"""with recursive cv as (select conv_id || ':' || turn id, text txt, [22.0::double, 24.0] caps, [30.0::double, 30.0] beside, 2 most, length(text) % 2 spare from conversations), {wrap_sql('cv')}"""


@query(f"{_WRAPPED} select f.id, coalesce((select string_agg(line, '|' order by n) from w_lines l where l.id = f.id), '') \"lines\", f.f wf, ovr \"over\" from w_fit f")
def greedy_wrap(s, d):
    return _wrapped(s, d).select("id", F.array_join("fit.lines", "|").alias("lines"), "fit.wf", "fit.over")


@query(f"{_WRAPPED} select case when ovr then 'overflow' when f < 0.85 then 'tight' when f < 1.0 then 'long' else 'ok' end flag, count(*) n from w_fit group by 1")
def fit_histogram(s, d):
    return fit.histogram(_wrapped(s, d).select(fit.flag(F.col("fit.over"), F.col("fit.wf")).alias("flag")))


def _run(s, d):
    none = s.createDataFrame([], "source string, target string")
    return pipeline.run_all(_ord(_ti(s, d)), _rules(s, d), none)


_CLEAR = "clr as (select a.handle, greatest(min(a.y - (b.y + b.height)), 0.0) clear from it a join it b on a.job_id = b.job_id and a.place = b.place and a.handle <> b.handle and b.y < a.y - 1e-9 and b.x < a.x + a.own_w and b.x + b.own_w > a.x where a.own_w > 0 group by 1)"


_CLEAR_FLOORS = "clr as (select handle, greatest(min(gap), 0.0) clear from (select a.handle, a.y - (b.y + b.height) gap from it a join it b on a.job_id = b.job_id and a.place = b.place and a.handle <> b.handle and b.y < a.y - 1e-9 and b.x < a.x + a.own_w and b.x + b.own_w > a.x where a.own_w > 0 union all select a.handle, a.y - f.pos from it a join flr f on a.job_id = f.job_id and a.place = f.place and f.pos < a.y - 1e-9 and f.lo < a.x + a.own_w and f.hi > a.x where a.own_w > 0) group by 1)"


def instances_sql(base: str, rules: str, wanted: str, floors: bool = False) -> str:
    """The run in DuckDB up to w_fit and w_lines, over a `ti`: base defines it, rules gives `rule`, wanted says what is translated; with floors, base has `flr`."""
    av = _AV.replace(TI, base).replace(RULE, rules)
    em, w = M.em_width_sql("plain"), "u.job_id = q.job_id and u.paragraph = q.paragraph"
    return f"""with recursive {av}, {_CLEAR_FLOORS if floors else _CLEAR}, ok_ as materialized (select *, row_number() over (order by ord_) ord from (select it.*, {'doc_id * 4294967296 + pos' if base == TI else 'ord'} ord_ from it where {wanted})),
pi as (select job_id, place, layer, handle, ord, plain, lang, height, x, y, own_w w from ok_ where kind in ('TEXT', 'MTEXT')), {paragraph_sql('pi')},
ln as materialized (select ok_.*, coalesce(paragraph, ok_.handle) paragraph, coalesce(line, 0) line from ok_ left join para on para.job_id = ok_.job_id and para.handle = ok_.handle),
un as (select job_id, paragraph, count(*) n_lines, max(height) height, arg_min(lang, line) lang, arg_min(ord, line) ord, case when count(*) = 1 then any_value(plain) when arg_min(lang, line) = 'ja' then string_agg(trim(plain), '' order by line) else string_agg(trim(plain), ' ' order by line) end plain from ln group by 1, 2),
sg as (select job_id, plain source, min(ord) first from un group by 1, 2), seg as (select *, job_id || '-s' || lpad(cast(row_number() over (partition by job_id order by first) as varchar), 5, '0') id from sg),
pc as (select job_id, paragraph, max(x + own_w) col, min(x) st, min(x + avail * 0.93) reserve, arg_min(height, line) scale from ln left join av using (handle) group by 1, 2),
rm as (select ln.*, n_lines, case when avail is not null then greatest(avail * 0.93 / (ln.height * 1.0), {em.replace('plain', 'ln.plain')}) else {em.replace('plain', 'ln.plain')} * (case when ln.lang = 'ja' then 2.4 else 1.4 end) end alone,
 greatest((least(col, coalesce(reserve, col + (col - st) * 0.2)) - ln.x) / scale, {em.replace('plain', 'ln.plain')}) p_cap, greatest((greatest(least(col, coalesce(reserve, col + (col - st) * 0.2)), coalesce(reserve, col + (col - st) * 0.2)) - ln.x) / scale, {em.replace('plain', 'ln.plain')}) cap_max,
 case when coalesce(clear, 0) > 0 then cast(greatest(0, least(2, floor((clear - 0.35 * ln.height) / (1.45 * ln.height)))) as int) else 0 end spare
 from ln join un on ln.job_id = un.job_id and ln.paragraph = un.paragraph join pc on pc.job_id = ln.job_id and pc.paragraph = ln.paragraph left join av on av.handle = ln.handle left join clr on clr.handle = ln.handle),
inst as materialized (select q.job_id, q.paragraph, list(q.handle order by line) hs, list(case when q.n_lines = 1 then alone else p_cap end order by line) caps, list(case when q.n_lines = 1 then alone else cap_max end order by line) beside, count(*) most, arg_max(spare, line) spare from rm q group by 1, 2),
wi as (select inst.paragraph id, '[EN]' || plain || '[/EN]' txt, caps, beside, cast(most as int) most, spare from inst join un using (job_id, paragraph)), {wrap_sql('wi')},
done as materialized (select seg.id, inst.*, un.plain, f, ovr from inst join un using (job_id, paragraph) join seg on seg.job_id = un.job_id and seg.source = un.plain join w_fit on w_fit.id = inst.paragraph)"""


_FITS = f"per as (select id, bool_or(ovr) ovr, min(f) wf, any_value(plain) plain from done group by 1) select id, case when ovr then 'overflow' when wf < 0.85 then 'tight' when wf < 1.0 then 'long' else '' end flag, wf suggested_width_factor, {M.em_width_sql(chr(40) + chr(39) + '[EN]' + chr(39) + ' || plain || ' + chr(39) + '[/EN]' + chr(39) + chr(41))} / {M.em_width_sql('plain')} ratio from per"
_PLAN = """rows_ as (select done.*, u.n from done, lateral (select unnest(range(1, greatest(len(hs), (select max(n) from w_lines l where l.id = done.paragraph)) + 1)) as n) u)
select r.id, r.paragraph inst, it.handle, case when n > len(hs) then 'insert' else 'update' end "action", coalesce((select line from w_lines l where l.id = r.paragraph and l.n = r.n), '') new_text, f width_mult, it.y - 1.45 * it.height * greatest(n - len(hs), 0) y
 from rows_ r join it on it.handle = r.hs[least(n, len(hs))] where n <= len(hs) or it.kind = 'TEXT'"""
_INST = instances_sql(TI, RULE, _OK)


@query(f"{_INST}, {_FITS}")
def fit_flags(s, d):
    return _run(s, d).fits.select("id", "flag", "suggested_width_factor", "ratio")


@query(f"{_INST}, {_PLAN}")
def patch_plan(s, d):
    return _run(s, d).plan


_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query("with m as (select count(*) n, count(*) filter (l_orderkey % 1000 = 0) moved from lineitem) select moved = 0 ok, case when moved > 0 then 'geometry moved' else '' end problems, n from m")
def verify_report(s, d):
    before = table(s, d, "lineitem").select(*_COLS)
    moved = before.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    a, b = review.fingerprint(before, _COLS), review.fingerprint(moved, _COLS)
    return review.verify(a, b, 3, 4, added=1).join(a.select("n"), F.lit(True)).select("ok", F.array_join("problems", "; ").alias("problems"), "n")


@query(f"with a as (select {', '.join(_COLS)} from lineitem), b as (select {', '.join(_COLS)} from lineitem order by l_partkey) select (select count(*) from (select * from a except all select * from b)) = 0 and (select count(*) from (select * from b except all select * from a)) = 0 same, (select count(*) from a) n")
def fingerprint_equal(s, d):
    li = table(s, d, "lineitem").select(*_COLS)
    a, b = review.fingerprint(li, _COLS), review.fingerprint(li.repartition(7), _COLS)
    return a.join(b.select(F.col("h_sum").alias("s2"), F.col("h_xor").alias("x2")), F.lit(True)).select(((F.col("h_sum") == F.col("s2")) & (F.col("h_xor") == F.col("x2"))).alias("same"), "n")


# ---------------------------------------------------------------- jobs and spending


_COST = f"{USAGE}, cost as (select u.*, (input * coalesce(p.p_in, 1.0) + output * coalesce(p.p_out, 5.0)) / 1e6 usd from usage u left join pricing p on u.model = p.model and p.model <> 'default')"


def _cost(s, d):
    return jobs.priced(S.usage(table(s, d, "events")), S.pricing(s))


_MU = "cast(round({0} * 1e6) as bigint)"


def _micro(c):
    """Sums of doubles depend on their order; millionths as integers do not."""
    return F.round(F.col(c) * 1e6).cast("long").alias(c)


@query(f"""with {_COST}, nw as (select max("at") n from cost) select {_MU.format('sum(usd)')} all_usd, {_MU.format('''coalesce(sum(usd) filter (date_trunc('month', "at") = date_trunc('month', n)), 0)''')} month_usd, {_MU.format('''coalesce(sum(usd) filter (date_trunc('day', "at") = date_trunc('day', n)), 0)''')} today_usd, cast(sum(input) as bigint) tokens_in, cast(sum(output) as bigint) tokens_out, count(distinct job_id) jobs from cost, nw""")
def spend_totals(s, d):
    """In all, in the month and on the day of the last use."""
    cost = _cost(s, d)
    last = cost.join(F.broadcast(cost.agg(F.max("at").alias("now"))), F.lit(True))  # one row
    return jobs.spend_totals(last, F.col("now")).select(_micro("all_usd"), _micro("month_usd"), _micro("today_usd"), "tokens_in", "tokens_out", "jobs")


@query(f"with {_COST} select job_id, {_MU.format('sum(usd)')} usd, cast(sum(input) as bigint) tokens_in, cast(sum(output) as bigint) tokens_out from cost group by job_id")
def spend_per_job(s, d):
    return jobs.spend_per_job(_cost(s, d)).select("job_id", _micro("usd"), "tokens_in", "tokens_out")


@query(f"""with {_COST} select strftime("at", '%Y-%m') as month, strftime("at", '%Y-%m-%d') as day, {_MU.format('sum(usd)')} usd, count(*) n from cost group by rollup (1, 2)""".replace("rollup (1, 2)", """rollup (strftime("at", '%Y-%m'), strftime("at", '%Y-%m-%d'))"""))
def spend_by_day_rollup(s, d):
    return jobs.spend_rollup(_cost(s, d)).select("month", "day", _micro("usd"), "n")


@query(f"""with {_COST} select strftime("at", '%Y-%m-%d') as day, {_MU.format('sum(usd)')} usd, count(*) n from cost group by 1""".replace("group by 1", """group by strftime("at", '%Y-%m-%d')"""))
def daily_spend(s, d):
    return spend.daily_spend(S.usage(table(s, d, "events")), S.pricing(s)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), _micro("usd"), "n")


@query("select event_id, value from events where value is not null order by value, event_id limit 8")
def worst_k(s, d):
    e = table(s, d, "events").where("value is not null").select(F.col("event_id").alias("id"), F.lit("tight").alias("flag"), F.col("value").alias("suggested_width_factor"))
    return fit.worst(e).select(F.col("id").alias("event_id"), F.col("suggested_width_factor").alias("value"))


_JOBS = "jb as (select o_orderkey id, case when o_custkey % 7 = 0 then ' ' else c_mktsegment end client, o_orderpriority project, case o_orderstatus when 'P' then 'running' else 'done' end status from orders join customer on o_custkey = c_custkey)"


def _jobs(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.col("c_mktsegment")).alias("client"), F.col("o_orderpriority").alias("project"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))


@query(f"with {_JOBS} select coalesce(nullif(trim(client), ''), 'Unfiled') client, project, count(*) n from jb group by 1, 2")
def folder_counts(s, d):
    return jobs.folders(_jobs(s, d))


@query(f"with {_JOBS}, k as (select id, coalesce(nullif(trim(client), ''), 'Unfiled') || (id % 997) client, status from jb) select id, client from k where client in ('AUTOMOBILE129', 'AUTOMOBILE142', 'AUTOMOBILE104') and client not in (select client from k where status = 'running')")
def folder_delete(s, d):
    """Folders with a running job keep all of theirs; the others go."""
    j = _jobs(s, d).withColumn("client", F.concat(F.coalesce(F.nullif(F.trim("client"), F.lit("")), F.lit("Unfiled")), (F.col("id") % 997).cast("string")))
    return jobs.deletable(j, "AUTOMOBILE129").union(jobs.deletable(j, "AUTOMOBILE142")).union(jobs.deletable(j, "AUTOMOBILE104")).select("id", "client")


@query(f"with {_JOBS} select id, coalesce(case when id % 5 = 0 then 'Moved' end, client) client, project from jb")
def default_coalesce(s, d):
    j = _jobs(s, d)
    return jobs.update_job(j, j.select("id", F.when(F.col("id") % 5 == 0, "Moved").otherwise(" ").alias("client"), F.lit("").alias("project"))).select("id", "client", "project")


@query(f"with {_JOBS} select id, case when status = 'running' then 'running' else 'idle' end state from jb")
def job_listing(s, d):
    j = _jobs(s, d)
    return jobs.listing(j, j.where("status = 'running'").select("id", F.lit("running").alias("state"))).select("id", "state")


def queries() -> dict[str, Query]:
    from . import drawing_queries, drawing_runs  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
