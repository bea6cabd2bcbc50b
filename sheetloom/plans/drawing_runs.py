"""Queries that carry whole drawings through: entities to entities, derived from orders, customers and rules of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom import schema
from sheetloom.operators import apply, jobs, outputs, sheets, spatial
from sheetloom.sources import entities as E
from sheetloom.sources import stages
from sheetloom.sources import tables as S
from sheetloom.sources import tagstream as T_
from sheetloom.sources.stages import checkpointed
from sheetloom.sources.tables import USAGE_SQL, table
from sheetloom.streaming import spend

from . import pipeline
from .drawing_queries import _LANG, _PP, _WANTED, _lines, _pick, _sql_list, grown_sql
from .queries import instances_sql
from .registry import query
from .shape_sql import components_sql, merged_sql

# ---------------------------------------------------------------- a drawing carried to its end

#: Of orders, what an entity is; the kind of its item, and what the item's handle has behind the entity's.
DRAWN = ["TEXT", "TEXT", "TEXT", "MTEXT", "INSERT", "TEXT", "DIMENSION", "ACAD_TABLE", "TEXT", "TEXT", "TEXT"]
_KIND = {"INSERT": "ATTRIB", "ACAD_TABLE": "TABLE_CELL"}
_BEHIND = {"INSERT": ":T", "ACAD_TABLE": ":1"}
_N = len(DRAWN)
_STYLES = ["st0", "st1"]


def drawn(s, d) -> DataFrame:
    """Entities of 40 jobs: a text an order, an upright or a level line a customer."""
    k = F.col("ord")
    type_ = _pick(DRAWN, F.floor(k / 2) % _N)
    lines = _lines(s, d)
    texts = lines.select(
        "job_id", F.col("place").alias("space"), "ord", type_.alias("type"), "handle", "layer", _pick(_STYLES, k % 2).alias("style"), F.when(type_.isin("INSERT", "ACAD_TABLE"), None).otherwise(F.col("plain")).alias("text"), F.lit(0).alias("flags"), "height", "x", "y",
        F.when(type_ == "INSERT", F.array(F.struct(F.lit("T").alias("tag"), F.col("plain").alias("text")), F.struct(F.lit("U").alias("tag"), F.lit("7").alias("text")))).alias("attribs"),
        F.when(type_ == "ACAD_TABLE", F.array(F.lit(""), F.col("plain"))).alias("cells"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("vertices"), F.lit(False).alias("closed"),
    )
    c = F.col("c_custkey")
    x, y = (c % 50 * 3.0).cast("double"), (-(c % 61) * 2.0 - 0.5).cast("double")
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ends = F.when(c % 2 == 0, F.array(point(x, y), point(x, y + 6))).otherwise(F.array(point(x, y), point(x + 30, y)))
    rules = table(s, d, "customer").select((c % 40).alias("job_id"), F.lit("model").alias("space"), (F.lit(1 << 40) + c).alias("ord"), F.lit("LINE").alias("type"), F.concat(F.lit("c"), c.cast("string")).alias("handle"), F.lit("r").alias("layer"), F.lit("").alias("style"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("flags"), F.lit(0.0).alias("height"), x.alias("x"), y.alias("y"), F.lit(None).cast(texts.schema["attribs"].dataType).alias("attribs"), F.lit(None).cast("array<string>").alias("cells"), ends.alias("vertices"), F.lit(False).alias("closed"))
    return texts.unionByName(rules)


def carried(s, d) -> pipeline.Finished:
    fonts = s.range(40).select(F.col("id").alias("job_id"), F.explode(F.array(F.struct(F.lit("st0").alias("style"), F.lit("arial").alias("font")), F.struct(F.lit("st1").alias("style"), F.lit("MS Gothic").alias("font")))).alias("f")).select("job_id", "f.*")
    return pipeline.run_drawing(drawn(s, d), s.createDataFrame([], "source string, target string"), fonts, fine=["gothic"])


def _case(values: dict[str, str], key: str, other: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + f" else {other} end"


_TYPE = f"{_sql_list(DRAWN)}[(ord // 2) % {_N} + 1]"
_BASE = _PP.partition(",\npi as")[0]
_DRAWN = f"""{_BASE},
en as (select pq.* exclude (lang, handle), handle || {_case(_BEHIND, _TYPE, "''")} handle, handle entity, {_TYPE} type, {_case(_KIND, _TYPE, _TYPE)} kind, {_LANG.format('plain')} lang from pq),
ru_ as (select c_custkey % 40 job_id, 'model' place, c_custkey c, (c_custkey % 50) * 3.0::double x, -(c_custkey % 61) * 2.0::double - 0.5 y from customer),
flr as (select job_id, place, y pos, x lo, x + 30 hi from ru_ where c % 2 = 1), ti as (select * from en)"""
_RULES = "rule as (select job_id, place, x pos, y lo, y + 6 hi from ru_ where c % 2 = 0)"
# What stands below is the next text or the next level line.
_UP_TO_DONE = instances_sql(_DRAWN, _RULES, _WANTED, floors=True)
_AFTER = rf"""rows_ as (select done.*, u.n from done, lateral (select unnest(range(1, greatest(len(hs), (select max(n) from w_lines l where l.id = done.paragraph)) + 1)) as n) u),
pl0 as (select it.job_id, it.handle, it.kind, it.ord, greatest(n - len(hs), 0) added, it.y - 1.45 * it.height * greatest(n - len(hs), 0) y, case when it.kind in ('DIMENSION', 'TABLE_CELL') then 1.0 else f end mult,
 case when it.kind in ('DIMENSION', 'TABLE_CELL') or (it.kind = 'MTEXT' and len(hs) = 1) then '[EN]' || r.plain || '[/EN]' else coalesce((select line from w_lines l where l.id = r.paragraph and l.n = r.n), '') end t
 from rows_ r join it on it.handle = r.hs[least(n, len(hs))] where n <= len(hs) or it.kind = 'TEXT'),
pl1 as (select *, case when ord % 2 = 1 then t else translate(t, '１２', '12') end t1 from pl0),
pl2 as (select *, regexp_extract(t1, '^(.*?[^ ])( {{3,}})(.*)$', 1) head, regexp_extract(t1, '^(.*?[^ ])( {{3,}})(.*)$', 2) gap, regexp_extract(t1, '^(.*?[^ ])( {{3,}})(.*)$', 3) tail from pl1),
pl3 as (select *, case when gap = '' or abs(mult - 1) <= 0.01 then t1 else head || repeat(' ', cast(ceil((length(head) + length(gap)) / mult) as int) - length(head)) || tail end t2 from pl2),
pl as (select *, case when kind in ('MTEXT', 'TABLE_CELL') and abs(mult - 1) > 0.01 then '\W' || regexp_replace(printf('%.4f', mult), '\.?0+$', '') || ';' || t2 else t2 end written, case when kind in ('MTEXT', 'TABLE_CELL') then 1.0 else mult end width from pl3)"""


@query(rf"""{_UP_TO_DONE}, {_AFTER}
select en.job_id, en.entity || case when coalesce(added, 0) > 0 then '+' || added else '' end handle, type, case when type in ('INSERT', 'ACAD_TABLE') then '' else coalesce(written, en.plain) end body, case type when 'INSERT' then 'T=' || coalesce(written, en.plain) || ';U=7' when 'ACAD_TABLE' then '=;=' || coalesce(written, en.plain) else '' end parts, coalesce(pl.y, en.y) y, case when type in ('INSERT', 'ACAD_TABLE') then null else width end width_factor, cast(coalesce(added, 0) as int) added from en left join pl on pl.handle = en.handle
union all select job_id, 'c' || c, 'LINE', '', '', y, null, 0 from ru_""")
def drawing_written(s, d):
    """Every entity of the drawings after the run: texts of all kinds, attributes and cells written, lines inserted."""
    a = carried(s, d).after
    parts = F.coalesce(F.array_join(F.transform("attribs", lambda p: F.concat(p["tag"], F.lit("="), p["text"])), ";"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("="), c)), ";"), F.lit(""))
    return a.select("job_id", "handle", "type", F.coalesce("text", F.lit("")).alias("body"), parts.alias("parts"), "y", "width_factor", "added")


@query(rf"""{_UP_TO_DONE}, {_AFTER}, jb as (select job_id, cast(count(*) filter (type in ('TEXT', 'MTEXT')) as bigint) texts from en group by 1), nw as (select job_id, count(*) n from pl where added > 0 group by 1),
ln_ as (select job_id, count(*) lines from ru_ group by 1), tx as (select job_id, count(*) filter (type in ('INSERT', 'DIMENSION', 'ACAD_TABLE')) solid from en group by 1),
j as (select jb.job_id, coalesce(n, 0) new_lines, coalesce(lines, 0) lines, solid from jb left join nw using (job_id) left join ln_ using (job_id) left join tx using (job_id))
select 'as written' "case", job_id, true ok, '' problems, new_lines from j union all select 'moved', job_id, lines = 0, case when lines > 0 then 'geometry changed' else '' end, new_lines from j
union all select 'lost a line', job_id, new_lines = 0, case when new_lines > 0 then 'texts: 0 more, ' || new_lines || ' expected' else '' end, new_lines from j
union all select 'lost the rules', job_id, lines = 0, case when lines > 0 then 'entities: ' || (solid + lines) || ' before, ' || solid || ' after; geometry changed' else '' end, new_lines from j""")
def drawing_verified(s, d):
    """Each job's verdict on the real entities before and after; on the same with rules moved, inserted lines lost, and rules lost."""
    done = carried(s, d)
    before, after = checkpointed(drawn(s, d)), done.after
    moved = after.withColumn("vertices", F.transform("vertices", lambda v: F.struct((v["x"] + 0.25).alias("x"), v["y"].alias("y"))))
    # The lines are gone, yet the plan says that they were put in: only the counts can tell.
    lost = after.withColumn("type", F.when(F.col("added") > 0, "ATTDEF").otherwise(F.col("type")))
    new = after.groupBy("job_id").agg(F.count_if(F.col("added") > 0).alias("planned"))
    cases = {"as written": apply.verified(before, after), "moved": apply.verified(before, moved), "lost a line": apply.verified(before, lost, new), "lost the rules": apply.verified(before, after.where("type <> 'LINE'"))}
    out = None
    for name, v in cases.items():
        one = v.select(F.lit(name).alias("case"), "job_id", "ok", F.array_join("problems", "; ").alias("problems"), "new_lines")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- references

_TURNS, _SCALES = [0.0, 90.0, 180.0, 270.0, 30.0], [1.0, 2.0, -1.0, 0.5]
_REFS = f"""rf as (select o_orderkey // 400 job_id, case when o_orderkey % 3 = 0 then 'model' else 'block:b' || ((o_orderkey // 3) % 6) end space, o_orderkey ord, o_orderkey k, (o_orderkey % 97)::double x, (o_custkey % 89)::double y, (o_orderkey // 5) % 6 to_, (o_orderkey // 2) % 7 sort,
 {_sql_list([str(t) for t in _TURNS])}[(o_orderkey // 7) % 5 + 1]::double turn, {_sql_list([str(x) for x in _SCALES])}[(o_orderkey // 11) % 4 + 1]::double sx, {_sql_list([str(x) for x in _SCALES])}[(o_orderkey // 13) % 4 + 1]::double sy from orders)"""


def referring(s, d) -> DataFrame:
    """Entities, 400 orders a job, in model space and six blocks that refer to each other: a seventh references, the others upright lines and closed boxes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    num = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    is_ref = F.floor(k / 2) % 7 == 0
    x, y = (k % 97).cast("double"), (c % 89).cast("double")
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    box = F.array(point(0, 0), point(7, 0), point(7, 3), point(0, 3))
    return table(s, d, "orders").select(
        F.floor(k / 400).cast("long").alias("job_id"), F.when(k % 3 == 0, "model").otherwise(F.concat(F.lit("block:b"), (F.floor(k / 3) % 6).cast("string"))).alias("space"), k.alias("ord"), F.when(is_ref, "INSERT").when(k % 2 == 0, "LINE").otherwise("LWPOLYLINE").alias("type"),
        F.when(is_ref, F.concat(F.lit("b"), (F.floor(k / 5) % 6).cast("string"))).alias("block"), x.alias("x"), y.alias("y"), num(_SCALES, F.floor(k / 11) % 4).alias("xscale"), num(_SCALES, F.floor(k / 13) % 4).alias("yscale"), num(_TURNS, F.floor(k / 7) % 5).alias("rotation"),
        F.when(~is_ref, F.when(k % 2 == 0, F.array(point(0, 0), point(0, 11))).otherwise(box)).alias("vertices"), (k % 2 == 1).alias("closed"),
    )


# A block's base point is its number by minus its number.
_REF_SQL = rf"""with recursive {_REFS}, r0 as (select job_id, space, ord, 'b' || to_ name, x, y, case when turn = 30 then cos(radians(30.0)) when turn = 0 then 1.0 when turn = 180 then -1.0 else 0.0 end co, case when turn = 30 then sin(radians(30.0)) when turn = 90 then 1.0 when turn = 270 then -1.0 else 0.0 end si, sx, sy, to_::double ux, -(to_::double) uy from rf where sort = 0),
r1 as (select job_id, space, ord, name, co * sx a, si * sx b, -si * sy c, co * sy d, x, y, ux, uy from r0), r2 as (select job_id, space, ord, name, a, b, c, d, x - (a * ux + c * uy) e, y - (b * ux + d * uy) f from r1),
at_(job_id, place, ord, name, way, level, a, b, c, d, e, f) as (select job_id, space, ord, name, [name], 1, a, b, c, d, e, f from r2 where space <> 'block:' || name union all
 select m.job_id, m.place, m.ord, i.name, list_append(way, i.name), level + 1, m.a * i.a + m.c * i.b, m.b * i.a + m.d * i.b, m.a * i.c + m.c * i.d, m.b * i.c + m.d * i.d, m.a * i.e + m.c * i.f + m.e, m.b * i.e + m.d * i.f + m.f
 from at_ m join r2 i on i.job_id = m.job_id and i.space = 'block:' || m.name where level < 2 and not list_contains(way, i.name) and m.place <> 'block:' || i.name),
eg as (select job_id, space, u.n, ord, case when k % 2 = 0 then x else x + [0, 7, 7, 0][u.n + 1] end x0, case when k % 2 = 0 then y else y + [0, 0, 3, 3][u.n + 1] end y0, case when k % 2 = 0 then x else x + [7, 7, 0, 0][u.n + 1] end x1, case when k % 2 = 0 then y + 11 else y + [0, 3, 3, 0][u.n + 1] end y1 from rf, lateral (select unnest(range(0, case when k % 2 = 0 then 1 else 4 end)) as n) u where sort <> 0),
pl as (select job_id, space place, 0 level, x0, y0, x1, y1 from eg union all select a.job_id, place, level, a.a * x0 + a.c * y0 + a.e, a.b * x0 + a.d * y0 + a.f, a.a * x1 + a.c * y1 + a.e, a.b * x1 + a.d * y1 + a.f from eg join at_ a on a.job_id = eg.job_id and eg.space = 'block:' || a.name)"""


@query(f"{_REF_SQL} select job_id, place, count(*) n, round(sum(x0), 3) pos, round(sum(greatest(y0, y1) - least(y0, y1)), 3) length from pl where abs(x1 - x0) <= 0.01 * greatest(abs(y1 - y0), 1e-9) group by 1, 2")
def block_rules(s, d):
    """Upright rules of every space, with those that references put there through two levels."""
    bases = referring(s, d).select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("job_id", F.concat(F.lit("b"), "n").alias("name"), F.col("n").cast("double").alias("bx"), (-F.col("n")).cast("double").alias("by"))
    r = E.rule_lines(referring(s, d), bases=bases)
    return r.groupBy("job_id", "place").agg(F.count("*").alias("n"), F.round(F.sum("pos"), 3).alias("pos"), F.round(F.sum(F.col("hi") - F.col("lo")), 3).alias("length"))


# ---------------------------------------------------------------- tag streams

_TAGGED = f"""{_DRAWN.partition('ru_ as')[0]} tg as (select job_id, entity handle, type, plain, kind, y, ord % 53 = 0 and type not in ('INSERT', 'ACAD_TABLE') bad from en),
cu as (select c_custkey % 40 job_id, 'c' || c_custkey handle from customer)"""


def tagged(s, d) -> str:
    """The drawings as tag files in the session's shared folder; every 53rd text has a height that is no number."""
    path = stages.scratch(s, "tags")
    e = drawn(s, d)
    T_.write_tags(e.withColumn("height", F.when((F.col("ord") % 53 == 0) & F.col("type").isin("TEXT", "MTEXT", "DIMENSION"), F.concat(F.lit("x"), F.col("height"))).otherwise(F.col("height").cast("string"))), path)
    return path


@query(f"with {_TAGGED} select job_id, handle, type, case when type in ('INSERT', 'ACAD_TABLE') then '' else plain end body, case type when 'INSERT' then 'T=' || plain || ';U=7' when 'ACAD_TABLE' then '=;=' || plain else '' end parts, bad from tg union all select job_id, handle, 'LINE', '', '', false from cu")
def tag_entities(s, d):
    """Entities written as tag files and read again in splits of 20,000 bytes: all columns of each, bad records marked."""
    e = T_.entities(T_.read_tags(s, tagged(s, d), split_bytes=20_000))
    parts = F.coalesce(F.array_join(F.transform("attribs", lambda p: F.concat(p["tag"], F.lit("="), p["text"])), ";"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("="), c)), ";"), F.lit(""))
    return e.select("job_id", "handle", "type", F.coalesce("text", F.lit("")).alias("body"), parts.alias("parts"), F.col("bad").isNotNull().alias("bad"))


@query(f"with {_TAGGED}, n as (select job_id, count(*) + count(*) filter (type = 'INSERT') * 2 n, count(*) filter (bad) errors from tg group by 1), c as (select job_id, count(*) n from cu group by 1) select n.job_id, n.n + coalesce(c.n, 0) + 1 records, errors from n left join c using (job_id)")
def tag_errors(s, d):
    """The audit of each drawing: its records (spaces and attributes too), and those that are malformed."""
    found = T_.error_count(T_.read_tags(s, tagged(s, d), split_bytes=7_000, schema="file string, height double, _corrupt_record string"))
    return found.groupBy(F.regexp_extract("file", r"job_id=(\d+)", 1).cast("long").alias("job_id")).agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))


@query(f"with {_TAGGED}, z as (select handle, type, case when type = 'MTEXT' or kind in ('ATTRIB', 'TABLE_CELL', 'TEXT', 'DIMENSION') then plain end p, kind, bad, ord from (select tg.*, cast(substr(handle, 2) as bigint) ord from tg))\nselect handle || case kind when 'ATTRIB' then ':T' when 'TABLE_CELL' then ':1' else '' end handle, kind, p plain from z where not bad and trim(p) <> '' union all select handle || ':U', 'ATTRIB', '7' from z where kind = 'ATTRIB' union all select handle, type, '[unreadable: ' || case when type in ('TEXT', 'MTEXT') then 'height is not a number; ' else '' end || 'malformed record]' from z where bad")
def tolerant_items(s, d):
    """Text items of drawings read from tag files: an entity that cannot be read is one marked row, and the scan goes on."""
    found = T_.entities(T_.read_tags(s, tagged(s, d), split_bytes=50_000))
    return E.items(found, tolerant=True).select("handle", "kind", "plain")


@query("select c_custkey % 40 job_id, 'c' || c_custkey handle, c_custkey % 50 * 3.0::double x0, case when c_custkey % 2 = 0 then c_custkey % 50 * 3.0::double else c_custkey % 50 * 3.0::double + 30 end x1 from customer")
def tag_lines_alone(s, d):
    """The lines of tag files alone: one type and three columns are parsed."""
    found = T_.read_tags(s, tagged(s, d), split_bytes=30_000, schema=f"file string, handle string, vertices {T_.POINTS}", only={"type": ["LINE"]})
    return found.select(F.regexp_extract("file", r"job_id=(\d+)", 1).cast("long").alias("job_id"), "handle", F.col("vertices")[0]["x"].alias("x0"), F.col("vertices")[1]["x"].alias("x1"))


# ---------------------------------------------------------------- sheets

_SHEET_ITEMS = """si as (select o_custkey % 12 job_id, o_orderkey ord, 'h' || o_orderkey handle, ((o_orderkey // 4) % 6) sh, case when (o_orderkey // 4) % 97 = 0 then 40.0::double else 2.5::double + (o_orderkey % 3) * 0.5::double end height,
 (((o_orderkey // 4) % 3) * (600.0::double + (o_custkey % 12) * 40) + (o_orderkey % 40) * 4.0::double) * (case when o_custkey % 12 = 11 then 60.0::double else 1.0::double end) x, ((((o_orderkey // 4) % 6) // 3) * 700.0::double + (o_custkey % 30) * 5.0::double) * (case when o_custkey % 12 = 11 then 60.0::double else 1.0::double end) y from orders)"""


def _sheet_items(s, d) -> DataFrame:
    """Texts of 12 jobs in six places each, spread differently; those of the last job lie far apart."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = F.floor(k / 4)
    wide = F.when(c % 12 == 11, 60.0).otherwise(1.0)
    return table(s, d, "orders").select((c % 12).alias("job_id"), k.alias("ord"), F.concat(F.lit("h"), k.cast("string")).alias("handle"), F.lit("model").alias("place"), F.lit("TEXT").alias("kind"), F.when(q % 97 == 0, 40.0).otherwise(2.5 + (k % 3) * 0.5).alias("height"), (((q % 3) * (600.0 + (c % 12) * 40) + (k % 40) * 4.0) * wide).alias("x"), ((F.floor(q % 6 / 3) * 700.0 + (c % 30) * 5.0) * wide).alias("y"))


@query(f"""with recursive {_SHEET_ITEMS}, pts as (select job_id, 'model' place, job_id || '|' || handle node, x px, y py, height from si),
so as (select job_id, count(*) n, list_sort(list(height)) hs, list_sort(list(px)) xs, list_sort(list(py)) ys from pts group by 1 having count(*) > 1),
sc as materialized (select job_id, hs[n // 2 + 1] h, greatest(xs[cast(greatest(floor(n * 0.98::double) - 1, 0) as bigint) + 1] - xs[cast(floor(n * 0.02::double) as bigint) + 1], ys[cast(greatest(floor(n * 0.98::double) - 1, 0) as bigint) + 1] - ys[cast(floor(n * 0.02::double) as bigint) + 1], 1.0) extent from so),
gp as materialized (select *, greatest(25 * h, 0.015::double * extent) gap from sc), {components_sql('(select gap from gp where gp.job_id = a.job_id)')}, {merged_sql(5)},
sg as (select a.job_id, a.box, min(case when b.y0 <= a.y1 and b.y1 >= a.y0 and b.x0 - a.x1 >= 0 then b.x0 - a.x1 end) rgt, min(case when b.y0 <= a.y1 and b.y1 >= a.y0 and a.x0 - b.x1 >= 0 then a.x0 - b.x1 end) lft,
 min(case when b.x0 <= a.x1 and b.x1 >= a.x0 and b.y0 - a.y1 >= 0 then b.y0 - a.y1 end) abv, min(case when b.x0 <= a.x1 and b.x1 >= a.x0 and a.y0 - b.y1 >= 0 then a.y0 - b.y1 end) blw from mbox a left join mbox b on a.job_id = b.job_id and a.box <> b.box group by 1, 2),
{grown_sql('mbox', 'sg', 'sc')} select gs.job_id, cast(row_number() over (partition by gs.job_id order by -round_even(gs.y1 / (0.15::double * extent), 0), gs.x0, gs.y0, gs.box) as int) nth, gs.x0, gs.y0, gs.x1, gs.y1, n from gs join sc using (job_id) join mbox using (job_id, box)""")
def sheets_discovered(s, d):
    """Sheets of every job from where its texts stand, through all steps in one plan."""
    return sheets.discovered(_sheet_items(s, d))


_FRAMES = "fr as (select c_custkey % 12 job_id, c_custkey box, case when c_custkey % 12 < 8 then ['A', 'B'][c_custkey % 2 + 1] || '-' || (c_custkey % 40) else case when c_custkey % 5 = 0 then '' else 'A-1' end end nm, (c_custkey % 9) * 130.0::double x0, (c_custkey // 9 % 8) * 110.0::double y0 from customer)"


@query(f"""with recursive {_SHEET_ITEMS}, {_FRAMES}, pd as (select job_id, 0.02::double * min(greatest(110.0 + box % 4, 85.0)) pad from fr group by 1), f as (select fr.*, x0 - pad wx0, y0 - pad wy0, x0 + 110 + box % 4 + pad wx1, y0 + 85 + pad wy1 from fr join pd using (job_id)),
t as (select f.job_id, box, s.y py, s.height h, row_number() over (partition by f.job_id, box order by s.ord) i from f join si s on s.job_id = f.job_id and s.x between wx0 and wx1),
w(job_id, box, i, lo, hi) as (select job_id, box, 0::bigint, wy0, wy1 from f union all select w.job_id, w.box, t.i, case when t.py between lo and hi then least(lo, t.py - 0.25::double * t.h) else lo end, case when t.py between lo and hi then greatest(hi, t.py + 1.25::double * t.h) else hi end from w join t on t.job_id = w.job_id and t.box = w.box and t.i = w.i + 1),
z as (select job_id, box, min(lo) y0, max(hi) y1 from w group by 1, 2), o as (select z.*, nm, wx0 x0, wx1 x1, max(z.y1 - z.y0) over (partition by z.job_id) tall, min(case when nm <> '' then 1 else 0 end) over (partition by z.job_id) = 1 named from z join f using (job_id, box))
select job_id, cast(row_number() over (partition by job_id order by case when named then string_split(nm, '-')[1] end nulls first, case when named then cast(string_split(nm, '-')[2] as bigint) end nulls first, case when not named then -round_even(y1 / greatest(tall * 0.5::double, 1.0), 0) end nulls first, case when not named then x0 end nulls first, box) as int) nth, nm "name", x0, y0, x1, y1 from o""")
def sheets_framed(s, d):
    """Stated frames as windows, stretched over the texts that begin in them, in the order of their numbers or of their rows."""
    c = F.col("c_custkey")
    x, y = ((c % 9) * 130.0).cast("double"), (F.floor(c / 9) % 8 * 110.0).cast("double")
    name = F.when(c % 12 < 8, F.concat(_pick(["A", "B"], c % 2), F.lit("-"), (c % 40).cast("string"))).when(c % 5 == 0, "").otherwise("A-1")
    frames = table(s, d, "customer").select((c % 12).alias("job_id"), c.alias("box"), name.alias("name"), x.alias("x0"), y.alias("y0"), (x + 110 + c % 4).alias("x1"), (y + 85).alias("y1"))
    return sheets.framed(frames, _sheet_items(s, d))


# ---------------------------------------------------------------- stages, streams, order, pages


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'acme' else 'Unfiled' end client, case when o_orderkey % 4 = 0 then 'moved' else 'General' end project, case when o_orderkey % 5 = 0 then 'done' else 'new' end status from orders")
def stage_updates(s, d):
    """A stage of jobs, one an order: created, then changed by two updates that each name the version they read."""
    path, k = stages.scratch(s, "jobs"), F.col("o_orderkey")
    o = table(s, d, "orders")
    none = F.lit("")
    blank = s.createDataFrame([], schema.JOB)
    first = o.select(k.cast("string").alias("id"), F.when(k % 3 == 0, "acme").otherwise("Unfiled").alias("client"), F.lit("General").alias("project"), F.lit("new").alias("status"))
    stages.update_stage(s, path, schema.JOB, lambda held: held.unionByName(blank.unionByName(first, allowMissingColumns=True)))
    moved = o.where(k % 4 == 0).select(k.cast("string").alias("id"), F.lit(" ").alias("client"), F.lit("moved").alias("project"), none.alias("status"))
    done = o.where(k % 5 == 0).select(k.cast("string").alias("id"), none.alias("client"), none.alias("project"), F.lit("done").alias("status"))
    for edits in (moved, done):
        stages.update_stage(s, path, schema.JOB, lambda held, e=edits: jobs.update_job(held, e))
    return stages.read_stage(s, path, schema.JOB).select(F.col("id").cast("long").alias("id"), "client", "project", "status")


@query(f"with {USAGE_SQL}, cost as (select u.*, (input * coalesce(p.p_in, o.p_in) + output * coalesce(p.p_out, o.p_out)) / 1e6 usd from usage u left join pricing p on p.model = u.model and p.model <> 'default', (select * from pricing where model = 'default') o) select strftime(\"at\", '%Y-%m-%d') as day, cast(round(sum(usd) * 1e6) as bigint) usd, count(*) n from cost group by strftime(\"at\", '%Y-%m-%d')")
def streamed_spend(s, d):
    """Spending a day as a stream over files of events in the order of time, two files a batch, resumed once from its checkpoint."""
    base = stages.scratch(s, "stream")
    events = table(s, d, "events")
    events.repartitionByRange(7, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    usage = S.usage(spend.file_stream(s, f"{base}/in", events.schema, files_a_batch=2))
    for _ in range(2):
        spend.start_daily(usage, S.pricing(s), f"{base}/out", f"{base}/checkpoint", late="60 days").awaitTermination()
    return spend.daily_totals(s, f"{base}/out").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(F.col("usd") * 1e6).cast("long").alias("usd"), "n")


@query(f"with {_REFS}, e as (select job_id, space place, x pos, y lo, y + 11 hi, ord from rf where sort <> 0 and k % 2 = 0) select job_id, place, pos, lo, hi, ord, row_number() over (order by job_id, place, pos, lo, hi, ord) - 1 position from e")
def rules_in_order(s, d):
    """Upright lines over all jobs in the order of an output, each with its position."""
    e = referring(s, d).where("type = 'LINE'")
    rows = e.select("job_id", F.col("space").alias("place"), F.col("vertices")[0]["x"].alias("pos"), F.col("vertices")[0]["y"].alias("lo"), F.col("vertices")[1]["y"].alias("hi"), "ord")
    return outputs.positioned(rows, ["job_id", "place", "pos", "lo", "hi", "ord"])


_LAYOUTS = """lo as (select o_custkey % 40 job_id, 'paper:A' || (o_orderkey % 25) space, max(case when o_orderkey % 3 = 0 then 1 else 0 end) kept from orders group by 1, 2)"""


@query(f"with {_LAYOUTS} select job_id, space, row_number() over (order by job_id, space) - 1 position from lo where kept = 1")
def layouts_in_order(s, d):
    """Paper layouts with anything on them, written in sorted files and read back in the order of the files."""
    k = F.col("o_orderkey")
    e = table(s, d, "orders").select((F.col("o_custkey") % 40).alias("job_id"), F.concat(F.lit("paper:A"), (k % 25).cast("string")).alias("space"), F.when(k % 3 == 0, "TEXT").otherwise("VIEWPORT").alias("type"))
    path = stages.scratch(s, "layouts")
    outputs.write_sorted(E.paper_layouts(e), path, ["job_id", "space"], 5)
    held = s.read.parquet(path)
    at = held.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
    return outputs.positioned(at, ["file", "i"], 3).select("job_id", "space", "position")


_LEFT = """ls as (select l_orderkey page, l_linenumber span, min(l_partkey % 6 * 2.0::double) x0, min(l_partkey % 6 * 2.0::double) + 3 x1, min(l_suppkey % 3 * 1.5::double) y0, min(l_suppkey % 3 * 1.5::double) + 8 y1, min(case when l_suppkey % 4 = 0 then 'v' else 'h' end) dir from lineitem group by 1, 2),
dl as (select distinct l_orderkey page, 3 line, 0.0::double x0, 3.5::double x1, 0.0::double y0, 9.0::double y1, 'h' dir from lineitem where l_orderkey % 3 > 0)"""


@query(f"""with recursive {_LEFT}, k as (select ls.*, dl.line home from ls left join dl on dl.page = ls.page and dl.dir = ls.dir and (ls.x0 + ls.x1) / 2 between dl.x0 - 1 and dl.x1 + 1 and (ls.y0 + ls.y1) / 2 between dl.y0 - 1 and dl.y1 + 1),
q as (select *, row_number() over (partition by page order by span) i from k where home is null),
w(page, i, span, opened, home) as (select page, i, span, [struct_pack(x0 := x0, x1 := x1, y0 := y0, y1 := y1, dir := dir)], 1::bigint from q where i = 1 union all
 select page, i, span, case when at_ is null or at_ = 0 then list_append(opened, me) else opened end, case when at_ is null or at_ = 0 then len(opened) + 1 else at_ end from (select q.page, q.i, q.span, w.opened, struct_pack(x0 := q.x0, x1 := q.x1, y0 := q.y0, y1 := q.y1, dir := q.dir) me,
 list_position(list_transform(w.opened, lambda o: o.dir = q.dir and (q.x0 + q.x1) / 2 between o.x0 - 1 and o.x1 + 1 and (q.y0 + q.y1) / 2 between o.y0 - 1 and o.y1 + 1), true) at_ from w join q on q.page = w.page and q.i = w.i + 1))
select page, span, home line from k where home is not null union all select w.page, w.span, case when w.page % 3 > 0 then 4 else 0 end + w.home - 1 from w""")
def span_leftovers(s, d):
    """Lines of every span: those detected, and those that spans without a line open for the ones after them."""
    g = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("span")).agg(F.min((F.col("l_partkey") % 6 * 2.0)).alias("x0"), F.min(F.col("l_suppkey") % 3 * 1.5).alias("y0"), F.min(F.when(F.col("l_suppkey") % 4 == 0, "v").otherwise("h")).alias("dir"))
    spans = g.select("page", "span", "x0", "y0", (F.col("x0") + 3).alias("x1"), (F.col("y0") + 8).alias("y1"), "dir")
    zero = lambda v, n: F.lit(float(v)).alias(n)
    lines = g.where("page % 3 > 0").select("page").distinct().select("page", F.lit(3).alias("line"), zero(0, "x0"), zero(3.5, "x1"), zero(0, "y0"), zero(9, "y1"), F.lit("h").alias("dir"))
    return E.home_lines(spans, lines).select("page", "span", F.col("line").cast("long").alias("line"))


@query(f"""with {_PP}, flr as (select l_suppkey % 40 job_id, 'model' place, -2.0::double * (l_partkey % 61) - (l_linenumber % 4) * 0.5::double - 0.25::double pos, (l_orderkey % 60)::double lo, (l_orderkey % 60) + l_quantity::double hi from lineitem)
select handle, greatest(min(gap), 0.0) clear from (select a.handle, a.y - (b.y + b.height) gap from pi a join pi b on a.job_id = b.job_id and a.handle <> b.handle and b.y < a.y - 1e-9 and b.x < a.x + a.w and b.x + b.w > a.x where a.w > 0
 union all select a.handle, a.y - f.pos from pi a join flr f on a.job_id = f.job_id and f.pos < a.y - 1e-9 and f.lo < a.x + a.w and f.hi > a.x where a.w > 0) group by 1""")
def clearance_with_floors(s, d):
    """Clear height below every text, down to the next text or the next level rule."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    floors = table(s, d, "lineitem").select((F.col("l_suppkey") % 40).alias("job_id"), F.lit("model").alias("place"), (-2.0 * (F.col("l_partkey") % 61) - (n % 4) * 0.5 - 0.25).alias("pos"), (k % 60).cast("double").alias("lo"), ((k % 60) + F.col("l_quantity")).cast("double").alias("hi"))
    return spatial.room_below(_lines(s, d), floors).select("handle", "clear")
