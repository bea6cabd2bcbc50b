"""Queries on entities, rich text, measures, pages and the stages of a run, over relations derived from the tables.

Orders stand for entities and texts: each takes a sample string by its key, so all branches of an operator are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import measure as M
from sheetloom.functions import text as X
from sheetloom.operators import cluster, fit, jobs, review, segments, sheets, spatial, translation
from sheetloom.sources import entities as E
from sheetloom.sources import stages
from sheetloom.sources.tables import table

from . import pipeline
from .queries import _FITS, _OK, _PLAN, instances_sql
from .registry import query
from .shape_sql import paragraph_sql


def _sql_list(xs: list) -> str:
    return "[" + ", ".join("null" if x is None else "'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _pick(xs: list, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), (k + 1).cast("int"))


# ---------------------------------------------------------------- rich text

RICH = [r"ПЛАН\PЭТАЖ {\fArial|b0;1}", r"\W0.8;узкий\P\W1.2;широкий", r"{\H2;x}\~y \S1/2; %%c100", "plain text", r"\{brace\} {\LДМ\l}", "  ", r"\fMS Gothic|c128;図面\P配管", r"{\W0.5;in} \W0.9;out", "%%d45 %%123 тест"]
MARKED = ["⟦1⟧ план ⟦2⟧", "⟦1⟧", "план", " a⟦2⟧b ", "⟦3⟧⟦1⟧этаж⟦2⟧", "⟦1⟧ ⟦2⟧", ""]
ROWS = ["Lead   Ivanov   Petrov", "label   value", "one two", "a    b   c", "ИД   имя"]
CASES = f"tx as (select o_orderkey id, o_custkey % 40 job_id, o_custkey, o_orderpriority pri, o_totalprice price, o_orderdate odate, {_sql_list(RICH)}[o_orderkey % {len(RICH)} + 1] rich, {_sql_list(MARKED)}[o_orderkey % {len(MARKED)} + 1] marked, {_sql_list(ROWS)}[o_orderkey % {len(ROWS)} + 1] row_text from orders)"


def _tx(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 40).alias("job_id"), "o_custkey", F.col("o_orderpriority").alias("pri"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("odate"),
        _pick(RICH, k % len(RICH)).alias("rich"), _pick(MARKED, k % len(MARKED)).alias("marked"), _pick(ROWS, k % len(ROWS)).alias("row_text"),
    )


def _plain_sql(s: str) -> str:
    bare = rf"regexp_replace({s}, '\\[fFHWCTQApXS][^;]*;|\\[LlOoKk]', '', 'g')"
    kept = rf"replace(replace(replace(replace({bare}, '\P', chr(10)), '\~', chr(160)), '\{{', chr(1)), '\}}', chr(2))"
    return rf"replace(replace(regexp_replace({kept}, '[{{}}]', '', 'g'), chr(1), '{{'), chr(2), '}}')"


@query(f"with {CASES} select id, {_plain_sql('rich')} plain from tx")
def mtext_plain(s, d):
    return _tx(s, d).select("id", X.mtext_plain(F.col("rich")).alias("plain"))


@query(rf"with {CASES} select id, case when w > 0 then w else 1.0 end factor from (select id, try_cast(regexp_extract(regexp_replace(rich, '\{{[^{{}}]*\}}', '', 'g'), '\\W([0-9.]+);', 1) as double) w from tx)")
def mtext_width_factor(s, d):
    return _tx(s, d).select("id", X.mtext_width_factor(F.col("rich")).alias("factor"))


@query(rf"with {CASES} select id, case when id % 9 in (1, 7) then replace(replace(replace(replace(rich, '\W0.8;', '\W0.6;'), '\W1.2;', '\W0.9;'), '\W0.5;', '\W0.375;'), '\W0.9;', case when id % 9 = 7 then '\W0.675;' else '\W0.9;' end) else '\W0.75;' || rich end narrowed from tx")
def narrow_mtext(s, d):
    return _tx(s, d).select("id", X.narrow_mtext(F.col("rich"), F.lit(0.75)).alias("narrowed"))


@query(rf"with {CASES} select id, case id % 9 when 0 then replace(rich, '\fArial|', '\fNoto|') else rich end swapped_text, cast(case id % 9 when 0 then 1 else 0 end as int) swapped from tx")
def swap_fonts(s, d):
    z = X.swap_fonts(F.col("rich"), "Noto", ["gothic"])
    return _tx(s, d).select("id", z["text"].alias("swapped_text"), z["swapped"].alias("swapped"))


@query(rf"with {CASES} select id, replace(rich, '|c128;', '|c0;') simple from tx")
def simplify_mtext(s, d):
    return _tx(s, d).select("id", X.simplify_mtext(F.col("rich")).alias("simple"))


@query(rf"with {CASES} select id, case when regexp_matches(rich, '[\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{FF66}}-\x{{FF9F}}]') then regexp_replace(rich, '\\[fF][^;]*;', '', 'g') else rich end bare from tx")
def strip_preview_fonts(s, d):
    return _tx(s, d).select("id", X.strip_preview_fonts(F.col("rich")).alias("bare"))


@query(f"with {CASES}, p as (select id, string_split_regex(rich, '%%[cCdDpPuUoO]|%%[0-9]{{3}}') parts from tx) select id, array_to_string(list_transform(parts, lambda x, i: case when i < len(parts) then x || '⟦' || i || '⟧' else x end), '') marked from p")
def mask_plain_codes(s, d):
    return _tx(s, d).select("id", X.mask(F.col("rich"), X.PLAIN_CODE).alias("marked"))


@query(f"""with {CASES}, e as (select id, marked, regexp_extract(marked, '^((?:⟦[0-9]+⟧\\s*)*)', 1) pre, regexp_extract(marked, '((?:\\s*⟦[0-9]+⟧)*)$', 1) suf from tx),
c as (select *, substring(marked, length(pre) + 1, length(marked) - length(pre) - length(suf)) core from e), f as (select *, length(pre) + length(suf) >= length(marked) or trim(core) = '' whole from c)
select id, case when whole then '' else pre end pre, case when whole then marked else core end core, case when whole then '' else suf end suf from f""")
def strip_edges(s, d):
    return _tx(s, d).select("id", X.strip_edges(F.col("marked")).alias("z")).select("id", "z.*")


@query(f"with {CASES} select id, array_to_string(list_transform(string_split(trim(replace(answer, '　', ' ')), chr(10)), lambda x: trim(x)), chr(10)) answer from (select id, '　 ' || row_text || ' ' || chr(10) || '  ' || pri || '  ' answer from tx)")
def clean_answer(s, d):
    return _tx(s, d).select("id", X.clean_answer(F.concat(F.lit("　 "), "row_text", F.lit(" \n  "), "pri", F.lit("  "))).alias("answer"))


@query(f"""with {CASES}, g as (select id, row_text, regexp_extract_all(row_text, ' {{3,}}') gaps, string_split_regex(row_text, ' {{3,}}') heads from tx), n as (select *, list_transform(heads, lambda x: x || 'X') new from g)
select id, case len(gaps) when 0 then array_to_string(new, '  ') when 1 then rpad(new[1], cast(greatest(length(heads[1]) + length(gaps[1]), length(new[1]) + 1) as int), ' ') || new[2]
 else rpad(rpad(new[1], cast(greatest(length(heads[1]) + length(gaps[1]), length(new[1]) + 1) as int), ' ') || new[2], cast(greatest(length(heads[1]) + length(gaps[1]) + length(heads[2]) + length(gaps[2]), greatest(length(heads[1]) + length(gaps[1]), length(new[1]) + 1) + length(new[2]) + 1) as int), ' ') || new[3] end padded from n""")
def repad_rows(s, d):
    target = F.array_join(F.transform(F.split("row_text", r" {3,}", -1), lambda x: F.concat(x, F.lit("X"))), "  ")
    return _tx(s, d).select("id", X.repad(F.col("row_text"), target).alias("padded"))


@query(f"""with {CASES}, g as (select id, row_text, regexp_extract(row_text, '^(.*?[^ ])( {{3,}})(.*)$', 1) head, regexp_extract(row_text, '^(.*?[^ ])( {{3,}})(.*)$', 2) gap, regexp_extract(row_text, '^(.*?[^ ])( {{3,}})(.*)$', 3) tail from tx)
select id, case when gap = '' then row_text else head || repeat(' ', cast(ceil((length(head) + length(gap)) / 0.8) as int) - length(head)) || tail end wide from g""")
def repad_narrowed(s, d):
    return _tx(s, d).select("id", review.repad_narrowed(F.col("row_text"), F.lit(0.8)).alias("wide"))


@query(f"with {CASES} select id, case id % 3 when 0 then 'план' || pri when 1 then 'план ' || pri else 'план ' || pri end joined from tx")
def join_lines(s, d):
    lang = _pick(["ja", "ru", "en"], F.col("id") % 3)
    return _tx(s, d).select("id", X.join_lines(F.array(F.lit(" план "), "pri"), lang).alias("joined"))


@query(f"with {CASES} select id, case when id % 2 = 0 and id % 3 = 0 then 'name reading unverified' else '' end note from tx")
def name_note(s, d):
    lang, source = _pick(["ja", "en"], F.col("id") % 2), _pick(["担当 山田 太郎 印", "山田太郎様", "plan"], F.col("id") % 3)
    return _tx(s, d).select("id", X.name_note(lang, source).alias("note"))


@query(f"with {CASES} select id, case id % 3 when 0 then 'план здания' when 1 then 'plain' else 'Ѐ' end best from tx")
def best_reading(s, d):
    first = _pick(["öëàí çäàíèÿ", "plain", "Ѐ"], F.col("id") % 3)
    other = _pick(["план здания", "other", "￿￿"], F.col("id") % 3)
    return _tx(s, d).select("id", X.best_reading([F.when(F.col("id") % 3 == 0, F.lit("￿￿￿")).otherwise(first), other]).alias("best"))


@query(f"with {CASES} select id, key, case when key = 'a' then 'T' || id else 'план' end target, case when key = 'b' then 'n' else '' end note from tx, (select unnest(['a', 'b']) as key)")
def model_answers(s, d):
    answer = F.format_string('```json\n{"a": "T%d", "b": {"t": "план", "note": "n"}}\n```', "id")
    return _tx(s, d).select("id", F.explode(X.parse_answers(answer)).alias("z")).select("id", F.col("z.id").alias("key"), "z.target", "z.note")


@query(f"with {CASES} select id, regexp_replace(pri || '_' || cast(floor(price) as bigint), '[^0-9A-Za-z]+', '_', 'g') slug from tx")
def cache_slug(s, d):
    return _tx(s, d).select("id", X.cache_slug([F.col("pri"), F.floor("price").cast("string")]).alias("slug"))


@query(f"with {CASES} select id, u.n - 1 piece, substring(t, (u.n - 1) * 7 + 1, 7) chunk from (select id, repeat(pri, cast(id % 4 as int)) t from tx) z, lateral (select unnest(range(1, greatest(cast(floor((length(t) - 1) / 7) as int), 0) + 2)) as n) u")
def cell_chunks(s, d):
    t = F.expr("repeat(pri, cast(id % 4 as int))")
    return _tx(s, d).select("id", F.posexplode(review.cell_chunks(t, 7)).alias("piece", "chunk"))


@query(f"""with {CASES} select id, '{{"id":"' || id || '","text":"' || row_text || '"' || case when id % 2 = 0 then ',"context":"' || pri || '"' else '' end || case when id % 3 = 0 then ',"max_chars":' || (id % 50) else '' end || '}}' payload from tx""")
def request_payload(s, d):
    seg = _tx(s, d).select(F.col("id").cast("string").alias("id"), F.col("row_text").alias("text"), F.when(F.col("id") % 2 == 0, F.col("pri")).alias("context"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("max_chars"))
    return seg.select(F.col("id").cast("long").alias("id"), translation.payload("id", "text", "context", "max_chars").alias("payload"))


# ---------------------------------------------------------------- entities

TYPES = ["TEXT", "MTEXT", "INSERT", "DIMENSION", "ACAD_TABLE", "ATTDEF", "TOLERANCE", "MULTILEADER", "ARC_DIMENSION", "ACAD_PROXY_ENTITY", "OLE2FRAME", "GEODATA", "VIEWPORT", "LINE", "LWPOLYLINE"]
SPACES = ["model", "paper:A1", "block:door", "block:*Model_Space", "paper:A2"]
WORDS = ["ПЛАН", r"ВЕНТИЛЯЦИЯ\PПРИТОЧНАЯ", "<>", "<> шт", " ", None, "図面", "plan %%c"]
_N = len(TYPES)
ENT = f"""en as (select o_custkey % 40 job_id, {_sql_list(SPACES)}[o_custkey % 5 + 1] space, o_orderkey ord, {_sql_list(TYPES)}[(o_orderkey // 4) % {_N} + 1] type, 'e' || o_orderkey handle, o_orderpriority layer, case when (o_orderkey // 4) % 2 = 0 then 'st1' else 'st2' end style,
 {_sql_list(WORDS)}[(o_orderkey // 7) % {len(WORDS)} + 1] txt, cast(o_custkey % 4 as int) flags, 2.5 height, cast(o_orderkey % 100 as double) x, cast(o_custkey % 90 as double) y from orders)"""


def _entities(s, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    type_ = _pick(TYPES, F.floor(k / 4) % _N)
    text = _pick(WORDS, F.floor(k / 7) % len(WORDS))
    x, y = (k % 100).cast("double"), (c % 90).cast("double")
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    shape = F.when(type_ == "LINE", F.array(point(0, 0), point(0, 50))).when(type_ == "LWPOLYLINE", F.array(point(0, 0), point(0, 30), point(40, 30), point(40, 0)))
    return table(s, d, "orders").select(
        (c % 40).alias("job_id"), _pick(SPACES, c % 5).alias("space"), k.alias("ord"), type_.alias("type"), F.concat(F.lit("e"), k.cast("string")).alias("handle"), F.col("o_orderpriority").alias("layer"),
        F.when(F.floor(k / 4) % 2 == 0, "st1").otherwise("st2").alias("style"), text.alias("text"), (c % 4).cast("int").alias("flags"), F.lit(2.5).cast("double").alias("height"), x.alias("x"), y.alias("y"),
        F.when(type_ == "INSERT", F.array(F.struct(F.lit("T").alias("tag"), text.alias("text")), F.struct(F.lit("U").alias("tag"), F.col("o_orderpriority").alias("text")))).alias("attribs"),
        F.when(type_ == "ACAD_TABLE", F.array(F.lit(""), text, F.lit("cell"))).alias("cells"), shape.alias("vertices"), ((k % 2 == 0) & (type_ == "LWPOLYLINE")).alias("closed"),
    )


_LANG = r"case when regexp_matches({0}, '[\x{{0400}}-\x{{04FF}}]') then 'ru' when regexp_matches({0}, '[\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{FF66}}-\x{{FF9F}}]') then 'ja' when regexp_matches({0}, '[A-Za-z]') then 'en' else 'none' end"
_P = _plain_sql("raw")
_ITEMS = f"""{ENT}, ne as (select * from en where not regexp_matches(upper(ltrim(regexp_replace(space, '^block:', ''), '*$')), '^(MODEL_SPACE|PAPER_SPACE)')),
i0 as (select handle, 'TEXT' kind, txt raw, 0 sub from ne where type = 'TEXT' union all select handle, 'MTEXT', txt, 0 from ne where type = 'MTEXT'
 union all select handle || ':T', 'ATTRIB', txt, 0 from ne where type = 'INSERT' union all select handle || ':U', 'ATTRIB', layer, 1 from ne where type = 'INSERT'
 union all select handle, 'DIMENSION', txt, 0 from ne where type in ('DIMENSION', 'ARC_DIMENSION') and txt <> '<>'
 union all select handle || ':1', 'TABLE_CELL', txt, 1 from ne where type = 'ACAD_TABLE' union all select handle || ':2', 'TABLE_CELL', 'cell', 2 from ne where type = 'ACAD_TABLE'
 union all select handle, 'ATTDEF', txt, 0 from ne where type = 'ATTDEF' and flags & 2 <> 0 union all select handle, 'TOLERANCE', txt, 0 from ne where type = 'TOLERANCE' union all select handle, 'MLEADER', txt, 0 from ne where type = 'MULTILEADER'),
ei as (select handle, kind, raw, case when kind in ('MTEXT', 'TABLE_CELL', 'MLEADER') then {_P} when kind = 'DIMENSION' then replace(raw, '<>', ' ') else raw end plain from i0 where trim(raw) <> '')"""


@query(f"with {_ITEMS} select handle, kind, plain, {_LANG.format('case when kind = $$DIMENSION$$ then raw else plain end')} lang from ei")
def entity_items(s, d):
    return E.items(_entities(s, d)).select("handle", "kind", "plain", "lang")


@query(f"with {ENT} select job_id, space place, x pos, y lo, y + 50 hi from en where type = 'LINE' union all select job_id, space, x, y, y + 30 from en where type = 'LWPOLYLINE' union all select job_id, space, x + 40, y, y + 30 from en where type = 'LWPOLYLINE'")
def rule_lines_upright(s, d):
    return E.rule_lines(_entities(s, d)).select("job_id", "place", "pos", "lo", "hi")


@query(f"with {ENT} select job_id, space place, y + 30 pos, x lo, x + 40 hi from en where type = 'LWPOLYLINE' union all select job_id, space, y, x, x + 40 from en where type = 'LWPOLYLINE' and ord % 2 = 0")
def rule_lines_level(s, d):
    return E.rule_lines(_entities(s, d), vertical=False).select("job_id", "place", "pos", "lo", "hi")


@query(f"with {ENT}, r as (select job_id, space place, type, ord, u.n from en, lateral (select unnest(range(0, case type when 'LINE' then 1 when 'LWPOLYLINE' then 2 else 0 end)) as n) u) select job_id, place, count(*) n from (select *, rank() over (partition by job_id, place order by ord) before from r) where before <= 5 group by 1, 2")
def rules_capped_by_space(s, d):
    return E.rule_lines(_entities(s, d), limit=5).groupBy("job_id", "place").agg(F.count("*").alias("n"))


@query(f"with {ENT} select type, count(*) n, (select string_agg(space, ',' order by o) from (select space, min(ord) o from en b where b.type = en.type group by space)) spaces from en where type in ('ACAD_PROXY_ENTITY', 'OLE2FRAME') group by type")
def unreachable_entities(s, d):
    return E.unreachable(_entities(s, d)).select("type", "n", F.array_join("spaces", ",").alias("spaces"))


@query(f"with {ENT} select type, count(*) n, arg_min(txt, ord) sample from en where type in ('GEODATA', 'VIEWPORT', 'LINE', 'LWPOLYLINE') and trim(coalesce(txt, '')) <> '' group by type")
def uncollected_entities(s, d):
    return E.uncollected(_entities(s, d)).select("type", "n", "sample")


@query(f"with {ENT} select distinct job_id, space from en where space like 'paper:%' and type <> 'VIEWPORT'")
def paper_layouts(s, d):
    return E.paper_layouts(_entities(s, d))


@query("select c_custkey id from customer where c_custkey % 3 <> 1 and c_custkey % 7 <> 0")
def frames_by_block(s, d):
    k = F.col("c_custkey")
    inserts = table(s, d, "customer").select(k.alias("id"), _pick(["A1_Frame", "door", "図枠A3"], k % 3).alias("name"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(k % 7 == 0, 4000.0).otherwise(9000.0).alias("x1"), F.lit(6000.0).alias("y1"))
    return E.frames_by_block(inserts).select("id")


@query("select distinct 'f' || (c_custkey % 30) || '.png' path from customer where c_custkey % 2 = 0 union select distinct 'x' || (c_custkey % 5) || '.dwg' from customer where c_custkey % 5 <> 0")
def linked_files(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    pictures = c.select(F.when(k % 2 == 0, F.concat(F.lit("f"), (k % 30).cast("string"), F.lit(".png"))).otherwise("").alias("path"))
    refs = c.select(F.lit(1).alias("job_id"), F.concat(F.lit("b"), (k % 5).cast("string")).alias("name"), F.concat(F.lit("x"), (k % 5).cast("string"), F.lit(".dwg")).alias("path")).distinct()
    held = s.createDataFrame([(1, "block:b0")], "job_id int, space string")
    return E.linked_files(pictures, refs, held)


@query("select o_orderkey id, cast(u.c as bigint) cell, case when u.c = 0 then 'AB' || o_orderpriority else '' end as \"value\" from orders, lateral (select unnest([0, 1]) as c) u")
def table_cell_texts(s, d):
    tag = lambda n, code, v: F.struct(F.lit(n).alias("pos"), F.lit(code).alias("code"), (v if isinstance(v, Column) else F.lit(v)).alias("value"))
    stream = F.array(tag(0, 1, "before"), tag(1, 301, "CELL_VALUE"), tag(2, 2, "A"), tag(3, 1, F.col("o_orderpriority")), tag(4, 2, "B"), tag(5, 304, "ACVALUE_END"), tag(6, 1, "between"), tag(7, 301, "CELL_VALUE"), tag(8, 304, "ACVALUE_END"), tag(9, 1, "after"))
    tags = table(s, d, "orders").select(F.col("o_orderkey").alias("handle"), F.explode(stream).alias("t")).select("handle", "t.*")
    return E.cell_texts(tags).select(F.col("handle").alias("id"), "cell", "value")


# ---------------------------------------------------------------- pages

_GL = "gl as (select l_orderkey span, l_linenumber ord, cast(l_linenumber * 10 - case when l_linenumber > 3 then 40 else 0 end as double) x, cast(case when l_linenumber in (1, 2, 3) then 0 else 20 end as double) y, 10.0 size, l_partkey from lineitem)"


@query(f"with {_GL}, f as (select *, min(ord) over (partition by span) o1, lag(ord) over (partition by span order by ord) lo, lag(y) over (partition by span order by ord) ly from gl) select span, cast(ord as bigint) ord, cast(sum(case when lo is not null and ly <> y then 1 else 0 end) over (partition by span order by ord) as int) as \"row\" from f")
def glyph_rows(s, d):
    n = F.col("l_linenumber")
    g = table(s, d, "lineitem").select(F.col("l_orderkey").alias("span"), n.cast("long").alias("ord"), (n * 10 - F.when(n > 3, 40).otherwise(0)).cast("double").alias("x"), F.when(n <= 3, 0.0).otherwise(20.0).alias("y"), F.lit(10.0).alias("size"))
    return E.glyph_rows(g)


_SP = "sp as (select l_orderkey page, l_linenumber span, l_linenumber * 10.0 x0, l_linenumber * 10.0 + case when l_linenumber % 2 = 0 then 10.0 else 4.0 end x1, 10.0 size, case when l_linenumber % 3 = 0 then ' ' || min(l_returnflag) || ' ' else min(l_linestatus) end t from lineitem group by 1, 2)"


@query(f"with {_SP}, p as (select *, case when x0 - lag(x1) over (partition by page order by x0, span) > 0.25 * size then ' ' else '' end || t piece from sp) select page, trim(regexp_replace(string_agg(piece, '' order by x0, span), ' +', ' ', 'g')) as text from p group by page")
def page_line_texts(s, d):
    n = F.col("l_linenumber")
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    spans = li.select(F.col("l_orderkey").alias("page"), F.lit(0).alias("line"), n.alias("span"), (n * 10.0).alias("x0"), (n * 10.0 + F.when(n % 2 == 0, 10.0).otherwise(4.0)).alias("x1"), F.lit(10.0).alias("size"), F.when(n % 3 == 0, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))).otherwise(F.col("l_linestatus")).alias("text"))
    return E.line_texts(spans).select("page", "text")


@query("with p as (select distinct l_orderkey page, l_linenumber span from lineitem) select page, span, cast(case when span <= 4 then (span - 1) // 2 else 1 + count(*) filter (span > 4) over (partition by page order by span) end as int) line from p")
def span_home_lines(s, d):
    n = F.col("l_linenumber")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("n")).distinct()
    spans = li.select("page", F.col("n").alias("span"), (n_ := F.col("n") * 10.0).alias("x0"), (n_ + 4).alias("x1"), F.lit(0.0).alias("y0"), F.lit(8.0).alias("y1"), F.lit("h").alias("dir"))
    lines = li.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("line")).select("page", "line", (F.col("line") * 20.0 + 9).alias("x0"), (F.col("line") * 20.0 + 28).alias("x1"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("y1"), F.lit("h").alias("dir"))
    return E.home_lines(spans, lines).select("page", "span", F.col("line").cast("int").alias("line"))


_DR = "dr as (select l_orderkey page, case when l_linenumber % 2 = 0 then 'line' else 'rect' end kind, l_quantity x0, 5.0 y0, case when l_linenumber % 4 = 0 then l_quantity + 9 when l_linenumber % 2 = 0 then l_quantity else l_quantity + 30 end x1, case when l_linenumber % 3 = 0 then 6.0 else 25.0 end y1 from lineitem)"


def _drawings(s, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(n % 2 == 0, "line").otherwise("rect").alias("kind"), q.alias("x0"), F.lit(5.0).alias("y0"), F.when(n % 4 == 0, q + 9).when(n % 2 == 0, q).otherwise(q + 30).alias("x1"), F.when(n % 3 == 0, 6.0).otherwise(25.0).alias("y1"))


@query(f"with {_DR} select page, x0 pos, -y1 lo, -y0 hi from dr where kind = 'line' and x0 = x1 and y1 - y0 > 2 union all select page, u.p, -y1, -y0 from dr, lateral (select unnest([x0, x1]) as p) u where kind = 'rect' and y1 - y0 > 2")
def page_rules(s, d):
    return E.page_rules(_drawings(s, d)).select("page", "pos", "lo", "hi")


@query(f"""with {_DR}, j as (select page, string_agg('{{"kind":"' || kind || '","x0":' || x0 || ',"x1":' || x1 || '}}', chr(10) order by kind, x0, x1, y1) t, count(*) n from dr group by page) select page, n, sha256(t) sha from j""")
def page_fingerprint(s, d):
    dr = _drawings(s, d).withColumn("o", F.struct("kind", "x0", "x1", "y1"))
    return review.ordered_fingerprint(dr, "page", "o", ["kind", "x0", "x1"]).select("page", "n", "sha")


# ---------------------------------------------------------------- stages, sinks, jobs


@query("select o_orderkey id, o_orderpriority target, o_orderstatus = 'F' ok, '' note from orders")
def stage_round_trip(s, d):
    from sheetloom import schema

    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("target"), (F.col("o_orderstatus") == "F").alias("ok"), F.lit("").alias("note"))
    path = stages.scratch(s, "translations")
    stages.write_stage(o.limit(0), path)
    stages.write_stage(o, path)
    return stages.read_stage(s, path, schema.TRANSLATION).select(F.col("id").cast("long").alias("id"), "target", "ok", "note")


@query("select 'm' || p_partkey model, p_retailprice / 300 p_in, case when p_partkey % 3 > 0 then p_retailprice / 60 else 0.0 end p_out, case when p_partkey % 4 = 0 then p_size / 10.0::double else 0.0 end p_read, 0.0::double p_write from part")
def pricing_from_file(s, d):
    """A price list written as a file, a model a part, with rates that some rows lack."""
    path, k = stages.scratch(s, "pricing"), F.col("p_partkey")
    rates = table(s, d, "part").select(F.concat(F.lit("m"), k).alias("model"), (F.col("p_retailprice") / 300).alias("input"), F.when(k % 3 > 0, F.col("p_retailprice") / 60).alias("output"), F.when(k % 4 == 0, F.col("p_size") / 10).alias("cache_read"))
    rates.write.json(path)
    return stages.read_pricing(s, path)


@query("""with l as (select coalesce(source, 'none') source, doc_id, string_split(text, chr(10))[1] line from documents where text is not null), t as (select source, string_agg(line, chr(10) order by doc_id) body from l where trim(line) <> '' group by 1)
select source, md5(regexp_replace(body, '\\s+$', '')) digest, len(string_split(regexp_replace(body, '\\s+$', ''), chr(10))) n from t where trim(body) <> ''""")
def workspace_texts(s, d):
    """A workspace of one file a source, the first lines of its documents, some with front matter: read whole, without it."""
    path = stages.scratch(s, "workspace")
    first = table(s, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.split("text", "\n")[0].alias("line")).where("trim(line) <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda z: z["line"]), "\n")
    files = first.groupBy("source").agg(body.alias("body"))
    front = F.when(F.length("source") % 2 == 0, F.concat(F.lit("---\ntitle: "), F.col("source"), F.lit("\nkind: notes\n---\n"))).otherwise("")
    files.select("source", F.concat(front, "body").alias("value")).repartition("source").write.partitionBy("source").text(path)
    t = E.workspace_text(s, f"{path}/*/*.txt")
    text = F.regexp_replace("text", r"\s+$", "")
    return t.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.md5(text.cast("binary")).alias("digest"), F.size(F.split(text, "\n")).alias("n"))


@query("select 'k' || o_orderkey term, o_orderpriority translation from orders where o_orderkey % 5 <> 0")
def glossary_pairs(s, d):
    """The pairs of a glossary text a customer; lines without an arrow have none."""
    k = F.col("o_orderkey")
    pair = F.when(k % 5 == 0, F.concat(F.lit("note "), k)).otherwise(F.concat(F.lit("k"), k, F.lit(" → "), "o_orderpriority"))
    texts = table(s, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("# terms\n"), F.call_function("array_join", F.collect_list(pair), F.when(F.max("o_custkey") % 2 == 0, " · ").otherwise("\n"))).alias("text"))
    return E.glossary(texts.select("text"))


_TR = "tj as (select o_orderkey id, o_orderdate deleted_at, (select max(o_orderdate) from orders) now from orders)"


def _trashed(s, d):
    o = table(s, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("deleted_at")).join(F.broadcast(now), F.lit(True)).withColumn("now", F.col("now").cast("timestamp"))


@query(f"with {_TR} select id, (epoch(now) - epoch(deleted_at)) / 86400.0 deleted_days_ago from tj where (epoch(now) - epoch(deleted_at)) / 86400.0 <= 14")
def trash_listing(s, d):
    return jobs.trash(_trashed(s, d), F.col("now")).select("id", "deleted_days_ago")


@query(f"with {_TR} select id from tj where (epoch(now) - epoch(deleted_at)) / 86400.0 > 14")
def trash_purge(s, d):
    return jobs.purged(_trashed(s, d), F.col("now")).select("id")


@query(f"with {_TR} select id, id % 2 = 0 deleted from tj")
def trash_restore(s, d):
    t = _trashed(s, d)
    return jobs.restored(t, t.where("id % 2 = 1").select("id")).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'p1=new' when o_orderkey % 3 = 1 then 'p2=x' else 'p1=old,p2=x' end flags from orders")
def flag_edits(s, d):
    m = F.create_map(F.lit("p1"), F.lit("old"), F.lit("p2"), F.lit("x"))
    k = F.col("o_orderkey")
    out = F.when(k % 3 == 0, F.map_filter(jobs.set_flag(m, F.lit("p1"), F.lit("new")), lambda a, _: a == "p1")).when(k % 3 == 1, jobs.set_flag(m, F.lit("p1"), None)).otherwise(m)
    show = F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(s, d, "orders").select(k.alias("id"), show.alias("flags"))


@query("select o_orderkey id, case o_orderkey % 4 when 0 then 'dwg' when 1 then 'dxf' when 2 then 'pdf' else null end upload from orders")
def upload_type(s, d):
    k = F.col("o_orderkey")
    name, head = _pick(["a.DWG", "b.dxf", "c.pdf", "d.exe"], k % 4), _pick(["AC1032..", "  0\nSECTION", "%PDF-1.7", "MZ"], k % 4)
    return table(s, d, "orders").select(k.alias("id"), jobs.upload_type(name, F.to_binary(head, F.lit("utf-8"))).alias("upload"))


@query("select o_orderkey id, case when o_orderkey % 3 = 0 then 'dwg' when o_orderkey % 3 = 1 then 'dxf' end dl from orders")
def download_choice(s, d):
    k = F.col("o_orderkey")
    made = F.when(k % 3 == 0, F.array(F.lit("dxf"), F.lit("dwg"))).when(k % 3 == 1, F.array(F.lit("dxf"))).otherwise(F.array().cast("array<string>"))
    return table(s, d, "orders").select(k.alias("id"), jobs.download(made).alias("dl"))


@query("select event_type stage, cast(count(*) as bigint) runs, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from events group by 1")
def stage_timing(s, d):
    return jobs.stage_timing(table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("ts").alias("at")))


_KINDS = {"layout": 0, "frame": 1, "cluster": 2}


@query("select c_nationkey job_id, c_custkey sheet from customer where case c_nationkey % 3 when 0 then c_custkey % 3 = 0 when 1 then c_custkey % 3 = 1 else c_custkey % 3 = 2 end")
def sheets_by_kind(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("job_id"), F.col("c_custkey").alias("sheet"))
    layouts, frames = c.where("job_id % 3 = 0 and sheet % 3 = 0"), c.where("job_id % 3 = 1 and sheet % 3 = 1")
    return jobs.sheets(layouts, frames, c.where("sheet % 3 = 2"))


@query("""with st as (select event_type, count(*) n from events group by 1), f as (select case when o_orderkey % 7 = 0 then 'overflow' when o_orderkey % 5 = 0 then 'tight' else 'ok' end flag, o_orderkey k, o_totalprice r, o_orderpriority p from orders),
w as (select * from f where flag <> 'ok' order by r, k limit 8)
select 'stage' section, event_type || ' ' || n line from st union all select 'fit', flag || ': ' || count(*) from f group by flag union all select 'worst', k || ' ' || flag || case when k % 3 > 0 then ' ' || p else '' end from w""")
def diagnostics_text(s, d):
    """Runs of each stage, flags and the eight tightest with their texts, where these are known."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(k.cast("string").alias("id"), k.alias("k"), F.when(k % 7 == 0, "overflow").when(k % 5 == 0, "tight").otherwise("ok").alias("flag"), F.col("o_totalprice").alias("r"), F.col("o_orderpriority").alias("source"))
    timed = table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("seconds"))
    worst = o.where("flag <> 'ok'").orderBy("r", "k").limit(8).select("id", "flag")
    return jobs.diagnostics(timed, o.groupBy("flag").agg(F.count("*").alias("n")), jobs.with_text(worst, o.where("k % 3 > 0")))


# ---------------------------------------------------------------- paragraphs

PIECES = ["план", "этаж", "стена,", "дом.", "- пункт", "図面", "配管。", "note", "Next", "x   y", "wall-", "１２"]
_PP = f"""pq as (select o_custkey % 40 job_id, 'model' place, 'l' || (o_orderkey % 3) layer, 'h' || o_orderkey handle, o_orderkey ord, {_sql_list(PIECES)}[o_orderkey % 12 + 1] || case when o_orderkey % 5 < 2 then ' ' || {_sql_list(PIECES)}[(o_orderkey // 12) % 12 + 1] else '' end plain,
 ['ru', 'ja', 'en'][o_orderkey % 3 + 1] lang, 2.5::double * [1.0, 1.0, 1.0, 1.05, 1.3][(o_orderkey // 3) % 5 + 1] height, [0.0, 1.0, 2.0, 5.0, 9.0, 40.0, 42.0, 100.0][(o_orderkey // 7) % 8 + 1]::double x, -2.0::double * (o_orderkey % 61) y from orders),
pi as (select *, {M.em_width_sql('plain')} * height w from pq)"""


def _lines(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    num = lambda xs, i: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (i + 1).cast("int"))
    plain = F.concat(_pick(PIECES, k % 12), F.when(k % 5 < 2, F.concat(F.lit(" "), _pick(PIECES, F.floor(k / 12) % 12))).otherwise(""))
    return table(s, d, "orders").select(
        (F.col("o_custkey") % 40).alias("job_id"), F.lit("model").alias("place"), F.concat(F.lit("l"), (k % 3).cast("string")).alias("layer"), F.concat(F.lit("h"), k.cast("string")).alias("handle"), k.alias("ord"), F.lit("TEXT").alias("kind"), plain.alias("plain"),
        _pick(["ru", "ja", "en"], k % 3).alias("lang"), (2.5 * num([1, 1, 1, 1.05, 1.3], F.floor(k / 3) % 5)).alias("height"), num([0, 1, 2, 5, 9, 40, 42, 100], F.floor(k / 7) % 8).alias("x"), (-2.0 * (k % 61)).cast("double").alias("y"),
    )


_PARA = f"with recursive {_PP}, {paragraph_sql('pi')}"


@query(f"{_PARA} select handle, paragraph, line from para")
def paragraph_runs(s, d):
    return segments.paragraphs(_lines(s, d)).select("handle", "paragraph", "line")


@query(f"{_PARA} select paragraph handle, string_agg(trim(plain), case when arg_min(lang, line) = 'ja' then '' else ' ' end order by line) as plain, cast(count(*) as int) n_lines, max(height) height from para join pi using (job_id, place, layer, handle) group by job_id, paragraph".replace("string_agg(trim(plain), case when arg_min(lang, line) = 'ja' then '' else ' ' end order by line)", "case when arg_min(lang, line) = 'ja' then string_agg(trim(plain), '' order by line) else string_agg(trim(plain), ' ' order by line) end"))
def paragraph_units(s, d):
    t = _lines(s, d)
    return segments.paragraph_units(t, segments.paragraphs(t)).select("handle", "plain", "n_lines", "height")


@query(f"""{_PARA}, q as (select para.job_id, paragraph, handle, line, x, height, plain, {M.em_width_sql('plain')} em, w from para join pi using (job_id, place, layer, handle)),
r as (select *, max(x + w) over v col, min(x) over v st, first_value(height) over (partition by job_id, paragraph order by line) scale from q window v as (partition by job_id, paragraph)),
z as (select *, least(col, col + (col - st) * 0.2) rgt, greatest(col, col + (col - st) * 0.2) most from r)
select handle, line, greatest((rgt - x) / scale, em) cap, greatest((most - x) / scale, em) cap_max from z""")
def paragraph_capacity(s, d):
    t = _lines(s, d)
    lines = t.join(segments.paragraphs(t).select("job_id", "handle", "paragraph", "line"), ["job_id", "handle"])
    none = s.createDataFrame([], "job_id long, handle string, avail double")
    return segments.paragraph_capacity(lines, none).select("handle", "line", "cap", "cap_max")


@query(f"{_PARA}, u as (select job_id, paragraph, count(*) n from para group by 1, 2) select (select count(distinct (job_id, plain)) from pi) segments, (select count(*) from pi) entities, 0::bigint skipped, (select count(*) from u where n > 1) paragraphs")
def prepare_counters(s, d):
    t = _lines(s, d)
    units = segments.paragraph_units(t, segments.paragraphs(t))
    return segments.counters(t, units, t.select("job_id", "plain").distinct())


@query(f"with {_PP} select plain, min(ord) first from pi where lang in ('ru', 'ja') and trim(plain) <> '' and plain <> '１２' and plain not in ('план', 'note') and not regexp_matches(plain, '^[-１２ ]+$') group by plain order by first limit 25")
def unseen_strings(s, d):
    known = s.createDataFrame([("план",), ("note",)], "source string")
    return segments.unseen(_lines(s, d), ["ru", "ja"], known)


_TI = _PP[: _PP.index(",\npi as")] + ", ti as (select *, 'TEXT' kind from pq)"
_WANTED = f"({_OK} and not regexp_matches(plain, '^[- １２]+$'))"
_NO_RULES = "rule as (select 0::bigint job_id, '' place, 0.0::double pos, 0.0::double lo, 0.0::double hi where false)"
_RUN = instances_sql(_TI, _NO_RULES, _WANTED)


def _run(s, d, shorter=None):
    none = s.createDataFrame([], "job_id long, place string, pos double, lo double, hi double")
    return pipeline.run_all(_lines(s, d), none, s.createDataFrame([], "source string, target string"), shorter=shorter)


@query(f"{_RUN}, {_FITS}")
def fit_flags_of_paragraphs(s, d):
    return _run(s, d).fits.select("id", "flag", "suggested_width_factor", "ratio")


@query(f"{_RUN}, {_PLAN}")
def patch_plan_of_paragraphs(s, d):
    return _run(s, d).plan


@query("select o_custkey % 40 job_id, o_orderkey % 9 page, count(*) n, string_agg('w' || o_orderkey, ',' order by o_orderkey % 61, o_orderkey) writes from orders where o_orderkey % 4 <> 0 group by 1, 2")
def page_plan(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select((F.col("o_custkey") % 40).alias("job_id"), F.concat(F.lit("h"), k.cast("string")).alias("handle"), k.alias("k"))
    plan = o.select("job_id", "handle", F.when(F.col("k") % 4 == 0, "skip").otherwise("update").alias("action"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("new_text"))
    places = o.select("job_id", "handle", (F.col("k") % 9).alias("page"), F.col("k").cast("double").alias("x"), (F.col("k") % 61).cast("double").alias("y0"))
    return review.page_plan(plan, places).select("job_id", "page", F.size("writes").cast("long").alias("n"), F.array_join(F.transform("writes", lambda w: w["new_text"]), ",").alias("writes"))


@query(r"""with z as (select o_orderkey id, o_orderkey % 2 = 0 narrow, o_orderkey % 3 c, o_orderkey % 4 = 0 fine from orders)
select id, case c when 0 then case when fine then 'Ａ b' else 'A b' end when 1 then case when narrow then 'label     v' else 'label   v' end else case when narrow then '\W0.8;' else '' end || '{\fNoto|b0;x}' end written,
 case when c = 2 then 0.9::double when narrow then 0.9::double * 0.8::double else 0.9::double end width, case when c = 2 then case when narrow then 40.0::double * 0.8::double else 40.0::double end end box, case when fine then 'MS Gothic' else 'Noto' end new_font from z""")
def refined_plan(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    plan = o.select(F.lit(1).cast("long").alias("job_id"), k.alias("handle"), F.when(k % 3 == 2, "MTEXT").otherwise("TEXT").alias("kind"), _pick(["Ａ b", "label   v", r"{\fArial|b0;x}"], k % 3).alias("new_text"), F.when(k % 2 == 0, 0.8).otherwise(1.0).alias("width_mult"))
    items = o.select(F.lit(1).cast("long").alias("job_id"), k.alias("handle"), F.lit("").alias("raw"), F.lit(0.9).alias("width_factor"), F.lit(40.0).alias("box_width"), F.lit("st").alias("style"), F.when(k % 4 == 0, "MS Gothic").otherwise("arial").alias("font"))
    return review.refined(plan, items, ["gothic"]).select(F.col("handle").alias("id"), "written", "width", "box", "new_font")


# ---------------------------------------------------------------- room, budgets, plans


@query("select o_orderkey id, case when o_orderkey % 5 = 2 then 1.5 + o_orderkey % 7 when o_orderkey % 5 in (1, 4) then 1.5 + o_orderkey % 7 else o_orderkey % 10 + 0.0 end x from orders")
def align_points(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), M.align_x((k % 10).cast("double"), (1.5 + k % 7).cast("double"), k % 5).alias("x"))


@query("select o_orderkey id, case o_orderkey % 5 when 0 then 3.0 when 1 then 20.0 - (o_orderkey % 9) / 2.0 when 2 then 20.0 - (o_orderkey % 9) when 4 then 20.0 - (o_orderkey % 9) / 2.0 else 3.0 end::double l from orders")
def left_edges(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), M.left_edge(F.lit(3.0), F.lit(20.0), (k % 9).cast("double"), k % 5).alias("l"))


@query("select o_orderkey id, o_orderkey % 7 <> 0 and ((o_orderkey % 720 - 360) % 360 + 360) % 360 in (0, 1, 359) flat from orders")
def flat_texts(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), M.is_flat((k % 720 - 360).cast("double"), k % 7 == 0).alias("flat"))


@query("select o_orderkey id, o_orderkey % 4 in (0, 2) or (o_orderkey % 4 = 1 and (o_orderkey % 3 = 0 or o_orderkey % 2 = 0)) \"like\" from orders")
def line_like(s, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 2 == 0, "one line").otherwise(r"two\Plines")
    return table(s, d, "orders").select(k.alias("id"), M.fits_like_a_line(_pick(["TEXT", "MTEXT", "PDF", "TABLE_CELL"], k % 4), F.when(k % 3 == 0, 0.0).otherwise(9.0), raw).alias("like"))


@query("select o_orderkey id, case when o_orderkey % 9 > 0 then cast(greatest(0, least(2, floor((o_orderkey % 9 - 0.35 * 2.0) / (1.45 * 2.0)))) as int) else 0 end spare from orders")
def spare_lines(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), M.spare_lines((F.col("o_orderkey") % 9).cast("double"), F.lit(2.0)).alias("spare"))


@query("select o_orderkey id, case when o_orderkey % 2 = 0 and o_orderkey % 30 > 0 and o_orderkey % 30 > 1.02 * 12 then 12.0::double * 0.93::double end clamp, floor((o_orderkey % 30)::double * 2 / 0.6::double * 1.1::double) chars, greatest(4.0::double, floor((o_orderkey % 30)::double / 0.6::double * 0.95::double)) shorter from orders")
def room_budgets(s, d):
    box = (F.col("o_orderkey") % 30).cast("double")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "MTEXT").otherwise("TEXT")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), segments.box_clamp(kind, box, F.lit(12.0)).alias("clamp"), segments.budget_chars(box, F.lit(2)).cast("double").alias("chars"), segments.shorten_budget(box).cast("double").alias("shorter"))


_OV = f"ov as (select o_orderkey id, o_orderpriority || '⟦1⟧' source, o_orderpriority || ' and more⟦1⟧' target, o_orderkey % 20 budget from orders)"


def _answers(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit("⟦1⟧")).alias("source"), F.concat("o_orderpriority", F.lit(" and more⟦1⟧")).alias("target"), (F.col("o_orderkey") % 20).alias("budget"))


_CUT = """cu as (select *, length(replace(target, '⟦1⟧', '')) n0, replace(target, ' and more', '') t1, substring(source, 1, 3) || '⟦1⟧' t2 from ov)"""


def _shorter(rows):
    """Stands in for a model: first without the addition, then the first letters alone."""
    first = F.replace("target", F.lit(" and more"), F.lit(""))
    return rows.select("id", F.when(F.col("id") % 2 == 0, first).otherwise(F.concat(F.substring("source", 1, 3), F.lit("⟦1⟧"))).alias("target"))


@query(f"with {_OV}, {_CUT} select id, case when n0 <= budget then target when length(replace(case when id % 2 = 0 then t1 else t2 end, '⟦1⟧', '')) <= budget then case when id % 2 = 0 then t1 else t2 end else target end target, n0 > budget and length(replace(case when id % 2 = 0 then t1 else t2 end, '⟦1⟧', '')) <= budget shortened from cu")
def shortened(s, d):
    return translation.shorten(_answers(s, d), _shorter)


@query(f"with {_OV}, {_CUT}, z as (select id, n0 > budget and length(replace(case when id % 2 = 0 then t1 else t2 end, '⟦1⟧', '')) <= budget shortened from cu) select count(*) filter (id % 7 <> 0) ok, count(*) filter (id % 5 = 0) from_memory, count(*) filter (shortened) shortened, count(*) filter (id % 7 = 0) attention from z")
def translate_counters(s, d):
    out = translation.shorten(_answers(s, d), _shorter)
    return translation.counters(out.select("id", (F.col("id") % 7 != 0).alias("ok"), F.when(F.col("id") % 5 == 0, "from memory").otherwise("").alias("note"), "shortened"))


@query(f"with {_OV} select id, trim(target) <> '' and length(replace(target, '⟦1⟧', '')) <= budget fits from ov")
def within_budget(s, d):
    return _answers(s, d).select("id", translation.within_budget("source", "target", "budget").alias("fits"))


@query("with b as (select o_custkey % 40 job_id, (row_number() over (partition by o_custkey % 40 order by o_orderkey) - 1) // 60 batch from orders), c as (select job_id, batch, count(*) n from b group by 1, 2) select job_id, cast(batch as bigint) batch, cast(sum(n) over (partition by job_id order by batch) + case when job_id % 2 = 0 then 5 else 0 end as bigint) seen from c")
def answer_progress(s, d):
    t = table(s, d, "orders").select((F.col("o_custkey") % 40).alias("job_id"), "o_orderkey")
    held = t.select("job_id").distinct().where("job_id % 2 = 0").select("job_id", F.lit(5).alias("n"))
    return translation.progress(translation.batches(t, "o_orderkey"), held).select("job_id", "batch", F.col("seen").cast("long").alias("seen"))


@query("select o_orderkey id, upper(o_orderpriority) target, o_orderkey % 50 <> 0 ok, case when o_orderkey % 50 = 0 then 'left as it was' else '' end note from orders".replace("upper(o_orderpriority)", "case when o_orderkey % 50 = 0 then o_orderpriority || '⟦1⟧' else upper(o_orderpriority) || '⟦1⟧' end"))
def translated_by_function(s, d):
    def upper(rows):
        lost = rows["id"].astype("int64") % 50 == 0
        return rows.assign(target=rows["source"].str.upper().mask(lost, "no marker"), note="")[["id", "target", "note"]]

    seg = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat("o_orderpriority", F.lit("⟦1⟧")).alias("source"))
    return translation.translate(seg, upper).select(F.col("id").cast("long").alias("id"), "target", "ok", "note")


@query("select o_orderkey id, 'h' || o_orderkey || case when u.n = 0 then 'a' else 'b' end handle, 'update' \"action\", '{' || o_orderpriority || '}' new_text from orders, lateral (select unnest([0, 1]) as n) u")
def other_kinds_plan(s, d):
    o = table(s, d, "orders")
    t = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("⟦1⟧"), "o_orderpriority").alias("target"), F.array(F.lit("{"), F.lit("}")).alias("codes"), F.array(*(F.concat(F.lit("h"), F.col("o_orderkey").cast("string"), F.lit(x)) for x in "ab")).alias("handles"))
    return review.other_kinds_plan(t.select("id", "target", "codes"), t.select("id", F.explode("handles").alias("handle")))


@query("select c.c_nationkey block, 'o' || o_orderkey handle, 'new ' || o_orderpriority new_text from orders join customer c on o_custkey = c_custkey where c.c_nationkey % 2 = 0")
def mirrored_cells(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    drawn = o.select(F.col("c_nationkey").alias("block"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("handle"), F.col("o_orderpriority").alias("text"))
    changed = drawn.where("block % 2 = 0").select("block", F.col("text").alias("old_text"), F.concat(F.lit("new "), "text").alias("new_text")).distinct()
    return review.mirror_cells(drawn, changed)


@query("select distinct 'st' || (o_orderkey % 4) style, ['romans', 'MS Gothic', 'arial', 'txt'][o_orderkey % 4 + 1] old_font, case when o_orderkey % 4 = 1 then 'MS Gothic' else 'Noto' end new_font from orders where o_orderkey % 3 = 0")
def restyled(s, d):
    k = F.col("o_orderkey")
    items = table(s, d, "orders").select(k.alias("handle"), F.concat(F.lit("st"), (k % 4).cast("string")).alias("style"), _pick(["romans", "MS Gothic", "arial", "txt"], k % 4).alias("font"))
    plan = items.select("handle", F.when(F.col("handle") % 3 == 0, "update").otherwise("skip").alias("action"))
    return review.restyled(items, plan, ["gothic"], "Noto")


@query("select style, count(distinct space) spaces, count(*) handles from (select case when (o_orderkey // 4) % 2 = 0 then 'st1' else 'st2' end style, o_custkey % 5 space from orders) group by 1")
def styles_in_use(s, d):
    return _entities(s, d).groupBy("style").agg(F.count_distinct("space").alias("spaces"), F.count_distinct("handle").alias("handles"))


@query("select o_orderkey id, o_orderkey % 4 in (1, 2) or o_orderkey % 8 >= 4 vertical from orders")
def vertical_styles(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select(k.alias("id"), M.is_vertical(_pick(["arial", "@gothic", "txt", None], k % 4), _pick([None, "big", "@big", None], k % 4), (k % 8).cast("int")).alias("vertical"))


@query("with z as (select o_orderkey id, case when n <= 50000 then 4000 when n <= 200000 then 3000 when n <= 500000 then 2200 else 1600 end w, 1 + o_orderkey % 9 r from (select o_orderkey, (o_orderkey * 97) % 700000 n from orders)) select id, cast(floor(w * least(1.0, sqrt(16000000.0 / (w * (w * (r + 0.0::double) / 2.0))))) as bigint) w, cast(floor((w * (r + 0.0::double) / 2.0) * least(1.0, sqrt(16000000.0 / (w * (w * (r + 0.0::double) / 2.0))))) as bigint) h from z")
def render_sizes(s, d):
    k = F.col("o_orderkey")
    z = M.render_size((k * 97) % 700_000, F.lit(2.0), (1 + k % 9).cast("double"))
    return table(s, d, "orders").select(k.alias("id"), z["w"].alias("w"), z["h"].alias("h"))


@query("""select o_orderkey id, case o_orderkey % 4 when 0 then 'page 2, page 10, model space' when 1 then 'page 7' when 2 then '' else 'block d, model space, sheet A, …' end places from orders""")
def segment_places(s, d):
    k = F.col("o_orderkey")
    stored = F.when(k % 4 == 0, F.array(*(F.lit(x) for x in ("page:10", "model", "page:2", "page:10")))).when(k % 4 == 3, F.array(*(F.lit(x) for x in ("sheet:z", "paper:A", "model", "block:d"))))
    return table(s, d, "orders").select(k.alias("id"), segments.short_places(segments.place_list(stored, _pick(["h1", "p7-3", "h2", "h3"], k % 4))).alias("places"))


@query("select o_orderkey id, o_orderkey % 3 in (0, 2) and o_orderkey % 2 = 0 or (o_orderkey % 2 = 1 and o_orderkey % 3 in (0, 1)) \"taken\" from orders")
def source_languages(s, d):
    k = F.col("o_orderkey")
    lang = _pick(["ru", "en", "ja"], k % 3)
    taken = F.when(k % 2 == 0, lang.isin(segments.sources_for("en"))).otherwise(lang.isin(segments.sources_for("ja")))
    return table(s, d, "orders").select(k.alias("id"), taken.alias("taken"))


@query("select cast(o_orderkey % 40 as int) page, string_agg(kind || '=' || n, ';' order by kind) notes from (select o_orderkey % 40 o_orderkey, case when o_orderstatus = 'F' then 'a' else 'b' end kind, count(*) n from orders group by 1, 2) group by 1".replace("o_orderkey % 40 as int) page", "o_orderkey as int) page"))
def notes_by_page(s, d):
    g = table(s, d, "orders").groupBy(F.concat(F.lit("page "), (F.col("o_orderkey") % 40).cast("string")).alias("place"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("kind")).agg(F.count("*").alias("n"))
    other = g.limit(1).select(F.lit("model space").alias("place"), "kind", "n")
    notes = review.notes_by_page(g.unionByName(other).withColumn("shown", F.array(F.lit("x"))))
    return notes.select("page", F.array_join(F.transform("notes", lambda z: F.concat(z["kind"], F.lit("="), z["n"])), ";").alias("notes"))


@query("""with r as (select lpad(cast(o_orderkey as varchar), 10, '0') id, 'page ' || (o_orderkey % 12) place, o_orderkey % 7 = 0 wide, o_orderkey % 11 = 0 un, o_orderkey % 5 = 0 ns, o_orderpriority || o_orderkey shown from orders),
k as (select id, place, 'wider than the space' kind, shown from r where wide union all select id, place, case when un then 'not approved, so left in the original language' else 'the model was unsure' end, shown from r where un or ns
 union all select '', 'page ' || (c_custkey % 12), 'flagged by the reviewer', case when c_custkey % 20 = 0 then 'no note given' else 'note ' || c_custkey end from customer),
g as (select *, row_number() over (partition by place, kind order by id, shown) i, count(*) over (partition by place, kind) n from k),
l as (select place, kind, place || ': ' || kind || ' (' || any_value(n) || '): ' || string_agg(shown, '; ' order by i) filter (where i <= 4) || case when any_value(n) > 4 then ' and ' || (any_value(n) - 4) || ' more' else '' end line from g group by place, kind)
select 0 line_no, 'NOT verified: ' || count(*) filter (o_orderkey % 2 = 0) || ' written, ' || count(*) filter (o_orderkey % 2 = 1) || ' left; geometry moved' line from orders union all select row_number() over (order by cast(place[6:] as int), kind), line from l""")
def report_text(s, d):
    """The whole report: the verdict, then every place and kind with its number, the first four texts and how many more."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    o = table(s, d, "orders")
    result = o.agg(F.count_if(k % 2 == 0).alias("patched"), F.count_if(k % 2 == 1).alias("skipped"), F.lit(False).alias("ok"), F.array(F.lit("geometry moved")).alias("problems"))
    page = lambda x: F.concat(F.lit("page "), (x % 12).cast("string"))
    rows = o.select(F.lpad(k.cast("string"), 10, "0").alias("id"), F.when(k % 7 == 0, "overflow").otherwise("").alias("fit"), (k % 11 != 0).alias("approved"), (k % 5 != 0).alias("ok"), F.concat("o_orderpriority", k).alias("display"), F.lit("s").alias("source"), F.array(page(k)).alias("places"))
    flags = table(s, d, "customer").select(page(c).alias("place"), F.when(c % 20 == 0, " ").otherwise(F.concat(F.lit("note "), c)).alias("note"))
    return review.report(result, review.to_check(rows, flags)).select("line", "line_no")


# ---------------------------------------------------------------- sheets


def _boxes(s, d) -> DataFrame:
    k = F.col("c_custkey")
    x, y = ((k % 17) * 11.0).cast("double"), (F.floor(k / 17) % 13 * 7.0).cast("double")
    return table(s, d, "customer").select((k % 25).alias("job_id"), k.alias("box"), x.alias("x0"), y.alias("y0"), (x + 3 + k % 4).alias("x1"), (y + 2 + k % 3).alias("y1"), F.lit(5).cast("long").alias("n"), F.when(k % 3 > 0, F.concat(_pick(["A", "B"], k % 2), F.lit("-"), (k % 40).cast("string"))).otherwise("").alias("number"))


_BX = "bx as (select c_custkey % 25 job_id, c_custkey box, (c_custkey % 17) * 11.0::double x0, (c_custkey // 17) % 13 * 7.0::double y0, (c_custkey % 17) * 11.0::double + 3 + c_custkey % 4 x1, (c_custkey // 17) % 13 * 7.0::double + 2 + c_custkey % 3 y1, case when c_custkey % 3 > 0 then ['A', 'B'][c_custkey % 2 + 1] || '-' || (c_custkey % 40) else '' end number from customer)"
_SG = f"""{_BX}, sg as (select a.job_id, a.box, min(case when b.y0 <= a.y1 and b.y1 >= a.y0 and b.x0 - a.x1 >= 0 then b.x0 - a.x1 end) rgt, min(case when b.y0 <= a.y1 and b.y1 >= a.y0 and a.x0 - b.x1 >= 0 then a.x0 - b.x1 end) lft,
 min(case when b.x0 <= a.x1 and b.x1 >= a.x0 and b.y0 - a.y1 >= 0 then b.y0 - a.y1 end) abv, min(case when b.x0 <= a.x1 and b.x1 >= a.x0 and a.y0 - b.y1 >= 0 then a.y0 - b.y1 end) blw from bx a left join bx b on a.job_id = b.job_id and a.box <> b.box group by 1, 2)"""


@query(f"with {_SG} select box, rgt \"right\", lft \"left\", abv above, blw below from sg")
def sheet_side_gaps(s, d):
    return spatial.side_gaps(_boxes(s, d)).select("box", "right", "left", "above", "below")


def grown_sql(boxes: str, gaps: str, scale: str) -> str:
    """`gs` (job_id, box, x0, y0, x1, y1): boxes grown by their gaps (rgt, lft, abv, blw) and the job's median height h."""
    room = lambda g, lo, hi: f"case when {g} is not null then least({g} / 2, 0.3 * greatest({hi} - {lo}, 20 * h)) end"
    return f"""ge as (select b.*, {room('lft', 'x0', 'x1')} el, {room('rgt', 'x0', 'x1')} er, {room('blw', 'y0', 'y1')} ed, {room('abv', 'y0', 'y1')} eu, 0.12 * greatest(x1 - x0, y1 - y0, 20 * h) + 30 * h alone from {boxes} b join {gaps} using (job_id, box) join {scale} using (job_id)),
gf as (select *, coalesce(greatest(el, er, ed, eu), alone) other from ge), gg as (select job_id, box, x0 - coalesce(el, other) x0, y0 - coalesce(ed, other) y0, x1 + coalesce(er, other) x1, y1 + coalesce(eu, other) y1 from gf),
gs as (select job_id, box, x0, y0 - 0.6::double * greatest((x1 - x0) / 1.6::double - (y1 - y0), 0) y0, x1, y1 + (1 - 0.6::double) * greatest((x1 - x0) / 1.6::double - (y1 - y0), 0) y1 from gg)"""


@query(f"with {_SG}, sc as (select distinct job_id, 0.1::double + (job_id % 3) * 0.05::double h from bx), {grown_sql('bx', 'sg', 'sc')} select box, x0, y0, x1, y1 from gs")
def grown_sheets(s, d):
    b = _boxes(s, d)
    heights = b.select("job_id", (0.1 + (F.col("job_id") % 3) * 0.05).alias("h")).distinct()
    return sheets.grown(b, heights).select("box", "x0", "y0", "x1", "y1")


@query(f"with {_BX}, p as (select o_custkey % 25 job_id, o_orderkey ord, 'A-' || (o_orderkey % 90) number, (o_orderkey % 190) + 0.5::double px, (o_orderkey // 190 % 95) + 0.25::double py from orders where o_orderkey % 2 = 0) select bx.job_id, box, arg_max(p.number, ((px - x0) / (x1 - x0) - (py - y0) / (y1 - y0), -ord)) number from bx join p on p.job_id = bx.job_id and px between x0 and x1 and py between y0 and y1 group by 1, 2".replace("arg_max(p.number, ((px - x0) / (x1 - x0) - (py - y0) / (y1 - y0), -ord))", "first(p.number order by (px - x0) / (x1 - x0) - (py - y0) / (y1 - y0) desc, ord)"))
def sheet_numbers_by_job(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(F.lit(" A ー "), (k % 90).cast("string"))).otherwise("A-1-2")
    items = table(s, d, "orders").select((F.col("o_custkey") % 25).alias("job_id"), k.alias("ord"), text.alias("plain"), (k % 190 + 0.5).cast("double").alias("x"), (F.floor(k / 190) % 95 + 0.25).cast("double").alias("y"))
    return spatial.sheet_numbers(items, _boxes(s, d).drop("number")).select("job_id", "box", "number")


@query(f"""with {_BX}, z as (select *, case when job_id % 2 = 0 then case when number = '' then 'C' else number end else number end nm from bx), y as (select *, min(case when nm <> '' then 1 else 0 end) over (partition by job_id) = 1 named from z)
select box, cast(row_number() over (partition by job_id order by case when named then nm[1] end nulls first, case when named then coalesce(try_cast(nm[3:] as int), 0) end nulls first, case when not named then -round_even(y1 / 20.0::double, 0) end nulls first, case when not named then x0 end nulls first, box) as int) nth from y""")
def sheet_order(s, d):
    b = _boxes(s, d)
    name = F.when((F.col("job_id") % 2 == 0) & (F.col("number") == ""), "C").otherwise(F.col("number"))
    return sheets.in_order(b.withColumn("name", name), 20.0).select("box", "nth")


_VX = "vx as (select o_custkey % 20 job_id, 'model' place, o_orderkey // 4 entity, o_orderkey node, cast((o_orderkey % 2) * 6000 + (o_orderkey // 4) % 40 * 9000 as double) px, cast((o_orderkey // 2 % 2) * 5500 + (o_orderkey // 160) % 30 * 9000 as double) py from orders)"


@query(f"""with recursive {_VX}, span as (select job_id, place, greatest(max(px) - min(px), max(py) - min(py)) s from vx group by 1, 2), gp as (select job_id, place, greatest(2500.0, 0.01 * s) gap from span),
fe as materialized (select a.node a, b.node b from vx a join vx b on a.job_id = b.job_id and a.node <> b.node join gp on gp.job_id = a.job_id where a.entity = b.entity or (abs(a.px - b.px) <= gap and abs(a.py - b.py) <= gap)),
fc(node, label) using key (node) as (select node, node from vx union select fe.a, min(fc.label) from fc join fe on fe.b = fc.node join recurring.fc cur on cur.node = fe.a where fc.label < cur.label group by fe.a)
select job_id, min(px) x0, min(py) y0, max(px) x1, max(py) y1, count(*) n from vx join fc using (node) group by job_id, label having max(px) - min(px) >= 5000 and max(py) - min(py) >= 5000""")
def frames_by_layer(s, d):
    k = F.col("o_orderkey")
    v = table(s, d, "orders").select((F.col("o_custkey") % 20).alias("job_id"), F.lit("model").alias("place"), F.floor(k / 4).alias("entity"), k.alias("node"), ((k % 2) * 6000 + F.floor(k / 4) % 40 * 9000).cast("double").alias("px"), (F.floor(k / 2) % 2 * 5500 + F.floor(k / 160) % 30 * 9000).cast("double").alias("py"))
    return cluster.frames_by_layer(v).select("job_id", "x0", "y0", "x1", "y1", "n")


@query("select c_custkey id from customer where c_custkey % 4 in (1, 2)")
def frame_layers(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").where(cluster.on_frame_layer(_pick(["walls", "A-FRAME", "Рамка", "text"], k % 4))).select(k.alias("id"))


_GP = f"""{_PP}, ex as (select job_id, list_sort(list(x))[least(cast(floor(count(*) * 0.02) as bigint) + 1, count(*))] x0, list_sort(list(x))[greatest(cast(floor(count(*) * 0.98) as bigint), 1)] x1, list_sort(list(y))[least(cast(floor(count(*) * 0.02) as bigint) + 1, count(*))] y0, list_sort(list(y))[greatest(cast(floor(count(*) * 0.98) as bigint), 1)] y1,
 list_sort(list(height))[cast(floor(count(*) / 2) as bigint) + 1] h from pi group by 1)"""


@query(f"with {_GP} select job_id, x0 - 0.1 * (x1 - x0) x0, y0 - 0.1 * (y1 - y0) y0, x1 + 0.1 * (x1 - x0) x1, y1 + 0.1 * (y1 - y0) y1 from ex")
def text_extent(s, d):
    return cluster.text_extent(_lines(s, d), padding=0.1).select("job_id", "x0", "y0", "x1", "y1")


@query(f"with {_GP} select job_id, greatest(25 * h, 0.015 * greatest(x1 - x0, y1 - y0)) gap from ex")
def sheet_gap(s, d):
    t = _lines(s, d)
    return cluster.sheet_gap(t, cluster.text_extent(t)).select("job_id", "gap")


# ---------------------------------------------------------------- Latin forms

_IN = ["ГОСТ 123", "СНиП и СП-5", "・項目", "１２Ａ～Ｂ", "• пункт", "ПГОСТ", "〜", "ｶﾅ"]
_LATIN = ["GOST 123", "SNiP и SP-5", "- 項目", "12A~B", "- пункт", "ПГОСТ", "–", "カナ"]
_ASCII = ["ГОСТ 123", "СНиП и СП-5", "·項目", "12A~B", "• пункт", "ПГОСТ", "〜", "ｶﾅ"]


@query(f"select o_orderkey id, {_sql_list(_LATIN)}[o_orderkey % 8 + 1] || ' ' || o_orderpriority latin, {_sql_list(_ASCII)}[o_orderkey % 8 + 1] || ' ' || o_orderpriority ascii from orders")
def latin_forms(s, d):
    t = F.concat(_pick(_IN, F.col("o_orderkey") % 8), F.lit("　"), "o_orderpriority")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), X.latinize(t).alias("latin"), X.ascii_forms(t).alias("ascii"))
