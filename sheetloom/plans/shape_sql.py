"""Clusters, merged boxes and paragraphs in DuckDB: recursive expressions."""

from __future__ import annotations


def components_sql(gap: str) -> str:
    """`labelled` (job_id, place, node, px, py, label) from `pts` (job_id, place, node, px, py): single linkage, least node as label."""
    return f"""at_ as materialized (select job_id, place, px, py, min(node) node from pts group by 1, 2, 3, 4),
near_ as materialized (select a.node a, b.node b from at_ a join at_ b on a.job_id = b.job_id and a.place = b.place and a.node <> b.node and abs(a.px - b.px) <= {gap} and abs(a.py - b.py) <= {gap}),
cc_(node, label) using key (node) as (select node, node from at_ union select near_.a, min(cc_.label) from cc_ join near_ on near_.b = cc_.node join recurring.cc_ cur on cur.node = near_.a where cc_.label < cur.label group by near_.a),
labelled as materialized (select pts.*, cc_.label from pts join at_ using (job_id, place, px, py) join cc_ on cc_.node = at_.node)"""


def merged_sql(least: int = 5) -> str:
    """`mbox` (job_id, place, box, x0, y0, x1, y1, n): boxes of `labelled` with `least` members; overlapping ones joined, once and again."""
    step = lambda name, of: f"""{name}_e as materialized (select a.box a, b.box b from {of} a join {of} b on a.job_id = b.job_id and a.place = b.place and a.box <> b.box and a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1),
{name}_c(node, label) using key (node) as (select box, box from {of} union select e.a, min(c.label) from {name}_c c join {name}_e e on e.b = c.node join recurring.{name}_c cur on cur.node = e.a where c.label < cur.label group by e.a),
{name} as materialized (select job_id, place, label box, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, cast(sum(n) as bigint) n from {of} join {name}_c on box = node group by 1, 2, 3)"""  # noqa: E731
    return f"""box0 as materialized (select job_id, place, label box, min(px) x0, min(py) y0, max(px) x1, max(py) y1, count(*) n from labelled group by 1, 2, 3 having count(*) >= {least}),
{step('box1', 'box0')}, {step('box2', 'box1')}, {step('mbox', 'box2')}"""


def paragraph_sql(source: str) -> str:
    """`para` (job_id, place, layer, handle, paragraph, line) from `source` (job_id, place, layer, handle, ord, plain, lang, height, x, y, w)."""
    k = "job_id, place, layer"
    on = lambda a, b: f"{a}.job_id = {b}.job_id and {a}.place = {b}.place and {a}.layer = {b}.layer"
    cues = {
        "ja_end": r"[。．.!！?？:：;；」』）)]\s*$", "ends": r"[.!?:;]\s*$", "bullet": r"^\s*([・･\-–—■□●○※◆▪*•●◇]|\(?[0-9]+[)）.．:]|[①-⑳]|[（(][0-9]+[)）]|[a-zA-Z][.)）])",
        "heading": r"^\s*[■□●○◆◇▪]", "table": r"[^\s　]\s{3,}[^\s　]|[^\s　]　{2,}[^\s　]", "small": r"^\s*\p{Ll}", "joiner": r"[,\-‑–]\s*$",
    }
    is_ = lambda c, name: f"regexp_matches({c}, '{cues[name]}')"
    reads = f"""not ({is_('plain', 'bullet')} or {is_('pp', 'heading')} or {is_('pp', 'table')} or {is_('plain', 'table')}) and case when lang = 'ja' then not {is_('pp', 'ja_end')} else not {is_('pp', 'ends')} and ({is_('plain', 'small')} or {is_('pp', 'joiner')}) end"""
    return f"""p_h as (select {k}, list_sort(list(height))[cast(floor(count(*) / 2) as bigint) + 1] h from {source} group by {k}),
p_x as (select {k}, x, row_number() over (partition by {k} order by x) i from (select distinct {k}, x from {source})),
p_col({k}, i, x, a) as (select {k}, i, x, x from p_x where i = 1 union all select n.job_id, n.place, n.layer, n.i, n.x, case when n.x - c.a > 2.5 * h then n.x else c.a end from p_col c join p_x n on {on('c', 'n')} and n.i = c.i + 1 join p_h on {on('p_h', 'n')}),
p_c as materialized (select s.*, c.a, h, row_number() over w pos, min(s.x) over v lft, max(s.x + s.w) over v most, lag(plain) over w pp, lag(s.y) over w py, lag(s.x + s.w) over w pr from {source} s join p_col c on {on('s', 'c')} and s.x = c.x join p_h on {on('p_h', 's')}
 window w as (partition by s.job_id, s.place, s.layer, c.a order by s.y desc, s.x, s.ord, s.handle), v as (partition by s.job_id, s.place, s.layer, c.a)),
p_l as materialized (select *, pp is not null and py - y between 0.8 * h and 2.6 * h and (most - lft <= 0 or pr - lft >= 0.5 * (most - lft)) and {reads} link from p_c),
p_run({k}, a, pos, fx, fh, start) as (select {k}, a, pos, x, height, pos from p_l where pos = 1 union all
 select n.job_id, n.place, n.layer, n.a, n.pos, case when ok then r.fx else n.x end, case when ok then r.fh else n.height end, case when ok then r.start else n.pos end
 from (select r.*, n.pos np, n.link and n.x - r.fx between -0.5 * n.h and 2.5 * n.h and abs(n.height - r.fh) <= 0.1 * r.fh ok from p_run r join p_l n on {on('r', 'n')} and r.a = n.a and n.pos = r.pos + 1) r join p_l n on {on('r', 'n')} and r.a = n.a and n.pos = r.np),
p_g as (select l.*, r.start, count(*) over g size, first_value(handle) over o fhandle, first_value(lang) over o flang, last_value(plain) over o final from p_l l join p_run r on {on('l', 'r')} and l.a = r.a and l.pos = r.pos
 window g as (partition by l.job_id, l.place, l.layer, l.a, r.start), o as (partition by l.job_id, l.place, l.layer, l.a, r.start order by l.pos rows between unbounded preceding and unbounded following)),
para as materialized (select {k}, handle, case when size > 1 and flang = 'ja' and not {is_('final', 'ja_end')} then handle else fhandle end paragraph, cast(case when size > 1 and flang = 'ja' and not {is_('final', 'ja_end')} then 0 else pos - start end as int) line from p_g)"""
