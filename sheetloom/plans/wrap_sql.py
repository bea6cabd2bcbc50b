"""The wrap search in DuckDB: a recursive walk over words for all texts, rooms and factors at once."""

from __future__ import annotations

from sheetloom.functions import measure as M


def wrap_sql(source: str) -> str:
    """Common table expressions from `source` (id, txt, caps, beside, most, spare) to w_lines (id, n, line) and w_fit (id, f, ovr, used)."""
    em = lambda c: f"cast(round({M.em_width_sql(c)} * 100) as bigint)"
    return f"""w_in as materialized (select id, txt, caps, beside, most, spare, {em('txt')} wide from {source}),
w_room as (select id, 0 rank, 0 nr, caps c, most lim from w_in union all select id, 0, 1, caps, most + spare from w_in where spare > 0
 union all select id, 1, 2, list_transform(caps, lambda c, k: least(beside[k], greatest(c, wide / 100.0 / greatest(most, 1) * 1.05))), most from w_in where beside <> caps),
w_par as (select id, u.p, string_split(txt, chr(10))[u.p] t from w_in, lateral (select unnest(range(1, len(string_split(txt, chr(10))) + 1)) as p) u),
w_word as materialized (select id, p, w, row_number() over (partition by id order by p, k) i, {em('w')} own from (select id, p, u.k, string_split(t, ' ')[u.k] w from w_par, lateral (select unnest(range(1, len(string_split(t, ' ')) + 1)) as k) u)),
w_factor as (select unnest([100, 95, 90, 85, 80, 75, 70, 65, 60]) f),
w_walk(id, nr, f, i, p, lno, width, started, head) as (select r.id, r.nr, f, 1::bigint, p, 1::bigint, own, w <> '', 1::bigint from w_room r, w_factor, w_word where w_word.id = r.id and w_word.i = 1
 union all select s.id, s.nr, s.f, w.i, w.p, case when brk then s.lno + 1 else s.lno end, case when not brk and s.started then s.width + 35 + w.own else w.own end, case when not brk and s.started then true else w.w <> '' end, case when not brk and s.started then s.head else w.i end
 from (select s.*, w.i wi, w.p <> s.p or (s.started and (s.width + 35 + w.own) / 100.0 > r.c[least(s.lno, len(r.c))] / (s.f / 100.0)) brk from w_walk s join w_word w on w.id = s.id and w.i = s.i + 1 join w_room r on r.id = s.id and r.nr = s.nr) s join w_word w on w.id = s.id and w.i = s.wi),
w_end as materialized (select id, nr, f, lno, max(i) last, max(head) head, arg_max(started, i) kept from w_walk group by 1, 2, 3, 4),
w_count as (select id, nr, f, greatest(count(*) filter (kept), 1) n from w_end group by 1, 2, 3),
w_try as (select c.id, c.nr, r.rank, c.f, n > lim ovr, lim from w_count c join w_room r on c.id = r.id and c.nr = r.nr),
w_settled as (select id, nr, rank, lim, bool_and(ovr) ovr, coalesce(max(f) filter (not ovr), 60) f from w_try group by 1, 2, 3, 4),
w_best as materialized (select * from w_settled qualify row_number() over (partition by id order by ovr, rank, -f, nr) = 1),
w_raw as (select e.id, e.lno, b.lim, b.ovr, row_number() over (partition by e.id order by e.lno) n, (select string_agg(w, ' ' order by i) from w_word w where w.id = e.id and w.i between e.head and e.last) line from w_best b join w_end e on e.id = b.id and e.nr = b.nr and e.f = b.f where e.kept),
w_lines as (select id, least(n, lim) n, string_agg(line, ' ' order by n) line from w_raw group by 1, 2),
w_fit as (select b.id, b.f / 100.0::double f, b.ovr, coalesce((select count(*) from w_lines l where l.id = b.id), 0) used from w_best b)"""
