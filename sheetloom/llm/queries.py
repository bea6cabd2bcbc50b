"""Queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontaminate, infill, langid, linededup, mixing, neardup, ngramjoin, phrasededup, pii, secrets, suffixdedup
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": lambda s, d: suffixdedup.op1(table(s, d, "documents")),
        "op2_pii": lambda s, d: pii.op2(table(s, d, "documents")),
        "op3_ann": lambda s, d: ann.op3(table(s, d, "embeddings")),
        "op4_secrets": lambda s, d: secrets.op4(table(s, d, "documents")),
        "op5_entropy_mixing": lambda s, d: mixing.op5(table(s, d, "documents")),
        "op6_language_id": lambda s, d: langid.op6(table(s, d, "documents")),
        "op7_decontaminate": lambda s, d: decontaminate.op7(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_line_dedup": lambda s, d: linededup.op10(table(s, d, "documents")),
        "op8_phrase_dedup": lambda s, d: phrasededup.op8(table(s, d, "documents")),
        "op9_near_dedup": lambda s, d: neardup.op9(table(s, d, "documents")),
        "op11_token_alignment": lambda s, d: alignment.op11(table(s, d, "documents")),
        "op13_ngram_join": lambda s, d: ngramjoin.op13(table(s, d, "documents")),
        "op12_fill_in_middle": lambda s, d: infill.op12(table(s, d, "documents")),
    }


_SPLIT = r"""w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents)"""

_OP8 = rf"""with {_SPLIT}, p as (select doc_id, ws, u.i i from w, lateral (select unnest(range(1, len(ws) + 1)) as i) u),
g as (select doc_id, i, ws[i] word, case when i + 34 <= len(ws) then md5(array_to_string(ws[i:i + 34], ' ')) end h from p),
c as (select h from g where h is not null group by h having count(*) > 1),
r as (select g.doc_id, i, word, max(case when c.h is not null then 1 else 0 end) over (partition by g.doc_id order by i rows between 34 preceding and current row) gone from g left join c on g.h = c.h),
s as (select doc_id, cast(sum(gone) as bigint) n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) kept from r group by doc_id)
select w.doc_id, len(ws) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join s on w.doc_id = s.doc_id"""

_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP7 = rf"""with b as (select item_id, {_LOW} ws from benchmark), bw as (select distinct item_id, least(10, len(ws)) size, array_to_string(ws[u.i:u.i + least(10, len(ws)) - 1], ' ') t
  from b, lateral (select unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i) u where len(ws) > 0),
d as (select doc_id, {_LOW} ws from documents), sizes as (select distinct size from bw),
dw as (select doc_id, size, u.i i, array_to_string(ws[u.i:u.i + size - 1], ' ') t from d, sizes, lateral (select unnest(range(1, len(ws) - size + 2)) as i) u where len(ws) >= size),
hits as (select doc_id, i, dw.size, item_id from dw join bw on dw.size = bw.size and dw.t = bw.t),
words as (select distinct doc_id, i + u.k pos from hits, lateral (select unnest(range(0, size)) as k) u), nh as (select doc_id, count(*) n from words group by doc_id),
it as (select doc_id, count(distinct item_id) n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hits group by doc_id)
select d.doc_id, len(ws) n_words, coalesce(nh.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(nh.n, 0) > 0 contaminated from d left join nh on d.doc_id = nh.doc_id left join it on d.doc_id = it.doc_id"""

_OP9 = rf"""with recursive {_SPLIT}, sh as (select doc_id, array_to_string(ws[u.i:u.i + 4], ' ') s, count(*) n from w, lateral (select unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i) u where len(ws) > 0 group by 1, 2),
size as (select doc_id, sum(n) n from sh group by doc_id), pr as (select a.doc_id a, b.doc_id b, sum(least(a.n, b.n)) n from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e0 as (select a, b from pr join size x on a = x.doc_id join size y on b = y.doc_id where pr.n >= 0.8 * (x.n + y.n - pr.n)), e as (select a, b from e0 union all select b, a from e0),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, e.b from reach join e on reach.b = e.a), cls as (select a doc_id, min(b) class_id from reach group by a)
select doc_id, class_id, count(*) over (partition by class_id) n_class from cls"""

_OP10 = r"""with l as (select doc_id, string_split(text, chr(10)) a from documents where text is not null), ln as (select doc_id, u.i - 1 ln, list_sort(list_distinct(regexp_extract_all(a[u.i], '[^\x20\x09-\x0D]+'))) ts from l, lateral (select unnest(range(1, len(a) + 1)) as i) u),
f as (select ts, min(doc_id * 1000000 + ln) o, row_number() over (order by min(doc_id * 1000000 + ln)) id from ln where len(ts) > 0 group by ts),
tok as (select id, len(ts) n, unnest(ts) t from f), fr as (select t, count(*) c from tok group by t),
pos as (select id, n, tok.t, row_number() over (partition by id order by c, tok.t) p from tok join fr on tok.t = fr.t), pre as (select id, n, t from pos where p <= n - (4 * n + 4) // 5 + 1),
cand as (select distinct x.id x, y.id y from pre x join pre y on x.t = y.t and y.id < x.id and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
near as (select distinct x from (select x, len(list_intersect(a.ts, b.ts)) m, len(a.ts) na, len(b.ts) nb from cand join f a on x = a.id join f b on y = b.id) where 9 * m >= 4 * (na + nb)),
gone as (select doc_id, ln from ln join f on ln.ts = f.ts left join near on f.id = near.x where near.x is not null or doc_id * 1000000 + ln <> o),
g as (select doc_id, count(*) n, string_agg(cast(ln as varchar), ',' order by ln) removed from gone group by doc_id)
select d.doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end n_lines, coalesce(g.n, 0) n_removed, coalesce(removed, '') removed from documents d left join g on d.doc_id = g.doc_id"""

_OP12 = r"""with t as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
d as (select doc_id, t, length(t) n, cast('0x' || h[1:8] as ubigint) % (length(t) + 1) c1, cast('0x' || h[9:16] as ubigint) % (length(t) + 1) c2, cast('0x' || h[17:24] as ubigint) % 100 f, cast('0x' || h[25:32] as ubigint) % 100 o from t),
c as (select *, cast(least(c1, c2) as bigint) p, cast(greatest(c1, c2) as bigint) q, case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or f >= 90 then 'plain' when o < 20 then 'spm' else 'psm' end form from d),
x as (select *, substring(t, 1, p) a, substring(t, p + 1, q - p) m, substring(t, q + 1) z from c)
select doc_id, n, form, case when form <> 'plain' then p end prefix_chars, case when form <> 'plain' then q - p end middle_chars, sha256(t) restored_sha256,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || m else '<S>' || z || '<P>' || a || '<M>' || m end) output_sha256 from x"""

_OP13 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sh as (select distinct doc_id, array_to_string(ws[u.i:u.i + 4], ' ') s from w, lateral (select unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i) u where len(ws) > 0),
size as (select doc_id, count(*) n from sh group by doc_id), pr as (select a.doc_id a, b.doc_id b, count(*) n from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e0 as (select a, b from pr join size x on a = x.doc_id join size y on b = y.doc_id where 100 * pr.n >= 80 * (x.n + y.n - pr.n)), e as (select a, b from e0 union all select b, a from e0),
reach(a, b) as (select doc_id, doc_id from documents union select reach.a, e.b from reach join e on reach.b = e.a)
select d.doc_id, coalesce(size.n, 0) n_shingles, c.b component_id from documents d left join size on d.doc_id = size.doc_id join (select a, min(b) b from reach group by a) c on d.doc_id = c.a"""


def oracle_sql() -> dict[str, str]:
    """Brute force in SQL; offsets of matches, byte windows, fitted models and roundings are beyond it and are held by tests."""
    return {"op7_decontaminate": _OP7, "op8_phrase_dedup": _OP8, "op9_near_dedup": _OP9, "op10_line_dedup": _OP10, "op12_fill_in_middle": _OP12, "op13_ngram_join": _OP13}
