"""DuckDB SQL that the queries are checked against."""

from __future__ import annotations

from passagelake.llm.quality import RULES, STOP_WORDS


def _quality() -> str:
    stop = ", ".join(f"'{form}'" for form in dict.fromkeys(form for w in STOP_WORDS for form in (w, w.capitalize())))

    def holds(r) -> str:
        bottom = "1.0" if r.bottom is None else f"{r.bottom}::double"
        parts = [f"{r.top} >= {bottom} * {r.low}::double"] * (r.low is not None) + [f"{r.top} <= {bottom} * {r.high}::double"] * (r.high is not None)
        return "(" + " and ".join(parts) + ")"

    flags = ",\n".join(f"{holds(r)} as ok_{r.name}" for r in RULES)
    every = " and ".join(f"ok_{r.name}" for r in RULES)
    blank = r"'[\x20\x09-\x0D]+'"
    odd = "chr(9) || chr(11) || chr(12) || chr(13)"
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, {blank}), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: length(trim(translate(x, {odd}, '    '), ' ')) > 0) as ls from d),
p as (select rid, unnest(range(0, len(ws) - 4)) as i, ws from w where len(ws) >= 5),
g as (select rid, i, ws[i + 1 : i + 5] as g from p),
r as (select rid, i from (select *, count(*) over (partition by rid, g) as n from g) where n > 1),
c as (select rid, count(distinct pos) as n from (select rid, unnest(range(i, i + 5)) as pos from r) group by rid),
m as (select doc_id, len(ws)::bigint as n_words,
        length(translate(t, ' ' || chr(10) || {odd}, ''))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words,
        len(ls)::bigint as n_lines,
        len(list_filter(ws, lambda x: x in ({stop})))::bigint as n_stop_words,
        len(list_filter(ls, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::bigint as n_bullet_lines,
        len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') or ends_with(rtrim(x, ' '), '…')))::bigint as n_cut_lines
      from w left join c using (rid)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {flags} from m)
select *, not base_failed and {every} as kept from j
"""


QUALITY = _quality()

LINE_DEDUP = """
with l as (select rid, doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place
           from (select row_number() over (order by doc_id) as rid, doc_id, text from documents)),
w as (select *, row_number() over (partition by rid order by place) - 1 as pos from l
      where length(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ')) > 0),
g as (select rid, doc_id, pos, [line, lead(line, 1) over v, lead(line, 2) over v] as win, [place, lead(place, 1) over v, lead(place, 2) over v] as places
      from w window v as (partition by rid order by pos)),
f as (select *, count(*) over (partition by win) as n, row_number() over (partition by win order by doc_id, pos) as k,
        first_value(rid) over (partition by win order by doc_id, pos) as frid, first_value(pos) over (partition by win order by doc_id, pos) as fat
      from g where win[3] is not null),
c as (select distinct rid, unnest(places) as place from f where k > 1 and (rid <> frid or pos >= fat + 3)),
s as (select l.rid, string_agg(l.line, chr(10) order by l.place) as text from l left join c using (rid, place) where c.rid is null group by l.rid),
t as (select rid, count(*) as n from w group by rid),
r as (select rid, count(*) as n from c group by rid)
select d.doc_id, coalesce(t.n, 0)::bigint as n_lines, coalesce(r.n, 0)::bigint as n_removed,
  case when d.text is null then null else coalesce(s.text, '') end as text
from (select row_number() over (order by doc_id) as rid, doc_id, text from documents) d
left join s using (rid) left join t using (rid) left join r using (rid)
"""

JACCARD = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, array_to_string(ws[i + 1 : i + 4], ' ') as sh from (select doc_id, ws, unnest(range(0, len(ws) - 3)) as i from w where len(ws) >= 4)
    union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 3)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(node, root) as (select a, a from l union select l.b, r.root from r join l on l.a = r.node),
c as (select node, min(root) as root from r group by node)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.root, w.doc_id) as component_id
from w left join n using (doc_id) left join c on c.node = w.doc_id
"""

# crc32 (reflected polynomial 0xEDB88320) of text: its byte table, and a fold over the UTF-8 bytes of code points below U+0800
_CRC_TABLE = """
t as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc)"""


def _crc32(text: str) -> str:
    point = "unicode(c)::bigint"
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda c: case when {point} < 128 then [{point}] else [192 + ({point} >> 6), 128 + ({point} & 63)] end))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {utf8}), lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])))"


def _leaf(text: str) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
with recursive {_CRC_TABLE},
d as (select doc_id, source, {_leaf("text")} as leaf,
        case when {_crc32("doc_id::varchar")} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as checked
      from documents, t),
l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n,
        row_number() over (order by source, doc_id, leaf) as rid from d),
s(source, level, pos, h, n) as (
  select source, 0, pos, leaf, n from l
  union all select source, level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from s where n > 1 group by source, level, pos // 3, n),
sub as (select source, h, row_number() over (order by encode(source) nulls first) - 1 as pos, count(*) over () as n from s where n = 1),
u(level, pos, h, n) as (
  select 0, pos, h, n from sub
  union all select level + 1, pos // 3, sha256(string_agg(h, '' order by pos)), (n + 2) // 3 from u where n > 1 group by level, pos // 3, n),
nodes as (select source, level, pos, h, n, false as above from s union all select null, level, pos, h, n, true from u),
f(rid, source, high, level, above, pos, n, h, proof) as (
  select rid, source, 0, 0, false, pos, n, checked, '' from l
  union all
  select rid, source, high + 1, case when n > 1 then level + 1 else 0 end, above or n = 1,
    case when n > 1 then pos // 3 else (select sub.pos from sub where sub.source is not distinct from f.source) end,
    case when n > 1 then (n + 2) // 3 else (select max(sub.n) from sub) end,
    case when n > 1 then sha256(coalesce(before, '') || f.h || coalesce(after, '')) else f.h end,
    case when n > 1 then proof || coalesce(before, '') || coalesce(after, '') else proof end
  from f left join lateral (
    select string_agg(nodes.h, '' order by nodes.pos) filter (nodes.pos < f.pos) as before, string_agg(nodes.h, '' order by nodes.pos) filter (nodes.pos > f.pos) as after
    from nodes where f.n > 1 and nodes.above = f.above and (f.above or nodes.source is not distinct from f.source) and nodes.level = f.level
      and nodes.pos // 3 = f.pos // 3) on true
  where n > 1 or not above),
root as (select h from u where n = 1),
e as (select rid, h, proof from f where above and n = 1)
select k.doc_id, k.leaf, sub.h as subroot, root.h as root, sha256(e.proof) as proof_sha256, e.h as folded_root, e.h = root.h as verified
from l k join e using (rid) join sub on sub.source is not distinct from k.source, root
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = f"""
with recursive {_CRC_TABLE},
r as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) as run from documents),
c as (select run, n, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from (select doc_id, run, count(*) as n from r group by all), t),
w as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from c),
v as (select word, sum(n)::bigint as n from w where length(word) >= 5 group by word having sum(n) >= 3),
x as (select word, n, left(word, i::int) as a, substr(word, i::int + 2) as b from (select *, unnest(range(length(word))) as i from v)),
p as (
  select x.word, y.word as other, y.n as m from x join x y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, v.word, v.n from x join v on x.a || x.b = v.word
  union select v.word, x.word, x.n from x join v on x.a || x.b = v.word),
g as (select word, count(*) as n_near, min(struct_pack(m := -m, other := other)) as best from p group by word),
o as (select v.word, v.n, coalesce(g.n_near, 0)::bigint as n_near, case when -best.m >= 2 * v.n then best.other end as form,
        case when -best.m >= 2 * v.n then -best.m end as form_n from v left join g using (word)),
q(word, root) as (select word, word from o union all select q.word, o.form from q join o on o.word = q.root where o.form is not null),
z as (select q.word, q.root from q join o on o.word = q.root where o.form is null)
select o.word, o.form, z.root, o.n, o.n_near, o.form_n::bigint as form_n from o join z using (word)
"""
