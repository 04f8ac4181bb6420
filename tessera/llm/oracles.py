"""SQL that DuckDB runs over the same tables, for the queries that SQL can express."""

from __future__ import annotations

from .fingerprint import HEAD, PARAGRAPH, SMALL
from .mixing import CURRICULUM
from .queries import VOCABULARY
from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, LOGIN, LOOSE

ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"'[^\x20\x09-\x0D]+'"
PIECES = r"'[0-9a-z\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0D]'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Positions: of constant-sum curricula (one segment a source), by the quadratic's root.
_slopes = [(s[0][1], s[-1][1]) for s in CURRICULUM]


def _position(s: str) -> str:
    roots = " ".join(
        f"when {i} then case when {s} * {(a + b) / 2} > 0 then 2 * {s} * {(a + b) / 2} / ({float(a)} + sqrt({float(a * a)} + {float(2 * (b - a))} * {s} * {(a + b) / 2})) else 0.0 end" for i, (a, b) in enumerate(_slopes)
    )
    return f"case rank % 3 {roots} end"


ORACLES["op1_mix_sources"] = f"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) key, coalesce(len(regexp_extract_all(text, {SPACED})), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 rank from s),
w as (select *, case rank % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end weight, (source_size * 2)::bigint cap from r),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) lvl from w),
m as (select arg_min(lvl, struct_pack(a := cap / weight, b := rank)) filter (where lvl <= cap / weight) water from l),
t as (select source, source_size, rank, least(cap::double, coalesce(water, 'inf'::double) * weight) target from l, m),
o as (select d.*, source_size, target, rank, coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start
  from d join t on d.source is not distinct from t.source),
k as (select *, (greatest(least(round(target)::bigint - start, size), 0) + greatest(least(round(target)::bigint - start - source_size, size), 0))::bigint taken, start / greatest(target, 1.0) s,
  case when size = 0 then null when round(target)::bigint > start + source_size then start + source_size when round(target)::bigint > start then start end / greatest(target, 1.0) s2 from o)
select doc_id, size, source_size, target, taken, round(case when taken > 0 then {_position('s')} end, 9) as position, round(case when taken > 0 then {_position('s2')} end, 9) as last_position from k
"""

_base32 = (
    "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "((('0x' || substr(sha1(html), (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), 'string_agg', '')"
)
ORACLES["op2_warc"] = f"""
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html))::bigint payload_bytes, {_base32} payload_digest, max(page_id) over (partition by html) top from p)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type, case when page_id <> top then top end refers_to from d
"""

_lowered = f"translate(text, '{UPPER}', '{LOWER}')"
ORACLES["op3_jaccard_join"] = f"""
with recursive w as (select doc_id, regexp_extract_all(coalesce({_lowered}, ''), {SPACED}) ws from documents),
g as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) s from w),
n as (select doc_id, count(*) n from g group by doc_id),
b as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select x, y from b join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
e2 as (select x, y from e union select y, x from e),
r(doc_id, root) as (select doc_id, doc_id from documents union select e2.y, r.root from r join e2 on e2.x = r.doc_id)
select doc_id, coalesce(any_value(n), 0)::bigint n_shingles, min(root) component_id from r left join n using (doc_id) group by doc_id
"""

_cut = lambda t, p: f"regexp_extract_all({t}, {_literal(p.replace('+[', '[').replace('*+', '*').replace('}+', '}'))})"
_pieces = lambda t: f"list_distinct(list_transform(list_filter(list_concat({_cut(f'substr({t}, 1, {HEAD})', SMALL)}, {_cut(f'substr({t}, {HEAD + 1})', PARAGRAPH)}), lambda p: p <> ''), lambda p: ('0x' || substr(md5(p), 1, 15))::bigint))"
_like = lambda b: f"case when len(a) + len({b}) = 0 then 1.0::double else 1.0::double - (len(a) + len({b}) - 2 * len(list_intersect(a, {b})))::int / (len(a) + len({b}))::double end"
# Sketches are told apart by their digests; of each, sizes are tried by taking digests off that have a cell of their own, round by round, until none is left.
ORACLES["op4_fingerprints"] = f"""
with recursive o as (select doc_id, row_number() over () rid, coalesce(text, '') text, coalesce(lead(coalesce(text, '')) over w, first(coalesce(text, '')) over w) next from documents window w as (order by doc_id rows between unbounded preceding and unbounded following)),
e as (select *, length(text)::bigint n_chars, substr(text, 1, length(text) - length(text) // 4) || substr(next, 1, length(text) // 4) edited from o),
p as materialized (select rid, doc_id, n_chars, sha256(edited) edited_sha256, {_pieces('text')} a, {_pieces('edited')} e, {_pieces('next')} x from e),
k as (select rid, side, len(l) n, l from (select rid, 'a' side, a l from p union all select rid, 'e', e from p) where len(l) > 0),
s as (select *, greatest(4, 1 << length(bin(((2 * n + 8) // 3)::int - 1)))::bigint m0 from k),
c as (select rid, side, (m0 << t) m, unnest(l) d from s, (select unnest(range(0, 6)) t)),
r(rid, side, m, d, round) as (select rid, side, m, d, 0 from c
  union all select rid, side, m, d, round + 1 from (select *, count(*) over (partition by rid, side, m, (d >> 3) % m) c0, count(*) over (partition by rid, side, m, (d >> 20) % m) c1, count(*) over (partition by rid, side, m, (d >> 37) % m) c2 from r)
    where c0 > 1 and c1 > 1 and c2 > 1 and round < 30),
stuck as (select distinct rid, side, m from r where round = 30),
z as (select rid, side, min(m) m from (select distinct rid, side, m from c) anti join stuck using (rid, side, m) group by all),
f as (select rid, side, m, row * m + (d >> (row * 17 + 3)) % m i, count(*) n, bit_xor(d) x, bit_xor((d % 65521) * (d % 65519) % 65536) c from c join z using (rid, side, m), (select unnest(range(0, 3)) row) group by all),
g as (select rid, side, any_value(m) || ':' || string_agg(concat_ws('.', i, n, format('{{:x}}', x), format('{{:x}}', c)), '-' order by i) fingerprint from f group by all)
select doc_id, n_chars, edited_sha256, coalesce(ga.fingerprint, '') fingerprint, coalesce(ge.fingerprint, '') edited_fingerprint, {_like('e')} near_edited, {_like('x')} near_next
from p left join g ga on ga.rid = p.rid and ga.side = 'a' left join g ge on ge.rid = p.rid and ge.side = 'e'
"""

ORACLES["op7_winnowing"] = f"""
with i as (select coalesce(item_id::varchar, '') item, regexp_extract_all(coalesce({_lowered}, ''), {ALNUM}) ws from benchmark),
win as (select distinct item, least(10, len(ws)) n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda j: array_to_string(ws[j:j + 9], ' '))) s from i where len(ws) > 0),
d as (select doc_id, row_number() over () rid, regexp_extract_all(coalesce({_lowered}, ''), {ALNUM}) ws from documents),
sizes as (select distinct n from win),
g as (select rid, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda j: struct_pack(j := j, s := array_to_string(ws[j:j + n - 1], ' ')))) v from d, sizes where len(ws) >= n),
h as (select rid, item, g.v.j j, g.n n from g join win on g.n = win.n and g.v.s = win.s),
hits as (select rid, count(*) n_hit from (select distinct rid, unnest(range(j, j + n)) k from h) group by rid),
items as (select rid, count(*) n_items, string_agg(item, ',' order by item) its from (select distinct rid, item from h) group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(its, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (rid) left join items using (rid)
"""

_KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("login", LOGIN, 1, 3), ("loose", LOOSE, 0, 20), ("endpoint", ENDPOINT, 0, 8))
_found = " union all ".join(
    f"select rid, {k} kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack("
    "a := coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), "
    f"n := length(m[i]), g := length(gs[i]), s := m[i]))) v, {least} least from "
    f"(select rid, regexp_split_to_array(text, {_literal(p)}) p, regexp_extract_all(text, {_literal(p)}) m, regexp_extract_all(text, {_literal(p)}, {group}) gs from d where regexp_matches(text, {_literal(p)}))"
    for k, (_, p, group, least) in enumerate(_KINDS)
)
_name = "case kind " + " ".join(f"when {i} then '{k[0]}'" for i, k in enumerate(_KINDS)) + " end"
ORACLES["op8_secrets"] = f"""
with d as (select doc_id, row_number() over () rid, coalesce(text, '') text from documents),
f as ({_found}),
s as (select rid, kind, v.a::bigint a, (v.a + v.n)::bigint b, v.s s from f where v.g >= least and (kind <> 4 or regexp_matches(v.s, '[0-9]') and regexp_matches(v.s, '[A-Za-z]'))),
c as (select * from s x where kind < 3 or not exists (select 1 from s y where x.rid = y.rid and y.a < x.b and x.a < y.b and (y.kind < 3 or x.kind = 4 and y.kind in (3, 5)))),
k as (select x.rid, x.kind, x.a, x.b, bool_or(y.kind in (1, 3)) login, bool_or(y.kind in (0, 2, 4)) secret from c x join c y on x.rid = y.rid and x.a between y.a - 200 and y.b + 200 where x.kind >= 3 group by all),
r as (select rid, kind, a, b from c where kind < 3 union all select rid, kind, a, b from k where case kind when 3 then secret when 4 then login else login and secret end),
t as (select rid, count(*) filter (where kind = 0) n_assign, count(*) filter (where kind = 1) n_access, count(*) filter (where kind = 2) n_hex,
  string_agg({_name} || ':' || a || ':' || b, ',' order by a, kind) filter (where kind < 3) base, string_agg({_name} || ':' || a || ':' || b, ',' order by a, kind) spans from r group by rid)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join t using (rid)
"""

ORACLES["op6_quotations"] = r"""
with recursive m as (select conv_id, turn, role, text, row_number() over () rid, string_split_regex(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '\r?\n') ls from conversations),
l as (select rid, conv_id, turn, i, length(regexp_replace(regexp_extract(ls[i], '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) level, regexp_replace(ls[i], '^[ \t]*(?:>[ \t]?)+', '') body
  from (select *, unnest(range(1, len(ls) + 1)) i from m)),
a as (select * replace (case when level = 0 and regexp_matches(body, '(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$') and coalesce(lead(level) over (partition by rid order by i), 0) > 0 then -1 else level end as level) from l),
b as (select *, case when lag(level) over w = level and not regexp_matches(body, '^[ \t]*$') then 0 else 1 end begins from a window w as (partition by rid order by i)),
n as (select *, sum(begins) over (partition by rid order by i) run from b),
p as (select rid, conv_id, turn, run, any_value(level) level, string_agg(body, chr(10) order by i) body from n group by all),
pc as (select rid, conv_id, turn, run, level, unnest(list_distinct(list_filter(list_transform(list_concat(string_split(body, chr(10)), string_split_regex(replace(body, chr(10), ' '), '[.!?]+[ \t\n\r\f]+')),
  lambda x: trim(regexp_replace(lower(x), '[^\pL\pN]+', ' ', 'g'))), lambda x: x <> ''))) piece from p),
reply as (select rid, regexp_replace(string_agg(body, chr(10) order by i) filter (where level = 0), '^\s+|\s+$', '', 'g') reply from a group by rid),
said as (select conv_id, piece, min(turn) source from pc where level = 0 and turn is not null group by all),
q as (select pc.rid, pc.conv_id, pc.turn, run, level, max(case when source is not null then struct_pack(size := length(pc.piece), source := source) end).source source
  from pc left join said on pc.conv_id is not distinct from said.conv_id and pc.piece = said.piece and source < pc.turn where level > 0 and pc.turn is not null group by all),
o as (select conv_id, turn, max(source) filter (where level = 1) parent, count(*) n_quoted, count(source) n_linked, max(level) max_level from q group by all),
r as (select conv_id, turn, parent root, case when parent is null then 0 else 1 end depth from o
  union all select r.conv_id, r.turn, o.parent, depth + 1 from r join o on r.conv_id is not distinct from o.conv_id and r.root = o.turn where o.parent is not null),
t as (select conv_id, turn, arg_max(root, depth) root, max(depth) depth from r group by all),
e as (select m.conv_id, m.turn, m.role, coalesce(reply, '') reply, parent, coalesce(t.root, m.turn) root, coalesce(t.depth, 0)::int depth, coalesce(n_quoted, 0)::bigint n_quoted, coalesce(n_linked, 0)::bigint n_linked, coalesce(max_level, 0)::int max_level
  from m left join reply using (rid) left join o on m.conv_id is not distinct from o.conv_id and m.turn = o.turn left join t on m.conv_id is not distinct from t.conv_id and m.turn = t.turn)
select *, row_number() over (order by conv_id nulls first, root nulls first, turn nulls first, role nulls first, reply) - 1 as position from e
"""

# Pieces and words in hexadecimal; a word is followed from piece to piece, of which the longest that fits is taken at each place.
_hex_lower = "list_aggregate(list_transform(range(1, length(h) // 2 + 1), lambda i: case when substr(h, 2 * i - 1, 2) between '41' and '5A' then chr(ascii(substr(h, 2 * i - 1, 1)) + 2) || substr(h, 2 * i, 1) else substr(h, 2 * i - 1, 2) end), 'string_agg', '')"
_fits = "(length(h) = 2 or regexp_matches(h, '^(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|[89A-F][0-9A-F])+$'))"
ORACLES["op10_token_counts"] = f"""
with recursive v as (select hex(from_base64(split_part(column0, ' ', 1))) h from read_csv('{VOCABULARY}', header = false, delim = chr(9), quote = '', escape = '', columns = {{'column0': 'varchar'}})),
rest as (select distinct {_hex_lower} h from v where h <> '' and {_fits}),
first as (select h from rest union select distinct {_hex_lower} h from (select substr(h, 3) h from v where starts_with(h, '20')) where h <> '' and {_fits}),
size as (select max(length(h)) // 2 m from first),
d as (select doc_id, row_number() over () rid, regexp_extract_all({_lowered}, {PIECES}) ws from documents),
g as (select rid, unnest(ws) w from d),
w as (select w, hex(encode(w)) h from (select distinct w from g)),
s as (select w, h, unnest(range(0, length(h) // 2)) p from w),
c as (select w, p, unnest(range(1, least(m, length(h) // 2 - p) + 1)) n, h from s, size),
j as (select w, p, max(n) n from (select w, p, n, substr(h, 2 * p + 1, 2 * n) x from c) where p = 0 and x in (select h from first) or p > 0 and x in (select h from rest) group by all),
r(w, p, n) as (select w, 0, 0 from w union all select r.w, (r.p + j.n)::int, r.n + 1 from r join j on j.w = r.w and j.p = r.p),
t as (select w.w, coalesce(max(r.n) filter (where r.p = length(h) // 2), 1) n from w left join r on r.w = w.w group by w.w),
k as (select rid, sum(n) n from g join t using (w) group by rid)
select doc_id, coalesce(len(ws), 0)::bigint n_words, coalesce(n, 0)::bigint n_tokens from d left join k using (rid)
"""
