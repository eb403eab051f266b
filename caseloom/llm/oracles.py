"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"""coalesce(list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), [])"""

# components by the smallest reachable id, by repeated relaxation over the direct links
OP1 = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
ok as (select vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e
  where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
n as (select * from ok where n > 0),
l as (select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
reach as (select vec_id a, vec_id b from e union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a vec_id, min(b) component_id from reach group by a),
k as (select a vec_id, count(*) n from l group by a)
select c.vec_id, coalesce(k.n, 0)::bigint n_links, component_id, c.vec_id = component_id kept from c left join k using (vec_id)
"""

# DuckDB has no base32: five bits of the digest at a time, through the alphabet.
OP2 = """
with p as (select page_id, encode(coalesce(html, '')) payload from pages),
h as (select page_id, octet_length(payload) n, sha1(payload) hex from p),
f as (select *, min(page_id) over (partition by hex, n) first from h),
b as (select *, array_to_string(list_transform(string_split_regex(hex, ''), lambda c: lpad(bin(('0x' || c)::int), 4, '0')), '') bits from f)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(5), lambda j: (substr(bits, (i * 5 + j + 1)::bigint, 1) = '1')::int * (16 >> j::int))) + 1)::bigint, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from b
"""

OP6 = rf"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
i as (select item_id, {_WORDS} w from benchmark),
iw as (select item_id, w[s:s + least(10, len(w)) - 1] win
  from i, unnest(range(1, greatest(len(w) - 10, 0)::bigint + 2)) t(s) where len(w) > 0),
sizes as (select distinct len(win) k from iw),
dw as (select r, s, k, w[s:s + k - 1] win from d, sizes, unnest(range(1, greatest(len(w) - k + 2, 1)::bigint)) t(s)),
hit as (select distinct r, s, k, item_id from dw join iw using (win)),
cover as (select r, count(distinct p) n_hit from hit, unnest(range(s, s + k)) t(p) group by r),
its as (select r, count(*) n_items, string_agg(id, ',' order by id) ids
  from (select distinct r, item_id::varchar id from hit) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join cover using (r) left join its using (r)
"""

OP7 = r"""
with d as (select doc_id, row_number() over () r,
  list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select r, doc_id, s, w[s:s + 12] x from d, unnest(range(1, greatest(len(w) - 11, 1)::bigint)) t(s)),
hit as (select r, s from (select r, s, doc_id, min(doc_id) over (partition by x) m from win) where doc_id > m),
gone as (select distinct r, p from hit, unnest(range(s, s + 13)) t(p)),
word as (select r, p, w[p] x from d, unnest(range(1, len(w)::bigint + 1)) t(p)),
kept as (select r, count(gone.p) n_removed, string_agg(x, ' ' order by p) filter (where gone.p is null) k
  from word left join gone using (r, p) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(k, '')) kept_sha256
from d left join kept using (r)
"""


def license_sql(phrases: dict[str, str], templates: dict[str, str], percent: int = 80) -> str:
    """Every block of every text is looked at; a text without enough of a template's words is left out first."""
    ph = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in phrases.items())
    te = ", ".join(f"('{label}', string_split('{t}', ' '))" for label, t in templates.items())
    return rf"""
with d as (select doc_id, row_number() over () r, {_WORDS} w from documents),
ph(p, label) as (values {ph}),
te as (select label, list_distinct(t) t, len(t) span, (len(list_distinct(t)) * {percent} + 99) // 100 need from (values {te}) v(label, t)),
base as (select r, label, s - 1 pos, 1.0::double share from d, ph, unnest(range(1, greatest(len(w) - len(p) + 2, 1)::bigint)) x(s)
  where w[s:s + len(p) - 1] = p),
near as (select r, w, te.* from d, te where len(list_intersect(w, t)) >= need),
blk as (select r, label, max(len(list_intersect(w[s:s + span - 1], t))) / any_value(len(t)) share
  from near, unnest(range(1, greatest(len(w) - span, 0)::bigint + 2)) x(s)
  where len(list_intersect(w[s:s + span - 1], t)) >= need group by r, label),
b as (select r, count(*) n_base, min(pos) first_word, max(pos) last_word, string_agg(distinct label, ',' order by label) base_labels from base group by r),
a as (select r, string_agg(distinct label, ',' order by label) labels, max(share) score
  from (select r, label, share from base union all select r, label, share from blk) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0)::double score
from d left join b using (r) left join a using (r)
"""

OP11 = """
with e as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end label,
    list_transform(embedding, lambda x: x::double) d from embeddings where embedding is not null),
n as (select r, vec_id, label, list_transform(d, lambda x: floor(256 * x)) v from e
  where label is not null and len(list_filter(d, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.r, b.r r2, a.vec_id anchor_id, b.r <> a.r and a.label = b.label same, a.label <> b.label other, b.vec_id id,
    list_dot_product(a.v, b.v)::bigint score
  from n a join n b on a.vec_id % 100 = 0 and len(a.v) = len(b.v)),
pos as (select * from p where same qualify row_number() over (partition by r order by score desc, id) <= 5),
neg as (select pos.anchor_id, pos.id positive_id, p.id negative_id, pos.score positive_score, p.score negative_score,
    row_number() over (partition by pos.r, pos.r2 order by p.score desc, p.id)::int rank
  from pos join p on p.r = pos.r and p.other and 80 * pos.score <= 100 * p.score and 100 * p.score <= 100 * pos.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from neg where rank <= 5
"""

# The grammar's states: 0 nothing, 1 s, 2 a user turn is open, 3 all turns are answered. ``tops`` holds the least (cost, audit, state,
# text) of each state; a row, then an insertion before the next one, leads to the next tops. Two insertions in a row are never cheapest.
_MOVES = "[" + ", ".join(f"{{'f': {f}, 'y': '{y}', 'n': '{n}', 'g': {g}}}" for f, y, n, g in [
    (0, "s", "system", 1), (0, "u", "user", 2), (1, "u", "user", 2), (3, "u", "user", 2), (2, "a", "assistant", 3)]) + "]"
_LEAST = "list_filter(list_transform([0, 1, 2, 3], lambda s: list_sort(list_filter({}, lambda x: x.s = s))[1]), lambda x: x is not null)"
_INSERT = _LEAST.format(
    f"""list_concat(tops, flatten(list_transform(tops, lambda o: list_transform(list_filter({_MOVES}, lambda m: m.f = o.s and m.y <> 's'),
      lambda m: {{'c': o.c + 5, 'a': o.a || 'I', 's': m.g, 't': list_append(o.t, m.n || ':')}}))))"""
)
_ROW = _LEAST.format(
    f"""flatten(list_transform(tops, lambda o: list_concat([{{'c': o.c + 2, 'a': o.a || 'D', 's': o.s, 't': o.t}}],
      list_transform(list_filter({_MOVES}, lambda m: m.f = o.s and pen is not null and m.y = sym),
        lambda m: {{'c': o.c + pen, 'a': o.a || 'K', 's': m.g, 't': list_append(o.t, role || ':' || text)}}),
      list_transform(list_filter({_MOVES}, lambda m: m.f = o.s and pen is not null and m.y <> 's'),
        lambda m: {{'c': o.c + pen + 1, 'a': o.a || 'R', 's': m.g, 't': list_append(o.t, m.n || ':' || text)}}))))"""
)
OP13 = rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    list_transform(string_split_regex(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::ubigint) b from conversations),
h as (select *, xor(list_reduce(list_concat([4294967295::ubigint], b), lambda c, d:
    list_reduce(list_concat([xor(c, d)], [0::ubigint for z in range(8)]), lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 kind from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) t(n)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i, coalesce(nullif(left(role, 1), ''), ' ') sym,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) fin from d),
f as (select *, case when fin = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when fin not in ('.', '!', '?') then 'truncated' else '' end fault,
    lag(sym) over (partition by conv_id order by i) prev from o),
r as (select *, case fault when '' then 0 when 'truncated' then 5 end pen from f),
run as (
  select conv_id, 0::bigint i, {_INSERT} tops from (select distinct conv_id, [{{'c': 0, 'a': '', 's': 0, 't': []::varchar[]}}] tops from conversations)
  union all
  select conv_id, i, {_INSERT} from (
    select conv_id, i, {_ROW} tops from (
      select r.*, run.tops from run join r on r.conv_id is not distinct from run.conv_id and r.i = run.i + 1))),
done as (select conv_id, list_sort(list_filter(arg_max(tops, i), lambda x: x.s in (0, 3)))[1] b from run group by conv_id),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') blank,
    count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
    count(*) filter (prev || sym not in ('su', 'ua', 'au')) illegal from r group by conv_id)
select done.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, b.c::bigint as cost, b.a audit, sha256(array_to_string(b.t, chr(10))) repaired_sha256
from done left join n on n.conv_id is not distinct from done.conv_id
"""
