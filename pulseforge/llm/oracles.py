"""DuckDB SQL that gives the rows of the queries of the same name."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
with rows as (select doc_id, sha256({_LOWER}) as d, count(*) as n from documents group by 1, 2),
groups as (select d, max(doc_id) as keep_id, cast(sum(n) as bigint) as group_size from rows group by d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, d as text_sha256 from rows join groups using (d)
"""

def _keyed(seed: str, *parts: str) -> str:
    return f"cast('0x' || substr(md5('{seed}' || " + " || ".join(f"'|' || coalesce(cast({p} as varchar), '')" for p in parts) + "), 1, 8) as bigint)"


def _dealt(depth: int) -> str:
    """m0 to m{depth}: items (node, i, source, quota); each level deals every node's left half a hypergeometric draw of each source."""
    q = ["m0 as (select 1 as node, row_number() over (order by source nulls first) as i, source, cast(sum(n_draws) as bigint) as quota from placed group by source)"]
    for d in range(depth):
        u = f"({_keyed('42u', 'node', 'source')} + ({_keyed('42v', 'node', 'source')} + 0.5::double) / 4294967296.0::double) / 4294967296.0::double"
        weights = "list_transform(range(a, b + 1), lambda k: exp(c - lgamma(k + 1.0::double) - lgamma(quota - k + 1.0::double) - lgamma(slots - k + 1.0::double) - lgamma(rest - quota - slots + k + 1.0::double)))"
        mode = "lgamma(mid + 1.0::double) + lgamma(quota - mid + 1.0::double) + lgamma(slots - mid + 1.0::double) + lgamma(rest - quota - slots + mid + 1.0::double)"
        q.append(f"""r{d} as (with recursive r as (
  select node, 0::bigint as i, null::varchar as source, 0::bigint as quota, cast(sum(quota) as bigint) as rest, cast(sum(quota) // 2 as bigint) as slots, 0::bigint as n from m{d} group by node
  union all
  select node, i, source, quota, rest - quota, slots - n, n from (select *, least(a + len(list_filter(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) < {u} * list_sum(w))), b) as n
    from (select *, {weights} as w from (select *, {mode} as c from (select *, greatest(a, least(b, round(mean)::bigint)) as mid
    from (select *, greatest(a, least(hi, ceil(mean + 8 * spread + 8)::bigint)) as b from (select *, greatest(lo, floor(mean - 8 * spread - 8)::bigint) as a
    from (select r.node, t.i, t.source, t.quota, r.rest, r.slots, r.slots * (t.quota / greatest(r.rest, 1)) as mean,
      sqrt(r.slots * (t.quota / greatest(r.rest, 1)) * (1 - t.quota / greatest(r.rest, 1)) * (r.rest - r.slots) / greatest(r.rest - 1, 1)) as spread,
      greatest(r.slots - (r.rest - t.quota), 0) as lo, least(t.quota, r.slots) as hi from r join m{d} t on t.node = r.node and t.i = r.i + 1)))))))) select * from r where i > 0)""")
        q.append(f"m{d + 1} as (select 2 * node as node, i, source, n as quota from r{d} union all select 2 * node + 1, i, source, quota - n from r{d})")
    return ", ".join(q)


MIX = r"""
with slim as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || substr(md5('42|' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size, count(*) filter (where size > 0) as n_docs from slim group by source),
s1 as (select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s0),
s2 as (select *, source_size * 3 / w as ratio, (sum(source_size) over () - coalesce(sum(source_size * 3) over b, 0))
    / (sum(w) over () - coalesce(sum(w) over b, 0)) as lv from s1
    window b as (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select source, source_size, n_docs, least(source_size * 3.0::double, w * (select min_by(lv, ratio) from s2 where ratio >= lv)) as target from s2),
s4 as (select *, cast(floor(target + 0.5) as bigint) // greatest(source_size, 1) as passes from s3),
ordered as (select s.*, t.source_size, t.target, t.passes, t.n_docs, cast(floor(t.target + 0.5) as bigint) - t.passes * t.source_size as rest,
    sum(s.size) over o - s.size as before, sum((s.size > 0)::int) over o - 1 as rank
  from slim s join s4 t on s.source is not distinct from t.source window o as (partition by s.source order by s.h, s.doc_id rows unbounded preceding)),
placed as (select *, cast(greatest(0, least(size, rest - before)) as bigint) as last, case when size > 0 then cast(passes + (rest > before)::int as bigint) else 0 end as n_draws from ordered),
""" + _dealt(4) + """,
ends as (select source, list(e order by node) as ends from (select source, node, sum(quota) over (partition by source order by node) as e from m4) group by source)
select doc_id, size, source_size, target, cast(passes * size + last as bigint) as taken, n_draws,
  array_to_string(list_transform(range(n_draws), lambda c: c || ':' || len(list_filter(ends, lambda e: e <= c * n_docs + rank)) || ':' || case when c < passes then size else last end), ',') as dealt
from placed left join ends on placed.source is not distinct from ends.source
"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha256(h) as digest from p),
f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from d left join f on d.digest = f.digest and n >= 100
"""


#: The search patterns as RE2 has them, and what a match must hold.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast('0' || right(ltrim(x, '0'), 3) as int) > 255)) = 0",
    ),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(regexp_replace(m, '[^0-9]', '', 'g')) between 16 and 19 and list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), "
        "lambda i: case when i % 2 = 0 then (cast(substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1) as int) * 2 - 1) % 9 + 1 "
        "else cast(substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1) as int) end)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) between 8 and 15"),
    "iban": (
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
        "alone and list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: case when ascii(c) < 58 then ascii(c) - 48 else ascii(c) - 55 end), "
        "lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1",
    ),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "alone and regexp_matches(near, 'ssn|social security|tax id')"),
    "secret": (r"[A-Fa-f0-9]{32,64}", "alone and regexp_matches(near, 'token|secret|key|password|auth')"),
}
#: A kind's score in hundredths, and its context words.
_SCORES = {
    "email": (70, "mail|contact|write"),
    "ip": (50, "ip|host|server|address"),
    "card": (80, "card|visa|credit|payment"),
    "phone": (50, "phone|call|tel|mobile"),
    "iban": (90, "iban|account|bank|transfer"),
    "ssn": (20, "ssn|social security|tax id"),
    "secret": (30, "token|secret|key|password|auth"),
}


def _pii() -> str:
    parts = []
    for k, (kind, (pattern, holds)) in enumerate(_PII.items()):
        parts.append(f"""
select doc_id, {k} as k, '{kind}' as kind, s, s + length(m) as e, least(100, {_SCORES[kind][0]} + case when regexp_matches(near, '{_SCORES[kind][1]}') then 30 else 0 end) as score from (
  select doc_id, text, m, s, lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || chr(10) || substr(text, s + length(m) + 1, 40)) as near,
    not regexp_matches(case when s > 0 then substr(text, s, 1) else '' end || ' ' || substr(text, s + length(m) + 1, 1), '[A-Za-z0-9]') as alone
  from (select doc_id, text, m, cast(sum(length(g) + length(m)) over (partition by doc_id order by i) - length(m) as bigint) as s
    from (select doc_id, text, i, ms[i] as m, string_split_regex(text, '{pattern}')[i] as g
      from (select doc_id, text, ms, unnest(range(1, len(ms) + 1)) as i
        from (select doc_id, text, regexp_extract_all(text, '{pattern}') as ms from t) where len(ms) > 0)))) where {holds}""")
    counts = ", ".join(f"cast(count(*) filter (where kind = '{x}') as bigint) as n_{x}" for x in ("email", "ip", "card", "phone"))
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents), found as ({' union all '.join(parts)}),
per as (select doc_id, {counts},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by k, s) filter (where k < 4), '')) as base_sha256,
  string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as spans, count(*) as n_spans, string_agg(score, ',' order by k, s) as scores from found group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans, coalesce(scores, '') as scores
from t d left join per on d.doc_id = per.doc_id
"""


LINES = r"""
with p as (select doc_id, coalesce(text, '') as text from documents),
b as (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g'), '([\n。！？])', '\1' || chr(57344), 'g'), chr(57344)) as us from p),
x as (select doc_id, unnest(range(1, len(us) + 1)) as i, us from b),
l as (select doc_id, i, us[i] as unit, trim(regexp_replace(lower(us[i]), '[\x20\x09-\x0D]+', ' ', 'g')) as plain from x),
u as (select *, cast(sum(length(unit)) over (partition by doc_id order by i) as bigint) as e from l),
v as (select doc_id, e - length(unit) as s, e, plain, strlen(plain) as n, sum(strlen(plain)) over w as cum, row_number() over w as k
  from u where plain <> '' window w as (partition by doc_id order by i)),
lists as (select doc_id, list(plain order by k) as ps from v group by doc_id),
r as (select a.doc_id, a.s, b.e, md5(array_to_string(list_slice(ps, a.k, b.k), chr(10))) as d
  from (select *, cum - n + 100 as need from v) a asof join v b on a.doc_id = b.doc_id and a.need <= b.cum join lists on a.doc_id = lists.doc_id),
g as (select doc_id, s, e from (select *, row_number() over (partition by d order by doc_id, s) as k from r) where k > 1),
m as (select *, coalesce(s > max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding), true) as opens from g),
spans as (select doc_id, min(s) as s, max(e) as e from (select *, sum(opens::int) over (partition by doc_id order by s, e) as o from m) group by doc_id, o),
cut as (select doc_id, s, e, lag(e, 1, 0) over (partition by doc_id order by s) as f from spans),
per as (select c.doc_id, cast(sum(e - s) as bigint) as n_removed, count(*) as n_spans, string_agg(s || ':' || e, ',' order by s) as removed,
  string_agg(substr(text, f + 1, s - f), '' order by s) || substr(any_value(text), max(e) + 1) as kept
  from cut c join p on c.doc_id = p.doc_id group by c.doc_id)
select p.doc_id, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, coalesce(removed, '') as removed,
  sha256(coalesce(kept, text)) as kept_sha256, cast(length(text) as bigint) as text_length
from p left join per on p.doc_id = per.doc_id
"""

FIM = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u from d),
k as (select *, len(u) as n, list_transform([0, 1, 2, 3], lambda i: cast('0x' || substr(h, 8 * i + 1, 8) as bigint)) as hs from u),
c as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 90 then 'plain' when hs[4] % 100 < 20 then 'spm' else 'psm' end as form from k),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

ORACLES = {"op4_line_dedup": LINES, "op3_source_mix": MIX, "op5_exact_dedup": EXACT, "op9_pii": _pii(), "op10_warc": WARC, "op11_fill_middle": FIM}
