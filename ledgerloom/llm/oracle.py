"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .secret_ledger import RULES

ORACLE: dict[str, str] = {}

ORACLE["op1_warc_transactions"] = """
with d as (select page_id, url, coalesce(html, '') as h from pages),
    f as (select page_id, url, strlen(h) as bytes, sha256(h) as digest, min(page_id) over (partition by sha256(h)) as first from d)
select page_id, bytes as payload_bytes, digest as payload_digest, case when bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when bytes >= 100 and page_id <> first then first end as refers_to, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as request_uri
from f"""

ORACLE["op5_chat_grammar"] = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c as (select conv_id, bool_or(contains(text, '</s>') or regexp_matches(text, '<\\+/?s>')) as escaped from t group by 1),
x as (select t.*, 8 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + length(text) + case when escaped then len(regexp_extract_all(text, '<\\*/?s>')) else 0 end as chars from t join c using (conv_id))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from x group by 1"""

ORACLE["op6_ngram_jaccard_join"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as shingle from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach where reach.a = d.doc_id) as component_id,
    (select count(*) from links where links.a = d.doc_id) as n_links from documents d left join n on n.doc_id = d.doc_id"""


def _secrets() -> str:
    """Starts of matches are sums of the lengths of the pieces between matches and of the matches before."""
    found = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("(?i)", "").replace("'", "''")
        if rule.kind == "assign":
            letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
            pattern = letters + pattern[pattern.index(")") + 1 :]
        before = "''"  # what a pattern takes in before a match, where it may not look behind
        if "(?<!" in pattern:
            pattern = "(^|[^" + pattern[5:].replace("}+", "}")
            before = f"regexp_extract(m[i], '{pattern}', 1)"
        found.append(
            f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, {str(rule.base).lower()} as base, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            's': cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length({before}) as bigint),
            'n': length(m[i]) - length({before}), 'ok': length(v[i]) - length({before}) >= {rule.least}}})) as f
            from (select doc_id, string_split_regex(t, '{pattern}') as g, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {rule.group}) as v from d where regexp_matches(t, '{pattern}'))"""
        )
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in RULES if r.base)
    text = "string_agg(kind || ':' || cast(s as varchar) || ':' || cast(s + n as varchar), ',' order by s, rank, n)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), a as ({' union all '.join(found)}),
        h as (select doc_id, rank, kind, base, f.s as s, f.n as n from a where f.ok),
        r as (select doc_id, {counts}, {text} filter (base) as b, {text} as spans from h group by 1)
        select d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in RULES if r.base)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join r on d.doc_id = r.doc_id"""


ORACLE["op7_secret_ledger"] = _secrets()

ORACLE["op9_kd_tree_topk"] = """
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 20"""

ORACLE["op11_source_mixing"] = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by 1),
w as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
-- places in the order of size / weight, the caps of those before, the weights from here on
p as (select *, 2 * (sum(cast(source_size as hugeint)) over o - source_size) as capped, sum(weight) over () - sum(weight) over o + weight as left_weight,
    sum(cast(source_size as hugeint)) over () as total from w window o as (order by source_size * (10 // weight), source nulls last)),
-- the first whose share stays under its cap sets the level for it and all after it, in units of half a word
level as (select left_weight, 3 * total - 2 * capped as rest from p where (3 * total - 2 * capped) * weight < 4 * source_size * left_weight order by left_weight desc limit 1),
t as (select source, source_size, coalesce(least(2.0 * source_size, cast(weight * rest as double) / cast(2 * level.left_weight as double)), 2.0 * source_size) as target from p left join level on true),
r as (select d.*, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as quota,
    sum(size) over (partition by d.source order by md5(concat_ws(':', '0', cast(doc_id as varchar))), size, doc_id) - size as before
    from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else quota // source_size * size + greatest(0, least(size, quota % source_size - before)) end as bigint) as taken from r"""

ORACLE["op12_filter_audit"] = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (select doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m left join l using (doc_id) group by 1, 2),
f as (select * from (values (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')) as f(i, c)),
p as (select [a.i, b.i, x.i, y.i, z.i] as i, a.c || b.c || x.c || y.c || z.c as filter_order from f a, f b, f x, f y, f z
    where (1 << a.i) | (1 << b.i) | (1 << x.i) | (1 << y.i) | (1 << z.i) = 31),
s as (select filter_order, k as step, i[k] as filter, cast(list_sum([0] || list_transform(i[:k - 1], lambda j: 1 << j)) as int) as before from p, (select unnest(range(1, 6)) as k)),
g as (select part, filter_order, cast(step as int) as step, filter,
    sum(case when mask & (before | (1 << filter)) = 0 then n else 0 end) as kept,
    sum(case when mask & before = 0 and (mask >> filter) & 1 = 1 then n else 0 end) as removed,
    sum(case when mask & before <> 0 and (mask >> filter) & 1 = 1 then n else 0 end) as redundant,
    sum(case when mask = 1 << filter then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and (mask >> filter) & 1 = 1 then good else 0 end) as good_lost,
    sum(case when mask & before = 0 and (mask >> filter) & 1 = 1 then toxic else 0 end) as toxic_lost
    from c, s group by all)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley from g"""

ORACLE["op13_phrase_mining"] = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
w as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
g as (select lang, 1 as k, unnest(w) as phrase from w
    union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) from w
    union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) from w),
f as materialized (select lang, k, phrase, cast(count(*) as hugeint) as a from g group by all),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as s from f where k > 1 and a >= 10),
cuts as (select lang, phrase, k, a, 1 as cut, s[1] as x, array_to_string(s[2:], ' ') as y from c union all select lang, phrase, k, a, 2, array_to_string(s[:2], ' '), s[3] from c where k = 3),
scored as (select cuts.*, l.a as l, r.a as r, 1000000 * cuts.a * cuts.a // (l.a * r.a) as score from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (select lang, phrase, max(a) as most from (select lang, array_to_string(s[1:2], ' ') as phrase, a from c where k = 3 union all select lang, array_to_string(s[2:3], ' '), a from c where k = 3) group by 1, 2),
n as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by 1),
r as (select z.*, row_number() over (partition by z.lang order by score desc, z.a desc, z.phrase) as rank from lowest z left join inside i on i.lang = z.lang and i.phrase = z.phrase where i.most is null or 100 * i.most < 50 * z.a)
select r.lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score from r join n on n.lang = r.lang where rank <= 2000"""
