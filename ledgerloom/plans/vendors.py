"""Vendor resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vendors as V
from .registry import query

_COLUMNS = ["name", "standard", "method", "confidence", "needs_review", "usage_rows", "contract_records", "item_rows", "code_check"]


def _key(c: str) -> str:
    return f"regexp_replace(trim(upper(coalesce({c}, ''))), '\\s+', ' ', 'g')"


def _words(c: str) -> str:
    return f"string_split(trim(regexp_replace(replace(upper({c}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), ' ')"


def _core(c: str) -> str:
    kept = f"list_filter({_words(c)}, lambda w: w not in {tuple(V.LEGAL_WORDS)} and w <> '')"
    return f"case when len({kept}) > 0 then array_to_string({kept}, ' ') else array_to_string({_words(c)}, ' ') end"


def _telling(c: str) -> str:
    return f"list_filter({_words(c)}, lambda w: length(w) > 2 and w not in {tuple(V.LEGAL_WORDS + V.GENERAL_WORDS)})"


_RULED = f"""with k as (select {_key('vendor')} as v, trim(item_id) as i, coalesce(vendor_code, '') as c from vendor_contracts),
    u as (select {_key('vendor')} as v, trim(item_id) as i, count(*) as n from vendor_usage group by 1, 2),
    m as (select {_key('vendor')} as v, trim(item_id) as i, coalesce(vendor_code, '') as c from vendor_items),
    sp as (select v as name, count(*) as records, {_core('v')} as core from k where v <> '' group by v),
    st as (select *, first_value(name) over (partition by core order by records desc, name) as standard, count(*) over (partition by core) as members from sp),
    owner as (select c, v from k where c <> '' and v <> '' group by 1, 2 qualify row_number() over (partition by c order by count(*) desc, v) = 1),
    own as (select c, standard from owner join st on st.name = owner.v),
    nm as (select v, c from m where v <> '' and c <> '' group by 1, 2 qualify row_number() over (partition by v order by count(*) desc, c) = 1),
    named as (select v as name, own.standard as named_vendor from nm join own using (c)),
    coded as (select u.v, x.c, sum(n) as r, count(*) as items from (select * from u where v <> '' and i <> '') u join (select distinct i, c from m where i <> '' and c <> '') x on u.i = x.i group by 1, 2),
    coded2 as (select u.v, x.c, sum(n) as r, count(*) as items from (select * from u where v <> '' and i <> '') u join (select distinct i, c from k where i <> '' and c <> '') x on u.i = x.i
        where u.v not in (select v from coded) group by 1, 2),
    ev as (select v as name, src, c as code, r * 1e0 / sum(r) over (partition by v) as share, items, own.standard as code_vendor
        from (select *, 'IM' as src from coded union all select *, 'CON' from coded2) z left join own using (c) qualify row_number() over (partition by v order by r desc, c) = 1),
    names as (select name, max(a) as usage_rows, max(b) as contract_records, max(d) as item_rows from (
        select v as name, sum(n) as a, 0 as b, 0 as d from u where v <> '' group by 1 union all select name, 0, records, 0 from st union all select v, 0, 0, count(*) from m where v <> '' group by 1) group by 1),
    s1 as (select n.*, st.standard as own_standard, case when n.name <> st.standard then 'CORE_KEY' when st.members = 1 then 'EXACT' else 'CONTRACT_VENDOR_ANCHOR' end as own_method, c.standard as core_standard,
        named_vendor, ev.src, ev.share, ev.items, ev.code_vendor,
        coalesce(ev.code_vendor is not null and ev.share >= 0.8 and (ev.src = 'IM' or ev.items >= 3 or len(list_intersect({_telling('n.name')}, {_telling('ev.code_vendor')})) > 0), false) as accepted
        from names n left join st on st.name = n.name left join (select distinct core, standard from st) c on c.core = ({_core('n.name')}) left join named on named.name = n.name left join ev on ev.name = n.name),
    s2 as (select *, coalesce(own_standard, core_standard, named_vendor, case when accepted then code_vendor end) as standard,
        case when own_standard is not null then own_method when core_standard is not null then 'CORE_KEY' when named_vendor is not null or accepted then 'VENDOR_CODE' end as method,
        case when own_standard is null and core_standard is null and named_vendor is null then round(share, 3) else 1.0 end as confidence from s1),
    used as (select distinct v as name, i from (select v, i from u union all select v, i from m) where i <> '' and v in (select name from s2 where method is null)),
    idx as (select distinct k.i, st.standard from k join st on st.name = k.v where k.i <> ''),
    con as (select name, count(*) as contracted from used where i in (select i from idx) group by 1),
    hit as (select name, standard, count(*) as hits from used join idx using (i) group by 1, 2),
    best as (select name, standard, hits, coalesce(lead(hits) over (partition by name order by hits desc, standard), 0) as second from hit qualify row_number() over (partition by name order by hits desc, standard) = 1),
    o as (select name, standard, hits * 1e0 / contracted as share, contracted >= 2 and hits * 1e0 / contracted >= 0.6 and hits >= 1.5 * second and (len(list_intersect({_telling('name')}, {_telling('standard')})) > 0
        or (hits * 1e0 / contracted >= 0.9 and contracted >= 10) or (hits * 1e0 / contracted >= 0.8 and contracted >= 50)) as ok from best join con using (name)),
    z as (select s2.name, coalesce(s2.standard, case when o.ok then o.standard end, s2.name) as standard, coalesce(s2.method, case when o.ok then 'ITEM_OVERLAP' end, 'NO_MATCH') as method,
        case when s2.method is not null then s2.confidence when o.ok then round(o.share, 3) else 0 end as confidence, usage_rows, contract_records, item_rows, s2.share, s2.code_vendor from s2 left join o on o.name = s2.name)
    select name, standard, method, cast(confidence as double) as confidence, case when method in ('ITEM_OVERLAP', 'FUZZY_NAME', 'NO_MATCH', 'VENDOR_CODE') then 'Y' else 'N' end as needs_review,
        cast(usage_rows as bigint) as usage_rows, cast(contract_records as bigint) as contract_records, cast(item_rows as bigint) as item_rows,
        case when method not in ('ITEM_OVERLAP', 'FUZZY_NAME', 'NO_MATCH', 'VENDOR_CODE') then '' when code_vendor is null then 'NO_CODE_DATA' when share < 0.5 then 'INCONCLUSIVE' when code_vendor = standard then 'CONFIRMED' else 'CONFLICT' end as code_check from z"""


@query("JN-19-FUZZY")
def cascade(d):
    """All stages, with alike names as the last one, whose ratio SQL hasn't."""
    return V.resolve(d.vendor_usage, d.vendor_contracts, d.vendor_items).select(*_COLUMNS, "evidence")


@query("JN-19", _RULED)
def ruled(d):
    """All stages but alike names."""
    return V.resolve(d.vendor_usage, d.vendor_contracts, d.vendor_items, fuzzy=False).select(*_COLUMNS)


@query("JN-19-REVIEW")
def review(d):
    """A reviewer's remarks on names that need a review."""
    found = V.resolve(d.vendor_usage, d.vendor_contracts, d.vendor_items)
    n = F.abs(F.xxhash64("name")) % 5
    remark = F.when(n == 0, "ok").when(n == 1, "check the vendor code").when(n == 2, "Kartonic  medical").when(n == 3, "who is this?")
    return V.reviewed(found, found.where("needs_review = 'Y'").select("name", remark.alias("remark")))
