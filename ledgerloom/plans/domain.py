"""Purchasing tables derived from the shared test tables by rules on keys, with the blanks, returns and duplicates that raw feeds
have. The rules are SQL that Spark and DuckDB read alike, so that a query and its SQL start from the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_UNIT = "case l_linenumber % 5 when 0 then 'EA' when 1 then 'EACH' when 2 then 'BX' when 3 then ' box ' else 'CASE' end"


_HEADS, _TAILS = "Kar Bel Dom Fen Gil Hux Jor Lap".split(), "tonic vanta mexis ridge solve".split()


def _vendor_word(family: str) -> str:
    """One of 40 invented names."""
    head = " ".join(f"when {i} then '{x}'" for i, x in enumerate(_HEADS))
    tail = " ".join(f"when {8 * i} then '{x}'" for i, x in enumerate(_TAILS))
    return f"case {family} % 8 {head} end || case {family} - {family} % 8 {tail} end"


VIEWS = {
    "consumption": f"""
        select cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(cast(floor(l_extendedprice) as bigint) as string) as row_id,
            l_orderkey as log_id, o_orderpriority as facility, o_orderstatus as patient_type, c_mktsegment as service_line,
            case when l_partkey % 37 = 0 then '' else cast(l_partkey as string) end as item_id,
            case when l_suppkey % 41 = 0 then ' ' else 'V' || cast(l_suppkey % 10 as string) end as vendor,
            p_brand as manufacturer, p_brand || '-' || cast(p_size as string) as catalog_number, p_name as description, p_type as item_type,
            'MS' || cast(100 + l_partkey % 90 as string) || ' | APR' || cast(l_partkey % 40 as string) as drg_code,
            case when l_orderkey % 29 = 0 then null else cast(l_shipdate as date) end as service_date,
            l_extendedprice / l_quantity as unit_price,
            case when l_orderkey % 23 = 0 and l_linenumber = 1 then -l_quantity else l_quantity end as quantity,
            {_UNIT} as uom, case when l_partkey % 13 = 0 then null else p_retailprice end as client_contract_price
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{customer}} on o_custkey = c_custkey join {{part}} on l_partkey = p_partkey""",
    "item_master": """
        select cast(p_partkey as string) as item_id, p_name as description, case when p_size % 11 = 0 then null else p_brand end as manufacturer,
            p_brand || '-' || cast(p_size as string) as manufacturer_part, 'VP' || cast(p_partkey % 500 as string) as vendor_part,
            p_type as unspsc_text, case when p_partkey % 17 = 0 then null else cast(40000000 + p_partkey % 97 as string) end as unspsc,
            p_retailprice as price, case when p_partkey % 6 = 0 then 10 else 1 end as qoe, case when p_partkey % 5 = 0 then 'N' else 'Y' end as active
        from {part}""",
    "contracts": """
        select case when n = 2 and k % 18 = 0 then 'C' || cast(k as string) || 'B' else 'C' || cast(k as string) end as contract_number,
            cast(p_partkey as string) as item_id, 'V' || cast(k % 10 as string) as vendor, case when k % 6 = 0 then 'BX' else 'EA' end as uom,
            case when k % 6 = 0 then 10 else 1 end as qoe,
            case when k % 11 = 0 then null else p_retailprice * ((80 + 5 * (k % 8)) / 100e0) * (case when n = 2 then 11 / 10e0 else 1e0 end) end as price,
            case when k % 11 = 0 then null else p_retailprice * ((80 + 5 * (k % 8)) / 100e0) * (case when n = 2 then 11 / 10e0 else 1e0 end) / (case when k % 6 = 0 then 10e0 else 1e0 end) end as each_price,
            date '1995-01-01' + cast(k % 1500 as int) as starts,
            case when k % 7 = 0 then null else date '1995-01-01' + cast(k % 1500 + 400 + k % 900 as int) end as ends,
            cast(40000000 + p_partkey % 97 as string) || ' - ' || p_type as category, p_brand as manufacturer, p_brand || '-' || cast(p_size as string) as manufacturer_part
        from (select distinct l_partkey * 10 + l_suppkey % 10 as k, l_partkey from {lineitem}) as keys
            join {part} on l_partkey = p_partkey cross join (select 1 as n union all select 2 as n) as copies
        where k % 5 <> 0 and (n = 1 or k % 9 = 0)""",
    "purchase_orders": f"""
        select 'PO' || cast(l_orderkey as string) as po_number, cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as po_line,
            cast(o_orderdate as date) as po_date, cast(l_shipdate as date) as updated, o_orderpriority as facility,
            case when l_partkey % 37 = 0 then '' else cast(l_partkey as string) end as item_id, 'V' || cast(l_suppkey % 10 as string) as vendor,
            {_UNIT} as uom, case when l_linenumber % 5 in (0, 1) then 1e0 when l_linenumber % 5 = 4 then 50e0 else 10e0 end as factor,
            l_quantity as quantity, l_extendedprice / l_quantity as unit_price, l_extendedprice as total_value
        from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "invoices": f"""
        select '# INV' || cast(l_orderkey * 7 + l_linenumber as string) as invoice_number, 'PO' || cast(l_orderkey as string) as po_number,
            cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) as po_line,
            cast(l_shipdate as date) + cast(l_partkey % 30 as int) as paid, cast(l_partkey as string) as item_id,
            case when l_linenumber % 3 = 0 then l_quantity / 2 else l_quantity end as quantity,
            l_extendedprice / l_quantity * (1 + (l_suppkey % 3) / 100e0) as unit_price,
            {_UNIT} as uom, case when l_linenumber % 2 = 0 then null else 1e0 end as factor
        from {{lineitem}} where l_linenumber % 4 <> 0""",
    "aliases": """
        select case s_suppkey % 3 when 0 then lower(s_name) || '  INC' when 1 then ' ' || s_name else s_name || ', LLC' end as alias, upper(s_name) as standard from {supplier}""",
    # spellings of vendors in three feeds: of a family of items, f, contracts have three legal forms; usage has equal names, other legal
    # forms, names that share a word, names that share only items or codes, misspelt ones, and traders without contracts
    "vendor_contracts": f"""
        select {_vendor_word('f')} || case form when 0 then ' Medical Inc' when 1 then ' MEDICAL' else '  Medical, LLC' end as vendor, cast(l_partkey as string) as item_id,
            case when f % 4 = 0 then null else 'VC' || cast(f as string) end as vendor_code
        from (select distinct l_partkey, case when l_partkey % 10 = 1 then (l_partkey * 7) % 35 else l_partkey % 40 end as f, l_linenumber % 3 as form from {{lineitem}}) as k
        where l_partkey % 3 <> 0 and f < 35""",
    "vendor_usage": f"""
        select l_orderkey as log_id, cast(l_partkey as string) as item_id, case f % 7 when 0 then {_vendor_word('f')} || ' medical inc' when 1 then {_vendor_word('f')} || ' Medical Corp.'
            when 2 then 'Hospital Supply ' || {_vendor_word('f')} when 3 then 'Depot ' || cast(f as string)
            when 4 then case when l_partkey % 3 = 0 then substr({_vendor_word('f')}, 1, 4) || substr({_vendor_word('f')}, 4) || ' Medical' else {_vendor_word('f')} || ' MEDICAL' end
            when 5 then case when l_suppkey % 9 = 0 then ' ' else 'Unrelated Works ' || cast(f as string) end else 'Trader ' || cast(l_suppkey % 50 as string) end as vendor
        from (select *, l_partkey % 40 as f from {{lineitem}}) as k""",
    "vendor_items": f"""
        select cast(p_partkey as string) as item_id, case f % 7 when 3 then 'Depot ' || cast(f as string) when 5 then null else {_vendor_word('f')} || ' Medical' end as vendor,
            case when f % 3 = 0 then 'VC' || cast(f as string) when p_partkey % 11 = 0 then 'VC' || cast((f + 1) % 40 as string) end as vendor_code
        from (select *, p_partkey % 40 as f from {{part}}) as k""",
    "vendor_aliases": "select 'v7 ' as alias_name, 'V6' as standard_vendor union all select 'V8', 'v3' union all select 'V9', 'V9'",
    "product_classes": """
        select distinct cast(40000000 + p_partkey % 97 as string) as unspsc_code, 'Class ' || cast(p_partkey % 97 % 7 as string) as final_class, 'Group ' || cast(p_partkey % 97 % 11 as string) as final_subclass,
            'Text ' || cast(p_partkey % 97 as string) as unspsc_text from {part} where p_partkey % 97 % 3 = 0""",
    # contract records as delivered: dates as text, some bad or blank, spellings, tiers, codes and copies
    "raw_contracts": """
        select contract_number, case when m % 23 = 0 then ' ' when m % 3 = 0 then lower(vendor) || '  inc' else vendor end as vendor, case when m % 29 = 0 then '' else item_id end as item_id, uom, price, each_price,
            case when m % 19 = 0 then null when m % 31 = 0 then 'soon' when m % 37 = 0 then '1899-12-30' else cast(starts as string) end as start_text,
            case when m % 17 = 0 then 'open' when m % 41 = 0 then '1994-01-01' else cast(ends as string) end as end_text,
            case when m % 4 = 0 then '' when m % 4 = 1 then 'TIER 1' when m % 4 = 2 then 'tier 2 ' else 'LOCAL' end as tier, case when m % 13 = 0 then '' when copy = 3 then category || ' B' else category end as category,
            case when m % 5 = 0 then null when m % 3 = 0 then 'C' || vendor else 'C' || cast(m % 4 as string) end as vendor_code
        from (select *, cast(item_id as int) as m from contracts) as c join (select 1 as copy union all select 2 as copy union all select 3 as copy) as copies on copy = 1 or (copy = 2 and m % 12 = 5) or (copy = 3 and m % 14 = 6)""",
    "logs": """select event_id, user_id, cast(ts as timestamp) as ts, event_type as action, case when event_id % 7 = 0 then 'FAILED' else 'OK' end as status, value, props from {events}""",
}
#: The same joins with the small tables first, so that Spark shuffles the lines twice instead of three times.
_SMALL_FIRST = (
    "from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {part} on",
    "from {lineitem} join (select o_orderkey, o_orderpriority, o_orderstatus, c_mktsegment from {orders} join {customer} on o_custkey = c_custkey) as o on l_orderkey = o_orderkey join {part} on",
)
#: What a line of consumption is derived from, apart from its part.
RAW_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, cast(l_shipdate as date) as l_shipdate, o_orderpriority, o_orderstatus, c_mktsegment"
#: The same names looked up by place: so many branches for each line make code that the JVM doesn't compile.
_BY_PLACE = (_vendor_word("f"), f"get(array{tuple(_HEADS)}, cast(f % 8 as int)) || get(array{tuple(_TAILS)}, cast(f div 8 as int))")
#: Rows of the same feed before and after a delivery: some go, some change, some come.
VERSIONS = {
    "before": "select item_id, description, price, manufacturer from item_master where cast(item_id as int) % 10 <> 0",
    "after": """select item_id, case when cast(item_id as int) % 9 = 0 then description || ' v2' else description end as description,
        case when cast(item_id as int) % 8 = 0 then price * 2 when cast(item_id as int) % 14 = 0 then null else price end as price, manufacturer
        from item_master where cast(item_id as int) % 12 <> 1""",
}


def fields(view: str) -> dict[str, str]:
    """The columns of a view and their SQL, so that a plan can derive them where they are needed and shuffle what they come from."""
    text, out, depth, start = VIEWS[view].split("select ", 1)[1].rsplit("from {lineitem}", 1)[0], [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out, start = [*out, text[start:i]], i + 1
    pairs = (x.rsplit(" as ", 1) for x in [*out, text[start:]])
    return {name.strip(): body.strip() for body, name in pairs}


class Domain:
    """The tables of one folder, each read or derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            out = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name == "raw_lines":
            out = self.spark.sql(f"select {RAW_LINE} {_SMALL_FIRST[1].rsplit(' join ', 1)[0]}", lineitem=self.lineitem, orders=self.orders, customer=self.customer)
        elif name == "raw_invoices":
            out = self.lineitem.where(VIEWS["invoices"].rsplit(" where ", 1)[1]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("date").alias("l_shipdate"))
        elif name in VIEWS:
            text = VIEWS[name].replace("from contracts)", "from {contracts})").replace(*_SMALL_FIRST).replace(*_BY_PLACE)
            out = self.spark.sql(text, **{t: getattr(self, t) for t in (*TABLES, "contracts") if f"{{{t}}}" in text})
        elif name in VERSIONS:
            out = self.spark.sql(VERSIONS[name].replace("item_master", "{item_master}"), item_master=self.item_master)
        else:
            raise AttributeError(name)
        self.__dict__[name] = out
        return out


def oracle(body: str) -> str:
    """SQL over the same tables for DuckDB."""
    plain = {t: t for t in TABLES}
    ctes = [f"{name} as ({text.format_map(plain)})" for name, text in VIEWS.items()] + [f"{name} as ({text})" for name, text in VERSIONS.items()]
    used = [c for c in ctes]
    head = ", ".join(used)
    body = body.strip()
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
