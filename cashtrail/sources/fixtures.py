"""Domain tables derived from the star-schema test tables (whole tables, no subsets).

customer -> accounts, part -> cash machines, orders -> complaints, lineitem -> transfers,
documents -> evidence artefacts, conversations -> case notes, events -> audit trail,
nation/region -> alert recipients. An order that is still open ('O') has no complaint on
its transfers, so some complaints have no ledger and some transfers are unattached; an order of five
lines or more is cashed out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# {epoch:x} and {div:a,b} are the only spots where the two SQL dialects differ.
VIEWS = {
    "accounts": """
select c_custkey as account_id, c_custkey % 16 as bank_id, n_name as city, r_name as state,
  9.0e0 + n_nationkey * 1.05e0 + ((c_custkey * 6131) % 401 - 200) / 1000.0e0 as lat,
  69.0e0 + ((n_nationkey * 7) % 25) * 1.1e0 + ((c_custkey * 3571) % 401 - 200) / 1000.0e0 as lon,
  20 + (c_custkey * 53) % 3000 as account_age_days,
  case when c_custkey % 33 = 0 then 1 else 0 end as is_mule_label
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "cashpoints": """
select p_partkey as atm_id, n_name as city, n_name as district, r_name as state,
  9.0e0 + n_nationkey * 1.05e0 + ((p_partkey * 7919) % 441 - 220) / 1000.0e0 as lat,
  69.0e0 + ((n_nationkey * 7) % 25) * 1.1e0 + ((p_partkey * 10473) % 441 - 220) / 1000.0e0 as lon,
  p_partkey % 16 as bank_id, ((p_partkey * 31) % 100) / 100.0e0 as risk, (p_partkey * 17) % 181 as fraud_count,
  case when p_partkey % 11 = 0 then null else (p_partkey * 13) % 1440 end as opens_min,
  case when p_partkey % 11 = 0 then null else (p_partkey * 29 + 600) % 1440 end as closes_min
from part join supplier on p_partkey % (select count(*) from supplier) = s_suppkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "complaints": """
select o_orderkey as ticket_id, o_custkey as victim_account, c_name as victim_name, o_orderpriority as fraud_type,
  o_totalprice as stolen_amount, {epoch:o_orderdate} as filed_s, n_name as city, r_name as state,
  case o_orderstatus when 'O' then 'ACTIVE' when 'F' then 'Resolved' else 'Investigating' end as status
from orders join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "ledger": """
select l_orderkey * 100 + hop as txn_id,
  case when o_orderstatus <> 'O' then l_orderkey end as complaint_id,
  case when hop <= 3 then o_custkey else lag(dst, 3) over (partition by l_orderkey order by hop) end as src_account,
  dst as dst_account, l_extendedprice * (1 - l_discount) as amount,
  {epoch:o_orderdate} + hop * 70 + (l_partkey % 97) * (1 + l_suppkey % 5) as ts_s,
  least({div:hop + 2,3}, 4) as hop_depth,
  case when hop > n - ends then 1 else 0 end as is_terminal,
  case when o_orderstatus <> 'O' then 1 else 0 end as is_fraud,
  case when hop > n - ends then (l_partkey * 13 + l_suppkey) % (select count(*) from part) end as cashout_atm_id,
  case when hop > n - ends then 3 + (l_partkey * 37 + l_suppkey * 11) % 110 end as time_to_cashout_min
from (
  select l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_discount, o_custkey, o_orderdate, o_orderstatus,
    (l_partkey * 7 + l_suppkey) % (select count(*) from customer) as dst,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as hop,
    count(*) over (partition by l_orderkey) as n,
    case when count(*) over (partition by l_orderkey) >= 5 then 2 else 1 end as ends
  from lineitem join orders on l_orderkey = o_orderkey) l""",
    "recipients": """
select 1000 + n_nationkey as recipient_id, 'district-desk' as name, 'LEA' as role, 'email' as channel,
  concat(lower(n_name), '@desk.example') as address, r_name as scope_state, n_name as scope_district,
  case when n_nationkey % 12 = 5 then 0 else 1 end as active
from nation join region on n_regionkey = r_regionkey
union all
select 100 + r_regionkey, 'state-desk', 'LEA', 'sms', concat(lower(r_name), '@desk.example'), r_name, '', 1 from region
union all
select min(r_regionkey) + 1, 'national-desk', 'I4C', 'webhook', 'national@desk.example', '', '', 1 from region""",
    "evidence": """
select doc_id + 999900 as evidence_no, {div:doc_id,8} as case_id, source as kind, text, n_chars as size_bytes,
  concat('officer-', cast(doc_id % 7 as varchar(20))) as collected_by, 1700000000 + doc_id * 60 as collected_s
from documents""",
    "notes": """
select conv_id as case_id, turn, role as author, text from conversations""",
    "audit": """
select event_id as audit_no, {epoch:ts} as at_s, user_id as case_id, event_type as action,
  case event_type when 'click' then 'Under Review' when 'view' then 'Investigating' when 'purchase' then 'Resolved'
    when 'signup' then 'Intervention Required' else 'Bogus' end as status,
  concat('officer-', cast(event_id % 9 as varchar(20))) as actor
from events""",
}


def _render(text: str, dialect: str) -> str:
    import re

    if dialect == "spark":
        text = re.sub(r"\{epoch:([^}]*)\}", r"unix_timestamp(\1)", text)
        return re.sub(r"\{div:([^,}]*),([^}]*)\}", r"cast((\1) div \2 as bigint)", text)
    text = re.sub(r"\{epoch:([^}]*)\}", r"cast(floor(epoch(\1)) as bigint)", text)
    return re.sub(r"\{div:([^,}]*),([^}]*)\}", r"cast((\1) // \2 as bigint)", text)


def duckdb_ctes(*names: str) -> str:
    """The same views as a WITH list for the comparison SQL."""
    return ", ".join(f"{n} as ({_render(VIEWS[n], 'duckdb')})" for n in names)


class Domain:
    """Lazily built domain tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        for table in TABLES:
            if table in VIEWS[name]:
                self.raw(table).createOrReplaceTempView(table)
        return self.spark.sql(_render(VIEWS[name], "spark"))
