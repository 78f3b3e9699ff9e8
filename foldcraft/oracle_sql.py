"""Independent SQL text of the fixtures, for the DuckDB oracle.

Every oracle query is ``with_base(body)``: the ``accounts`` and ``scored``
views written as CTEs over the driver's pre-registered tables, followed by
the operator's own SQL.  Doubles are rounded to 6 decimals and integers
cast to BIGINT on both sides.
"""

ACCOUNTS = """
select o.o_orderkey as id,
  case when o.o_orderkey % 10 < 7 then 'train' when o.o_orderkey % 10 < 9 then 'test' else 'ref' end as role,
  cast(o.o_orderstatus = 'F' as int) as y,
  o.o_orderpriority as pri, c.c_mktsegment as seg, n.n_name as nation, r.r_name as region,
  cast((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 as int) as tenure,
  c.c_acctbal as monthly, o.o_totalprice as total,
  cast(coalesce(l.n_items, 0) as bigint) as n_items,
  case when l.n_items is null then 'None' when l.k_ret > 0 then 'Yes' else 'No' end as svc_return,
  case when l.n_items is null then 'None' when l.k_acc > 0 then 'Yes' else 'No' end as svc_accept,
  case when l.n_items is null then 'None' when l.k_non > 0 then 'Yes' else 'No' end as svc_keep,
  case when l.n_items is null then 'None' when l.k_blk > 0 then 'Yes' else 'No' end as svc_bulk,
  case when l.n_items is null then 'None' when l.k_dsc > 0 then 'Yes' else 'No' end as svc_disc,
  case when l.n_items is null then 'None' when l.k_tax > 0 then 'Yes' else 'No' end as svc_tax,
  case when l.n_items is null then 'None' when l.k_opn > 0 then 'Yes' else 'No' end as svc_open,
  case when l.n_items is null then 'None' when l.k_lat > 0 then 'Yes' else 'No' end as svc_late
from orders o
join customer c on o.o_custkey = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
left join (
  select l_orderkey, count(*) as n_items,
    sum(case when l_returnflag = 'R' then 1 else 0 end) as k_ret,
    sum(case when l_returnflag = 'A' then 1 else 0 end) as k_acc,
    sum(case when l_returnflag = 'N' then 1 else 0 end) as k_non,
    sum(case when l_quantity > 40 then 1 else 0 end) as k_blk,
    sum(case when l_discount >= 0.08 then 1 else 0 end) as k_dsc,
    sum(case when l_tax >= 0.07 then 1 else 0 end) as k_tax,
    sum(case when l_linestatus = 'O' then 1 else 0 end) as k_opn,
    sum(case when year(l_shipdate) >= 1999 then 1 else 0 end) as k_lat
  from lineitem group by l_orderkey
) l on l.l_orderkey = o.o_orderkey
"""

SCORED = """
select a.*,
  cast(0.02 * (40 - tenure) + (case when svc_return = 'Yes' then 1.0 else 0.0 end)
     + (case when pri = '1-URGENT' then 0.8 else 0.0 end)
     + 3.0 * (((id * 7919 + 17) % 10007) / 10007.0 - 0.5) > 0.6 as int) as y_sig,
  cast(1.0 / (1.0 + exp(-(0.02 * (40 - tenure) + (case when svc_return = 'Yes' then 1.0 else 0.0 end) - 0.6))) as double) as s_a,
  cast(0.7 / (1.0 + exp(-(0.02 * (40 - tenure) + (case when svc_return = 'Yes' then 1.0 else 0.0 end) - 0.6)))
     + 0.3 * (((id * 104729 + 29) % 10007) / 10007.0) as double) as s_b
from accounts a
"""


def with_base(body: str, extra: str = "") -> str:
    """Prefix ``body`` with the fixture CTEs (+ optional extra CTEs)."""
    ctes = f"accounts as ({ACCOUNTS}),\nscored as ({SCORED})"
    if extra:
        ctes += ",\n" + extra
    return f"with {ctes}\n{body}"
