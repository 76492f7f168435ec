"""Whole analytical queries over the star tables, and the streaming forms of the time-bucket ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..operators import relational as R
from ..sources.scratch import scratch
from ..streaming import windows as SW
from .registry import query, text


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def day(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where(F.col("l_shipdate") <= day("1998-09-02"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(revenue()), 2).alias("sum_disc_price"),
        F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query("""select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""")
def shipping_priority(t: Tables) -> DataFrame:
    c = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = t.orders.where(F.col("o_orderdate") < day("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    rows = t.lineitem.where(F.col("l_shipdate") > day("1998-03-15")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return R.top(rows.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 4).alias("revenue")), ["-revenue", "l_orderkey"], 10)


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by n_name""")
def local_supplier_volume(t: Tables) -> DataFrame:
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t.orders.where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1998-01-01"))).select("o_orderkey", "o_custkey")
    rows = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(F.round(F.sum(revenue()), 4).alias("revenue"))


@query("select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
def forecast_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


text("volume_by_nations", """select sn.n_name as supp_nation, cn.n_name as cust_nation, year(l_shipdate) as y, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey
join customer on c_custkey = o_custkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey where (sn.n_regionkey = 1 and cn.n_regionkey = 2 or sn.n_regionkey = 2 and cn.n_regionkey = 1) group by 1, 2, 3""",
     """select sn.n_name as supp_nation, cn.n_name as cust_nation, cast(year(l_shipdate) as int) as y, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey
join customer on c_custkey = o_custkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey where (sn.n_regionkey = 1 and cn.n_regionkey = 2 or sn.n_regionkey = 2 and cn.n_regionkey = 1) group by 1, 2, 3""", tables=("supplier", "lineitem", "orders", "customer", "nation"))  # fmt: skip
text("returned_items", "select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by c_custkey, c_name order by revenue desc, c_custkey limit 20", tables=("customer", "orders", "lineitem"))
text("ship_mode_like", "select o_orderpriority, sum(case when l_linestatus = 'F' then 1 else 0 end) as done, sum(case when l_linestatus <> 'F' then 1 else 0 end) as pending from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 20 group by o_orderpriority",
     "select o_orderpriority, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as done, cast(sum(case when l_linestatus <> 'F' then 1 else 0 end) as bigint) as pending from orders join lineitem on o_orderkey = l_orderkey where l_quantity > 20 group by o_orderpriority", tables=("orders", "lineitem"))
text("customer_distribution", "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) group by c_count", tables=("customer", "orders"))
text("promo_share", "select round(100 * sum(case when p_type like 'PROMO%' or p_size < 10 then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 4) as promo from lineitem join part on l_partkey = p_partkey", tables=("lineitem", "part"))
text("top_supplier", "with r as (select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as total from lineitem group by l_suppkey) select s_suppkey, s_name, total from supplier join r on s_suppkey = l_suppkey where total = (select max(total) from r)", tables=("lineitem", "supplier"))
# NOT IN of a key without nulls as NOT EXISTS: the planner's own NOT IN broadcasts the suppliers, however many there are
text("parts_supplier_relation", "select p_brand, p_size, count(distinct l_suppkey) as supplier_cnt from part join lineitem on p_partkey = l_partkey where p_size in (3, 9, 14, 19) and l_suppkey is not null and not exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal < 0) group by p_brand, p_size",
     "select p_brand, p_size, count(distinct l_suppkey) as supplier_cnt from part join lineitem on p_partkey = l_partkey where p_size in (3, 9, 14, 19) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_size", tables=("part", "lineitem", "supplier"))
text("small_quantity", "select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem join part on p_partkey = l_partkey where p_size < 10 and l_quantity < (select 0.5 * avg(x.l_quantity) from lineitem x where x.l_partkey = p_partkey)", tables=("lineitem", "part"))
text("large_volume", "select c_name, o_orderkey, o_totalprice, round(sum(l_quantity), 2) as q from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 150) group by c_name, o_orderkey, o_totalprice order by o_totalprice desc, o_orderkey limit 100", tables=("customer", "orders", "lineitem"))
text("sales_opportunity", "select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as total from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_nationkey", tables=("customer", "orders"))
text("order_priority_check", "select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp_ntz'1996-07-01' and o_orderdate < timestamp_ntz'1996-10-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30) group by o_orderpriority",
     "select o_orderpriority, count(*) as n from orders where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '1996-10-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30) group by o_orderpriority", tables=("orders", "lineitem"))
text("market_share", "select y, round(sum(case when n_name = 'BRAZIL' or n_nationkey = 2 then volume else 0 end) / sum(volume), 6) as share from (select year(o_orderdate) as y, l_extendedprice * (1 - l_discount) as volume, n_name, n_nationkey from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey) group by y",
     "select cast(y as int) as y, round(sum(case when n_name = 'BRAZIL' or n_nationkey = 2 then volume else 0 end) / sum(volume), 6) as share from (select year(o_orderdate) as y, l_extendedprice * (1 - l_discount) as volume, n_name, n_nationkey from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey) group by y", tables=("lineitem", "orders", "supplier", "nation"))
text("waiting_suppliers", "select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey where o_orderstatus = 'F' and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_quantity > 45) group by s_name order by numwait desc, s_name limit 100", tables=("supplier", "lineitem", "orders"))


def stream_events(t: Tables) -> DataFrame:
    """The events table as a stream of files."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("select event_type, time_bucket(interval '1 day', ts, timestamp '2024-01-01') as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    out = SW.tumbling(stream_events(t), "ts", "1 day", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = SW.to_files(out, scratch(t.spark, "tumbling"))
    return rows.select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", F.round("total", 4).alias("total"))


@query("""with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as new from events),
g as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as g from s) select user_id, min(ts) as start, max(ts) + interval '6 hours' as stop, count(*) as n from g group by user_id, g""")
def stream_sessions(t: Tables) -> DataFrame:
    out = SW.sessions(stream_events(t), "ts", "6 hours", "1 hour", ["user_id"], F.count("*").alias("n"))
    rows = SW.to_files(out, scratch(t.spark, "sessions"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("select distinct user_id, event_type from events")
def stream_once_each(t: Tables) -> DataFrame:
    out = SW.once_each(stream_events(t), "ts", ["user_id", "event_type"], "400 days")
    return SW.to_files(out.select("user_id", "event_type"), scratch(t.spark, "once"), "append")
