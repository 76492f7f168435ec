"""Scans, filters, joins, aggregates, windows, sorts, set operations and subqueries over the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..operators import aggregates as A
from ..operators import dml
from ..operators import relational as R
from ..operators import tablefuncs as TF
from ..operators import timeseries as TS
from ..operators import windows as W
from .registry import query, text

YEARS = "l_shipdate >= '1995-01-01' and l_shipdate < '1997-01-01'"


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""select o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from orders join lineitem on o_orderkey = l_orderkey
where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1997-01-01' group by o_orderpriority order by revenue desc limit 10""")
def revenue_by_priority(t: Tables) -> DataFrame:
    joined = t.orders.select("o_orderkey", "o_orderpriority").join(t.lineitem.where(YEARS), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.top(joined.groupBy("o_orderpriority").agg(F.round(F.sum(revenue()), 2).alias("revenue")), ["-revenue"], 10)


# scans, filters, predicates

text("scan_project", "select c_custkey, c_name, c_acctbal from customer", tables=("customer",))
text("pk_lookup", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey in (1, 7, 33, 102)", tables=("orders",))
text("count_star", "select count(*) as n from lineitem where l_quantity > 25", tables=("lineitem",))
text("filter_three_valued", "select c_custkey from customer where nullif(c_nationkey, 3) <> 5 or nullif(c_mktsegment, 'BUILDING') = 'AUTOMOBILE'", tables=("customer",))
text("filter_not_unknown", "select c_custkey from customer where not (nullif(c_nationkey, 3) = 5 and c_acctbal > 0)", tables=("customer",))
text("filter_between", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12 and l_discount not between 0.02 and 0.08", tables=("lineitem",))
text("filter_in_list", "select p_partkey, p_size from part where p_size in (1, 15, 23) and (p_size not in (23, null)) is null", tables=("part",))
text("filter_is_null", "select count(*) as n, count(nullif(c_nationkey, 3)) as known from customer where nullif(c_nationkey, 7) is not null", tables=("customer",))
text("filter_is_distinct", "select c_custkey from customer where nullif(c_nationkey, 3) is distinct from 5 and nullif(c_nationkey, 3) is not distinct from nullif(c_nationkey, 4)", tables=("customer",))
text("filter_is_true", "select count(*) filter (where (nullif(p_size, 5) > 20) is true) as t, count(*) filter (where (nullif(p_size, 5) > 20) is false) as f, count(*) filter (where (nullif(p_size, 5) > 20) is unknown) as u from part",
     "select count(*) filter (where (nullif(p_size, 5) > 20) is true) as t, count(*) filter (where (nullif(p_size, 5) > 20) is false) as f, count(*) filter (where (nullif(p_size, 5) > 20) is null) as u from part", tables=("part",))
text("filter_like", "select p_partkey, p_name from part where p_name like '%a%e%' and p_type not like '%!_%' escape '!'", tables=("part",))
text("filter_ilike", "select p_partkey from part where p_name ilike '%AN%'", tables=("part",))
text("case_searched", "select o_orderpriority, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band, count(*) as n from orders group by 1, 2", tables=("orders",))
text("case_simple", "select case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as state, count(*) as n from orders group by 1", tables=("orders",))


@query("select p_partkey from part where regexp_full_match(p_brand, 'Brand#[12][0-9]')")
def filter_regexp(t: Tables) -> DataFrame:
    from ..functions.strings import full_match

    return t.part.where(full_match(F.col("p_brand"), "Brand#[12][0-9]")).select("p_partkey")


@query("select c_custkey from customer where coalesce(nullif(c_nationkey, 3) > 10, false) or c_acctbal < 0")
def filter_ignore3vl(t: Tables) -> DataFrame:
    return t.customer.where(R.ignore3vl(F.nullif("c_nationkey", F.lit(3)) > 10) | (F.col("c_acctbal") < 0)).select("c_custkey")


@query("select vec_id from embeddings where list_max(embedding) > 0.3 and list_min(embedding) > -0.4")
def filter_any_all(t: Tables) -> DataFrame:
    from ..functions import arrays

    a = F.col("embedding")
    bound = F.lit(0.3).cast("float")
    return t.embeddings.where(arrays.some(a, lambda x: x > bound) & arrays.every(a, lambda x: x > F.lit(-0.4).cast("float"))).select("vec_id")


# joins

text("join_inner", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 150000", tables=("orders", "customer"))
text("join_multi", "select r_name, n_name, count(*) as n, round(sum(c_acctbal), 2) as bal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name", tables=("customer", "nation", "region"))
text("join_left", "select o_orderkey, l.n from orders left join (select l_orderkey, count(*) as n from lineitem where l_quantity > 40 group by l_orderkey) l on l.l_orderkey = o_orderkey", tables=("orders", "lineitem"))
text("join_right", "select n_name, c.c_custkey from (select * from customer where c_acctbal > 9000) c right join nation on c_nationkey = n_nationkey", tables=("customer", "nation"))
text("join_full", "select s.s_suppkey, c.c_custkey from (select * from supplier where s_nationkey < 8) s full join (select * from customer where c_nationkey > 6 and c_acctbal > 9000) c on s_nationkey = c_nationkey", tables=("supplier", "customer"))
text("join_cross", "select a.r_name as a, b.n_name as b from region a cross join nation b", tables=("region", "nation"))
text("join_theta", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey or a.n_nationkey = b.n_nationkey + 20", tables=("nation",))
text("join_self", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey", tables=("supplier",))
text("join_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)", tables=("orders", "lineitem"))
text("join_anti", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)", tables=("orders", "lineitem"))


@query("select l_orderkey, l_partkey, p_name from lineitem join part on l_partkey = p_partkey where p_size = 1")
def join_lookup(t: Tables) -> DataFrame:
    parts = t.part.where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return R.lookup_join(t.lineitem.select("l_orderkey", "l_partkey"), parts, "l_partkey").select("l_orderkey", "l_partkey", "p_name")


# subqueries

text("subquery_scalar", "select count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders)", tables=("orders",))
text("subquery_correlated", "select p_partkey, (select count(*) from lineitem where l_partkey = p_partkey) as n from part where p_size < 3", tables=("part", "lineitem"))
text("subquery_in", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)", tables=("customer", "nation"))
text("subquery_not_in_null", "select c_custkey from customer where c_nationkey not in (select nullif(n_nationkey, 4) from nation where n_nationkey < 4)", tables=("customer", "nation"))
text("subquery_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select 2 * avg(n) from (select count(*) as n from orders group by o_custkey) x)", tables=("orders",))


@query("select o_orderkey from orders where o_totalprice >= all (select o_totalprice from orders where o_orderstatus = 'F')")
def subquery_all(t: Tables) -> DataFrame:
    return R.compare_all(t.orders, F.col("o_totalprice"), ">=", t.orders.where("o_orderstatus = 'F'").select("o_totalprice")).select("o_orderkey")


@query("select c_custkey from customer where c_acctbal < any (select s_acctbal from supplier where s_nationkey = 3)")
def subquery_any(t: Tables) -> DataFrame:
    return R.compare_any(t.customer, F.col("c_acctbal"), "<", t.supplier.where("s_nationkey = 3").select("s_acctbal")).select("c_custkey")


@query("select (select list(n_name order by n_name) from nation where n_regionkey = 1) as names, r_name from region")
def subquery_array(t: Tables) -> DataFrame:
    names = t.nation.where("n_regionkey = 1").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return t.region.crossJoin(F.broadcast(names)).select("names", "r_name")  # one row


# aggregates

text("agg_group", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 2) as avg_price, min(l_discount) as lo, max(l_tax) as hi, count(*) as n from lineitem group by l_returnflag, l_linestatus", tables=("lineitem",))
text("agg_global", "select count(*) as n, round(sum(l_extendedprice), 2) as total, min(l_shipdate) as first_day, max(l_shipdate) as last_day from lineitem", tables=("lineitem",))
text("agg_empty", "select count(*) as n, sum(l_quantity) as s, min(l_returnflag) as m from lineitem where l_quantity < 0", tables=("lineitem",))
text("agg_having", "select l_suppkey, count(*) as n from lineitem group by l_suppkey having count(*) > 5 and max(l_quantity) >= 49", tables=("lineitem",))
text("agg_filter", "select l_returnflag, count(*) filter (where l_quantity > 30) as big, round(sum(l_tax) filter (where l_linestatus = 'O'), 4) as open_tax from lineitem group by l_returnflag", tables=("lineitem",))
text("agg_distinct", "select count(distinct l_suppkey) as supps, round(avg(distinct l_quantity), 4) as avg_q, cast(sum(distinct l_linenumber) as bigint) as s from lineitem", tables=("lineitem",))
text("agg_distinct_group", "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_orderkey) as orders from lineitem group by l_returnflag", tables=("lineitem",))
text("agg_null_group", "select nullif(c_nationkey, 3) as k, count(*) as n, count(nullif(c_mktsegment, 'BUILDING')) as known from customer group by 1", tables=("customer",))
text("agg_ordinal", "select c_mktsegment, count(*) as n from customer group by 1 order by 2 desc, 1", tables=("customer",))
text("agg_stddev", "select c_mktsegment, round(stddev_pop(c_acctbal), 4) as pop, round(stddev_samp(c_acctbal), 4) as samp from customer group by c_mktsegment", tables=("customer",))
text("select_distinct", "select distinct o_orderstatus, o_orderpriority from orders", tables=("orders",))
text("agg_bigint_sum", "select cast(sum(o_orderkey) as bigint) as s, cast(sum(o_custkey) as bigint) as c from orders", tables=("orders",))


@query("select c_mktsegment, max_by(c_custkey, c_acctbal) as richest, min_by(c_custkey, c_acctbal) as poorest from customer group by c_mktsegment")
def agg_max_by(t: Tables) -> DataFrame:
    key, by = F.col("c_custkey"), F.col("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(A.max_by(key, by).alias("richest"), A.min_by(key, by).alias("poorest"))


@query("select c_mktsegment, round(var_pop(c_acctbal), 2) as variance from customer group by c_mktsegment")
def agg_variance(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.round(A.variance(F.col("c_acctbal")), 2).alias("variance"))


@query("select p_brand, round(exp(avg(ln(p_retailprice))), 4) as gm from part group by p_brand")
def agg_geometric_mean(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.round(A.geometric_mean(F.col("p_retailprice")), 4).alias("gm"))


@query("select c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) as p50, round(quantile_cont(c_acctbal, 0.9), 4) as p90 from customer group by c_mktsegment")
def agg_percentile(t: Tables) -> DataFrame:
    got = A.percentiles(t.customer, ["c_mktsegment"], "c_acctbal", {"p50": 0.5, "p90": 0.9})
    return got.select("c_mktsegment", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@query("select event_type, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.75), 6) as q3 from events group by event_type")
def agg_percentile_array(t: Tables) -> DataFrame:
    p = A.percentile(F.col("value"), [0.25, 0.75])
    return t.events.groupBy("event_type").agg(p.alias("p")).select("event_type", F.round(F.col("p")[0], 6).alias("q1"), F.round(F.col("p")[1], 6).alias("q3"))


@query("select n_regionkey, list(nullif(n_nationkey, 3) order by n_nationkey) as ks from nation group by n_regionkey")
def agg_array_agg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(A.array_agg_ordered(F.nullif("n_nationkey", F.lit(3)), F.col("n_nationkey")).alias("ks"))


@query("select c_mktsegment, list_sort(list(distinct c_nationkey)) as ks from customer group by c_mktsegment")
def agg_collect_set(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(A.collect_set(F.col("c_nationkey")).alias("ks"))


@query("select n_regionkey, string_agg(nullif(n_name, 'CHINA'), '; ' order by n_name) as names from nation group by n_regionkey")
def agg_string_agg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(A.string_agg(F.nullif("n_name", F.lit("CHINA")), "; ", F.col("n_name")).alias("names"))


@query("select event_type, round(avg(cast(epoch_us(ts) // 1000 as double)), 0) as at from events group by event_type")
def agg_avg_timestamp(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(A.avg_timestamp(F.col("ts")), 0).alias("at"))


@query("""select l_returnflag, l_shipmonth, frequency from (select *, row_number() over (partition by l_returnflag order by frequency desc, l_shipmonth) as r from
(select l_returnflag, cast(month(l_shipdate) as int) as l_shipmonth, count(*) as frequency from lineitem group by 1, 2)) where r <= 3""")
def agg_topk(t: Tables) -> DataFrame:
    return A.top_k(t.lineitem.select("l_returnflag", F.month("l_shipdate").alias("l_shipmonth")), ["l_returnflag"], "l_shipmonth", 3)


@query()
def agg_topk_sketch(t: Tables) -> DataFrame:
    return A.top_sketched(t.lineitem, "l_suppkey", 5)


@query()
def agg_hyperloglog(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(A.hyperloglog_distinct(F.col("l_partkey")).alias("parts"))


@query()
def agg_percentile_sketch(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(A.percentile_sketch(F.col("l_extendedprice"), 0.95).alias("p95"))


@query()
def agg_lttb(t: Tables) -> DataFrame:
    return A.lttb(t.events, ["event_type"], "ts", "value", 50)


@query("select count(*) as n, count(distinct o_custkey) as different from (select distinct o_custkey from orders limit 20)")
def distinct_limit(t: Tables) -> DataFrame:
    return R.distinct_limit(t.orders.select("o_custkey"), 20).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("different"))


@query("select p_brand, any_value(length(p_brand)) as n from part group by p_brand")
def agg_any_value(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(A.any_value(F.length("p_brand")).cast("long").alias("n"))


# windows

text("window_rank", "select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn, rank() over (partition by s_nationkey order by floor(s_acctbal / 1000)) as rk, dense_rank() over (partition by s_nationkey order by floor(s_acctbal / 1000)) as dr from supplier",
     "select s_suppkey, s_nationkey, cast(row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as int) as rn, cast(rank() over (partition by s_nationkey order by floor(s_acctbal / 1000)) as int) as rk, cast(dense_rank() over (partition by s_nationkey order by floor(s_acctbal / 1000)) as int) as dr from supplier", tables=("supplier",))
text("window_offset", "select event_id, lag(value) over w as before, lead(value, 2, -1.0D) over w as after from events window w as (partition by user_id order by ts, event_id)", "select event_id, lag(value) over w as before, lead(value, 2, -1.0) over w as after from events window w as (partition by user_id order by ts, event_id)", tables=("events",))
text("window_values", "select event_id, first_value(event_type) over w as f, last_value(event_type) over w as l, nth_value(event_type, 2) over w as n from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 1 following)", tables=("events",))
text("window_ignore_nulls", "select event_id, last_value(nullif(event_type, 'click')) ignore nulls over w as l, lag(nullif(event_type, 'click'), 1) ignore nulls over (partition by user_id order by ts, event_id) as g from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)",
     "select event_id, last_value(nullif(event_type, 'click') ignore nulls) over w as l, lag(nullif(event_type, 'click'), 1 ignore nulls) over (partition by user_id order by ts, event_id) as g from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)", tables=("events",))
text("window_rows_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 1 preceding and current row), 2) as s, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as n from orders", tables=("orders",))
text("window_range_frame", "select s_suppkey, count(*) over (partition by s_nationkey order by s_acctbal range between 500 preceding and 500 following) as n from supplier", tables=("supplier",))
text("window_range_interval", "select event_id, count(*) over (partition by user_id order by ts range between interval '1' day preceding and current row) as n from events", tables=("events",))
text("window_default_frame", "select event_id, round(sum(value) over (partition by user_id order by ts), 4) as s, round(avg(value) over (partition by user_id), 4) as a from events", tables=("events",))


@query("""select event_id, count(*) filter (where event_type = 'click') over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as clicks,
(select count(distinct event_type) from events e where e.user_id = events.user_id) as kinds from events""")
def window_filter_distinct(t: Tables) -> DataFrame:
    running = W.rows(W.over(["user_id"], ["ts", "event_id"]), None, 0)
    clicks = W.filtered(F.count, F.lit(1), F.col("event_type") == "click", running)
    return t.events.select("event_id", clicks.alias("clicks"), W.count_distinct_whole(F.col("event_type"), ["user_id"]).alias("kinds"))


# sorts and limits


@query("select k, c_custkey from (select nullif(c_nationkey, 3) as k, c_custkey from customer) order by k desc nulls first, c_custkey limit 20 offset 5")
def top_k_nulls_first(t: Tables) -> DataFrame:
    return R.top(t.customer.select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey"), ["-k", "c_custkey"], 20, 5)


@query("select k, c_custkey from (select nullif(c_nationkey, 24) as k, c_custkey from customer) order by k asc nulls last, c_custkey desc limit 15")
def top_k_nulls_last(t: Tables) -> DataFrame:
    return R.top(t.customer.select(F.nullif("c_nationkey", F.lit(24)).alias("k"), "c_custkey"), ["k", F.col("c_custkey").desc()], 15)


@query("select n_nationkey, n_name from nation order by n_name desc")
def sort_total(t: Tables) -> DataFrame:
    return R.order(t.nation.select("n_nationkey", "n_name"), "-n_name")


text("top_k_fetch", "select o_orderkey, o_totalprice, o_orderpriority from orders order by o_totalprice desc, o_orderkey limit 25", tables=("orders",))

# set operations, tables of values

text("union_all", "select n_nationkey as k, n_name as v from nation union all select r_regionkey, r_name from region union all select r_regionkey, r_name from region", tables=("nation", "region"))
text("union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier union select r_regionkey from region", tables=("customer", "supplier", "region"))
text("intersect", "select c_nationkey as k from customer where c_acctbal > 9900 intersect select s_nationkey from supplier where s_acctbal > 5000", tables=("customer", "supplier"))
text("except", "select n_nationkey as k from nation except select c_nationkey from customer where c_acctbal > 9900", tables=("nation", "customer"))
text("with_cte", "with big as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey), top as (select * from big where total > 1000000) select c_name, round(total, 2) as total from top join customer on c_custkey = o_custkey", tables=("orders", "customer"))
text("values_relation", "select a, b, upper(b) as c from (values (1, 'x'), (2, null), (3, 'z')) as v(a, b)", tables=())
text("with_recursive", "with recursive r(n) as (select 1 union all select n + 1 from r where n < 20) select n, n * n as sq from r", tables=())


@query("select cast(n_nationkey as bigint) as k, n_name as v from nation union select s_suppkey, s_name from supplier")
def union_types(t: Tables) -> DataFrame:
    return R.union(t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")), t.supplier.select("s_suppkey", "s_name"), distinct=True)


@query("select c_custkey, c_name from customer where c_nationkey = 5")
def view(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("strataflow_base")
    t.spark.sql("create or replace temporary view strataflow_view as select c_custkey, c_name from strataflow_base where c_nationkey = 5")
    return t.spark.table("strataflow_view")


# table functions


@query("select r_regionkey, unnest([1, 2, 3]) as a, unnest(['x', 'y']) as b from region")
def table_unnest(t: Tables) -> DataFrame:
    return TF.unnest(t.region, ["r_regionkey"], a=F.array(F.lit(1), F.lit(2), F.lit(3)), b=F.array(F.lit("x"), F.lit("y")))


@query("select unnest(generate_series(3, 40, 4)) as generate_series")
def table_generate_series(t: Tables) -> DataFrame:
    return TF.generate_series(t.spark, 3, 40, 4)


@query("select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-03', interval 6 hour)) as generate_series")
def table_generate_times(t: Tables) -> DataFrame:
    return TF.generate_times(t.spark, "2024-01-01", "2024-01-03", "6 hours")


@query("select vec_id, cast(unnest(generate_series(len(embedding), 1, -1)) as int) as i from embeddings")
def table_generate_subscripts(t: Tables) -> DataFrame:
    return R.project_set(t.embeddings, ["vec_id"], i=TF.generate_subscripts(F.col("embedding"), reverse=True))


@query("select event_id, regexp_extract_all(props, '([a-z]+)\": ([0-9]+)', 1) as names, regexp_extract_all(props, '([a-z]+)\": ([0-9]+)', 2) as numbers from events")
def table_regexp_matches(t: Tables) -> DataFrame:
    got = t.events.select("event_id", TF.regexp_matches(F.col("props"), '([a-z]+)": ([0-9]+)', every=True).alias("m"))
    return got.select("event_id", F.transform("m", lambda x: x[0]).alias("names"), F.transform("m", lambda x: x[1]).alias("numbers"))


@query("select vec_id, unnest(embedding) as x, cast(generate_subscripts(embedding, 1) as int) as n from embeddings")
def table_expand_array(t: Tables) -> DataFrame:
    return TF.expand_array(t.embeddings, ["vec_id"], F.col("embedding"))


@query()
def table_summits(t: Tables) -> DataFrame:
    return TF.summits(t.spark)


# time buckets


@query("select event_type, time_bucket(interval '6 hours', ts, timestamp '2024-01-01') as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def time_bins(t: Tables) -> DataFrame:
    return TS.binned(t.events, "ts", "6 hours", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), origin="2024-01-01 00:00:00")


@query("""with b as (select event_type, time_bucket(interval '2 hours', ts, timestamp '2024-01-01') as bucket, count(*) as n from events where value > 90 group by 1, 2),
e as (select event_type, unnest(generate_series(min(bucket), max(bucket), interval 2 hour)) as bucket from b group by event_type)
select e.event_type, e.bucket, coalesce(n, 0) as n from e left join b on b.event_type = e.event_type and b.bucket = e.bucket""")
def time_gap_fill(t: Tables) -> DataFrame:
    bins = TS.binned(t.events.where("value > 90"), "ts", "2 hours", ["event_type"], F.count("*").alias("n"), origin="2024-01-01 00:00:00")
    return TS.fill_gaps(bins, ["event_type"], "2 hours", {"n": 0})


# changes to tables


@query("select s_suppkey, s_name, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier where not s_nationkey = 3")
def change_update_delete(t: Tables) -> DataFrame:
    rows = dml.update(t.supplier, F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})
    return dml.delete(rows, F.col("s_nationkey") == 3).select("s_suppkey", "s_name", "s_acctbal")


@query("select n_nationkey, case when n_regionkey = 1 then n_name || '+' || n_name else n_name end as n_name from nation union all select n_nationkey + 100, n_name from nation where n_regionkey = 2")
def change_upsert(t: Tables) -> DataFrame:
    base = t.nation.select("n_nationkey", "n_name")
    rows = t.nation.where("n_regionkey = 1").select("n_nationkey", "n_name").union(t.nation.where("n_regionkey = 2").select(F.col("n_nationkey") + 100, "n_name"))
    return dml.insert_on_conflict(base, rows, ["n_nationkey"], {"n_name": F.concat("n_name", F.lit("+"), "excluded.n_name")})


# numeric and interval aggregates, text functions of the current time


@query("""select l_returnflag, cast(sum(cast(l_quantity as decimal(12, 2))) as double) as s, round(avg(cast(l_extendedprice as decimal(12, 2))), 4) as a, cast(max(cast(l_tax as decimal(6, 4))) as double) as m from lineitem group by l_returnflag""")
def agg_numeric(t: Tables) -> DataFrame:
    q, p, x = F.col("l_quantity").cast("decimal(12,2)"), F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(6,4)")
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(q).cast("double").alias("s"), F.round(A.avg_numeric(p), 4).cast("double").alias("a"), F.max(x).cast("double").alias("m"))


@query("""select o_orderstatus, cast(sum((epoch_us(o_orderdate) - epoch_us(timestamp '1995-01-01')) // 1000000) as bigint) as seconds,
min(epoch_us(o_orderdate) - epoch_us(timestamp '1995-01-01')) // 1000000 as least from orders group by o_orderstatus""")
def agg_intervals(t: Tables) -> DataFrame:
    since = F.col("o_orderdate") - F.lit("1995-01-01").cast("timestamp_ntz")
    return t.orders.groupBy("o_orderstatus").agg(A.sum_seconds(since).alias("seconds"), F.min(since).cast("interval second").cast("decimal(19,6)").cast("long").alias("least"))


@query("select case when c_custkey % 2 = 0 then 'even' else 'odd' end as k, count(*) as n from customer group by 1")
def udf_scalar(t: Tables) -> DataFrame:
    from ..functions.sql import create_function

    create_function(t.spark, "strataflow_parity", "if(x % 2 = 0, 'even', 'odd')", "string", "x bigint")
    return t.customer.groupBy(F.expr("strataflow_parity(c_custkey)").alias("k")).agg(F.count("*").alias("n"))


@query()
def system_now(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.current_timestamp().alias("ts"), F.current_date().alias("day"), F.expr("uuid()").alias("id"), F.rand().alias("r"))


@query("select c_custkey, n_name from (select c_custkey, case when c_nationkey > 20 then null else c_nationkey end as k from customer) c left join nation on k = n_nationkey")
def join_null_keys(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("k"))
    return c.join(t.nation, F.col("k") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("select p_partkey, round(p_retailprice * 1.1, 4) as x from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50) and p_size > (select avg(p_size) from part)")
def subquery_multi_phase(t: Tables) -> DataFrame:
    mean = t.part.agg(F.avg("p_size").alias("_mean"))
    wanted = t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    rows = R.semi(t.part, wanted, "p_partkey").crossJoin(F.broadcast(mean)).where("p_size > _mean")  # one row
    return rows.select("p_partkey", F.round(F.col("p_retailprice") * 1.1, 4).alias("x"))
