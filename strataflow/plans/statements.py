"""Statements, sources, session functions, analyzers and the rest of the forms as queries, each with its SQL."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TABLES, Tables
from ..functions import arrays, geo, network, objects, sql, strings, system, times
from ..operators import aggregates as A
from ..operators import analysis as An
from ..operators import dml, schema, statements, stemming
from ..operators import relational as R
from ..operators import textsearch as T
from ..operators import timeseries as TS
from ..sources import files
from ..sources.jdbc import Foreign, shared_database
from ..sources.scratch import scratch
from ..streaming import windows as SW
from .registry import query, text


def unique(name: str) -> str:
    return f"strataflow_{name}_{uuid.uuid4().hex[:12]}"


# predicates


@query("select p_partkey, regexp_full_match(p_brand, '(?i)bRAND#[12][0-9]') as same, not regexp_full_match(p_type, '(?i).*sTEEL') as other from part")
def filter_regexp_ignore_case(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.full_match(F.col("p_brand"), "bRAND#[12][0-9]", True).alias("same"), (~strings.full_match(F.col("p_type"), ".*sTEEL", True)).alias("other"))


@query("""select p_partkey, x = 2 or y = 2 as any_eq, x <> 2 or y <> 2 as any_ne, x = 2 and y = 2 as all_eq, x <> 2 and y <> 2 as all_ne, x <= 2 and y <= 2 as all_le, p_name like '%a%' and p_name like '%e%' as all_like, p_name not like '%a%' or p_name not like '%e%' as any_not_like
from (select *, p_size % 5 as x, nullif(p_size % 7, 3) as y from part)""")
def filter_any_all_forms(t: Tables) -> DataFrame:
    a, likes = F.array(F.col("p_size") % 5, F.nullif(F.col("p_size") % 7, F.lit(3))), F.array(F.lit("%a%"), F.lit("%e%"))
    name = F.col("p_name")
    cols = {
        "any_eq": arrays.some(a, lambda x: x == 2), "any_ne": arrays.some(a, lambda x: x != 2), "all_eq": arrays.every(a, lambda x: x == 2), "all_ne": arrays.every(a, lambda x: x != 2), "all_le": arrays.every(a, lambda x: x <= 2),
        "all_like": arrays.every(likes, lambda p: F.call_function("like", name, p)), "any_not_like": arrays.some(likes, lambda p: ~F.call_function("like", name, p)),
    }
    return t.part.select("p_partkey", *[c.alias(k) for k, c in cols.items()])


def quantified_sql() -> str:
    """Every operator by counting, null rules spelled out: v has a null, w has none, z is empty."""
    ops = {"eq": "=", "ne": "<>", "lt": "<", "ge": ">="}
    out = []
    for s, known in (("v", "true"), ("w", "false"), ("z", "false")):
        for k, op in ops.items():
            hit = f"exists (select 1 from {s} where k {op} x)"
            miss = f"exists (select 1 from {s} where not (k {op} x))"
            some = f"exists (select 1 from {s})"
            out.append(f"case when {hit} then true when not {some} then false when k is null or {known} then null else false end as {s}_any_{k}")
            out.append(f"case when {miss} then false when not {some} then true when k is null or {known} then null else true end as {s}_all_{k}")
    return f"""with v as (select nullif(n_nationkey, 4) as x from nation where n_nationkey in (3, 4, 9)), w as (select n_nationkey as x from nation where n_regionkey = 2), z as (select n_nationkey as x from nation where n_regionkey = 77)
select c_custkey, {", ".join(out)} from (select c_custkey, nullif(c_nationkey, 12) as k from customer)"""


@query(quantified_sql())
def subquery_quantified(t: Tables) -> DataFrame:
    """Every row with key op ANY and ALL of a subquery with a null, one without, and an empty one."""
    n = t.nation
    sets = {"v": n.where("n_nationkey in (3, 4, 9)").select(F.nullif("n_nationkey", F.lit(4))), "w": n.where("n_regionkey = 2").select("n_nationkey"), "z": n.where("n_regionkey = 77").select("n_nationkey")}
    out, names = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(12)).alias("k")), []
    for s, values in sets.items():
        for k, op in {"eq": "=", "ne": "<>", "lt": "<", "ge": ">="}.items():
            names += [f"{s}_any_{k}", f"{s}_all_{k}"]
            out = R.all_of(R.any_of(out, F.col("k"), op, values, names[-2]), F.col("k"), op, values, names[-1])
    return out.select("c_custkey", *names)


@query("select count(*) as n from customer where not c_nationkey = any (select n_nationkey from nation where n_regionkey = 1)")
def subquery_not_any(t: Tables) -> DataFrame:
    told = R.any_of(t.customer, F.col("c_nationkey"), "=", t.nation.where("n_regionkey = 1").select("n_nationkey"), "hit")
    return told.where(~F.col("hit")).agg(F.count("*").alias("n"))


@query("""select 'known' as vs, c_custkey, k from (select c_custkey, nullif(c_nationkey, 12) as k from customer) where k not in (select s_nationkey from supplier where s_acctbal > 8000)
union all select 'null', c_custkey, k from (select c_custkey, nullif(c_nationkey, 12) as k from customer) where k not in (select nullif(s_nationkey, 3) from supplier)
union all select 'empty', c_custkey, k from (select c_custkey, nullif(c_nationkey, 12) as k from customer) where k not in (select s_nationkey from supplier where s_acctbal > 1e9)""")
def subquery_not_in(t: Tables) -> DataFrame:
    """NOT IN of values without a null, with one, and of none; some keys are null."""
    rows, s = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(12)).alias("k")), t.supplier
    sets = {"known": s.where("s_acctbal > 8000").select("s_nationkey"), "null": s.select(F.nullif("s_nationkey", F.lit(3))), "empty": s.where("s_acctbal > 1e9").select("s_nationkey")}
    return R.union(*[R.not_in(rows, "k", v).select(F.lit(k).alias("vs"), "c_custkey", "k") for k, v in sets.items()])


@query("""select c_custkey, unnest(case when c_nationkey % 3 > 0 then range(c_nationkey % 4) end) as i, unnest(case when c_nationkey % 5 > 0 then string_split(c_mktsegment, 'I') end) as part from customer""")
def table_sets_with_nulls(t: Tables) -> DataFrame:
    """Two sets in lock-step, either of which may be null, empty or the shorter one."""
    i = F.when(F.col("c_nationkey") % 3 > 0, F.filter(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda x: x < F.col("c_nationkey") % 4))
    return R.project_set(t.customer, ["c_custkey"], i=i, part=F.when(F.col("c_nationkey") % 5 > 0, F.split("c_mktsegment", "I")))


@query("""with b as (select nullif(event_type, (select min(event_type) from events)) as k, time_bucket(interval '1 hour', ts, timestamp '2024-01-01') as bucket, count(*) as n, min(case when value > 99 then value end) as top from events where value > 95 group by 1, 2),
e as (select k, unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) as bucket from b group by k)
select e.k, e.bucket, case when b.bucket is null then 0 else n end as n, case when b.bucket is null then -1 else top end as top from e left join b on b.k is not distinct from e.k and b.bucket = e.bucket""")
def time_gap_fill_nulls(t: Tables) -> DataFrame:
    """A group of null keys, and nulls in buckets that were there."""
    least = t.events.agg(F.min("event_type").alias("least"))
    rows = t.events.where("value > 95").crossJoin(F.broadcast(least)).withColumn("k", F.nullif("event_type", F.col("least")))  # one row
    bins = TS.binned(rows, "ts", "1 hour", ["k"], F.count("*").alias("n"), F.min(F.when(F.col("value") > 99, F.col("value"))).alias("top"), origin="2024-01-01 00:00:00")
    return TS.fill_gaps(bins, ["k"], "1 hour", {"n": 0, "top": -1.0})


@query("select p_partkey, p_name, p_size, cast(null as date) as added, p_comment from (select p_partkey, p_name, p_size, case when p_partkey % 3 = 0 then '' else p_type end as p_comment from part)")
def copy_csv_by_header(t: Tables) -> DataFrame:
    """The file's columns stand in another order, one is not asked for, one that is asked for is not there."""
    path = scratch(t.spark, "csv")
    t.part.select("p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_comment"), "p_brand", "p_name", "p_partkey").write.mode("overwrite").option("header", True).csv(path)
    return files.copy_from(t.spark, path, "p_partkey bigint, p_name string, p_size int, added date, p_comment string", "csv")


text("table_sample", "select count(*) as n from orders tablesample (100 percent)", "select count(*) as n from orders tablesample 100%", tables=("orders",))


@query("select e.event_id, (cast(split_part(ip, '.', 2) as int) // 64) = 1 as narrow, true as wide, cast(null as boolean) as unknown from (select event_id, '10.' || event_id % 256 || '.1.2' as ip from events) e")
def filter_network(t: Tables) -> DataFrame:
    ip = F.concat(F.lit("10."), F.col("event_id") % 256, F.lit(".1.2"))
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("event_id") % 65536)))
    return t.events.select("event_id", network.in_network(ip, F.lit("10.64.0.0/10")).alias("narrow"), network.in_network(six, F.lit("2001:db8::/32")).alias("wide"), network.in_network(F.lit(None).cast("string"), F.lit("10.0.0.0/8")).alias("unknown"))


# aggregates


@query("select l_returnflag, cast(round(sum(cast(l_extendedprice as decimal(18, 4))), 2) as double) as total from lineitem group by l_returnflag")
def agg_sum_stable(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(A.sum_stable(F.col("l_extendedprice")), 2).alias("total"))


@query("""select o_orderstatus, cast(m // n as bigint) as months, cast(floor(c / n + (m - m // n * n) / n * 30 * 86400000000) as bigint) as micros
from (select o_orderstatus, sum(o_orderkey % 12) as m, sum(o_custkey * 1000) as c, count(*) as n from orders group by o_orderstatus)""")
def agg_avg_intervals(t: Tables) -> DataFrame:
    one = F.struct((F.col("o_orderkey") % 12).alias("months"), (F.col("o_custkey") * 1000).alias("micros"))
    return t.orders.groupBy("o_orderstatus").agg(A.avg_intervals(one).alias("s")).select("o_orderstatus", "s.months", "s.micros")


@query("select c_mktsegment, round(avg(x), 6) as a, min(n) as n from (select c_mktsegment, cast(x as double) as x, count(*) over (partition by c_mktsegment) as n from (select distinct c_mktsegment, cast(c_acctbal as decimal(12, 2)) as x from customer)) group by c_mktsegment")
def agg_collection_numeric(t: Tables) -> DataFrame:
    kinds = F.collect_set(F.col("c_acctbal").cast("decimal(12,2)"))
    return t.customer.groupBy("c_mktsegment").agg(F.round(arrays.avg_numeric(kinds).cast("double"), 6).alias("a"), arrays.count(kinds).alias("n"))


@query("select l_returnflag, true as close from lineitem group by l_returnflag")
def agg_hyperloglog_error(t: Tables) -> DataFrame:
    """The sketch against the exact count: within 4 standard errors of its precision."""
    sketched = t.lineitem.groupBy("l_returnflag").agg(A.hyperloglog_distinct(F.col("l_partkey")).alias("a"))
    exact = t.lineitem.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("n"))  # apart: beside a distinct count Spark would keep and send one sketch a value
    got = sketched.unionByName(exact, allowMissingColumns=True).groupBy("l_returnflag").agg(F.max("a").alias("a"), F.max("n").alias("n"))
    return got.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * 4 * 1.04 / 128).alias("close"))


@query("select l_returnflag, true as close from lineitem group by l_returnflag")
def agg_percentile_sketch_error(t: Tables) -> DataFrame:
    """The share of values at or below the sketch's answer is the one asked for, to twice its accuracy and one value."""
    sketch = t.lineitem.groupBy("l_returnflag").agg(A.percentile_sketch(F.col("l_extendedprice"), 0.95).alias("p"), F.count("l_extendedprice").alias("n"))
    below = t.lineitem.join(sketch, "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("p")).cast("double")).alias("share"), F.max("n").alias("n"))
    return below.select("l_returnflag", (F.abs(F.col("share") - 0.95) <= 2e-4 + 1 / F.col("n")).alias("close"))


@query("select max(n) as most from (select count(*) as n from lineitem group by l_suppkey)")
def agg_topk_sketch_first(t: Tables) -> DataFrame:
    """The first item's count is exact where values are dealt to as many sketches as take them all."""
    return A.top_sketched(t.lineitem, "l_suppkey", 1).agg(F.max("count").alias("most"))


@query("select event_type, cast(least(count(*), 50) as bigint) as n, min(ts) as first_ts, max(ts) as last_ts from events group by event_type")
def agg_lttb_shape(t: Tables) -> DataFrame:
    """How many points are kept, and that both ends are."""
    kept = A.lttb(t.events, ["event_type"], "ts", "value", 50)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("select c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 4) as spread from customer group by c_mktsegment")
def udf_aggregate(t: Tables) -> DataFrame:
    """A user's aggregate in Python."""

    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    name = unique("spread")
    sql.create_aggregate(t.spark, name, spread, "double")
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.call_function(name, F.col("c_acctbal")), 4).alias("spread"))


@query("select n_name, unnest(generate_series(1, n_regionkey)) as k from nation")
def udf_table(t: Tables) -> DataFrame:
    """A user's table function in Python, joined laterally."""

    class Upto:
        def eval(self, n: int):
            for k in range(1, n + 1):
                yield (k,)

    name = unique("upto")
    sql.create_table_function(t.spark, name, Upto, "k bigint")
    t.nation.createOrReplaceTempView(f"{name}_nation")
    return t.spark.sql(f"select n_name, k from {name}_nation, lateral {name}(cast(n_regionkey as int))")


# scalars


@query("select o_orderkey, trim(printf('%.2f', o_totalprice)) as price, lpad(cast(o_custkey as varchar), 8, '0') as padded from orders")
def string_to_char_number(t: Tables) -> DataFrame:
    price = F.trim(strings.to_char_number(F.round(F.col("o_totalprice").cast("decimal(14,2)"), 2), "99999999990D99"))
    return t.orders.select("o_orderkey", price.alias("price"), strings.to_char_number(F.col("o_custkey").cast("decimal(8,0)"), "00000000").alias("padded"))


@query("""select event_id, lpad(cast(event_id % 40 // 12 as varchar), 4, '0') || '-' || lpad(cast(event_id % 40 % 12 as varchar), 2, '0') || ' ' || lpad(cast(s // 86400 as varchar), 2, '0') || ' ' || lpad(cast(s // 3600 % 24 as varchar), 2, '0') || ':' || lpad(cast(s // 60 % 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as x
from (select event_id, event_id * 7919 % 2500000 as s from events)""")
def string_to_char_interval(t: Tables) -> DataFrame:
    months, micros = F.col("event_id") % 40, F.col("event_id") * 7919 % 2_500_000 * 1_000_000
    return t.events.select("event_id", strings.to_char_interval(months, micros, "YYYY-MM DD HH24:MI:SS").alias("x"))


@query("select doc_id, ltrim(text, 'aeiou') as l, rtrim(text, 'aeiou.') as r, length(text) as n from documents")
def string_trim_sides(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", strings.trim(x, "aeiou", "LEADING").alias("l"), strings.trim(x, "aeiou.", "TRAILING").alias("r"), F.char_length(x).cast("long").alias("n"))


@query("select doc_id, regexp_replace(text, 'A|b', '#', 'gi') as i, regexp_replace(text, '^.', '#', 'g') as first_line, len(regexp_extract_all(lower(text), 'th')) as n from documents")
def string_regexp_flags(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", strings.regexp_replace(x, "A|b", "#", "gi").alias("i"), strings.regexp_replace(x, "^[^\\n]", "#", "g").alias("first_line"), strings.regexp_count(x, "TH", flags="i").cast("long").alias("n"))


@query("""select s_suppkey, s_suppkey % 10 between 1 and 3 and s_nationkey between 1 and 20 as meets, s_suppkey % 10 between 1 and 3 and s_nationkey between 1 and 20 as inside, not (s_suppkey % 10 between 1 and 3 and s_nationkey between 1 and 20) as apart from supplier""")
def geo_match(t: Tables) -> DataFrame:
    box = F.lit("POLYGON ((1 1, 3 1, 3 20, 1 20, 1 1))")
    p = F.concat(F.lit("POINT ("), F.col("s_suppkey") % 10, F.lit(" "), F.col("s_nationkey"), F.lit(")"))
    return t.supplier.select("s_suppkey", geo.match(p, box).alias("meets"), geo.match(p, box, "within").alias("inside"), geo.match(p, box, "disjoint").alias("apart"))


@query("""select s_suppkey, x <= 3 and x + 2 >= 1 and y <= 6 and y + 3 >= 2 as meets, x >= 1 and x + 2 <= 3 and y >= 2 and y + 3 <= 6 as inside from (select s_suppkey, s_suppkey % 7 - 2 as x, s_nationkey % 11 - 2 as y from supplier)""")
def geo_boxes(t: Tables) -> DataFrame:
    """Boxes against a box: where they meet, and which lie inside."""
    x, y = F.col("s_suppkey") % 7 - 2, F.col("s_nationkey") % 11 - 2
    corners = [(x, y), (x + 2, y), (x + 2, y + 3), (x, y + 3), (x, y)]
    shape = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners]), F.lit("))"))
    box = F.lit("POLYGON ((1 2, 3 2, 3 6, 1 6, 1 2))")
    return t.supplier.select("s_suppkey", geo.intersects(shape, box).alias("meets"), geo.within(shape, box).alias("inside"))


# full text

WORDS_OF = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def scored_sql(kind: str) -> str:
    """BM25 of 'large gear' over p_name (boost 2) and p_type by counting words."""
    base = f"""with d as (select p_partkey, {WORDS_OF.format("p_name")} as a, {WORDS_OF.format("p_type")} as b from part),
c as (select p_partkey, len(a) as la, len(b) as lb, {", ".join(f"len(list_filter({f}, lambda x: x = '{w}')) as {f}{i}" for f in "ab" for i, w in enumerate(("large", "gear")))} from d),
g as (select count(*) as n, avg(la) as ava, avg(lb) as avb, {", ".join(f"count(*) filter ({f}{i} > 0) as d{f}{i}" for f in "ab" for i in (0, 1))} from c),
s as (select p_partkey, a0, a1, b0, b1, {", ".join(f"ln(1 + (g.n - d{f}{i} + 0.5) / (d{f}{i} + 0.5)) * {f}{i} / ({f}{i} + 1.2 * (0.25 + 0.75 * l{f} / av{f})) as s{f}{i}" for f in "ab" for i in (0, 1))} from c, g)"""
    total = {
        "best": "select p_partkey, greatest(2 * (sa0 + sa1), sb0 + sb1) + 0.3 * least(2 * (sa0 + sa1), sb0 + sb1) as score from s",
        "most": "select p_partkey, case when (a0 > 0)::int + (a1 > 0)::int >= 2 then 2 * (sa0 + sa1) else 0 end + case when (b0 > 0)::int + (b1 > 0)::int >= 2 then sb0 + sb1 else 0 end as score from s",
        "cross": "select p_partkey, case when (a0 > 0 or b0 > 0) and (a1 > 0 or b1 > 0) then greatest(2 * sa0, sb0) + greatest(2 * sa1, sb1) else 0 end as score from s",
    }[kind]
    return f"{base} select p_partkey, round(score, 6) as score from ({total}) where score > 0"


@query(scored_sql("best"))
def match_best_fields(t: Tables) -> DataFrame:
    got = T.search_fields(t.part, {"p_name": 2.0, "p_type": 1.0}, "large gear", tie_breaker=0.3)
    return got.select("p_partkey", F.round("_score", 6).alias("score"))


@query(scored_sql("most"))
def match_most_fields(t: Tables) -> DataFrame:
    got = T.search_fields(t.part, {"p_name": 2.0, "p_type": 1.0}, "large gear", kind="most_fields", minimum_should_match=2)
    return got.select("p_partkey", F.round("_score", 6).alias("score"))


@query(scored_sql("cross"))
def match_cross_fields(t: Tables) -> DataFrame:
    got = T.search_fields(t.part, {"p_name": 2.0, "p_type": 1.0}, "large gear", kind="cross_fields", operator="and", keep=["p_partkey"])
    return got.select("p_partkey", F.round("_score", 6).alias("score"))


@query("select p_partkey, cast(1 as double) as score from part")
def match_no_terms(t: Tables) -> DataFrame:
    return T.search_fields(t.part, {"p_name": 1.0}, "--", zero_terms="all").select("p_partkey", F.col("_score").alias("score"))


@query(f"""select p_partkey, list_filter(regexp_split_to_array(x, '\\P{{L}}+'), lambda w: w <> '') as letter, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') as whitespace, [x] as keyword,
list_filter(regexp_split_to_array(x, '[#0-9]+'), lambda w: w <> '') as pattern, regexp_extract_all(x, '[a-z]{{3}}') as simple, list_filter(regexp_split_to_array(x, '[ #]+'), lambda w: w <> '') as grouped, {WORDS_OF.format("x")} as standard
from (select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as x from part)""")
def match_tokenizers(t: Tables) -> DataFrame:
    x = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    steps = {"letter": An.letter(), "whitespace": An.whitespace(), "keyword": An.keyword(), "pattern": An.pattern("[#0-9]+"), "simple": An.simple_pattern("[a-z]{3}"), "grouped": An.char_group(" #")}
    chain = An.Chain(filters=[An.lowercase()])
    return t.part.select("p_partkey", *[s(x).alias(k) for k, s in steps.items()], chain.tokens(x).alias("standard"))


TYPE_WORDS = "string_split(upper(p_name), ' ')"


@query(f"""select p_partkey, list_transform({TYPE_WORDS}, lambda w: lower(w)) as low, list_transform({TYPE_WORDS}, lambda w: upper(w)) as up, list_transform({TYPE_WORDS}, lambda w: reverse(w)) as rev, list_transform({TYPE_WORDS}, lambda w: w[:4]) as cut,
list_filter({TYPE_WORDS}, lambda w: length(w) between 4 and 5) as sized, {TYPE_WORDS}[1:2] as two, list_transform({TYPE_WORDS}, lambda w: regexp_replace(w, '[AEIOU]', '_', 'g')) as replaced, list_filter({TYPE_WORDS}, lambda w: w not in ('GEAR', 'LARGE')) as stopped,
flatten(list_transform({TYPE_WORDS}, lambda w: [w[1:1], w[1:2]])) as edges, list_transform(regexp_split_to_array(upper(p_name), '[AE]'), lambda w: trim(w)) as trimmed from part""")
def match_filters(t: Tables) -> DataFrame:
    a = F.split(F.upper("p_name"), " ")
    steps = {"low": An.lowercase(), "up": An.uppercase(), "rev": An.reverse(), "cut": An.truncate(4), "sized": An.length(4, 5), "two": An.limit(2), "replaced": An.token_pattern_replace("[AEIOU]", "_"), "stopped": An.stop(["GEAR", "LARGE"]), "edges": An.edge_ngram(1, 2)}
    trimmed = An.trim()(F.split(F.upper("p_name"), "[AE]"))
    return t.part.select("p_partkey", *[s(a).alias(k) for k, s in steps.items()], trimmed.alias("trimmed"))


@query("select p_partkey, replace(replace(p_type, 'LARGE', 'big'), 'O', '_') as mapped, regexp_replace(p_type, '[AEIOU]', '', 'g') as bare, p_name as stripped from part")
def match_char_filters(t: Tables) -> DataFrame:
    x = F.col("p_type")
    html = F.trim(An.html_strip()(F.concat(F.lit("<p class='x'>"), "p_name", F.lit("</p>"))))
    return t.part.select("p_partkey", An.mapping({"LARGE": "big", "O": "_"})(x).alias("mapped"), An.pattern_replace("[AEIOU]", "")(x).alias("bare"), html.alias("stripped"))


def stems_sql() -> str:
    """Endings taken off by one expression for each language: the shortest beginning of three letters or more leaves the longest ending."""
    words = "select lower(w) as w, count(*) as n from (select unnest(string_split(p_name || ' ' || p_type, ' ')) as w from part) group by 1"
    one = "select '{0}' as language, case when regexp_matches(w, '{1}') then regexp_extract(w, '{1}', 1) else w end as stem, n from words"
    return f"with words as ({words}) select language, stem, cast(sum(n) as bigint) as n from (" + " union all ".join(one.format(k, f"^(.{{3,}}?)(?:{'|'.join(v)})$") for k, v in An.ENDINGS.items()) + ") group by 1, 2"


@query(stems_sql())
def match_languages(t: Tables) -> DataFrame:
    """Stems by the light rules of every language."""
    words = t.part.select(F.explode(An.ANALYZERS["standard"].tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(k).alias("language"), F.get(An.strip_endings(k)(F.array("w")), F.lit(0)).alias("stem")) for k in An.ENDINGS])
    return words.select("n", F.inline(each)).groupBy("language", "stem").agg(F.sum("n").alias("n"))


GROWN = ["", "s", "sses", "ies", "eed", "ed", "ing", "y", "e", "ll", "ational", "tional", "enci", "izer", "bli", "alli", "ousli", "ization", "ator", "alism", "iveness", "fulness", "aliti", "biliti", "logi", "icate", "ative", "ical", "ness", "ance", "able", "ement", "sion", "ion", "ous", "ize"]


def porter_sql() -> str:
    """Step by step, the measure counted in a text of letter kinds."""

    def m(s: str) -> str:
        return f"len(regexp_extract_all(regexp_replace(regexp_replace({s}, '[aeiouy]+', '#', 'g'), '[^#]+', 'c', 'g'), '#c'))"

    def short(s: str) -> str:
        return f"regexp_matches({s}, '[^aeiouy][aeiouy][^aeiouywxY]$')"

    def step(name: str, before: str, ends: str, then: str) -> str:
        cut = f"'^(.*?)({ends})$'"
        return f"{name} as (select w, case when e = '' then x {then} else x end as x from (select w, x, regexp_extract(x, {cut}, 1) as s, regexp_extract(x, {cut}, 2) as e from {before}))"

    def change(pairs: str) -> tuple[str, str]:
        table = [(a, b) for a, _, b in (x.partition(">") for x in pairs.split())]
        whens = " ".join(f"when '{a}' then '{b}'" for a, b in table)
        return "|".join(a for a, _ in table), f"when {m('s')} > 0 then s || case e {whens} end"

    second = change("ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log")
    third = change("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>")
    parts = [
        f"w as (select distinct b || e as w from (select lower(unnest(string_split(p_name, ' '))) as b from part), (select unnest({GROWN}) as e))",
        "x as (select w, regexp_replace(w, '(^|[aeiouy])y', '\\1Y', 'g') as x from w)",
        step("a", "x", "sses|ies|ss|s", "when e = 'sses' then s || 'ss' when e = 'ies' then s || 'i' when e = 's' then s"),
        step("b", "a", "eed|ed|ing", f"""when e = 'eed' then case when {m("s")} > 0 then s || 'ee' else x end when regexp_matches(s, '[aeiouy]') then case when right(s, 2) in ('at', 'bl', 'iz') then s || 'e'
when length(s) > 1 and right(s, 1) = left(right(s, 2), 1) and regexp_matches(s, '[^aeiouy]$') then case when right(s, 1) in ('l', 's', 'z') then s else left(s, length(s) - 1) end when {m("s")} = 1 and {short("s")} then s || 'e' else s end"""),
        step("c", "b", "y|Y", "when regexp_matches(s, '[aeiouy]') then s || 'i'"),
        step("d", "c", *second),
        step("f", "d", *third),
        step("g", "f", "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize", f"when {m('s')} > 1 and (e <> 'ion' or right(s, 1) in ('s', 't')) then s"),
        step("h", "g", "e", f"when {m('s')} > 1 or ({m('s')} = 1 and not {short('s')}) then s"),
        step("i", "h", "l", f"when right(s, 1) = 'l' and {m('x')} > 1 then s"),
    ]
    return "with " + ", ".join(parts) + " select w, case when length(w) < 3 then w else replace(x, 'Y', 'y') end as stem from i"


@query(porter_sql())
def match_porter(t: Tables) -> DataFrame:
    """Stems of all words of the parts' names, each with many endings."""
    bases = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("b")).distinct()
    grown = bases.select(F.explode(F.transform(F.array(*[F.lit(e) for e in GROWN]), lambda e: F.concat("b", e))).alias("w")).distinct()
    return grown.select("w", stemming.porter_stem(F.col("w")).alias("stem"))


# forms over whole tables whose small relations of values stand elsewhere


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') || ' ' || upper(p_type[1:1]) || lower(p_type[2:]) as s from part")
def string_initcap_columns(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", strings.initcap(F.concat_ws(" ", "p_name", "p_type")).alias("s"))


@query("""select n_nationkey, ['schema_' || n_regionkey, n_name || ' "x"', lower(n_name) || '_' || n_nationkey] as parts from nation""")
def string_parse_ident_columns(t: Tables) -> DataFrame:
    s = F.concat(F.lit("Schema_"), F.col("n_regionkey"), F.lit(' . "'), "n_name", F.lit(' ""x""".'), F.translate("n_name", " ", "_"), F.lit("_"), F.col("n_nationkey"))
    return t.nation.select("n_nationkey", network.parse_ident(s).alias("parts"))


@query("""select p_partkey, list_sort(list_distinct(list_filter(list_concat(a, b), lambda x: x is not null))) as un, list_filter(a, lambda x: x is null or not list_contains(b, x)) as di, list_has_any(list_filter(a, lambda x: x is not null), b) as ov
from (select p_partkey, [p_size % 3, p_size % 5, p_size % 3, nullif(p_size % 4, 0)] as a, [p_partkey % 3, p_partkey % 7] as b from part)""")
def array_sets_columns(t: Tables) -> DataFrame:
    n = F.col("p_size")
    a, b = F.array((n % 3).cast("long"), (n % 5).cast("long"), (n % 3).cast("long"), F.nullif(n % 4, F.lit(0)).cast("long")), F.array(F.col("p_partkey") % 3, F.col("p_partkey") % 7)
    known = F.array_sort(F.filter(arrays.unique(a, b), lambda x: x.isNotNull()))
    return t.part.select("p_partkey", known.alias("un"), arrays.difference(a, b).alias("di"), arrays.overlap(a, b).alias("ov"))


@query("select event_id, ['k', 'e', 'z'] as ks, [user_id, event_id * 2, user_id % 7] as vs from events")
def object_merge_columns(t: Tables) -> DataFrame:
    a = F.create_map(F.lit("k"), F.col("user_id"), F.lit("e"), F.col("event_id"))
    b = F.create_map(F.lit("e"), F.col("event_id") * 2, F.lit("z"), F.col("user_id") % 7)
    rows = t.events.select("event_id", objects.merge(a, b).alias("m"))
    return rows.select("event_id", F.map_keys("m").alias("ks"), F.map_values("m").alias("vs"))


@query("""with p as (select s_suppkey, s_suppkey * 37 % 360 - 180 + 0.25 as lon, s_nationkey * 7 % 180 - 90 + 0.125 as lat from supplier),
b as (select s_suppkey, cast(floor((lon + 180) / 360 * 32768) as bigint) as x, cast(floor((lat + 90) / 180 * 32768) as bigint) as y from p),
d as (select s_suppkey, list_transform(range(30), lambda i: case when i % 2 = 0 then (x >> cast(14 - i // 2 as bigint)) & 1 else (y >> cast(14 - i // 2 as bigint)) & 1 end) as bits from b)
select s_suppkey, array_to_string(list_transform(range(6), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', cast(1 + 16 * bits[5 * c + 1] + 8 * bits[5 * c + 2] + 4 * bits[5 * c + 3] + 2 * bits[5 * c + 4] + bits[5 * c + 5] as bigint), 1)), '') as hash from d""")
def geo_hash_columns(t: Tables) -> DataFrame:
    p = geo.point(F.col("s_suppkey") * 37 % 360 - 180 + F.lit(0.25), F.col("s_nationkey") * 7 % 180 - 90 + F.lit(0.125))
    return t.supplier.select("s_suppkey", geo.geohash(p, 6).alias("hash"))


@query("select s_suppkey, round(pow(6371.0087714, 2) * radians(1 + s_suppkey % 5) * (sin(radians(s_nationkey + 2)) - sin(radians(s_nationkey))), 3) as km2 from supplier")
def geo_area_columns(t: Tables) -> DataFrame:
    lon, lat = 1 + F.col("s_suppkey") % 5, F.col("s_nationkey")
    ring = [(F.lit(0), lat), (lon, lat), (lon, lat + 2), (F.lit(0), lat + 2), (F.lit(0), lat)]
    shape = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in ring]), F.lit("))"))
    return t.supplier.select("s_suppkey", F.round(geo.area(shape) / 1e6, 3).alias("km2"))


@query("""select o_orderkey, cast(date_part('year', a) as int) as years, cast(date_part('month', a) as int) as months from (select o_orderkey, age(timestamp '2001-01-01', date_trunc('month', o_orderdate)) as a from orders)""")
def time_age_columns(t: Tables) -> DataFrame:
    a = times.age(F.lit("2001-01-01").cast("timestamp_ntz"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return t.orders.select("o_orderkey", a.alias("a")).select("o_orderkey", "a.years", "a.months")


# sources


@query("select c_custkey, c_name || ',{},\"' as label, c_acctbal, nullif(c_nationkey, 3) as k from customer")
def copy_json_array(t: Tables) -> DataFrame:
    """COPY TO with arrays of values, read back by position; texts hold what looks like JSON."""
    rows = t.customer.select("c_custkey", F.concat("c_name", F.lit(',{},"')).alias("label"), "c_acctbal", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    path = scratch(t.spark, "copy")
    files.copy_to(rows, path, "json_array")
    kinds = dict(rows.dtypes)
    back = t.spark.read.text(path).select(F.from_json("value", "array<string>").alias("v"))
    return back.select(*[F.get("v", F.lit(i)).cast(kinds[c]).alias(c) for i, c in enumerate(rows.columns)])


@query("select p_partkey, p_name from part")
def copy_skip_lines(t: Tables) -> DataFrame:
    """COPY FROM of CSV files that have two lines of notes and a header each."""
    path = scratch(t.spark, "copy")

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": ["a note", "another, longer", "p_partkey,p_name"]})
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": [f"{k},{v}" for k, v in zip(*(b.column(i).to_pylist() for i in (0, 1)))]})

    t.part.select("p_partkey", "p_name").repartition(3).mapInArrow(headed, "value string").write.text(path)
    return files.copy_from(t.spark, path, "p_partkey bigint, p_name string", "csv", skip=2)


@query("select cast(count(*) filter (c_custkey % 10 <> 0) as bigint) as good, cast(count(*) filter (c_custkey % 10 = 0) as bigint) as bad from customer")
def copy_summary(t: Tables) -> DataFrame:
    """COPY FROM .. RETURN SUMMARY over files in which every tenth line is broken."""
    path = scratch(t.spark, "copy")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    t.customer.select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("{broken"), line)).otherwise(line).alias("value")).repartition(4).write.text(path)
    got = files.copy_summary(t.spark, path, "c_custkey bigint, c_name string", "json")
    return got.agg(F.sum("success_count").alias("good"), F.sum("error_count").alias("bad"))


@query("select cast(count(*) as bigint) as n, cast(count(distinct html) filter (html <> '') as bigint) as different from pages")
def copy_blobs(t: Tables) -> DataFrame:
    """A file for each page's bytes, read back by digest; the digest is that of the page."""
    path = scratch(t.spark, "blobs")
    store = t.pages.select(F.coalesce("html", F.lit("")).alias("html"), F.col("page_id"))

    def put(batches):
        for b in batches:
            from pyarrow import fs

            place, base = fs.FileSystem.from_uri(path)
            place.create_dir(base, recursive=True)
            for html, page in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                with place.open_output_stream(f"{base}/{page}.blob") as f:
                    f.write(html.encode())
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    wrote = store.mapInArrow(put, "n long").agg(F.sum("n").alias("n")).first().n
    if not wrote:
        return t.spark.sql("select 0L as n, 0L as different")
    blobs = files.read_blobs(t.spark, path)
    same = blobs.join(store.select(F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("length")).distinct(), ["digest", "length"], "left_semi")
    return same.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("length") > 0, F.col("digest"))).alias("different"))


@query("select n_nationkey, n_name from nation where n_nationkey > 3")
def foreign_jdbc(t: Tables) -> DataFrame:
    """A foreign table over JDBC, in a database that driver and executors open; the filter is the server's work."""
    f = Foreign()
    f.create_server("s", shared_database(t.nation.select("n_nationkey", "n_name"), "nation"))
    f.create_table("t", "s", "nation")
    got = f.read(t.spark, "t")
    return got.where(F.col(got.columns[0]) > 3).toDF("n_nationkey", "n_name")


# definitions of tables and changes to them


@query("select p_partkey, p_retailprice as price, p_retailprice * 2 as twice, 'none' as note, p_size as size from part")
def ddl_definition(t: Tables) -> DataFrame:
    """Keys, NOT NULL, CHECK, DEFAULT, generated columns, and ALTERs: a column added, one renamed, one dropped, a default set,
    a check dropped; then CREATE TABLE LIKE takes it all over."""
    s = schema.Table([schema.Column("p_partkey", "bigint"), schema.Column("cost", "double", not_null=True), schema.Column("twice", "double", generated="price * 2"), schema.Column("gone", "int")], key=["p_partkey"], checks={"cheap": "price < 0", "some": "price > 0"})
    s.add_column(schema.Column("note", "string"))
    s.set_default("note", "'none'")
    s.drop_column("gone")
    s.rename_column("cost", "price")
    s.drop_check("cheap")
    like = s.like()
    return like.conform(t.part.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")))


@query("select k, n from (values ('constraint p check (price > 0)', 1), ('primary key (id)', 1), ('default 5', 1), ('column_policy = ''strict''', 1)) as v(k, n)")
def ddl_show_create(t: Tables) -> DataFrame:
    s = schema.Table([schema.Column("id", "int"), schema.Column("price", "double", default="5")], key=["id"], checks={"p": "price > 0"}, policy=schema.STRICT)
    shown = s.show_create("x")
    want = ["constraint p check (price > 0)", "primary key (id)", "default 5", "column_policy = 'strict'"]
    return t.spark.createDataFrame([(w, shown.count(w)) for w in want], "k string, n int")


@query("select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus <> 'P'")
def ddl_partitions(t: Tables) -> DataFrame:
    """CREATE TABLE AS, partitioned; DELETE of a partition; OPTIMIZE; REFRESH."""
    name, path = unique("parts"), scratch(t.spark, "table")
    dml.create_table_as(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), name, partition_by=["o_orderstatus"], path=path)
    dml.delete_partitions(t.spark, path, "o_orderstatus", ["P"])
    rows = t.spark.read.parquet(path)
    dml.replace_table(rows.repartition(2), path, ["o_orderstatus"])
    statements.drop_table(t.spark, name)
    return t.spark.read.parquet(path)


@query("select 'a' as label, n_nationkey as k from nation union all select 'b', r_regionkey from region")
def ddl_swap(t: Tables) -> DataFrame:
    """SWAP TABLE, then RENAME."""
    a, b = unique("a"), unique("b")
    dml.create_table_as(t.region.select(F.col("r_regionkey").alias("k")), a, path=scratch(t.spark, "table"))
    dml.create_table_as(t.nation.select(F.col("n_nationkey").alias("k")), b, path=scratch(t.spark, "table"))
    dml.swap_tables(t.spark, a, b)
    statements.rename_table(t.spark, a, f"{a}_new")
    return t.spark.table(f"{a}_new").select(F.lit("a").alias("label"), "k").union(t.spark.table(b).select(F.lit("b"), "k"))


@query("select cast(n_nationkey as bigint) as k, n_name as v from nation union all select r_regionkey + 100, r_name from region")
def dml_insert_subquery(t: Tables) -> DataFrame:
    """CREATE SCHEMA, CREATE TABLE AS in it, INSERT from a query, inside statements of a transaction that change nothing."""
    db, path = unique("db"), scratch(t.spark, "schema")
    statements.create_schema(t.spark, db, path)
    statements.transaction("begin")
    dml.create_table_as(t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")), f"{db}.t")
    t.region.createOrReplaceTempView(f"{db}_region")
    t.spark.sql(f"insert into {db}.t select r_regionkey + 100, r_name from {db}_region")
    statements.transaction("commit")
    statements.refresh(t.spark, f"{db}.t")
    return t.spark.table(f"{db}.t")


@query("select s_suppkey, case when s_suppkey in (1, 5) then 0 else s_acctbal end as s_acctbal from supplier where s_suppkey not in (2, 7)")
def dml_by_key(t: Tables) -> DataFrame:
    rows = dml.update(t.supplier, F.col("s_suppkey").isin(1, 5), {"s_acctbal": F.lit(0.0)})
    return dml.delete(rows, F.col("s_suppkey").isin(2, 7)).select("s_suppkey", "s_acctbal")


@query("select c_custkey, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end as c_acctbal from customer where c_custkey % 5 <> 0")
def dml_versions(t: Tables) -> DataFrame:
    """A table changed twice as whole versions; readers find the newest whole one."""
    root = scratch(t.spark, "versions")
    dml.put_version(t.customer.select("c_custkey", "c_acctbal"), root)
    dml.put_version(dml.update(dml.read_version(t.spark, root), F.col("c_custkey") % 3 == 0, {"c_acctbal": F.lit(0.0)}), root)
    dml.put_version(dml.delete(dml.read_version(t.spark, root), F.col("c_custkey") % 5 == 0), root)
    return dml.read_version(t.spark, root)


@query("""with r as (select n_name, row_number() over (order by n_nationkey) as k from nation) select 1 as step, n_name from r where k <= 5 union all select 2, n_name from r where k in (4, 5) union all select 3, n_name from r where k > 3""")
def cursor_fetch(t: Tables) -> DataFrame:
    """DECLARE SCROLL, FETCH forwards, backwards, to the end, CLOSE."""
    c = dml.Cursor(R.order(t.nation, "n_nationkey").select("n_name"), scroll=True)
    got = [(step, r.n_name) for step, n in ((1, 5), (2, -2), (3, 1000)) for r in c.fetch(n)]
    c.close()
    return t.spark.createDataFrame(got, "step int, n_name string")


# streams


@query("select user_id, max(event_id) as event_id, max_by(value, event_id) as value from events group by user_id")
def stream_upsert(t: Tables) -> DataFrame:
    """ON CONFLICT UPDATE over a stream of files, by partitions."""
    path = scratch(t.spark, "upserted")
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).select("user_id", "event_id", "value")
    SW.upsert(stream, path, ["user_id"], "event_id", f"{path}-checkpoint", buckets=8).awaitTermination()
    return t.spark.read.parquet(path).select("user_id", "event_id", "value")


@query("""select event_type, b as bucket, count(*) as n from (select event_type, unnest([time_bucket(interval '12 hours', ts, timestamp '2024-01-01'), time_bucket(interval '12 hours', ts, timestamp '2024-01-01') - interval '12 hours']) as b from events) group by 1, 2""")
def stream_sliding(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    out = SW.sliding(stream, "ts", "1 day", "12 hours", "1 hour", ["event_type"], F.count("*").alias("n"))
    return SW.to_files(out, scratch(t.spark, "sliding")).select("event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


@query("select event_type, count(*) as n from events group by event_type")
def stream_ingest(t: Tables) -> DataFrame:
    """COPY FROM that keeps running, over a folder of files as they were exported."""
    path = scratch(t.spark, "arrivals")
    files.copy_to(t.events.select("event_id", "event_type").repartition(3), path)
    rows = SW.ingest(t.spark, path, "event_id bigint, event_type string", "json")
    return SW.to_files(rows, scratch(t.spark, "ingested"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


# session and catalogue


@query("select column_name, cast(ordinal_position as int) as ordinal_position from information_schema.columns where table_name = 'customer'")
def catalogue_columns(t: Tables) -> DataFrame:
    t.views("customer")
    return statements.information_schema_columns(t.spark, "customer").select("column_name", "ordinal_position")


@query("select table_name from information_schema.tables where table_name in (" + ", ".join(f"'{x}'" for x in TABLES) + ")")
def catalogue_tables(t: Tables) -> DataFrame:
    t.views()
    return statements.information_schema_tables(t.spark).select("table_name").where(F.col("table_name").isin(*TABLES)).distinct()


@query("select true as known, false as unknown, true as function_known, 'CHECK (price > 0)' as checked, 'PRIMARY KEY (a, b)' as keyed, cast(null as varchar) as expr, true as may_select, true as may_use, true as may_connect, true as may_run, 'on' as was_set, true as was_reset")
def catalogue_functions(t: Tables) -> DataFrame:
    t.views("customer")
    statements.set_(t.spark, "strataflow.probe", "on")
    was = system.current_setting(t.spark, "strataflow.probe")
    statements.set_(t.spark, "strataflow.probe", None)
    gone = t.spark.conf.get("strataflow.probe", None) is None
    cols = {
        "known": system.table_is_visible(t.spark, "customer"), "unknown": system.table_is_visible(t.spark, "no_such_table"), "function_known": system.function_is_visible(t.spark, "upper"), "checked": system.constraint_definition([], "price > 0"), "keyed": system.constraint_definition(["a", "b"]),
        "expr": system.pg_get_expr(), "may_select": system.has_privilege("table", "select, insert"), "may_use": system.has_privilege("schema", "usage"), "may_connect": system.has_privilege("database", "connect"), "may_run": system.has_privilege("function", "execute"), "was_set": was, "was_reset": F.lit(gone),
    }
    return t.spark.range(1).select(*[c.alias(k) for k, c in cols.items()])


@query("select true as user_known, ['pg_catalog', 'default'] as schemas, 'spark_catalog' as catalogue, true as versioned, 'double precision' as type_name, 36 as uuid_size, true as process, true as started, true as in_day, 'Usage' as described")
def system_session(t: Tables) -> DataFrame:
    cols = {
        "user_known": system.current_user() == system.user_by_id(F.lit(10)), "schemas": system.current_schemas(True), "catalogue": system.current_database(), "versioned": system.version().rlike(r"^\d+\.\d+"), "type_name": system.format_type(F.lit(701)), "uuid_size": F.length(system.random_uuid()),
        "process": system.backend_pid(t.spark) > 0, "started": system.postmaster_start_time(t.spark) < F.current_timestamp(), "in_day": times.current_time().between(0, 86_399_999_999), "described": F.when(system.function_result(t.spark, "upper").contains("upper"), "Usage"),
    }
    return t.spark.range(1).select(*[c.alias(k) for k, c in cols.items()])


@query("select 'EXPLAIN' as statement, true as ok union all select 'ANALYZE', true union all select 'SHOW', true union all select 'CREATE ANALYZER', true")
def statement_results(t: Tables) -> DataFrame:
    """EXPLAIN [ANALYZE], ANALYZE, SHOW CREATE / COLUMNS / SCHEMAS / TABLES, CREATE and DROP ANALYZER."""
    name = unique("seen")
    dml.create_table_as(t.nation, name, path=scratch(t.spark, "table"))
    statements.analyze(t.spark, name, ["n_nationkey"])
    rows = t.spark.table(name).groupBy("n_regionkey").count()
    plan = "HashAggregate" in statements.explain(rows) and "HashAggregate" in statements.explain_analyze(rows)
    stats = t.spark.sql(f"describe extended {name} n_nationkey").where("info_name = 'distinct_count' and info_value <> 'NULL'").count() == 1
    shown = statements.show_columns(t.spark, name).count() == len(t.nation.columns) and name in statements.show_create(t.spark, name) and statements.show_schemas(t.spark).count() > 0 and statements.show_tables(t.spark).where(F.col("tableName") == name).count() == 1
    An.create_analyzer("strataflow_probe", An.Chain(filters=[An.lowercase()]))
    made = t.spark.range(1).select(An.ANALYZERS["strataflow_probe"].tokens(F.lit("A b")).alias("x")).first().x == ["a", "b"]
    An.drop_analyzer("strataflow_probe")
    statements.drop_table(t.spark, name)
    return t.spark.createDataFrame([("EXPLAIN", bool(plan)), ("ANALYZE", stats), ("SHOW", shown), ("CREATE ANALYZER", made)], "statement string, ok boolean")
