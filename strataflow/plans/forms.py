"""Further forms of predicates, joins, aggregates, functions, sources and changes, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..functions import arrays, maths, network, objects, strings, system, times
from ..operators import aggregates as A
from ..operators import analysis, dml, phonetics
from ..operators import relational as R
from ..operators import tablefuncs as TF
from ..operators import textsearch as T
from ..operators import windows as W
from ..sources import files
from ..sources.scratch import scratch
from .registry import query, text

# predicates

text("filter_any_like", "select p_partkey from part where exists(array('%a%e%', 'B%'), p -> p_name like p) and not exists(array('%#1%', '%#2%'), p -> p_brand like p)",
     "select p_partkey from part where (p_name like '%a%e%' or p_name like 'B%') and not (p_brand like '%#1%' or p_brand like '%#2%')", tables=("part",))
text("filter_all_not_like", "select p_partkey from part where forall(array('%#1%', '%#2%'), p -> p_brand not like p) and p_name not ilike 'a%'",
     "select p_partkey from part where p_brand not like '%#1%' and p_brand not like '%#2%' and p_name not ilike 'a%'", tables=("part",))
text("filter_any_unknown", "select id, exists(a, x -> x = 3) as found, forall(a, x -> x < 3) as every from (values (1, array(1, 3, null)), (2, array(1, null)), (3, array(1, 2)), (4, array()), (5, null)) as v(id, a)",
     "select * from (values (1, true, false), (2, null, null), (3, false, true), (4, false, true), (5, null, null)) as v(id, found, every)", tables=())
text("filter_kleene", "select a, b, a and b as both, a or b as either, not a as no from (values (true), (false), (cast(null as boolean))) as x(a) cross join (values (true), (false), (cast(null as boolean))) as y(b)", tables=())
text("filter_in_subquery_rows", "select o_orderkey from orders where (o_custkey, o_orderstatus) in (select c_custkey, 'F' from customer where c_nationkey = 7)", tables=("orders", "customer"))


@query("select * from (values ('192.168.0.5', true, true), ('192.169.0.5', false, true), ('10.0.0.1', false, false), (null, null, null)) as v(ip, narrow, wide)")
def filter_cidr(t: Tables) -> DataFrame:
    rows = t.spark.sql("select * from (values ('192.168.0.5'), ('192.169.0.5'), ('10.0.0.1'), (null)) as v(ip)")
    return rows.select("ip", network.in_network4(F.col("ip"), "192.168.0.0/16").alias("narrow"), network.in_network(F.col("ip"), F.lit("192.0.0.0/8")).alias("wide"))


# joins and subqueries

text("join_using", "select c_custkey, c_nationkey, n_name from customer join (select n_nationkey as c_nationkey, n_name from nation) n using (c_nationkey)", tables=("customer", "nation"))
text("join_natural", "select r_name, count(*) as n from (select n_regionkey as k, n_name from nation) a natural join (select r_regionkey as k, r_name from region) b group by r_name", tables=("nation", "region"))
text("join_using_full", "select k, a.x, b.y from (select n_nationkey as k, n_name as x from nation where n_nationkey < 10) a full join (select s_nationkey as k, count(*) as y from supplier where s_nationkey > 5 group by s_nationkey) b using (k)", tables=("nation", "supplier"))
text("join_on_expressions", "select a.o_orderkey as x, b.o_orderkey as y from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.o_orderstatus <> b.o_orderstatus and a.o_totalprice > 2 * b.o_totalprice", tables=("orders",))
text("join_outer_filtered", "select n_name, count(s_suppkey) as n from nation left join supplier on n_nationkey = s_nationkey and s_acctbal > 5000 where n_regionkey <> 2 group by n_name", tables=("nation", "supplier"))
text("subquery_lateral", "select r_name, x.n_name from region cross join lateral (select n_name from nation where n_regionkey = r_regionkey and n_nationkey > 3) x", tables=("region", "nation"))
text("subquery_exists_not_correlated", "select count(*) as n from nation where exists (select 1 from supplier where s_acctbal > 0) and not exists (select 1 from supplier where s_acctbal > 1e9)", tables=("nation", "supplier"))
text("subquery_correlated_max", "select o_orderkey, o_custkey from orders o where o_totalprice = (select max(x.o_totalprice) from orders x where x.o_custkey = o.o_custkey)", tables=("orders",))
text("subquery_in_from", "select band, count(*) as n from (select case when o_totalprice > 200000 then 'high' else 'low' end as band from orders where o_orderstatus = 'F') x group by band", tables=("orders",))


# aggregates

text("agg_group_by_all", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by all", tables=("orders",))
text("agg_expression_keys", "select o_orderkey % 7 as k, upper(o_orderstatus) as s, count(*) as n, count(distinct o_custkey) as c from orders group by o_orderkey % 7, upper(o_orderstatus) having count(*) > 3", tables=("orders",))
text("agg_min_max_text", "select c_mktsegment, min(c_name) as lo, max(c_name) as hi from customer group by c_mktsegment", tables=("customer",))
text("agg_empty_groups", "select c_mktsegment, count(*) as n from customer where c_acctbal < -1e9 group by c_mktsegment", tables=("customer",))


@query("select l_returnflag, cast(sum(cast(l_quantity as float)) as float) as q from lineitem group by l_returnflag")
def agg_sum_real(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(A.sum_real(F.col("l_quantity").cast("float")).alias("q"))


@query("select o_orderstatus, cast(sum(o_orderkey % 12) as bigint) as months, cast(sum(o_custkey * 1000) as bigint) as micros from orders group by o_orderstatus")
def agg_sum_mixed_intervals(t: Tables) -> DataFrame:
    one = F.struct((F.col("o_orderkey") % 12).alias("months"), (F.col("o_custkey") * 1000).alias("micros"))
    return t.orders.groupBy("o_orderstatus").agg(A.sum_intervals(one).alias("s")).select("o_orderstatus", "s.months", "s.micros")


@query("select c_mktsegment, count(distinct c_nationkey) as n, round(avg(distinct c_nationkey), 6) as a from customer group by c_mktsegment")
def agg_collection(t: Tables) -> DataFrame:
    kinds = F.collect_set("c_nationkey")
    return t.customer.groupBy("c_mktsegment").agg(arrays.count(kinds).alias("n"), F.round(arrays.avg(kinds), 6).alias("a"))


@query("select c_mktsegment, round(stddev_pop(cast(c_acctbal as decimal(12, 2))), 4) as pop, round(stddev_samp(cast(c_acctbal as decimal(12, 2))), 4) as samp from customer group by c_mktsegment")
def agg_stddev_numeric(t: Tables) -> DataFrame:
    x = F.col("c_acctbal").cast("decimal(12,2)")
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.stddev_pop(x), 4).alias("pop"), F.round(F.stddev_samp(x), 4).alias("samp"))


@query("select event_type, k, frequency from (select *, row_number() over (partition by event_type order by frequency desc, k) as r from (select event_type, user_id % 5 as k, count(*) as frequency from events group by 1, 2)) where r <= 2")
def agg_topk_grouped(t: Tables) -> DataFrame:
    return A.top_k(t.events.select("event_type", (F.col("user_id") % 5).alias("k")), ["event_type"], "k", 2)


@query("select e.event_id, k.kinds from events e join (select user_id, list_sort(list(distinct event_type)) as kinds from events group by user_id) k on k.user_id = e.user_id")
def window_collect_set(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_sort(F.collect_set("event_type").over(W.over(["user_id"]))).alias("kinds"))


text("window_aggregates", "select s_suppkey, min(s_acctbal) over w as lo, max(s_acctbal) over w as hi, count(*) over w as n, round(stddev_pop(s_acctbal) over w, 4) as sd from supplier window w as (partition by s_nationkey)", tables=("supplier",))
text("window_over_groups", "select o_orderpriority, count(*) as n, cast(rank() over (order by count(*) desc, o_orderpriority) as int) as rk, round(sum(sum(o_totalprice)) over (), 0) as total from orders group by o_orderpriority", tables=("orders",))
text("window_several", "select event_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as a, cast(row_number() over (partition by event_type order by ts desc, event_id) as int) as b from events", tables=("events",))
text("window_range_following", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderkey range between current row and 500 following) as n from orders", tables=("orders",))
text("top_k_expression", "select s_suppkey, abs(s_acctbal) as a from supplier order by abs(s_acctbal) desc, s_suppkey limit 7", tables=("supplier",))
text("limit_zero", "select s_suppkey from supplier limit 0", tables=("supplier",))
text("offset_only", "select n_nationkey from nation order by n_nationkey offset 20", tables=("nation",))
text("union_nested", "select k, count(*) as n from (select c_nationkey as k from customer union all (select s_nationkey from supplier union select n_nationkey from nation)) x group by k", tables=("customer", "supplier", "nation"))

# text


@query("select * from (values (1, 'doc|my Tab|x'), (2, 'a'), (3, 'schema_1|t$2')) as v(id, parts)")
def string_parse_ident(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, 'Doc."my Tab".x'), (2, "A"), (3, "schema_1.T$2")], "id int, s string")
    return rows.select("id", F.array_join(network.parse_ident(F.col("s")), "|").alias("parts"))


@query("select * from (values ('', 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262'), ('abc', '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85')) as v(s, h)")
def string_blake3(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([("",), ("abc",)], "s string")
    return rows.select("s", network.blake3(F.col("s")).alias("h"))


@query("select * from (values ('http', 'u:p', 'h.x', 81, '/a/b', 'q=1&r=a%20b&q=2', 'f', '1,2', 'a b')) as v(scheme, userinfo, hostname, port, path, query, fragment, q, r)")
def string_parse_uri(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([("http://u:p@h.x:81/a/b?q=1&r=a%20b&q=2#f",)], "s string").select(strings.parse_url(F.col("s")).alias("u"))
    p = F.col("u.parameters")
    return rows.select("u.scheme", "u.userinfo", "u.hostname", "u.port", "u.path", "u.query", "u.fragment", F.array_join(p["q"], ",").alias("q"), F.array_join(p["r"], ",").alias("r"))


@query("select p_partkey, p_name[-3:] as last3, lpad(cast(p_size as varchar), 4, '0') as padded, string_split(p_type, ' ')[1] as first_word, contains(p_name, 'an') as has_an, translate(lower(p_name), 'aeiou', '') as bare from part")
def string_columns(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", strings.right(n, 3).alias("last3"), strings.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), strings.split_part(F.col("p_type"), " ", 1).alias("first_word"), (strings.strpos(n, "an") > 0).alias("has_an"), F.translate(F.lower(n), "aeiou", "").alias("bare"))


# times and numbers


@query("select event_id, strftime(ts, '%A %B %-d %j %p %I:%M:%S') as a, strftime(ts, '%a %b %y %-m/%-H') as b from events")
def time_formats(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", times.date_format(ts, "%W %M %e %j %p %I:%i:%S").alias("a"), times.date_format(ts, "%a %b %y %c/%k").alias("b"))


@query("select event_id, date_trunc('day', ts + interval 5 hour + interval 30 minute) - interval 5 hour - interval 30 minute as d from events")
def time_trunc_zone(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.date_trunc("day", F.col("ts"), "Asia/Kolkata").cast("timestamp_ntz").alias("d"))


@query("select * from (values (1, 5, 93784000000), (2, -2, -1500000)) as v(id, months, micros)")
def time_interval_arithmetic(t: Tables) -> DataFrame:
    rows = t.spark.sql("select * from (values (1, 1, 2), (2, 2, -2)) as v(id, a, n)")
    one = times.add(times.interval(months=2, days=1, seconds=7384), times.times_(times.interval(months=1), 3))
    two = times.times_(times.interval(months=1, seconds=0.75), -2)
    picked = F.when(F.col("id") == 1, one).otherwise(two)
    return rows.select("id", picked.alias("i")).select("id", "i.months", "i.micros")


@query("select p_partkey, -p_size as neg, p_size % 7 as m, round(pi() * p_size, 6) as circle, cast(if(p_size > 25, 1, 0) as int) as big, greatest(p_size, 20) as g, least(p_size, null, 20) as l from part")
def math_columns(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select("p_partkey", F.negative(n).alias("neg"), maths.modulus(n, F.lit(7)).alias("m"), F.round(F.pi() * n, 6).alias("circle"), F.expr("if(p_size > 25, 1, 0)").alias("big"), F.greatest(n, F.lit(20)).alias("g"), F.least(n, F.lit(None).cast("int"), F.lit(20)).alias("l"))


# arrays and objects


@query("select vec_id, 1 as lower_, len(embedding) as upper_, round(list_max(embedding), 5) as hi, round(list_min(embedding), 5) as lo, round(list_avg(list_transform(embedding, lambda x: cast(x as double))), 6) as mean from embeddings")
def array_bounds(t: Tables) -> DataFrame:
    a = F.col("embedding")
    cols = {"lower_": arrays.lower(a), "upper_": arrays.upper(a).cast("long"), "hi": F.round(F.array_max(a), 5), "lo": F.round(F.array_min(a), 5), "mean": F.round(arrays.avg(a), 6)}
    return t.embeddings.select("vec_id", *[c.alias(k) for k, c in cols.items()])


@query("select event_id, user_id as k, event_type as first_tag, [user_id, event_id] as ids, false as nothing from events")
def object_literals(t: Tables) -> DataFrame:
    o = F.struct(F.col("user_id").alias("k"), F.array("event_type").alias("tags"), F.array(F.struct(F.col("user_id").alias("id")), F.struct(F.col("event_id").alias("id"))).alias("parts"))
    rows = t.events.select("event_id", o.alias("o"))
    return rows.select("event_id", objects.subscript(F.col("o"), "k").alias("k"), arrays.get(F.col("o.tags"), 1).alias("first_tag"), F.transform("o.parts", lambda x: x["id"]).alias("ids"), arrays.null_or_empty(F.col("o.tags")).alias("nothing"))


@query("select cast(json_extract_string(props, '$.k') as int) // 10 as band, count(*) as n, round(sum(value), 4) as total from events where json_extract_string(props, '$.missing') is null group by 1")
def object_filter_group(t: Tables) -> DataFrame:
    props = F.col("props")
    rows = t.events.where(objects.json_subscript(props, "missing").isNull())
    return rows.groupBy(maths.divide(objects.json_subscript(props, "k").cast("int"), F.lit(10)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# text search


TOKENS = "list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"select p_partkey, list_bool_or(list_transform({TOKENS}, lambda x: levenshtein(x, 'part') <= 1)) as fuzzy, contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' pa') as prefixed from part")
def match_fuzzy_prefix(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select("p_partkey", T.match(n, "part", fuzziness=1).alias("fuzzy"), T.match(n, "pa", kind="phrase_prefix").alias("prefixed"))


@query("""select w, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 11)) as w from documents) group by w""")
def match_terms(t: Tables) -> DataFrame:
    chain = analysis.Chain(filters=[analysis.lowercase(), analysis.length(least=12)])
    return t.documents.select(F.explode(chain.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("select * from (values ('soundex', 'R163,A261'), ('cologne', '65752682,3412'), ('word_delimiter', 'Wi,Fi,4,all')) as v(filter, tokens)")
def match_token_filters(t: Tables) -> DataFrame:
    cases = [("soundex", ["Robert", "Ashcraft"], phonetics.soundex()), ("cologne", ["Müller-Lüdenscheidt", "Wikipedia"], phonetics.cologne()), ("word_delimiter", ["Wi-Fi4all's"], phonetics.word_delimiter())]
    parts = [t.spark.range(1).select(F.lit(k).alias("filter"), F.array_join(step(F.array(*map(F.lit, words))), ",").alias("tokens")) for k, words, step in cases]
    return R.union(*parts)


# sources, changes, functions


@query("select c_custkey, c_name, c_acctbal, case when c_nationkey > 2 then c_mktsegment end as seg from customer")
def copy_json_round_trip(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment")).alias("seg"))
    path = scratch(t.spark, "copy")
    files.copy_to(rows, path, compression="gzip")
    return files.copy_from(t.spark, path, rows.schema, "json")


@query("select p_partkey, p_name || ', \"' || p_brand || '\"' as label, p_retailprice from part")
def copy_csv_round_trip(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("label"), "p_retailprice")
    path = scratch(t.spark, "copy")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.copy_from(t.spark, path, rows.schema, "csv")


@query("select n_nationkey, n_name from nation union all select n_nationkey + 100, n_name from nation where n_regionkey = 2")
def change_insert_ignore(t: Tables) -> DataFrame:
    base = t.nation.select("n_nationkey", "n_name")
    rows = base.withColumn("n_name", F.lit("ignored")).union(t.nation.where("n_regionkey = 2").select(F.col("n_nationkey") + 100, "n_name"))
    return dml.insert_on_conflict(base, rows, ["n_nationkey"])


@query("select s_suppkey, round(s_acctbal * 2, 2) as doubled from supplier where s_nationkey = 3")
def change_returning(t: Tables) -> DataFrame:
    return dml.update_returning(t.supplier, F.col("s_nationkey") == 3, {"s_acctbal": F.round(F.col("s_acctbal") * 2, 2)}, "s_suppkey", F.col("s_acctbal").alias("doubled"))


@query("select r_regionkey + 10 as r_regionkey, r_name from region")
def change_insert_returning(t: Tables) -> DataFrame:
    more = t.region.union(t.region.select(F.col("r_regionkey") + 10, "r_name"))
    return dml.insert_returning(t.region, more, ["r_regionkey"])


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as s from embeddings")
def udf_vectorized(t: Tables) -> DataFrame:
    """A user's Python function over Arrow batches; functions in SQL stay in the JVM (udf_scalar)."""

    @F.pandas_udf("double")
    def total(x: pd.Series) -> pd.Series:
        return x.map(lambda v: float(v.astype("float64").sum()))

    return t.embeddings.select("vec_id", F.round(total("embedding"), 4).alias("s"))


@query("select 1 as one, 'integer' as kind, true as allowed, cast(null as varchar) as nothing, 'UTF8' as encoding")
def system_compatibility(t: Tables) -> DataFrame:
    rows = TF.empty_row(t.spark)
    return rows.select(F.lit(1).alias("one"), system.format_type(F.lit(23)).alias("kind"), system.has_privilege().alias("allowed"), system.description().alias("nothing"), system.pg_encoding_to_char(F.lit(6)).alias("encoding"))


@query()
def table_keywords(t: Tables) -> DataFrame:
    return TF.keywords(t.spark)
