"""Scalar functions of every family, applied to columns of the tables or to small relations of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Tables
from ..functions import arrays, geo, maths, objects, strings, times, vectors
from ..operators import textsearch as T
from .registry import query, text

WORDS = "(values (1, 'hello wOrld-x'), (2, ''), (3, null), (4, 'a,b,,c'), (5, 'Straße über'), (6, 'foo123bar45')) as v(id, s)"
INTS = "(values (1, 7, 2), (2, -7, 2), (3, null, 3), (4, 0, 5), (5, 100, -7)) as v(id, a, b)"
LISTS = "(values (1, array(1, 2, 2, null), array(2, 3)), (2, array(5), null), (3, null, array(1, null)), (4, array(9, 8, 9), array(7))) as v(id, a, b)"
DUCK_LISTS = "(values (1, [1, 2, 2, null], [2, 3]), (2, [5], null), (3, null, [1, null]), (4, [9, 8, 9], [7])) as v(id, a, b)"


def words(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from {WORDS}")


def ints(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from {INTS}")


def lists(t: Tables) -> DataFrame:
    return t.spark.sql(f"select * from {LISTS}")


class Name:
    """A column by name, made when it is used: there is no session yet when this module is read."""

    def __init__(self, name: str):
        self.name = name

    def __get__(self, *_):
        return F.col(self.name)


class columns:
    s, a, b = Name("s"), Name("a"), Name("b")


@query(f"""select id, substr(s, 1, 2) as head, substr(s, 3) as tail, s[:-3] as but_last, case when s is null then null else right(s, 3) end as last3, substr(s, 3) as but_first,
lpad(s, 8, '*') as lp, rpad(s, 3, '*') as rp, trim(s, 'hx') as tr, reverse(s) as rv, repeat(s, 2) as rp2, upper(replace(s, 'ß', 'ss')) as up, lower(s) as lo from {WORDS}""")
def string_parts(t: Tables) -> DataFrame:
    cols = {
        "head": strings.substr(columns.s, 0, 2), "tail": strings.substr(columns.s, 3), "but_last": strings.left(columns.s, -2), "last3": strings.right(columns.s, 3), "but_first": strings.right(columns.s, -2), "lp": strings.lpad(columns.s, 8, "*"),
        "rp": strings.rpad(columns.s, 3, "*"), "tr": strings.trim(columns.s, "hx"), "rv": F.reverse(columns.s), "rp2": F.repeat(columns.s, 2), "up": F.upper(F.replace(columns.s, F.lit("ß"), F.lit("ss"))), "lo": F.lower(columns.s),
    }
    return words(t).select("id", *[c.alias(k) for k, c in cols.items()])


@query(f"select id, length(s) as n, strlen(s) as bytes, 8 * strlen(s) as bits, strpos(s, 'o') as p, starts_with(s, 'foo') as st, replace(s, 'o', '00') as re, translate(s, 'abo', 'xy') as tl, md5(s) as m, sha1(s) as h from {WORDS}")
def string_measures(t: Tables) -> DataFrame:
    cols = {"n": F.char_length(columns.s).cast("long"), "bytes": F.octet_length(columns.s).cast("long"), "bits": F.bit_length(columns.s).cast("long"), "p": strings.strpos(columns.s, "o").cast("long"), "st": F.startswith(columns.s, F.lit("foo")), "re": F.replace(columns.s, F.lit("o"), F.lit("00")), "tl": F.translate(columns.s, "abo", "xy"), "m": F.md5(columns.s), "h": F.sha1(columns.s)}
    return words(t).select("id", *[c.alias(k) for k, c in cols.items()])


@query(f"select id, concat(s, '-', id) as c, s || '-' || id as o, concat_ws('/', s, 'x', null) as w, split_part(s, ',', 2) as p2, split_part(s, ',', 9) as p9, printf('%05d|%s', id, coalesce(s, 'none')) as f from {WORDS}")
def string_concat(t: Tables) -> DataFrame:
    text_id = F.col("id").cast("string")
    return words(t).select("id", strings.concat(columns.s, "-", F.col("id")).alias("c"), strings.concat_op(strings.concat_op(columns.s, F.lit("-")), text_id).alias("o"), F.concat_ws("/", columns.s, F.lit("x"), F.lit(None)).alias("w"), strings.split_part(columns.s, ",", 2).alias("p2"), strings.split_part(columns.s, ",", 9).alias("p9"), strings.format_("%05d|%s", F.col("id"), F.coalesce(columns.s, F.lit("none"))).alias("f"))


@query(f"""select id, regexp_replace(s, '[0-9]+', '#') as first_only, regexp_replace(s, '[0-9]+', '#', 'g') as every, len(regexp_extract_all(s, 'o')) as n,
nullif(regexp_extract(s, '([a-z]+)[0-9]', 1), '') as g, regexp_full_match(s, '[a-z]+[0-9]+.*') as full_, case when s is null then null when s = 'foo123bar45' then 3 else 0 end as pos from {WORDS}""")
def string_regexp(t: Tables) -> DataFrame:
    return words(t).select(
        "id", strings.regexp_replace(columns.s, "[0-9]+", "#").alias("first_only"), strings.regexp_replace(columns.s, "[0-9]+", "#", "g").alias("every"), strings.regexp_count(columns.s, "o").cast("long").alias("n"),
        strings.substr_pattern(columns.s, "([a-z]+)[0-9]").alias("g"), strings.full_match(columns.s, "[a-z]+[0-9]+.*").alias("full_"), strings.regexp_instr(columns.s, "[a-z][0-9]").alias("pos"),
    )


@query(f"select id, case when s = '' then [] else string_split(s, ',') end as parts, array_to_string(string_split(s, ','), '+') as joined, case when s = '' then [] else list_transform(string_split(s, ','), lambda x: nullif(x, 'b')) end as nulls from {WORDS}")
def string_arrays(t: Tables) -> DataFrame:
    parts = strings.string_to_array(columns.s, ",")
    return words(t).select("id", parts.alias("parts"), strings.array_to_string(parts, "+").alias("joined"), strings.string_to_array(columns.s, ",", "b").alias("nulls"))


@query(f"select id, to_base64(encode(s)) as b64, lower(hex(encode(s))) as hx, decode(from_base64(to_base64(encode(s)))) as back, case when s = '' then 0 else unicode(s) end as code, chr(300 + id) as ch from {WORDS}")
def string_codes(t: Tables) -> DataFrame:
    hx = F.replace(strings.encode(columns.s, "hex"), F.lit("\\x"), F.lit(""))
    return words(t).select("id", strings.encode(columns.s, "base64").alias("b64"), hx.alias("hx"), strings.decode(strings.encode(columns.s, "base64"), "base64").alias("back"), F.ascii(columns.s).alias("code"), strings.chr_(F.col("id") + 300).alias("ch"))


@query("select page_id, regexp_extract(url, '^([a-z]+):', 1) as scheme, regexp_extract(url, '//([^/?#]+)', 1) as host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') as query, nullif(regexp_extract(url, '#(.*)$', 1), '') as fragment from pages")
def string_parse_url(t: Tables) -> DataFrame:
    u = strings.parse_url(F.col("url"))
    rows = t.pages.select("page_id", u.alias("u"))
    return rows.select("page_id", "u.scheme", F.concat_ws(":", "u.hostname", "u.port").alias("host"), F.nullif("u.query", F.lit("")).alias("query"), F.nullif("u.fragment", F.lit("")).alias("fragment"))


@query(f"select id, case when s = 'a,b,,c' then '\"a,b,,c\"' when s = 'foo123bar45' then s else '\"' || s || '\"' end as q from {WORDS} where s is not null")
def string_quote_ident(t: Tables) -> DataFrame:
    return words(t).where("s is not null").select("id", strings.quote_ident(columns.s).alias("q"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') as a, strftime(ts, '%d.%m.%y %H:%M:%S') as b from events")
def string_to_char(t: Tables) -> DataFrame:
    return t.events.select("event_id", strings.to_char(F.col("ts"), "YYYY-MM-DD HH24:MI").alias("a"), times.date_format(F.col("ts"), "%d.%m.%y %H:%i:%s").alias("b"))


text("string_initcap", "select id, initcap(s) as s from (values (1, 'hello wOrld'), (2, 'a-b cD'), (3, null)) as v(id, s)", "select * from (values (1, 'Hello World'), (2, 'A-b Cd'), (3, null)) as v(id, s)", tables=())


# numbers


@query(f"select id, a + b as s, a - b as d, a * b as m, cast(trunc(a / b) as int) as q, a % b as r, abs(a) as ab, -a as ng, cast(sign(a) as double) as sg, cast(greatest(a, b, 3) as int) as gr, cast(least(a, b, 3) as int) as le from {INTS}")
def math_integers(t: Tables) -> DataFrame:
    cols = {"s": columns.a + columns.b, "d": columns.a - columns.b, "m": columns.a * columns.b, "q": maths.divide(columns.a, columns.b).cast("int"), "r": maths.modulus(columns.a, columns.b), "ab": F.abs(columns.a), "ng": -columns.a, "sg": F.signum(columns.a), "gr": F.greatest(columns.a, columns.b, F.lit(3)), "le": F.least(columns.a, columns.b, F.lit(3))}
    return ints(t).select("id", *[c.alias(k) for k, c in cols.items()])


@query("""select c_custkey, cast(floor(c_acctbal + 0.5) as bigint) as r0, round(c_acctbal, 1) as r1, cast(trunc(c_acctbal) as bigint) as t0, cast(ceil(c_acctbal) as bigint) as c, cast(floor(c_acctbal) as bigint) as f,
round(power(c_acctbal / 1000, 2), 6) as p, round(exp(c_acctbal / 10000), 8) as e from customer""")
def math_rounding(t: Tables) -> DataFrame:
    x = F.col("c_acctbal")
    cols = {"r0": maths.round_(x), "r1": maths.round_(x, 1), "t0": maths.trunc(x), "c": F.ceil(x), "f": F.floor(x), "p": F.round(F.pow(x / 1000, 2), 6), "e": F.round(F.exp(x / 10000), 8)}
    return t.customer.select("c_custkey", *[c.alias(k) for k, c in cols.items()])


@query("""select p_partkey, round(sqrt(p_retailprice), 8) as sq, round(ln(p_retailprice), 8) as l, round(log10(p_retailprice), 8) as l10, round(ln(p_retailprice) / ln(2), 8) as l2, round(sin(p_size), 8) as s, round(cos(p_size), 8) as c,
round(tan(p_size), 6) as t, round(cot(p_size), 6) as ct, round(atan(p_size), 8) as at, round(atan2(p_size, 3), 8) as a2, round(asin(p_size / 100.0), 8) as asn, round(acos(p_size / 100.0), 8) as acs, round(degrees(p_size), 6) as dg, round(radians(p_size), 8) as rd, round(pi(), 8) as pi from part""")
def math_real(t: Tables) -> DataFrame:
    x, n = F.col("p_retailprice"), F.col("p_size").cast("double")
    cols = {"sq": maths.sqrt(x), "l": maths.ln(x), "l10": maths.log(x), "l2": maths.log(x, 2.0), "s": F.sin(n), "c": F.cos(n), "t": F.tan(n), "ct": maths.cot(n), "at": F.atan(n), "a2": F.atan2(n, F.lit(3.0)), "asn": maths.asin(n / 100), "acs": maths.acos(n / 100), "dg": F.degrees(n), "rd": F.radians(n), "pi": F.pi()}
    digits = {"t": 6, "ct": 6, "dg": 6}
    return t.part.select("p_partkey", *[F.round(c, digits.get(k, 8)).alias(k) for k, c in cols.items()])


@query(f"select id, a & b as n, a | b as o, xor(a, b) as x from {INTS}")
def math_bits(t: Tables) -> DataFrame:
    return ints(t).select("id", *[maths.bits(op, columns.a, columns.b).alias(k) for k, op in (("n", "and"), ("o", "or"), ("x", "xor"))])


@query("select '0010' as n, '1011' as o, '1001' as x")
def math_bit_strings(t: Tables) -> DataFrame:
    a, b = F.lit("0011"), F.lit("1010")
    return t.spark.range(1).select(*[maths.bit_strings(op, a, b).alias(k) for k, op in (("n", "and"), ("o", "or"), ("x", "xor"))])


text("math_conditional", f"select id, coalesce(a, b) as c, nullif(a, 7) as n, if(a > 0, 'pos', 'rest') as i from {INTS}", tables=())
text("cast_try", "select id, try_cast(s as int) as n, cast(id as string) as t, try_cast(s as double) as d from (values (1, '12'), (2, 'x'), (3, null), (4, '-7')) as v(id, s)", "select id, try_cast(s as int) as n, cast(id as varchar) as t, try_cast(s as double) as d from (values (1, '12'), (2, 'x'), (3, null), (4, '-7')) as v(id, s)", tables=())
text("cast_types", "select o_orderkey, cast(o_totalprice as bigint) as b, cast(cast(o_orderdate as date) as string) as d, cast(o_custkey as double) as x, cast(o_orderkey % 2 as boolean) as f from orders", "select o_orderkey, cast(trunc(o_totalprice) as bigint) as b, cast(cast(o_orderdate as date) as varchar) as d, cast(o_custkey as double) as x, cast(o_orderkey % 2 as boolean) as f from orders", tables=("orders",))


# times

TRUNCATED = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "d": "day", "h": "hour", "mi": "minute", "s": "second"}


@query("select event_id, " + ", ".join(f"cast(date_trunc('{u}', ts) as timestamp) as {k}" for k, u in TRUNCATED.items()) + " from events")
def time_trunc(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[times.date_trunc(u, F.col("ts")).cast("timestamp_ntz").alias(k) for k, u in TRUNCATED.items()])


@query("""select o_orderkey, cast(ceil(year(o_orderdate) / 100) as int) as c, cast(year(o_orderdate) as int) as y, cast(quarter(o_orderdate) as int) as q, cast(month(o_orderdate) as int) as m, cast(week(o_orderdate) as int) as w, cast(day(o_orderdate) as int) as d,
cast(isodow(o_orderdate) as int) as dow, cast(dayofyear(o_orderdate) as int) as doy, epoch(o_orderdate) as e from orders""")
def time_extract(t: Tables) -> DataFrame:
    fields = {"c": "century", "y": "year", "q": "quarter", "m": "month", "w": "week", "d": "day", "dow": "day_of_week", "doy": "day_of_year", "e": "epoch"}
    return t.orders.select("o_orderkey", *[times.extract(f, F.col("o_orderdate")).alias(k) for k, f in fields.items()])


@query("select event_id, time_bucket(interval '15 minutes', ts, timestamp '2024-01-10 00:05:00') as b, time_bucket(interval '3 days', ts, timestamp '2024-01-20') as d from events")
def time_bin(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.date_bin("15 minutes", F.col("ts"), "2024-01-10 00:05:00").alias("b"), times.date_bin("3 days", F.col("ts"), "2024-01-20 00:00:00").alias("d"))


@query("select event_id, ts + interval 1 month + interval 36 hour as p, ts - interval 90 second as m, epoch_us(ts) - epoch_us(timestamp '2024-01-01') as diff from events")
def time_interval(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", times.plus(ts, times.interval(months=1, days=1.5)).alias("p"), times.plus(ts, times.interval(seconds=90), -1).alias("m"), (times.micros(ts) - times.micros(F.lit("2024-01-01").cast("timestamp_ntz"))).alias("diff"))


@query("select event_id, timezone('Europe/Vienna', timezone('UTC', ts)) as vienna from events")
def time_zone(t: Tables) -> DataFrame:
    return t.events.select("event_id", times.timezone("Europe/Vienna", F.col("ts"), True).cast("timestamp_ntz").alias("vienna"))


@query("select * from (values (1, 1, 2, 3), (2, 0, 0, 30), (3, -1, -2, -3)) as v(id, years, months, days)")
def time_age(t: Tables) -> DataFrame:
    pairs = t.spark.sql("select id, cast(e as timestamp_ntz) as e, cast(s as timestamp_ntz) as s from (values (1, '2024-03-04', '2023-01-01'), (2, '2024-01-31', '2024-01-01'), (3, '2023-01-01', '2024-03-04')) as v(id, e, s)")
    return pairs.select("id", times.age(F.col("e"), F.col("s")).alias("a")).select("id", "a.years", "a.months", "a.days")


# arrays


@query(f"""select id, case when a is not null then list_append(a, 5) end as app, case when a is not null then list_prepend(5, a) end as pre, case when a is null and b is null then null else list_concat(coalesce(a, []), coalesce(b, [])) end as cat, a[2:3] as sl, a[2] as el,
list_min(a) as mn, list_max(a) as mx, list_position(a, 2) as pos, cast(list_sum(a) as double) as su, list_avg(a) as av, nullif(len(a), 0) as ln from {DUCK_LISTS}""")
def array_basics(t: Tables) -> DataFrame:
    cols = {
        "app": F.array_append(columns.a, F.lit(5)), "pre": F.array_prepend(columns.a, F.lit(5)), "cat": arrays.concat(columns.a, columns.b), "sl": arrays.slice_(columns.a, 2, 3), "el": arrays.get(columns.a, 2), "mn": F.array_min(columns.a), "mx": F.array_max(columns.a),
        "pos": arrays.position(columns.a, 2), "su": arrays.sum_(columns.a), "av": arrays.avg(columns.a), "ln": arrays.length(columns.a).cast("long"),
    }
    return lists(t).select("id", *[c.alias(k) for k, c in cols.items()])


@query("select * from (values (1, [1, 2, null, 3], [1, null], true), (2, [5], [5], null), (3, [1, null], null, null), (4, [9, 8, 7], [9, 8, 9], false)) as v(id, un, di, ov)")
def array_sets(t: Tables) -> DataFrame:
    return lists(t).select("id", arrays.unique(columns.a, columns.b).alias("un"), arrays.difference(columns.a, columns.b).alias("di"), arrays.overlap(columns.a, columns.b).alias("ov"))


@query("select * from (values (1, [1, 2, 2, null, null, 0], [1, 1], 2), (2, [5, null, null, null, null, 0], [], 1), (4, [9, 8, 9, null, null, 0], [9], 2)) as v(id, st, fl, up)")
def array_more(t: Tables) -> DataFrame:
    flat = F.when(F.col("id") == 1, arrays.flatten(F.array(F.slice(columns.a, 1, 1), F.lit(None).cast("array<int>"), F.slice(columns.a, 1, 1)))).when(F.col("id") == 2, F.slice(columns.a, 1, 0)).otherwise(F.slice(columns.a, 1, 1))
    up = arrays.upper(F.array(F.slice(columns.a, 1, 2), F.slice(columns.a, 1, 1)), 2)
    return lists(t).where("a is not null").select("id", arrays.set_(columns.a, 6, 0).alias("st"), flat.alias("fl"), up.alias("up"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as norm, len(embedding) as n from embeddings")
def array_fold(t: Tables) -> DataFrame:
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.select("vec_id", F.round(F.sqrt(square), 6).alias("norm"), F.size("embedding").cast("long").alias("n"))


# objects


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, json_keys(props) as keys from events")
def object_subscript(t: Tables) -> DataFrame:
    return t.events.select("event_id", objects.json_subscript(F.col("props"), "k").cast("int").alias("k"), objects.keys(F.col("props"), json=True).alias("keys"))


@query("select event_type, cast(json_extract_string(props, '$.k') as int) % 10 as bucket, count(*) as n from events group by 1, 2")
def object_group(t: Tables) -> DataFrame:
    o = F.from_json("props", "k int")
    return t.events.select("event_type", (objects.subscript(o, "k") % 10).alias("bucket")).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def object_variant(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("select * from (values (1, 'a,b,c', '1,9,3'), (2, 'b', '5')) as v(id, ks, vs)")
def object_merge(t: Tables) -> DataFrame:
    rows = t.spark.sql("select 1 as id, map('a', 1, 'b', 2) as x, map('b', 9, 'c', 3) as y union all select 2, cast(null as map<string, int>), map('b', 5)")
    rows = rows.select("id", objects.merge(F.col("x"), F.col("y")).alias("m"))
    return rows.select("id", F.array_join(F.map_keys("m"), ",").alias("ks"), F.array_join(F.map_values("m").cast("array<string>"), ",").alias("vs"))


# geo, vectors, text


@query("select n_nationkey, round(2 * 6371008.7714 * asin(sqrt(pow(sin(radians(n_regionkey * 10 - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(n_regionkey * 10)) * pow(sin(radians(n_regionkey - n_nationkey * 2) / 2), 2))), 3) as meters from nation")
def geo_distance(t: Tables) -> DataFrame:
    a, b = geo.point(F.col("n_nationkey") * 2, F.col("n_nationkey")), geo.point(F.col("n_regionkey"), F.col("n_regionkey") * 10)
    return t.nation.select("n_nationkey", F.round(geo.distance(a, b), 3).alias("meters"))


@query("select * from (values ('a', cast(-5.6 as double), cast(42.6 as double), 'ezs42'), ('b', cast(10.40744 as double), cast(57.64911 as double), 'u4pru')) as v(label, lon, lat, hash)")
def geo_hash(t: Tables) -> DataFrame:
    rows = t.spark.sql("select * from (values ('a', -5.6D, 42.6D), ('b', 10.40744D, 57.64911D)) as v(label, lon, lat)")
    p = geo.point(F.col("lon"), F.col("lat"))
    return rows.select("label", geo.longitude(p).alias("lon"), geo.latitude(p).alias("lat"), geo.geohash(p, 5).alias("hash"))


@query("select s_suppkey, s_suppkey % 10 between 1 and 3 and s_nationkey between 1 and 20 as inside from supplier")
def geo_within(t: Tables) -> DataFrame:
    box = F.lit("POLYGON ((1 1, 3 1, 3 20, 1 20, 1 1))")
    point = F.concat(F.lit("POINT ("), F.col("s_suppkey") % 10, F.lit(" "), F.col("s_nationkey"), F.lit(")"))
    return t.supplier.select("s_suppkey", geo.within(point, box).alias("inside"))


@query("select * from (values (1, true), (2, false), (3, true)) as v(id, hit)")
def geo_intersects(t: Tables) -> DataFrame:
    rows = t.spark.sql("select * from (values (1, 'POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))'), (2, 'POLYGON ((8 8, 9 8, 9 9, 8 8))'), (3, 'POINT (1 1)')) as v(id, g)")
    return rows.select("id", geo.intersects(F.col("g"), F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")).alias("hit"))


@query("select cast(12364.0 as double) as km2")
def geo_area(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.round(geo.area(F.lit("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")) / 1e6, 0).alias("km2"))


@query("""select vec_id, round(1 / (1 + list_sum(list_transform(list_zip(embedding, q), lambda z: (cast(z[1] as double) - z[2]) * (cast(z[1] as double) - z[2])))), 6) as score
from embeddings, (select list_transform(range(64), lambda i: cast(0.01 * i - 0.3 as double)) as q)""")
def vector_similarity(t: Tables) -> DataFrame:
    q = F.array(*[F.lit(0.01 * i - 0.3) for i in range(64)])
    return t.embeddings.select("vec_id", F.round(vectors.similarity(F.col("embedding"), q), 6).alias("score"))


@query("""select vec_id from (select vec_id, list_sum(list_transform(embedding, lambda x: (cast(x as double) - 0.1) * (cast(x as double) - 0.1))) as d from embeddings) order by d, vec_id limit 10""")
def vector_knn(t: Tables) -> DataFrame:
    return vectors.knn(t.embeddings, "embedding", [0.1] * 64, 10, "vec_id").select("vec_id")


TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"select doc_id, list_contains({TOKENS}, 'tion') or list_contains({TOKENS}, 'onnd') as any_of, list_contains({TOKENS}, 'the') and list_contains({TOKENS}, 'of') as all_of, contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ') as phrase from documents")
def match_boolean(t: Tables) -> DataFrame:
    m = T.matches(F.col("text"), any_of={"query": "tion onnd"}, all_of={"query": "the of", "operator": "and"}, phrase={"query": "of the", "kind": "phrase"})
    return t.documents.select("doc_id", F.explode(F.array(m)).alias("m")).select("doc_id", "m.any_of", "m.all_of", "m.phrase")


@query(f"""with d as (select doc_id, {TOKENS} as t from documents), f as (select doc_id, len(t) as n, len(list_filter(t, lambda x: x = 'the')) as a, len(list_filter(t, lambda x: x = 'for')) as b from d),
g as (select count(*) as n, avg(n) as av, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from f)
select doc_id, round(ln(1 + (g.n - da + 0.5) / (da + 0.5)) * a / (a + 1.2 * (0.25 + 0.75 * f.n / av)) + ln(1 + (g.n - db + 0.5) / (db + 0.5)) * b / (b + 1.2 * (0.25 + 0.75 * f.n / av)), 6) as score from f, g where a > 0 or b > 0""")
def match_score(t: Tables) -> DataFrame:
    return T.search(t.documents.select("doc_id", "text"), "text", "the for", keep=["doc_id"]).select("doc_id", F.round("_score", 6).alias("score"))


# session and catalogue functions

text("system_functions", "select typeof(1) as t, current_schema() as s, 1 as one", "select 'int' as t, 'default' as s, 1 as one", tables=())
