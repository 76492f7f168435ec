"""The registered queries of the corpus operators: thin functions of (spark, sf_dir) over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed, langid, mixing, pii, quality, secrets, simhash, substrings, warc
from .common import WRITTEN, shared_dir
from .spans import digest_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), out="pii")
    scores = F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",")  # of spans, in their order
    return docs.select("doc_id", *[c.alias(k) for k, c in digest_columns(docs["pii"], pii.KINDS, pii.BASE).items()], scores.alias("scores"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as an archive grows: an older batch of them starts a ledger, then the newer batch is scanned against
    it. Together they are the whole table; blobs of the second batch that the first one had are not scanned again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    WRITTEN.append(ledger)
    older = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(True))
    docs = secrets.update(docs.where(older), ledger).unionByName(secrets.update(docs.where(~older), ledger))
    return docs.select("doc_id", *[c.alias(k) for k, c in digest_columns(docs["secrets"], secrets.KINDS, secrets.BASE).items()])


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return rows.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id")))
    rows = quality.score(docs, quality.learn(docs, labels))
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def mixing_sql() -> str:
    """The mix of op8 with one running sum for each leaf."""

    def level(name: str, nodes: str, by: str, col: str, weights: dict) -> str:
        part = f"partition by {by}" if by else ""
        w = "cast(case " + "".join(f"when {col} = '{k}' then {v} " for k, v in weights.items()) + "else 1 end as double)" if weights else "cast(1 as double)"
        return f"""
{name}_w as (select *, {w} as w from ({nodes})),
{name}_r as (select *, cap / w as ratio from {name}_w),
{name}_b as (select *, sum(w) over ({part}) - coalesce(sum(w) over ({part} order by ratio, {col} rows between unbounded preceding and 1 preceding), 0) as rest_w,
  above - coalesce(sum(cap) over ({part} order by ratio, {col} rows between unbounded preceding and 1 preceding), 0) as rest_b from {name}_r),
{name}_f as (select *, cap * rest_w <= rest_b * w as fits from {name}_b),
{name}_l as (select *, min(case when not fits then ratio end) over ({part}) as first_ratio from {name}_f),
{name}_v as (select *, max(case when not fits and ratio = first_ratio then rest_b / rest_w end) over ({part}) as lvl from {name}_l),
{name} as (select *, cast(floor(case when fits or lvl is null then cast(cap as double) else least(cast(cap as double), lvl * w) end) as bigint) as budget from {name}_v)"""

    root = f"(select least(cast(floor(sum(t) * {mixing.SHARE}) as bigint), cast(sum(t) * {mixing.EPOCHS} as bigint)) from leaves)"
    return rf"""
with s as (select doc_id, concat('d', cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4, 0) as varchar)) as d, coalesce(lang, '') as l, coalesce(source, '') as s,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as bigint) as t from documents),
k as (select * from s where t > 0),
leaves as (select d, l, s, cast(sum(t) as bigint) as t, cast(sum(t) as bigint) * {mixing.EPOCHS} as cap from k group by d, l, s),
{level("a", f"select d, cast(sum(cap) as bigint) as cap, {root} as above from leaves group by d", "", "d", mixing.WEIGHTS["domain"])},
{level("b", "select x.d, x.l, x.cap, a.budget as above from (select d, l, cast(sum(cap) as bigint) as cap from leaves group by d, l) x join a on a.d = x.d", "d", "l", mixing.WEIGHTS["language"])},
{level("c", "select x.d, x.l, x.s, x.t, x.cap, b.budget as above from leaves x join b on b.d = x.d and b.l = x.l", "d, l", "s", mixing.WEIGHTS["source"])},
p as (select d, l, s, budget // t as whole, budget % t as rest from c),
h as (select k.*, whole, rest, md5(concat_ws(':', '{mixing.SEED}', cast(whole as varchar), cast(doc_id as varchar))) as h from k join p on p.d = k.d and p.l = k.l and p.s = k.s),
u as (select *, sum(t) over (partition by d, l, s order by h, doc_id range between unbounded preceding and current row) as upto from h)
select doc_id, d as mix_domain, l as mix_language, s as mix_source, t as mix_tokens, whole + cast(upto <= rest as bigint) as n_copies from u where whole + cast(upto <= rest as bigint) > 0"""


def secrets_sql() -> str:
    """The findings of op4: places of matches from the lengths of the texts between them. The expressions are those of the
    contract, and plain forms of the added ones."""
    rules = {
        "assign": r"""(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}",
        "private_key": "-----BEGIN( [A-Z0-9]{1,20}){0,4} PRIVATE KEY-----", "forge_token": "gh[pousr]_[A-Za-z0-9]{36,}", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    }
    base, rules = ("assign", "access", "hex"), {k: v.replace("\\'", "'").replace("'", "''") for k, v in rules.items()}
    one = " union all ".join(f"select doc_id, {i} as k, '{kind}' as kind, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as g from d" for i, (kind, p) in enumerate(rules.items()))
    counts = ", ".join(f"count(*) filter (where k = {i}) as n_{kind}" for i, kind in enumerate(base))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
r as ({one}),
e as (select doc_id, k, kind, m, g, unnest(range(1, len(m) + 1)) as i from r),
p as (select doc_id, k, kind, m[i] as w, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as a from e),
f as (select *, kind || ':' || a || ':' || (a + length(w)) as s from p where k <> 0 or length(regexp_extract(w, '{rules["assign"]}', 2)) >= 12),
x as (select doc_id, {counts}, string_agg(s, ',' order by a, k) filter (where k < {len(base)}) as base, string_agg(s, ',' order by a, k) as spans from f group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join x on x.doc_id = d.doc_id"""


EMBEDDING_SQL = """
with recursive v as (select vec_id, case when embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
  then cast(embedding as double[]) end as e from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as r from v where e is not null),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / a.r / b.r >= 0.95),
reach as (select a, b from l union select reach.a, l.b from reach join l on l.a = reach.b),
c as (select a, min(b) as low from reach group by a),
k as (select a, count(*) as n from l group by a)
select v.vec_id, coalesce(k.n, 0) as n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) as component_id, v.vec_id <= coalesce(c.low, v.vec_id) as kept
from v left join k on k.a = v.vec_id left join c on c.a = v.vec_id"""

#: Every window of 400 bytes by its digest, of texts in hex (cut into parts, as a place far inside a long text is slow to find).
SUBSTRINGS_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
q as (select r, j * 1000 as base, substr(h, cast(2000 * j + 1 as bigint), 2798) as part from (select r, h, unnest(range(0, (len(h) // 2 + 600) // 1000)) as j from d where len(h) >= 800)),
w as (select r, base + o as p, md5(substr(part, cast(2 * o + 1 as bigint), 800)) as k from (select r, base, part, unnest(range(0, least(1000, len(part) // 2 - 399))) as o from q)),
t as (select k from w group by k having count(*) > 1),
c as (select w.r, w.p, case when w.p - lag(w.p) over (partition by w.r order by w.p) <= 400 then 0 else 1 end as fresh from w join t on t.k = w.k),
g as (select r, p, sum(fresh) over (partition by r order by p rows unbounded preceding) as n from c),
s as (select r, n, min(p) as lo, max(p) + 400 as hi from g group by r, n),
x as (select r, lo, hi, lag(hi, 1, 0) over (partition by r order by lo) as before from s),
k as (select d.r, string_agg(substr(d.h, cast(2 * x.before + 1 as bigint), cast(2 * (x.lo - x.before) as bigint)), '' order by x.lo) as head, max(x.hi) as last, sum(x.hi - x.lo) as gone, count(*) as spans from x join d on d.r = x.r group by d.r)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(cast(gone as bigint), 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, cast(2 * coalesce(last, 0) + 1 as bigint)))) as kept_sha256
from d left join k on k.r = d.r"""

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WARC_SQL = rf"""
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as n, sha1(html) as x from p),
m as (select x, max(page_id) as first from q group by x)
select q.page_id, cast(n as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{B32}', cast(1 + ((cast('0x' || substr(q.x, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint), 1)), '') as payload_digest,
  case when q.page_id = first then 'response' else 'revisit' end as record_type, case when q.page_id = first then null else first end as refers_to
from q join m on m.x = q.x"""

QUERIES = {f.__name__: f for f in (op1_pii, op2_embedding, op3_simhash, op4_secrets, op5_language, op6_warc, op7_quality, op8_mixing, op9_decontaminate, op10_substrings)}
ORACLE_SQL: dict[str, str] = {
    "op9_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bs as (select item_id, w, least(len(w), 8) as k, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as pos from b where len(w) > 0),
bw as (select distinct cast(item_id as varchar) as item, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') as g from bs),
ks as (select distinct k from bw),
ds as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as pos from d, ks where len(w) >= k),
h as (select s.doc_id, s.pos, s.k, bw.item from (select doc_id, pos, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') as g from ds) s join bw on bw.k = s.k and bw.g = s.g),
p as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(pos, pos + k)) as p from h) group by doc_id),
i as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(p.n, 0) as n_hit, coalesce(i.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(i.n, 0) >= 2 as contaminated
from d left join p on p.doc_id = d.doc_id left join i on i.doc_id = d.doc_id""",
    "op2_embedding": EMBEDDING_SQL,
    "op4_secrets": secrets_sql(),
    "op6_warc": WARC_SQL,
    "op8_mixing": mixing_sql(),
    "op10_substrings": SUBSTRINGS_SQL,
}
