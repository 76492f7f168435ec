"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits, each set if over half the word shingles' XXH64 values have it set. Fifteen bit
masks come from a linear code: bit i has a vector m(i) of RADIUS + 1 bits, and mask v holds the bits with
<m(i), v> = 1. Any RADIUS differing bits leave a v orthogonal to all their vectors, so every pair within the
radius agrees under some mask: no pair can be missed (Pagh, 2016).

Copies with one fingerprint are a single row from the start. A bucket with more than BUCKET different
fingerprints is dealt out anew by masks over its free bits, again covering; after three rounds at most
seven bits are free, so no task ever gathers an unbounded group, and nothing is dropped. A bucket emits
the edges of a spanning forest, not its pairs.

Null, empty and wordless texts have fingerprint zero and are linked like others; long texts are read whole; an empty
table gives no rows. Rows keep their multiplicity; of ids that could name a component the smallest does; a null id stays
and never becomes a component's name unless all ids of the component are null. Only the named columns are read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import components, cut, fresh

RADIUS, SHINGLE, SEED, BUCKET, ROUNDS = 3, 3, 42, 4096, 3


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.array([xxh64_intdigest(p, SEED) for p in parts], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each row of docs."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def masks(free: list[int]) -> list[int]:
    """Masks over the free bits that cover every set of RADIUS of them. The bits' vectors go round the nonzero ones,
    so that each mask holds at least about half of the bits."""
    size = 2 ** (RADIUS + 1)
    return [sum(1 << bit for i, bit in enumerate(free) if bin((i % (size - 1) + 1) & v).count("1") % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, family: dict[int, list[int]]) -> DataFrame:
    """A row (table, key, fp) for each mask; rows has fp and table (the mask that its bucket already shares).
    family: by that mask, its extensions."""
    pick = F.create_map(*[x for k, v in family.items() for x in (F.lit(signed(k)), F.array(*[F.lit(signed(k | m)) for m in v]))])
    out = rows.select("fp", F.explode(F.element_at(pick, F.col("table"))).alias("table"))
    return out.select("table", F.col("fp").bitwiseAND(F.col("table")).alias("key"), "fp")


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within the radius that connect what all such edges connect: all pairs of a small bucket, else a forest."""
    if len(fps) <= 16:
        i, j = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
        return fps[i[near]], fps[j[near]]
    left, a, b = np.arange(len(fps)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS
            new = left[near]
            a += [fps[at]] * len(new)
            b += fps[new].tolist()
            front, left = np.concatenate([front, new]), left[~near]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def bucket_edges(batches):
    for batch in batches:
        offsets, values = batch.column(0).offsets.to_numpy(), batch.column(0).values.to_numpy().view("<u8")
        pairs = [forest(np.unique(values[i:j])) for i, j in zip(offsets, offsets[1:])]
        a, b = (np.concatenate([p[k] for p in pairs] or [np.empty(0, "<u8")]).astype("<u8").view("<i8") for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def edges(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints within the radius that connect all that such edges connect."""
    every = list(range(64))
    family, rows, found = {0: masks(every)}, fps.select("fp").distinct().withColumn("table", F.lit(0).cast("long")), None
    for level in range(ROUNDS):
        keys = dealt(rows, family)
        counts = keys.groupBy("table", "key").count().where("count > 1")
        last = level == ROUNDS - 1
        small = keys.join(counts if last else counts.where(F.col("count") <= bucket), ["table", "key"])
        lists = small.groupBy("table", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        here = lists.mapInArrow(bucket_edges, "a long, b long")
        found = here if found is None else found.union(here)
        if last:
            break
        large, _ = cut(keys.join(counts.where(F.col("count") > bucket), ["table", "key"]).select("table", "fp").distinct(), "buckets")
        if large.isEmpty():
            break
        rows = large
        family = {k | m: masks([i for i in every if not (k | m) >> i & 1]) for k, v in family.items() for m in v}
    return found.distinct()


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of docs."""
    fps, _ = cut(fingerprints(docs, doc_id, text), "fps")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    of = components(edges(fps, bucket)).select(F.col("node").alias("fp"), F.col("component"))
    named = firsts.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that another one of their group stands for: the smallest id of each group stays
    (of its texts in the group the one of the least hash, one row of it if rows repeat). Texts under one id are
    documents of their own. Columns stay as they were; rows without id are kept."""
    kind = f"struct<id:{docs.schema[doc_id].dataType.simpleString()},digest:bigint>"
    known, digest = docs.where(F.col(doc_id).isNotNull()), fresh(docs, "digest")
    named = known.select(F.struct(F.col(doc_id), F.xxhash64(text)).cast(kind).alias("name"), text)
    kept = groups(named, "name", text).where("doc_id = component_id").select(F.col("doc_id.id").alias(doc_id), F.col("doc_id.digest").alias(digest)).distinct()
    once = known.withColumn(digest, F.xxhash64(text)).join(kept, [doc_id, digest], "left_semi").dropDuplicates([doc_id, digest])
    return once.select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
