"""Near-duplicate vectors by cosine, with randomised-rotation binary codes (RaBitQ, Gao and Long, 2024).

A vector's code is the signs of its random rotations; it is stored once, with the vector and a correction factor.
Candidates come from keys, runs of the code's bits, a key for each of so many tables that a pair right at the
threshold shares none with a probability of MISS at most (closer pairs far less). Only codes are dealt out to the
tables. In a bucket, the number of bits in which two codes differ estimates their angle without bias; pairs within
its confidence bound of the threshold survive, and only vectors with such a partner, met for the first time in this
table, are fetched to the bucket. There the correction factor gives an unbiased estimate of the inner product and a
bound; pairs whose upper bound reaches the threshold are recomputed in double precision, and only those with a
cosine at or above it are linked. A pair counts in the first table in which it meets. A bucket sends back link counts
and a spanning forest, never its pairs; buckets over BLOCK vectors are dealt out as pairs of blocks, so that no task
gathers more than two blocks, and none is dropped.

Vectors that are null, empty or zero, hold null or non-finite components, or have no id, link with nothing. Vectors
of different lengths do not link. Equal vectors are one row until the end, where each copy gets its links to the
others; repeated rows count as other vectors. An empty table gives no rows. Vectors may be of any length; only the named
columns are read, so others may have any name."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, maybe_broadcast

COSINE, MISS, FILL, BLOCK, SEED, SIGMAS = 0.95, 1e-4, 1024, 4096, 11, 5.0


def tables(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits of a key, so that a bucket has about FILL unrelated vectors, and the number of tables."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / FILL + 1)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-same))


def key_bits(code: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Key numbers by code and table."""
    signs = np.unpackbits(code, axis=1, count=bits * count).reshape(len(code), count, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def rotations(size: int, count: int, seed: int) -> np.ndarray:
    """Random directions as rows, orthogonal by runs of size."""
    rng = np.random.default_rng([seed, size])
    blocks = [np.linalg.qr(rng.normal(size=(size, size)))[0].T for _ in range(-(-count // size))]
    return np.concatenate(blocks)[:count]


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes of unit vectors (packed) under whole rotations, and their correction factors: the inner products of the
    rotated vectors with their codes, both of length one."""
    z = x @ turn.T
    return np.packbits(z >= 0, axis=1), np.abs(z).sum(1) / len(turn) * math.sqrt(x.shape[1])


def most_bits(size: int, cosine: float) -> float:
    """The number of differing bits, of so many, up to which a pair may have the cosine."""
    p = math.acos(cosine) / math.pi
    return size * p + SIGMAS * math.sqrt(size * p * (1 - p))


def near_codes(a: np.ndarray, b: np.ndarray, size: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of codes of size bits whose angle may be small enough."""
    pad = -a.shape[1] % 8
    wide = [np.ascontiguousarray(np.pad(c, ((0, 0), (0, pad)))).view(np.uint64) for c in (a, b)]
    differ = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(wide[0].shape[1]):
        differ += np.bitwise_count(wide[0][:, k, None] ^ wide[1][None, :, k])
    return np.nonzero(differ <= most_bits(size, cosine))


def estimates(code: np.ndarray, factor: np.ndarray, turned: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, bound) of the inner products, row by row, of the vectors behind codes with the rotated vectors turned, of
    size components before rotation."""
    n = turned.shape[1]
    signs = np.unpackbits(code, axis=1, count=n).astype(np.float32) * 2 - 1
    estimate = np.einsum("ij,ij->i", signs, turned.astype(np.float32)) / n * math.sqrt(size) / factor
    return estimate, np.sqrt(np.maximum(1 - factor**2, 0)) / factor * SIGMAS / math.sqrt(max(size - 1, 1))


def met_here(a: np.ndarray, b: np.ndarray, n: int, bits: int, table: int, cosine: float, same: bool):
    """Pairs of codes, in portions, that may be near and share no key of an earlier table; same: a is b, only i < j."""
    keys = [key_bits(c, bits, table) for c in (a, b)] if table else None
    for at in range(0, len(a), 512):
        i, j = near_codes(a[at : at + 512], b, n, cosine)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000], j[k : k + 100_000]
            if keys is not None:
                new = ~(keys[0][p] == keys[1][q]).any(1)
                p, q = p[new], q[new]
            if len(p):
                yield p, q


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least number of each one's component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            return label


def blocks(rows: DataFrame, held: list[str], block: int) -> DataFrame:
    """rows (table, size, key, rep, ..) gathered as (table, size, key, i, j, all): a bucket, or a pair of its blocks."""
    at = ["table", "size", "key"]
    large = rows.groupBy(*at).count().where(F.col("count") > block).select(*at, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    large, _ = cut(large, "large")
    parts = rows.join(maybe_broadcast(large), at, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    parts = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return parts.groupBy(*at, "i", "j").agg(F.collect_list(F.struct(*held, "own")).alias("all")).where("size(all) > 1")


def encoded(vectors: DataFrame, bits: int, count: int, kind: type) -> DataFrame:
    """(rep, m, size, x, code, factor): each vector once, with its code."""

    def run(batches):
        memo: dict = {}
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=kind)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                turn = frame(memo, int(size), bits * count)
                rows = np.nonzero(sizes == size)[0]
                for at in range(0, len(rows), 4000):
                    ids = rows[at : at + 4000]
                    part = values[(ends[ids] - size)[:, None] + np.arange(size)]
                    code, factor = codes(unit(part), turn)
                    take = pa.array(ids)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(ids), size, np.int32)), pa.array([r.tobytes() for r in part], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor)], ["rep", "m", "size", "x", "code", "factor"])

    return vectors.select("rep", "m", "v").mapInArrow(run, "rep long, m long, size int, x binary, code binary, factor double")


def frame(memo: dict, size: int, least: int) -> np.ndarray:
    """Whole rotations of so many dimensions, of at least so many rows together."""
    if size not in memo:
        memo[size] = rotations(size, -(-least // size) * size, SEED)
    return memo[size]


def dealt(coded: DataFrame, bits: int, count: int) -> DataFrame:
    """(table, size, key, rep, code): a row for each code and table."""

    def run(batches):
        for b in batches:
            sizes, packed = b.column(1).to_numpy(), b.column(2).to_pylist()
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                key = key_bits(np.frombuffer(b"".join(packed[i] for i in rows), dtype=np.uint8).reshape(len(rows), -1), bits, count)
                for t in range(count):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), b.column(1).take(take), pa.array(key[:, t]), b.column(0).take(take), b.column(2).take(take)], ["table", "size", "key", "rep", "code"])

    return coded.select("rep", "size", "code").mapInArrow(run, "table int, size int, key long, rep long, code binary")


def links(vectors: DataFrame, n: int, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(a, b, n) from different vectors (rep, m copies, v): rows with null b add n links to a; others are edges."""
    bits, count = tables(n, cosine)
    kind = np.float64 if "double" in vectors.schema["v"].dataType.simpleString() else np.float32
    coded, _ = cut(encoded(vectors, bits, count, kind), "codes")

    def groups(b):
        """(table, size, whether of one block, first and second block, members) of each bucket of a batch."""
        table, size, first, second = (b.column(k).to_numpy() for k in (0, 1, 3, 4))
        ends, inner = b.column(5).offsets.to_numpy(), b.column(5).values
        for g in range(len(b)):
            part = inner.slice(ends[g], ends[g + 1] - ends[g])
            own = part.field("own").to_numpy()
            alone = first[g] == second[g]
            p = np.arange(len(own)) if alone else np.nonzero(own == first[g])[0]
            q = p if alone else np.nonzero(own == second[g])[0]
            code = np.frombuffer(b"".join(part.field("code").to_pylist()), dtype=np.uint8).reshape(len(own), -1)
            bits_of = -(-bits * count // int(size[g])) * int(size[g])
            pairs = ((p[i], q[j]) for i, j in met_here(code[p], code[q], bits_of, bits, int(table[g]), cosine, alone)) if len(p) and len(q) else ()
            yield g, int(size[g]), part, code, pairs

    def partners(batches):
        for b in batches:
            rows, reps = [], []
            for g, _, part, code, pairs in groups(b):
                some = np.zeros(len(code), bool)
                for i, j in pairs:
                    some[i] = some[j] = True
                found = part.field("rep").filter(pa.array(some))
                rows.append(np.full(len(found), g))
                reps.append(found.to_numpy())
            take = pa.array(np.concatenate(rows or [np.empty(0, int)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), pa.array(np.concatenate(reps or [np.empty(0, int)]).astype(np.int64))], ["table", "size", "key", "rep"])

    def meet(batches):
        memo: dict = {}
        for b in batches:
            out: list[tuple] = []
            for _, size, part, code, pairs in groups(b):
                rep, m, factor = (part.field(k).to_numpy() for k in ("rep", "m", "factor"))
                x, turned = None, None
                total, edges = np.zeros(len(rep)), []
                for i, j in pairs:
                    if x is None:
                        x = unit(np.frombuffer(b"".join(part.field("x").to_pylist()), dtype=kind).reshape(len(rep), -1))
                        turned = (x @ frame(memo, size, bits * count).T).astype(np.float32)
                    for k in range(0, len(i), 20_000):
                        p, q = i[k : k + 20_000], j[k : k + 20_000]
                        estimate, bound = estimates(code[p], factor[p], turned[q], size)
                        may = estimate + bound >= cosine - 1e-5
                        p, q = p[may], q[may]
                        near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                        edges.append((p[near], q[near]))
                        total += np.bincount(p[near], m[q[near]], len(rep)) + np.bincount(q[near], m[p[near]], len(rep))
                if some := np.nonzero(total)[0].tolist():
                    out += zip(rep[some].tolist(), [None] * len(some), total[some].astype(np.int64).tolist())
                    root = roots(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)), len(rep))
                    some = np.nonzero(root != np.arange(len(rep)))[0]
                    out += zip(rep[some].tolist(), rep[root[some]].tolist(), [0] * len(some))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    at = ["table", "size", "key"]
    found = blocks(dealt(coded, bits, count), ["rep", "code"], block).mapInArrow(partners, "table int, size int, key long, rep long")
    members, _ = cut(found.distinct(), "members")
    names = coded.withColumnRenamed("size", "dims")
    fetched = names.join(maybe_broadcast(members), "rep").select(*at, "rep", "m", "x", "code", "factor")
    return blocks(fetched, ["rep", "m", "x", "code", "factor"], block).select(*at, "i", "j", "all").mapInArrow(meet, "a long, b long, n long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of rows."""
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    fine = F.expr("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    every = every.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = every.where("fine").select("vec_id", "v")
    vectors, _ = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "vectors")
    found, _ = cut(links(vectors, vectors.count(), cosine, block), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    of = components(found.where("b is not null"))
    reps = vectors.join(counts, F.col("rep") == F.col("a"), "left").join(of, F.col("rep") == F.col("node"), "left")
    reps = reps.select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(reps, "v").select("vec_id", "n_links", "component_id")
    out = out.union(every.where("not fine").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
