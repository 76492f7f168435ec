"""Quality scores: random-indexing word vectors pooled for each document, then a two-layer network.

A token's index vector is sparse and ternary, made from a hash; its word vector adds the index vectors of
its neighbours over a bounded sample of labelled rows (SAMPLE). Besides words, tokens are runs of
punctuation, the shapes of words, and marks for words seen just before or before at all. A document is
the mean of its tokens' vectors. The network is trained in numpy and its probabilities are calibrated by a
temperature fitted on rows kept apart.

Neighbours are summed on the executors, in whole numbers, so that the sums do not depend on how rows are dealt
out; the driver gets one vector for each token of the sample (all of them) and one for each of its documents, but no
texts. What is broadcast is thus bounded by the sample, not by the table.

Every text gets a score, whole however long; null and empty ones that of no tokens. With no labels the score is 0.5,
with one class its rate after smoothing; an empty table gives no rows. Of several labels of an id the least
counts, of several texts the first in order. Rows keep their multiplicity; only the named columns are read."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut
from .langid import bounded

SAMPLE, SIZE, SPIKES, REACH, HIDDEN = 4000, 128, 8, 2, 24
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE = 100_000


def tokens(text: str | None) -> list[str]:
    out, seen, last = [], set(), None
    for t in TOKEN.findall(text or ""):
        low = t.lower()
        out.append(low)
        if not t[0].isalnum():
            out.append("\0mark")
        elif t.isupper() and len(t) > 1:
            out.append("\0upper")
        elif t[0].isupper():
            out.append("\0title")
        elif not t.isalpha():
            out.append("\0digit")
        if low == last:
            out.append("\0same")
        elif low in seen:
            out.append("\0again")
        seen.add(low)
        last = low
    return out


def index_vector(token: str) -> np.ndarray:
    out, h = np.zeros(SIZE, dtype=np.float32), 0
    for i in range(SPIKES):
        h = xxh64_intdigest(token, i)
        out[h % SIZE] += 1.0 if h >> 40 & 1 else -1.0
    return out


class Vectors:
    """words: row numbers of matrix (bytes, times the row's scale); other tokens have their index vectors."""

    def __init__(self, words: dict[str, int], matrix: np.ndarray, scale: np.ndarray):
        self.words, self.matrix, self.scale, self.cache, self.held = words, matrix, scale, {}, None

    def shared(self, spark: SparkSession):
        """The one broadcast of these vectors."""
        if self.held is None:
            self.held = spark.sparkContext.broadcast((self.words, self.matrix, self.scale))
        return self.held

    def __call__(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        out, rows, times = np.zeros(SIZE, dtype=np.float64), [], []
        for t, n in Counter(found).items():
            if (k := self.words.get(t)) is not None:
                rows.append(k)
                times.append(n)
            else:
                if (v := self.cache.get(t)) is None:
                    v = index_vector(t)
                    if len(self.cache) < CACHE:
                        self.cache[t] = v
                out += n * v
        if rows:
            out += (np.asarray(times, dtype=np.float64) * self.scale[rows]) @ self.matrix[rows].astype(np.float64)
        return np.concatenate([out / max(len(found), 1), [1.0 if found else 0.0, np.log1p(len(found)) / 10]])


def neighbours(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Tokens of the texts, and for each the sum of the index vectors of what stands at most REACH from it."""
    numbers: dict[str, int] = {}
    flat = np.array([x for t in texts for x in (*(numbers.setdefault(w, len(numbers)) for w in tokens(t)), *[-1] * REACH)], dtype=np.int64)
    size = len(numbers)
    own = np.stack([index_vector(t) for t in numbers]).astype(np.int32) if numbers else np.zeros((0, SIZE), np.int32)
    around = np.zeros((size, SIZE), dtype=np.int32)
    for d in range(1, REACH + 1):
        a, b = flat[:-d], flat[d:]
        both = (a >= 0) & (b >= 0)
        for left, right in ((a[both], b[both]), (b[both], a[both])):
            pair, n = np.unique(left * size + right, return_counts=True)
            for at in range(0, len(pair), 100_000):
                one, other = np.divmod(pair[at : at + 100_000], size)
                starts = np.nonzero(np.diff(one, prepend=-1))[0]
                around[one[starts]] += np.add.reduceat(own[other] * n[at : at + 100_000, None], starts, axis=0)
    return list(numbers), around


def word_vector(token: str, around: np.ndarray) -> tuple[bytes, float]:
    """A token's index vector and, at half its length, the direction of its neighbours: in bytes, and their scale."""
    v = index_vector(token) + around / max(np.linalg.norm(around), 1e-9) * SPIKES**0.5 / 2
    scale = max(float(np.abs(v).max()), 1e-9) / 127
    return np.rint(v / scale).astype(np.int8).tobytes(), scale


def word_vectors(sample: DataFrame) -> Vectors:
    """The vectors of all tokens of sample (text)."""
    tasks = sample.sparkSession.sparkContext.defaultParallelism

    def partial(batches):
        for b in batches:
            found, around = neighbours(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([v.tobytes() for v in around], pa.binary())], ["token", "around"])

    def merged(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                more = np.frombuffer(v, dtype=np.int32).astype(np.int64)
                sums[t] = sums[t] + more if t in sums else more
        made = [word_vector(t, v) for t, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in made], pa.binary()), pa.array([x[1] for x in made], pa.float64())], ["token", "v", "scale"])

    parts = sample.select("text").repartition(tasks).mapInArrow(partial, "token string, around binary")
    got = parts.repartition(tasks, "token").mapInArrow(merged, "token string, v binary, scale double").toArrow().sort_by("token")
    return Vectors({t: i for i, t in enumerate(got.column(0).to_pylist())}, np.frombuffer(b"".join(got.column(1).to_pylist()), dtype=np.int8).reshape(-1, SIZE), got.column(2).to_numpy())


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    return np.maximum((x - net["mean"]) / net["scale"] @ net["a"] + net["a0"], 0) @ net["b"] + net["b0"]


def train(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> dict:
    """A two-layer network (Adam on the whole sample, logistic loss), calibrated on every fifth row, which it is not trained on."""
    apart = np.arange(len(y)) % 5 == 4
    if not 0 < y[~apart].sum() < (~apart).sum():
        rate_ = (y.sum() + 0.5) / (len(y) + 1)
        return {"mean": 0.0, "scale": 1.0, "a": np.zeros((x.shape[1], 1)), "a0": np.zeros(1), "b": np.zeros(1), "b0": float(np.log(rate_ / (1 - rate_))), "t": 1.0}
    rng = np.random.default_rng(seed)
    net = {"mean": x[~apart].mean(0), "scale": x[~apart].std(0) + 1e-3, "a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "a0": np.zeros(HIDDEN), "b": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b0": 0.0}
    z, t = (x[~apart] - net["mean"]) / net["scale"], y[~apart]
    m, v = ({k: np.zeros_like(net[k]) * 1.0 for k in ("a", "a0", "b", "b0")} for _ in range(2))
    for step in range(1, steps + 1):
        h = z @ net["a"] + net["a0"]
        r = np.maximum(h, 0)
        e = (1 / (1 + np.exp(-np.clip(r @ net["b"] + net["b0"], -30, 30))) - t) / len(t)
        back = np.outer(e, net["b"]) * (h > 0)
        grad = {"a": z.T @ back + decay * net["a"], "a0": back.sum(0), "b": r.T @ e + decay * net["b"], "b0": e.sum()}
        for k, g in grad.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net[k] = net[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    raw = forward(net, x[apart])
    loss = lambda s: np.mean(np.logaddexp(0, raw / s) - y[apart] * raw / s)
    net["t"] = min(np.geomspace(0.3, 10, 60), key=loss) if apart.any() else 1.0
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[Vectors, dict]:
    """Word vectors and network from a bounded sample of the labelled rows of docs."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("l_id"), F.col(label).alias("y")).where("y is not null").groupBy("l_id").agg(F.min("y").alias("y"))
    known = bounded(known, "l_id", sample)
    rows = docs.select(F.col(doc_id).alias("l_id"), F.col(text).alias("text")).join(F.broadcast(known), "l_id")  # sample rows at most
    rows, _ = cut(rows.groupBy("l_id").agg(F.min("text").alias("text"), F.min("y").cast("double").alias("y")), "sample")
    vectors = word_vectors(rows)
    got = pooled(spark, rows.select("l_id", "y", "text"), vectors, "x binary", lambda x: pa.array([v.tobytes() for v in x], pa.binary())).toArrow().sort_by("l_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype=np.float64).reshape(-1, SIZE + 2)
    return vectors, train(x, got.column("y").to_numpy())


def pooled(spark: SparkSession, rows: DataFrame, vectors: Vectors, field: str, made, text: str = "text", last: bool = True) -> DataFrame:
    """rows, without text if last, with a field that made() derives from the pooled vectors of their texts."""
    shared = vectors.shared(spark)
    name = field.split()[0]
    keep = [c for c in rows.columns if not (last and c == text) and c != name]

    def run(batches):
        pool = Vectors(*shared.value)
        for b in batches:
            x = np.stack([pool(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]) if len(b) else np.zeros((0, SIZE + 2))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], made(x)], [*keep, name])

    return rows.mapInArrow(run, rows.select(*keep).schema.add(*field.split()))


def score(docs: DataFrame, model: tuple[Vectors, dict], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out, the calibrated probability of label 1, in place of any of that name."""
    vectors, net = model
    return pooled(docs.sparkSession, docs, vectors, f"{out} double", lambda x: pa.array(1 / (1 + np.exp(-np.clip(forward(net, x) / net["t"], -30, 30))), pa.float64()), text=text, last=False)
