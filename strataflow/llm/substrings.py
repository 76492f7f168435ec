"""Removal of repeated substrings, by a depth-limited radix sort of suffixes.

A byte goes if a LENGTH-byte string (a window) that also starts elsewhere covers it. Windows are suffixes cut at depth
LENGTH, put in order by digits: the first passes deal them out to buckets across the cluster, the others go through
a bucket most significant digit first, DIGIT bytes at a time; a suffix alone in its group drops out after each pass,
and the groups left at depth LENGTH are exactly the repeated windows.

A pass that shuffled a key for every byte could not fit a few times the input, so the digit of the first pass is not at
a fixed place: it is the window's least GRAM bytes by hash (leftmost on ties), which windows that overlap share. The
windows around one such gram, a stretch, travel as one row; as the digit is chosen by the window's bytes alone, equal
windows meet in one bucket with the gram at the same distance.

Pass 1, digit of GRAM bytes: stretches whose gram occurs once drop out, counted by partial aggregates.
Pass 2, whole stretches as digits (a 128-bit cryptographic digest): those that occur again are repeated entirely.
Passes 3 to 10, in buckets with different stretches: the windows of one stretch of each kind, by gram and its distance,
then by LENGTH / DIGIT digits of their own; at the end the bytes of each group are compared, so no hash decides.
A bucket of over GROUP different stretches is not gathered: its windows are counted one by one, by the digest of all
their digits at once, with hash aggregates.

Null texts are empty; texts under LENGTH bytes keep everything; an empty table gives no rows; long texts are worked on
in pieces but whole; documents are told apart by id and a hash of the text, and rows equal in both are repeats of each
other, each with its own result (of equal windows none stays). Only the named columns are read."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTH, GRAM, DIGIT, GROUP, PIECE, SEED = 400, 64, 50, 20_000, 1 << 20, 3
AT_BITS, STEP = 24, 8000
RNG = np.random.default_rng(SEED)
BYTES = RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every size consecutive bytes, put together from those of powers of two."""
    power = np.array([BASE], dtype=np.uint64)  # an array: it wraps around without a warning
    part, width, whole, done = BYTES[data], 1, None, 0
    while True:
        if size & width:
            if whole is None:
                whole, done = part, width
            else:  # what is done so far, then this part
                n = len(data) - done - width + 1
                whole, done = whole[:n] * power + part[done : done + n], done + width
        if width * 2 > size:
            break
        part, width, power = part[:-width] * power + part[width:], width * 2, power * power
    whole = whole ^ (whole >> np.uint64(29))
    whole = whole * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(32))


def digest(part: bytes, place: int = 0) -> bytes:
    """128 bits of a cryptographic hash: nobody can write texts that meet in it."""
    return hashlib.blake2b(part, digest_size=16, salt=place.to_bytes(8, "little")).digest()


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every size consecutive values."""
    width = 1
    while width * 2 <= size:
        values, width = np.minimum(values[:-width], values[width:]), width * 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts data[start:end]: (text number, suffix, first window, last window, gram hash) of each suffix taken."""
    empty = np.empty(0, np.int64)
    long = np.nonzero(ends - starts >= LENGTH)[0]
    if not len(long):
        return empty, empty, empty, empty, empty
    grams = rolled(data, GRAM)
    mask = np.uint64((1 << AT_BITS) - 1)
    at = least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1) & mask
    counts = ends[long] - starts[long] - LENGTH + 1
    first = np.cumsum(counts) - counts
    windows = np.repeat(starts[long] - first, counts) + np.arange(counts.sum())
    text = np.repeat(long, counts)
    suffix = at[windows].astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (suffix[1:] != suffix[:-1]) | (text[1:] != text[:-1])
    lo = np.nonzero(new)[0]
    hi = np.append(lo[1:], len(windows)) - 1
    return text[lo], suffix[lo], windows[lo], windows[hi], grams[suffix[lo]]


def pieces(texts: list[bytes]):
    """(numbers, offsets, starts, ends, data): texts put together up to about PIECE bytes; a longer one comes in
    overlapping parts, so that each of its windows is whole in one of them."""
    held, size = [], 0

    def out():
        data = np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8)
        ends = np.cumsum([len(x[2]) for x in held])
        return [x[0] for x in held], [x[1] for x in held], ends - [len(x[2]) for x in held], ends, data

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 1), PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def encoded(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def suffixes(batches):
    """(doc_id, rid, text) to (doc_id, rid, key, stretch, lo, hi, at)."""
    names = ["doc_id", "rid", "key", "stretch", "lo", "hi", "at"]
    for b in batches:
        for numbers, offsets, starts, ends, data in pieces(encoded(b.column(2))):
            text, suffix, lo, hi, key = stretches(data, starts, ends)
            raw = data.tobytes()
            sup = [digest(raw[a : z + LENGTH], s - a) for a, z, s in zip(lo.tolist(), hi.tolist(), suffix.tolist())]
            row = np.asarray(numbers)[text] if len(text) else np.empty(0, np.int64)
            shift = np.asarray(offsets)[text] - starts[text] if len(text) else np.empty(0, np.int64)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(key.astype(np.uint64).view(np.int64), pa.int64()), pa.array(sup, pa.binary()), *(pa.array(x + shift, pa.int64()) for x in (lo, hi, suffix))], names)


def contexts(batches):
    """(doc_id, rid, text, parts) to a row for each part with its bytes."""
    names = ["doc_id", "rid", "key", "copies", "lo", "at", "bytes"]
    for b in batches:
        parts = b.column(3)
        inner, ends = parts.values, parts.offsets.to_numpy()
        row = np.repeat(np.arange(len(b)), np.diff(ends))
        picked = inner.slice(ends[0], ends[-1] - ends[0])
        texts = encoded(b.column(2))
        lo, hi = picked.field("lo").to_numpy(), picked.field("hi").to_numpy()
        for k in range(0, len(row), 20_000):
            s = slice(k, k + 20_000)
            take = pa.array(row[s])
            got = [texts[r][a : z + LENGTH] for r, a, z in zip(row[s].tolist(), lo[s].tolist(), hi[s].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(picked.field(c).slice(k, len(got)) for c in ("key", "copies", "lo", "at")), pa.array(got, pa.binary())], names)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the joined texts, text number, place in the text) of every window."""
    sizes = np.array([len(t) for t in texts])
    counts = sizes - LENGTH + 1
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.cumsum(sizes) - sizes, counts) + place, text, place


def radix(data: np.ndarray, windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number among windows, group) of the windows (places in data) that are not alone in their group at depth LENGTH.
    Passes go from the first digit to the last; a group is numbered by the order of its windows so far."""
    digits = rolled(data, DIGIT)
    active = np.arange(len(windows))
    for at in range(0, LENGTH, DIGIT):
        key = digits[windows[active] + at] ^ (group.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(key)
        key = key[order]
        number = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
        shared = np.bincount(number)[number] > 1
        active, group = active[order[shared]], number[shared]
    return active, group


def confirmed(raw: bytes, windows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the windows have another one of equal bytes in their group. The bytes are compared run by run with those of
    the group's first window; only where a comparison fails are windows looked at one by one."""
    if not len(windows):
        return np.zeros(0, bool)
    first = np.full(group.max() + 1, len(raw))
    np.minimum.at(first, group, windows)
    order = np.argsort(windows)
    at, like = windows[order], first[group[order]]
    lo = np.nonzero(np.append(True, (at[1:] != at[:-1] + 1) | (like[1:] != like[:-1] + 1)))[0]
    sizes = np.diff(np.append(lo, len(at))) + LENGTH - 1
    same = [raw[a : a + n] == raw[b : b + n] for a, b, n in zip(at[lo].tolist(), like[lo].tolist(), sizes.tolist())]
    out = np.ones(len(windows), bool)
    if not all(same):
        odd = np.isin(group, np.unique(np.concatenate([group[order[a : a + n - LENGTH + 1]] for a, n, s in zip(lo, sizes, same) if not s])))
        told = [(g, raw[w : w + LENGTH]) for g, w in zip(group[odd].tolist(), windows[odd].tolist())]
        counts = Counter(told)
        out[odd] = [counts[x] > 1 for x in told]
    return out


def runs(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of runs of consecutive places."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    lo = np.nonzero(new)[0]
    return text[lo], place[lo], place[np.append(lo[1:], len(text)) - 1] if len(text) else place


def settled(batches):
    """Lists of a group's stretches to (doc_id, rid, lo, stop): what repeats of those that occur once as a whole."""
    for b in batches:
        lists = b.column(0)
        ends = lists.offsets.to_numpy()
        inner = lists.values.slice(ends[0], ends[-1] - ends[0])
        group = np.repeat(np.arange(len(b)), np.diff(ends))
        at = 0
        while at < len(group):  # whole groups up to some STEP stretches, or one group
            stop = np.searchsorted(group, group[min(at + STEP, len(group)) - 1], "left") if at + STEP < len(group) else len(group)
            stop = stop if stop > at else np.searchsorted(group, group[at], "right")
            part = inner.slice(at, stop - at)
            lo = part.field("lo").to_numpy()
            texts = part.field("bytes").to_pylist()
            windows, text, place = windows_of(texts)
            raw = b"".join(texts)
            far = (part.field("at").to_numpy() - lo)[text] - place
            met, numbers = radix(np.frombuffer(raw, dtype=np.uint8), windows, (group[at:stop] - group[at])[text] * LENGTH + far)
            met = met[confirmed(raw, windows[met], numbers)]
            keep = np.sort(met[part.field("copies").to_numpy()[text[met]] == 1])
            text, first, last = runs(text[keep], place[keep])
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.field("doc_id").take(take), part.field("rid").take(take), pa.array(lo[text] + first, pa.int64()), pa.array(lo[text] + last + LENGTH, pa.int64())], ["doc_id", "rid", "lo", "stop"])
            at = stop


def single_windows(batches):
    """Stretches to a row (doc_id, rid, key, far, hash, lo, copies) for each window."""
    for b in batches:
        for r in range(len(b)):
            doc, rid, key, copies, lo, at, text = (b.column(i)[r].as_py() for i in range(7))
            n = len(text) - LENGTH + 1
            hashes = [digest(text[i : i + LENGTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array([r] * n)) for i in (0, 1, 2)] + [pa.array([at - lo - i for i in range(n)], pa.int64()), pa.array(hashes, pa.binary()), pa.array([lo + i for i in range(n)], pa.int64()), pa.array([copies] * n, pa.int64())], ["doc_id", "rid", "key", "far", "hash", "lo", "copies"])


def cleaned(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed)."""
    kept, at, n, removed = [], 0, 0, 0
    last = -1
    for lo, stop in sorted(spans):
        if lo > last:
            n += 1
            kept.append(text[at:lo])
            removed -= lo
        else:
            removed -= last
        last = at = max(last, stop)
        removed += last
    kept.append(text[at:])
    return b"".join(kept), removed, n


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(source, spans): source has doc_id, rid (a hash of the text) and text for each row of docs; spans has doc_id, rid,
    and spans array<struct<lo, stop>> of repeated bytes, overlapping as they may."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rid"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    found, _ = cut(source.mapInArrow(suffixes, f"doc_id {kind}, rid long, key long, stretch binary, lo long, hi long, at long"), "suffixes")
    whole = found.groupBy("key", "stretch").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid", "lo", "hi", "at")).alias("one"))
    grams = whole.groupBy("key").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    whole, _ = cut(whole.join(grams, "key").select("key", "stretch", "copies", "kinds", "one"), "stretches")

    again = whole.where("copies > 1").select("key", "stretch")
    spans = found.join(again, ["key", "stretch"], "left_semi").select("doc_id", "rid", "lo", (F.col("hi") + LENGTH).alias("stop"))

    def texts_with(rows: DataFrame, how: str, column: str) -> DataFrame:
        right = rows.select(F.col("doc_id").alias("r_id"), F.col("rid").alias("r_rid"), column)
        return source.join(right, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("rid") == F.col("r_rid")), how).select("doc_id", "rid", "text", column)

    parts = whole.where("kinds > 1").select("one.doc_id", "one.rid", F.struct("key", "copies", "one.lo", "one.hi", "one.at", "kinds").alias("part"))
    by_doc = parts.groupBy("doc_id", "rid").agg(F.collect_list("part").alias("parts"))
    once = texts_with(by_doc, "inner", "parts")
    bytes_of = once.mapInArrow(contexts, f"doc_id {kind}, rid long, key long, copies long, lo long, at long, bytes binary")
    large = whole.where(F.col("kinds") > group).select("key").distinct()
    if not large.isEmpty():
        bytes_of, _ = cut(bytes_of, "contexts")
        large, _ = cut(large, "large")
        each = bytes_of.join(large, "key", "left_semi").select(*bytes_of.columns).mapInArrow(single_windows, f"doc_id {kind}, rid long, key long, far long, hash binary, lo long, copies long")
        each, _ = cut(each, "windows")
        twice = each.groupBy("key", "far", "hash").count().where("count > 1").select("key", "far", "hash")
        spans = spans.union(each.where("copies = 1").join(twice, ["key", "far", "hash"], "left_semi").select("doc_id", "rid", "lo", (F.col("lo") + LENGTH).alias("stop")))
        bytes_of = bytes_of.join(large, "key", "left_anti")
    lists = bytes_of.groupBy("key").agg(F.collect_list(F.struct("doc_id", "rid", "copies", "lo", "at", "bytes")).alias("all")).select("all")
    spans = spans.union(lists.mapInArrow(settled, f"doc_id {kind}, rid long, lo long, stop long"))
    return source, spans.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("lo", "stop")).alias("spans"))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256): a row for each row of docs."""
    source, spans = repeated(docs, doc_id, text, group)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for t, s in zip(encoded(b.column(1)), b.column(2).to_pylist()):
                kept, removed, n = cleaned(t, [(x["lo"], x["stop"]) for x in s or []])
                out.append((len(t), removed, n, kept, hashlib.sha256(kept).hexdigest()))
            cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    right = spans.select(F.col("doc_id").alias("r_id"), F.col("rid").alias("r_rid"), "spans")
    joined = source.join(right, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("rid") == F.col("r_rid")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
