"""Benchmark decontamination by winnowing, in the JVM.

A window is WINDOW consecutive words of a benchmark item (a shorter item is one window). Of every WINDOW words,
the least of its GRAM-word hashes is kept, so a text that holds a whole window of an item shares that window's
kept hash with it: joining the kept hashes finds every document with a hit. Only these documents are looked
at again: their windows are compared with the items' word by word (no hash decides), and hits extended by word positions.

Every row of the input has its row in the result, repeated ones too. Null texts and texts without words have no
windows and no hits; an empty table gives no rows, no items no hits; items without id are left out; repeated items
count once, items that share a window are each found. Long texts are read whole. Only the named columns are read, so
others may have any name. The benchmark side is broadcast only after its rows (and the items in them) are counted;
beyond the bound the joins shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, let, maybe_broadcast

WINDOW, GRAM = 8, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: letters and digits of ASCII and all other code points; only A-Z is lower-cased."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, BETWEEN), "")


def hashed(text: Column) -> Column:
    """A hash for each word of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def grams(hashes: Column, n: int, size: int) -> Column:
    """Hashes of every n consecutive values (that of an array of them); none if there are fewer. Values are picked one by
    one: a slice would be a new array for each."""
    count = F.size(hashes)
    all_of = F.transform(F.sequence(F.lit(0), count - n), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(n)]))
    return F.when(count >= n, all_of).otherwise(F.array().cast("array<bigint>"))


def kept(hashes: Column, short: list[int]) -> Column:
    """The least GRAM-hash of every WINDOW consecutive words, each once; and all hashes of the lengths in short."""
    none = F.array().cast("array<bigint>")

    def least(g: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.least(*[F.get(g, i + k) for k in range(WINDOW - GRAM + 1)])))

    main = F.when(F.size(hashes) >= WINDOW, let(grams(hashes, GRAM, WINDOW), least)).otherwise(none)
    return F.concat(main, *[grams(hashes, n, n) for n in short]) if short else main


def windows(cut_words: Column, lengths: list[int]) -> Column:
    """array<struct<length, at, w>> of every run of so many words; at: its first word from 1; w: the words, between which
    a space is unambiguous, as no word has one."""

    def run(n: int) -> Column:
        def one(i: Column) -> Column:
            return F.struct(F.lit(n).alias("length"), i.alias("at"), F.array_join(F.slice(cut_words, i, n), " ").alias("w"))

        every = F.transform(F.sequence(F.lit(1), F.size(cut_words) - (n - 1)), one)
        return F.when(F.size(cut_words) >= n, every).otherwise(F.array().cast("array<struct<length:int,at:int,w:string>>"))

    return F.concat(*[run(n) for n in lengths])


def times(rows: DataFrame, n: str, block: int = 10_000) -> DataFrame:
    """Each row of rows n times (a positive column, dropped), by arrays of limited size however often that is."""
    a, b, some = fresh(rows, "block"), fresh(rows, "within"), F.col(n)
    out = rows.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((some - 1) / block))))
    last = F.least(F.lit(block).cast("long"), some - F.col(a) * block) - 1
    return out.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(a, b, n)


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, rid, n_words, n_hit, items array<string>) for every row of docs; rid: a hash of the text, by which rows of
    one id are told apart."""
    bench = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0")
    bench, _ = cut(bench.distinct(), "items")
    short = sorted(r.n for r in bench.where(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect())  # at most 7 rows
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", F.xxhash64(F.coalesce("text", F.lit(""))))
    none = F.array().cast("array<bigint>")

    own_hashes = bench.select(F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    own_keys = F.when(F.size("hashes") >= WINDOW, kept(F.col("hashes"), [])).otherwise(F.array(F.xxhash64(F.size("hashes"), "hashes")))
    keys, _ = cut(own_hashes.select(F.explode(own_keys).alias("k")).distinct().withColumn("hit", F.lit(True)), "keys")
    both = let(hashed(F.col("text")), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), F.coalesce(kept(h, short), none).alias("kept")))
    marks = source.select("doc_id", "rid", both.alias("both")).select("doc_id", "rid", "both.n_words", F.posexplode_outer("both.kept").alias("place", "k"))
    met = marks.join(maybe_broadcast(keys), "k", "left")
    # a row of docs has one first mark, even if it has no key: their number is that of equal rows
    stat = met.groupBy("doc_id", "rid", "n_words").agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"), F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("copies"))
    stat, _ = cut(stat, "marks")

    some = maybe_broadcast(stat.where("hit").select(F.col("doc_id").alias("c_id"), F.col("rid").alias("c_rid")))
    again = source.join(some, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("rid") == F.col("c_rid")), "left_semi")
    whole = F.least(F.size("words"), F.lit(WINDOW))
    own = bench.select("item", whole.alias("whole"), F.inline(windows(F.col("words"), [*short, WINDOW]))).where("length = whole")
    own, _ = cut(own.groupBy("length", "w").agg(F.collect_set("item").alias("items")), "windows")
    runs = again.select("doc_id", "rid", F.inline(let(words(F.col("text")), lambda w: windows(w, [*short, WINDOW]))))
    exact = runs.join(maybe_broadcast(own, weight=F.size("items")), ["length", "w"])
    got = exact.groupBy("doc_id", "rid").agg(
        F.array_sort(F.collect_set(F.struct("at", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )

    def step(acc: Column, x: Column) -> Column:
        stop = x["at"] + x["length"]
        more = F.greatest(F.lit(0), stop - F.greatest(x["at"], acc["stop"]))
        return F.struct(F.greatest(acc["stop"], stop).alias("stop"), (acc["n"] + more).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("stop"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    got = got.select(F.col("doc_id").alias("g_id"), F.col("rid").alias("g_rid"), covered.cast("long").alias("n_hit"), "items")
    joined = stat.join(got, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("rid") == F.col("g_rid")), "left")
    out = joined.select("doc_id", "rid", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "copies")
    return times(out, "copies")


def clean(docs: DataFrame, items: DataFrame, least_items: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold windows of at least so many items; columns stay as they were."""
    a, b = fresh(docs, "bad_id"), fresh(docs, "bad_rid")
    bad = hits(docs, items, doc_id, text).where(F.size("items") >= least_items).select(F.col("doc_id").alias(a), F.col("rid").alias(b)).distinct()
    bad, _ = cut(bad, "bad")
    same = F.col(doc_id).eqNullSafe(F.col(a)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(b))
    return docs.join(maybe_broadcast(bad), same, "left_anti")
