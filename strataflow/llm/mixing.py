"""Mixing sources to target weights, by hierarchical budgeting, in the JVM.

The tree has a level for each column (domain, language, source). A node's budget goes to its children by
their weights; a child that has too little gives the rest to its siblings, and only what all of them
together cannot fill leaves for the ancestors' other children: the children's capacities are summed up
the tree first, then each level is filled from the top (water-filling in closed form: children ordered
by capacity over weight, with running sums).

A leaf's budget is spent in epochs: whole ones, then a prefix of one more, in an order seeded by epoch. The
prefix is found step by step, so that no task sorts a leaf: tokens are summed by the first digits (DIGITS) of the
order's hash, then by more of them inside the one bucket that the prefix ends in, and only the documents of the
last such bucket, one in 16 million of a leaf, are put in order.

Null level values are nodes of their own; null texts and texts without words have no tokens and are never taken;
repeated rows are taken or left together if all is equal, and count each (as rows whose hashes tie and whose ids are the
same); an empty table gives no rows; a long text counts with all its words, and one that is longer than what is left
of a budget ends the prefix. Columns of the input under names of the operator's own give way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

DIGITS = (3, 6)
TREE = {
    "domain": "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4, 0))",
    "language": "coalesce(lang, '')",
    "source": "coalesce(source, '')",
}
#: Relative weight of a node by level and value; 1 if not listed.
WEIGHTS = {"domain": {"d0": 2, "d1": 3, "d2": 3, "d3": 2}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
SHARE, EPOCHS, SEED = 0.5, 3, "7"


def tokens(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order(doc_id: Column, epoch: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def weight(name: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, float(v)).otherwise(out)
    return out


def filled(nodes: DataFrame, parents: list[str], name: str, weights: dict[str, float]) -> DataFrame:
    """nodes (parents, name, capacity, budget of the parent) with budget: the child's own share, rounded down."""
    nodes = nodes.withColumn("w", weight(name, weights)).withColumn("ratio", F.col("capacity") / F.col("w"))
    by = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    before = by.orderBy("ratio", name).rowsBetween(W.unboundedPreceding, -1)
    rest_w = F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rest_b = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    nodes = nodes.withColumn("rest_w", rest_w).withColumn("rest_b", rest_b).withColumn("full", F.col("capacity") * F.col("rest_w") <= F.col("rest_b") * F.col("w"))
    # those before the first that the level does not fill are full; the others share what is left by weight
    first = F.min(F.when(~F.col("full"), F.col("ratio"))).over(by)
    level = F.max(F.when(~F.col("full") & (F.col("ratio") == first), F.col("rest_b") / F.col("rest_w"))).over(by)
    own = F.when(F.col("full") | level.isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), level * F.col("w")))
    return nodes.withColumn("budget", F.floor(own).cast("long")).drop("w", "ratio", "rest_w", "rest_b", "full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: Column) -> DataFrame:
    """leaves (levels, tokens, capacity) with budget. total: of the root, a Column over the sum of tokens."""
    caps = leaves.groupBy(*levels).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    above = caps.agg(total.cast("long").alias("parent_budget"), F.sum("capacity").alias("all")).withColumn("parent_budget", F.least("parent_budget", "all")).drop("all")
    out = None
    for i, name in enumerate(levels):
        at = levels[: i + 1]
        nodes = caps.groupBy(*at).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.crossJoin(F.broadcast(above)) if out is None else nodes.join(out.select(*levels[:i], F.col("budget").alias("parent_budget")), levels[:i])  # above is one row
        out = filled(nodes, levels[:i], name, weights.get(name, {})).drop("parent_budget", "capacity")
    return out.join(caps, levels)


def mix(
    docs: DataFrame,
    tree: dict[str, str] = TREE,
    weights: dict[str, dict[str, float]] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents taken: the tree's levels (mix_..), mix_tokens, n_copies (how often each is taken), and the columns
    keep, of which those under any of these names give way.

    share: of all tokens that the mix is to have; epochs: how often a document may be taken at most."""
    levels = [f"_{k}" for k in tree]
    made = {f"mix{n}" for n in levels} | {"mix_tokens", "n_copies"}
    keep = [doc_id] if keep is None else [c for c in keep if c not in made]
    rows = docs.select(*[F.expr(e).alias(n) for n, e in zip(levels, tree.values())], tokens(F.col(text)).alias("_tokens"), F.col(doc_id).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    slim = docs.select(*[F.expr(e).alias(n) for n, e in zip(levels, tree.values())], tokens(F.col(text)).alias("tokens"), F.col(doc_id).alias("_id")).where("tokens > 0")
    slim, _ = cut(slim, "tokens")  # a few narrow columns, read four times
    leaves = slim.groupBy(*levels).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * epochs)
    named = {lv: weights.get(k, {}) for lv, k in zip(levels, tree)}
    plan = budgets(leaves, levels, named, F.floor(F.sum("tokens") * F.lit(share)))
    plan, _ = cut(plan.select(*levels, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")), "budgets")

    inner = slim.join(plan, levels).select(*levels, "tokens", "_id", "whole", "rest", order(F.col("_id"), F.col("whole"), seed).alias("h"), F.lit(0).cast("long").alias("base"))
    for digits in DIGITS:
        bucket = F.substring("h", 1, digits).alias("b")
        sums = inner.groupBy(*levels, bucket).agg(F.sum("tokens").alias("t"), F.any_value("rest").alias("rest"), F.any_value("base").alias("base"))
        run = F.col("base") + F.sum("t").over(W.partitionBy(*levels).orderBy("b"))
        edge = sums.withColumn("upto", run).where(F.expr("upto > rest and upto - t <= rest")).select(*levels, "b", (F.col("upto") - F.col("t")).alias("base"))
        edge, _ = cut(edge, "edges")
        inner = inner.drop("base").withColumn("b", bucket).join(edge, [*levels, "b"]).drop("b")
        inner, _ = cut(inner, "inner")  # a 4096th of the rows at most, for evenly spread hashes
    last = F.sum("tokens").over(W.partitionBy(*levels).orderBy("h", "_id").rangeBetween(W.unboundedPreceding, 0))
    ends = inner.withColumn("upto", last + F.col("base")).where("upto <= rest").groupBy(*levels).agg(F.max("h").alias("end"))
    ends = edge.join(ends, levels, "left").select(*levels, F.coalesce("end", F.concat("b", F.lit(" "))).alias("end"))
    spent, _ = cut(plan.join(ends, levels, "left").select(*levels, "whole", "end"), "plan")

    more = F.coalesce(order(F.col("_id"), F.col("whole"), seed) <= F.col("end"), F.lit(False)).cast("long")
    if keep == [doc_id]:
        rows = slim.withColumnRenamed("tokens", "_tokens").withColumn("_keep0", F.col("_id"))
    taken = rows.where("_tokens > 0").join(spent, levels).withColumn("n_copies", F.col("whole") + more).where("n_copies > 0")
    return taken.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], *[F.col(n).alias(f"mix{n}") for n in levels], F.col("_tokens").alias("mix_tokens"), "n_copies")
