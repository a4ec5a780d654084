"""Mixing to target weights by hierarchical budgeting over a domain - language - source tree.

A token budget runs down the tree. Among siblings it is shared by weight; a node never gets more than
it can give, `max_epochs` times the tokens below it, and what it cannot take goes to its siblings by
their weights. As a node's own bound is the sum of its leaves' bounds, a shortage is met by siblings
first and reaches the ancestors' siblings only when the whole branch is exhausted. Shares are whole
tokens, rounded down.

A leaf reads its documents in seeded epochs: in epoch k they are ordered by md5(seed:k:id). Whole
epochs are taken as long as the share lasts; of the last one the longest prefix within the rest.

Scale: siblings are shared out by windows over the tree's nodes, never over documents. The prefix of a
leaf is found in two steps, so a leaf with a third of all documents is never in one task: documents
fall into ranges of their hash, about RANGE documents each; the ranges' sums are accumulated per leaf,
and only the one range in which the budget ends is accumulated document by document.

Rows: a null text has no tokens. Null languages, sources or domains are the name ''. Documents with
equal keys (repeated rows, null ids) are taken or left together. Nodes without a weight have weight 1;
a weight of 0 takes nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.llm.shared import BREAK, settled

TREE = ("domain", "language", "source")
RANGE = 4096


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")).cast("long")


def shared_out(nodes: DataFrame, above: list[str], name: str) -> DataFrame:
    """Share each parent's `budget` among its children: nodes (above.., name, most, weight, budget) get `share`.

    Children are ordered by most / weight. Those at the front that would get more than they can give
    are full; the others divide what is left by weight.
    """
    siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(F.try_divide(F.col("most"), F.col("weight")).asc_nulls_last(), name).rowsBetween(Window.unboundedPreceding, -1)
    done, gone = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = F.col("most") * (F.sum("weight").over(siblings) - gone) <= F.col("weight") * (F.col("budget") - done)
    full = F.when(full & (F.col("weight") > 0), 1).otherwise(0)
    rest = F.col("budget") - F.sum(F.col("full") * F.col("most")).over(siblings)
    weights = F.sum((1 - F.col("full")) * F.col("weight")).over(siblings)
    return (
        nodes.withColumn("full", full).withColumn("rest", rest).withColumn("weights", weights)
        .withColumn("share", F.when(F.col("full") == 1, F.col("most")).otherwise(
            F.coalesce(F.expr("(weight * rest) div nullif(weights, 0)"), F.lit(0))))
        .drop("full", "rest", "weights")
    )


def leaf_shares(leaves: DataFrame, weights: DataFrame, budget: DataFrame, max_epochs: int) -> DataFrame:
    """Leaves (domain, language, source, docs, tokens) with their `share` of the one-row table `budget` (budget).

    `weights` has (domain, language, source, weight): language or source null for the nodes above leaves.
    """
    table = leaves.withColumn("most", F.col("tokens") * max_epochs)
    given = F.col("budget")
    for depth, name in enumerate(TREE):
        path, above = list(TREE[: depth + 1]), list(TREE[:depth])
        own = weights.filter(F.col(name).isNotNull())
        for lower in TREE[depth + 1 :]:
            own = own.filter(F.col(lower).isNull())
        own = own.groupBy(*path).agg(F.max("weight").cast("bigint").alias("weight"))
        nodes = table.groupBy(*path).agg(F.sum("most").alias("most")).join(own, path, "left").fillna(1, ["weight"])
        if depth == 0:
            nodes = nodes.withColumn("only", F.lit(0)).join(budget.select(F.lit(0).alias("only"), given.cast("bigint")), "only").drop("only")
        else:
            nodes = nodes.join(shares.withColumnRenamed("share", "budget"), above)  # noqa: F821
        shares = shared_out(nodes, above, name).select(*path, "share")
    return leaves.join(shares, list(TREE))


def mixed(
    docs: DataFrame, weights: DataFrame, domain: Column, budget_percent: int = 100, max_epochs: int = 3, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """(id, domain, language, source, n_tokens, epoch): one row per document and epoch in which it is taken.

    The budget is `budget_percent` percent of all tokens in the table.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = settled(
        docs.select(
            F.col(id_column).alias("id"), named(domain).alias("domain"), named(F.col(language_column)).alias("language"),
            named(F.col(source_column)).alias("source"), word_count(F.col(text_column)).alias("n_tokens"),
        )
    )
    leaves = rows.groupBy(*TREE).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    budget = leaves.agg(F.expr(f"sum(tokens) * {int(budget_percent)} div 100").alias("budget"))
    shares = leaf_shares(leaves, weights, budget, max_epochs)
    plan = settled(
        shares.select(
            *TREE, "docs", F.expr("coalesce(share div nullif(tokens, 0), 0)").alias("whole"),
            F.expr("coalesce(share % nullif(tokens, 0), 0)").alias("rest"),
        )
    )
    drawn = rows.join(plan, list(TREE))
    full = drawn.filter("whole > 0").select("id", *TREE, "n_tokens", F.explode(F.expr("sequence(0L, whole - 1)")).alias("epoch"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    high = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    ranges = F.shiftright(high * F.greatest(F.lit(1), F.expr(f"least(docs div {RANGE}, 2147483647)")), 32)
    partial = drawn.filter("rest > 0").withColumn("key", key).withColumn("range", ranges)
    sums = partial.groupBy(*TREE, "range").agg(F.sum("n_tokens").alias("inside"), F.max("rest").alias("rest"))
    before = Window.partitionBy(*TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).filter("before <= rest").drop("rest")
    near = partial.join(sums, [*TREE, "range"])
    whole_ranges = near.filter("before + inside <= rest")
    upto = Window.partitionBy(*TREE, "range").orderBy("key", F.col("id").asc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last_range = near.filter("before + inside > rest").withColumn("sum", F.sum("n_tokens").over(upto)).filter("before + sum <= rest")
    columns = ["id", *TREE, "n_tokens", F.col("whole").alias("epoch")]
    return full.union(whole_ranges.select(*columns)).union(last_range.select(*columns))


def drawn(
    docs: DataFrame, weights: DataFrame, domain: Column, budget_percent: int = 100, max_epochs: int = 3, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """The rows of `docs`, as they are, once for every epoch in which they are taken, with the epoch as `epoch`.

    An own column called `epoch` is replaced.
    """
    taken = mixed(
        docs, weights, domain, budget_percent, max_epochs, seed, id_column, text_column, language_column, source_column
    ).select("id", *TREE, "epoch").distinct()
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("own_id"),
        named(domain).alias("own_domain"), named(F.col(language_column)).alias("own_language"), named(F.col(source_column)).alias("own_source"),
    )
    same = F.col("own_id").eqNullSafe(F.col("id"))
    for name in TREE:
        same = same & (F.col(f"own_{name}") == F.col(name))
    columns = [c for c in docs.columns if c != "epoch"]
    return rows.join(taken, same).select(*(F.col("row")[c].alias(c) for c in columns), "epoch")
