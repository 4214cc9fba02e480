"""Mixing sources to target weights by hierarchical budgets.

Sources hang in a tree of domain, language and source. A token budget is handed down: each
group shares what it gets among its children by weight, but none gets more than it has in its
epochs; what a child cannot take goes to its siblings, and only what all of them cannot take
is lost to the group, so that the level above shares it out among the groups there. A leaf
takes the prefix of its seeded epochs that fits its budget: whole epochs, then the first
documents of the next one in an order given by a hash of seed, epoch and id.

Defined cases. Nulls in the tree columns are the group ``(none)``. A null or empty text has no
tokens and comes with every whole epoch, and with a prefix that passes it. Groups without a
weight in the table have weight 1. Repeated rows are taken together. A budget above what all epochs
hold takes all. An empty table gives an empty table. Ids may be null.

The tree is a table with a row for each leaf; leaves are small in number next to documents, but
are only joined by shuffles, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.llm.common import store

LEVELS = ("domain", "lang", "source")
NONE = "(none)"


def tokens(text: Column) -> Column:
    """Number of words; spaces are blank, tab, and the line and page marks."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1).cast("long")


def domain_of(source: Column) -> Column:
    """The leading letters and digits of a source's name in two classes: even and odd numbers."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.when(number == "", F.lit(NONE)).otherwise(F.concat(F.lit("domain"), F.right(number, F.lit(1)).cast("int") % 2))


def share_out(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, float]) -> DataFrame:
    """Budgets of children from ``given`` (of their parent) and ``holds`` (their own supply).

    In order of supply for weight, a child is full when its share of what is left, by its weight
    among the children that are left, covers its supply. All later ones share the rest.
    """
    weight = F.lit(1.0)
    for key, value in weights.items():
        weight = F.when(F.col(name) == key, float(value)).otherwise(weight)
    nodes = nodes.withColumn("weight", weight)
    order = Window.partitionBy(*parent).orderBy(F.col("holds") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns(
        {
            "taken": F.coalesce(F.sum("holds").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(after),
        }
    )
    full = F.col("holds") * F.col("weight_left") <= F.col("weight") * (F.col("given") - F.col("taken"))
    nodes = nodes.withColumn("full", full)
    # Supplies for weight rise along the order, so the full ones come first.
    open_nodes = Window.partitionBy(*parent, "full")
    spent = F.sum(F.when(F.col("full"), F.col("holds")).otherwise(0)).over(Window.partitionBy(*parent))
    share = F.floor((F.col("given") - spent) * F.col("weight") / F.sum("weight").over(open_nodes))
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("holds")).otherwise(F.greatest(share, F.lit(0))).cast("long")).drop(
        "taken", "weight_left", "full", "weight"
    )


def budgets(leaves: DataFrame, total: Column, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """A row for each leaf: the tree columns, ``supply`` (one epoch) and ``budget``.

    ``leaves`` has the tree columns and ``supply``; ``total`` is the budget as an expression over
    ``supply``, the sum of all supplies.
    """
    held = leaves.withColumn("holds", F.col("supply") * epochs)
    given = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply")).select(total.cast("long")).first()[0]
    level = held.groupBy(LEVELS[0]).agg(F.sum("holds").alias("holds")).withColumn("given", F.lit(given))
    level = share_out(level, [F.lit(0)], LEVELS[0], weights.get(LEVELS[0], {}))
    for depth in range(1, len(LEVELS)):
        parent = list(LEVELS[:depth])
        above = level.select(*parent, F.col("budget").alias("given"))
        below = held.groupBy(*LEVELS[: depth + 1]).agg(F.sum("holds").alias("holds"))
        level = share_out(below.join(above, parent), parent, LEVELS[depth], weights.get(LEVELS[depth], {}))
    return held.select(*LEVELS, "supply").join(level.select(*LEVELS, "budget"), list(LEVELS))


def ticket(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    total: Column | None = None,
    epochs: int = 2,
    weights: dict[str, dict[str, float]] | None = None,
    seed: int = 7,
) -> DataFrame:
    """``doc_id``, tree columns, ``tokens`` and ``copies`` of every document; 0: not taken.

    ``total`` defaults to nine tenths of all tokens. No window runs over a leaf's documents: they
    are cut into 4096 classes by their ticket, sums of classes find the class where the prefix
    ends, and only that class is put in order.
    """
    total = F.floor(F.col("supply") * 9 / 10) if total is None else total
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source").cast("string")).alias("domain"),
        named("lang").alias("lang"), named("source").alias("source"), tokens(F.col("text").cast("string")).alias("tokens"),
    )
    rows = store(rows, "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    plan = budgets(leaves, total, epochs, weights or {})
    plan = plan.withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(1).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply"))
    plan = store(plan.select(*LEVELS, "whole", "rest"), "budgets")

    drawn = rows.join(plan, list(LEVELS)).withColumn("ticket", ticket(seed, F.col("whole"), F.col("doc_id")))
    drawn = drawn.withColumn("class", F.substring("ticket", 1, 3))
    key = [*LEVELS, "class"]
    sums = drawn.groupBy(*key).agg(F.sum("tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    drawn = drawn.join(sums, key)
    passed = F.col("before") + F.col("n") <= F.col("rest")
    ending = ~passed & (F.col("before") < F.col("rest"))
    cut = drawn.where(ending)
    inside = Window.partitionBy(*key).orderBy("ticket").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("extra", (F.col("before") + F.sum("tokens").over(inside) <= F.col("rest")).cast("long"))
    plain = drawn.where(~ending).withColumn("extra", passed.cast("long"))
    out = plain.unionByName(cut)
    return out.select("doc_id", *LEVELS, "tokens", (F.col("whole") + F.col("extra")).alias("copies"))
