"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import attached
from .scratch import pointed

#: Links that one task goes over at ease.
PART_LINKS = 200_000


def component_labels(links: DataFrame, a: str = "a", b: str = "b", name: str = "class") -> DataFrame:
    """(name, component) of every node that has a link; the component is its smallest node.

    Each round hooks every root to the smallest root beside it and then halves the paths, so that the
    number of rounds grows with the logarithm of the longest chain. Rounds end in written tables. Links are
    counted, and kept in as many partitions as they need: a few thousand are not dealt out at every step."""
    links = pointed(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    parts = -(-links.count() // PART_LINKS)
    fitted = (lambda df: df.coalesce(1)) if parts <= 1 else (lambda df: df)
    links = fitted(links)
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    labels = fitted(pointed(nodes.select("node", F.col("node").alias("root"))))
    edges = links
    while True:
        # Edges between roots; those inside a component are finished.
        ru, rv = labels.select(F.col("node").alias("u"), F.col("root").alias("ru")), labels.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        edges = edges.join(ru, "u").join(rv, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges = fitted(pointed(edges))
        if edges.isEmpty():
            return labels.select(F.col("node").alias(name), F.col("root").alias("component"))
        hook = edges.groupBy(F.col("v").alias("from")).agg(F.min("u").alias("to"))
        hook = _jumped(hook, fitted)
        labels = fitted(pointed(labels.join(hook, labels["root"] == hook["from"], "left").select("node", F.coalesce("to", "root").alias("root"))))


def joined_labels(labels: DataFrame, links: DataFrame, name: str = "line") -> DataFrame:
    """Labels (name, component) after more links (a, b): only the components that these join are labelled anew."""
    of = lambda x: labels.select(F.col(name).alias(x), F.col("component").alias(f"of_{x}"))
    between = attached(attached(links, of("a"), "a", "left"), of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    between = pointed(between.where("a != b"))
    if between.isEmpty():
        return labels
    now = pointed(component_labels(between, name="from").withColumnRenamed("component", "to"))
    moved = attached(labels, now, labels["component"] == now["from"], "left").select(name, F.coalesce("to", "component").alias("component"))
    new = now.join(labels, now["from"] == labels[name], "left_anti").select(F.col("from").alias(name), F.col("to").alias("component"))
    return pointed(moved.union(new))


def _jumped(hook: DataFrame, fitted) -> DataFrame:
    """Follows the hooks to their ends; they always lead to a smaller node."""
    hook = fitted(pointed(hook))
    while True:
        nxt = hook.select(F.col("from").alias("to"), F.col("to").alias("nxt"))
        moved = fitted(pointed(hook.join(nxt, "to", "left").select("from", F.coalesce("nxt", "to").alias("to"), F.col("nxt").isNotNull().alias("moved"))))
        hook = moved.select("from", "to")
        if moved.where("moved").isEmpty():
            return hook
