"""Connected components of a link table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gantry.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of `links` (columns a and b, longs).

    Each round points every node to its smallest neighbour if that is smaller, follows these pointers to their ends by
    going two steps at a time, twice as far each time, and contracts the links to those between different ends: at least half of the nodes that still have
    links go in a round, and only what is left is joined again. Smallest neighbours are found before the shuffle; each
    round is written out.
    """
    edges = _between(links.select("a", "b"), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")), "pointers")
        while True:
            # two steps at a time: nothing is left to follow once the second one leads nowhere
            ends = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            far = ends.select(F.col("root").alias("next"), F.col("next").alias("far"))
            moved = materialise(step.join(ends, "root").join(far, "next").select("node", "next", F.col("far").alias("root")), "pointers")
            step = moved.select("node", "root")
            if moved.where("next <> root").isEmpty():
                break
        if roots is None:
            roots = step
        else:
            further = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = materialise(roots.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        of = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = _between(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), "links")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)


def _between(links: DataFrame, label: str) -> DataFrame:
    """Different links between different nodes, the smaller node first."""
    return materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
