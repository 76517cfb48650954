"""Connected components of an undirected link table, by smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import drop, stash

ROUNDS = 60
BROADCAST_NODES = 250_000  # labels of up to so many counted nodes (16 bytes each) are broadcast; more are shuffled
ROWS = "count(1)"


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, one row per linked node, stashed.

    Every round takes the smallest label among a node and its neighbours, then the label of that
    label, so labels travel by doubling steps. Partial sums of min() meet a hot node's links before
    the shuffle; each round is written to the shared folder. A counted small graph joins its labels by broadcast, one
    shuffle a round; in a larger one a hot node's links or a large component's members are one side of a plain
    join with one row of labels on the other, which AQE splits."""
    both = stash(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", rows=ROWS)
    few = labels.seen["rows"] <= BROADCAST_NODES
    for _ in range(ROUNDS):
        known = F.broadcast(labels) if few else labels
        near = both.join(known.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        least = near.join(known.select("node", F.col("label").alias("old")), "node").select("node", "old", F.least("old", "seen").alias("label"))
        to = known.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = least.join(to, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        moved = stash(after, "labels", rows=ROWS, moved="count_if(old <> label)")
        drop(labels)
        if not moved.seen["moved"]:
            drop(both)
            return _as(moved, F.col("node"), F.col("label").alias("component"))
        labels = _as(moved, F.col("node"), F.col("label"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def _as(stashed: DataFrame, *columns: Column) -> DataFrame:
    out = stashed.select(*columns)
    out.stashed, out.seen = stashed.stashed, stashed.seen
    return out
