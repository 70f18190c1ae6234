"""Connected components of large edge tables by contraction along random priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orospark.llm.common import discard, lookup, materialise


def _priority(node: str, round_: int) -> Column:
    """In the first round the node itself, as edges often lead to the least of their kind; then a hash, another each round."""
    return F.col(node) if round_ == 0 else F.xxhash64(node, F.lit(round_))


def connected_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, label) for the nodes of edges (u long, v long); label is the least node of the component.

    Each round maps every node to the one of lowest priority among its neighbours and itself, and contracts the edges.
    With random priorities at most three quarters of a component's nodes are expected to be anyone's choice, on a path
    half, on a star half, whatever the graph; so rounds grow with the logarithm of the nodes. (With fixed priorities an
    ascending path loses one node a round.) A node with a large share of the edges is met by broadcasts of a bounded
    number of rows, see lookup(). Tables are written to the shared folder between rounds; the driver sees counts and
    the hot nodes. The number of edges at the start of each round is appended to ``rounds``. An edge table without
    rows, or with loops only, has no components."""
    left = materialise(edges.select("u", "v").where("u <> v"))
    maps: list[DataFrame] = []
    while n := left.count():
        if rounds is not None:
            rounds.append(n)
        k = len(maps)
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min_by("v", F.struct(_priority("v", k), "v")).alias("m"))
        own = F.struct(_priority("u", k), F.col("u")) < F.struct(_priority("m", k), F.col("m"))
        chosen = materialise(best.select(F.col("u").alias("node"), F.when(own, F.col("u")).otherwise(F.col("m")).alias("label")))
        maps.append(chosen)
        half = materialise(lookup(left, chosen.toDF("u", "a"), "u").select("a", "v"))
        both_ends = lookup(half, chosen.toDF("v", "b"), "v").where("a <> b")
        after = materialise(both_ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        discard(left, half)
        left = after
    if not maps:
        return left.toDF("node", "label")
    labels = maps.pop()
    while maps:  # earlier choices lead on to later ones
        earlier = maps.pop()
        on = materialise(lookup(earlier, labels.toDF("label", "_to"), "label").select("node", F.coalesce("_to", "label").alias("label")))
        discard(earlier, labels)
        labels = on
    least = labels.groupBy("label").agg(F.min("node").alias("_least"))
    out = materialise(lookup(labels, least, "label").select("node", F.col("_least").alias("label")))
    discard(left, labels)
    return out
