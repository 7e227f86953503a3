"""Connected components: union-find inside tasks, alternating stars between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowguard.llm.common import cut


class Forest:
    """Union-find over what one task has seen; the smaller id becomes the root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.up.get(top, top)) != top:
            top = up
        while (up := self.up.get(x, x)) != top:
            self.up[x], x = top, up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        if a != b:
            self.up[b] = a

    def links(self) -> tuple[list[int], list[int]]:
        """One link from each node that is no root to its root."""
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
                    .alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in the links (a, b); comp is the smallest id reachable.

    Each round links every node's larger neighbours to the smallest of its neighbours, and then
    its smaller neighbours likewise, until nothing changes; the number of rounds grows with the
    square of the logarithm of the nodes. Rounds are cut by checkpoints in the shared folder.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = cut(large.join(small, "u").filter("v <> m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
