"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.tables import discard, materialise


def _joiner() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Made here, so that the function goes to the workers whole and they need not import this module."""

    def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, stays): the nodes of a bounded number of edges, each with one node of its component."""
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent.setdefault(parent[x], parent[x])
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                parent[root(a)] = root(b)
        if parent:
            yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in list(parent)], kind)], names=["node", "stays"])

    return joined_up


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100, *, last: int = 50_000, told: list[int] | None = None) -> DataFrame:
    """(node, component): every node that an edge names, and the least node of its component.

    Edges are contracted: in each round every node gives its place to the one with the least hash
    among itself and its neighbours (another hash each round, so chains and grids about halve), edges are
    renamed to those nodes, and loops and repeats go. What is left falls from round to round; ``told`` gets the number
    of edges at each. Once ``last`` edges or fewer are left, one task joins them up (none where no edge is left). Who gave way to whom is written a round, and followed back from the last round to the
    first. Least hashes are combined before the shuffle, so a hub is not one task's. Edges with a null end are ignored; nodes
    named only as one end need no row of their own; loops name a node; an empty table gives no rows. Nodes are
    numbers or strings.
    """
    both = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
    whole = materialise(both.distinct())
    live, gave_way, where = whole.where("a <> b"), [], None
    for turn in range(rounds):
        left = live.count()
        if told is not None:
            told.append(left)
        if left <= last:
            kind = whole.schema["a"].dataType.simpleString()
            rest = live.coalesce(1).mapInArrow(_joiner(), f"node {kind}, stays {kind}") if left else live.select(F.col("a").alias("node"), F.col("a").alias("stays"))
            where = materialise(rest)
            if turn:
                discard(live)
            break

        def rank(column: str, turn: int = turn):
            return F.struct(F.xxhash64(F.lit(turn), column).alias("hash"), F.col(column).alias("node"))

        ways = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = ways.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least("least", rank("a"))["node"].alias("to"))
        chosen = materialise(chosen)
        gave_way.append(chosen)
        renamed = live.join(chosen.toDF("a", "x"), "a").join(chosen.toDF("b", "y"), "b")
        before, live = live, materialise(renamed.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if turn:
            discard(before)
    else:
        raise RuntimeError("components did not settle")
    for chosen in reversed(gave_way):
        # A round's nodes are the places of the round before, so each follows its own way and then that of where it led.
        led = chosen.toDF("node", "to").join(where.toDF("to", "stays"), "to", "left")
        after, where = where, materialise(led.select("node", F.coalesce("stays", "to").alias("stays")))
        discard(after)
    nodes = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labelled = materialise(nodes.join(where, "node", "left").select("node", F.coalesce("stays", "node").alias("stays")))
    # Written: right on an aggregate, the join of a component with most nodes is not split.
    least = materialise(labelled.groupBy("stays").agg(F.min("node").alias("component")))
    found = materialise(labelled.join(least, "stays").select("node", "component"))
    for used in (whole, labelled, least, where, *gave_way):
        discard(used)
    return found
