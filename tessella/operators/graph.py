"""Connected components and leader rounds over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.scratch import ship_package, stored


#: Edges that one task passes through in order at most: a graph of so few at once, a larger one's components each.
PASS_EDGES = 200_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges that a task has: u is above v."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = find(u), find(v)
            up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", small: int = 0) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the edges are stars around their smallest node. Each round is two aggregations and two
    equi-joins, written to the shared folder. At most ``small`` edges are united by one task instead. Self-loops,
    repeated and null edges are allowed; edges with a null end are ignored. An empty table gives an empty result.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = stored(links.distinct(), "cc-edges")  # written once: edges may be costly to make
    if small and links.count() <= small:
        ship_package(edges.sparkSession)
        kind = dict(links.dtypes)["u"]
        return links.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    loops, pairs = links.where("u = v"), links.where("u <> v")
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "cc-large")
        # small star: every edge already points from the larger to the smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pairs = stored(small, "cc-small")
        now = pairs.agg(
            F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        # stars: no node points at two others, and none that points is pointed at
        if now == before or (now[0] == now[1] and pairs.join(
                pairs.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0):
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return found.union(alone.join(found.select("node"), "node", "left_anti"))


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy passes over components, rows in order of ``a`` and of ``b``, which is before it: ``a`` follows the first
    of its ``b`` that leads."""
    component, follows = None, {}
    for batch in batches:
        new_a, new_b = [], []
        for c, a, b in zip(*(batch.column(k).to_pylist() for k in ("component", "a", "b")), strict=True):
            if c != component:
                component, follows = c, {}
            if a not in follows and b not in follows:
                follows[a] = b
                new_a.append(a)
                new_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(new_a, batch.column("a").type), pa.array(new_b, batch.column("b").type)], names=["a", "b"])


def leader_groups(nodes: DataFrame, edges: DataFrame, pass_edges: int = PASS_EDGES) -> DataFrame:
    """Rows ``(node, leader)``: what a greedy pass in order of ``ordinal`` gives.

    ``nodes`` has node, a unique ordinal and optionally a boolean ``forced`` (always a leader); ``edges`` has a and b.
    The pass makes each node a follower of its earliest leading neighbour, else a leader. A forced node leads, and
    never follows. At most ``pass_edges`` edges are passed through by one task. Components are independent: each one of at most ``pass_edges`` edges is passed through by one task;
    in larger ones a round lets a node with an earlier leader among its neighbours follow, and a node whose earlier
    neighbours all follow lead (the lexicographically first maximal independent set, as in parallel greedy
    algorithms), until all are decided. Each round is written to the shared folder.
    """
    forced = F.coalesce("forced", F.lit(False)) if "forced" in nodes.columns else F.lit(False)
    n = nodes.select("node", "ordinal", forced.alias("forced"))
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    earlier = both.join(n.select(F.col("node").alias("a"), F.col("ordinal").alias("o"), F.col("forced").alias("fa")), "a").join(
        n.select(F.col("node").alias("b"), F.col("ordinal").alias("o2")), "b").where("o2 < o and not fa")
    earlier = stored(earlier.select("a", "b", "o", "o2"), "leader-edges")  # b is before a
    kind = dict(n.dtypes)["node"]
    ship_package(n.sparkSession)
    if earlier.count() <= pass_edges:
        one = earlier.withColumn("component", F.lit(0)).coalesce(1).sortWithinPartitions("o", "o2")
        follows = one.select("component", "a", "b").mapInArrow(_passes, f"a {kind}, b {kind}")
        return n.join(follows, n["node"] == follows["a"], "left").select("node", F.coalesce("b", "node").alias("leader"))
    named = stored(earlier.join(connected_components(earlier).withColumnRenamed("node", "a"), "a"), "leader-components")
    size = stored(named.groupBy("component").agg(F.count("*").alias("k")), "leader-sizes")
    few = named.join(size.where(F.col("k") <= pass_edges), "component", "left_semi").repartition("component").sortWithinPartitions("component", "o", "o2")
    follows = few.select("component", "a", "b").mapInArrow(_passes, f"a {kind}, b {kind}")
    large = size.where(F.col("k") > pass_edges)
    if large.limit(1).count():
        follows = follows.union(_rounds(n, stored(named.join(large, "component", "left_semi").drop("component"), "leader-edges")))
    return n.join(follows, n["node"] == follows["a"], "left").select("node", F.coalesce("b", "node").alias("leader"))


def _rounds(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    """``a`` and the leader ``b`` that it follows, decided in rounds."""
    own = earlier.select(F.col("a").alias("node")).union(earlier.select("b")).distinct()
    state = stored(nodes.join(own, "node", "left_semi").select("node", F.when(F.col("forced"), "leader").otherwise("open").alias("state")), "leader-state")
    while state.where("state = 'open'").limit(1).count():
        seen = earlier.join(state.select(F.col("node").alias("b"), F.col("state").alias("sb")), "b").groupBy(F.col("a").alias("node")).agg(
            F.bool_or(F.col("sb") == "leader").alias("led"), F.bool_and(F.col("sb") == "follower").alias("free"))
        state = stored(state.join(seen, "node", "left").select(
            "node", F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("led", F.lit(False)), "follower").when(F.coalesce("free", F.lit(True)), "leader").otherwise("open").alias("state")), "leader-state")
    leaders = state.where("state = 'leader'").select(F.col("node").alias("b"))
    return earlier.join(leaders, "b").groupBy("a").agg(F.min(F.struct("o2", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
