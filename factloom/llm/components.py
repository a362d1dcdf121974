"""Groups of records linked directly or indirectly: seed-tree pruning.

Each round, every vertex links its neighbourhood to the neighbourhood's minimum; a vertex that is no
minimum of any neighbourhood drops out of the graph into a propagation forest, under the minimum it
saw. When the graph is empty its last vertices, the seeds, are the smallest of their components, and
their ids flow down the forest by pointer doubling. The number of rounds grows with the logarithm of
a component's size; each round shuffles the edges that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import cut, written

#: A vertex is a hub above 1/HUB_SHARE of the edges left, so there are fewer than HUB_SHARE hubs.
HUB_SHARE = 256
MAX_ROUNDS = 64


def _with_min(edges: DataFrame, mins: DataFrame) -> DataFrame:
    """``edges(u, v)`` with the minimum of u's neighbourhood. Hubs' edges stay where they are and meet the
    hubs' minima by broadcast (fewer than HUB_SHARE rows at any size); the rest is a hash join on u."""
    total = mins.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    marked = mins.withColumn("hub", F.col("n") * HUB_SHARE > total)
    hubs = F.broadcast(marked.filter("hub").select("u", F.col("m").alias("hm")))
    rest = marked.filter("not hub").select("u", "m")
    at = edges.join(hubs, "u", "left")
    return at.filter("hm is not null").select("u", "v", F.col("hm").alias("m")).unionByName(
        at.filter("hm is null").drop("hm").join(rest, "u")
    )


def numbered(vertices: DataFrame, u: str) -> DataFrame:
    """(u, n): every vertex with a number of the same order, so rounds move numbers in place of strings."""
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vertices.repartitionByRange(parts, u).sortWithinPartitions(u).withColumn("n", F.monotonically_increasing_id())


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, group_id): every id of a pair and the smallest id reachable from it (by code point).

    Pairs may repeat, come reversed or join an id with itself; a self pair alone gives a group of one.
    Pairs with a null end are left out; no pairs give no rows. Clashing extra columns are ignored.
    """
    with written(pairs.sparkSession) as keep:
        pairs = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
        vertices = keep(numbered(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id"))
        end = lambda c: vertices.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
        links = salted_join(salted_join(pairs.filter("a <> b"), end("a"), "a", spread="b"), end("b"), "b", spread="na")
        links = links.select(F.least("na", "nb").alias("u"), F.greatest("na", "nb").alias("v")).distinct()
        graph = keep(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        forest: DataFrame | None = None  # child -> parent, the parent is smaller
        for _ in range(MAX_ROUNDS):
            if graph.isEmpty():
                break
            mins = keep(graph.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
            # each neighbour (and the vertex itself) is linked to the neighbourhood's minimum
            heads = keep(mins.select("u", "m").unionByName(_with_min(graph, mins).select(F.col("v").alias("u"), "m")).distinct())
            low = keep(heads.groupBy("u").agg(F.min("m").alias("m"), F.count("*").alias("n"), F.max(F.col("u") == F.col("m")).alias("own")))
            # who sees several minima joins them; the smallest takes the others
            joined = _with_min(heads.withColumnRenamed("m", "v"), low.select("u", "m", "n")).filter("v <> m").select("v", "m")
            # a vertex that is nobody's minimum leaves for the forest
            gone = low.filter("not own").select(F.col("u").alias("child"), F.col("m").alias("parent"))
            # minima that met a smaller one and stay alone later leave in a later round
            edges = joined.select(F.least("v", "m").alias("u"), F.greatest("v", "m").alias("v")).distinct()
            graph = keep(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
            forest = gone if forest is None else forest.unionByName(gone)
        else:
            raise RuntimeError(f"the graph was not empty after {MAX_ROUNDS} rounds")
        if forest is None:
            return cut(vertices.select(F.col("id").alias("vertex"), F.col("id").alias("group_id")))
        # a vertex leaves once for good; of several leavings the smallest parent holds
        parent = keep(forest.groupBy("child").agg(F.min("parent").alias("parent")))
        for _ in range(MAX_ROUNDS):
            up = parent.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
            step = _jump(parent, up)
            step = step.select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
            moved = keep(step)
            parent = moved.select("child", "parent")
            if moved.filter("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"the forest was not flat after {MAX_ROUNDS} rounds")
        # roots have no parent: their number is their own
        root = vertices.join(parent.withColumnRenamed("child", "n"), "n", "left").select("id", F.coalesce("parent", "n").alias("root"))
        names = vertices.select(F.col("n").alias("root"), F.col("id").alias("group_id"))
        return cut(salted_join(root, names, "root", spread="id").select(F.col("id").alias("vertex"), "group_id"))


def _jump(parent: DataFrame, up: DataFrame) -> DataFrame:
    """Each vertex's parent's parent. A parent of very many children is met by broadcast, as hubs are."""
    sizes = parent.groupBy("parent").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    big = sizes.filter(F.col("n") * HUB_SHARE > total).select("parent")
    hot = F.broadcast(big.join(up, "parent", "left").select("parent", F.col("above").alias("hot_above"), F.lit(True).alias("hot")))
    at = parent.join(hot, "parent", "left")
    return at.filter("hot").select("child", "parent", F.col("hot_above").alias("above")).unionByName(
        at.filter("hot is null").select("child", "parent").join(up, "parent", "left").select("child", "parent", "above")
    )
