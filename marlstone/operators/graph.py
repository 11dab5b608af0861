"""Connected components by contraction, in DataFrame operations around a per-task union of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.storage import persisted, scratch_tables

#: Nodes that a task's union of edges holds at once; beyond, it starts anew.
LOCAL_NODES = 200_000


def _root(above: dict[tuple, tuple], x: tuple) -> tuple:
    while above[x] != x:
        above[x] = x = above[above[x]]
    return x


def _forest(edges: DataFrame) -> DataFrame:
    """node, to: each node of a task's edges with the smallest node that they connect it with (itself included).

    It connects what ``edges`` connect, by at most one row a node and task.
    """
    kind = edges.schema["a"].dataType["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            roots = [_root(above, x) for x in above]
            columns = [pa.array([x[i] for x in side], (pa.int64(), kind)[i]) for side in (above, roots) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["node_h", "node_id", "to_h", "to_id"])

        held = pa.null()
        for batch in batches:
            held = batch.column(1).type
            a_h, a, b_h, b = (c.to_pylist() for c in batch.columns)
            for x, y in zip(zip(a_h, a), zip(b_h, b)):
                x, y = (_root(above, z) if above.setdefault(z, z) != z else z for z in (x, y))
                if x != y:
                    above[max(x, y)] = min(x, y)
            if len(above) > LOCAL_NODES:
                yield rows(held)
                above.clear()
        if above:
            yield rows(held)

    flat = edges.select(F.col("a.h").alias("a_h"), F.col("a.id").alias("a_id"), F.col("b.h").alias("b_h"), F.col("b.id").alias("b_id"))
    joined = flat.mapInArrow(run, f"node_h long, node_id {kind}, to_h long, to_id {kind}")
    return joined.select(*[F.struct(F.col(f"{c}_h").alias("h"), F.col(f"{c}_id").alias("id")).alias(c) for c in ("node", "to")])


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of ``edges`` (a, b); all of a component share a label, its smallest node.

    In each round the edges of a task (of a written table, so that small files share one) are first united to stars,
    without a shuffle. Then every node follows the smallest
    node that any task gives it, twice, and the edges left between different choices are the next round's. Nodes are
    compared by hash, so that a long chain of growing ids shrinks by a share of it in each round. At the end the label of
    each component becomes its smallest node. No component lies in one task: minima are summed up before they are
    shuffled, and joins, in which a hub has many rows, are sort-merge joins of written tables, so that Spark splits its
    partition and the driver holds no table. Null nodes and loops are left out.
    """
    left = edges.where("a <> b").select(*[F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")).alias(c) for c in ("a", "b")])
    with scratch_tables(edges.sparkSession) as written:
        left, nodes = written(left), None
        while nodes is None or not left.isEmpty():
            forest = written(_forest(left))
            step = written(forest.groupBy("node").agg(F.min("to").alias("to")))
            after = step.select(F.col("node").alias("to"), F.col("to").alias("further")).hint("merge")
            step = written(step.join(after, "to").select("node", F.col("further").alias("to")))
            if nodes is None:
                nodes = step.select("node", F.col("to").alias("label"))
            else:
                moved = step.select(F.col("node").alias("label"), F.col("to").alias("moved")).hint("merge")
                nodes = written(nodes.join(moved, "label", "left").select("node", F.coalesce("moved", "label").alias("label")))
            of_node = step.select("node", F.col("to").alias("a")).hint("merge")
            of_to = step.select(F.col("node").alias("to"), F.col("to").alias("b")).hint("merge")
            left = written(forest.where("node <> to").join(of_node, "node").join(of_to, "to").where("a <> b").select("a", "b"))
        nodes = nodes.select(F.col("node.id").alias("node"), F.col("label.id").alias("label"))
        least = written(nodes.groupBy("label").agg(F.min("node").alias("least")))
        return persisted(nodes.join(least.hint("merge"), "label").select("node", F.col("least").alias("label")))


def grouped(items: DataFrame, edges: DataFrame, id_col: str = "item_id") -> DataFrame:
    """``id_col``, group_id for all items: the smallest id of the component; an item without edges is its own group."""
    labels = components(edges).withColumnRenamed("node", id_col)
    return items.select(id_col).join(labels, id_col, "left").select(id_col, F.coalesce("label", id_col).alias("group_id"))
