"""Connected components of a link table, by hooking and contraction.

Each round hooks every node onto its smallest neighbour, jumps pointers until
they are roots, and replaces the links by links between roots. A component's
nodes at least halve with every round, so rounds grow with the logarithm of
the largest component. Rounds are cut by tables in the shared folder; nothing
but row counts comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import map_batches
from .store import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smaller node) with the same components as the links (a, b), one a node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while True:
            further = hooked[hooked]
            if (further == hooked).all():
                break
            hooked = further
        label = hooked[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def thinned(links: DataFrame, budget: int = 1 << 20) -> DataFrame:
    """(a, b) longs with the same components, each task's rows reduced to forests of up to ``budget`` links."""

    def run(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= budget:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, n = [x], [y], 0 if 2 * len(x) < budget else n
                if len(x) * 2 >= budget:
                    yield pa.record_batch([x, y], ["a", "b"])
                    a, b, n = [], [], 0
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            yield pa.record_batch([x, y], ["a", "b"])

    return map_batches(links.select("a", "b"), run, "a long, b long")


def components(links: DataFrame, thin: bool = True) -> DataFrame:
    """(node, root) for every node of a (a, b) table of longs; root: the component's smallest node.

    Links may repeat, point either way or be loops. Nodes without a link to another are left out.
    thin: reduce the links task by task first; of no use where they are forests already.
    """
    links = written((thinned(links) if thin else links.select("a", "b")).where("a <> b").distinct(), "links")
    parts = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        hook = written(hook, "hooks")
        while True:  # to roots
            jumped = hook.alias("x").join(hook.select(F.col("node").alias("at"), F.col("up").alias("further")), F.col("up") == F.col("at"))
            jumped = written(jumped.select("node", F.col("further").alias("up"), (F.col("further") < F.col("up")).alias("moved")), "hooks")
            hook, settled = jumped.drop("moved"), jumped.where("moved").isEmpty()
            if settled:
                break
        parts.append(hook)
        up = hook.select(F.col("node"), F.col("up"))
        lifted = links.join(up.withColumnsRenamed({"node": "a", "up": "ra"}), "a").join(up.withColumnsRenamed({"node": "b", "up": "rb"}), "b")
        links = written(lifted.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    if not parts:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = parts[0].withColumnRenamed("up", "root")
    for later in parts[1:]:
        step = later.withColumnsRenamed({"node": "root", "up": "next"})
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
