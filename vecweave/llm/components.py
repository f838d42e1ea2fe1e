"""Connected components of a link table, by joins; nothing is brought to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecweave.session import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``links`` (a, b): comp is the smallest node reached.

    Each round a node takes the smallest label among itself and its neighbours and then that
    label's own label, so long chains shorten geometrically. A round's labels are written to
    the shared folder; a lost executor costs one round at most. Aggregation is partial, so a
    node with very many links is no single task's work.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        jump = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        step = step.join(jump, F.col("comp") == F.col("_n"), "left").select("node", "old", F.least("comp", "_c").alias("comp"))
        step = stored(step, "labels")
        labels = step.select("node", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels
