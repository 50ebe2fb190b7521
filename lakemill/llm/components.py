"""Connected components by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.workspace import save

#: More rounds than any graph needs whose labels double their reach each round.
MAX_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """Label each node of an undirected graph with the least node it reaches.

    edges has two columns of one orderable type; direction, loops and repeats
    don't matter.  Returns (node, label).  Every round joins links with labels
    and then replaces each label by its own label; each round's labels are
    written to the shared folder, and only a count of changes gets to the
    driver.  No links: no rows.
    """
    a, b = edges.columns
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = save(both.union(both.select("v", "u")).where("u <> v").distinct(), "links")
    labels = save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        # Labels reach over one link ...
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = save(labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "m").alias("label")), "labels")
        # ... and then as far as the label's own label.
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = save(step.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("old"))
        if jumped.join(old, "node").where("label <> old").isEmpty():
            return jumped
        labels = jumped
    raise RuntimeError("components did not settle")
