"""Connected components over an edge table: minimum labels with pointer jumping, one written table a round.

A vertex of many edges, or a label of many vertices, is looked up by broadcast: none of them gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.plans.joins import frequent, looked_up
from codeweave.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable vertex for each vertex that has an edge.

    edges(a long, b long), undirected; null ends and loops are ignored, repeated edges count once. Returns
    (vertex, component), one row a vertex; no row where there is no edge. Labels only fall, and each round also jumps
    to the label of the label, so chains halve. Raises if ``max_rounds`` (far beyond the logarithm of any diameter)
    don't suffice, rather than return unfinished labels.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = materialize(clean.union(clean.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    hubs = frequent(both, ["b"])
    for _ in range(max_rounds):
        seen = looked_up(both, labels.withColumnRenamed("vertex", "b"), ["b"], hubs).groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "vertex").select("vertex", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("vertex").alias("component"), F.col("component").alias("far"))
        stepped = looked_up(lower, jump, ["component"], frequent(lower, ["component"])).select("vertex", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        stepped = materialize(stepped, "labels")
        labels = stepped.drop("old")
        if not stepped.where("component < old").limit(1).count():
            return labels
    raise RuntimeError("connected_components: labels still change; raise max_rounds")
