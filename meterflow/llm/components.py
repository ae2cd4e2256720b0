"""Connected components of an edge table by contraction, all in Spark.

In each round every node points to its smallest neighbour, if that is smaller than itself. Pointers are followed to their
roots by doubling, edges are moved to the roots and those within a root go. A round is one grouping and a few
equi-joins; a hub's many edges are summed map-side or split by adaptive execution. Every table is stored in the shared folder,
in as many parts as its rows are worth, so that small tables take few tasks; all but the result are deleted at the end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import dropped, scratch, shared_dir

#: Rows of an edge table that are worth a task.
ROWS_PER_TASK = 50_000


def _stored(df: DataFrame, rows: int, name: str = "components") -> DataFrame:
    """df, written in parts for about so many rows and read again."""
    path = scratch(df.sparkSession, name)
    df.coalesce(-(-rows // ROWS_PER_TASK) or 1).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pairs(edges: DataFrame, u: str, v: str) -> DataFrame:
    return edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u < v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the stored edges (u, v): root is the smallest node that is reachable."""
    spark, work = edges.sparkSession, f"edges-{uuid.uuid4().hex}"
    all_rows = rows = edges.count()
    edges = _stored(_pairs(edges, "u", "v"), rows, f"{work}/edges")
    done = None
    while rows := edges.count():
        parents = _stored(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), rows, f"{work}/edges")
        while True:  # pointer doubling
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = _stored(parents.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), rows, f"{work}/edges")
            parents = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        root = lambda side: parents.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = edges.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
        edges = _stored(_pairs(moved, "a", "b"), rows, f"{work}/edges")
        if done is None:
            done = parents
        else:  # what has been contracted before follows its root
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
            done = _stored(done.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(parents), rows, f"{work}/edges")
    if done is None:
        found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        found = done.unionByName(done.select(F.col("root").alias("node"), "root").distinct())
    found = _stored(found, all_rows)
    dropped(spark, f"{shared_dir(spark)}/{work}")
    return found
