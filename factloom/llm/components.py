"""Connected components of a table of links: contracted in tasks first, then by alternating large-star and small-star rounds."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


PER_TASK = 1 << 20  # links that one task contracts, some 100 MB of arrays


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, each but roots themselves, and the least node that each reaches: smaller labels are hooked on, then labels jump to their own labels."""
    nodes, of = np.unique(np.r_[a, b], return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    above = label != np.arange(len(nodes))
    return nodes[above], nodes[label[above]]


def _contracted(batches):
    import pyarrow as pa

    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = contract(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) of whole numbers: the least node that each linked node reaches. Groups are only ever aggregated to a minimum.

    Links that are null on a side, or lead to themselves, connect nothing. Tasks of about PER_TASK links contract them to stars; if one task holds all, that is
    the result. Else rounds follow, written as tables in the shared folder, whose sizes Spark knows (estimates carried on through the joins of many rounds grow
    beyond all measure). Minima are written before they are joined, so both sides of every join are plain shuffles and the partition of a node with very many
    links can be split. More than ``most`` rounds (paths of over 10^15 nodes) raise.
    """
    spark = links.sparkSession
    given = common.cut(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))))
    parts = max(1, -(-given.count() // PER_TASK))
    stars = common.cut(given.repartition(parts).mapInArrow(_contracted, "u long, v long"))
    roots = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if parts == 1:
        return roots(stars)
    folder = f"{common.shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    e = kept(stars.distinct(), "links")
    before = None
    for k in range(most):
        # large star: what is above v goes to the least of v and its neighbours, which is v itself or below it
        low = kept(e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")), f"low{k}")
        e = kept(e.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), f"large{k}")
        # small star: what is below u, and u, go to the least of them
        low = kept(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"least{k}")
        star = low.select("u", F.col("m").alias("v"))
        e = kept(star.unionByName(e.join(low.where("n > 1"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()).distinct(), f"small{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    out = common.cut(roots(e))
    common.remove(spark, folder)
    return out
