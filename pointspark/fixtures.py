"""The data model bound to the relational test tables.

Each view exists as a DataFrame and as SQL text for a WITH clause, with the same
columns and values. Fractions are written so that both engines compute the same
doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, point_idx, x, y, z, intensity and the label parts sem, inst, segment, label."""
    li = table(spark, sf_dir, "lineitem")
    frame = (F.col("l_orderkey") % FRAMES).cast("int")
    order = Window.partitionBy(frame).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    sem, inst = F.col("l_suppkey") % 20, F.col("l_linenumber").cast("bigint")
    return li.select(
        frame.alias("frame"),
        (F.row_number().over(order) - 1).cast("int").alias("point_idx"),
        (F.col("l_quantity") - 25.5).alias("x"),
        (F.col("l_extendedprice") / 2000.0 - 26.0).alias("y"),
        (F.col("l_linenumber") * F.lit(0.5) - 2.0).alias("z"),
        (F.col("l_discount") * 10.0).alias("intensity"),
        sem.alias("sem"),
        inst.alias("inst"),
        (1025 + F.col("l_partkey") % 40).alias("segment"),
        F.shiftleft(inst, 16).bitwiseOR(sem).alias("label"),
    )


POINTS = """points AS (SELECT CAST(l_orderkey % 64 AS INTEGER) AS frame,
 CAST(row_number() OVER (PARTITION BY l_orderkey % 64 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS point_idx,
 l_quantity - 25.5e0 AS x, l_extendedprice / 2000e0 - 26e0 AS y, l_linenumber * 5e-1 - 2e0 AS z, l_discount * 10e0 AS intensity,
 l_suppkey % 20 AS sem, CAST(l_linenumber AS BIGINT) AS inst, 1025 + l_partkey % 40 AS segment, CAST(l_linenumber AS BIGINT) * 65536 + l_suppkey % 20 AS label FROM lineitem)"""


def poses(spark: SparkSession, sf_dir: str, turned: bool = True) -> DataFrame:
    """frame and a transform m00 .. m23: a shift along x, and for odd frames a turn with a 3-4-5 triangle."""
    frames = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % FRAMES).cast("int").alias("frame")).distinct()
    odd = (F.col("frame") % 2 == 1) if turned else F.lit(False)
    c, s, o = F.when(odd, F.lit(0.6)).otherwise(F.lit(1.0)), F.when(odd, F.lit(0.8)).otherwise(F.lit(0.0)), F.lit(0.0)
    m = [c, -s, o, F.col("frame") * F.lit(0.25), s, c, o, o, o, o, F.lit(1.0), o]
    return frames.select("frame", *[v.alias(f"m{i // 4}{i % 4}") for i, v in enumerate(m)])


POSES = """poses AS (SELECT frame, CASE WHEN frame % 2 = 1 THEN 6e-1 ELSE 1e0 END AS c, CASE WHEN frame % 2 = 1 THEN 8e-1 ELSE 0e0 END AS s, frame * 25e-2 AS tx
 FROM (SELECT DISTINCT CAST(l_orderkey % 64 AS INTEGER) AS frame FROM lineitem) f)"""


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, event_id, step: a path a user walks, event by event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), "ts", "event_id", F.col("value").alias("step"))


TRAJECTORY = "trajectory AS (SELECT user_id AS seq, ts, event_id, value AS step FROM events)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, cam, obj_id, row, col: pixels that order lines stand for."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % FRAMES).cast("int").alias("frame"), (F.col("l_linenumber") % 4).cast("int").alias("cam"), (1000 + F.col("l_suppkey") % 30).alias("obj_id"), (F.col("l_partkey") % 48).cast("int").alias("row"), (F.col("l_quantity").cast("bigint") % 64).cast("int").alias("col")).distinct()


def mask_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, obj_id, x, y, z: the points of the order lines that masks stand for."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") % FRAMES).cast("int").alias("frame"), (1000 + F.col("l_suppkey") % 30).alias("obj_id"),
        (F.col("l_quantity") - 25.5).alias("x"), (F.col("l_extendedprice") / 2000.0 - 26.0).alias("y"), (F.col("l_linenumber") * F.lit(0.5) - 2.0).alias("z"),
    )


MASKS = """masks AS (SELECT DISTINCT CAST(l_orderkey % 64 AS INTEGER) AS frame, CAST(l_linenumber % 4 AS INTEGER) AS cam, 1000 + l_suppkey % 30 AS obj_id,
 CAST(l_partkey % 48 AS INTEGER) AS row, CAST(CAST(trunc(l_quantity) AS BIGINT) % 64 AS INTEGER) AS col FROM lineitem)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j, x, y, size: a grid of 25 tiles of 10 around the origin, by nation."""
    n = table(spark, sf_dir, "nation")
    i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5).cast("int")
    return n.select(i.alias("i"), j.alias("j"), (i * F.lit(10.0) - 20.0).alias("x"), (j * F.lit(10.0) - 20.0).alias("y"), F.lit(10.0).alias("size"))


TILES = "tiles AS (SELECT n_nationkey % 5 AS i, CAST(n_nationkey // 5 AS INTEGER) AS j, (n_nationkey % 5) * 1e1 - 2e1 AS x, (n_nationkey // 5) * 1e1 - 2e1 AS y, 1e1 AS size FROM nation)"
