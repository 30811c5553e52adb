"""Filters and relabelling."""

import math

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.functions import geometry as G
from pointspark.functions import scalars as S
from pointspark.operators import selection as O
from pointspark.operators import spatial as P
from pointspark.plans.registry import query

POINTS = X.POINTS


@query(f"""WITH {POINTS}, {X.POSES}, w AS (SELECT p.*, c * x - s * y + tx AS wx, s * x + c * y AS wy, sqrt(x * x + y * y + z * z) AS dist FROM points p JOIN poses ON p.frame = poses.frame)
SELECT frame, point_idx FROM w WHERE abs(wx - 1e1) < 125e-1 AND abs(wy - 0e0) < 125e-1 AND dist >= 25e-1 AND dist <= 5e1 AND NOT (x > -2e0 AND x < 3e0 AND abs(y) < 2e0)""")
def tile_filter(spark, d):
    own = P.with_poses(X.points(spark, d), X.poses(spark, d))
    world = list(G.apply(G.columns("m"), *P.xyz()))
    return own.where(O.in_tile(F.lit(10.0), F.lit(0.0), F.lit(10.0), 15.0, 2.5, 50.0, world, P.xyz())).select("frame", "point_idx")


@query(f"WITH {POINTS} SELECT frame, point_idx, label FROM points WHERE label % 65536 NOT IN (3, 5, 7)")
def visibility_filter(spark, d):
    return X.points(spark, d).where(O.visible(F.col("label"), [3, 5, 7])).select("frame", "point_idx", "label")


THETA, PHI = 0.3, -0.2
NORMAL = [v / math.sqrt(math.tan(THETA) ** 2 + math.tan(PHI) ** 2 + 1) for v in (math.tan(THETA), math.tan(PHI), 1.0)]


@query(f"WITH {POINTS} SELECT frame, point_idx FROM points WHERE (CAST({NORMAL[0]!r} AS DOUBLE) * x + CAST({NORMAL[1]!r} AS DOUBLE) * y + CAST({NORMAL[2]!r} AS DOUBLE) * z) - 15e-1 < 0")
def plane_filter(spark, d):
    return X.points(spark, d).where(O.beyond_plane(P.xyz(), THETA, PHI, 1.5, 1)).select("frame", "point_idx")


@query(f"WITH {POINTS} SELECT frame, point_idx FROM points WHERE x >= 0 AND x < 2e1 AND y >= 0 AND y < 1e1 AND intensity / 1e1 >= 0 AND intensity / 1e1 <= 1")
def frustum_filter(spark, d):
    return X.points(spark, d).where(O.in_window(F.col("x"), F.col("y"), F.col("intensity") / 10.0, 20.0, 10.0)).select("frame", "point_idx")


@query(f"WITH {POINTS}, h AS (SELECT frame, point_idx, CASE WHEN inst > 4 THEN sem ELSE label END AS label FROM points) SELECT * FROM h WHERE label // 65536 = 0")
def hide_instances(spark, d):
    p = X.points(spark, d).withColumn("label", F.when(F.col("inst") > 4, F.col("sem")).otherwise(F.col("label")))
    return p.where(S.instance(F.col("label")) == 0).select("frame", "point_idx", "label")


@query(f"WITH {POINTS} SELECT frame, point_idx, x FROM points WHERE frame BETWEEN 10 AND 20")
def scan_range(spark, d):
    return X.points(spark, d).where(F.col("frame").between(10, 20)).select("frame", "point_idx", "x")


@query(f"WITH {POINTS} SELECT frame, point_idx, sem * 20 AS class FROM points WHERE sem * 20 > 200")
def moving_points(spark, d):
    return X.points(spark, d).withColumn("class", F.col("sem") * 20).where(S.is_moving(F.col("class"))).select("frame", "point_idx", "class")


@query(f"WITH {POINTS} SELECT frame, point_idx FROM points WHERE sqrt(x * x + y * y) > 1e1")
def nonempty_pixels(spark, d):
    return X.points(spark, d).where(G.length([F.col("x"), F.col("y")]) > 10.0).select("frame", "point_idx")


@query(f"WITH {POINTS} SELECT label % 65536 AS sem, label // 65536 AS inst, label, count(*) AS n FROM points GROUP BY 1, 2, 3")
def pack_labels(spark, d):
    p = X.points(spark, d)
    g = p.groupBy(S.semantic(F.col("label")).alias("sem"), S.instance(F.col("label")).alias("inst")).agg(F.count("*").alias("n"))
    return g.withColumn("label", S.pack(F.col("sem"), F.col("inst")))


@query(f"WITH {POINTS} SELECT frame, point_idx, label FROM points WHERE label % 65536 = 10 AND label // 65536 = 3")
def selected_instance(spark, d):
    return X.points(spark, d).where(O.selected_instance(F.col("label"), 10, 3)).select("frame", "point_idx", "label")


@query(f"WITH {POINTS} SELECT frame, point_idx, CASE WHEN inst % 2 = 1 THEN sem ELSE segment END AS label FROM (SELECT frame, point_idx, inst, CASE WHEN sem = 0 AND inst % 2 = 1 THEN segment ELSE sem END AS sem, segment FROM points) p")
def merge_labels(spark, d):
    p = X.points(spark, d)
    keep = p.select("frame", "point_idx", F.when(F.col("inst") % 2 == 1, F.col("sem")).otherwise(F.lit(0)).alias("label"))
    return O.zip_labels(keep, p.select("frame", "point_idx", F.col("segment").alias("label"))).select("frame", "point_idx", "label")


CIRCLE = "(x - 2e0) * (x - 2e0) + (y - 3e0) * (y - 3e0) < 1e2"
POLYGON = [(-10.0, -10.0), (10.0, -12.0), (14.0, 9.0), (0.0, 2.0), (-8.0, 12.0)]
SHOWN = "sem NOT IN (3, 5)"


def inside_sql() -> str:
    parts = []
    for a, b, c in G.triangulate(POLYGON):
        sides = ((a, b), (b, c), (c, a))
        parts.append("(" + " AND ".join(f"CAST({q[0] - p[0]!r} AS DOUBLE) * (y - CAST({p[1]!r} AS DOUBLE)) - CAST({q[1] - p[1]!r} AS DOUBLE) * (x - CAST({p[0]!r} AS DOUBLE)) > 0" for p, q in sides) + ")")
    return "(" + " OR ".join(parts) + ")"


@query(f"WITH {POINTS} SELECT frame, point_idx FROM points WHERE {inside_sql()}")
def polygon_filter(spark, d):
    return X.points(spark, d).where(O.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("frame", "point_idx")


def relabelled(spark, d, gesture: O.Relabel, brush: bool = False):
    p = X.points(spark, d)
    inside = O.under_brush(F.col("x"), F.col("y"), 2.0, 3.0, 10.0) if brush else O.in_polygon(F.col("x"), F.col("y"), POLYGON)
    return p.select("frame", "point_idx", O.relabel(F.col("label"), O.visible(F.col("label"), [3, 5]), inside, gesture).alias("label"))


def relabel_sql(condition: str, value: str) -> str:
    return f"WITH {POINTS} SELECT frame, point_idx, CASE WHEN {SHOWN} AND {condition} THEN {value} ELSE label END AS label FROM points"


@query(relabel_sql(f"{CIRCLE} AND sem = 0", "40"))
def brush_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("paint", new_label=40), brush=True)


@query(relabel_sql(f"{CIRCLE} AND sem = 7", "0"))
def brush_remove(spark, d):
    return relabelled(spark, d, O.Relabel("paint", new_label=7, removing=True), brush=True)


@query(relabel_sql(inside_sql(), "40"))
def polygon_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("polygon", new_label=40, overwrite=True))


@query(relabel_sql(f"{inside_sql()} AND sem = 10", "11"))
def merge_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("merge", new_label=11, old_label=10, overwrite=True))


@query(relabel_sql(f"sem = 10 AND {inside_sql()}", "2 * 65536 + sem"))
def instance_add_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("add", selected_class=10, selected_instance=2))


@query(relabel_sql(f"sem = 10 AND inst = 2 AND {inside_sql()}", "9 * 65536 + sem"))
def instance_split_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("split", selected_class=10, selected_instance=2, new_instance=9))


@query(relabel_sql(f"sem = 10 AND {inside_sql()}", "sem"))
def instance_remove_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("remove", selected_class=10, selected_instance=2))


@query(relabel_sql(f"sem = 10 AND {inside_sql()}", "8 * 65536 + sem"))
def instance_create_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("create", selected_class=10, new_instance=8))


@query(relabel_sql("sem = 10 AND inst = 3", "1 * 65536 + sem"))
def instance_join_relabel(spark, d):
    return relabelled(spark, d, O.Relabel("join", selected_class=10, selected_instance=3, new_instance=1))
