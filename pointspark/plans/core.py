"""Frames, voxels, projection and rasters."""

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.functions import geometry as G
from pointspark.operators import spatial as P
from pointspark.plans.registry import query

SIZE = 2.0
VOXEL = "CAST(floor({x} / 2e0) AS BIGINT) AS vx, CAST(floor(y / 2e0) AS BIGINT) AS vy, CAST(floor(z / 2e0) AS BIGINT) AS vz"
VOXELS = f"voxels AS (SELECT frame, {VOXEL.format(x='x')}, max(intensity) AS intensity FROM points GROUP BY 1, 2, 3, 4)"


@query(f"""WITH {X.POINTS}, f AS (SELECT DISTINCT frame FROM points), w AS (SELECT c.frame AS centre, f.frame FROM f c JOIN f ON f.frame BETWEEN c.frame - 3 AND c.frame + 3)
SELECT centre AS frame, CAST(floor((x + (p.frame - centre) * 25e-2) / 2e0) AS BIGINT) AS vx, CAST(floor(y / 2e0) AS BIGINT) AS vy, CAST(floor(z / 2e0) AS BIGINT) AS vz, max(intensity) AS intensity
FROM points p JOIN w ON p.frame = w.frame GROUP BY 1, 2, 3, 4""")
def superframe_voxels(spark, d):
    return P.superframe_voxels(X.points(spark, d), X.poses(spark, d, turned=False), 7, SIZE)


@query(f"WITH {X.POINTS} SELECT frame, {VOXEL.format(x='x')}, max(intensity) AS intensity FROM points GROUP BY 1, 2, 3, 4")
def voxel_max_intensity(spark, d):
    return P.voxel_max(X.points(spark, d), SIZE, "frame")


@query(f"""WITH {X.POINTS}, {X.POSES} SELECT p.frame, point_idx, round(c * x - s * y + tx, 6) AS x, round(s * x + c * y, 6) AS y, z
FROM points p JOIN poses ON p.frame = poses.frame""")
def pose_transform(spark, d):
    moved = P.to_world(X.points(spark, d), X.poses(spark, d))
    return moved.select("frame", "point_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query(f"""WITH {X.POSES}, w AS (SELECT a.frame AS centre, b.frame AS frame, a.c AS ca, a.s AS sa, b.c AS cb, b.s AS sb, a.tx AS ta, b.tx AS tb FROM poses a JOIN poses b ON b.frame BETWEEN a.frame - 3 AND a.frame + 3)
SELECT centre, frame, round(ca * cb + sa * sb, 9) AS m00, round(ca * (tb - ta), 9) AS m03, round(-sa * (tb - ta), 9) + 0e0 AS m13 FROM w""")
def relative_pose(spark, d):
    poses = X.poses(spark, d)
    m = P.relative_poses(P.frame_window(poses, 7), poses)
    return m.select("centre", "frame", F.round("m00", 9).alias("m00"), F.round("m03", 9).alias("m03"), (F.round("m13", 9) + 0.0).alias("m13"))


@query(f"WITH {X.POSES} SELECT a.frame AS centre, b.frame AS frame FROM poses a JOIN poses b ON b.frame BETWEEN a.frame - 3 AND a.frame + 3")
def frame_window(spark, d):
    return P.frame_window(X.poses(spark, d), 7)


@query(f"""WITH {X.POINTS}, {VOXELS}, k AS (SELECT * FROM (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1), (4, 1, 1, 0), (5, 1, 0, 1), (6, 0, 1, 1), (7, 1, 1, 1)) t(corner, i, j, l))
SELECT frame, vx, vy, vz, intensity, corner, (vx + i) * 2e0 AS x, (vy + j) * 2e0 AS y, (vz + l) * 2e0 AS z FROM voxels CROSS JOIN k""")
def corner_explode(spark, d):
    return P.corners(P.voxel_max(X.points(spark, d), SIZE, "frame"), SIZE)


@query(f"""WITH {X.POINTS}, {VOXELS} SELECT frame, vx, vy, vz, intensity FROM voxels WHERE vx * 2e0 > 0""")
def in_front_voxels(spark, d):
    v = P.voxel_max(X.points(spark, d), SIZE, "frame")
    lowest = P.corners(v, SIZE).groupBy(*v.columns).agg(F.min("x").alias("x"))
    return lowest.where("x > 0").drop("x")


def pixels(spark, d):
    """Points as a camera sees them that looks along x from 30 behind: depth is x + 30."""
    p = X.points(spark, d).withColumn("depth", F.col("x") + 30.0)
    col, row = P.pinhole(F.col("y"), F.col("z") * 8.0, F.col("depth"), 50.0, 50.0, 32.0, 24.0)
    return p.withColumns({"col": col, "row": row})


PIXELS = """pixels AS (SELECT frame, point_idx, intensity, label, sem, inst, segment, x, y, z, x + 3e1 AS depth, CAST(trunc((5e1 * y + 32e0 * (x + 3e1)) / (x + 3e1)) AS INTEGER) AS col,
 CAST(trunc((5e1 * (z * 8e0) + 24e0 * (x + 3e1)) / (x + 3e1)) AS INTEGER) AS row FROM points)"""
INSIDE = "col >= 0 AND col < 64 AND row >= 0 AND row < 48"


@query(f"WITH {X.POINTS}, {PIXELS} SELECT frame, point_idx, row, col, depth FROM pixels WHERE {INSIDE}")
def pinhole_project(spark, d):
    return pixels(spark, d).where(P.in_picture(F.col("col"), F.col("row"), 64, 48)).select("frame", "point_idx", "row", "col", "depth")


@query(f"""WITH {X.POINTS}, {PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, row, col ORDER BY depth, point_idx) AS k FROM pixels WHERE {INSIDE})
SELECT frame, row, col, depth, point_idx, intensity FROM r WHERE k = 1""")
def zbuffer_nearest(spark, d):
    return P.zbuffer(pixels(spark, d).where(P.in_picture(F.col("col"), F.col("row"), 64, 48)), "frame")


@query(f"""WITH {X.POINTS}, {PIXELS}, r AS (SELECT frame, row, col, min(depth) AS seen FROM pixels WHERE {INSIDE} AND sem <> 0 GROUP BY 1, 2, 3)
SELECT p.frame AS cam, point_idx, p.row, p.col, depth FROM pixels p JOIN r ON p.frame = r.frame AND p.row = r.row AND p.col = r.col WHERE sem = 0 AND abs(depth - seen) < 2e0""")
def occlusion_prompts(spark, d):
    p = pixels(spark, d).withColumnRenamed("frame", "cam")
    seen = p.where(P.in_picture(F.col("col"), F.col("row"), 64, 48) & (F.col("sem") != 0)).groupBy("cam", "row", "col").agg(F.min("depth").alias("depth"))
    return P.occlusion(p.where("sem = 0").select("cam", "point_idx", "row", "col", "depth"), seen).select("cam", "point_idx", "row", "col", "depth")


@query(f"""WITH {X.POSES}, r AS (SELECT CAST(i AS INTEGER) AS cam, i * 7853981633974483e-16 AS yaw, cos(6283185307179586e-15 - i * 7853981633974483e-16) * (-tan(5e-1 + 3141592653589793e-15 - 3e-1) * 4e0) AS x,
sin(6283185307179586e-15 - i * 7853981633974483e-16) * (-tan(5e-1 + 3141592653589793e-15 - 3e-1) * 4e0) AS y FROM (SELECT n_nationkey AS i FROM nation WHERE n_nationkey < 8) t)
SELECT frame, cam, round(yaw, 9) AS yaw, round(c * x - s * y + tx, 6) + 0e0 AS x, round(s * x + c * y, 6) + 0e0 AS y, 4e0 AS z FROM poses CROSS JOIN r""")
def camera_ring(spark, d):
    """A ring of cameras about every pose, in the world."""
    placed = X.poses(spark, d).crossJoin(F.broadcast(P.camera_ring(spark, 8, 0.5, 0.3, 4.0)))  # eight rows
    moved = P.transform(placed, P.G.columns("m"))
    return moved.select("frame", "cam", F.round("yaw", 9).alias("yaw"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), "z")


@query(f"""WITH {X.POINTS}, b AS (SELECT frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0 FROM points GROUP BY frame), n AS (SELECT n_nationkey AS k FROM nation)
SELECT frame, x0 + i.k * 1e1 AS x, y0 + j.k * 1e1 AS y, z0 AS z, 0e0 AS intensity FROM b JOIN n i ON i.k <= floor((x1 - x0) / 1e1) JOIN n j ON j.k <= floor((y1 - y0) / 1e1)""")
def ground_grid(spark, d):
    return P.ground_grid(X.points(spark, d), "frame", step=10.0)


@query(f"""WITH {X.POINTS}, e AS (SELECT min(intensity) AS lo, max(intensity) AS hi FROM points), l AS (SELECT frame, point_idx, CAST(floor((intensity - lo) / (hi - lo) * 255) AS INTEGER) AS level FROM points CROSS JOIN e),
n AS (SELECT level, count(*) AS n FROM l GROUP BY level), c AS (SELECT level, sum(n) OVER (ORDER BY level) AS c, sum(n) OVER () AS t FROM n)
SELECT frame, point_idx, l.level, CAST(c AS DOUBLE) / CAST(t AS DOUBLE) AS equalized FROM l JOIN c ON l.level = c.level""")
def hist_equalize(spark, d):
    return P.histogram_equalize(X.points(spark, d).select("frame", "point_idx", "intensity")).select("frame", "point_idx", "level", "equalized")


def square(v, n):
    return f"greatest(0, least({n - 1}, {v}))"


@query(f"""WITH {X.POINTS}, {PIXELS}, r AS (SELECT frame, row, col, max(depth) AS v FROM pixels WHERE {INSIDE} GROUP BY 1, 2, 3),
o AS (SELECT a.n_nationkey - 1 AS i, b.n_nationkey - 1 AS j FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < 3 AND b.n_nationkey < 3),
t AS (SELECT DISTINCT frame, row + i AS row, col + j AS col FROM r CROSS JOIN o WHERE row + i BETWEEN 0 AND 47 AND col + j BETWEEN 0 AND 63),
s AS (SELECT t.frame, t.row, t.col, {square('t.row + i', 48)} AS r2, {square('t.col + j', 64)} AS c2 FROM t CROSS JOIN o)
SELECT s.frame, s.row, s.col, round(sum(coalesce(r.v, 0e0)) / 9, 6) AS mean FROM s LEFT JOIN r ON r.frame = s.frame AND r.row = s.r2 AND r.col = s.c2 GROUP BY 1, 2, 3""")
def box_mean(spark, d):
    r = pixels(spark, d).where(P.in_picture(F.col("col"), F.col("row"), 64, 48)).groupBy("frame", "row", "col").agg(F.max("depth").alias("v"))
    return P.box_mean(r, "v", 48, 64, "frame").select("frame", "row", "col", F.round("mean", 6).alias("mean"))


@query()
def raster_fill(spark, d):
    """Convex fills of projected voxels; checked by a brute-force twin in the tests."""
    v = P.voxel_max(X.points(spark, d), SIZE, "frame")
    camera = [F.lit(float(c)) for c in (0, 1, 0, 0, 0, 0, 4, 0, 1, 0, 0, 40)]
    return P.rasterise(v, camera, SIZE, 40.0, 40.0, 64.0, 48.0, 128, 96)
