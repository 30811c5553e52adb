"""Joins by key, distance, overlap and order; set operations."""

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.operators import aggregates as A
from pointspark.operators import cluster as C
from pointspark.operators import joins as J
from pointspark.operators import spatial as P
from pointspark.plans.core import PIXELS, VOXELS, pixels
from pointspark.plans.registry import query
from pointspark.session import materialize

POINTS = X.POINTS


@query(f"WITH {POINTS}, f AS (SELECT *, max(CASE WHEN z <= -1e0 THEN 1 ELSE 0 END) OVER (PARTITION BY frame, point_idx) AS ground FROM points) SELECT frame, point_idx, x, y, z FROM f WHERE ground = 0")
def ground_anti(spark, d):
    p = X.points(spark, d).select("frame", "point_idx", "x", "y", "z")
    return p.join(p.where("z <= -1").select("frame", "point_idx"), ["frame", "point_idx"], "left_anti")


NEAR = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(f"""WITH {POINTS}, n AS (SELECT a.frame, a.point_idx, b.segment, {NEAR} AS d2, b.point_idx AS o FROM points a JOIN points b ON a.frame = b.frame WHERE a.sem = 0 AND b.sem <> 0 AND {NEAR} <= 9e0),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, point_idx ORDER BY d2, o) AS k FROM n) SELECT frame, point_idx, segment AS label, d2 FROM r WHERE k = 1""")
def nn_label_transfer(spark, d):
    # read twice below, so that points are numbered once
    p = materialize(X.points(spark, d).select("frame", "point_idx", "x", "y", "z", "sem", "segment"), "points")
    left, right = p.where("sem = 0").select("frame", "point_idx", "x", "y", "z"), p.where("sem <> 0").select("frame", "point_idx", "x", "y", "z", "segment")
    near = J.nearest_join(left, right, ("x", "y", "z"), ("frame", "point_idx"), "point_idx", 3.0, ("frame",))
    return near.select("frame", "point_idx", F.col("r_segment").alias("label"), "d2")


@query(f"WITH {POINTS}, {VOXELS}, a AS (SELECT frame, vx, vy, vz, 7 AS answer FROM voxels WHERE intensity > 5e0) SELECT p.frame, point_idx, coalesce(answer, 0) AS answer FROM points p LEFT JOIN a ON p.frame = a.frame AND CAST(floor(x / 2e0) AS BIGINT) = vx AND CAST(floor(y / 2e0) AS BIGINT) = vy AND CAST(floor(z / 2e0) AS BIGINT) = vz")
def voxel_answer(spark, d):
    from pointspark.operators.fusion import point_labels

    p = X.points(spark, d)
    answers = P.voxel_max(p, 2.0, "frame").where("intensity > 5").select("frame", "vx", "vy", "vz", F.lit(7).alias("label"))
    return point_labels(p.select("frame", "point_idx", "x", "y", "z"), answers, 2.0).select("frame", "point_idx", F.col("label").alias("answer"))


@query(f"""WITH {POINTS}, e AS (SELECT min(x) AS x0, min(y) AS y0 FROM points), c AS (SELECT frame, point_idx, sem, CAST(trunc((y - y0) / 2e0) AS INTEGER) AS row, CAST(trunc((x - x0) / 2e0) AS INTEGER) AS col FROM points CROSS JOIN e),
m AS (SELECT row, col, max(sem) AS class FROM c GROUP BY 1, 2) SELECT frame, point_idx, class FROM c JOIN m ON c.row = m.row AND c.col = m.col""")
def bev_join(spark, d):
    c = A.bev_cells(X.points(spark, d), 2.0)
    return c.select("frame", "point_idx", "row", "col").join(c.groupBy("row", "col").agg(F.max("sem").alias("class")), ["row", "col"]).select("frame", "point_idx", "class")


@query(f"""WITH {POINTS}, {PIXELS}, {X.MASKS}, r AS (SELECT frame, CAST(inst % 4 AS INTEGER) AS cam, row, col, min(depth) AS depth FROM pixels GROUP BY 1, 2, 3, 4)
SELECT m.frame, m.cam, obj_id, m.row, m.col, depth FROM masks m JOIN r ON m.frame = r.frame AND m.cam = r.cam AND m.row = r.row AND m.col = r.col""")
def mask_pixels(spark, d):
    r = pixels(spark, d).groupBy("frame", (F.col("inst") % 4).cast("int").alias("cam"), "row", "col").agg(F.min("depth").alias("depth"))
    return X.masks(spark, d).join(r, ["frame", "cam", "row", "col"]).select("frame", "cam", "obj_id", "row", "col", "depth")


PROMPTS = "prompts AS (SELECT 999 + row_number() OVER (ORDER BY p_size % 8, p_partkey % 2, p_partkey) AS obj_id, p_size % 8 AS kf, p_partkey % 2 AS scale, p_partkey AS j FROM part)"


def prompts(spark, d):
    from pointspark.operators.ordered import numbered

    p = X.table(spark, d, "part").select((F.col("p_size") % 8).alias("kf"), (F.col("p_partkey") % 2).alias("scale"), F.col("p_partkey").alias("j"))
    return numbered(p, ("kf", "scale", "j"), 1000, "obj_id")


@query(f"WITH {PROMPTS} SELECT l_orderkey, l_linenumber, obj_id FROM lineitem JOIN prompts ON l_partkey = j AND l_partkey % 2 = scale AND l_quantity > 4e1")
def prompt_registry(spark, d):
    li = X.table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("j"), (F.col("l_partkey") % 2).alias("scale"))
    return li.join(prompts(spark, d), ["j", "scale"]).select("l_orderkey", "l_linenumber", "obj_id")


WIDE = "wide AS (SELECT DISTINCT frame, CAST(floor(x / 4e0) AS BIGINT) AS vx, CAST(floor(y / 4e0) AS BIGINT) AS vy, CAST(floor(z / 4e0) AS BIGINT) AS vz FROM points)"


def wide(spark, d):
    return X.points(spark, d).select("frame", *P.voxel_keys(4.0)).distinct()


STEP = "(a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) + (a.vz - b.vz) * (a.vz - b.vz)"


@query(f"WITH {POINTS}, {WIDE} SELECT a.frame, a.vx, a.vy, a.vz, count(*) AS n, CAST(sum({STEP}) AS BIGINT) AS d2 FROM wide a JOIN wide b ON a.frame = b.frame AND {STEP} <= 4 GROUP BY 1, 2, 3, 4")
def radius_pairs(spark, d):
    w = wide(spark, d)
    return J.radius_join(w, w, C.VOXEL, 2.0, ("frame",)).groupBy("frame", *C.VOXEL).agg(F.count("*").alias("n"), F.sum("d2").cast("bigint").alias("d2"))


@query(f"""WITH {POINTS}, k AS (SELECT DISTINCT segment % 20 AS a, sem AS b, round(x, 1) AS x, z FROM points), l AS (SELECT DISTINCT a, x, z FROM k), r AS (SELECT DISTINCT b, x, z FROM k),
s AS (SELECT a, b, count(*) AS shared FROM l JOIN r ON l.x = r.x AND l.z = r.z GROUP BY 1, 2), t AS (SELECT a, count(*) AS size FROM l GROUP BY a) SELECT s.a, b, shared FROM s JOIN t ON s.a = t.a WHERE shared >= 120 OR shared > 7e-1 * size""")
def cloud_overlap(spark, d):
    p = X.points(spark, d).select((F.col("segment") % 20).alias("a"), F.col("sem").alias("b"), "x", "z")
    return J.cloud_overlap(p, p, "a", "b", ("x", "z"), 1, 120)


VOTES = f"""votes AS (SELECT frame, CAST(inst % 4 AS INTEGER) AS cam, 1000 + segment % 12 AS obj_id, CAST(sem % 3 AS INTEGER) AS sf, CAST(floor(x / 4e0) AS BIGINT) AS vx, CAST(floor(y / 4e0) AS BIGINT) AS vy, CAST(floor(z / 4e0) AS BIGINT) AS vz, count(*) AS cnt
 FROM points WHERE sem < 6 GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def votes(spark, d):
    p = X.points(spark, d).where("sem < 6")
    keyed = p.select("frame", (F.col("inst") % 4).cast("int").alias("cam"), (1000 + F.col("segment") % 12).alias("obj_id"), (F.col("sem") % 3).cast("int").alias("sf"), *P.voxel_keys(4.0))
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("cnt"))


LOHI = ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in C.VOXEL)
SHARED = " * ".join(f"greatest(least(p.hi_{a}, q.hi_{a}) - greatest(p.lo_{a}, q.lo_{a}) + 1, 0)" for a in C.VOXEL)


@query(f"WITH {POINTS}, {VOTES}, b AS (SELECT frame, sf, obj_id, cam, {LOHI} FROM votes GROUP BY 1, 2, 3, 4) SELECT DISTINCT p.frame, p.sf, p.obj_id AS a, q.obj_id AS b FROM b p JOIN b q ON p.frame = q.frame AND p.sf = q.sf AND p.obj_id < q.obj_id AND p.cam <> q.cam WHERE {SHARED} > 9")
def bbox_overlap_pairs(spark, d):
    return J.box_pairs(J.boxes(votes(spark, d), "frame", "sf", "obj_id", "cam"), ("frame", "sf"))


@query(f"""WITH {POINTS}, {VOTES}, n AS (SELECT obj_id, frame AS region, min((vx - (obj_id - 1005)) * (vx - (obj_id - 1005)) + vy * vy + vz * vz) AS d2 FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d2, region) AS k FROM n)
SELECT obj_id, region FROM r WHERE k = 1""")
def nearest_cluster(spark, d):
    v = votes(spark, d).withColumnRenamed("frame", "region")
    where = v.select("obj_id").distinct().select("obj_id", (F.col("obj_id") - 1005).alias("vx"), F.lit(0).alias("vy"), F.lit(0).alias("vz"))
    return C.nearest_cluster(v, where)


@query(f"""WITH {POINTS}, {VOTES}, n AS (SELECT obj_id, frame AS region, min((vx - (obj_id - 1005)) * (vx - (obj_id - 1005)) + vy * vy + vz * vz) AS d2 FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d2, region) AS k FROM n)
SELECT v.frame AS region, v.obj_id, CAST(sum(cnt) AS BIGINT) AS votes, count(DISTINCT vx * 1000000 + vy * 1000 + vz) AS voxels FROM votes v JOIN r ON v.obj_id = r.obj_id AND v.frame = r.region AND k = 1 GROUP BY 1, 2""")
def bleeding_cleanup(spark, d):
    v = votes(spark, d).withColumnRenamed("frame", "region")
    where = v.select("obj_id").distinct().select("obj_id", (F.col("obj_id") - 1005).alias("vx"), F.lit(0).alias("vy"), F.lit(0).alias("vz"))
    return C.vote_sums(C.without_bleeding(v, where))


@query(f"""WITH {POINTS}, s AS (SELECT frame AS kf, segment AS c, x, y, z FROM points WHERE sem = 2), p AS (SELECT frame AS kf, point_idx AS obj, x, y, z FROM points WHERE sem = 3),
m AS (SELECT p.kf, obj, c, min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z)) AS d2 FROM p JOIN s ON p.kf = s.kf GROUP BY 1, 2, 3),
r AS (SELECT kf, obj, c, d2, row_number() OVER (PARTITION BY kf, obj ORDER BY d2, c) AS rank FROM m WHERE d2 > 144e-2) SELECT kf, obj, c, rank FROM r WHERE rank <= 5""")
def topk_negatives(spark, d):
    p = X.points(spark, d)
    s = p.where("sem = 2").select(F.col("frame").alias("kf"), F.col("segment").alias("c"), "x", "y", "z")
    q = p.where("sem = 3").select(F.col("frame").alias("kf"), F.col("point_idx").alias("obj"), "x", "y", "z")
    return J.nearest_groups(q, s, ("x", "y", "z"), ("kf", "obj"), "c", 5, 1.2, ("kf",)).select("kf", "obj", "c", "rank")


SPOTS = "spots AS (SELECT DISTINCT CAST(o_custkey AS INTEGER) AS frame, CAST(o_custkey % 61 AS DOUBLE) - 3e1 AS px, CAST(o_custkey % 53 AS DOUBLE) - 26e0 AS py FROM orders)"
MEETS = "NOT (greatest(abs(px - x), abs(py - y)) > size / 2e0 + 3e0) AND (least(abs(px - x), abs(py - y)) < size / 2e0 OR (abs(px - x) - size / 2e0) * (abs(px - x) - size / 2e0) + (abs(py - y) - size / 2e0) * (abs(py - y) - size / 2e0) < 9e0)"


def overlaps(spark, d):
    c = F.col("o_custkey")
    spots = X.table(spark, d, "orders").select(c.cast("int").alias("frame"), ((c % 61).cast("double") - 30.0).alias("px"), ((c % 53).cast("double") - 26.0).alias("py")).distinct()
    return J.tile_scans(X.tiles(spark, d), spots, 3.0, 10.0)


@query(f"WITH {X.TILES}, {SPOTS} SELECT i, j, frame FROM tiles JOIN spots ON {MEETS}")
def tile_scan_overlap(spark, d):
    return overlaps(spark, d)


@query(f"WITH {X.TILES}, {SPOTS}, o AS (SELECT i, j, frame FROM tiles JOIN spots ON {MEETS}) SELECT i, j, count(*) AS n, CAST(string_agg(frame, ',' ORDER BY frame) AS VARCHAR) AS indexes FROM o GROUP BY i, j")
def nonempty_tiles(spark, d):
    t = overlaps(spark, d).groupBy("i", "j").agg(F.array_sort(F.collect_set("frame")).alias("indexes")).where(F.size("indexes") > 0)
    return t.select("i", "j", F.size("indexes").cast("bigint").alias("n"), F.array_join(F.col("indexes").cast("array<string>"), ",").alias("indexes"))


@query(f"WITH {POINTS}, m AS (SELECT DISTINCT segment AS old, segment - segment % 4 AS new FROM points WHERE segment % 4 < 3) SELECT frame, point_idx, coalesce(new, segment) AS segment FROM points LEFT JOIN m ON segment = old")
def id_remap(spark, d):
    p = X.points(spark, d).select("frame", "point_idx", "segment")
    m = p.where("segment % 4 < 3").select(F.col("segment").alias("old"), (F.col("segment") - F.col("segment") % 4).alias("new")).distinct()
    return J.remap(p, m, "segment")


@query("SELECT DISTINCT o_orderkey AS frame FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def files_without_labels(spark, d):
    o, li = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame")), X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"))
    return o.join(li, "frame", "left_anti").distinct()


CENTRES = [(-15.0, -10.0, 0.0), (15.0, -10.0, 0.0), (-15.0, 15.0, 0.5), (15.0, 15.0, 0.5)]
D2 = [f"(x - ({a!r})) * (x - ({a!r})) + (y - ({b!r})) * (y - ({b!r})) + (z - ({c!r})) * (z - ({c!r}))" for a, b, c in CENTRES]


@query(f"""WITH {POINTS}, q AS (SELECT frame, point_idx, {', '.join(f'{e} AS q{i}' for i, e in enumerate(D2))} FROM points)
SELECT frame, point_idx, CASE WHEN q0 <= q1 AND q0 <= q2 AND q0 <= q3 THEN 0 WHEN q1 <= q2 AND q1 <= q3 THEN 1 WHEN q2 <= q3 THEN 2 ELSE 3 END AS centre, round(sqrt(least(q0, q1, q2, q3)), 6) AS distance FROM q""")
def nearest_centroid(spark, d):
    p = X.points(spark, d)
    at, dist = J.nearest_of_few(p, CENTRES, ("x", "y", "z"))
    return p.select("frame", "point_idx", at.alias("centre"), F.round(dist, 6).alias("distance"))


@query(f"WITH {X.MASKS} SELECT a.frame, a.cam, a.row, a.obj_id, b.obj_id AS neighbour FROM (SELECT DISTINCT frame, cam, row, obj_id FROM masks) a JOIN (SELECT DISTINCT frame, cam, row, obj_id FROM masks) b ON a.frame = b.frame AND a.row = b.row AND b.cam = (a.cam + 1) % 4 AND a.obj_id <> b.obj_id")
def adjacent_cameras(spark, d):
    m = X.masks(spark, d).select("frame", "cam", "row", "obj_id").distinct()
    right = m.select("frame", ((F.col("cam") + 3) % 4).alias("cam"), "row", F.col("obj_id").alias("neighbour"))
    return m.join(right, ["frame", "cam", "row"]).where("obj_id <> neighbour").select("frame", "cam", "row", "obj_id", "neighbour")


@query(f"""WITH {POINTS}, {PIXELS}, r AS (SELECT frame, label, depth, row_number() OVER (PARTITION BY frame ORDER BY depth, point_idx) AS k FROM pixels WHERE (col - 32) * (col - 32) + (row - 24) * (row - 24) < 36 AND sem <> 4) SELECT frame, label, depth FROM r WHERE k = 1""")
def click_resolve(spark, d):
    c, r = F.col("col") - 32, F.col("row") - 24
    near = pixels(spark, d).where((c * c + r * r < 36) & (F.col("sem") != 4))
    return near.groupBy("frame").agg(F.min_by(F.struct("label", "depth"), F.struct("depth", "point_idx")).alias("b")).select("frame", "b.label", "b.depth")


@query(f"""WITH {POINTS}, {PIXELS}, b AS (SELECT frame, label, min(col) AS c0, max(col) AS c1, min(row) AS r0, max(row) AS r1, min(depth) AS depth FROM pixels GROUP BY 1, 2),
f AS (SELECT DISTINCT frame FROM points), r AS (SELECT f.frame, label, row_number() OVER (PARTITION BY f.frame ORDER BY depth, label) AS k FROM f LEFT JOIN b ON f.frame = b.frame AND 40 BETWEEN c0 AND c1 AND 30 BETWEEN r0 AND r1)
SELECT frame, coalesce(label, 0) AS label FROM r WHERE k = 1""")
def pick_instance(spark, d):
    p = pixels(spark, d)
    b = p.groupBy("frame", "label").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("depth").alias("depth"))
    hit = b.where("40 between c0 and c1 and 30 between r0 and r1").groupBy("frame").agg(F.min_by("label", F.struct("depth", "label")).alias("label"))
    return p.select("frame").distinct().join(hit, "frame", "left").select("frame", F.coalesce("label", F.lit(0)).alias("label"))


@query(f"WITH {POINTS}, f AS (SELECT DISTINCT frame FROM points) SELECT frame, CAST(n_nationkey AS INTEGER) AS cam FROM f CROSS JOIN nation WHERE n_nationkey < 8")
def camera_frame_cross(spark, d):
    return X.points(spark, d).select("frame").distinct().withColumn("cam", F.explode(F.sequence(F.lit(0), F.lit(7))))


# ---- set operations


@query(f"WITH {POINTS} SELECT frame, segment, sem, inst FROM points WHERE x < 0 EXCEPT SELECT frame, segment, sem, inst FROM points WHERE x >= 0")
def set_difference(spark, d):
    p = X.points(spark, d).select("x", "frame", "segment", "sem", "inst")
    return p.where("x < 0").drop("x").subtract(p.where("x >= 0").drop("x"))


@query(f"WITH {POINTS} SELECT frame, segment FROM points WHERE sem < 5 INTERSECT SELECT frame, segment FROM points WHERE sem >= 5")
def set_intersect(spark, d):
    p = X.points(spark, d)
    return p.where("sem < 5").select("frame", "segment").intersect(p.where("sem >= 5").select("frame", "segment"))


@query(f"WITH {POINTS} SELECT frame, sem FROM points WHERE z > 0 UNION SELECT frame, sem FROM points WHERE x > 0")
def set_union(spark, d):
    p = X.points(spark, d)
    return p.where("z > 0").select("frame", "sem").union(p.where("x > 0").select("frame", "sem")).distinct()


@query(f"WITH {POINTS} SELECT frame, point_idx, x FROM points WHERE z <= -1e0 UNION ALL SELECT frame, point_idx, x FROM points WHERE z >= 1e0")
def union_all_clouds(spark, d):
    p = X.points(spark, d)
    return p.where("z <= -1").select("frame", "point_idx", "x").unionByName(p.where("z >= 1").select("frame", "point_idx", "x"))


@query(f"WITH {POINTS} SELECT DISTINCT frame, CAST(floor(x / 2e0) AS BIGINT) AS vx, CAST(floor(y / 2e0) AS BIGINT) AS vy, CAST(floor(z / 2e0) AS BIGINT) AS vz FROM points")
def distinct_voxels(spark, d):
    return X.points(spark, d).select("frame", *P.voxel_keys(2.0)).distinct()


@query(f"WITH {POINTS.replace('points AS', 'points AS MATERIALIZED')}, o AS (SELECT DISTINCT frame * 100000 + segment AS k FROM points WHERE sem = 2) SELECT frame, point_idx, segment FROM points WHERE sem = 1 AND frame * 100000 + segment NOT IN (SELECT k FROM o)")
def index_difference(spark, d):
    p = X.points(spark, d).select("frame", "point_idx", "segment", "sem")
    return p.where("sem = 1").join(p.where("sem = 2").select("frame", "segment").distinct(), ["frame", "segment"], "left_anti").select("frame", "point_idx", "segment")


@query(f"WITH {POINTS}, s AS (SELECT frame, sem, count(*) AS cnt FROM points WHERE (x - 2e0) * (x - 2e0) + (y - 3e0) * (y - 3e0) < 1e2 AND sem % 2 = 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY cnt DESC, sem) AS k FROM s) SELECT frame, sem AS major, cnt FROM r WHERE k = 1")
def selection_majority(spark, d):
    from pointspark.operators.selection import under_brush

    able = X.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("bigint").alias("sem"))
    hit = X.points(spark, d).where(under_brush(F.col("x"), F.col("y"), 2.0, 3.0, 10.0)).join(able, "sem", "left_semi")
    return A.majority(hit, "sem", "frame")


@query("SELECT l_orderkey || '.bin' AS name, row_number() OVER (ORDER BY l_orderkey) AS place FROM (SELECT DISTINCT l_orderkey FROM lineitem) t")
def file_order(spark, d):
    from pointspark.operators.ordered import numbered

    names = X.table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(".bin")).alias("name")).distinct()
    return numbered(names.withColumn("n", F.regexp_extract("name", "^([0-9]+)", 1).cast("bigint")), ("n",), 1, "place").select("name", "place")
