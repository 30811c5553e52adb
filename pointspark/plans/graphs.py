"""Components, density clusters, folds and composite steps."""

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.config import SceneConfig
from pointspark.functions import geometry as G
from pointspark.operators import aggregates as A
from pointspark.operators import cluster as C
from pointspark.operators import fusion, ordered
from pointspark.operators import spatial as P
from pointspark.operators.graph import connected_components as components
from pointspark.plans.aggregates import JACCARD, jaccard
from pointspark.plans.joins import LOHI, SHARED, VOTES, WIDE, votes, wide
from pointspark.plans.registry import query
from pointspark.session import materialize

POINTS = X.POINTS

EDGES = "edges AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part)"
REACH = "r AS (SELECT node, node AS reach FROM nodes UNION SELECT r.node, e.b FROM r JOIN both_ways e ON r.reach = e.a)"


#: Components of nodes (node) and both_ways (a, b): a node takes the least component around it, as long as one is less.
LEAST = "cc(node, component) USING KEY (node) AS (SELECT node, node FROM nodes UNION (SELECT u.node, min(v.component) FROM recurring.cc u JOIN both_ways e ON e.a = u.node JOIN cc v ON v.node = e.b WHERE v.component < u.component GROUP BY u.node))"


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), nodes AS (SELECT DISTINCT a AS node FROM both_ways), {LEAST}
SELECT node, component FROM cc""")
def connected_components(spark, d):
    p = X.table(spark, d, "part")
    return components(p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1 + F.col("p_size") % 3).alias("b")))


@query(f"""WITH RECURSIVE {JACCARD}, both_ways AS (SELECT a, b FROM j WHERE jaccard > 1e-1 UNION SELECT b, a FROM j WHERE jaccard > 1e-1), nodes AS (SELECT DISTINCT a AS node FROM both_ways), {REACH}
SELECT node AS old, min(reach) AS new FROM r GROUP BY node""")
def canonical_ids(spark, d):
    return C.unified_ids(jaccard(spark, d).select("a", "b"))


@query(f"""WITH RECURSIVE {POINTS}, {VOTES}, b AS (SELECT frame, sf, obj_id, cam, {LOHI} FROM votes GROUP BY 1, 2, 3, 4), e AS (SELECT DISTINCT p.obj_id AS a, q.obj_id AS b FROM b p JOIN b q ON p.frame = q.frame AND p.sf = q.sf AND p.obj_id < q.obj_id AND p.cam <> q.cam WHERE {SHARED} > 9),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), nodes AS (SELECT DISTINCT a AS node FROM both_ways), {REACH} SELECT node AS obj_id, min(reach) AS root FROM r GROUP BY node""")
def equivalence_roots(spark, d):
    return C.equivalent_objects(votes(spark, d), ("frame", "sf"))


KEYED = f"keyed AS MATERIALIZED (SELECT *, frame * 1000000 + (vx + 50) * 10000 + (vy + 50) * 100 + vz + 50 AS key FROM wide)"
BETWEEN = "(a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) + (a.vz - b.vz) * (a.vz - b.vz)"


def keyed(spark, d):
    """Voxels with a number that names them: their frame and place."""
    return wide(spark, d).withColumn("key", (F.col("frame") * 1000000 + (F.col("vx") + 50) * 10000 + (F.col("vy") + 50) * 100 + F.col("vz") + 50).cast("bigint"))


@query(f"""WITH RECURSIVE {POINTS}, {WIDE}, {KEYED}, both_ways AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM keyed a JOIN keyed b ON a.frame = b.frame AND {BETWEEN} <= 4 WHERE a.key <> b.key), nodes AS (SELECT key AS node FROM keyed), {LEAST}
SELECT component AS region, count(*) AS n FROM cc GROUP BY component""")
def region_components(spark, d):
    """Voxel regions of every frame, and their size."""
    return C.regions(keyed(spark, d), 2.0, "key", ("frame",)).groupBy("region").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {POINTS}, {WIDE}, {KEYED}, pairs AS MATERIALIZED (SELECT a.frame, a.key AS a, b.key AS b, {BETWEEN} AS d2 FROM keyed a JOIN keyed b ON a.frame = b.frame AND {BETWEEN} <= 3),
core AS MATERIALIZED (SELECT a AS c FROM pairs GROUP BY a HAVING count(*) >= 8), both_ways AS MATERIALIZED (SELECT a, b FROM pairs WHERE a <> b AND a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), nodes AS (SELECT c AS node FROM core), {LEAST},
near AS (SELECT a, component, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS k FROM pairs JOIN cc ON b = node) SELECT key, frame, component AS cluster FROM keyed LEFT JOIN near ON key = a AND k = 1""")
def dbscan_labels(spark, d):
    """Density clusters of every frame's voxels at the first scale."""
    return C.dbscan(keyed(spark, d), 1.75, 8, "key", by=("frame",))


@query()
def cluster_representatives(spark, d):
    w = keyed(spark, d)
    c = C.dbscan(w, 1.5, 8, "key", by=("frame",)).where("cluster is not null")
    return C.representatives(w.join(c, ["key", "frame"]), ("frame", "cluster"), "key", C.VOXEL)


def drives(spark, d):
    """Poses of users that drive along x: every third step is 1 long, the others 4, and every fifth pose is turned by a quarter more."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = X.table(spark, d, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(w) - 1).cast("int").alias("frame"))
    k, x = F.floor(F.col("frame") / 5) % 4, F.col("frame") * 3.0 + F.when(F.col("frame") % 3 == 0, F.lit(0.0)).when(F.col("frame") % 3 == 1, F.lit(-2.0)).otherwise(F.lit(-1.0))
    c = F.when(k == 0, F.lit(1.0)).when(k == 2, F.lit(-1.0)).otherwise(F.lit(0.0))
    s = F.when(k == 1, F.lit(1.0)).when(k == 3, F.lit(-1.0)).otherwise(F.lit(0.0))
    o = F.lit(0.0)
    return n.select("seq", "frame", *[v.alias(f"m{i // 4}{i % 4}") for i, v in enumerate([c, -s, o, x, s, c, o, o, o, o, F.lit(1.0), o])])


DRIVES = "drives AS MATERIALIZED (SELECT seq, frame, frame * 3e0 + CASE frame % 3 WHEN 0 THEN 0e0 WHEN 1 THEN -2e0 ELSE -1e0 END AS x, frame // 5 % 4 AS k FROM (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame FROM events) t)"


def keyframes_sql(turns: str) -> str:
    """From a keyframe, the next is the first pose that ends its segment: 3 poses on, or 7 or more away, or turned."""
    return f"""WITH RECURSIVE {DRIVES}, f AS (SELECT seq, frame, x, k FROM drives WHERE frame = 0 UNION ALL SELECT n.seq, n.frame, n.x, n.k FROM (SELECT d.*, row_number() OVER (PARTITION BY d.seq ORDER BY d.frame) AS place FROM f JOIN drives d ON d.seq = f.seq AND d.frame > f.frame AND d.frame <= f.frame + 3
WHERE d.frame = f.frame + 3 OR d.x - f.x >= 7e0{turns}) n WHERE place = 1) SELECT seq, frame FROM f"""


@query(keyframes_sql(""))
def keyframes(spark, d):
    """Segments that end by number or by distance; turns count for nothing."""
    return ordered.keyframes(drives(spark, d), 3, shift=7.0, angle=9.0)


@query(keyframes_sql(" OR d.k <> f.k"))
def keyframes_by_turn(spark, d):
    """The same, and a quarter turn ends a segment too."""
    return ordered.keyframes(drives(spark, d), 3, shift=7.0)


def moving_boxes(spark, d):
    p = X.points(spark, d).withColumn("label", 1000 + F.col("segment"))
    return A.bounding_boxes(p, "frame", "label").withColumn("seq", F.lit(0))


@query()
def track_labels(spark, d):
    return ordered.track(moving_boxes(spark, d))


@query()
def nms_merge(spark, d):
    return C.nms(votes(spark, d).withColumnRenamed("sf", "region"))


@query()
def layer_growth(spark, d):
    v = votes(spark, d).groupBy("frame", "sf", *C.VOXEL).agg(F.min("obj_id").alias("obj_id"))
    return C.grow(v.withColumnRenamed("sf", "region").withColumn("obj_id", F.when(F.col("obj_id") < 1006, F.col("obj_id"))))


@query()
def fcm_clusters(spark, d):
    e = A.l2_normalized(X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), "v")
    found, _ = C.fuzzy_cmeans(e, "v", "vec_id", 5)
    return found.select("vec_id", "cluster")


@query()
def grid_votes(spark, d):
    m = X.masks(spark, d).select((F.col("frame") % 4).alias("seq"), F.col("obj_id"), "row", "col")
    return C.vote_into_grid(m, "seq", "obj_id")


@query()
def label_fusion(spark, d):
    """Region growing, votes, suppression, growth and painting of whole scans."""
    v = votes(spark, d).join(wide(spark, d), ["frame", *C.VOXEL], "left_semi")
    where = P.prompt_voxels(asked(X.points(spark, d).where("sem < 6").withColumn("obj_id", 1000 + F.col("segment") % 12)), v, X.poses(spark, d, turned=False), 4.0)
    return fusion.fuse_labels(wide(spark, d), v, where, radius=2.0)


def asked(points):
    """obj_id, keyframe, x, y, z: where each object is asked for, its first point (obj_id, frame, x, y, z)."""
    first = points.groupBy("obj_id").agg(F.min(F.struct(F.col("frame").alias("keyframe"), *P.XYZ)).alias("p"))
    return first.select("obj_id", "p.*")


@query(f"""WITH {POINTS}, c AS (SELECT frame, sem, segment, count(*) AS cnt, min(point_idx) AS i FROM points WHERE sem IN (0, 3, 6) GROUP BY 1, 2, 3), b AS (SELECT * FROM c WHERE cnt >= 4),
f AS (SELECT sem, segment, min(frame * 10000000 + i) AS first FROM b GROUP BY 1, 2), n AS (SELECT sem, segment, row_number() OVER (PARTITION BY sem ORDER BY first) AS inst FROM f)
SELECT p.frame, p.point_idx, coalesce(n.inst, 0) * 65536 + p.sem AS label FROM points p LEFT JOIN b ON p.frame = b.frame AND p.sem = b.sem AND p.segment = b.segment LEFT JOIN n ON b.sem = n.sem AND b.segment = n.segment""")
def auto_instance(spark, d):
    p = X.points(spark, d).select("frame", "point_idx", "sem", "segment")
    return fusion.auto_instances(p, [0, 3, 6], 4).select("frame", "point_idx", "label")


def walks(spark, d, drift: bool):
    """Poses of users that walk along x, with a turn by 3-4-5 at every other step; with drift steps are a quarter longer and every third pose is not turned."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = X.table(spark, d, "events")
    n = e.select(F.col("user_id").alias("seq"), (F.row_number().over(w) - 1).cast("int").alias("frame"))
    odd = (F.col("frame") % 2 == 1) & (F.lit(not drift) | (F.col("frame") % 3 != 0))
    c, s, o = F.when(odd, F.lit(0.6)).otherwise(F.lit(1.0)), F.when(odd, F.lit(0.8)).otherwise(F.lit(0.0)), F.lit(0.0)
    x = F.col("frame") * F.lit(1.25 if drift else 1.0)
    m = [c, -s, o, x, s, c, o, o, o, o, F.lit(1.0), o]
    return n.select("seq", "frame", *[v.alias(f"m{i // 4}{i % 4}") for i, v in enumerate(m)])


WALK = "n AS (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame FROM events)"
ERRORS = f"""{WALK}, l AS (SELECT CAST(unnest([2, 4]) AS DOUBLE) AS len), s AS (SELECT a.seq, a.frame AS first, len, min(b.frame) AS last FROM n a CROSS JOIN l JOIN n b ON a.seq = b.seq AND CAST(b.frame AS DOUBLE) > a.frame + len WHERE a.frame % 10 = 0 GROUP BY 1, 2, 3),
e AS (SELECT seq, first, len, last, round(CASE WHEN last % 6 = 3 THEN acos(6e-1) / len ELSE 0e0 END, 6) AS r_err, round((last - first) * 25e-2 / len, 6) AS t_err, round(len / (1e-1 * (last - first + 1)), 6) AS speed FROM s)"""


@query(f"WITH {ERRORS} SELECT * FROM e")
def odometry_eval(spark, d):
    e = fusion.odometry_errors(walks(spark, d, False), walks(spark, d, True), (2.0, 4.0))
    return e.select("seq", "first", "len", "last", F.round("r_err", 6).alias("r_err"), F.round("t_err", 6).alias("t_err"), F.round("speed", 6).alias("speed"))


@query(f"WITH {ERRORS}, k AS (SELECT n_nationkey * 2e0 AS bucket FROM nation WHERE n_nationkey BETWEEN 1 AND 12) SELECT bucket, count(*) AS n, round(avg(r_err), 6) AS r_err, round(avg(t_err), 5) AS t_err FROM e JOIN k ON abs(speed - bucket) < 2 GROUP BY bucket HAVING count(*) >= 3")
def odometry_by_speed(spark, d):
    e = fusion.odometry_errors(walks(spark, d, False), walks(spark, d, True), (2.0, 4.0))
    b = ordered.errors_by(e.withColumns({c: F.round(c, 6) for c in ("speed", "t_err", "r_err")}), [float(v) for v in range(2, 25, 2)], "speed", 2.0)
    return b.select("bucket", "n", F.round("r_err", 6).alias("r_err"), F.round("t_err", 5).alias("t_err"))


@query(f"WITH {ERRORS} SELECT len AS bucket, count(*) AS n, round(avg(r_err), 6) AS r_err, round(avg(t_err), 5) AS t_err FROM e GROUP BY len HAVING count(*) >= 3")
def odometry_by_length(spark, d):
    e = fusion.odometry_errors(walks(spark, d, False), walks(spark, d, True), (2.0, 4.0))
    b = ordered.errors_by(e.withColumns({c: F.round(c, 6) for c in ("t_err", "r_err")}), [2.0, 4.0], "len", 1.0)
    return b.select("bucket", "n", F.round("r_err", 6).alias("r_err"), F.round("t_err", 5).alias("t_err"))


@query(f"WITH {POINTS}, b AS (SELECT frame, CAST(floor(x / 4e0) AS BIGINT) AS vx, CAST(floor(y / 4e0) AS BIGINT) AS vy, CAST(floor(z / 4e0) AS BIGINT) AS vz, count(*) AS n FROM points GROUP BY 1, 2, 3, 4), s AS (SELECT frame, min(vx) AS lx, max(vx) AS hx, min(vy) AS ly, max(vy) AS hy FROM b GROUP BY frame) SELECT p.frame AS a, q.frame AS b, round((CASE WHEN (p.lx <= q.lx AND q.hx <= p.hx AND p.ly <= q.ly AND q.hy <= p.hy) OR (q.lx <= p.lx AND p.hx <= q.hx AND q.ly <= p.ly AND p.hy <= q.hy) THEN 1e0 ELSE CAST(greatest(least(p.hx, q.hx) - greatest(p.lx, q.lx) + 1, 0) * greatest(least(p.hy, q.hy) - greatest(p.ly, q.ly) + 1, 0) AS DOUBLE) / ((p.hx - p.lx + 1) * (p.hy - p.ly + 1) + (q.hx - q.lx + 1) * (q.hy - q.ly + 1) - greatest(least(p.hx, q.hx) - greatest(p.lx, q.lx) + 1, 0) * greatest(least(p.hy, q.hy) - greatest(p.ly, q.ly) + 1, 0)) END), 9) AS iou FROM s p JOIN s q ON q.frame = p.frame + 1")
def box_iou(spark, d):
    s = wide(spark, d).groupBy("frame").agg(F.min("vx").alias("lx"), F.max("vx").alias("hx"), F.min("vy").alias("ly"), F.max("vy").alias("hy"))
    p = s.select((F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"p{c}") for c in ("lx", "hx", "ly", "hy")])
    iou = G.box_iou_cells([F.col("plx"), F.col("ply")], [F.col("phx"), F.col("phy")], [F.col("lx"), F.col("ly")], [F.col("hx"), F.col("hy")])
    return s.join(p, "frame").select((F.col("frame") - 1).alias("a"), F.col("frame").alias("b"), F.round(iou, 9).alias("iou"))


@query(f"""WITH RECURSIVE {X.MASKS}, px AS MATERIALIZED (SELECT DISTINCT frame, cam, row, col, ((frame * 4 + cam) * 64 + row) * 64 + col AS key FROM masks), both_ways AS MATERIALIZED (SELECT a.key AS a, b.key AS b FROM px a JOIN px b ON a.frame = b.frame AND a.cam = b.cam AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.key <> b.key),
nodes AS (SELECT key AS node FROM px), {LEAST} SELECT frame, cam, row, col, CAST(component // 64 % 64 AS INTEGER) AS first_row, CAST(component % 64 AS INTEGER) AS first_col, count(*) OVER (PARTITION BY component) AS size FROM px JOIN cc ON key = node""")
def pixel_components(spark, d):
    return C.pixel_components(X.masks(spark, d)).drop("component")


def prompted(spark, d):
    """Prompts and negatives of every frame's voxels of 2, at two scales."""
    v = X.points(spark, d).select(F.col("frame").alias("kf"), *P.voxel_keys(2.0)).distinct()
    return C.prompt_objects(v, ((1.0, 4), (1.5, 6)))


@query()
def prompt_objects(spark, d):
    return prompted(spark, d)[0]


@query()
def prompt_negatives(spark, d):
    return prompted(spark, d)[1]


@query()
def ground_textures(spark, d):
    return C.ground_textures(X.points(spark, d).where("z <= -1"), 2.0, 5)


@query()
def prelabel(spark, d):
    """The whole pre-labelling of a sequence at the resolution of a scene's configuration, masks given as a table."""
    from pointspark.plans.prelabel import prelabel

    c = SceneConfig()
    p = X.points(spark, d).select("frame", "point_idx", "x", "y", "z", "intensity")
    # both are drawn from all order lines, and are read several times; without turns no voxel of this size would meet those of other scans
    poses, masks = materialize(X.poses(spark, d), "poses"), materialize(X.masks(spark, d), "masks")
    return prelabel(p, poses, masks, asked(X.mask_points(spark, d)), width=c.window, voxel=c.voxel_size, radius=c.voxel_grow, threshold=c.temporal_threshold)
