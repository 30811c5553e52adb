"""Grouped, focal and ordered aggregates."""

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.functions import scalars as S
from pointspark.operators import aggregates as A
from pointspark.operators import ordered as W
from pointspark.plans.registry import query

POINTS = X.POINTS


@query(f"WITH {POINTS} SELECT frame, point_idx, round(intensity * sqrt(x * x + y * y + z * z), 6) AS intensity FROM points")
def range_intensity(spark, d):
    p = X.points(spark, d)
    return p.select("frame", "point_idx", F.round(A.range_intensity(F.col("x"), F.col("y"), F.col("z"), F.col("intensity")), 6).alias("intensity"))


ENDS = "e AS (SELECT min(x) AS x0, min(y) AS y0, min(intensity) AS lo, max(intensity) AS hi FROM points)"
CELLS = f"{ENDS}, cells AS (SELECT CAST(trunc((y - y0) / 2e0) AS INTEGER) AS row, CAST(trunc((x - x0) / 2e0) AS INTEGER) AS col, max((intensity - lo) / (hi - lo)) AS val FROM points CROSS JOIN e GROUP BY 1, 2)"


@query(f"WITH {POINTS}, {ENDS} SELECT frame, point_idx, CAST(trunc((y - y0) / 2e0) AS INTEGER) AS row, CAST(trunc((x - x0) / 2e0) AS INTEGER) AS col FROM points CROSS JOIN e")
def bev_cells(spark, d):
    return A.bev_cells(X.points(spark, d), 2.0).select("frame", "point_idx", "row", "col")


@query(f"WITH {POINTS}, {CELLS} SELECT row, col, val FROM cells")
def bev_max(spark, d):
    return A.bev_max(X.points(spark, d), 2.0)


@query(f"""WITH {POINTS}, {ENDS}, v AS (SELECT (intensity - lo) / (hi - lo) * (5e-1 + point_idx % 7 / 14e0) AS val FROM points CROSS JOIN e),
n AS (SELECT CAST(least(floor(val * 1000), 999) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1),
b AS (SELECT a.n_nationkey * 40 + b.n_nationkey AS bin FROM nation a CROSS JOIN (SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey + 25 FROM nation WHERE n_nationkey < 15) b),
h AS (SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN n ON b.bin = n.bin),
c AS (SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS c FROM h),
s AS (SELECT c AS c1, (bin + 1) / 1e3 AS x1, lag(c) OVER (ORDER BY bin) AS c0, bin / 1e3 AS x0 FROM c),
q AS (SELECT CAST(n_nationkey AS INTEGER) AS k, n_nationkey / 1e1 AS q FROM nation WHERE n_nationkey <= 10),
r AS (SELECT k, q, c0, c1, x0, x1, row_number() OVER (PARTITION BY k ORDER BY x1) AS o FROM q JOIN s ON c1 >= q)
SELECT k, round(CASE WHEN k = 0 THEN 0e0 WHEN c0 IS NULL OR c0 >= q THEN x1 ELSE x0 + (q - c0) / (c1 - c0) * (x1 - x0) END, 9) AS edge FROM r WHERE o = 1""")
def quantile_edges(spark, d):
    p = A.normalized(X.points(spark, d)).select((F.col("intensity") * (0.5 + F.col("point_idx") % 7 / 14.0)).alias("val"))
    return A.quantile_edges(p).select("k", F.round("edge", 9).alias("edge"))


EDGES = [0.0, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.0]
BIN = "CASE " + " ".join(f"WHEN val >= {a!r} AND val {'<=' if k == 9 else '<'} {b!r} THEN {k}" for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END"


@query(f"""WITH {POINTS}, {CELLS}, b AS (SELECT row, col, {BIN} AS bin FROM cells), n AS (SELECT a.row, a.col, b.bin FROM cells a JOIN b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2),
c AS (SELECT row, col, bin, count(*) AS n FROM n GROUP BY 1, 2, 3), t AS (SELECT row, col, sum(n) AS t FROM c GROUP BY 1, 2)
SELECT c.row, c.col, CAST(bin AS INTEGER) AS bin, CAST(n AS DOUBLE) / CAST(t AS DOUBLE) AS share FROM c JOIN t ON c.row = t.row AND c.col = t.col WHERE bin IS NOT NULL""")
def focal_histogram(spark, d):
    return A.focal_histogram(A.bev_max(X.points(spark, d), 2.0), EDGES)


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS n FROM e GROUP BY vec_id) SELECT e.vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(v AS DOUBLE) / n, 5) + 0e0 AS v FROM e JOIN n ON e.vec_id = n.vec_id")
def l2_normalize(spark, d):
    e = A.l2_normalized(X.table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return e.select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.round("v", 5) + 0.0)


@query("WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY 1, 2")
def mean_vector(spark, d):
    return A.mean_vector(X.table(spark, d, "embeddings"), "embedding", "label").withColumn("mean", F.round("mean", 6))


SIDES = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, max({c}) - min({c}) AS size_{c}, min({c}) + (max({c}) - min({c})) / 2e0 AS mid_{c}" for c in "xyz")


@query(f"WITH {POINTS} SELECT label, {SIDES} FROM points WHERE inst > 0 AND sem * 20 <= 200 GROUP BY label")
def bbox_static(spark, d):
    p = X.points(spark, d).where((F.col("inst") > 0) & ~S.is_moving(F.col("sem") * 20))
    return A.bounding_boxes(p, "label")


@query(f"WITH {POINTS} SELECT label, frame, {SIDES} FROM points WHERE inst > 0 AND sem * 20 > 200 GROUP BY label, frame")
def bbox_moving(spark, d):
    p = X.points(spark, d).where((F.col("inst") > 0) & S.is_moving(F.col("sem") * 20))
    return A.bounding_boxes(p, "label", "frame")


@query(f"WITH {POINTS} SELECT label % 65536 AS sem, max(label // 65536) AS max_inst FROM points GROUP BY 1")
def max_instance(spark, d):
    return A.max_instance(X.points(spark, d))


@query(f"WITH {POINTS} SELECT frame, sem, segment, count(*) AS cnt FROM points GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def cooccurrence_having(spark, d):
    return A.cooccurrence(X.points(spark, d), "frame", "sem", "segment", least=4)


@query(f"WITH {POINTS}, c AS (SELECT frame, sem, segment, count(*) AS cnt FROM points GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY frame, sem ORDER BY cnt DESC, segment) AS k FROM c) SELECT frame, sem, segment AS major, cnt FROM r WHERE k = 1")
def majority_label(spark, d):
    return A.majority(X.points(spark, d), "segment", "frame", "sem")


@query(f"WITH {POINTS} SELECT frame, count(*) FILTER (WHERE sem <> 0) AS labelled, count(*) AS n, CAST(count(*) FILTER (WHERE sem <> 0) AS DOUBLE) / count(*) AS ratio FROM points GROUP BY frame")
def labelled_ratio(spark, d):
    return A.labelled_ratio(X.points(spark, d), "frame")


HEIGHT = "h AS (SELECT CAST(floor(x / 5e-1) AS BIGINT) AS hx, CAST(floor(y / 5e-1) AS BIGINT) AS hy, min(z) AS h FROM points WHERE sem <> 1 GROUP BY 1, 2)"


@query(f"WITH {POINTS}, {HEIGHT} SELECT * FROM h")
def heightmap_min(spark, d):
    return A.heightmap(X.points(spark, d))


SMOOTH = "s AS (SELECT hx + i AS hx, hy + j AS hy, h FROM h CROSS JOIN (SELECT a.k AS i, b.k AS j FROM (VALUES (-1), (1)) a(k) CROSS JOIN (VALUES (-1), (1)) b(k)) o), m AS (SELECT h.hx, h.hy, round(coalesce(sum(s.h) / count(s.h), min(h.h)), 9) AS h FROM h LEFT JOIN s ON h.hx = s.hx AND h.hy = s.hy GROUP BY h.hx, h.hy)"


@query(f"WITH {POINTS}, {HEIGHT}, {SMOOTH} SELECT * FROM m")
def heightmap_smooth(spark, d):
    return A.smooth_diagonal(A.heightmap(X.points(spark, d))).withColumn("h", F.round("h", 9))


@query(f"WITH {POINTS}, {HEIGHT} SELECT frame, point_idx FROM points JOIN h ON CAST(floor(x / 5e-1) AS BIGINT) = hx AND CAST(floor(y / 5e-1) AS BIGINT) = hy WHERE z > h + 1e0")
def height_above_ground(spark, d):
    p = X.points(spark, d)
    return A.above_ground(p.select("frame", "point_idx", "x", "y", "z"), A.heightmap(p), 1.0).select("frame", "point_idx")


@query(f"WITH {X.TRAJECTORY}, w AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts, event_id) AS k FROM trajectory) SELECT seq, event_id, round(CAST(sum(CASE WHEN k = 1 THEN 0 ELSE CAST(step AS DECIMAL(20, 6)) END) OVER (PARTITION BY seq ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS dist FROM w")
def path_length(spark, d):
    t = W.path_length(X.trajectory(spark, d), ("seq",), ("ts", "event_id"), F.col("step").cast("decimal(20,6)"))
    return t.select("seq", "event_id", F.round(F.col("dist").cast("double"), 6).alias("dist"))


PATH = f"{X.TRAJECTORY}, w AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ts, event_id) AS k FROM trajectory), path AS (SELECT seq, CAST(k - 1 AS INTEGER) AS frame, CAST(sum(CASE WHEN k = 1 THEN 0 ELSE CAST(step AS DECIMAL(20, 6)) END) OVER (PARTITION BY seq ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS dist FROM w)"


def path(spark, d):
    from pyspark.sql import Window

    t = W.path_length(X.trajectory(spark, d), ("seq",), ("ts", "event_id"), F.col("step").cast("decimal(20,6)"))
    n = F.row_number().over(Window.partitionBy("seq").orderBy("ts", "event_id"))
    return t.select("seq", (n - 1).cast("int").alias("frame"), F.col("dist").cast("double").alias("dist"))


@query(f"WITH {PATH}, l AS (SELECT CAST(unnest([100, 200, 400]) AS DOUBLE) AS len) SELECT a.seq, a.frame AS first, len, min(b.frame) AS last FROM path a CROSS JOIN l JOIN path b ON a.seq = b.seq AND b.dist > a.dist + len WHERE a.frame % 2 = 0 GROUP BY 1, 2, 3")
def segment_end(spark, d):
    return W.segment_ends(path(spark, d), (100, 200, 400), every=2)


HOURS = "hours AS (SELECT DISTINCT user_id AS seq, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame FROM events)"


def hours(spark, d):
    return X.table(spark, d, "events").select(F.col("user_id").alias("seq"), F.floor(F.unix_timestamp("ts") / 3600).cast("bigint").alias("frame")).distinct()


ISLANDS = f"{HOURS}, c AS (SELECT seq, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY seq ORDER BY frame) > 10 THEN 1 ELSE 0 END AS cut FROM hours), i AS (SELECT seq, frame, CAST(sum(cut) OVER (PARTITION BY seq ORDER BY frame) AS BIGINT) AS island FROM c), g AS (SELECT seq, island, min(frame) AS first, max(frame) AS last, count(*) AS n FROM i GROUP BY 1, 2)"


@query(f"WITH {ISLANDS} SELECT * FROM g")
def scan_islands(spark, d):
    return W.islands(hours(spark, d), ("seq",), "frame")


@query(f"WITH {ISLANDS} SELECT * FROM g WHERE seq IN (SELECT seq FROM g GROUP BY seq HAVING count(*) > 1)")
def loop_islands(spark, d):
    return W.loops(hours(spark, d), ("seq",), "frame")


@query(f"""WITH {POINTS}, f AS (SELECT segment - 1025 AS v, min(frame * 10000000 + point_idx) AS first FROM points GROUP BY 1)
SELECT v AS value, CASE WHEN v = 0 THEN 0 ELSE 1024 + row_number() OVER (PARTITION BY v = 0 ORDER BY first) END AS dense FROM f""")
def dense_ids(spark, d):
    p = X.points(spark, d).withColumn("value", F.col("segment") - 1025)
    return W.dense_ids(p, "value", ("frame", "point_idx"), 1025)


@query(f"""WITH {POINTS}, f AS (SELECT sem, segment, min(frame * 10000000 + point_idx) AS first FROM points GROUP BY 1, 2) SELECT sem, segment, row_number() OVER (PARTITION BY sem ORDER BY first) AS dense FROM f""")
def dense_instances(spark, d):
    return W.dense_ids(X.points(spark, d), "segment", ("frame", "point_idx"), 1, ("sem",))


@query(f"""WITH {X.MASKS}, s AS (SELECT frame, obj_id, count(*) AS size FROM masks GROUP BY 1, 2), r AS (SELECT m.frame, row, col, m.obj_id, row_number() OVER (PARTITION BY m.frame, row, col ORDER BY size DESC, m.obj_id DESC) AS k FROM masks m JOIN s ON m.frame = s.frame AND m.obj_id = s.obj_id)
SELECT frame, row, col, obj_id FROM r WHERE k = 1""")
def last_writer_wins(spark, d):
    m = X.masks(spark, d)
    size = m.groupBy("frame", "obj_id").agg(F.count("*").alias("size"))
    return W.last_writer(m.join(size, ["frame", "obj_id"]), ("frame", "row", "col"), "obj_id", "size")


@query("WITH f AS (SELECT DISTINCT o_custkey AS frame FROM orders), l AS (SELECT min(frame) AS lo FROM f) SELECT frame, (frame - lo) // 200 AS batch FROM f CROSS JOIN l")
def batches_200(spark, d):
    return W.batches(X.table(spark, d, "orders").select(F.col("o_custkey").alias("frame")).distinct())


@query(f"""WITH {POINTS}, f AS (SELECT DISTINCT frame FROM points), c AS (SELECT f.frame, count(p.frame) AS size FROM f LEFT JOIN points p ON p.frame = f.frame AND p.z > 1e0 GROUP BY f.frame)
SELECT frame, CAST(sum(size) OVER (ORDER BY frame) - size AS BIGINT) AS start, size FROM c""")
def buffer_offsets(spark, d):
    p = X.points(spark, d)
    return W.buffer_offsets(p.where("z > 1"), p.select("frame"))


@query(f"WITH {X.TRAJECTORY} SELECT seq, event_id, round(step - first_value(step) OVER (PARTITION BY seq ORDER BY ts, event_id), 6) AS step FROM trajectory")
def rebase_first(spark, d):
    return W.rebased(X.trajectory(spark, d), ("seq",), ("ts", "event_id"), ("step",)).select("seq", "event_id", F.round("step", 6).alias("step"))


@query(f"""WITH {POINTS}, c AS (SELECT frame, sem, count(DISTINCT CAST(floor(x / 2e0) AS BIGINT)) AS v FROM points GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY sem ORDER BY frame), 0) AS b, coalesce(lead(v) OVER (PARTITION BY sem ORDER BY frame), 0) AS a FROM c)
SELECT frame, sem, v, b + v + a AS three FROM w WHERE v >= b AND v >= a""")
def local_peaks(spark, d):
    c = X.points(spark, d).groupBy("frame", "sem").agg(F.countDistinct(F.floor(F.col("x") / 2.0)).alias("v"))
    return W.local_peak(c, ("sem",), "frame", "v")


@query(f"WITH {POINTS} SELECT frame, count(DISTINCT CAST(floor(x / 2e0) AS BIGINT) * 1000000 + CAST(floor(y / 2e0) AS BIGINT) * 1000 + CAST(floor(z / 2e0) AS BIGINT)) AS n FROM points GROUP BY frame")
def visible_voxels(spark, d):
    from pointspark.operators.spatial import voxel_keys

    return X.points(spark, d).select("frame", *voxel_keys(2.0)).groupBy("frame").agg(F.countDistinct("vx", "vy", "vz").alias("n"))


@query("SELECT p_brand AS camera, round(avg(p_retailprice), 6) AS height, round(avg(CAST(p_size AS DOUBLE)), 6) AS pitch FROM part GROUP BY p_brand")
def camera_means(spark, d):
    return X.table(spark, d, "part").groupBy(F.col("p_brand").alias("camera")).agg(F.round(F.avg("p_retailprice"), 6).alias("height"), F.round(F.avg(F.col("p_size").cast("double")), 6).alias("pitch"))


@query(f"""WITH {X.MASKS}, p AS (SELECT DISTINCT a.frame, a.obj_id AS a, b.obj_id AS b FROM masks a JOIN masks b ON a.frame = b.frame AND a.row = b.row AND a.obj_id < b.obj_id) SELECT a, b, count(*) AS n FROM p GROUP BY a, b""")
def pair_frame_counts(spark, d):
    return A.pair_frames(X.masks(spark, d).select("frame", "row", "obj_id").distinct(), ("frame", "row"), "obj_id")


SEEN = "seen AS (SELECT DISTINCT o_custkey % 40 AS obj_id, CAST(o_orderkey % 64 AS INTEGER) AS frame FROM orders WHERE o_totalprice > 2e5)"
SETS = "sets AS (SELECT DISTINCT frame, obj_id % 5 AS root, obj_id FROM seen)"


def seen(spark, d):
    o = X.table(spark, d, "orders").where("o_totalprice > 2e5")
    return o.select((F.col("o_custkey") % 40).alias("obj_id"), (F.col("o_orderkey") % 64).cast("int").alias("frame")).distinct()


JACCARD = f"""{SEEN}, {SETS}, p AS (SELECT a.obj_id AS a, b.obj_id AS b, count(DISTINCT a.frame) AS n FROM sets a JOIN sets b ON a.frame = b.frame AND a.root = b.root AND a.obj_id < b.obj_id GROUP BY 1, 2),
life AS (SELECT obj_id, min(frame) - 3 AS born, max(frame) + 3 AS gone FROM seen GROUP BY obj_id),
j AS (SELECT a, b, n, CAST(n AS DOUBLE) / (least(x.gone, y.gone) - greatest(x.born, y.born) + 1) AS jaccard FROM p JOIN life x ON a = x.obj_id JOIN life y ON b = y.obj_id)"""


def jaccard(spark, d):
    s = seen(spark, d)
    pairs = A.pair_frames(s.withColumn("root", F.col("obj_id") % 5), member="obj_id")
    return A.temporal_jaccard(pairs, A.lifetimes(s), threshold=0.1)


@query(f"WITH {JACCARD} SELECT a, b, n, jaccard FROM j WHERE jaccard > 1e-1")
def temporal_jaccard(spark, d):
    return jaccard(spark, d)


@query(f"WITH {SEEN} SELECT obj_id, min(frame) - 3 AS born, max(frame) + 3 AS gone FROM seen GROUP BY obj_id")
def lifetimes(spark, d):
    return A.lifetimes(seen(spark, d))
