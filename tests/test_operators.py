"""Small cases worked out by hand, and brute-force twins."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointspark.config import SceneConfig, parse_settings, parse_yaml
from pointspark.functions import geometry as G
from pointspark.functions import scalars as S
from pointspark.operators import aggregates as A
from pointspark.operators import cluster as C
from pointspark.operators import fusion, ordered
from pointspark.operators import joins as J
from pointspark.operators import selection as O
from pointspark.operators import spatial as P
from pointspark.operators.graph import connected_components

POINT = "frame int, point_idx int, x double, y double, z double, intensity double"


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def shift_poses(spark, shifts, by="frame"):
    m = lambda x: [1.0, 0.0, 0.0, float(x), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    return spark.createDataFrame([(i, *m(x)) for i, x in enumerate(shifts)], "frame int, " + ", ".join(f"{n} double" for n in G.names("m")))


def test_voxel_max(spark):
    p = spark.createDataFrame([(0, 0, 0.1, 0.1, 0.1, 0.3), (0, 1, 0.19, 0.05, 0.0, 0.9), (0, 2, -0.1, 0.1, 0.1, 0.5)], POINT)
    assert tuples(P.voxel_max(p, 0.2, "frame")) == [(0, -1, 0, 0, 0.5), (0, 0, 0, 0, 0.9)]


def test_superframe(spark):
    p = spark.createDataFrame([(f, 0, 0.1, 0.1, 0.1, (f + 1) / 10) for f in range(3)], POINT)
    out = P.superframe_voxels(p, shift_poses(spark, [0, 1, 2]), 3, 0.2).where("frame = 1")
    assert tuples(out.select("vx", "vy", "vz", "intensity")) == [(-5, 0, 0, 0.1), (0, 0, 0, 0.2), (5, 0, 0, 0.3)]


@pytest.mark.parametrize(("n", "step", "starts"), [(20, 1, [0, 7, 14]), (20, 3, [0, 4, 8, 12, 16])])
def test_keyframes(spark, n, step, starts):
    poses = shift_poses(spark, [step * i for i in range(n)]).withColumn("seq", F.lit(0))
    assert sorted(r.frame for r in ordered.keyframes(poses, 7).collect()) == starts


def test_islands(spark):
    f = spark.createDataFrame([(0, i) for i in (0, 1, 2, 20, 21, 40)] + [(1, 5), (1, 6)], "seq int, frame int")
    assert tuples(ordered.loops(f, ("seq",), "frame").select("seq", "first", "last")) == [(0, 0, 2), (0, 20, 21), (0, 40, 40)]


def test_dense_ids(spark):
    rows = [(0, i, v) for i, v in enumerate((0, 1003, 1001, 1003))] + [(1, i, v) for i, v in enumerate((1001, 17, 0))]
    df = spark.createDataFrame(rows, "frame int, point_idx int, v long")
    got = {r.v: r.dense for r in ordered.dense_ids(df, "v", ("frame", "point_idx"), 1025).collect()}
    assert got == {0: 0, 1003: 1025, 1001: 1026, 17: 1027}


def test_box_iou(spark):
    lit = lambda v: [F.lit(c) for c in v]
    a = G.box_iou_cells(lit((0, 0, 0)), lit((1, 1, 1)), lit((1, 1, 1)), lit((2, 2, 2)))
    b = G.box_iou_cells(lit((0, 0, 0)), lit((5, 5, 5)), lit((1, 1, 1)), lit((2, 2, 2)))
    c = G.box_iou(lit((0.0, 0.0)), lit((2.0, 2.0)), lit((1.0, 1.0)), lit((3.0, 3.0)))
    r = spark.range(1).select(a.alias("a"), b.alias("b"), c.alias("c")).first()
    assert r.a == pytest.approx(1 / 15) and r.b == 1 and r.c == pytest.approx(1 / 7)
    assert C.overlap(*map(np.array, ((0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 2)))) == pytest.approx(1 / 15)


def test_label_merge_and_bits(spark):
    df = spark.createDataFrame([(0, 7), (5, 8), (0, 0)], "a long, b long")
    assert [r[0] for r in df.select(O.merge_labels(F.col("a"), F.col("b"))).collect()] == [7, 5, 0]
    r = spark.range(1).select(S.pack(F.lit(10), F.lit(3)).alias("p")).select("p", S.semantic(F.col("p")), S.instance(F.col("p"))).first()
    assert tuple(r) == (196618, 10, 3)
    assert spark.range(1).select(S.instance(S.pack(F.lit(1), F.lit(0xFFFF)))).first()[0] == 0xFFFF


def test_tile_overlap(spark):
    df = spark.createDataFrame([(7.0, 0.0), (8.0, 0.0), (7.0, 7.0), (7.5, 7.5), (9.0, 0.0)], "px double, py double")
    got = [r[0] for r in df.select(J.tile_overlaps(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.col("px"), F.col("py"), 3.0)).collect()]
    assert got == [True, True, True, False, False]


def test_temporal_overlap(spark):
    life = spark.createDataFrame([("a", 10, 20), ("b", 12, 25)], "obj_id string, lo int, hi int")
    seen = life.select("obj_id", F.explode(F.array("lo", "hi")).alias("frame"))
    for n, matches in ((11, 1), (10, 0)):
        pairs = spark.createDataFrame([("a", "b", n)], "a string, b string, n long")
        assert A.temporal_jaccard(pairs, A.lifetimes(seen)).count() == matches


def test_truncation_toward_zero(spark):
    df = spark.createDataFrame([(-0.4,), (0.9,), (1.7,), (-1.2,)], "v double")
    assert [r[0] for r in df.select(S.truncate(F.col("v"))).collect()] == [0, 0, 1, -1]


def test_auto_instance(spark):
    rows = [(0, i, 10, 1025) for i in range(30)] + [(0, 30 + i, 10, 1026) for i in range(29)] + [(0, 99, 4, 1025)]
    df = spark.createDataFrame(rows, "frame int, point_idx int, sem long, segment long")
    got = {(r.sem, r.segment): r.label for r in fusion.auto_instances(df, [10]).collect()}
    assert got == {(10, 1025): 65536 + 10, (10, 1026): 10, (4, 1025): 4}


def test_tracker():
    box = lambda k, x, s: (k, np.array([x, 0.0, 0.0]), np.array([x + s[0], s[1], s[2]]))
    same = ordered.track_boxes(iter([(0, [box(1000, 0.0, (1, 1, 1))]), (1, [box(1001, 1.9, (0.9, 0.95, 0.9))])]))
    assert list(same) == [(0, 1000, 1000), (1, 1001, 1000)]
    flat = ordered.track_boxes(iter([(0, [box(1000, 0.0, (1, 1, 1))]), (1, [box(1001, 1.9, (0.9, 0.9, 0.8))])]))
    assert list(flat)[1] == (1, 1001, 1001)
    empty = ordered.track_boxes(iter([(0, []), (1, [box(1001, 0.0, (1, 1, 1))])]))
    assert list(empty) == [(1, 1001, 1001)]
    thin = ordered.track_boxes(iter([(0, [box(1000, 0.0, (0, 1, 1))]), (1, [box(1001, 0.0, (0, 1, 1))])]))
    assert list(thin)[1] == (1, 1001, 1001)


def test_zbuffer_and_majority_ties(spark):
    px = spark.createDataFrame([(1, 1, 5.0, 0, 0.1), (1, 1, 5.0, 1, 0.9)], "row int, col int, depth double, point_idx int, intensity double")
    assert P.zbuffer(px).first().intensity == 0.1
    m = spark.createDataFrame([(3,), (3,), (2,), (2,)], "v int")
    assert A.majority(m, "v").first().major == 2


def test_largest_paints_last(spark):
    df = spark.createDataFrame([(0, "A", 10), (0, "B", 4), (1, "B", 4)], "cell int, label string, size int")
    assert tuples(ordered.last_writer(df, ("cell",), "label", "size")) == [(0, "A"), (1, "B")]


def test_instance_split(spark):
    df = spark.createDataFrame([(2 << 16 | 10,), (3 << 16 | 10,), (2 << 16 | 11,)], "label long")
    g = O.Relabel("split", selected_class=10, selected_instance=2, new_instance=7)
    assert [r[0] for r in df.select(O.relabel(F.col("label"), F.lit(True), F.lit(True), g)).collect()] == [7 << 16 | 10, 3 << 16 | 10, 2 << 16 | 11]
    hidden = O.Relabel("polygon", new_label=5, overwrite=True, hide_instances=True)
    assert [r[0] for r in df.select(O.relabel(F.col("label"), F.lit(True), F.lit(True), hidden)).collect()] == [2 << 16 | 10, 3 << 16 | 10, 2 << 16 | 11]
    with pytest.raises(ValueError):
        O.relabel(F.col("label"), F.lit(True), F.lit(True), O.Relabel("blur"))


@pytest.mark.parametrize("mode", ["paint", "polygon", "merge", "add", "split", "remove", "create", "join"])
def test_relabel_spares_what_is_not_shown(spark, mode):
    df = spark.createDataFrame([(i % 3 << 16 | i % 5, i % 2 == 0) for i in range(60)], "label long, shown boolean")
    g = O.Relabel(mode, new_label=9, old_label=3, overwrite=True, selected_class=3, selected_instance=1, new_instance=8)
    out = df.select("label", "shown", O.relabel(F.col("label"), F.col("shown"), F.lit(True), g).alias("new"))
    assert out.where("not shown and label <> new").count() == 0 and out.where("label <> new").count() > 0


def test_triangles_cover_the_polygon():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    area = lambda t: abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2
    assert sum(map(area, G.triangulate(ring))) == pytest.approx(10.0)
    assert sum(map(area, G.triangulate(ring[::-1]))) == pytest.approx(10.0)
    assert len(G.triangulate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])) == 1
    with pytest.raises(ValueError):
        G.triangulate([(0.0, 0.0), (1.0, 1.0)])


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, edges):
    parent = {v: v for e in edges for v in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: find(parent, v) for v in parent}


def test_components_of_a_long_chain(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(e).select("component").distinct().collect()[0][0] == 0
    assert connected_components(e.limit(0)).count() == 0


def cells(spark, n=150, size=9, seed=1):
    rng = np.random.default_rng(seed)
    xyz = sorted({tuple(int(c) for c in v) for v in rng.integers(-size, size, (n, 3))})
    return xyz, spark.createDataFrame([(i, *v) for i, v in enumerate(xyz)], "key long, vx long, vy long, vz long")


def test_radius_join(spark):
    xyz, df = cells(spark)
    want = sorted((i, j) for i, a in enumerate(xyz) for j, b in enumerate(xyz) if sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) <= 9)
    assert tuples(J.radius_join(df, df, C.VOXEL, 3.0).select("key", "r_key")) == want


def test_regions_and_dbscan(spark):
    xyz, df = cells(spark)
    v = np.array(xyz)
    near = ((v[:, None] - v[None]) ** 2).sum(-1)
    parent = list(range(len(v)))
    for i, j in zip(*np.where(near <= 4), strict=True):
        a, b = find(parent, i), find(parent, j)
        parent[max(a, b)] = min(a, b)
    assert {r.key: r.region for r in C.regions(df, 2.0, "key").collect()} == {i: find(parent, i) for i in range(len(v))}

    got = {r.key: r.cluster for r in C.dbscan(df, 3.0, 5, "key").collect()}
    core = (near <= 9).sum(1) >= 5
    parent = list(range(len(v)))
    for i, j in zip(*np.where(near <= 9), strict=True):
        if core[i] and core[j]:
            a, b = find(parent, i), find(parent, j)
            parent[max(a, b)] = min(a, b)
    for i in range(len(v)):
        reach = [(near[i, j], j) for j in np.flatnonzero(core & (near[i] <= 9))]
        assert got[i] == (find(parent, min(reach)[1]) if reach else None)


def test_suppression():
    lo = {1: np.array([0, 0, 0]), 2: np.array([1, 1, 1]), 3: np.array([9, 9, 9])}
    hi = {1: np.array([4, 4, 4]), 2: np.array([2, 2, 2]), 3: np.array([10, 10, 10])}
    assert C.suppress({1: 50, 2: 8, 3: 8}, lo, hi) == {1: 1, 2: 1, 3: 3}


def test_growth():
    own = {1: np.array([[0, 0, 0], [1, 0, 0]])}
    free = np.array([[2, 0, 0], [3, 0, 0], [4, 0, 0], [30, 0, 0], [2, 0, 5]])
    assert sorted(c for c, _ in C.grow_layers(own, free, 3.5)) == [(2, 0, 0), (3, 0, 0), (4, 0, 0)]
    assert C.grow_layers(own, np.zeros((0, 3), int), 3.5) == []


def brute_growth(labels, free, eps):
    left, out = [tuple(v) for v in free.tolist()], []
    close = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for label in sorted(labels, key=lambda k: (-len(labels[k]), k)):
        for z in sorted({v[2] for v in labels[label].tolist()}):
            layer, own = [v for v in left if v[2] == z], [v for v in labels[label].tolist() if v[2] == z]
            near = {v: [w for w in layer if close(v, w) <= eps * eps] for v in layer}
            group, number = dict.fromkeys(layer, -1), 0
            for v in layer:
                if group[v] < 0 and len(near[v]) >= 3:
                    queue, group[v] = [v], number
                    while queue:
                        for w in near[queue.pop(0)]:
                            if group[w] < 0:
                                group[w] = number
                                if len(near[w]) >= 3:
                                    queue.append(w)
                    number += 1
            hit = {g for v, g in group.items() if any(close(v, o) < eps * eps for o in own)}
            out += [(v, label) for v in layer if group[v] in hit]
            left = [v for v in left if v[2] != z or group[v] not in hit]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_growth_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    free = np.unique(rng.integers(0, (40, 40, 3), (260, 3)), axis=0)
    free = free[np.lexsort(free.T)]
    labels = {k: np.unique(rng.integers(0, (40, 40, 3), (4 + k % 3, 3)), axis=0) for k in range(5)}
    for eps in (1.0, 2.0, 3.5):
        assert sorted(C.grow_layers(labels, free, eps)) == sorted(brute_growth(labels, free, eps))


def test_grid_votes():
    # two points of three meet 1, which is not over 0.7; the third segment meets 2 where 1 was before
    grid, ids = C.vote_segments([(1, [(0, 0), (0, 1)]), (2, [(0, 1), (0, 0), (5, 5)]), (3, [(0, 0), (0, 0), (0, 0), (7, 7)]), (4, [(9, 9)])])
    assert ids == {1: 1, 2: 2, 3: 2, 4: 3} and grid[0, 1] == 2 and grid[7, 7] == 2


def test_empty_tables(spark):
    from pointspark.operators import aggregates as A

    p = spark.createDataFrame([], "frame int, point_idx int, x double, y double, z double, intensity double, label long")
    assert C.ground_textures(p, 1.0, 3).count() == 0
    assert A.quantile_edges(spark.createDataFrame([], "val double")).count() == 0
    assert A.labelled_ratio(p).first().ratio is None
    found, centres = C.fuzzy_cmeans(spark.createDataFrame([], "i long, v array<double>"), "v", "i", 3)
    assert found.count() == 0 and centres.size == 0
    found, _ = C.fuzzy_cmeans(spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (3, [5.0, 6.0])], "i long, v array<double>"), "v", "i", 2)
    assert found.count() == 3
    v = spark.createDataFrame([], "frame int, vx long, vy long, vz long, region long, obj_id long")
    assert C.grow(v).count() == 0 and C.nms(v).count() == 0 and C.vote_into_grid(v.selectExpr("frame", "obj_id", "int(vx) as row", "int(vy) as col"), "frame", "obj_id").count() == 0
    assert C.pixel_components(v.selectExpr("frame", "0 as cam", "int(vx) as row", "int(vy) as col")).count() == 0


def test_angle_search():
    height = lambda a: 300 - 100 * a
    assert ordered.narrowed(height, 0.0, 3.0, (90.0, 110.0), 1.95) == 1.95
    assert 190 <= height(ordered.narrowed(height, 0.0, 3.0, (190.0, 210.0), 3.0)) <= 210
    assert 90 <= height(ordered.narrowed(height, 0.0, 3.0, (90.0, 110.0), 0.1)) <= 110
    assert ordered.narrowed(lambda a: None, 0.0, 3.0, (0.0, 1.0), 0.5) == 0.5
    assert ordered.narrowed(height, 0.0, 3.0, (900.0, 910.0), 1.0) == 1.0


def test_matrices(spark):
    from pointspark.functions import geometry as G

    rng = np.random.default_rng(8)
    m = rng.normal(size=(20, 16))
    m[0] = 0
    rows = spark.createDataFrame([tuple(map(float, r)) for r in m], [f"m{i}" for i in range(16)])
    cols = [F.col(f"m{i}") for i in range(16)]
    got = [list(r) for r in rows.select(*[c.alias(f"i{i}") for i, c in enumerate(G.inverse_whole(cols))]).collect()]
    assert got[0] == [None] * 16
    for a, b in zip(m[1:], got[1:], strict=True):
        assert np.allclose(np.linalg.inv(a.reshape(4, 4)).ravel(), b)
    two = [list(r) for r in rows.select(*G.solve_two(cols[:4], cols[4:6])).collect()]
    assert two[0] == [None, None] and np.allclose(two[1:], [np.linalg.solve(a[:4].reshape(2, 2), a[4:6]) for a in m[1:]])
    back = rows.select(*[c.alias(n) for c, n in zip(G.rotation_vector(G.from_rotation_vector(cols[:3])), "xyz", strict=True)]).collect()
    for a, b in zip(m[1:, :3], back[1:], strict=True):
        n = np.linalg.norm(a)
        assert np.allclose(a if n <= np.pi else a / n * (n - 2 * np.pi), list(b))
    half = spark.range(1).select(*G.rotation_vector(G.turn_about([F.lit(1.0), F.lit(-2.0), F.lit(2.0)], F.lit(np.pi)))).first()
    assert np.allclose(np.abs(list(half)), np.pi * np.array([1, 2, 2]) / 3, atol=1e-6) and half[0] * half[1] < 0
    for first in (True, False):
        y, p, r = 0.3, -0.4, 0.5
        z, yy, x = (np.array(a) for a in ([[np.cos(y), -np.sin(y), 0], [np.sin(y), np.cos(y), 0], [0, 0, 1]], [[np.cos(p), 0, np.sin(p)], [0, 1, 0], [-np.sin(p), 0, np.cos(p)]], [[1, 0, 0], [0, np.cos(r), -np.sin(r)], [0, np.sin(r), np.cos(r)]]))
        got = spark.range(1).select(*G.yaw_pitch_roll(F.lit(y), F.lit(p), F.lit(r), [F.lit(1.0), F.lit(2.0), F.lit(3.0)], first)).first()
        assert np.allclose(np.array(got).reshape(3, 4), np.column_stack([z @ yy @ x if first else z @ x @ yy, [1, 2, 3]]))


def test_fusion_keeps_the_object_near_its_prompt(spark):
    v = [(0, x, 0, 0) for x in (*range(5), *range(50, 55))]
    voxels = spark.createDataFrame(v, "frame int, vx long, vy long, vz long")
    votes = spark.createDataFrame([(0, x, 0, 0, 1000, 0, 0, 1) for x in (0, 1, 2, 50)], "frame int, vx long, vy long, vz long, obj_id long, cam int, sf int, cnt long")
    prompts = spark.createDataFrame([(0, 1000, 0, 0, 0)], "frame int, obj_id long, vx long, vy long, vz long")
    got = {r.vx: r.label for r in fusion.fuse_labels(voxels, votes, prompts).collect()}
    assert [got[x] for x in range(5)] == [1000] * 5 and all(got[x] == 0 for x in range(50, 55))


def test_fuzzy_cmeans(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 0.1, 2) + (5 * (i % 2), 0)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    found, centres = C.fuzzy_cmeans(df, "v", "key", 2)
    kinds = {k: {r.cluster for r in found.where(F.col("key") % 2 == k).collect()} for k in (0, 1)}
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]
    assert sorted(round(c[0]) for c in centres) == [0, 5]


def test_transform_and_its_inverse(spark):
    m = G.multiply(G.translation(F.lit(1.0), F.lit(-2.0), F.lit(3.0)), G.multiply(G.rotation("z", F.lit(0.7)), G.rotation("x", F.lit(-0.4))))
    p = G.apply(m, F.lit(1.5), F.lit(2.5), F.lit(-3.5))
    for inverse in (G.invert(m), G.affine_inverse(m)):
        assert list(spark.range(1).select(*G.apply(inverse, *p)).first()) == pytest.approx([1.5, 2.5, -3.5])
    assert spark.range(1).select(G.rotation_angle(G.rotation("y", F.lit(0.3)))).first()[0] == pytest.approx(0.3)


def test_colours(spark):
    v = [F.lit(0.2), F.lit(0.7), F.lit(0.4)]
    r = spark.range(1).select(*S.hsv_to_rgb(*S.rgb_to_hsv(*v)), *S.unpack_rgb(S.pack_rgb(*v))).first()
    assert list(r[:3]) == pytest.approx([0.2, 0.7, 0.4]) and list(r[3:]) == pytest.approx([0.2, 0.7, 0.4], abs=0.002)


def test_hull():
    assert P.hull_fill([(0, 0), (2, 0), (0, 2)]) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
    assert P.hull_fill([(1, 1), (1, 1)]) == [(1, 1)]
    assert P.hull_fill([(0, 0), (3, 0), (1, 0)]) == [(0, 0), (1, 0), (3, 0)]


def test_rasterise(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 10, 0.5), (0, 0, 0, 5, 0.9), (0, 0, 0, -5, 0.1)], "frame int, vx long, vy long, vz long, intensity double")
    camera = [F.lit(float(c)) for c in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)]
    out = P.rasterise(voxels, camera, 1.0, 20.0, 20.0, 8.0, 8.0, 32, 32).toPandas()
    assert set(out["depth"]) == {5.0} and set(out["intensity"]) == {0.9} and (8, 8) in set(zip(out["row"], out["col"], strict=True))


def test_settings_and_yaml():
    assert parse_settings("tile size: 100\nno colon\nrange: 2.5") == {"tile size": "100", "range": "2.5"}
    c = parse_yaml("a: 1\nb:\n  c: [0.6, 1.2]  # scales\n  d: yes it is\ne: true\n")
    assert c.b.c == [0.6, 1.2] and c.b.d == "yes it is" and c.e is True
    assert SceneConfig.of({"window": 9, "other": 1}).window == 9
    with pytest.raises(AttributeError):
        c.missing


def test_small_helpers():
    assert ordered.task_split(10, 3) == [(0, 3), (3, 6), (6, 10)]
    assert ordered.page(0, 99, 30, 3) == (90, 99) and ordered.page(5, 99, 30, 0) == (5, 34)
    assert ordered.bisect(lambda v: v - 0.3, 0, 1) == pytest.approx(0.3)
    assert O.visibility_delta([1, 2], [2, 3]) == ([3], [1])


def test_numbers_by_range(spark):
    rng = np.random.default_rng(5)
    v = [int(x) for x in rng.permutation(500)]
    out = ordered.numbered(spark.createDataFrame([(x,) for x in v], "v int"), ("v",), 10, "n").collect()
    assert sorted((r.v, r.n) for r in out) == [(i, i + 10) for i in range(500)]
    assert ordered.numbered(spark.createDataFrame([], "v int"), ("v",), 1, "n").count() == 0


def test_pixel_components(spark):
    rng = np.random.default_rng(6)
    px = sorted({(0, int(k), int(r), int(c)) for k, r, c in zip(rng.integers(0, 2, 160), rng.integers(0, 14, 160), rng.integers(0, 14, 160), strict=True)})
    parent = list(range(len(px)))
    for i, a in enumerate(px):
        for j, b in enumerate(px[:i]):
            if a[1] == b[1] and abs(a[2] - b[2]) <= 1 and abs(a[3] - b[3]) <= 1:
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    got = {(r.frame, r.cam, r.row, r.col): (r.component, r["size"]) for r in C.pixel_components(spark.createDataFrame(px, "frame int, cam int, row int, col int")).collect()}
    roots = [find(parent, i) for i in range(len(px))]
    for i, a in enumerate(px):
        assert got[a][1] == roots.count(roots[i])
        for j, b in enumerate(px[:i]):
            assert (got[a][0] == got[b][0]) == (roots[i] == roots[j])


def test_prompts_and_negatives(spark):
    cube = lambda x: [(0, x + i, j, k) for i in range(3) for j in range(3) for k in range(3)]
    v = spark.createDataFrame(cube(0) + cube(20) + [(0, 100, 0, 0)], "kf int, vx long, vy long, vz long")
    prompts, neg = C.prompt_objects(v, ((1.0, 4), (2.0, 6)))
    assert sorted((r.obj_id, r.scale, r.vx) for r in prompts.collect()) == [(1000, 0, 1), (1001, 0, 21), (1002, 1, 1), (1003, 1, 21)]
    assert sorted(map(tuple, neg.collect())) == [(1000, 1, 1003), (1001, 1, 1002), (1002, 1, 1003), (1003, 1, 1002)]


def test_nearest_join(spark):
    rng = np.random.default_rng(7)
    a, b = rng.uniform(-5, 5, (40, 2)), rng.uniform(-5, 5, (60, 2))
    left = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "key int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)], "key int, x double, y double")
    got = {r.key: r.r_key for r in J.nearest_join(left, right, ("x", "y"), ("key",), "key", 1.5).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert got == {i: int(d[i].argmin()) for i in range(40) if d[i].min() <= 1.5}


def test_hulls_together():
    rng = np.random.default_rng(8)
    xs, ys = rng.integers(-6, 9, (300, 5)), rng.integers(-4, 7, (300, 5))
    xs[:20], ys[20:40] = 3, xs[20:40]  # some on a line
    xs[40], ys[40] = 2, 2
    at, x, y = P.hull_runs(xs, ys)
    for i in range(300):
        assert sorted(set(zip(x[at == i].tolist(), y[at == i].tolist(), strict=True))) == sorted(P.hull_fill(list(zip(xs[i].tolist(), ys[i].tolist(), strict=True))))
    assert [len(v) for v in P.hull_runs(xs[:0], ys[:0])] == [0, 0, 0]


def dense_clusters(rows, eps, least):
    """Density clusters by their definition: rows (key, place)."""
    near = {a: [b for b, q in rows if sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) <= eps * eps] for a, p in rows}
    place, core = dict(rows), {a for a in near if len(near[a]) >= least}
    root = {a: a for a in core}
    changed = True
    while changed:
        changed = False
        for a in core:
            low = min(root[b] for b in near[a] if b in core)
            if low < root[a]:
                root[a], changed = low, True
    out = {}
    for a in near:
        d = [(sum((x - y) ** 2 for x, y in zip(place[a], place[b], strict=True)), b) for b in near[a] if b in core]
        out[a] = root[min(d)[1]] if d else None
    return out


@pytest.mark.parametrize("seed,axes", [(1, ("x", "y")), (2, ("x", "y", "z")), (3, ("x", "y", "z"))])
def test_full_cells_are_one_node(spark, seed, axes):
    rng = np.random.default_rng(seed)
    middles = rng.uniform(-6, 6, (5, len(axes)))
    spread = rng.choice([0.15, 0.5, 1.2], 5)
    v = np.concatenate([rng.normal(m, s, (45, len(axes))) for m, s in zip(middles, spread, strict=True)] + [rng.uniform(-8, 8, (40, len(axes)))])
    v[:20] = np.round(v[:20])
    rows = [(i, tuple(x)) for i, x in enumerate(v.tolist())]
    df = spark.createDataFrame([(i, i % 2, *x) for i, x in rows], "key long, part long, " + ", ".join(f"{a} double" for a in axes))
    for eps, least in ((0.6, 4), (1.0, 12)):
        assert {r.key: r.cluster for r in C.dbscan(df, eps, least, "key", axes).collect()} == dense_clusters(rows, eps, least)
    halves = {}
    for half in (0, 1):
        halves |= dense_clusters([r for r in rows if r[0] % 2 == half], 0.8, 5)
    assert {r.key: r.cluster for r in C.dbscan(df, 0.8, 5, "key", axes, ("part",)).collect()} == halves


def test_pairs_do_not_grow_with_the_square_of_a_cell(spark, monkeypatch):
    """A thousand points in one place and some around them: no pair within the place is made."""
    made = {}
    keep = C.materialize

    def counted(df, label):
        out = keep(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(C, "materialize", counted)
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.uniform(0, 0.2, (1000, 3)), rng.uniform(0.2, 1.5, (10, 3)), rng.uniform(5, 9, (5, 3))])
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(v.tolist())], "key long, x double, y double, z double")
    got = {r.key: r.cluster for r in C.dbscan(df, 1.0, 8, "key", ("x", "y", "z")).collect()}
    assert all(got[i] == 0 for i in range(1000)) and made["neighbours"] <= 15 * 1015
    assert got == dense_clusters([(i, tuple(x)) for i, x in enumerate(v.tolist())], 1.0, 8)


def test_long_chains_are_joined_by_parts(spark, monkeypatch):
    """Every round over all edges cost the whole table again, a round for each doubling of the chain."""
    from pointspark.operators import graph

    rounds, whole = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: rounds.append(label) or whole(df, label))
    n = 3000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    far = spark.createDataFrame([(10_000, 10_007), (10_007, 5), (20_001, 20_000), (7, 7), (30_000, 30_000)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(chain.unionByName(far).repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 10_000: 0, 10_007: 0, 20_000: 20_000, 20_001: 20_000, 30_000: 30_000}
    assert rounds.count("stars") <= 5
