"""Queries and plans that once did a part of their job."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.functions import udtf
from pointspark.operators import aggregates as A
from pointspark.operators import cluster as C
from pointspark.operators import fusion
from pointspark.operators import spatial as P
from pointspark.plans import catalog
from pointspark.plans import prelabel as plan


def test_fcm_clusters_uses_whole_vectors_until_they_settle(spark, data):
    got = {r.vec_id: r.cluster for r in catalog.queries()["fcm_clusters"](spark, data).collect()}
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").select("vec_id", "embedding").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = v[:5]
    for _ in range(30):
        d = np.maximum(((v[:, None] - c) ** 2).sum(-1), 1e-12)
        u = (1 / d / (1 / d).sum(1, keepdims=True)) ** 2
        old, c = c, (u.T @ v) / u.sum(0)[:, None]
        if np.abs(c - old).max() < 1e-4:
            break
    d = ((v[:, None] - c) ** 2).sum(-1)
    near = np.sort(d, axis=1)
    sure = near[:, 1] - near[:, 0] > 1e-9
    assert all(got[r.vec_id] == k for r, k, s in zip(rows, d.argmin(1), sure, strict=True) if s)


VOTES = "frame int, vx long, vy long, vz long, obj_id long, cam int, sf int, cnt long"


def box(obj, cam, x, y, frame=0):
    return [(frame, x + i, y + j, k, obj, cam, 0, 1) for i in range(3) for j in range(3) for k in range(3)]


def test_each_camera_votes_with_its_own_masks(spark):
    points = spark.createDataFrame([(0, 1.0, 5.0, 0.0)], "frame int, x double, y double, z double")
    eye = [float(i // 4 == i % 4) for i in range(12)]
    poses = spark.createDataFrame([(0, *eye)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    views = plan.default_pixels()
    at = [points.select(row.alias("row"), col.alias("col")).first() for _, row, col in views]
    masks = spark.createDataFrame([(0, k, 1000 + k, p.row, p.col) for k, p in enumerate(at)], "frame int, cam int, obj_id long, row int, col int")
    votes = plan.mask_votes(points, masks, poses, views, 1, 1.0)
    assert sorted((r.cam, r.obj_id) for r in votes.collect()) == [(k, 1000 + k) for k in range(4)]


def shuffled_rows(spark):
    """Rows that all stages so far have written for others."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_of_a_pixel_and_a_voxel_are_shuffled_as_one(spark):
    n, objects = 2000, range(1000, 1020)
    points = spark.createDataFrame([(f, 1.5 + i * 1e-6, 5.5, 0.1) for f in range(3) for i in range(n)], "frame int, x double, y double, z double")
    eye = [float(i // 4 == i % 4) for i in range(12)]
    poses = spark.createDataFrame([(f, *eye) for f in range(3)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    views = plan.default_pixels()
    at = points.select(views[0][1].alias("row"), views[0][2].alias("col")).distinct().collect()
    assert len(at) == 1
    masks = spark.createDataFrame([(f, 0, k, at[0].row, at[0].col) for f in range(3) for k in objects], "frame int, cam int, obj_id long, row int, col int")
    before = shuffled_rows(spark)
    got = {(r.frame, r.vx, r.vy, r.vz, r.obj_id, r.cam, r.sf): r.cnt for r in plan.mask_votes(points, masks, poses, views, 3, 1.0).collect()}
    assert got == {(f, 1, 5, 0, k, 0, s): n for f in range(3) for k in objects for s in (-1, 0, 1) if 0 <= f + s < 3}
    assert shuffled_rows(spark) - before < n


def test_votes_are_those_of_every_point_with_every_mask(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(int(f), *map(float, rng.uniform(-20, 20, 2)), float(rng.uniform(-2, 2))) for f in range(4) for _ in range(150)], "frame int, x double, y double, z double")
    turn = lambda f: (0.6, -0.8, 0, 0.5 * f, 0.8, 0.6, 0, -0.25 * f, 0, 0, 1, 0) if f % 2 else (1, 0, 0, 0.5 * f, 0, 1, 0, 0, 0, 0, 1, 0)
    poses = spark.createDataFrame([(f, *map(float, turn(f))) for f in range(4)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    # frame 3 has no masks, camera 2 none at all; a row that is there twice counts twice
    rows = [(f, c, 1000 + int(rng.integers(4)), int(rng.integers(48)), int(rng.integers(64))) for f in range(3) for c in (0, 1, 3) for _ in range(2500)]
    masks = spark.createDataFrame(rows, "frame int, cam int, obj_id long, row int, col int")
    held = {}
    for f, c, k, row, col in rows:
        held.setdefault((f, c, row, col), []).append(k)
    moves = {(r.centre, r.frame): [[r[f"m{i}{j}"] for j in range(4)] for i in range(3)] for r in P.relative_poses(P.frame_window(poses, 3), poses).collect()}
    views = plan.default_pixels()
    expected = {}
    for r in points.select("frame", *P.XYZ, *[c.alias(f"{n}{i}") for i, v in enumerate(views) for n, c in zip(("cam", "row", "col"), v, strict=True)]).collect():
        for (centre, frame), m in moves.items():
            if frame == r.frame:
                v = tuple(int(np.floor((m[i][0] * r.x + m[i][1] * r.y + m[i][2] * r.z + m[i][3]) / 2.0)) for i in range(3))
                for i in range(4):
                    for k in held.get((frame, i, r[f"row{i}"], r[f"col{i}"]), ()):
                        key = (centre, *v, k, i, frame - centre)
                        expected[key] = expected.get(key, 0) + 1
    got = {(r.frame, r.vx, r.vy, r.vz, r.obj_id, r.cam, r.sf): r.cnt for r in plan.mask_votes(points, masks, poses, views, 3, 2.0).collect()}
    assert got == expected and sum(got.values()) > 500


def test_sets_are_those_of_fusion(spark):
    # 1 and 2 overlap from two cameras; 3 and 4 stand in the same slab of x, apart in y
    rows = box(1, 0, 0, 0) + box(2, 1, 0, 1) + box(3, 0, 0, 40) + box(4, 1, 0, 80) + box(1, 0, 0, 0, 1) + box(2, 1, 0, 30, 1)
    votes = spark.createDataFrame(rows, VOTES)
    prompts = spark.createDataFrame([(f, *p) for f in (0, 1) for p in ((1, 0, 0, 0), (2, 0, 1, 0), (3, 0, 40, 0), (4, 0, 80, 0))], "frame int, obj_id long, vx long, vy long, vz long")
    cells = votes.select("frame", *C.VOXEL).distinct()
    labels, sets = fusion.fuse_with_sets(cells, votes, prompts, radius=2.0)
    assert {(r.a, r.b, r.n) for r in A.pair_frames(sets).collect()} == {(1, 2, 1)}
    assert {r.label for r in labels.where("frame = 0").collect()} == {1, 3, 4}


def block(x, y, more=()):
    """The points of an object of three by three columns, and of the ground below."""
    columns = [(x + i, y + j) for i in range(3) for j in range(3)] + list(more)
    return [(a + 0.5, b + 0.5, z + 0.5) for a, b in columns for z in (1, 2, 3)], [(a + 0.5, b + 0.5, 0.0) for a, b in columns]


def test_prelabel_gives_the_expected_labels(spark):
    # a stands; b moves by one; c is in no mask; a column beside a is in no mask either
    scenes, points, want = {0: 20, 1: 21}, [], {}
    for frame, x in scenes.items():
        objects = [block(5, 0, [(8, 3)]), block(x, 10), block(40, 40)]
        own = [(p, label) for (body, _), label in zip(objects, (1025, 1026, 0), strict=True) for p in body] + [(p, 0) for _, ground in objects for p in ground]
        for i, (p, label) in enumerate(own):
            points.append((frame, i, *p, 0.5))
            want[frame, i] = label
    # camera 0 sees y and z, camera 1 x and z; each gave its objects numbers of its own
    masks = [(f, 0, o, z, c + i) for f in scenes for o, c in ((1000, 0), (1001, 10)) for z in (1, 2, 3) for i in range(3)]
    masks += [(f, 1, o, z, c + i) for f, x in scenes.items() for o, c in ((1010, 5), (1011, x)) for z in (1, 2, 3) for i in range(3)]
    whole = lambda c: F.floor(c).cast("int")
    views = [(F.lit(0), whole("z"), whole("y")), (F.lit(1), whole("z"), whole("x"))]
    eye = [float(i // 4 == i % 4) for i in range(12)]
    poses = spark.createDataFrame([(f, *eye) for f in scenes], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    p = spark.createDataFrame(points, "frame int, point_idx int, x double, y double, z double, intensity double")
    m = spark.createDataFrame(masks, "frame int, cam int, obj_id long, row int, col int")
    got = {(r.frame, r.point_idx): r.label for r in plan.prelabel(p, poses, m, voxel=1.0, pixel=views).collect()}
    assert got == want


def test_prelabel_from_scans(spark):
    def squares(pdf):
        out = [(r.frame, r.cam, r.obj_id, r.row + i, r.col + j) for r in pdf.itertuples() for i in range(-12, 13) for j in range(-12, 13)]
        return pd.DataFrame(out, columns=["frame", "cam", "obj_id", "row", "col"])

    points, mine = [], {}
    for frame in range(2):
        bodies = [(x, y, z) for x0 in (-6, 5) for x in range(x0, x0 + 3) for y in range(3) for z in (1, 2, 3)]
        ground = sorted({(x, y, 0) for x, y, _ in bodies})
        for i, (x, y, z) in enumerate(bodies + ground):
            points.append((frame, i, x + 0.5, y + 0.5, z + 0.5 if z else 0.0, 0.5))
            mine[frame, i] = "ground" if z == 0 else "left" if x < 0 else "right"
    eye = [float(i // 4 == i % 4) for i in range(12)]
    poses = spark.createDataFrame([(f, *eye) for f in range(2)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    p = spark.createDataFrame(points, "frame int, point_idx int, x double, y double, z double, intensity double")
    cells = P.superframe_voxels(p.where("z > 0"), poses, 7, 1.0)
    keys = spark.createDataFrame([(0,)], "frame int")  # one keyframe for both scans
    prompts, _ = plan.prompt_places(cells, keys, 1.0, ((1.5, 8),))
    asked = plan.clicks(cells, prompts, poses, plan.Views.ring(spark), 7, 1.0)
    assert prompts.count() == 2 and {(r.frame, r.obj_id) for r in asked.collect()} == {(f, o) for f in (0, 1) for o in (1000, 1001)}
    got = plan.prelabel_scans(p, poses, squares, voxel=1.0, scales=((1.5, 8),)).collect()
    labels = {k: {r.label for r in got if mine[r.frame, r.point_idx] == k} for k in ("ground", "left", "right")}
    assert labels["ground"] == {0} and len(got) == len(points)
    assert len(labels["left"]) == len(labels["right"]) == 1 and {1025, 1026} == labels["left"] | labels["right"]


def moving_poses(spark, n):
    """Poses that drive along x and turn by a quarter every frame, with their matrices."""
    rows, mats = [], []
    for f in range(n):
        c, s = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)][f % 4]
        m = np.array([[c, -s, 0, 10.0 * f], [s, c, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
        rows.append((f, *m[:3].ravel().tolist()))
        mats.append(m)
    return spark.createDataFrame(rows, "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12))), mats


def test_prompts_stand_where_the_poses_put_them(spark):
    poses, m = moving_poses(spark, 6)
    prompts = spark.createDataFrame([(1, 2, 3.5, 4.5, 0.5), (2, 0, -1.5, 2.5, 1.5)], "obj_id long, keyframe int, x double, y double, z double")
    seen = spark.createDataFrame([(f, o) for f in range(6) for o in (1, 2, 9)], "frame int, obj_id long")
    got = {(r.frame, r.obj_id): (r.vx, r.vy, r.vz) for r in P.prompt_voxels(prompts, seen, poses, 1.0).collect()}
    want = {}
    for o, k, *p in ((1, 2, 3.5, 4.5, 0.5), (2, 0, -1.5, 2.5, 1.5)):
        for f in range(6):
            want[f, o] = tuple(np.floor(np.round(np.linalg.inv(m[f]) @ m[k] @ [*p, 1], 6))[:3].astype(int).tolist())
    assert got == want


def test_fusion_keeps_the_region_at_the_moved_prompt(spark):
    """One object stands still in the world; what masks say of it bleeds onto another thing, in each frame elsewhere."""
    poses, m = moving_poses(spark, 4)
    world, wrong = np.array([20.0, 30.0, 0.0]), np.array([20.0, -30.0, 0.0])
    rows, true = [], {}
    for f in range(4):
        for at, keep in ((world, True), (wrong, False)):
            x, y, _ = np.round((np.linalg.inv(m[f]) @ [*at, 1])[:3]).astype(int).tolist()
            cells = box(1, 0, x - 1, y - 1, f)
            rows += cells
            true.update({(f, *c[1:4]): 1 if keep else 0 for c in cells})
    votes = spark.createDataFrame(rows, VOTES)
    x, y, z = (np.linalg.inv(m[0]) @ [*world, 1])[:3].tolist()
    prompts = spark.createDataFrame([(1, 0, x + 0.5, y + 0.5, z + 0.5)], "obj_id long, keyframe int, x double, y double, z double")
    cells = votes.select("frame", *C.VOXEL).distinct()
    placed = P.prompt_voxels(prompts, votes, poses, 1.0)
    got = {(r.frame, r.vx, r.vy, r.vz): r.label for r in fusion.fuse_labels(cells, votes, placed, radius=2.0).collect()}
    assert got == true
    # without a prompt both stay
    assert {r.label for r in fusion.fuse_labels(cells, votes, None, radius=2.0).collect()} == {1}
    # an object that has no prompt keeps what it has, beside one that has
    assert {r.label for r in fusion.fuse_labels(cells, votes, placed.where("frame > 0"), radius=2.0).where("frame = 0").collect()} == {1}


@pytest.mark.parametrize("width", [3, 5, 7])
def test_frames_show_the_keyframes_whose_windows_meet_theirs(spark, width):
    n, keys, h = 17, (0, 6, 12, 16), width // 2
    poses, _ = moving_poses(spark, n)
    got = {(r.frame, r.keyframe) for r in P.shown_keyframes(poses, spark.createDataFrame([(k,) for k in keys], "frame int"), width).collect()}
    want = set()
    for f in range(n):
        for at in range(max(0, f - h), min(n - 1, f + h)):
            want |= {(f, k) for k in keys if max(0, k - h) <= at <= min(n - 1, k + h)}
    assert got == want


def test_clicks_in_every_frame_in_reach(spark):
    """A cube is asked for in keyframe 0 and a wall hides it in frame 1; a camera looks along the world's y from each pose."""
    eye = [[1.0, 0.0, 0.0, 2.0 * f, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0] for f in range(8)]
    poses = spark.createDataFrame([(f, *e) for f, e in enumerate(eye)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    cube = [(x, y, z) for x in range(3) for y in range(10, 13) for z in range(3)]
    cells = []
    for f in range(8):
        cells += [(f, x - 2 * f, y, z, 0.5) for x, y, z in cube]
        if f == 1:
            cells += [(f, x - 2, 4, z, 0.5) for x in range(-3, 6) for z in range(-3, 6)]
    cells = spark.createDataFrame(cells, "frame int, vx long, vy long, vz long, intensity double")
    prompts = spark.createDataFrame([(1000, 0, 1.5, 10.5, 1.5)], "obj_id long, keyframe int, x double, y double, z double")
    # right is x, down is -z, ahead is y
    views = plan.Views(((1.0, 0, 0, 0, 0, 0, -1.0, 0, 0, 1.0, 0, 0),), focal=60.0, width=200, height=100)
    got = {(r.frame, r.cam, r.obj_id, r.row, r.col) for r in plan.clicks(cells, prompts, poses, views, 5, 1.0).collect()}
    # windows of two frames to each side: keyframe 0 shows in frames 0 to 3 by the end of the window before them, and 4; frame 1 is hidden
    want = set()
    for f in (0, 2, 3, 4):
        x, y, z = 1.5 - 2 * f, 10.5, 1.5
        col, row = int(60 * x / y + 100), int(60 * -z / y + 50)
        if 0 <= col < 200:
            want.add((f, 0, 1000, row, col))
    assert got == want


class Told:
    """A session that writes down what it is asked, to a folder that the tasks share."""

    def __init__(self, folder, cam, frames):
        import json
        import os

        self.cam, self.frames, self.log, self.path, self.json = cam, frames, [], f"{folder}/{cam}-{frames[0]}-{os.getpid()}-{id(self)}.json", json

    def say(self, *what):
        self.log.append(what)
        with open(self.path, "w") as f:
            self.json.dump([self.cam, self.frames, self.log], f)

    def click(self, index, obj_id, points, labels):
        self.say("click", index, obj_id, points.tolist(), labels.tolist())

    def propagate(self, reverse=False):
        self.say("propagate", reverse)
        for i in reversed(range(len(self.frames))) if reverse else range(len(self.frames)):
            mask = np.zeros((4, 4), bool)
            if self.frames[i] != 12:  # of frame 12 nothing is found
                mask[int(reverse), i % 4] = True
            if not (reverse and i == 0):  # the way back does not say anything of the first picture
                yield i, mask


def test_objects_are_followed_with_their_negatives(spark, tmp_path):
    import json

    rows = [(f, 0, 1, f, 1) for f in (3, 4, 9, 12)] + [(4, 0, 2, 7, 7), (9, 0, 3, 8, 8), (4, 0, 3, 5, 5), (5, 0, 3, 6, 6), (4, 1, 2, 9, 9)] + [(30, 1, 1, 2, 2)]
    clicks = spark.createDataFrame(rows, "frame int, cam int, obj_id long, row int, col int")
    negatives = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (2, 1, 3)], "obj_id long, rank int, neg_obj_id long")
    folder = str(tmp_path)
    got = sorted(map(tuple, udtf.video_masks(clicks, negatives, lambda cam, frames: Told(folder, cam, frames), batch=5).collect()))
    log = sorted(json.loads(p.read_text()) for p in tmp_path.glob("*.json"))
    both = [["propagate", False], ["propagate", True]]
    assert log == sorted([
        # object 1 in camera 0: frames 3 to 12 by fives; negatives by rank, in frames where they have clicks
        [0, [3, 4, 5, 6, 7], [["click", 0, 1, [[1, 3]], [1]], ["click", 1, 1, [[1, 4], [5, 5], [7, 7]], [1, 0, 0]], *both]],
        [0, [8, 9, 10, 11, 12], [["click", 1, 1, [[1, 9], [8, 8]], [1, 0]], ["click", 4, 1, [[1, 12]], [1]], *both]],
        [0, [4], [["click", 0, 2, [[7, 7], [5, 5]], [1, 0]], *both]],
        [0, [4, 5, 6, 7, 8], [["click", 0, 3, [[5, 5]], [1]], ["click", 1, 3, [[6, 6]], [1]], *both]],
        [0, [9], [["click", 0, 3, [[8, 8]], [1]], *both]],
        [1, [4], [["click", 0, 2, [[9, 9]], [1]], *both]],
        [1, [30], [["click", 0, 1, [[2, 2]], [1]], *both]],
    ])
    # of a frame the mask of the way back stays, but for first pictures, which it left; frame 12 has none
    assert got == sorted([(3, 0, 1, 0, 0), (4, 0, 1, 1, 1), (9, 0, 1, 1, 1), (4, 0, 2, 0, 0), (4, 0, 3, 0, 0), (5, 0, 3, 1, 1), (9, 0, 3, 0, 0), (4, 1, 2, 0, 0), (30, 1, 1, 0, 0)])


def test_prelabel_from_scans_with_a_video_model(spark):
    """The same labels as with a model for single pictures, from poses that move and turn."""

    class Squares:
        def __init__(self, cam, frames):
            self.clicks = {}

        def click(self, index, obj_id, points, labels):
            self.clicks[index] = points[labels == 1]

        def propagate(self, reverse=False):
            for i, points in self.clicks.items():
                mask = np.zeros((72, 96), bool)
                for col, row in points:
                    mask[max(0, row - 12) : row + 13, max(0, col - 12) : col + 13] = True
                yield i, mask

    points, mine, poses = [], {}, []
    bodies = [(x, y, z) for x0 in (-6, 5) for x in range(x0, x0 + 3) for y in range(3) for z in (1, 2, 3)]
    for frame in range(3):
        c, s = ((1.0, 0.0), (0.0, 1.0), (1.0, 0.0))[frame]
        m = np.array([[c, -s, 0, 0.0], [s, c, 0, 1.0 * frame], [0, 0, 1, 0], [0, 0, 0, 1]])
        poses.append((frame, *m[:3].ravel().tolist()))
        for i, (x, y, z) in enumerate(bodies + sorted({(x, y, 0) for x, y, _ in bodies})):
            p = np.linalg.inv(m) @ [x + 0.5, y + 0.5, z + 0.5 if z else 0.0, 1]
            points.append((frame, i, *p[:3].tolist(), 0.5))
            mine[frame, i] = "ground" if z == 0 else "left" if x < 0 else "right"
    poses = spark.createDataFrame(poses, "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    p = spark.createDataFrame(points, "frame int, point_idx int, x double, y double, z double, intensity double")
    got = plan.prelabel_scans(p, poses, video=Squares, voxel=1.0, scales=((1.5, 8),)).collect()
    labels = {k: {r.label for r in got if mine[r.frame, r.point_idx] == k} for k in ("ground", "left", "right")}
    assert labels["ground"] == {0} and len(got) == len(points)
    assert len(labels["left"]) == len(labels["right"]) == 1 and {1025, 1026} == labels["left"] | labels["right"]
    with pytest.raises(ValueError):
        plan.prelabel_scans(p, poses)


def test_a_second_run_reads_what_is_done(spark, tmp_path):
    """Labels are the same; a changed parameter makes its stage and later ones anew; masks are asked for by frame."""
    from pointspark.sources.stages import Stages

    folder = str(tmp_path / "asked")

    def squares(pdf):
        import os

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(f"{pdf['frame'].iloc[0]}\n")
        out = [(r.frame, r.cam, r.obj_id, r.row + i, r.col + j) for r in pdf.itertuples() for i in range(-12, 13) for j in range(-12, 13)]
        return pd.DataFrame(out, columns=["frame", "cam", "obj_id", "row", "col"])

    def asked():
        lines = [x for p in (tmp_path / "asked").glob("*") for x in p.read_text().split()]
        for p in (tmp_path / "asked").glob("*"):
            p.unlink()
        return set(map(int, lines))

    def tables():
        return {p.name.rsplit("-", 1)[0]: p.stat().st_mtime_ns for p in sorted((tmp_path / "stages").iterdir(), key=lambda p: p.stat().st_mtime_ns)}

    points = []
    for frame in range(2):
        bodies = [(x, y, z) for x0 in (-6, 5) for x in range(x0, x0 + 3) for y in range(3) for z in (1, 2, 3)]
        points += [(frame, i, x + 0.5, y + 0.5, z + 0.5 if z else 0.0, 0.5) for i, (x, y, z) in enumerate(bodies + sorted({(x, y, 0) for x, y, _ in bodies}))]
    eye = [float(i // 4 == i % 4) for i in range(12)]
    poses = spark.createDataFrame([(f, *eye) for f in range(2)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    p = spark.createDataFrame(points, "frame int, point_idx int, x double, y double, z double, intensity double")
    run = lambda points=p, **how: {(r.frame, r.point_idx): r.label for r in plan.prelabel_scans(points, poses, squares, voxel=1.0, scales=((1.5, 8),), stages=Stages(spark, str(tmp_path / "stages")), **how).collect()}
    first = run()
    made = tables()
    assert asked() == {0, 1} and {"split", "superframes", "prompts", "clicks", "masks", "mask-votes", "fused", "sets", "unified", "labelled", "tracked"} <= set(made)
    assert run() == first and tables() == made and asked() == set()
    # another radius: labels are fused anew from the votes that are there
    assert run(radius=3.0) == first
    again = tables()
    assert asked() == set() and {n for n in made if again[n] != made[n]} == {"fused", "sets", "unified", "labelled", "tracked"}


def test_frames_are_made_once_and_anew_when_they_change(spark, tmp_path):
    from pointspark.sources.stages import Manifest, Stages

    calls = []

    def make(rows):
        calls.append(sorted({r.frame for r in rows.collect()}))
        return rows.select("frame", (F.col("v") * 10).alias("w"))

    def run(rows, **how):
        done = Manifest(Stages(spark, str(tmp_path)))
        return sorted(map(tuple, done.by_frame("s", spark.createDataFrame(rows, "frame int, v int"), make, **how).collect()))

    assert run([(0, 1), (1, 2), (1, 3)]) == [(0, 10), (1, 20), (1, 30)]
    assert run([(1, 3), (1, 2), (2, 5)]) == [(1, 20), (1, 30), (2, 50)]
    assert run([(0, 1), (1, 2), (2, 6)]) == [(0, 10), (1, 20), (2, 60)]
    assert run([(0, 1), (2, 5)]) == [(0, 10), (2, 50)]
    assert run([(0, 1)], model="b") == [(0, 10)]
    assert calls == [[0, 1], [2], [1, 2], [0]]


def test_clock_equals_its_sql_beyond_a_hundred_hours(spark, data, tmp_path):
    import duckdb

    orders = spark.read.parquet(f"{data}/orders.parquet").limit(50).withColumn("o_custkey", F.col("o_custkey") * 3607 + 350_000)
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["string_functions"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert any(int(r.o_custkey) >= 360_000 for r in orders.collect())
    assert got == sorted(tuple(r) for r in db.sql(catalog.oracle_sql()["string_functions"]).fetchall())


@pytest.mark.parametrize(("spread", "copies"), [(3.0, 4), (40.0, 1)])
def test_nearest_groups_equal_all_pairs(spark, spread, copies):
    from pointspark.operators import joins as J

    rng = np.random.default_rng(5)
    kinds = "f int, i int, c long, x double, y double, z double"
    rows = [(f, i, int(rng.integers(0, 12)), *np.round(rng.uniform(0, spread, 3), 1).tolist()) for f in (0, 1) for i in range(60)]
    left = [(f, 100 * k + i, c, *p) for f, i, c, *p in rows[::3] for k in range(copies)]
    right = [r for r in rows if r not in rows[::3]]
    want = set()
    for f, i, _, *p in left:
        near = {}
        for g, _, c, *q in right:
            if f == g:
                near[c] = min(near.get(c, np.inf), (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]))
        want |= {(f, i, c, rank) for rank, (_, c) in enumerate(sorted((d, c) for c, d in near.items() if d > 1.44)[:5], 1)}
    got = J.nearest_groups(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), ("x", "y", "z"), ("f", "i"), "c", 5, 1.2, ("f",))
    assert {(r.f, r.i, r.c, r["rank"]) for r in got.collect()} == want


def test_topk_negatives_meets_rows_of_one_place_once(spark, data, tmp_path):
    """All pairs of a frame made the join grow with the square of the rows."""
    from pyspark.sql import Observation

    from pointspark.operators import joins as J

    table = spark.read.parquet(f"{data}/lineitem.parquet")
    table.crossJoin(spark.range(4)).withColumn("l_orderkey", F.col("l_orderkey") + 64 * 10**6 * F.col("id")).drop("id").write.parquet(str(tmp_path / "lineitem.parquet"))
    made, whole = [], J.radius_join

    def counted(*args, **kwargs):
        seen = Observation()
        made.append(seen)
        return whole(*args, **kwargs).observe(seen, F.count("*").alias("n"))

    J.radius_join = counted
    try:
        sizes = []
        for d in (data, str(tmp_path)):
            made.clear()
            catalog.queries()["topk_negatives"](spark, d).count()
            sizes.append(sum(m.get["n"] for m in made))
    finally:
        J.radius_join = whole
    assert sizes[0] == sizes[1] > 0


def test_nearest_join_meets_rows_of_one_place_once(spark, monkeypatch):
    from pointspark.operators import joins as J

    rng = np.random.default_rng(7)
    places = [tuple(np.round(rng.uniform(0, 6, 3), 1).tolist()) for _ in range(60)]
    left = [(k % 2, k, *places[k % 20]) for k in range(100)]
    right = [(k % 2, int(i), *places[20 + k % 40], int(i) + 500) for k, i in enumerate(rng.permutation(400))]
    want = set()
    for f, i, *p in left:
        near = [((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]), o, s) for g, o, *q, s in right if f == g]
        near = [n for n in near if n[0] <= 9]
        want |= {(f, i, *min(near)[1:])} if near else set()
    met, whole = [], J.radius_join
    monkeypatch.setattr(J, "radius_join", lambda *a, **b: met.append((a[0].count(), a[1].count())) or whole(*a, **b))
    kinds = "f int, i int, x double, y double, z double"
    got = J.nearest_join(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds + ", s long"), ("x", "y", "z"), ("f", "i"), "i", 3.0, ("f",))
    assert {(r.f, r.i, r.r_i, r.r_s) for r in got.collect()} == want
    assert met[0] == (len({(r[0], *r[2:5]) for r in left}), len({(r[0], *r[2:5]) for r in right}))


def order_lines(spark, folder, rows):
    """A table lineitem of (frame, linenumber, partkey, suppkey, x, y) in a folder: linenumber says z and a mask's camera, partkey its row, x its column, suppkey its object."""
    lines = [(f, n, p, s, x + 25.5, (y + 26.0) * 2000.0, 0.1) for f, n, p, s, x, y in rows]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_prelabel_tells_objects_apart_at_the_resolution_of_the_configuration(spark, tmp_path):
    """Voxels were so coarse that every frame was one region, and all points of a sequence had one label."""
    things = [(1000, 0.5, 0.1), (1001, 2.5, 0.1), (1002, 2.5, 1.7)]
    rows = []
    for frame in range(3):
        for k, x, y in things:
            # a thing, the ground below it, and a pixel of its mask: camera 1 looks along y
            depth = y + 30.0
            row, col = int(50.0 * (-0.5 * 8.0) / depth + 24.0), int(50.0 * -x / depth + 32.0)
            rows += [(frame, 3, 0, k - 1000, x, y), (frame, 1, 0, k - 1000, x, y), (frame, 1, row, k - 1000, col - 25.5, 20.0 + k - 1000)]
    got = catalog.queries()["prelabel"](spark, order_lines(spark, tmp_path / "in", rows)).collect()
    points = X.points(spark, str(tmp_path / "in")).collect()
    at = {(r.frame, r.point_idx): (r.x, r.y, r.z) for r in points}
    assert len(got) == len(points) == len(at)
    seen = {(r.frame, at[r.frame, r.point_idx][:2]): r.label for r in got if at[r.frame, r.point_idx][2] == -0.5}
    assert len(seen) == 9 and all(at[r.frame, r.point_idx][2] == -0.5 or r.label == 0 for r in got)
    # one label a thing, through all frames, numbered by first appearance
    named = {(round(x, 6), round(y, 6)): {v for (_, p), v in seen.items() if p == (x, y)} for _, (x, y) in seen}
    assert sorted(map(sorted, named.values())) == [[1025], [1026], [1027]]


def test_growth_takes_the_groups_that_have_labels_and_free_voxels(spark):
    rows = [(0, 0, 0, 0, 0, 5), (0, 0, 1, 0, 0, None), (0, 0, 2, 0, 0, None), (0, 0, 3, 0, 0, None), (0, 1, 0, 0, 0, None), (0, 1, 1, 0, 0, None), (0, 2, 0, 0, 0, 7), (1, 0, 9, 0, 0, None)]
    voxels = spark.createDataFrame(rows, "frame int, region long, vx long, vy long, vz long, obj_id long")
    assert {tuple(r) for r in C.grow(voxels).select("frame", "region", *C.VOXEL, "obj_id").collect()} == {(0, 0, x, 0, 0, 5) for x in (1, 2, 3)}

@pytest.mark.parametrize("radius", [0.5, 1.0, 2.0, 4.0, 5.5])
def test_regions_of_blocks_are_those_of_all_pairs(spark, radius):
    rng = np.random.default_rng(int(radius * 2))
    places = sorted({(f, *map(int, rng.integers(-int(6 * radius + 4), int(6 * radius + 4), 3))) for f in range(2) for _ in range(220)})
    v = np.array(places)
    near = (((v[:, None, 1:] - v[None, :, 1:]) ** 2).sum(-1) <= radius * radius) & (v[:, None, 0] == v[None, :, 0])
    want = np.arange(len(v))
    while not np.array_equal(new := np.where(near, want[None, :], len(v)).min(axis=1), want):
        want = new
    voxels = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "key long, frame int, vx long, vy long, vz long")
    got = {r.key: r.region for r in C.regions(voxels, radius, "key", ("frame",)).collect()}
    assert got == dict(enumerate(want.tolist()))


def test_regions_do_not_copy_every_voxel_to_all_cells_around(spark):
    voxels = spark.createDataFrame([(x * 400 + y * 20 + z, x, y, z) for x in range(20) for y in range(20) for z in range(20)], "key long, vx long, vy long, vz long")
    before = shuffled_rows(spark)
    assert {r.region for r in C.regions(voxels, 4.0, "key").collect()} == {0}
    assert shuffled_rows(spark) - before < 8000 * 8


def test_votes_of_given_voxels_are_those_of_all_that_lie_there(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(f, *map(float, rng.uniform(-20, 20, 2)), float(rng.uniform(-2, 2))) for f in range(3) for _ in range(300)], "frame int, x double, y double, z double")
    poses = spark.createDataFrame([(f, 1.0, 0.0, 0.0, 0.25 * f, 0.0, 1.0, 0.0, -0.5 * f, 0.0, 0.0, 1.0, 0.0) for f in range(3)], "frame int, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    masks = spark.createDataFrame([(f, c, 1000 + int(rng.integers(4)), int(rng.integers(48)), int(rng.integers(64))) for f in range(3) for c in range(4) for _ in range(2500)], "frame int, cam int, obj_id long, row int, col int")
    cells = points.select("frame", *P.voxel_keys(0.2)).distinct().unionByName(points.select("frame", *P.voxel_keys(0.2)).where("vx > 0"))
    votes = lambda df: sorted(tuple(r) for r in df.select("frame", *C.VOXEL, "obj_id", "cam", "sf", "cnt").collect())
    some = votes(plan.mask_votes(points, masks, poses, plan.default_pixels(), 3, 0.2, cells))
    assert some == votes(plan.mask_votes(points, masks, poses, plan.default_pixels(), 3, 0.2).join(cells.distinct(), ["frame", *C.VOXEL], "left_semi")) and len(some) > 100


def test_prelabel_hears_the_masks_of_scans_around(spark, tmp_path):
    """A thing stands still; the scan after, turned and moved on, is the only one with its mask."""
    x, y = 0.6 * 0.25 + 0.8 * 0.1, -0.8 * 0.25 + 0.6 * 0.1
    row, col = int(50.0 * (-0.5 * 8.0) / (y + 30.0) + 24.0), int(50.0 * -x / (y + 30.0) + 32.0)
    rows = [(0, n, 0, 0, 0.5, 0.1) for n in (1, 3)] + [(1, n, 0, 0, x, y) for n in (1, 3)] + [(1, 1, row, 0, col - 25.5, 20.0)]
    got = catalog.queries()["prelabel"](spark, order_lines(spark, tmp_path / "in", rows)).collect()
    things = {(r.frame, r.point_idx) for r in X.points(spark, str(tmp_path / "in")).where("z = -0.5").collect()}
    assert {(r.frame, r.point_idx): r.label for r in got if r.label} == dict.fromkeys(things, 1025) and len(things) == 2
