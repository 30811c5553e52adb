"""Stateful streams against batch folds: frames split over batches, out of order and late, and a stream that is started again."""

import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.operators import spatial as P
from pointspark.operators.ordered import track_boxes
from pointspark.streaming import windows as S

START = dt.datetime(2024, 1, 1)
BOX = "seq long, ts timestamp, frame int, label long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def at(frame):
    return START + dt.timedelta(seconds=frame)


def boxes(seed, frames=8):
    """Objects that drift, some of which change their label from frame to frame, in two sequences."""
    rng = np.random.default_rng(seed)
    rows = []
    for seq in (0, 7):
        for f in range(frames):
            for k in range(3):
                lo = np.array([k * 4 + f * 0.3, seq, 0]) + rng.normal(0, 0.02, 3)
                rows.append((seq, at(f), f, 1000 + (k + f * (k == 2)), *lo.tolist(), *(lo + 1).tolist()))
    return rows


def batch(rows):
    out = []
    for seq in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == seq]
        frames = ((f, [(r[3], np.array(r[4:7]), np.array(r[7:10])) for r in own if r[2] == f]) for f in sorted({r[2] for r in own}))
        out += [(seq, *x) for x in track_boxes(frames)]
    return sorted(out)


def write(folder, rows, schema):
    """A file of JSON lines; files are taken by their time, so each is a second newer than the one before."""
    os.makedirs(folder, exist_ok=True)
    names = [c.split()[0] for c in schema.split(", ")]
    n = len(os.listdir(folder))
    path = f"{folder}/{n:04d}.json"
    with open(path + ".part", "w") as f:
        for r in rows:
            f.write(json.dumps({k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in zip(names, r, strict=True)}) + "\n")
    os.utime(path + ".part", (1_700_000_000 + n,) * 2)
    os.rename(path + ".part", path)


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def found(df):
    return sorted((r.seq, r.frame, r.label, r.new_label) for r in df.collect())


END = [(0, at(10_000), None, None, *[None] * 6)]


def test_split_and_shuffled_frames_equal_the_batch(spark, tmp_path):
    rows = boxes(3)
    assert any(new != label for *_, label, new in batch(rows))
    rng = np.random.default_rng(1)
    # every frame is split over batches, and frames come up to four seconds too late
    order = sorted(range(len(rows)), key=lambda i: rows[i][2] + rng.uniform(0, 4))
    for i in range(0, len(order), 5):
        write(str(tmp_path / "in"), [rows[k] for k in order[i : i + 5]], BOX)
    write(str(tmp_path / "in"), END, BOX)
    assert found(S.drained(S.stream_tracks(read(spark, str(tmp_path / "in"), BOX), "5 seconds"))) == batch(rows)


def test_what_is_late_is_left_out(spark, tmp_path):
    rows = boxes(4)
    late = [r for r in rows if r[2] == 1 and r[3] == 1000]
    folder = str(tmp_path / "in")
    write(folder, [r for r in rows if r not in late and r[2] < 7], BOX)
    write(folder, [r for r in rows if r[2] == 7], BOX)  # the watermark of the batch before holds: it stands at frame 4
    write(folder, late, BOX)
    write(folder, END, BOX)
    assert found(S.drained(S.stream_tracks(read(spark, folder, BOX), "2 seconds"))) == batch([r for r in rows if r not in late])


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = boxes(5)
    folder, root = str(tmp_path / "in"), str(tmp_path / "run")
    # frame 3 is half there when the stream ends
    first = [r for r in rows if r[2] < 3 or (r[2] == 3 and r[3] == 1000)]
    write(folder, first, BOX)
    tracks = lambda: S.stream_tracks(read(spark, folder, BOX), "2 seconds")
    before = found(S.drained(tracks(), root=root))
    assert 0 < len(before) < len(first)
    write(folder, [r for r in rows if r not in first], BOX)
    write(folder, END, BOX)
    assert found(S.drained(tracks(), root=root)) == batch(rows)


def test_keyframes_do_not_depend_on_batches(spark, tmp_path):
    schema = "seq long, ts timestamp, event_id long, step double"
    rng = np.random.default_rng(2)
    rows = [(s, at(int(t)), int(100 * s + i), float(rng.uniform(0, 4))) for s in (1, 2) for i, t in enumerate(rng.integers(0, 30, 40))]
    want = []
    for s in (1, 2):
        count, way = 0, 0.0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            way += r[3]
            if count == 0 or count > 6 or way >= 10:
                want.append((s, r[2]))
                count, way = 1, 0.0
            else:
                count += 1
    for files in (1, 9):
        folder = str(tmp_path / f"in{files}")
        order = rng.permutation(len(rows))
        for part in np.array_split(order, files):
            write(folder, [rows[i] for i in part], schema)
        write(folder, [(1, at(10_000), None, None)], schema)
        got = S.drained(S.stream_keyframes(read(spark, folder, schema), "40 seconds"))
        assert sorted((r.seq, r.event_id) for r in got.collect()) == sorted(want)


POINT = "ts timestamp, frame int, x double, y double, z double, intensity double"


def scene(spark, n=9):
    """Points of frames whose poses move and turn, and the superframes of all of them."""
    rng = np.random.default_rng(6)
    points = [(at(f), f, *rng.uniform(-3, 3, 3).tolist(), float(rng.random())) for f in range(n) for _ in range(25)]
    poses = []
    for f in range(n):
        c, s = (0.6, 0.8) if f % 2 else (1.0, 0.0)
        poses.append((f, at(f), c, -s, 0.0, 0.25 * f, s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0))
    poses = spark.createDataFrame(poses, "frame int, ts timestamp, " + ", ".join(f"m{i // 4}{i % 4} double" for i in range(12)))
    return points, poses


def superframes(spark, points, poses, width):
    df = spark.createDataFrame(points, POINT)
    moved = P.transform(df.join(P.relative_poses(P.frame_window(poses, width), poses), "frame"), [F.col(c) for c in P.G.names("m")])
    return {(r.centre, r.vx, r.vy, r.vz, r.intensity) for r in P.voxel_max(moved, 1.0, "centre").collect()}


@pytest.mark.parametrize("width", [1, 5])
def test_superframes_equal_the_batch(spark, tmp_path, width):
    points, poses = scene(spark)
    folder = str(tmp_path / "in")
    rng = np.random.default_rng(8)
    order = sorted(range(len(points)), key=lambda i: points[i][1] + rng.uniform(0, 3))
    for i in range(0, len(order), 40):
        write(folder, [points[k] for k in order[i : i + 40]], POINT)
    write(folder, [(at(10_000), None, None, None, None, None)], POINT)
    got = S.drained(S.stream_superframes(read(spark, folder, POINT), poses, width, 1.0, "4 seconds")).collect()
    assert {(r.centre, r.vx, r.vy, r.vz, r.intensity) for r in got} == superframes(spark, points, poses, width)
    assert len(got) == len({(r.centre, r.vx, r.vy, r.vz) for r in got})


def test_a_late_point_misses_closed_centres_only(spark, tmp_path):
    points, poses = scene(spark)
    folder = str(tmp_path / "in")
    late = (at(4), 4, 90.5, 0.5, 0.5, 2.0)
    write(folder, points, POINT)
    write(folder, [(at(13), None, None, None, None, None)], POINT)
    write(folder, [late], POINT)  # the watermark stands at 13 - 2 - 4 = 7: centres up to 5 are closed, 6 is not
    write(folder, [(at(10_000), None, None, None, None, None)], POINT)
    got = {(r.centre, r.vx, r.vy, r.vz, r.intensity) for r in S.drained(S.stream_superframes(read(spark, folder, POINT), poses, 5, 1.0, "2 seconds")).collect()}
    whole = superframes(spark, points, poses, 5)
    more = superframes(spark, [*points, late], poses, 5) - whole
    assert {r[0] for r in more} == {2, 3, 4, 5, 6}
    assert got == whole | {r for r in more if r[0] == 6}


def test_a_key_costs_a_few_calls_to_the_state():
    """A timer and some calls for each row made the fold of a long table take hours."""
    calls = []

    class State:
        def __init__(self):
            self.held = None

        def get(self):
            calls.append("get")
            return iter(self.held or ()) if isinstance(self.held, list) or self.held is None and self.many else self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        put = update

        def appendValue(self, value):
            calls.append("append")
            self.held = [*(self.held or ()), value]

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        timers: list = []

        def getValueState(self, name, schema):
            state = State()
            state.many = False
            return state

        def getListState(self, name, schema):
            state = State()
            state.many = True
            return state

        def registerTimer(self, ms):
            calls.append("timer")
            self.timers.append(ms)

        def deleteTimer(self, ms):
            calls.append("delete")
            self.timers.remove(ms)

    class At:
        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    fold, rng = S.Keyframes(), np.random.default_rng(4)
    fold.init(Handle())
    rows = [{"us": 1_000_000 * int(i), "event_id": int(i), "step": 4.0} for i in rng.permutation(np.arange(1, 1001))]
    list(fold.handleInputRows((5,), iter(rows), At(0)))
    assert len(Handle.timers) == 1
    # the watermark stands amid the rows: those up to it come out, the others wait for one more timer
    first = [r.event_id for r in fold.handleExpiredTimer((5,), At(500_000), At(Handle.timers.pop()))]
    assert Handle.timers == [501_000]
    second = [r.event_id for r in fold.handleExpiredTimer((5,), At(10_000_000), At(Handle.timers.pop()))]
    assert first + second == [1, *range(4, 1001, 3)]
    assert len(calls) < 20
