"""Files are read as they were written."""

import os

import numpy as np
import pytest

from pointspark.functions import geometry as G
from pointspark.functions import udtf
from pointspark.sources import scans, stages, tables


@pytest.fixture
def folder(tmp_path):
    seq = tmp_path / "00"
    for d in ("velodyne", "labels", "oxts"):
        os.makedirs(seq / d)
    for f in range(3):
        np.arange(4 * (f + 2), dtype="<f4").tofile(seq / f"velodyne/{f:06d}.bin")
        (np.arange(f + 2, dtype="<u4") + 4_000_000_000).tofile(seq / f"labels/{f:06d}.label")
    (seq / "calib.txt").write_text("P0: 1 2 3\nTr: 0 -1 0 1 1 0 0 2 0 0 1 3\n")
    (seq / "poses.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0\n1 0 0 5 0 1 0 0 0 0 1 0\nbroken line\n")
    (seq / "labels.xml").write_text("<config><label><id>10</id><name>car</name><root>vehicle</root><moving>252</moving><instanceable>true</instanceable></label><label><id>40</id><name>road</name><root>ground</root></label></config>")
    (seq / "instances.txt").write_text("10:4\nbad\n11:2\n")
    for f in range(2):
        (seq / f"oxts/{f:010d}.txt").write_text(" ".join(["49.0", str(8.0 + f * 1e-5), "100", "0", "0", "0", *["0"] * 24]))
    return str(tmp_path)


def test_scans_and_labels(spark, folder):
    p = scans.read_scans(spark, f"{folder}/*").orderBy("frame", "point_idx").collect()
    assert len(p) == 9 and p[0].seq == "00" and (p[1].x, p[1].intensity) == (4.0, 7.0)
    labels = scans.read_labels(spark, f"{folder}/*").where("frame = 2").orderBy("point_idx").collect()
    assert [r.label for r in labels] == [4_000_000_000 + i for i in range(4)]
    scans.register(spark)
    q = spark.read.format("lidar_scan").option("path", f"{folder}/00").load()
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, p))


def test_label_sink(spark, folder, tmp_path):
    labels = scans.read_labels(spark, f"{folder}/*")
    bad = labels.where("frame <> 1 or point_idx <> 1")
    checked = scans.check_labels(bad, scans.read_scans(spark, f"{folder}/*"))
    assert {r.frame for r in checked.select("frame").distinct().collect()} == {0, 2}
    # a frame with a gap, and one that is shorter than its scan, keep the files they have
    written = lambda name: {r.frame for r in scans.read_labels(spark, str(tmp_path / f"{name}/*")).select("frame").distinct().collect()}
    scans.write_labels(bad, str(tmp_path / "gap"))
    assert written("gap") == {0, 2}
    scans.write_labels(labels.where("frame <> 2 or point_idx = 0"), str(tmp_path / "short"), scans.read_scans(spark, f"{folder}/*"))
    assert written("short") == {0, 1}
    scans.write_labels(labels, str(tmp_path / "out"))
    again = scans.read_labels(spark, str(tmp_path / "out/*"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, labels.collect()))


def test_poses_and_calibration(spark, folder):
    calib = scans.read_calibration(spark, f"{folder}/00/calib.txt")
    assert [r.name for r in calib.collect()] == ["Tr"]
    poses = scans.read_poses(spark, f"{folder}/00/poses.txt", calib).orderBy("frame").collect()
    tr = np.vstack([np.array([[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3.0]]), [0, 0, 0, 1]])
    p = np.eye(4)
    p[0, 3] = 5
    want = np.linalg.inv(tr) @ p @ tr
    assert [r.frame for r in poses] == [0, 1] and np.allclose([poses[1][n] for n in G.names("m")], want[:3].ravel())
    assert scans.read_poses(spark, f"{folder}/00/poses.txt").count() == 2


def test_taxonomy_and_instances(spark, folder):
    t = {r.id: r for r in scans.read_taxonomy(spark, f"{folder}/00/labels.xml").collect()}
    assert t[252].name == "car (moving)" and t[10].moving_id == 252 and t[40].moving_id is None and t[10].instanceable and not t[40].instanceable
    m = scans.read_max_instances(spark, f"{folder}/00/instances.txt")
    assert [r.value for r in scans.max_instance_lines(m).collect()] == ["10:4", "11:2"]


def test_packets(spark, folder):
    p = scans.packet_poses(scans.read_packets(spark, f"{folder}/00/oxts")).orderBy("frame").collect()
    assert [r.frame for r in p] == [0, 1] and (p[0].m03, p[0].m00) == (0.0, 1.0)
    assert p[1].m03 == pytest.approx(np.cos(np.radians(49)) * 1e-5 * np.pi * 6378137 / 180)


def test_stages(spark, tmp_path):
    s = stages.Stages(spark, str(tmp_path))
    made = []
    make = lambda: (made.append(1), spark.range(3).withColumnRenamed("id", "frame"))[1]
    assert s.missing("a", spark.range(5).withColumnRenamed("id", "frame")).count() == 5
    s.get("a", make), s.get("a", make)
    assert len(made) == 1 and s.missing("a", spark.range(5).withColumnRenamed("id", "frame")).count() == 2
    kept = s.replace("a", spark.range(1).withColumnRenamed("id", "frame"))
    assert spark.read.parquet(kept).count() == 3 and spark.read.parquet(s.path("a")).count() == 1
    assert stages.progress(1, 4) == "Progress: 25%"


@pytest.fixture
def long_drive(tmp_path):
    folder = tmp_path / "drives/07/velodyne"
    os.makedirs(folder)
    for f in range(30):
        np.full(4 * (1 + f % 3), f, "<f4").tofile(folder / f"{f:06d}.bin")
    return str(tmp_path / "drives/07")


def test_frames_choose_files(spark, long_drive):
    scans.register(spark)
    whole = spark.read.format("lidar_scan").option("path", long_drive)
    some = whole.load(), spark.read.format("lidar_scan").option("path", long_drive).option("first_frame", 10).option("last_frame", 20).load()
    assert [df.count() for df in some] == [60, sum(1 + f % 3 for f in range(10, 21))]
    for f in range(30):
        if not 10 <= f <= 20:  # a folder cannot be opened as a file
            os.remove(f"{long_drive}/velodyne/{f:06d}.bin")
            os.mkdir(f"{long_drive}/velodyne/{f:06d}.bin")
    assert {r.frame for r in some[1].collect()} == set(range(10, 21))


def test_eleven_files_are_opened_for_eleven_frames(spark, long_drive):
    df = scans.read_scans(spark, long_drive, (10, 20))
    assert sorted((r.frame, r.point_idx) for r in df.collect()) == [(f, i) for f in range(10, 21) for i in range(1 + f % 3)]
    plan = df._jdf.queryExecution().executedPlan()
    while plan.metrics().get("numFiles").isEmpty():
        plan = plan.children().head()
    plan.execute()
    assert plan.metrics().apply("numFiles").value() == 11
    assert scans.read_scans(spark, long_drive).count() == 60


def test_parts_hold_several_files(long_drive):
    reader = scans._ScanReader(long_drive, 100)
    parts = [[os.path.getsize(p) for p in part.paths] for part in reader.partitions()]
    assert sum(map(len, parts)) == 30 and all(sum(p) <= 100 for p in parts) and len(parts) < 15
    assert [len(p.paths) for p in scans._ScanReader(os.path.dirname(long_drive) + "/*", 10**9).partitions()] == [30]


def labels_of(spark, path):
    return {(r.frame, r.point_idx): r.label for r in scans.read_labels(spark, f"{path}/00").collect()}


def test_a_failed_write_leaves_the_old_labels(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path)
    old = spark.createDataFrame([("00", f, i, 7) for f in range(8) for i in range(3)], scans.LABEL_SCHEMA)
    scans.write_labels(old, path)
    before = labels_of(spark, path)
    assert len(before) == 24
    scans.register(spark)
    # one task fails after others have written all their frames
    bad = old.repartition(4, "frame").sortWithinPartitions("frame", "point_idx").withColumn("label", F.when(F.col("frame") == 5, F.assert_true(F.lit(False), "no").cast("long")).otherwise(F.lit(9)).cast("long"))
    with pytest.raises(Exception):
        bad.write.format("lidar_label").mode("append").option("path", path).save()
    assert labels_of(spark, path) == before and not [n for n in os.listdir(path) if n.startswith(".staged")]


def test_the_version_before_can_be_put_back(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda v, frames: spark.createDataFrame([("00", f, i, v) for f in frames for i in range(2)], scans.LABEL_SCHEMA)
    scans.write_labels(rows(1, range(4)), path)
    scans.write_labels(rows(2, range(2, 6)), path)
    assert labels_of(spark, path) == {(f, i): 1 if f < 2 else 2 for f in range(6) for i in range(2)}
    assert scans.restore_labels(path) == 2
    assert labels_of(spark, path) == {(f, i): 1 if f < 4 else 2 for f in range(6) for i in range(2)}
    assert scans.restore_labels(path) == 0


def test_a_frame_in_two_partitions_is_refused(spark, tmp_path):
    scans.register(spark)
    rows = spark.createDataFrame([("00", 0, i, 1) for i in range(4)], scans.LABEL_SCHEMA).repartition(2, "point_idx")
    with pytest.raises(Exception, match="several partitions"):
        rows.write.format("lidar_label").mode("append").option("path", str(tmp_path)).save()
    assert not os.path.exists(tmp_path / "00/labels/000000.label")


def test_trajectory_writer(spark, tmp_path):
    e = spark.createDataFrame([(0, 10 * i, 100.0, 0.01, 0.1, 4.0) for i in range(4)], "seq int, first int, len double, r_err double, t_err double, speed double")
    stages.write_errors(e, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/by_length", sep=" ").count() == 1 and spark.read.csv(f"{tmp_path}/segments", sep=" ").count() == 4


def test_every_length_is_written(spark, tmp_path):
    e = spark.createDataFrame([(0, 10 * i, 10.0 * k, 0.01, 0.1, 4.0) for i in range(3) for k in range(1, 251)], "seq int, first int, len double, r_err double, t_err double, speed double")
    stages.write_errors(e, str(tmp_path))
    assert spark.read.csv(f"{tmp_path}/by_length", sep=" ").count() == 250


def test_stream_tracker_query(spark, data):
    from pointspark.plans import catalog

    q = catalog.queries()
    key = lambda df: sorted((r.frame, r.label, r.new_label) for r in df.collect())
    assert key(q["stream_tracker"](spark, data)) == key(q["track_labels"](spark, data))


def test_zero_labels(spark):
    s = spark.createDataFrame([(0, 3), (1, 0)], "frame int, n_points int")
    assert tables.zero_labels(s).count() == 3


def test_table_functions(spark):
    udtf.register(spark)
    assert spark.sql("SELECT * FROM voxel_corners(1, 2, 3)").count() == 8
    assert spark.sql("SELECT * FROM neighbour_cells(0, 0, 0, 1)").count() == 27
    assert spark.sql("SELECT * FROM convex_fill(array(0, 2, 0), array(0, 0, 2))").count() == 6


def test_hooks(spark):
    p = spark.createDataFrame([(0, 0.1, 0.1, 0.0), (0, 0.2, 0.1, 0.1), (0, 0.2, 0.2, 2.0)], "frame int, x double, y double, z double")
    assert sorted(r.part for r in udtf.ground_split(p).collect()) == ["ground", "ground", "other"]
    assert sorted(r.part for r in udtf.ground_split(p, flip=True).collect()) == ["ceiling", "other", "other"]
    px = spark.createDataFrame([(0, 0, 1, 1, 5.0), (0, 0, 2, 3, 1.0)], "frame int, cam int, row int, col int, depth double")
    v = udtf.embed_images(px, 8, 8).first().vector
    assert len(v) == 64 and np.linalg.norm(v) == pytest.approx(1)
    with pytest.raises(ValueError):
        udtf.masks_from(px, None)


def test_scene(spark, folder, tmp_path):
    from pointspark.operators.selection import Relabel
    from pointspark.scene import Scene

    s = Scene.load(spark, f"{folder}/00")
    assert s.points.count() == 9 and s.labelled_ratio() > 0
    cleared = s.relabel(Relabel("polygon", new_label=5, overwrite=True))
    assert {r.label for r in cleared.points.collect()} == {5}
    assert s.relabel(Relabel("polygon", new_label=5, overwrite=True), polygon=[(1e6, 1e6), (2e6, 1e6), (1e6, 2e6)]).points.where("label = 5").count() == 0
    cleared.write(str(tmp_path / "again"))
    again = scans.read_labels(spark, f"{tmp_path}/again/00")
    assert again.count() == 9 and {r.label for r in again.collect()} == {5}
    assert s.tile(0.0, 0.0).points.count() <= 9 and s.frames(1, 1).superframes().count() > 0
    with pytest.raises(ValueError):
        Scene(s.points.drop("label"), s.poses)
