"""Binary scans and labels as Spark data sources, and the text files beside them.

A sequence is a folder with velodyne/<frame>.bin (little-endian float32, four a
point) and labels/<frame>.label (little-endian uint32, one a point), poses.txt
and calib.txt. Files are read through Spark's own readers, so any file system
that Spark knows will do.
"""

from __future__ import annotations

import glob
import itertools
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pointspark.functions import geometry as G

POINT_SCHEMA = "seq string, frame int, point_idx int, x double, y double, z double, intensity double"
LABEL_SCHEMA = "seq string, frame int, point_idx int, label bigint"
#: Bytes of files that one task of the scan source reads.
PART_BYTES = 64 << 20
#: Where label files stay that the last write replaced.
FORMER = ".former"
NUMBERED = r"([^/]+)/[^/]+/([0-9]+)\.[a-z]+$"


def _files(spark: SparkSession, path: str, folder: str, suffix: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """(seq, frame, content) of a sequence's or several sequences' files; path may hold a pattern, frames is a first and a last one.

    Frames are chosen by the names of files, which Spark knows before it opens any.
    """
    df = spark.read.format("binaryFile").load(f"{path}/{folder}/*.{suffix}")
    if frames is not None:
        df = df.where(F.regexp_extract("_metadata.file_name", r"^([0-9]+)\.", 1).cast("int").between(*frames))
    return df.select(F.regexp_extract("path", NUMBERED, 1).alias("seq"), F.regexp_extract("path", NUMBERED, 2).cast("int").alias("frame"), "content")


def decode(kind: str):
    """A mapInArrow function from (seq, frame, content) to points or labels; bytes after the last whole record are left out."""

    def run(batches):
        for b in batches:
            for seq, frame, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = content.as_py()
                if kind == "points":
                    v = np.frombuffer(raw, "<f4", len(raw) // 16 * 4).reshape(-1, 4).astype(np.float64)
                    cols, names = [v[:, i] for i in range(4)], ["x", "y", "z", "intensity"]
                else:
                    cols, names = [np.frombuffer(raw, "<u4", len(raw) // 4).astype(np.int64)], ["label"]
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array([seq] * n, pa.string()), pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in cols]], ["seq", "frame", "point_idx", *names])

    return run


def read_scans(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """Points of every scan, or of those from a first to a last frame, whose files alone are opened."""
    return _files(spark, path, "velodyne", "bin", frames).mapInArrow(decode("points"), POINT_SCHEMA)


def read_labels(spark: SparkSession, path: str, folder: str = "labels", frames: tuple[int, int] | None = None) -> DataFrame:
    """Labels of every scan, or of those from a first to a last frame."""
    return _files(spark, path, folder, "label", frames).mapInArrow(decode("labels"), LABEL_SCHEMA)


def check_labels(labels: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Labels of the frames that may be written: numbered from 0 without gaps, and as many as the points of scans, where those are given."""
    n = labels.groupBy("seq", "frame").agg(F.count("*").alias("n"), F.countDistinct("point_idx").alias("k"), F.min("point_idx").alias("lo"), F.max("point_idx").alias("hi"))
    good = n.where("n > 0 and k = n and lo = 0 and hi = n - 1")
    if scans is not None:
        good = good.join(scans.groupBy("seq", "frame").agg(F.count("*").alias("size")), ["seq", "frame"]).where("n = size")
    return labels.join(good.select("seq", "frame"), ["seq", "frame"], "left_semi")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ScanSource(DataSource):
    """format("lidar_scan"): points of .bin files under a local or mounted path, which may be a pattern.

    The options first_frame and last_frame choose the files that are opened.
    (Conditions that Spark hands to a Python source stay with the loaded table
    and would hold in its later queries too, so they are not taken.) A part
    holds files of part_bytes (an option) together, or one larger file.
    """

    @classmethod
    def name(cls) -> str:
        return "lidar_scan"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        last = self.options.get("last_frame")
        return _ScanReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)), int(self.options.get("first_frame", 0)), int(last) if last is not None else None)


class _ScanReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int = PART_BYTES, first: int = 0, last: int | None = None):
        self.path, self.part_bytes, self.first, self.last = path, part_bytes, first, last

    def wanted(self, name: str) -> bool:
        stem, kind = os.path.splitext(name)
        if kind != ".bin" or not stem.isdigit():
            return False
        return self.first <= int(stem) and (self.last is None or int(stem) <= self.last)

    def partitions(self):
        """Files in the order of their names, several to a part."""
        parts, paths, size = [], [], 0
        for folder in sorted(glob.glob(f"{self.path}/velodyne")):
            with os.scandir(folder) as found:
                for e in sorted((e for e in found if self.wanted(e.name)), key=lambda e: e.name):
                    own = e.stat().st_size
                    if paths and size + own > self.part_bytes:
                        parts.append(_Part(paths))
                        paths, size = [], 0
                    paths.append(e.path)
                    size += own
        return [*parts, _Part(paths)]

    def read(self, partition):
        for path in partition.paths:
            with open(path, "rb") as f:
                raw = f.read()
            seq = os.path.basename(os.path.dirname(os.path.dirname(path)))
            frame = int(os.path.splitext(os.path.basename(path))[0])
            yield from decode("points")([pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([frame], pa.int32()), pa.array([raw], pa.binary())], ["seq", "frame", "content"])])


class LabelSink(DataSource):
    """format("lidar_label"): writes label files under a path that all executors mount; rows of a frame must be in one partition, in order of point_idx."""

    @classmethod
    def name(cls) -> str:
        return "lidar_label"

    def schema(self) -> str:
        return LABEL_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LabelWriter(self.options["path"], schema.names)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _LabelWriter(DataSourceWriter):
    """Files are staged by the tasks and take their places when all tasks have ended well; what they replace is kept."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.at, self.job = path, {n: i for i, n in enumerate(names)}, uuid.uuid4().hex
        self.staged = f"{path}/.staged-{self.job}"

    def write(self, rows) -> WriterCommitMessage:
        seq, frame, label = (self.at[n] for n in ("seq", "frame", "label"))
        files = []
        for (s, f), group in itertools.groupby(rows, key=lambda r: (r[seq], r[frame])):
            # a name of the attempt's own: a task that runs twice leaves two files, of which one is committed
            staged = f"{self.staged}/{s}/{f:06d}.{uuid.uuid4().hex}"
            os.makedirs(os.path.dirname(staged), exist_ok=True)
            with open(staged, "wb") as out:
                out.write(np.array([r[label] for r in group], np.int64).astype("<u4").tobytes())
            files.append((staged, f"{s}/labels/{f:06d}.label"))
        return _Written(files)

    def commit(self, messages) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one frame were in several partitions")
        former = f"{self.path}/{FORMER}"
        if os.path.isdir(former):
            shutil.rmtree(former)
        # first the old version is complete in its new place, then the new one comes
        for _, to in files:
            if os.path.exists(f"{self.path}/{to}"):
                os.makedirs(os.path.dirname(f"{former}/{to}"), exist_ok=True)
                os.link(f"{self.path}/{to}", f"{former}/{to}")
        for staged, to in files:
            os.makedirs(os.path.dirname(f"{self.path}/{to}"), exist_ok=True)
            os.replace(staged, f"{self.path}/{to}")
        shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def restore_labels(path: str) -> int:
    """Puts back the label files that the last write replaced, and says how many; files that were new then stay."""
    former, n = f"{path}/{FORMER}", 0
    for folder, _, names in os.walk(former):
        for name in names:
            os.replace(f"{folder}/{name}", f"{path}/{os.path.relpath(folder, former)}/{name}")
            n += 1
    shutil.rmtree(former, ignore_errors=True)
    return n


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScanSource)
    spark.dataSource.register(LabelSink)


def write_labels(labels: DataFrame, path: str, scans: DataFrame | None = None) -> None:
    """One file a frame, labels in order of their points; frames that do not pass check_labels are left as they are."""
    register(labels.sparkSession)
    labels = check_labels(labels, scans)
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = labels.select("seq", "frame", "point_idx", "label").repartition(n, "seq", "frame").sortWithinPartitions("seq", "frame", "point_idx")
    ordered.write.format("lidar_label").mode("append").option("path", path).save()


# ---- text files


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one text file, lines counted from 0.

    A file is one row here: these files hold a line a scan.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), r"\r?\n")).alias("line", "value"))
    return lines


def numbers(text):
    """The numbers of a text, null where one cannot be read."""
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(name, m) for lines `name: 12 numbers`; other lines are left out."""
    rows = numbered_lines(spark, path).where(F.contains("value", F.lit(":")))
    m = numbers(F.substring_index("value", ":", -1))
    return rows.select(F.trim(F.substring_index("value", ":", 1)).alias("name"), m.alias("m")).where(F.size("m") == 12)


def read_poses(spark: SparkSession, path: str, calibration: DataFrame | None = None, name: str = "Tr") -> DataFrame:
    """(frame, m00 .. m23): inverse(Tr) . P . Tr of each line of twelve numbers.

    The frame is the line's number; lines with fewer numbers are left out.
    """
    rows = numbered_lines(spark, path).select(F.col("line").alias("frame"), numbers(F.col("value")).alias("m")).where(F.size("m") >= 12)
    p = rows.select("frame", *G.from_array("m", "p"))
    if calibration is None:
        return p.select("frame", *[F.col(a).alias(b) for a, b in zip(G.names("p"), G.names("m"), strict=True)])
    found = calibration.where(F.col("name") == name).select("m").first()
    if found is None:
        raise ValueError(f"the calibration has no {name}")
    tr = [F.lit(float(v)) for v in found.m]  # twelve numbers
    m = G.multiply(G.multiply(G.affine_inverse(tr), G.columns("p")), tr)
    return p.select("frame", *[v.alias(n) for v, n in zip(m, G.names("m"), strict=True)])


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, root, moving_id, instanceable) of label elements, and a row for each moving class."""
    from pyspark.sql import types as T

    from pointspark.sources.tables import with_moving

    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "root", "moving", "instanceable")])
    raw = spark.read.format("xml").option("rowTag", "label").schema(schema).load(path)
    t = raw.select(F.trim("id").cast("int").alias("id"), F.trim("name").alias("name"), F.trim("root").alias("root"), F.trim("moving").try_cast("int").alias("moving_id"), F.coalesce(F.lower(F.trim("instanceable")).isin("true", "1"), F.lit(False)).alias("instanceable"))
    return with_moving(t)


def read_max_instances(spark: SparkSession, path: str) -> DataFrame:
    """(label, max_inst) of lines `label:max`."""
    v = numbered_lines(spark, path).where(F.contains("value", F.lit(":")))
    return v.select(F.trim(F.substring_index("value", ":", 1)).try_cast("int").alias("label"), F.trim(F.substring_index("value", ":", -1)).try_cast("int").alias("max_inst")).where("label is not null and max_inst is not null")


def max_instance_lines(max_instances: DataFrame) -> DataFrame:
    """The lines of the same file, by label."""
    return max_instances.orderBy("label").select(F.concat_ws(":", F.col("label").cast("string"), F.col("max_inst").cast("string")).alias("value"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(frame, lat, lon, alt, roll, pitch, yaw) of packet files named by frame, thirty numbers each."""
    raw = spark.read.text(f"{path}/*.txt", wholetext=True).withColumn("frame", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)\.txt$", 1).cast("int"))
    v = raw.select("frame", numbers(F.col("value")).alias("v")).where(F.size("v") >= 30)
    return v.select("frame", *[F.get("v", i).alias(n) for i, n in enumerate(("lat", "lon", "alt", "roll", "pitch", "yaw"))])


def packet_poses(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, frame, m00 .. m23): poses in the frame of the first packet, renumbered from 0.

    Positions are on a Mercator map at the first packet's scale.
    """
    from pointspark.functions.scalars import mercator

    w = Window.partitionBy(*by).orderBy("frame")
    scaled = packets.withColumn("scale", F.cos(F.radians(F.first("lat").over(w))))
    x, y = mercator(F.col("lat"), F.col("lon"), F.col("scale"))
    turn = G.multiply(G.multiply(G.rotation("z", F.col("yaw")), G.rotation("y", F.col("pitch"))), G.rotation("x", F.col("roll")))
    p = scaled.withColumns({"px": x, "py": y})
    m = G.multiply(G.translation(F.col("px"), F.col("py"), F.col("alt")), turn)
    abs_ = p.select(*by, "frame", *[v.alias(n) for v, n in zip(m, G.names("p"), strict=True)])
    first = abs_.withColumns({n.replace("p", "o", 1): F.first(n).over(w) for n in G.names("p")}).withColumn("n", F.row_number().over(w) - 1)
    rel = G.multiply(G.invert(G.columns("o")), G.columns("p"))
    return first.select(*by, F.col("n").alias("frame"), *[v.alias(n) for v, n in zip(rel, G.names("m"), strict=True)])
