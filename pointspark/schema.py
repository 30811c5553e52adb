"""Explicit schemas of the data model, and the check that operators make of their inputs."""

from pyspark.sql import DataFrame


POINTS = "seq string, frame int, point_idx int, x double, y double, z double, intensity double"
LABELS = "seq string, frame int, point_idx int, label bigint"
POSES = "seq string, frame int, m array<double>"
CALIB = "name string, m array<double>"
TAXONOMY = "id int, name string, root string, moving_id int, instanceable boolean"
MASKS = "frame int, cam int, obj_id bigint, row int, col int"
RASTER = "frame int, cam int, row int, col int, depth double, intensity double, px double, py double, pz double"
PROMPTS = "obj_id bigint, kf int, scale int, j int, x double, y double, z double"
TILES = "i int, j int, x double, y double, size double, indexes array<int>"
#: Numbers in a packet of the inertial sensor.
INS_FIELDS = 30


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError if df lacks one of the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}; there are {', '.join(df.columns)}")
