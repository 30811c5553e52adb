"""Scene configuration (S07, S08): dataclass, YAML subset and key: value settings."""

from __future__ import annotations

import dataclasses
from typing import Any


@dataclasses.dataclass
class SceneConfig:
    """Parameters of a scene; fixed values of the data model are defaults."""

    window: int = 7
    voxel_size: float = 0.2
    voxel_grow: float = 4.0
    z_grow: float = 3.5
    ground_clusters: int = 20
    n_cameras: int = 8
    width: int = 640
    height: int = 480
    tile_size: float = 100.0
    max_scans: int = 500
    min_range: float = 2.5
    max_range: float = 50.0
    tile_boundary: float = 15.0
    iou_threshold: float = 0.5
    temporal_threshold: float = 0.7

    @classmethod
    def of(cls, values: dict[str, Any]) -> SceneConfig:
        known = {f.name: f.type for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})


class Attributes(dict):
    """A dict whose keys can be read as attributes, all the way down."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e


def scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_yaml(text: str) -> Attributes:
    """Nested mappings of scalars and flat lists, by indentation; comments from #."""
    root = Attributes()
    stack: list[tuple[int, Attributes]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        indent = len(body) - len(body.lstrip())
        key, sep, value = body.strip().partition(":")
        if not sep:
            raise ValueError(f"not a mapping: {line!r}")
        while stack[-1][0] >= indent:
            stack.pop()
        if value.strip():
            stack[-1][1][key.strip()] = scalar(value)
        else:
            child = Attributes()
            stack[-1][1][key.strip()] = child
            stack.append((indent, child))
    return root


def parse_settings(text: str) -> dict[str, str]:
    """key: value lines; lines without a colon are left out, names keep their case."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.partition(":")
        if sep:
            out[key.strip()] = value.strip()
    return out
