"""Recorded files: npz frames and maps, binvox grids, PLY clouds, and folders of recordings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aerolith.functions.labels import folder_seconds

FRAME_SCHEMA = (
    "path string, frame_id bigint, timestamp bigint, state_before_ts bigint, state_after_ts bigint, points array<struct<x: float, y: float, z: float>>, position struct<x: double, y: double, z: double>, "
    "orientation struct<w: double, x: double, y: double, z: double>, lidar_position struct<x: double, y: double, z: double>, lidar_orientation struct<w: double, x: double, y: double, z: double>, imu_angular_vel struct<x: double, y: double, z: double>, imu_linear_acc struct<x: double, y: double, z: double>, gps struct<lat: double, lon: double, alt: double>"
)
TIMES = ["timestamp", "state_before_ts", "state_after_ts"]
MEMBERS = {"position": "xyz", "orientation": "wxyz", "lidar_position": "xyz", "lidar_orientation": "wxyz", "imu_angular_vel": "xyz", "imu_linear_acc": "xyz", "gps": ("lat", "lon", "alt")}


def decode_frame(path: str, raw: bytes) -> tuple:
    """A frame's row from an npz file. Absent members and stored None are null; positions default to zero, orientations to identity."""
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        def get(name: str):
            try:
                v = f[name] if name in f.files else None
            except ValueError:  # a stored None is an object array, which is not loaded
                return None
            return None if v is None or v.dtype == object or v.size == 0 else v

        points, times = get("points"), [get(t) for t in TIMES]
        digits = "".join(c for c in path.rsplit("/", 1)[-1].split("-")[0].split(".")[0] if c.isdigit())
        row = [path, int(digits) if digits else None, *[None if t is None else int(t.reshape(-1)[0]) for t in times], None if points is None else [tuple(map(float, p)) for p in points.reshape(-1, 3)]]
        for name, parts in MEMBERS.items():
            v = get(name)
            default = (0.0, 0.0, 0.0) if name.endswith("position") else (1.0, 0.0, 0.0, 0.0) if name.endswith("orientation") else None
            row.append(default if v is None else tuple(map(float, v.reshape(-1)[: len(parts)])))
    return tuple(row)


def encode_frame(row: dict) -> bytes:
    """An npz file of a frame's row; null members are left out."""
    out = {}
    if row.get("points") is not None:
        out["points"] = np.array([[p["x"], p["y"], p["z"]] for p in row["points"]], dtype=np.float32).reshape(-1, 3)
    for t in TIMES:
        if row.get(t) is not None:
            out[t] = np.array(row[t], dtype=np.int64)
    for name, parts in MEMBERS.items():
        v = row.get(name)
        if v is not None:
            out[name] = np.array([v[p] for p in parts], dtype=float)
    b = io.BytesIO()
    np.savez_compressed(b, **out)
    return b.getvalue()


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all npz files below ``path``, in batches of many files a task; unreadable files fail the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [decode_frame(p, c) for p, c in zip(b["path"], b["content"])]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for name in MEMBERS:
                out[name] = [None if v is None else dict(zip(MEMBERS[name], v)) for v in out[name]]
            out["points"] = [None if v is None else [dict(zip("xyz", p)) for p in v] for v in out["points"]]
            for c in ("frame_id", *TIMES):
                out[c] = out[c].astype("Int64")
            yield out

    return files.mapInPandas(decode, FRAME_SCHEMA)


COLUMNS = ["path", "frame_id", *TIMES, "points", *MEMBERS]


#: Files that one partition of the data source reads.
FILES_A_TASK = 256


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _NpzReader(DataSourceReader):
    """Partitions of many files each, of a folder that driver and executors both see."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.skip, self.most = int(options.get("skip", 1)), options.get("max")

    def partitions(self) -> list[InputPartition]:
        import glob

        paths = sorted(glob.glob(f"{self.path}/**/*.npz", recursive=True))[:: self.skip]
        paths = paths[: int(self.most)] if self.most else paths
        return [_Files(paths[i : i + FILES_A_TASK]) for i in range(0, len(paths), FILES_A_TASK)]

    def read(self, partition: _Files):
        for path in partition.paths:
            with open(path, "rb") as f:
                yield decode_frame(path, f.read())


class NpzFrames(DataSource):
    """``spark.read.format("npz_frames").option("skip", n).option("max", m).load(folder)``: skip and cap before any file is read."""

    @classmethod
    def name(cls) -> str:
        return "npz_frames"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options)


def write_frames(frames: DataFrame, path: str) -> DataFrame:
    """One npz file per row, named frame_<id>-<file_id>.npz, in a folder per recording; returns (file_id, path, n_bytes).

    Files are written by the tasks into a folder that all executors share; a file is renamed into
    place when whole, so a task that runs again leaves whole files only. The result is lazy: read it
    once, through ``written``.
    """
    target = path.removeprefix("file://")

    return _write_each(frames, lambda r: (f"{target}/{r['recording']}", f"frame_{r['frame_id']:05d}-{r['file_id']}.npz", encode_frame(r)), "file_id")


def _write_each(rows: DataFrame, encode, row_id: str) -> DataFrame:
    """A file per row, lazily: (row_id, path, n_bytes). ``encode`` gives a row's folder, file name and bytes."""

    def save(batches):
        import os
        import uuid

        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                folder, name, raw = encode(r)
                os.makedirs(folder, exist_ok=True)
                part = f"{folder}/{name}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, f"{folder}/{name}")
                out.append((r[row_id], f"{folder}/{name}", len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=[row_id, "path", "n_bytes"])

    return rows.mapInArrow(save, f"{row_id} bigint, path string, n_bytes bigint")


MAP_SCHEMA = "path string, points array<struct<x: float, y: float, z: float>>, timestamp double, source string, bounds array<double>, resolution double, extra map<string, string>"


def encode_map(row: dict) -> bytes:
    """An npz file of a map: points, timestamp, source, bounds and resolution where there are any, and a member for each extra."""
    out = {}
    if row.get("points") is not None:
        out["points"] = np.array([[p["x"], p["y"], p["z"]] if p else [0, 0, 0] for p in row["points"]], dtype=np.float32).reshape(-1, 3)
    for name, kind in (("timestamp", float), ("source", str), ("bounds", float), ("resolution", float)):
        v = row.get(name)
        if v is not None:
            out[name] = np.array([np.nan if x is None else x for x in v] if isinstance(v, list) else v, dtype=kind)
    for name, v in row.get("extra") or []:
        if v is not None and name not in out:
            out[name] = np.array(v)
    b = io.BytesIO()
    np.savez_compressed(b, **out)
    return b.getvalue()


def decode_map(path: str, raw: bytes) -> dict:
    """All members of a map's npz file; those without a column of their own are extras, as text."""
    row: dict = {"path": path, "points": None, "timestamp": None, "source": None, "bounds": None, "resolution": None, "extra": {}}
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        for name in f.files:
            v = f[name]
            if name == "points":
                row[name] = [dict(zip("xyz", map(float, p))) for p in v.reshape(-1, 3)]
            elif name in row and name not in ("path", "extra"):
                row[name] = v.tolist()
            else:
                row["extra"][name] = str(v)
    return row


def write_maps(maps: DataFrame, path: str) -> DataFrame:
    """One slam_map.npz per row in a folder of its own, as ``write_frames``: (map_id, path, n_bytes)."""
    target = path.removeprefix("file://")
    return _write_each(maps, lambda r: (f"{target}/{r['map_id']}-{r['folder']}", "slam_map.npz", encode_map(r)), "map_id")


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Maps of all npz files below ``path`` with all their members."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([decode_map(p, c) for p, c in zip(b["path"], b["content"])], columns=["path", "points", "timestamp", "source", "bounds", "resolution", "extra"])

    return files.mapInPandas(decode, MAP_SCHEMA)


def decode_binvox(raw: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header and the runs of a binvox file: (dims, translate, scale), values, counts."""
    head = {"translate": [0.0, 0.0, 0.0], "scale": 1.0}
    at = raw.index(b"\n") + 1
    if not raw.startswith(b"#binvox"):
        raise ValueError("not a binvox file")
    while True:
        end = raw.index(b"\n", at)
        word, *rest = raw[at:end].decode("ascii").split()
        at = end + 1
        if word == "data":
            break
        if word == "dim":
            head["dims"] = [int(v) for v in rest]
        elif word == "translate":
            head["translate"] = [float(v) for v in rest]
        elif word == "scale":
            head["scale"] = float(rest[0])
    if "dims" not in head:
        raise ValueError("no dimensions in the binvox header")
    data = np.frombuffer(raw, dtype=np.uint8, offset=at)
    return head, data[0::2], data[1::2]


def encode_binvox(cells: np.ndarray, dims: list[int], translate: list[float], scale: float) -> bytes:
    """A binvox file of occupied cells (rows of indices), first axis fastest."""
    flat = np.zeros(int(np.prod(dims)), dtype=np.uint8)
    flat[np.ravel_multi_index(cells.T, dims, order="F")] = 1
    cuts = np.flatnonzero(np.diff(flat)) + 1
    runs = []
    for part in np.split(flat, cuts):
        for n in range(0, len(part), 255):
            runs += [part[0], min(255, len(part) - n)]
    head = f"#binvox 1\ndim {dims[0]} {dims[1]} {dims[2]}\ntranslate {' '.join(map(repr, translate))}\nscale {scale!r}\ndata\n"
    return head.encode("ascii") + bytes(runs)


def binvox_points(files: DataFrame, center: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(path, x, y, z): occupied voxel centres in north, east, down from (path, content) rows.

    Only the runs are decoded in Python; they are spread and turned into coordinates as columns.
    The third axis of the file is east and the second is up, so it is negated with its offset.
    """
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                head, values, counts = decode_binvox(raw)
                ends = np.cumsum(counts.astype(np.int64))
                total = int(np.prod(head["dims"]))
                on = (values > 0) & (counts > 0) & (ends - counts < total)
                d = pd.DataFrame({"path": path, "first": (ends - counts)[on], "last": np.minimum(ends, total)[on] - 1})
                for n, v in (("d0", head["dims"][0]), ("d1", head["dims"][1]), ("dmax", max(head["dims"])), ("t0", head["translate"][0]), ("t1", head["translate"][1]), ("t2", head["translate"][2]), ("scale", head["scale"])):
                    d[n] = v
                yield d

    r = files.select("path", "content").mapInPandas(runs, "path string, first bigint, last bigint, d0 bigint, d1 bigint, dmax bigint, t0 double, t1 double, t2 double, scale double")
    r = r.withColumn("at", F.explode(F.sequence("first", "last")))
    i, j, k = F.col("at") % F.col("d0"), F.expr("at div d0 % d1"), F.expr("at div (d0 * d1)")

    def along(c: Column, t: str, mid: float) -> Column:
        return (c + 0.5) / F.col("dmax") * F.col("scale") + F.col(t) + F.lit(mid)

    return r.select("path", along(i, "t0", center[0]).alias("x"), along(k, "t1", center[1]).alias("y"), (-along(j, "t2", center[2])).alias("z"))


def latest(folders: DataFrame, name: str, n: int = 1) -> DataFrame:
    """The ``n`` newest rows by the time in their folder name, whatever the name's prefix; names without a time are oldest."""
    return folders.withColumn("__s", folder_seconds(F.col(name))).orderBy(F.desc_nulls_last("__s"), F.desc(name)).limit(n).drop("__s")


def write_ply(points: DataFrame, path: str) -> None:
    """An ASCII PLY cloud: a header part and text parts with one point a line, in file order."""
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", "property float x", "property float y", "property float z", "end_header"]
    spark = points.sparkSession
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    points.select(F.concat_ws(" ", *[F.col(a).cast("string") for a in "xyz"]).alias("value")).write.mode("overwrite").text(f"{path}/points")
