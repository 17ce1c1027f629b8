"""LAS point files (versions 1.0 to 1.4, formats 0 to 10, uncompressed) as a Spark data source.

    spark.dataSource.register(LasDataSource)
    points = spark.read.format("las").load("/data/tiles")

A file is read in ranges of records, each a partition; compressed (LAZ) files raise an error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..functions.crs import Crs, from_geo_keys, geo_keys
from ..functions.units import LinearUnit
from .files import file_size, find_files, read_range, write_file

SCHEMA = (
    "file string, x double, y double, z double, intensity int, return_number smallint, number_of_returns smallint, "
    "classification smallint, withheld boolean, synthetic boolean, keypoint boolean, overlap boolean, scan_angle double"
)
RECORDS_PER_PARTITION = 2_000_000
RECORDS_PER_BATCH = 100_000
# Fixed values of the format: bytes of a point record by point format.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
POINT10 = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
POINT14 = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]


@dataclass(frozen=True)
class LasHeader:
    path: str
    minor: int
    point_format: int
    record_bytes: int
    point_offset: int
    n_points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    wkt: str = ""
    keys: dict[int, int | float | str] = field(default_factory=dict)
    compressed: bool = False

    @property
    def crs(self) -> Crs:
        """The system by WKT, else by GeoTIFF keys; a text that cannot be read leaves it unknown."""
        if self.wkt:
            try:
                return Crs.parse(self.wkt)
            except ValueError:
                return Crs()
        return from_geo_keys(self.keys) if self.keys else Crs()


def read_header(path: str) -> LasHeader:
    """Header and variable records of one file; only their bytes are read."""
    head = read_range(path, 0, 375)
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    major, minor = head[24], head[25]
    if major > 1 or minor > 4:
        raise ValueError(f"{path}: LAS {major}.{minor} is not supported")
    header_bytes, point_offset, n_vlr, kind, record_bytes, n_points = struct.unpack_from("<HIIBHI", head, 94)
    scale, offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    bounds = struct.unpack_from("<6d", head, 179)
    evlr_at = n_evlr = 0
    if minor >= 4 and len(head) >= 375:
        evlr_at, n_evlr, big = struct.unpack_from("<QIQ", head, 235)
        n_points = big or n_points
    compressed = kind & 0x80 != 0 or kind & 0x40 != 0
    wkt, found = "", {}
    records = _variable(read_range(path, header_bytes, max(0, point_offset - header_bytes)), n_vlr, 54, "<H16sHH32s")
    if n_evlr:
        records += _variable(read_range(path, evlr_at, max(0, file_size(path) - evlr_at)), n_evlr, 60, "<H16sHQ32s")
    for user, number, data in records:
        if user == "LASF_Projection" and number in (2111, 2112):
            wkt = data.rstrip(b"\0").decode("utf-8", "replace") or wkt
        elif user == "LASF_Projection" and number in (34735, 34736, 34737):
            found[number] = data
        elif number == 22204:
            compressed = True
    kind &= 0x3F
    if kind not in RECORD_BYTES:
        raise ValueError(f"{path}: point format {kind} is not supported")
    keys = {}
    if 34735 in found:
        directory, doubles = (np.frombuffer(d[: len(d) // k * k], t).tolist() for d, k, t in ((found[34735], 2, "<u2"), (found.get(34736, b""), 8, "<f8")))
        keys = geo_keys(tuple(directory), tuple(doubles), found.get(34737, b"").decode("latin-1"))
    return LasHeader(path, minor, kind, record_bytes, point_offset, n_points, scale, offset, bounds[1::2], bounds[0::2], wkt, keys, compressed)


def _variable(data: bytes, count: int, head: int, layout: str) -> list[tuple[str, int, bytes]]:
    """Records of a variable-record block; a count that promises too much ends with the block."""
    out, at = [], 0
    while len(out) < count and at + head <= len(data):
        _, user, number, size, _ = struct.unpack_from(layout, data, at)
        out.append((user.rstrip(b"\0").decode("latin-1"), number, data[at + head : at + head + size]))
        at += head + size
    return out


def decode(raw: bytes, h: LasHeader, wanted: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """Columns of packed records, all or those wanted; bits are taken apart for all records at once."""
    new = h.point_format >= 6
    kind = np.dtype(POINT14 if new else POINT10)
    fields = {n: kind.fields[n] for n in kind.names}
    packed = np.dtype({"names": list(fields), "formats": [f[0] for f in fields.values()], "offsets": [f[1] for f in fields.values()], "itemsize": h.record_bytes})
    p = np.frombuffer(raw, packed)
    made = {a: (lambda a=a, s=s, o=o: p[a] * s + o) for a, s, o in zip("xyz", h.scale, h.offset)}
    made["intensity"] = lambda: p["intensity"].astype(np.int32)
    bit = lambda name, k: lambda: p[name] >> k & 1 > 0
    if new:
        made |= {"return_number": lambda: p["returns"] & 15, "number_of_returns": lambda: p["returns"] >> 4, "classification": lambda: p["class"], "scan_angle": lambda: p["angle"] * 0.006}
        made |= {"synthetic": bit("flags", 0), "keypoint": bit("flags", 1), "withheld": bit("flags", 2), "overlap": bit("flags", 3)}
    else:
        made |= {"return_number": lambda: p["bits"] & 7, "number_of_returns": lambda: p["bits"] >> 3 & 7, "classification": lambda: p["class"] & 31, "scan_angle": lambda: p["angle"].astype(float)}
        made |= {"synthetic": bit("class", 5), "keypoint": bit("class", 6), "withheld": bit("class", 7), "overlap": lambda: np.zeros(len(p), bool)}
    return {n: f() for n, f in made.items() if not wanted or n in wanted}


@dataclass
class Records(InputPartition):
    """A range of a file's records; ``last``: nothing of the file comes after it."""

    header: LasHeader
    start: int
    count: int
    last: bool = False


class LasDataSource(DataSource):
    """Format ``las``.

    Options: ``path`` (file, folder or pattern), ``recordsPerPartition``, ``columns`` (names, by comma: no others are
    decoded), ``system`` (only files whose system has this key) and ``pushdown`` (true: comparisons with constants
    are checked against headers, so that files apart from a box are not read, and then against records).
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        fields = {part.split()[0]: part for part in SCHEMA.split(", ")} | {"last": "last boolean"}
        if unknown := [c for c in wanted if c not in fields]:
            raise ValueError(f"points have no column {unknown[0]}")
        return ", ".join(fields[c] for c in wanted) if wanted else SCHEMA

    def reader(self, schema) -> LasReader:
        names = [f.name for f in schema.fields]
        return (PushingReader if self.options.get("pushdown", "").lower() == "true" else LasReader)(self.options, names)

    def streamReader(self, schema) -> LasStreamReader:
        return LasStreamReader(self.options, [f.name for f in schema.fields])


SMALL = ("return_number", "number_of_returns", "classification")
NUMBERS = ("x", "y", "z", "intensity", *SMALL, "scan_angle")


def _box(path: str) -> LasHeader:
    h = read_header(path)
    if h.compressed:
        raise ValueError(f"{path} is compressed (LAZ); decompress it first")
    return h


def headers(paths: list[str]) -> list[LasHeader]:
    """Headers of many files, read at the same time."""
    with ThreadPoolExecutor(min(32, len(paths) or 1)) as pool:
        return list(pool.map(_box, paths))


class LasReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.system, self.names = options["path"], options.get("system"), names
        self.size = int(options.get("recordsPerPartition", RECORDS_PER_PARTITION))
        self.tests: list[tuple[str, str, object]] = []

    @property
    def arrow(self) -> pa.Schema:
        kinds = {"file": pa.string(), "intensity": pa.int32()} | dict.fromkeys(SMALL, pa.int16()) | dict.fromkeys(("withheld", "synthetic", "keypoint", "overlap", "last"), pa.bool_())
        return pa.schema([(n, kinds.get(n, pa.float64())) for n in self.names])

    def _reads(self, h: LasHeader) -> bool:
        """Whether a file can hold points that pass."""
        if self.system is not None and h.crs.key != self.system:
            return False
        low, high = dict(zip("xyz", h.low)), dict(zip("xyz", h.high))
        for name, sign, value in self.tests:
            if name in low and sign != "in":
                a, b = low[name], high[name]
                if not {"=": a <= value <= b, ">": b > value, ">=": b >= value, "<": a < value, "<=": a <= value}[sign]:
                    return False
            elif name == "file" and h.path not in (value if sign == "in" else [value]):
                return False
        return h.n_points > 0

    def partitions(self) -> list[Records]:
        out = []
        for h in headers(find_files(self.path, (".las", ".laz"))):
            if self._reads(h):
                out += [Records(h, k, min(self.size, h.n_points - k)) for k in range(0, h.n_points, self.size)]
        return out or [Records(None, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        h = partition.header
        if h is None:
            return
        wanted = (*self.names, "x", "y", *(n for n, _, _ in self.tests))
        for k in range(0, partition.count, RECORDS_PER_BATCH):
            n = min(RECORDS_PER_BATCH, partition.count - k)
            raw = read_range(h.path, h.point_offset + (partition.start + k) * h.record_bytes, n * h.record_bytes)
            c = decode(raw[: len(raw) // h.record_bytes * h.record_bytes], h, wanted)
            # points outside the header's box are damage
            ok = (c["x"] >= h.low[0]) & (c["x"] <= h.high[0]) & (c["y"] >= h.low[1]) & (c["y"] <= h.high[1])
            for name, sign, value in self.tests:
                if name != "file":
                    ok &= COMPARE[sign](c[name], value)
            arrays = []
            for name in self.names:
                if name == "last":
                    arrays.append(pa.array(np.zeros(int(ok.sum()), bool)))
                elif name == "file":
                    arrays.append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(int(ok.sum()), np.int32)), pa.array([h.path])).cast(pa.string()))
                else:
                    arrays.append(pa.array(c[name][ok].astype(np.int16) if name in SMALL else c[name][ok]))
            yield pa.RecordBatch.from_arrays(arrays, names=self.names)
        if partition.last and "last" in self.names:
            yield pa.RecordBatch.from_pylist([{"file": h.path, "last": True}], schema=self.arrow)


COMPARE = {"=": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "in": lambda a, v: np.isin(a, list(v))}
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class PushingReader(LasReader):
    """Takes comparisons of numbers and file names with constants; points have no nulls."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, sign = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None, _SIGNS.get(type(f))
            if name in NUMBERS and sign and f.value is not None:
                self.tests.append((name, sign, f.value))
            elif name == "file" and sign in ("=", "in"):
                self.tests.append((name, sign, f.value))
            elif not (isinstance(f, IsNotNull) and name):
                yield f


class LasStreamReader(DataSourceStreamReader):
    """Files of a folder as a stream, each once, in order of names among those that are new.

    A batch takes ``filesPerBatch`` files or ``recordsPerBatch`` records at most (default: all there is), so a file
    may come in several.  With the column ``last`` among ``columns``, each file ends with a row that has its name and
    ``last`` true and nothing else; a file without points has this row alone.  An offset is the list of the files that
    were read, and how far the next one was.  A file has to be whole when it appears (written elsewhere, then moved).
    A run that ends with what is there (``availableNow``) takes one batch.
    """

    def __init__(self, options, names: list[str]):
        self.scan = LasReader(options, names)
        self.files, self.records = int(options.get("filesPerBatch", 1 << 30)), int(options.get("recordsPerBatch", 1 << 62))
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": "[]", "part": "", "at": "0"}

    def latestOffset(self) -> dict:
        now = self.now or self.initialOffset()
        done, part, at = json.loads(now["files"]), now["part"], int(now["at"])
        seen = set(done)
        files, room = self.files, self.records
        for path in ([part] if part else []) + [f for f in find_files(self.scan.path, (".las", ".laz")) if f not in seen and f != part]:
            if not files or room <= 0:
                break
            rest = _box(path).n_points - (at if path == part else 0)
            if rest > room:
                part, at, room = path, (at if path == part else 0) + room, 0
                break
            done.append(path)
            files, room = files - 1, room - rest
            if path == part:
                part, at = "", 0
        self.now = {"files": json.dumps(done), "part": part, "at": str(at)}
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Records]:
        before = set(json.loads(start["files"]))
        self.now = end
        out = []
        new = [f for f in json.loads(end["files"]) if f not in before]
        for h in headers(new + ([end["part"]] if end["part"] else [])):
            first = int(start["at"]) if start["part"] == h.path else 0
            whole = h.path in new
            stop = h.n_points if whole else int(end["at"])
            cuts = list(range(first, stop, self.scan.size)) or ([first] if whole else [])
            out += [Records(h, k, min(self.scan.size, stop - k), whole and k == cuts[-1]) for k in cuts]
        return out or [Records(None, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        return self.scan.read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] = (), **options) -> DataFrame:
    """Points of files; filters on numbers reach the reader, and with ``columns`` no others are decoded."""
    spark.dataSource.register(LasDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = {"columns": ",".join(columns)} if columns else {}
    return spark.read.format("las").options(pushdown="true", **wanted, **options).load(path)


def stream_points(spark: SparkSession, path: str, columns: tuple[str, ...] = (), **options) -> DataFrame:
    """Points of files as they arrive in a folder."""
    spark.dataSource.register(LasDataSource)
    wanted = {"columns": ",".join(columns)} if columns else {}
    return spark.readStream.format("las").options(**wanted, **options).load(path)


def las_catalogue(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per readable file, from headers alone; headers are read on the executors."""
    schema = "path string, minor int, point_format int, n_points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, epsg int, z_unit string, z_metres double, crs_key string, crs_text string, compressed boolean"
    found = find_files(paths, (".las", ".laz"))
    if not found:
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([(f,) for f in found], "path string").repartition(max(1, len(found) // 64 + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    h = read_header(path)
                except (ValueError, OSError):  # not a point file: left out, as in a folder of mixed files
                    continue
                box = [v for pair in zip(h.low, h.high) for v in pair]
                crs = h.crs
                rows.append((path, h.minor, h.point_format, h.n_points, *box, crs.epsg, crs.z_unit.name, crs.z_unit.metres, crs.key, crs.to_wkt() or (str(crs.epsg) if crs.epsg else ""), h.compressed))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 6, pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[p.split()[0] for p in schema.split(", ")])

    return names.mapInArrow(run, schema)


def write_las(path: str, columns: dict[str, np.ndarray], point_format: int = 6, scale: float = 0.01, wkt: str = "") -> None:
    """Write one uncompressed file: format 0 to 3 as LAS 1.2, 6 and 7 as 1.4."""
    n = len(columns["x"])
    new = point_format >= 6
    kind = np.dtype(POINT14 if new else POINT10)
    size = RECORD_BYTES[point_format]
    rec = np.zeros(n, np.dtype({"names": kind.names, "formats": [kind.fields[f][0] for f in kind.names], "offsets": [kind.fields[f][1] for f in kind.names], "itemsize": size}))
    for a in "xyz":
        rec[a] = np.round(np.asarray(columns[a]) / scale)
    get = lambda name, default=0: np.asarray(columns.get(name, np.full(n, default)))
    rec["intensity"] = get("intensity")
    if new:
        rec["returns"] = get("return_number", 1) | get("number_of_returns", 1) << 4
        rec["flags"] = get("synthetic") | get("keypoint") << 1 | get("withheld").astype(int) << 2 | get("overlap") << 3
        rec["class"], rec["angle"] = get("classification"), np.round(get("scan_angle") / 0.006)
    else:
        rec["bits"] = get("return_number", 1) | get("number_of_returns", 1) << 3
        rec["class"] = get("classification") | get("synthetic") << 5 | get("keypoint") << 6 | get("withheld").astype(int) << 7
        rec["angle"] = get("scan_angle")
    body = wkt.encode() + b"\0" if wkt else b""
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(body), b"") + body if wkt else b""
    head_size = 375 if new else 227
    xyz = [rec[a] * scale for a in "xyz"]
    bounds = [f(v) if n else 0.0 for v in xyz for f in (np.max, np.min)]
    head = bytearray(head_size)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 4 if new else 2))
    struct.pack_into("<HIIBHI", head, 94, head_size, head_size + len(vlr), 1 if wkt else 0, point_format, size, 0 if new else n)
    struct.pack_into("<12d", head, 131, scale, scale, scale, 0, 0, 0, *bounds)
    if new:
        struct.pack_into("<QIQ", head, 235, 0, 0, n)
    write_file(path, bytes(head) + vlr + rec.tobytes())


def write_las_files(points: DataFrame, folder: str, point_format: int = 6, scale: float = 0.01, wkt: str = "") -> DataFrame:
    """Write points as files under ``folder`` from the executors: ``(path, n_points)``.

    Each Arrow batch of a partition is a file, named by both, so a retried task writes the same files.
    """
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, pdf in enumerate(batches):
            if len(pdf):
                path = f"{folder}/part-{part:05d}-{k:05d}.las"
                write_las(path, {c: pdf[c].to_numpy() for c in pdf.columns}, point_format, scale, wkt)
                yield pdf.iloc[:1, :0].assign(path=path, n_points=len(pdf))

    names = ["x", "y", "z", "intensity", "return_number", "number_of_returns", "classification", "withheld", "scan_angle"]
    return points.select(*[c for c in names if c in points.columns]).mapInPandas(run, "path string, n_points long")
