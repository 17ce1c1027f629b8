"""From options to products: catalogue, heights, then one lazy DataFrame for each product."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import Crs
from ..functions.grid import Extent, Grid
from ..functions.lineage import delete_path, materialize, read_text, write_text
from ..functions.units import LinearUnit
from ..operators import csm as surface
from ..operators import metrics, terrain, trees
from ..operators.ground import MAX_SYSTEMS, Ground, moved_boxes
from ..operators.points import already_normalized, normalize, reproject
from ..sources.las import las_catalogue, read_points
from ..sources.raster_sink import write_layers
from ..sources.rasters import crs_of, raster_grid, write_table
from ..sources.vectors import write_vectors
from .config import RunConfig

#: Products by name, each ``Run -> {table name: DataFrame}``; more can be registered.
PRODUCTS: dict[str, Callable[[Run], dict[str, DataFrame]]] = {}
#: Exchangeable steps by kind and name.
ALGORITHMS: dict[str, dict[str, Callable]] = {
    "ground": {
        "raster": lambda points, run: normalize(points, *run.ground, run.config.min_ht, run.config.max_ht),
        "none": lambda points, run: already_normalized(points, run.config.min_ht, run.config.max_ht),
    },
    "csm": {"max": surface.max_points},
    "post": {
        "none": lambda csm, grid, c: surface.unchanged(csm, grid),
        "smooth": lambda csm, grid, c: surface.smooth(csm, grid, c.smooth),
        "fill": lambda csm, grid, c: surface.unchanged(csm, grid).unionByName(surface.fill(csm, grid, c.fill_needed, c.fill_distance)),
        "smooth_fill": lambda csm, grid, c: surface.smooth_and_fill(csm, grid, c.smooth, c.fill_needed, c.fill_distance),
    },
    "id": {"highpoint": trees.identify},
    "seg": {"watershed": trees.segments},
}


#: Conditions that points have to meet besides the options', and metrics besides the usual ones, by name.
FILTERS: dict[str, Callable[[RunConfig], Column]] = {}
METRICS: dict[str, Callable[[RunConfig], Column]] = {}


def register_filter(name: str, condition: Callable[[RunConfig], Column]) -> None:
    FILTERS[name] = condition


def register_metric(name: str, aggregate: Callable[[RunConfig], Column]) -> None:
    """Add a metric: an aggregate over a cell's points (``x, y, z, intensity, return_number``)."""
    METRICS[name] = aggregate


def register(name: str):
    """Add or replace a product."""

    def add(f):
        PRODUCTS[name] = f
        return f

    return add


def register_algorithm(kind: str, name: str, f: Callable) -> None:
    ALGORITHMS[kind][name] = f


@dataclass
class Run:
    """What products draw on; tables that several products read are written once, on first use.

    Lengths in the plane of ``config`` are in the unit of the system's coordinates, heights in the user's.
    """

    spark: SparkSession
    config: RunConfig
    points: DataFrame
    dems: Ground | list[tuple[DataFrame, Grid]] | None
    grid: Grid
    files: DataFrame | None = None
    crs: Crs = Crs()
    #: The options as they were stated, before lengths were converted.
    stated: RunConfig | None = None
    counts: dict[str, Observation] = field(default_factory=dict)
    _kept: dict = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.dems, list):
            self.dems = Ground.of_rasters(self.spark, self.dems, self.crs) if self.dems else None

    @property
    def rise(self) -> float:
        """Units of the plane in one of heights: slopes and surfaces compare the two."""
        return LinearUnit.named(self.config.user_units).factor_to(self.crs.xy_unit)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = materialize(make())
        return self._kept[name]

    def _counted(self, name: str, df: DataFrame, *sums: Column) -> DataFrame:
        """The same rows, which leave sums behind when they are first computed."""
        self.counts[name] = Observation(name)
        return df.observe(self.counts[name], *sums)

    @property
    def csm_grid(self) -> Grid:
        return Grid.from_resolution(self.grid.extent, self.config.csm_cellsize)

    @property
    def ground(self) -> tuple[DataFrame, Grid]:
        """The finest ground at each cell of the finest raster's grid size."""
        target = self.dems.grid(self.grid.extent)
        return self._once("ground", lambda: self.dems.on(target)), target

    def heights(self) -> DataFrame:
        c = self.config

        def make():
            conditions = c.point_filter().conditions() | {name: f(c) for name, f in FILTERS.items()}
            points = self.points
            if c.bench:  # counts what is read, so filters do not reach the reader
                first = F.lit(True)
                dropped = []
                for name, condition in conditions.items():
                    dropped.append(F.count_if(first & ~condition).alias(f"dropped_{name}"))
                    first = first & condition
                points = self._counted("points", points, F.count("*").alias("read"), *dropped)
            for condition in conditions.values():
                points = points.where(condition)
            algo = "none" if c.dem_algo == "raster" and not self.dems else c.dem_algo
            out = ALGORITHMS["ground"][algo](points, self)
            return self._counted("heights", out, F.count("*").alias("kept")) if c.bench else out

        return self._once("heights", lambda: make().select("x", "y", "z", "intensity", "return_number"))

    def surface(self) -> DataFrame:
        c = self.config
        post = c.post_algo or ("smooth" if c.smooth >= 3 else "") + ("_fill" if c.csm_fill and c.smooth >= 3 else "fill" if c.csm_fill else "")

        def make():
            raw = self._once("raw_csm", lambda: ALGORITHMS["csm"][c.csm_algo](self.heights(), self.csm_grid, c.footprint))
            return ALGORITHMS["post"][post or "none"](raw, self.csm_grid, c)

        return self._once("csm", make)


@register("points")
def point_products(run: Run) -> dict[str, DataFrame]:
    c = run.config
    if not c.do_points:
        return {}
    h = run.heights()
    out = {"point_metrics": metrics.point_metrics(h, run.grid, c.canopy, c.return_types, c.advanced, more={n: f(c) for n, f in METRICS.items()})}
    if c.advanced:
        out["cover_above_mean"] = metrics.cover_above_mean(h, run.grid, c.canopy, c.return_types)
    if c.do_strata:
        out["strata"] = metrics.strata(h, run.grid, c.strata, c.return_types)
    if run.files is not None:
        out["coverage"] = metrics.coverage(run.files, run.grid)
    return out


@register("csm")
def surface_products(run: Run) -> dict[str, DataFrame]:
    if not run.config.do_csm:
        return {}
    out = {"csm": run.surface()}
    if run.config.csm_metrics:
        out["csm_metrics"] = surface.csm_metrics(run.surface(), run.csm_grid, run.grid, run.rise)
    return out


@register("tao")
def tree_products(run: Run) -> dict[str, DataFrame]:
    c = run.config
    if not c.with_taos:
        return {}
    g = run.csm_grid
    tops = run._once("tops", lambda: ALGORITHMS["id"][c.id_algo](run.surface(), g, c.tao_height, c.min_tao_dist))
    crowns = run._once("crowns", lambda: ALGORITHMS["seg"][c.seg_algo](run.surface(), tops, g, cutoff=c.canopy, max_height=c.max_ht))
    taos = trees.tree_table(tops, crowns, g, area_factor=run.rise**-2)
    return {"taos": taos, "segments": trees.segment_rasters(crowns, taos)}


@register("intensity")
def intensity_products(run: Run) -> dict[str, DataFrame]:
    c = run.config
    if not c.do_fine_int:
        return {}
    g = Grid.from_resolution(run.grid.extent, c.fine_int_cellsize or c.csm_cellsize)
    cutoff = None if c.fine_int_no_cutoff else c.canopy if c.fine_int_cutoff is None else c.fine_int_cutoff
    return {"fine_intensity": surface.mean_intensity(run.heights(), g, cutoff)}


@register("topo")
def topo_products(run: Run) -> dict[str, DataFrame]:
    c = run.config
    if not c.do_topo or not run.dems:
        return {}
    dem, grid = run.ground
    elevation = run._once("elevation", lambda: terrain.mean_elevation(dem, grid, run.grid))
    where = {"latitude": run.crs} if run.crs.projection else {}
    level = elevation if run.rise == 1.0 else elevation.withColumn("value", F.col("value") * run.rise)
    slopes = terrain.topo_metrics(level, run.grid, c.radians, **where)
    if run.rise != 1.0:
        slopes = slopes.withColumn("TerrainRuggedness", F.col("TerrainRuggedness") / run.rise)
    out = {"elevation": elevation, "topo_metrics": slopes}
    for radius in c.topo_scale:
        wide = run.grid.extend(Extent(*(v for v in run.grid.extent.buffer(radius).__dict__.values() if v is not None)))
        dr, dc = run.grid.offset_to(wide)
        moved = elevation.withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc})
        full = moved.select("row", "col", "value").unionByName(run.dems.on(wide).join(moved, ["row", "col"], "left_anti"))
        index = terrain.position_index(full, wide, radius).withColumns({"row": F.col("row") - dr, "col": F.col("col") - dc})
        inside = index.where(f"row between 0 and {run.grid.nrow - 1} and col between 0 and {run.grid.ncol - 1}")
        out[f"topo_position_{radius:g}"] = inside.join(elevation.select("row", "col"), ["row", "col"], "left_semi")
    return out


def open_run(spark: SparkSession, config: RunConfig) -> Run:
    """Read the catalogues and lay out the grid; points stay lazy.

    Files may be in several systems and units: each is moved from what its own header says, unless the options
    state one for all.  The output is in ``out_crs``, else the system of ``alignment``, else that of the points if
    they share one.  ``alignment`` is a raster file whose cells the output's are to follow.
    """
    found = las_catalogue(spark, list(config.las))
    if found.isEmpty():
        raise ValueError("no point files were found")
    stated, unit = crs_of(config.las_crs), LinearUnit.named(config.las_units)
    said = found.groupBy("crs_key").agg(*[F.first(c).alias(c) for c in ("crs_text", "z_unit", "z_metres")]).limit(MAX_SYSTEMS + 1).collect()
    if len(said) > MAX_SYSTEMS:
        raise ValueError(f"point files are in over {MAX_SYSTEMS} coordinate systems")
    by_key = {r["crs_key"]: replace(Crs.parse(r["crs_text"]), z_unit=LinearUnit(r["z_unit"], r["z_metres"])) for r in said}
    keys = sorted(by_key)
    systems = [by_key[k] for k in keys]
    if stated.known:
        systems = [replace(stated, z_unit=stated.z_unit if stated.z_unit.metres else s.z_unit) for s in systems]
    if unit.metres:
        systems = [replace(s, z_unit=unit) for s in systems]
    pattern = raster_grid(config.alignment) if config.alignment else None
    to = next((c for c in (crs_of(config.out_crs), crs_of(config.alignment) if config.alignment else Crs()) if c.known), None)
    if to is None:
        to = systems[0]
        if not all(s.same_place(to) for s in systems):
            raise ValueError("point files are in several coordinate systems; state the output's with out-crs")
    to = replace(to, z_unit=LinearUnit.named(config.user_units), vertical=0)
    c = config.on_plane(to.xy_unit)
    number = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("crs_key")).cast("int") - 1
    files = moved_boxes(found.withColumn("system", number), systems, to)
    files = materialize(files.drop("xmin", "xmax", "ymin", "ymax").withColumnsRenamed({f"b{k}": k for k in ("xmin", "xmax", "ymin", "ymax")}))
    points = None
    for k, (key, system) in enumerate(zip(keys, systems)):
        for path in config.las:
            part = reproject(read_points(spark, path, **({"system": key} if len(keys) > 1 else {})), system, to)
            points = part if points is None else points.unionByName(part)
    extent = Extent(*files.agg(F.min("xmin"), F.max("xmax"), F.min("ymin"), F.max("ymax")).first())
    reach = max(c.topo_scale, default=0.0) + 2 * c.cellsize
    ground = None
    if config.dem:
        heights = systems[0].z_unit
        grown = files.select(F.col("path").alias("file"), *[(F.col(k) + s * reach).alias(k) for k, s in (("xmin", -1), ("xmax", 1), ("ymin", -1), ("ymax", 1))])
        ground = Ground.open(spark, list(config.dem), to, extent.buffer(reach), crs_of(config.dem_crs), LinearUnit.named(config.dem_units), heights, grown)
        if ground is None:
            raise ValueError("ground was given, but none of it overlaps the points")
    xres, yres = c.xres or c.cellsize, c.yres or c.xres or c.cellsize
    origin = (c.xorigin, c.yorigin)
    if pattern is not None:
        xres, yres, origin = pattern.xres, pattern.yres, pattern.origin
    grid = Grid.from_resolution(extent, xres, yres, *origin)
    return Run(spark, replace(c, cellsize=xres), points, ground, grid, files, to, config)


def products(run: Run) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {}
    for make in PRODUCTS.values():
        out |= make(run)
    return out


def write_rasters(run: Run, name: str, df: DataFrame) -> list[str]:
    """GeoTIFF tiles of each numeric column of a product that is a raster, in one job: the folders, one a column and part."""
    if not {"row", "col"} <= set(df.columns) or name == "taos":
        return []
    g = {"csm": run.csm_grid, "segments": run.csm_grid}.get(name, run.grid)
    if name == "fine_intensity":
        g = Grid.from_resolution(run.grid.extent, run.config.fine_int_cellsize or run.config.csm_cellsize)
    options = {"return_type": run.config.return_types, "stratum_idx": range(len(run.config.strata) + 1)}
    parts = [c for c in options if c in df.columns]
    layers = [c for c, t in df.dtypes if c not in ("row", "col", "stratum_idx") and t in ("double", "float", "int", "bigint", "smallint")]
    names = {c: run.config.file_name(c, "" if name == "fine_intensity" else run.config.unit_label(c), "tif")[:-4] for c in layers}
    folder = f"{run.config.output}/rasters/{name}"
    write_layers(df, g, folder, layers, parts, names, run.crs)
    chosen = [""]
    for c in parts:
        chosen = [f"{p}{o}/" for p in chosen for o in options[c]]
    return [f"{folder}/{p}{c}" for p in chosen for c in layers]


#: Fine cells along the side of a tile of trees.
TREE_TILE = 512


def write_trees(run: Run, taos: DataFrame) -> None:
    """The trees as vector files of points, one set a tile of the surface."""
    name = F.concat(F.lit(run.config.file_name("TAOs", extension="")[:-1] + "_Tile"), (F.col("tile_id") + 1).cast("string"))
    write_vectors(taos.select(name.alias("name"), "x", "y", "id", "height", "area", "radius"), f"{run.config.output}/vectors/taos", run.crs)


def write_layout(run: Run) -> None:
    """The outlines of the tiles that points cover, as one vector file."""
    g, size = run.csm_grid, TREE_TILE
    layout = Grid.from_resolution(g.extent, size * g.xres, size * g.yres, g.extent.xmin, g.extent.ymax)
    tiles = trees.tiles_of(run.files, layout)
    x0, y1 = layout.x() - layout.xres / 2, layout.y() + layout.yres / 2
    boxes = {"xmin": x0, "xmax": x0 + layout.xres, "ymin": y1 - layout.yres, "ymax": y1}
    name = F.lit(run.config.file_name("TileLayout", extension="")[:-1]).alias("name")
    shapes = tiles.withColumns(boxes).select(name, *boxes, F.col("name").alias("Tile"), (F.col("tile_id") + 1).alias("ID"), (F.col("col") + 1).alias("Column"), (F.col("row") + 1).alias("Row"))
    write_vectors(shapes, f"{run.config.output}/vectors/layout", run.crs)


#: Files of options that a run leaves behind, and the categories in each.
INI_FILES = {"full": (), "process_and_computer": ("process", "computer"), "data": ("data",), "process": ("process",), "computer": ("computer",)}


def clear_output(run: Run, made: list[str]) -> None:
    """Remove what an earlier run left in the output folder and this one does not make: its layers, vector files, and tables by its report."""
    spark, c = run.spark, run.config
    before = read_text(spark, f"{c.output}/{c.file_name('report', extension='json')}")
    for name, path in (json.loads(before)["products"] if before else {}).items():
        if name not in made and path.startswith(f"{c.output}/"):
            delete_path(spark, path)
    for folder in ("rasters", "vectors"):
        delete_path(spark, f"{c.output}/{folder}")


def execute(run: Run) -> dict[str, str]:
    """Write every product as Parquet, with ``rasters`` and ``vectors`` also as files, the options and a report: the paths by name.

    Layers and vector files that cannot be written are named in the report and in the log; a table that cannot be ends the run.
    """
    paths, rasters, seconds, failed = {}, [], {}, {}

    def attempt(name: str, write: Callable[[], list[str] | None]) -> list[str]:
        try:
            return write() or []
        except Exception as e:  # whatever a store or a task gave up with
            failed[name] = str(e)[:500]
            logging.getLogger(__name__).warning("%s could not be written: %s", name, e)
            return []

    c = run.config
    began = time.perf_counter()
    made = products(run)
    clear_output(run, list(made))
    seconds["shared tables"] = round(time.perf_counter() - began, 3)
    for name, df in made.items():
        began = time.perf_counter()
        paths[name] = f"{c.output}/{c.file_name(name, extension='parquet')}"
        write_table(df, paths[name], ("return_type",) if "return_type" in df.columns else ())
        if c.rasters:
            rasters += attempt(f"layers of {name}", lambda name=name, df=df: write_rasters(run, name, run.spark.read.schema(df.schema).parquet(paths[name])))
        if c.vectors and name == "taos":
            attempt("vector files of trees", lambda df=df: write_trees(run, run.spark.read.schema(df.schema).parquet(paths["taos"])))
        seconds[name] = round(time.perf_counter() - began, 3)
    if c.vectors and run.files is not None:
        attempt("vector file of tiles", lambda: write_layout(run))
    e = run.grid.extent
    report = {
        "grid": {"extent": [e.xmin, e.xmax, e.ymin, e.ymax], "nrow": run.grid.nrow, "ncol": run.grid.ncol},
        "products": paths,
        "rasters": rasters,
        "failed": failed,
        "bench": {"seconds": seconds, **{name: o.get for name, o in run.counts.items()}} if c.bench else {},
        "options": (run.stated or c).to_ini(),
    }
    delete_path(run.spark, f"{c.output}/{c.file_name('report', extension='json')}")
    write_text(run.spark, f"{c.output}/{c.file_name('report', extension='json')}", json.dumps(report, indent=1))
    for name, categories in INI_FILES.items():
        write_text(run.spark, f"{c.output}/parameters/{c.file_name(name, extension='ini')}", (run.stated or c).to_ini(*categories))
    return paths
