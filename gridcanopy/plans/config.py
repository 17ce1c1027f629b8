"""The options of a run: defaults, command line and ini files, names of outputs."""

from __future__ import annotations

import argparse
import configparser
import io
import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from ..functions.units import LinearUnit
from ..operators.metrics import STRATA
from ..operators.points import PointFilter

#: Lengths in the plane, which a run needs in the unit of its coordinates, and heights, which stay in the user's.
PLANE = ("cellsize", "xres", "yres", "xorigin", "yorigin", "csm_cellsize", "footprint", "min_tao_dist", "fine_int_cellsize")
HEIGHTS = ("min_ht", "max_ht", "canopy", "min_tao_ht", "fine_int_cutoff")


#: Options added from outside: the default and how a text is read, by name.
OPTIONS: dict[str, tuple[object, Callable[[str], object]]] = {}


def register_option(name: str, default: object, read: Callable[[str], object] = str) -> None:
    """Add an option ``--name`` (and a key of ini files), which steps read by ``config.option(name)``."""
    if name in {*_NAMES, *_FLAGS, "ini-file"} or name.replace("-", "_") in {f.name for f in fields(RunConfig)}:
        raise ValueError(f"there is an option {name} already")
    OPTIONS[name] = (default, read)


@dataclass(frozen=True)
class RunConfig:
    """Lengths are in ``user_units``; the defaults are the usual ones in metres."""

    las: tuple[str, ...] = ()
    dem: tuple[str, ...] = ()
    output: str = ""
    name: str = ""
    las_crs: str = ""
    dem_crs: str = ""
    out_crs: str = ""
    las_units: str = ""
    dem_units: str = ""
    user_units: str = "metre"
    alignment: str = ""
    cellsize: float = 30.0
    xres: float | None = None
    yres: float | None = None
    xorigin: float = 0.0
    yorigin: float = 0.0
    csm_cellsize: float = 1.0
    footprint: float = 0.4
    smooth: int = 3
    csm_fill: bool = True
    fill_needed: int = 6
    fill_distance: float = 5.0
    csm_metrics: bool = True
    classes: str = "~7,9,18"
    use_withheld: bool = False
    max_scan_angle: float = 90.0
    min_ht: float = -8.0
    max_ht: float = 100.0
    canopy: float = 2.0
    strata: tuple[float, ...] = STRATA
    advanced: bool = False
    all_returns: bool = True
    first_returns: bool = True
    do_strata: bool = True
    do_points: bool = True
    do_csm: bool = True
    do_tao: bool = True
    do_topo: bool = True
    do_fine_int: bool = False
    min_tao_ht: float | None = None
    min_tao_dist: float = 0.0
    id_algo: str = "highpoint"
    seg_algo: str = "watershed"
    dem_algo: str = "raster"
    csm_algo: str = "max"
    post_algo: str = ""
    rasters: bool = False
    vectors: bool = False
    bench: bool = False
    topo_scale: tuple[float, ...] = (500.0, 1000.0, 2000.0)
    radians: bool = False
    fine_int_cellsize: float | None = None
    fine_int_cutoff: float | None = None
    fine_int_no_cutoff: bool = False
    added: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.smooth > 1 and self.smooth % 2 == 0:
            raise ValueError("smooth is an odd number of cells")
        if self.min_ht > self.max_ht:
            raise ValueError("minht exceeds maxht")
        LinearUnit.named(self.user_units)
        object.__setattr__(self, "strata", tuple(sorted(set(self.strata))))
        object.__setattr__(self, "topo_scale", tuple(sorted(set(self.topo_scale))))

    def option(self, name: str) -> object:
        """The value of an option added from outside, or its default."""
        default, read = OPTIONS[name]
        said = dict(self.added)
        return read(said[name]) if name in said else default

    @property
    def with_taos(self) -> bool:
        """Trees need the surface."""
        return self.do_tao and self.do_csm

    @property
    def tao_height(self) -> float:
        return self.canopy if self.min_tao_ht is None else self.min_tao_ht

    @property
    def return_types(self) -> tuple[str, ...]:
        return tuple(n for n, on in (("ALL", self.all_returns), ("FIRST", self.first_returns)) if on)

    def point_filter(self) -> PointFilter:
        return PointFilter(self.classes, self.use_withheld, self.max_scan_angle)

    def in_units(self, name: str) -> RunConfig:
        """The same lengths in another unit."""
        k = LinearUnit.named(self.user_units).factor_to(LinearUnit.named(name))
        new = {f: v * k for f in PLANE + HEIGHTS if (v := getattr(self, f)) is not None}
        return replace(self, user_units=name, strata=tuple(s * k for s in self.strata), topo_scale=tuple(s * k for s in self.topo_scale), **new)

    def on_plane(self, unit: LinearUnit) -> RunConfig:
        """The lengths in the plane in the unit of its coordinates; heights and ``user_units`` stay."""
        k = LinearUnit.named(self.user_units).factor_to(unit)
        if k == 1.0:
            return self
        new = {f: v * k for f in PLANE if (v := getattr(self, f)) is not None}
        return replace(self, topo_scale=tuple(s * k for s in self.topo_scale), **new)

    def unit_label(self, column: str) -> str:
        """What a layer's name says of its unit: the user's unit for heights, Percent, Degrees or Radians, else nothing."""
        if re.search(r"CanopyHeight$|^(Max|Mean|StdDev)CSM$|^(value|height|max_height|top|mean)$", column):
            return LinearUnit.named(self.user_units).suffix
        if column in ("CanopyCover", "CoverAboveMean", "cover", "pct"):
            return "Percent"
        return ("Radians" if self.radians else "Degrees") if column in ("Slope", "Aspect") else ""

    def file_name(self, base: str, unit: LinearUnit | str | None = None, extension: str = "tif") -> str:
        """``{name_}{base}{_Units}.{extension}``"""
        label = unit.suffix if isinstance(unit, LinearUnit) else unit or ""
        parts = [p for p in (self.name, base, label) if p]
        return "_".join(parts) + f".{extension}"

    def to_ini(self, *categories: str) -> str:
        """The options as an ini file, a section for each category: all of ``data``, ``process`` and ``computer``, or those named."""
        ini = configparser.ConfigParser()
        for category in categories or CATEGORIES:
            ini[category] = {f.name: _text(v) for f in fields(self) if f.name != "added" and category_of(f.name) == category and (v := getattr(self, f.name)) is not None}
            if category == "process":
                ini[category].update(dict(self.added))
        out = io.StringIO()
        ini.write(out)
        return out.getvalue()


CATEGORIES = ("data", "process", "computer")


def category_of(name: str) -> str:
    """What an option is about: the files of a run, the machine, or what is done."""
    if name in ("las", "dem", "output", "name", "las_crs", "dem_crs", "las_units", "dem_units"):
        return "data"
    return "computer" if name == "bench" else "process"


def _text(v) -> str:
    return ",".join(map(str, v)) if isinstance(v, tuple) else str(v)


# Command-line names that differ from the fields': value or flag.
_FLAGS = {
    "use-withheld": ("use_withheld", True), "adv-point": ("advanced", True), "skip-all-returns": ("all_returns", False),
    "skip-first-returns": ("first_returns", False), "skip-strata": ("do_strata", False), "skip-point-metrics": ("do_points", False),
    "skip-csm": ("do_csm", False), "skip-tao": ("do_tao", False), "skip-topo": ("do_topo", False), "fine-int": ("do_fine_int", True),
    "no-csm-fill": ("csm_fill", False), "skip-csm-metrics": ("csm_metrics", False), "fine-int-no-cutoff": ("fine_int_no_cutoff", True), "radians": ("radians", True), "rasters": ("rasters", True), "vectors": ("vectors", True), "bench": ("bench", True),
}
_NAMES = {"minht": "min_ht", "maxht": "max_ht", "class": "classes"}


def _convert(name: str, text: str):
    kind = {f.name: f for f in fields(RunConfig)}[name]
    default = kind.default
    if isinstance(default, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        parts = [p.strip() for p in text.split(",") if p.strip()]
        return tuple(parts) if name in ("las", "dem") else tuple(map(float, parts))
    if isinstance(default, int):
        return int(text)
    return float(text) if isinstance(default, float) or default is None else text


def parse_ini(text: str) -> dict:
    ini = configparser.ConfigParser(allow_no_value=True)
    ini.read_string(text if re.search(r"^\s*\[", text, re.M) else "[run]\n" + text)
    out = {}
    for section in ini.sections():
        for key, value in ini[section].items():
            if key in _FLAGS and value is None:
                out.setdefault(*_FLAGS[key])
                continue
            if key in OPTIONS:
                out.setdefault("added", {}).setdefault(key, value or "")
                continue
            field = _NAMES.get(key, key.replace("-", "_"))
            if field in {f.name for f in fields(RunConfig)} - {"added"}:
                out.setdefault(field, _convert(field, value or ""))
    return out


def parse_args(args: list[str]) -> RunConfig:
    """Command line first, then the ini files in their order: the first to say something wins.

    Units come before lengths: those not stated keep their metric default, converted.
    """
    parser = argparse.ArgumentParser(prog="gridcanopy", allow_abbrev=False)
    parser.add_argument("--ini-file", action="append", default=[])
    for flag, (field, value) in _FLAGS.items():
        parser.add_argument(f"--{flag}", dest=field, action="store_const", const=value, default=None)
    seen = {field for field, _ in _FLAGS.values()}
    for f in fields(RunConfig):
        if f.name not in seen | {"added"}:
            option = next((k for k, v in _NAMES.items() if v == f.name), f.name.replace("_", "-"))
            many = {"action": "append"} if f.name in ("las", "dem") else {}
            parser.add_argument(f"--{option}", dest=f.name, default=None, **many)
    for name in OPTIONS:
        parser.add_argument(f"--{name}", dest=f"added {name}", default=None)
    got = vars(parser.parse_args(args))
    said = {}
    added = {name: value for name in OPTIONS if (value := got.pop(f"added {name}")) is not None}
    for name, value in got.items():
        if name != "ini_file" and value is not None:
            said[name] = value if isinstance(value, bool) else tuple(value) if isinstance(value, list) else _convert(name, value)
    for path in got["ini_file"]:
        with open(path) as f:
            for k, v in parse_ini(f.read()).items():
                if k == "added":
                    added = v | added
                else:
                    said.setdefault(k, v)
    said["added"] = tuple(sorted(added.items()))
    base = RunConfig().in_units(said.get("user_units", "metre"))
    return replace(base, **said)
