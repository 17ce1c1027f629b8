"""Coordinate systems: text read as a tree, what it defines, and projections as columns.

``Crs.parse`` takes a code, ``EPSG:code+vertical``, a PROJ string, WKT of either generation, or the text of a
``.prj`` file.  WKT is read into nested nodes; the horizontal and the vertical system are parts of a compound
one, each with its own unit and code, so neither is taken for the other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .units import LinearUnit

# Semi-major axis and inverse flattening.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "clrk66": (6378206.4, 294.978698213898),
    "intl": (6378388.0, 297.0),
    "bessel": (6377397.155, 299.1528128),
    "airy": (6377563.396, 299.3249646),
}
# Geographic systems by code, and the ellipsoid of each.
GEOGRAPHIC = {
    4326: ("WGS 84", "WGS84"),
    4269: ("NAD83", "GRS80"),
    4152: ("NAD83(HARN)", "GRS80"),
    4759: ("NAD83(NSRS2007)", "GRS80"),
    6318: ("NAD83(2011)", "GRS80"),
    4258: ("ETRS89", "GRS80"),
    4267: ("NAD27", "clrk66"),
}
# Codes of UTM zones as (first zone, last zone, code of zone 0, north, geographic system).
UTM = (
    (1, 60, 32600, True, 4326),
    (1, 60, 32700, False, 4326),
    (1, 23, 26900, True, 4269),
    (1, 22, 26700, True, 4267),
    (10, 19, 3730, True, 4152),
    (1, 19, 3708, True, 4759),
    (1, 19, 6329, True, 6318),
    (28, 38, 25800, True, 4258),
)
# State planes as method, latitude and longitude of origin, two parallels or the scale, false
# easting and northing in metres; then codes as (code, geographic system, unit).  Angles are (degrees, minutes).
STATE_PLANES = {
    "Washington North": ("lcc", (47, 0), (-120, 50), (48, 44), (47, 30), 500000, 0, ((32148, 4269, "metre"), (2285, 4269, "us survey foot"), (2855, 4152, "metre"), (2926, 4152, "us survey foot"), (6596, 6318, "metre"), (6597, 6318, "us survey foot"))),
    "Washington South": ("lcc", (45, 20), (-120, 30), (47, 20), (45, 50), 500000, 0, ((32149, 4269, "metre"), (2286, 4269, "us survey foot"), (2856, 4152, "metre"), (2927, 4152, "us survey foot"), (6598, 6318, "metre"), (6599, 6318, "us survey foot"))),
    "Oregon North": ("lcc", (43, 40), (-120, 30), (46, 0), (44, 20), 2500000, 0, ((32126, 4269, "metre"), (2269, 4269, "foot"), (2838, 4152, "metre"), (2913, 4152, "foot"))),
    "Oregon South": ("lcc", (41, 40), (-120, 30), (44, 0), (42, 20), 1500000, 0, ((32127, 4269, "metre"), (2270, 4269, "foot"), (2839, 4152, "metre"), (2914, 4152, "foot"))),
    "California 1": ("lcc", (39, 20), (-122, 0), (41, 40), (40, 0), 2000000, 500000, ((26941, 4269, "metre"), (2225, 4269, "us survey foot"), (2766, 4152, "metre"), (2870, 4152, "us survey foot"), (6414, 6318, "metre"), (6415, 6318, "us survey foot"))),
    "California 2": ("lcc", (37, 40), (-122, 0), (39, 50), (38, 20), 2000000, 500000, ((26942, 4269, "metre"), (2226, 4269, "us survey foot"), (2767, 4152, "metre"), (2871, 4152, "us survey foot"), (6416, 6318, "metre"), (6417, 6318, "us survey foot"))),
    "California 3": ("lcc", (36, 30), (-120, 30), (38, 26), (37, 4), 2000000, 500000, ((26943, 4269, "metre"), (2227, 4269, "us survey foot"), (2768, 4152, "metre"), (2872, 4152, "us survey foot"), (6418, 6318, "metre"), (6419, 6318, "us survey foot"))),
    "California 4": ("lcc", (35, 20), (-119, 0), (37, 15), (36, 0), 2000000, 500000, ((26944, 4269, "metre"), (2228, 4269, "us survey foot"), (2769, 4152, "metre"), (2873, 4152, "us survey foot"), (6420, 6318, "metre"), (6421, 6318, "us survey foot"))),
    "California 5": ("lcc", (33, 30), (-118, 0), (35, 28), (34, 2), 2000000, 500000, ((26945, 4269, "metre"), (2229, 4269, "us survey foot"), (2770, 4152, "metre"), (2874, 4152, "us survey foot"), (6422, 6318, "metre"), (6423, 6318, "us survey foot"))),
    "California 6": ("lcc", (32, 10), (-116, 15), (33, 53), (32, 47), 2000000, 500000, ((26946, 4269, "metre"), (2230, 4269, "us survey foot"), (2771, 4152, "metre"), (2875, 4152, "us survey foot"), (6424, 6318, "metre"), (6425, 6318, "us survey foot"))),
    "Colorado North": ("lcc", (39, 20), (-105, 30), (40, 47), (39, 43), 914401.8289, 304800.6096, ((26953, 4269, "metre"), (2231, 4269, "us survey foot"))),
    "Colorado Central": ("lcc", (37, 50), (-105, 30), (39, 45), (38, 27), 914401.8289, 304800.6096, ((26954, 4269, "metre"), (2232, 4269, "us survey foot"))),
    "Colorado South": ("lcc", (36, 40), (-105, 30), (38, 26), (37, 14), 914401.8289, 304800.6096, ((26955, 4269, "metre"), (2233, 4269, "us survey foot"))),
    "Montana": ("lcc", (44, 15), (-109, 30), (49, 0), (45, 0), 600000, 0, ((32100, 4269, "metre"), (2256, 4269, "foot"))),
    "Idaho East": ("tmerc", (41, 40), (-112, 10), 1 - 1 / 19000, None, 200000, 0, ((26968, 4269, "metre"), (2241, 4269, "us survey foot"))),
    "Idaho Central": ("tmerc", (41, 40), (-114, 0), 1 - 1 / 19000, None, 500000, 0, ((26969, 4269, "metre"), (2242, 4269, "us survey foot"))),
    "Idaho West": ("tmerc", (41, 40), (-115, 45), 1 - 1 / 15000, None, 800000, 0, ((26970, 4269, "metre"), (2243, 4269, "us survey foot"))),
    "Arizona East": ("tmerc", (31, 0), (-110, 10), 0.9999, None, 213360, 0, ((26948, 4269, "metre"),)),
    "Arizona Central": ("tmerc", (31, 0), (-111, 55), 0.9999, None, 213360, 0, ((26949, 4269, "metre"),)),
    "Arizona West": ("tmerc", (31, 0), (-113, 45), 1 - 1 / 15000, None, 213360, 0, ((26950, 4269, "metre"),)),
    "Conus Albers": ("aea", (23, 0), (-96, 0), (29, 30), (45, 30), 0, 0, ((5070, 4269, "metre"), (6350, 6318, "metre"))),
}
# Units of heights by code of the vertical system, and units by code.
VERTICAL = {5703: "metre", 6360: "us survey foot", 8228: "foot", 5702: "us survey foot", 5773: "metre", 3855: "metre", 5714: "metre"}
UNIT_CODES = {9001: "metre", 9002: "foot", 9003: "us survey foot", 9036: "kilometre", 9093: "mile"}
# Names of methods and parameters in texts, without case, blanks and signs.
METHODS = {
    "transversemercator": "tmerc", "gausskruger": "tmerc", "lambertconformalconic": "lcc", "lambertconformalconic2sp": "lcc", "lambertconicconformal2sp": "lcc",
    "lambertconformalconic1sp": "lcc", "lambertconicconformal1sp": "lcc", "albersconicequalarea": "aea", "albersequalarea": "aea", "albers": "aea",
}
PARAMETERS = {
    "latitudeoforigin": "lat0", "latitudeofnaturalorigin": "lat0", "latitudeoffalseorigin": "lat0", "latitudeofcenter": "lat0",
    "centralmeridian": "lon0", "longitudeofnaturalorigin": "lon0", "longitudeoffalseorigin": "lon0", "longitudeofcenter": "lon0",
    "standardparallel1": "lat1", "latitudeof1ststandardparallel": "lat1", "standardparallel2": "lat2", "latitudeof2ndstandardparallel": "lat2",
    "scalefactor": "k", "scalefactoratnaturalorigin": "k",
    "falseeasting": "x0", "eastingatfalseorigin": "x0", "falsenorthing": "y0", "northingatfalseorigin": "y0",
}
#: Differences of angles (degrees), lengths (metres) and of factors up to which systems are one.
NEAR_DEGREES, NEAR_METRES, NEAR_FACTOR = 1e-7, 1e-3, 1e-6


# Text as a tree ------------------------------------------------------------------------------------
@dataclass
class Node:
    """A keyword with its texts and numbers in order, and the nodes within it."""

    keyword: str
    values: list[str | float] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)

    def first(self, *keywords: str) -> Node | None:
        """The first node directly within that has one of the keywords, in their order."""
        return next((n for k in keywords for n in self.nodes if n.keyword == k), None)

    def below(self, *keywords: str) -> Iterator[Node]:
        for n in self.nodes:
            if n.keyword in keywords:
                yield n
            yield from n.below(*keywords)

    @property
    def name(self) -> str:
        return str(self.values[0]) if self.values else ""


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_]*)\s*[\[(]|([\])])|([^\s,\[\]()"]+)|,)')


def read_tree(text: str) -> Node:
    """The tree of a WKT: ``KEYWORD[value, KEYWORD[...]]``, brackets of either kind, doubled quotes for a quote."""
    stack: list[Node] = [Node("")]
    at = 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no coordinate system: {text[at : at + 40]!r} cannot be read")
        at = m.end()
        quoted, keyword, close, bare = m.groups()
        if keyword:
            node = Node(keyword.upper())
            stack[-1].nodes.append(node)
            stack.append(node)
        elif close:
            if len(stack) == 1:
                raise ValueError("no coordinate system: a bracket too many")
            stack.pop()
        elif quoted is not None:
            stack[-1].values.append(quoted.replace('""', '"'))
        elif bare:
            try:
                stack[-1].values.append(float(bare))
            except ValueError:
                stack[-1].values.append(bare)
    if len(stack) != 1 or len(stack[0].nodes) != 1:
        raise ValueError("no coordinate system: brackets do not match")
    return stack[0].nodes[0]


def _code(node: Node) -> int:
    """The EPSG code of this node itself, 0 if it has none."""
    for n in node.nodes:
        if n.keyword in ("AUTHORITY", "ID") and len(n.values) > 1 and str(n.values[0]).upper() == "EPSG":
            return int(float(n.values[1]))
    return 0


def _bare(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def unit_of(name: str, metres: float) -> LinearUnit:
    """The known unit of that factor, else one of that name."""
    for known in ("metre", "foot", "us survey foot", "kilometre", "yard", "mile"):
        u = LinearUnit.named(known)
        if abs(u.metres - metres) < 1e-9 * metres:
            return u
    return LinearUnit(name.lower(), metres)


def _length_unit(node: Node) -> LinearUnit:
    """The unit of a system's axes: its own, else that of its first axis."""
    own = node.first("LENGTHUNIT", "UNIT")
    if own is None:
        axis = node.first("AXIS")
        own = axis.first("LENGTHUNIT", "UNIT") if axis else None
    return unit_of(own.name, float(own.values[1])) if own and len(own.values) > 1 else LinearUnit()


# Systems -------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Projection:
    """A method with its parameters: angles in degrees from Greenwich, false origin in metres."""

    method: str = "longlat"
    ellipsoid: tuple[float, float] = ELLIPSOIDS["WGS84"]
    lat0: float = 0.0
    lon0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    k: float = 1.0
    x0: float = 0.0
    y0: float = 0.0

    def near(self, other: Projection) -> bool:
        angles = all(abs(getattr(self, n) - getattr(other, n)) <= NEAR_DEGREES for n in ("lat0", "lon0"))
        parallels = all(abs(p - q) <= NEAR_DEGREES for p, q in zip(sorted((self.lat1, self.lat2)), sorted((other.lat1, other.lat2))))
        lengths = all(abs(getattr(self, n) - getattr(other, n)) <= NEAR_METRES for n in ("x0", "y0"))
        round_ = abs(self.ellipsoid[0] - other.ellipsoid[0]) <= NEAR_METRES and abs(self.ellipsoid[1] - other.ellipsoid[1]) <= 1e-4
        return self.method == other.method and angles and parallels and lengths and round_ and abs(self.k - other.k) <= 1e-9


@dataclass(frozen=True)
class Crs:
    """A horizontal system, the unit of its coordinates and that of heights.

    ``epsg`` is the horizontal code, 0 if unknown; ``vertical`` that of heights.  ``projection`` is None where
    nothing is known.  ``datum`` is the bare name of the geographic system.
    """

    epsg: int = 0
    z_unit: LinearUnit = LinearUnit()
    projection: Projection | None = None
    unit: LinearUnit = LinearUnit()
    datum: str = ""
    vertical: int = 0

    def __post_init__(self):
        if self.epsg and self.projection is None:
            known = _by_code(self.epsg)
            if known:
                for name in ("projection", "unit", "datum"):
                    object.__setattr__(self, name, getattr(known, name))

    @classmethod
    def parse(cls, text: str | int | None, z_unit: LinearUnit | None = None) -> Crs:
        """A code, ``EPSG:code``, ``EPSG:code+vertical``, a PROJ string, WKT or the text of a ``.prj`` file.

        The unit of heights is ``z_unit`` if that is known, else what the vertical system says, else that of
        projected coordinates, else unknown.  A text that defines nothing known raises ValueError.
        """
        said = z_unit if z_unit is not None and z_unit.metres else None
        if text in (None, "", 0, "0"):
            return cls(0, said or LinearUnit())
        text = str(text).strip()
        if m := re.fullmatch(r"(?:EPSG:)?(\d+)(?:\+(?:EPSG:)?(\d+|Unknown))?", text, re.I):
            vertical = int(m[2]) if m[2] and m[2].isdigit() else 0
            out = replace(_by_code(int(m[1])) or cls(int(m[1])), vertical=vertical)
            own = LinearUnit.named(VERTICAL.get(vertical)) if vertical else out.unit
        elif text.startswith("+"):
            out = _from_proj(text)
            own = out.z_unit if out.z_unit.metres else out.unit
        else:
            out = _from_tree(read_tree(text))
            own = out.z_unit if out.z_unit.metres or out.vertical else out.xy_unit
        return replace(out, z_unit=said or own)

    @property
    def known(self) -> bool:
        return bool(self.epsg or self.projection)

    @property
    def zone(self) -> tuple[int, bool] | None:
        """UTM zone and whether it is north."""
        p = self.projection
        if p is None or p.method != "tmerc" or abs(p.k - 0.9996) > 1e-9 or p.lat0 or p.x0 != 500000 or p.y0 not in (0, 1e7):
            return None
        zone = (p.lon0 + 183) / 6
        return (round(zone), p.y0 == 0) if abs(zone - round(zone)) < 1e-9 else None

    @property
    def geographic(self) -> bool:
        return self.projection is not None and self.projection.method == "longlat"

    @property
    def projected(self) -> bool:
        """Whether coordinates are lengths; true where nothing is known."""
        return not self.geographic

    @property
    def xy_unit(self) -> LinearUnit:
        return LinearUnit() if self.geographic else self.unit

    @property
    def ellipsoid(self) -> tuple[float, float]:
        return self.projection.ellipsoid if self.projection else ELLIPSOIDS["WGS84"]

    def same_place(self, other: Crs) -> bool:
        """Whether horizontal coordinates mean the same, within the tolerances; an unknown system agrees with all."""
        if not self.known or not other.known:
            return True
        if self.projection is None or other.projection is None:
            return self.epsg == other.epsg
        units = self.geographic or abs((self.unit.metres or 1) - (other.unit.metres or 1)) <= NEAR_FACTOR * (self.unit.metres or 1)
        datums = not self.datum or not other.datum or self.datum == other.datum
        return self.projection.near(other.projection) and units and datums

    def consistent(self, other: Crs) -> bool:
        return self.same_place(other) and self.z_unit.consistent(other.z_unit)

    @property
    def key(self) -> str:
        """Equal for systems that differ by less than the tolerances: parameters rounded to them, and units.

        A system known by a code alone has that code.
        """
        p = self.projection
        if p is None:
            place = f"code {self.epsg}" if self.epsg else ""
        else:
            angles = [_rounded(v, NEAR_DEGREES) for v in (p.lat0, p.lon0, *sorted((p.lat1, p.lat2)))]
            numbers = [*angles, _rounded(p.k, 1e-9), _rounded(p.x0, NEAR_METRES), _rounded(p.y0, NEAR_METRES), _rounded(p.ellipsoid[0], NEAR_METRES), _rounded(p.ellipsoid[1], 1e-4)]
            unit = "" if self.geographic else _rounded(self.unit.metres or 1, 1e-6)
            place = " ".join([p.method, self.datum, *numbers, unit]).strip()
        return f"{place} | {_rounded(self.z_unit.metres, 1e-4) if self.z_unit.metres else ''}"

    def to_wkt(self) -> str:
        """The system as WKT of the first generation, with its vertical part if it has one."""
        p = self.projection
        if p is None:
            return ""
        quote = lambda s: '"' + s.replace('"', '""') + '"'
        name = next((n for n, _ in GEOGRAPHIC.values() if _bare(n) == self.datum), self.datum or "unknown")
        ident = lambda code: f',AUTHORITY["EPSG","{code}"]' if code else ""
        base = next((c for c, (n, _) in GEOGRAPHIC.items() if _bare(n) == self.datum), 0)
        geo = f'GEOGCS[{quote(name)},DATUM[{quote(name)},SPHEROID["ellipsoid",{p.ellipsoid[0]!r},{p.ellipsoid[1]!r}]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]{ident(base)}]'
        out = geo
        if p.method != "longlat":
            one = {"tmerc": "Transverse_Mercator", "lcc": "Lambert_Conformal_Conic_2SP", "aea": "Albers_Conic_Equal_Area"}[p.method]
            unit = self.unit.metres or 1.0
            values = {"latitude_of_center" if p.method == "aea" else "latitude_of_origin": p.lat0, "longitude_of_center" if p.method == "aea" else "central_meridian": p.lon0}
            values |= {"scale_factor": p.k} if p.method == "tmerc" else {"standard_parallel_1": p.lat1, "standard_parallel_2": p.lat2}
            values |= {"scale_factor": p.k} if p.method == "lcc" and p.k != 1 else {}
            values |= {"false_easting": p.x0 / unit, "false_northing": p.y0 / unit}
            listed = "".join(f',PARAMETER["{k}",{v!r}]' for k, v in values.items())
            out = f'PROJCS["{self.epsg or "projected"}",{geo},PROJECTION["{one}"]{listed},UNIT[{quote(self.unit.name)},{unit!r}]{ident(self.epsg)}]'
        if self.z_unit.metres and (self.vertical or not self.z_unit.consistent(self.xy_unit) or self.geographic):
            up = f'VERT_CS["heights",VERT_DATUM["heights",2005],UNIT[{quote(self.z_unit.name)},{self.z_unit.metres!r}]{ident(self.vertical)}]'
            out = f'COMPD_CS["compound",{out},{up}]'
        return out

    def transform(self, to: Crs, x: Column, y: Column) -> tuple[Column, Column]:
        """Columns of the coordinates in ``to``; the same columns if nothing changes.

        Geographic systems of different datums are taken for one (they lie within metres).  A code that no
        table here has raises ValueError; its WKT or PROJ string defines it.
        """
        if not self.known or not to.known or self.same_place(to):
            return x, y
        for crs in (self, to):
            if crs.projection is None:
                raise ValueError(f"EPSG {crs.epsg} is not in the tables; give the system as WKT or PROJ string")
        if not self.geographic:
            unit = self.unit.metres or 1.0
            lon, lat = INVERSE[self.projection.method](self.projection, *(v if unit == 1.0 else v * F.lit(unit) for v in (x, y)))
        else:
            lon, lat = x, y
        if to.geographic:
            return lon, lat
        east, north = FORWARD[to.projection.method](to.projection, lon, lat)
        unit = to.unit.metres or 1.0
        return (east, north) if unit == 1.0 else (east / F.lit(unit), north / F.lit(unit))


def _rounded(v: float, step: float) -> str:
    return str(round(v / step))


def _degrees(angle) -> float:
    whole, minutes = angle
    return whole + math.copysign(minutes / 60, whole)


def _by_code(code: int) -> Crs | None:
    """The system of a code in the tables, None if they lack it."""
    if code in GEOGRAPHIC:
        name, shape = GEOGRAPHIC[code]
        return Crs(code, LinearUnit(), Projection(ellipsoid=ELLIPSOIDS[shape]), LinearUnit(), _bare(name))
    for first, last, base, north, geographic in UTM:
        if base + first <= code <= base + last:
            name, shape = GEOGRAPHIC[geographic]
            p = Projection("tmerc", ELLIPSOIDS[shape], lon0=6.0 * (code - base) - 183, k=0.9996, x0=500000.0, y0=0.0 if north else 1e7)
            return Crs(code, LinearUnit(), p, LinearUnit.named("metre"), _bare(name))
    for method, lat0, lon0, one, two, x0, y0, codes in STATE_PLANES.values():
        for own, geographic, unit in codes:
            if own == code:
                name, shape = GEOGRAPHIC[geographic]
                shape_of = {"k": one} if method == "tmerc" else {"lat1": _degrees(one), "lat2": _degrees(two)}
                p = Projection(method, ELLIPSOIDS[shape], _degrees(lat0), _degrees(lon0), x0=float(x0), y0=float(y0), **shape_of)
                return Crs(code, LinearUnit(), p, LinearUnit.named(unit), _bare(name))
    return None


def _from_proj(text: str) -> Crs:
    """A system from ``+name=value`` parts: longlat, utm, tmerc, lcc and aea."""
    said = {k: v for k, _, v in (part.partition("=") for part in re.findall(r"\+([^\s+]+)", text))}
    number = lambda name, default=0.0: float(said.get(name, default))
    datum = {"WGS84": 4326, "NAD83": 4269, "NAD27": 4267}.get(said.get("datum", ""), 4326 if "ellps" not in said and "a" not in said else 0)
    name, shape = GEOGRAPHIC.get(datum, ("", said.get("ellps", "WGS84")))
    if shape not in ELLIPSOIDS and "a" not in said:
        raise ValueError(f"no coordinate system: the ellipsoid {shape} is not known")
    ellipsoid = (number("a"), number("rf", 298.257223563)) if "a" in said else ELLIPSOIDS[shape]
    heights = {"m": "metre", "us-ft": "us survey foot", "ft": "foot"}
    up = LinearUnit.named(heights.get(said.get("vunits", "")))
    kind = said.get("proj", "")
    if kind in ("longlat", "latlong"):
        epsg = datum
        return Crs(epsg, up, Projection(ellipsoid=ellipsoid), LinearUnit(), _bare(name))
    unit = unit_of("", number("to_meter")) if "to_meter" in said else LinearUnit.named(heights.get(said.get("units", "m"), said.get("units", "m")))
    if kind == "utm":
        zone = int(said["zone"])
        epsg = next((base + zone for first, last, base, north, g in UTM if g == datum and first <= zone <= last and north != ("south" in said)), 0)
        p = Projection("tmerc", ellipsoid, lon0=6.0 * zone - 183, k=0.9996, x0=500000.0, y0=1e7 if "south" in said else 0.0)
        return Crs(epsg if unit.name == "metre" else 0, up, p, unit, _bare(name))
    if kind not in FORWARD:
        raise ValueError(f"no coordinate system: +proj={kind} is not supported")
    lat1 = number("lat_1", said.get("lat_0", 0.0)) if kind != "tmerc" else 0.0
    lat2 = number("lat_2", lat1) if kind != "tmerc" else 0.0
    k = number("k_0", said.get("k", 1.0))
    p = Projection(kind, ellipsoid, number("lat_0"), number("lon_0"), lat1, lat2, k, number("x_0"), number("y_0"))
    return Crs(0, up, p, unit, _bare(name))


# GeoTIFF keys of parameters, and methods by code.
GEO_PARAMETERS = {
    3078: "lat1", 3079: "lat2", 3080: "lon0", 3081: "lat0", 3082: "x0", 3083: "y0", 3084: "lon0", 3085: "lat0", 3086: "x0", 3087: "y0",
    3088: "lon0", 3089: "lat0", 3090: "x0", 3091: "y0", 3092: "k", 3093: "k",
}
GEO_METHODS = {1: "tmerc", 8: "lcc", 9: "lcc", 11: "aea"}


def geo_keys(directory: tuple[int, ...], doubles: tuple[float, ...] = (), texts: str = "") -> dict[int, int | float | str]:
    """GeoTIFF keys by number: a directory of (key, place, count, value) entries and the values it points to."""
    out: dict[int, int | float | str] = {}
    for k in range(4, len(directory) - 3, 4):
        key, place, count, value = directory[k : k + 4]
        if place == 0:
            out[key] = value
        elif place == 34736 and value < len(doubles):
            out[key] = doubles[value]
        elif place == 34737:
            out[key] = texts[value : value + count].rstrip("|\0")
    return out


def from_geo_keys(keys: dict[int, int | float | str], z_unit: LinearUnit | None = None) -> Crs:
    """The system that GeoTIFF keys define: by code, or by method and parameters where the code is the user's own."""
    code = lambda key: int(v) if isinstance(v := keys.get(key, 0), (int, float)) and v not in (0, 32767) else 0
    vertical = code(4096)
    up = LinearUnit.named(UNIT_CODES.get(code(4099)) or VERTICAL.get(vertical))
    size = keys.get(3077)
    unit = LinearUnit.named(UNIT_CODES.get(code(3076))) if code(3076) else unit_of("user", float(size)) if isinstance(size, float) else LinearUnit()
    base = _by_code(code(2048))
    if code(3072):
        out = Crs(code(3072), unit=unit)
    elif (method := GEO_METHODS.get(code(3075))) is not None:
        said: dict[str, float] = {}
        for key, name in GEO_PARAMETERS.items():
            if isinstance(v := keys.get(key), float):
                said.setdefault(name, v * (unit.metres or 1.0) if name in ("x0", "y0") else v)
        if method in ("lcc", "aea"):
            said.setdefault("lat1", said.get("lat0", 0.0))
            said.setdefault("lat2", said["lat1"])
        shape = base.ellipsoid if base else (keys[2057], keys.get(2059, 298.257223563)) if isinstance(keys.get(2057), float) else ELLIPSOIDS["GRS80"]
        out = Crs(0, LinearUnit(), Projection(method, tuple(shape), **said), unit, base.datum if base else "")
    else:
        out = base or Crs(code(2048))
    own = z_unit if z_unit is not None and z_unit.metres else up if up.metres else LinearUnit() if vertical else out.xy_unit
    return replace(out, z_unit=own, vertical=vertical)


def to_geo_keys(crs: Crs) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Directory and doubles of the GeoTIFF keys of a system: by code, or by parameters where it has none."""
    codes = {v: k for k, v in UNIT_CODES.items()}
    keys: list[tuple[int, int | float]] = [(1024, 2 if crs.geographic else 1), (1025, 1)]
    p = crs.projection
    base = next((c for c, (n, _) in GEOGRAPHIC.items() if p is not None and _bare(n) == crs.datum), 0)
    if crs.geographic:
        keys.append((2048, crs.epsg or base or 32767))
    elif crs.epsg or p is None:
        keys.append((3072, crs.epsg or 32767))
    else:
        conic = p.method != "tmerc"
        keys += [(2048, base or 32767), (3072, 32767), (3074, 32767), (3075, {"tmerc": 1, "lcc": 8, "aea": 11}[p.method])]
        if not base:
            keys += [(2057, p.ellipsoid[0]), (2059, p.ellipsoid[1])]
        unit = crs.unit.metres or 1.0
        keys += [(3076, codes[crs.unit.name])] if crs.unit.name in codes else [(3076, 32767), (3077, unit)]
        keys += [(3078, p.lat1), (3079, p.lat2)] if conic else [(3092, p.k)]
        keys += [(3084, p.lon0), (3085, p.lat0), (3086, p.x0 / unit), (3087, p.y0 / unit)] if p.method == "lcc" else [(3080, p.lon0), (3081, p.lat0), (3082, p.x0 / unit), (3083, p.y0 / unit)]
    if crs.vertical:
        keys.append((4096, crs.vertical))
    if crs.z_unit.name in codes:
        keys.append((4099, codes[crs.z_unit.name]))
    doubles: list[float] = []
    entries: list[int] = []
    for key, value in sorted(keys):
        if isinstance(value, float):
            entries += [key, 34736, 1, len(doubles)]
            doubles.append(value)
        else:
            entries += [key, 0, 1, int(value)]
    return (1, 1, 0, len(entries) // 4, *entries), tuple(doubles)


_HORIZONTAL = ("PROJCS", "PROJCRS", "PROJECTEDCRS", "GEOGCS", "GEOGCRS", "GEODCRS", "GEODETICCRS", "GEOGRAPHICCRS", "BOUNDCRS")
_UPRIGHT = ("VERT_CS", "VERTCRS", "VERTICALCRS", "VERTCS")


def _from_tree(node: Node) -> Crs:
    if node.keyword in ("COMPD_CS", "COMPOUNDCRS"):
        flat, up = node.first(*_HORIZONTAL), node.first(*_UPRIGHT)
        if flat is None:
            raise ValueError("no coordinate system: a compound one without a horizontal part")
        out = _from_tree(flat)
        if up is None:
            return out
        if up.keyword == "BOUNDCRS":
            up = _source(up)
        code = _code(up)
        unit = _length_unit(up)
        return replace(out, z_unit=unit if unit.metres else LinearUnit.named(VERTICAL.get(code)), vertical=code)
    if node.keyword == "BOUNDCRS":
        return _from_tree(_source(node))
    if node.keyword in ("PROJCS", "PROJCRS", "PROJECTEDCRS"):
        return _projected(node)
    if node.keyword in _HORIZONTAL:
        ellipsoid, datum, _ = _geographic(node)
        return Crs(_code(node), LinearUnit(), Projection(ellipsoid=ellipsoid), LinearUnit(), datum)
    raise ValueError(f"no coordinate system: {node.keyword} is not a horizontal or compound one")


def _source(node: Node) -> Node:
    inner = node.first("SOURCECRS")
    if inner is None or not inner.nodes:
        raise ValueError("no coordinate system: a bound one without a source")
    return inner.nodes[0]


def _geographic(node: Node) -> tuple[tuple[float, float], str, float]:
    """Ellipsoid, bare name of the geographic system and degrees in its angular unit."""
    shape = next(node.below("SPHEROID", "ELLIPSOID"), None)
    if shape is None or len(shape.values) < 3:
        raise ValueError("no coordinate system: a geographic one without an ellipsoid")
    prime = next(node.below("PRIMEM", "PRIMEMERIDIAN"), None)
    if prime is not None and len(prime.values) > 1 and float(prime.values[1]):
        raise ValueError(f"the prime meridian {prime.name} is not supported")
    code = _code(node)
    name = GEOGRAPHIC[code][0] if code in GEOGRAPHIC else node.name.removeprefix("GCS_")
    known = {"nad831983": "nad83", "northamerican1983": "nad83", "wgs1984": "wgs84", "northamerican1983harn": "nad83harn", "nad832011": "nad832011", "nad19832011": "nad832011", "nad19832011": "nad832011"}
    bare = _bare(name)
    angle = node.first("ANGLEUNIT", "UNIT")
    per = math.degrees(float(angle.values[1])) if angle and len(angle.values) > 1 else 1.0
    return (float(shape.values[1]), float(shape.values[2])), known.get(bare, bare), 1.0 if abs(per - 1) < 1e-9 else per


def _projected(node: Node) -> Crs:
    base = node.first("GEOGCS", "BASEGEOGCRS", "BASEGEODCRS", "GEOGCRS", "BASEGEODETICCRS")
    if base is None:
        known = _by_code(_code(node))
        if known is None:
            raise ValueError("no coordinate system: a projected one without a geographic base")
        return known
    ellipsoid, datum, per = _geographic(base)
    unit = _length_unit(node)
    conversion = node.first("CONVERSION") or node
    method = next((n for n in conversion.nodes if n.keyword in ("PROJECTION", "METHOD")), None)
    kind = METHODS.get(_bare(method.name)) if method else None
    code = _code(node)
    if kind is None:
        known = _by_code(code)
        if known is None:
            raise ValueError(f"the projection {method.name if method else '(none)'} is not supported")
        return known
    said: dict[str, float] = {}
    for p in conversion.nodes:
        if p.keyword == "PARAMETER" and len(p.values) > 1 and (short := PARAMETERS.get(_bare(p.name))):
            value, own = float(p.values[1]), p.first("LENGTHUNIT", "ANGLEUNIT", "SCALEUNIT", "UNIT")
            factor = float(own.values[1]) if own and len(own.values) > 1 else None
            if short in ("x0", "y0"):
                value *= factor if factor is not None else unit.metres or 1.0
            elif short != "k":
                value *= math.degrees(factor) if factor is not None else per
            said[short] = value
    if kind in ("lcc", "aea"):
        said.setdefault("lat1", said.get("lat0", 0.0))
        said.setdefault("lat2", said["lat1"])
    return Crs(code, unit, Projection(kind, ellipsoid, **said), unit, datum)


# Projections as columns ----------------------------------------------------------------------------
def _series(p: Projection):
    """Third flattening, rectifying radius, and coefficients of the Transverse Mercator series in it."""
    a, inverse = p.ellipsoid
    f = 1 / inverse if inverse else 0.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, alpha, beta, delta


def _atanh(v: Column) -> Column:
    return F.lit(0.5) * F.log((1 + v) / (1 - v))


def _turned(p: Projection, lon: Column) -> Column:
    """Longitude from the central meridian in radians, within half a turn."""
    d = F.radians(lon - p.lon0)
    return F.atan2(F.sin(d), F.cos(d))


def _origin_arc(p: Projection) -> float:
    """Rectified distance of the origin's latitude from the equator, over the scaled radius."""
    if not p.lat0:
        return 0.0
    n, _, alpha, _, _ = _series(p)
    c = 2 * math.sqrt(n) / (1 + n)
    s = math.sin(math.radians(p.lat0))
    xi = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
    return xi + sum(k * math.sin(2 * j * xi) for j, k in enumerate(alpha, 1))


def _tmerc_forward(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Transverse Mercator by the third-order series in n (millimetres within a zone)."""
    n, radius, alpha, _, _ = _series(p)
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(_atanh(s) - c * _atanh(c * s))
    lam = _turned(p, lon)
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, m = eta, xi
    for j, k in enumerate(alpha, 1):
        e = e + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        m = m + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return p.x0 + p.k * radius * e, p.y0 - p.k * radius * _origin_arc(p) + p.k * radius * m


def _tmerc_inverse(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    _, radius, _, beta, delta = _series(p)
    xi, eta = (y - (p.y0 - p.k * radius * _origin_arc(p))) / (p.k * radius), (x - p.x0) / (p.k * radius)
    m, e = xi, eta
    for j, k in enumerate(beta, 1):
        m = m - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(m) / F.cosh(e))
    lat = chi
    for j, k in enumerate(delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return p.lon0 + F.degrees(F.atan2(F.sinh(e), F.cos(m))), F.degrees(lat)


def _eccentricity(p: Projection) -> float:
    f = 1 / p.ellipsoid[1] if p.ellipsoid[1] else 0.0
    return math.sqrt(f * (2 - f))


def _lcc_constants(p: Projection) -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, scaled radius factor and radius at the origin."""
    e = _eccentricity(p)

    def m(lat):
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat):  # of the conformal latitude
        s = math.sin(lat)
        return math.exp(-(math.atanh(s) - e * math.atanh(e * s)))

    one, two, zero = (math.radians(v) for v in (p.lat1, p.lat2, p.lat0))
    cone = math.sin(one) if abs(one - two) < 1e-12 else math.log(m(one) / m(two)) / math.log(t(one) / t(two))
    scaled = p.k * p.ellipsoid[0] * m(one) / (cone * t(one) ** cone)
    return e, cone, scaled, scaled * t(zero) ** cone


def _lcc_forward(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert conformal conic with one or two standard parallels."""
    e, cone, scaled, origin = _lcc_constants(p)
    s = F.sin(F.radians(lat))
    radius = scaled * F.exp(-cone * (_atanh(s) - e * _atanh(e * s)))
    turn = cone * _turned(p, lon)
    return p.x0 + radius * F.sin(turn), p.y0 + origin - radius * F.cos(turn)


def _conformal_to_latitude(p: Projection, chi: Column) -> Column:
    """Latitude in radians of a conformal one, by a series in the squared eccentricity."""
    e2 = _eccentricity(p) ** 2
    c = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    out = chi
    for j, k in enumerate(c, 1):
        out = out + k * F.sin(2 * j * chi)
    return out


def _lcc_inverse(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    _, cone, scaled, origin = _lcc_constants(p)
    sign = math.copysign(1.0, cone)
    east, south = sign * (x - p.x0), sign * (origin - (y - p.y0))
    radius = sign * F.sqrt(east * east + south * south)
    t = F.pow(radius / scaled, F.lit(1 / cone))
    chi = math.pi / 2 - 2 * F.atan(t)
    return p.lon0 + F.degrees(F.atan2(east, south) / cone), F.degrees(_conformal_to_latitude(p, chi))


def _aea_constants(p: Projection) -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, its constant term and radius at the origin over the semi-major axis."""
    e = _eccentricity(p)

    def q(lat):
        s = math.sin(lat)
        return (1 - e * e) * (s / (1 - (e * s) ** 2) + (math.atanh(e * s) / e if e else s))

    def m2(lat):
        return math.cos(lat) ** 2 / (1 - (e * math.sin(lat)) ** 2)

    one, two, zero = (math.radians(v) for v in (p.lat1, p.lat2, p.lat0))
    cone = math.sin(one) if abs(one - two) < 1e-12 else (m2(one) - m2(two)) / (q(two) - q(one))
    c = m2(one) + cone * q(one)
    return e, cone, c, math.sqrt(c - cone * q(zero)) / cone


def _aea_forward(p: Projection, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Albers equal-area conic."""
    e, cone, c, origin = _aea_constants(p)
    a = p.ellipsoid[0]
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) + (_atanh(e * s) / e if e else s))
    radius = a * F.sqrt(c - cone * q) / cone
    turn = cone * _turned(p, lon)
    return p.x0 + radius * F.sin(turn), p.y0 + a * origin - radius * F.cos(turn)


def _aea_inverse(p: Projection, x: Column, y: Column) -> tuple[Column, Column]:
    e, cone, c, origin = _aea_constants(p)
    a, e2 = p.ellipsoid[0], e * e
    sign = math.copysign(1.0, cone)
    east, south = sign * (x - p.x0), sign * (a * origin - (y - p.y0))
    square = (east * east + south * south) * (cone / a) ** 2
    pole = 1 + ((1 - e2) * math.atanh(e) / e if e else 1.0)
    beta = F.asin((c - square) / cone / pole)
    k = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    lat = beta
    for j, v in enumerate(k, 1):
        lat = lat + v * F.sin(2 * j * beta)
    return p.lon0 + F.degrees(F.atan2(east, south) / cone), F.degrees(lat)


FORWARD = {"tmerc": _tmerc_forward, "lcc": _lcc_forward, "aea": _aea_forward}
INVERSE = {"tmerc": _tmerc_inverse, "lcc": _lcc_inverse, "aea": _aea_inverse}


# Systems of a table --------------------------------------------------------------------------------
PARSED = "crs_text string, epsg int, vertical int, method string, xy_unit string, xy_metres double, z_unit string, z_metres double, crs_key string, readable boolean"


def parsed_systems(texts: DataFrame, column: str) -> DataFrame:
    """What each distinct text of ``column`` defines, read on the executors: one row a text, with columns of ``PARSED``.

    Null and empty texts are unknown systems; one that cannot be read has ``readable`` false and no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.bool_()]
        names = [part.split()[0] for part in PARSED.split(", ")]
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                try:
                    c = Crs.parse(text)
                    method = c.projection.method if c.projection else None
                    rows.append((text, c.epsg or None, c.vertical or None, method, c.xy_unit.name, c.xy_unit.metres, c.z_unit.name, c.z_unit.metres, c.key, True))
                except (ValueError, KeyError, TypeError):
                    rows.append((text, *[None] * 8, False))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return texts.select(F.col(f"`{column}`").cast("string").alias("crs_text")).distinct().mapInArrow(run, PARSED)
