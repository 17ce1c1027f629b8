"""Extents, grids and the column expressions that move between coordinates and cells.

A grid's row 0 is its north edge and ``cell = row * ncol + col``.  Everything here is either plain
arithmetic on the driver (a handful of numbers) or a Spark column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-4
#: Cells of a grid for each task that lists them, and tasks at most.
CELLS_PER_TASK, MAX_TASKS = 1 << 20, 2000


@dataclass(frozen=True)
class Extent:
    """An axis-aligned rectangle with an optional EPSG code."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    epsg: int | None = None

    def __post_init__(self):
        if self.xmin > self.xmax or self.ymin > self.ymax:
            raise ValueError(f"empty extent {self}")

    def consistent(self, other: Extent) -> bool:
        """No stated system, or the same one."""
        return self.epsg is None or other.epsg is None or self.epsg == other.epsg

    def _check(self, other: Extent) -> None:
        if not self.consistent(other):
            raise ValueError(f"EPSG {self.epsg} and {other.epsg} differ")

    def contains(self, x: float, y: float) -> bool:
        return self.xmin <= x <= self.xmax and self.ymin <= y <= self.ymax

    def strictly_contains(self, x: float, y: float) -> bool:
        return self.xmin < x < self.xmax and self.ymin < y < self.ymax

    def overlaps(self, other: Extent) -> bool:
        """Shares an area."""
        self._check(other)
        return min(self.xmax, other.xmax) > max(self.xmin, other.xmin) and min(self.ymax, other.ymax) > max(self.ymin, other.ymin)

    def touches(self, other: Extent) -> bool:
        """Shares at least an edge or corner."""
        self._check(other)
        return min(self.xmax, other.xmax) >= max(self.xmin, other.xmin) and min(self.ymax, other.ymax) >= max(self.ymin, other.ymin)

    def crop(self, other: Extent) -> Extent:
        if not self.touches(other):
            raise ValueError("extents are apart")
        return replace(self, xmin=max(self.xmin, other.xmin), xmax=min(self.xmax, other.xmax), ymin=max(self.ymin, other.ymin), ymax=min(self.ymax, other.ymax))

    def union(self, other: Extent) -> Extent:
        self._check(other)
        return Extent(min(self.xmin, other.xmin), max(self.xmax, other.xmax), min(self.ymin, other.ymin), max(self.ymax, other.ymax), self.epsg or other.epsg)

    def buffer(self, size: float) -> Extent:
        """Grown on all sides; the system is dropped, as a buffer's unit is the caller's affair."""
        return Extent(self.xmin - size, self.xmax + size, self.ymin - size, self.ymax + size)

    def corners(self) -> list[tuple[float, float]]:
        return [(self.xmin, self.ymin), (self.xmin, self.ymax), (self.xmax, self.ymax), (self.xmax, self.ymin)]

    def inside(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        """Closed point-in-rectangle predicate; both comparisons push down to Parquet."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        return x.between(self.xmin, self.xmax) & y.between(self.ymin, self.ymax)


@dataclass(frozen=True)
class QuadExtent:
    """A convex quadrilateral, such as a rectangle seen in another system: corners in ring order."""

    corners: tuple[tuple[float, float], ...]
    epsg: int | None = None

    @classmethod
    def of(cls, extent: Extent, move=lambda x, y: (x, y), epsg: int | None = None) -> QuadExtent:
        return cls(tuple(move(x, y) for x, y in extent.corners()), epsg if epsg is not None else extent.epsg)

    def outer(self) -> Extent:
        xs, ys = zip(*self.corners)
        return Extent(min(xs), max(xs), min(ys), max(ys), self.epsg)

    def inner(self) -> Extent | None:
        """The rectangle between the middle coordinates, where it lies inside the quadrilateral."""
        xs, ys = (sorted(v) for v in zip(*self.corners))
        box = Extent(xs[1], xs[2], ys[1], ys[2], self.epsg)
        return box if all(self._side(x, y) for x, y in box.corners()) else None

    def _edges(self):
        return zip(self.corners, (*self.corners[1:], self.corners[0]))

    def _side(self, x: float, y: float) -> bool:
        s = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in self._edges()]
        return all(v >= 0 for v in s) or all(v <= 0 for v in s)

    def contains(self, x: float, y: float) -> bool:
        return self.outer().contains(x, y) and self._side(x, y)

    def inside(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        """The same test as a column: the outer box first, which prunes files, then four sides."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        sides = [(bx - ax) * (y - F.lit(ay)) - (by - ay) * (x - F.lit(ax)) for (ax, ay), (bx, by) in self._edges()]
        left, right = F.lit(True), F.lit(True)
        for s in sides:
            left, right = left & (s >= 0), right & (s <= 0)
        return self.outer().inside(x, y) & (left | right)

    def overlaps(self, other: QuadExtent) -> bool:
        """Separating axes over the edges of both."""
        for quad in (self, other):
            for (ax, ay), (bx, by) in quad._edges():
                nx, ny = ay - by, bx - ax
                a = [nx * x + ny * y for x, y in self.corners]
                b = [nx * x + ny * y for x, y in other.corners]
                if max(a) <= min(b) or max(b) <= min(a):
                    return False
        return True


@dataclass(frozen=True)
class Grid:
    """Cells of ``xres`` by ``yres`` over an extent."""

    extent: Extent
    nrow: int
    ncol: int

    @classmethod
    def from_resolution(cls, extent: Extent, xres: float, yres: float | None = None, xorigin: float = 0.0, yorigin: float = 0.0) -> Grid:
        """Grow outward to whole cells counted from the origin."""
        yres = xres if yres is None else yres
        if xres <= 0 or yres <= 0:
            raise ValueError("cells need a size")
        lo = lambda v, o, r: math.floor((v - o) / r + 1e-9) * r + o
        hi = lambda v, o, r: math.ceil((v - o) / r - 1e-9) * r + o
        xmin, ymin = lo(extent.xmin, xorigin, xres), lo(extent.ymin, yorigin, yres)
        xmax, ymax = max(hi(extent.xmax, xorigin, xres), xmin + xres), max(hi(extent.ymax, yorigin, yres), ymin + yres)
        return cls(Extent(xmin, xmax, ymin, ymax, extent.epsg), round((ymax - ymin) / yres), round((xmax - xmin) / xres))

    @property
    def xres(self) -> float:
        return (self.extent.xmax - self.extent.xmin) / self.ncol

    @property
    def yres(self) -> float:
        return (self.extent.ymax - self.extent.ymin) / self.nrow

    @property
    def ncell(self) -> int:
        return self.nrow * self.ncol

    @property
    def origin(self) -> tuple[float, float]:
        return self.extent.xmin % self.xres, self.extent.ymin % self.yres

    # scalars ---------------------------------------------------------------------------------
    def col_of(self, x: float) -> int:
        if not self.extent.xmin <= x <= self.extent.xmax:
            raise ValueError(f"x {x} is outside the grid")
        return min(int((x - self.extent.xmin) / self.xres), self.ncol - 1)

    def row_of(self, y: float) -> int:
        if not self.extent.ymin <= y <= self.extent.ymax:
            raise ValueError(f"y {y} is outside the grid")
        return min(int((self.extent.ymax - y) / self.yres), self.nrow - 1)

    def cell_of(self, x: float, y: float) -> int:
        return self.row_of(y) * self.ncol + self.col_of(x)

    def centre(self, cell: int) -> tuple[float, float]:
        row, col = divmod(cell, self.ncol)
        return self.extent.xmin + (col + 0.5) * self.xres, self.extent.ymax - (row + 0.5) * self.yres

    def cell_extent(self, cell: int) -> Extent:
        x, y = self.centre(cell)
        return Extent(x - self.xres / 2, x + self.xres / 2, y - self.yres / 2, y + self.yres / 2, self.extent.epsg)

    def snap(self, extent: Extent, how: str = "near") -> Extent:
        """Move the sides to cell borders: ``near``, ``out``, ``in`` or ``ll`` (all down and left)."""
        down = lambda v: math.floor(v + 1e-9)
        up = lambda v: math.ceil(v - 1e-9)
        near = lambda v: math.floor(v + 0.5)
        low, high = {"near": (near, near), "out": (down, up), "in": (up, down), "ll": (down, down)}[how]
        ox, oy = self.extent.xmin, self.extent.ymin
        x = lambda f, v: ox + f((v - ox) / self.xres) * self.xres
        y = lambda f, v: oy + f((v - oy) / self.yres) * self.yres
        return Extent(x(low, extent.xmin), x(high, extent.xmax), y(low, extent.ymin), y(high, extent.ymax), extent.epsg)

    def rows_cols(self, extent: Extent, how: str = "near") -> tuple[int, int, int, int]:
        """``(first row, last row, first col, last col)`` of the cells of a snapped, cropped extent."""
        e = self.snap(extent, how).crop(self.extent)
        dx, dy = self.xres / 10, self.yres / 10
        return self.row_of(e.ymax - dy), self.row_of(e.ymin + dy), self.col_of(e.xmin + dx), self.col_of(e.xmax - dx)

    def cells(self, extent: Extent, how: str = "near") -> list[int]:
        r0, r1, c0, c1 = self.rows_cols(extent, how)
        return [r * self.ncol + c for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]

    def crop(self, extent: Extent, how: str = "near") -> Grid:
        r0, r1, c0, c1 = self.rows_cols(extent, how)
        e, x, y = self.extent, self.xres, self.yres
        box = Extent(e.xmin + c0 * x, e.xmin + (c1 + 1) * x, e.ymax - (r1 + 1) * y, e.ymax - r0 * y, e.epsg)
        return Grid(box, r1 - r0 + 1, c1 - c0 + 1)

    def extend(self, extent: Extent, how: str = "out") -> Grid:
        e = self.snap(extent, how).union(self.extent)
        return Grid(e, round((e.ymax - e.ymin) / self.yres), round((e.xmax - e.xmin) / self.xres))

    def transform(self, move, epsg: int | None = None) -> Grid:
        """The same rows and columns over the outer box of the moved corners."""
        return Grid(QuadExtent.of(self.extent, move, epsg).outer(), self.nrow, self.ncol)

    def consistent(self, other: Grid) -> bool:
        """Same cell size, origin and system, to within 1e-4: cells of one are cells of the other."""
        wrap = lambda a, b, r: min(abs(a - b) % r, r - abs(a - b) % r) < EPSILON
        return (
            abs(self.xres - other.xres) < EPSILON
            and abs(self.yres - other.yres) < EPSILON
            and wrap(self.extent.xmin, other.extent.xmin, self.xres)
            and wrap(self.extent.ymin, other.extent.ymin, self.yres)
            and self.extent.consistent(other.extent)
        )

    def offset_to(self, other: Grid) -> tuple[int, int]:
        """Rows and columns to add to a cell of this grid to have it in ``other``."""
        if not self.consistent(other):
            raise ValueError("grids are not aligned")
        return round((other.extent.ymax - self.extent.ymax) / self.yres), round((self.extent.xmin - other.extent.xmin) / self.xres)

    # columns ---------------------------------------------------------------------------------
    def col(self, x: Column | str = "x") -> Column:
        x = F.col(x) if isinstance(x, str) else x
        c = F.floor((x - F.lit(float(self.extent.xmin))) / F.lit(float(self.xres)))
        return F.least(c, F.lit(self.ncol - 1)).cast("int")

    def row(self, y: Column | str = "y") -> Column:
        y = F.col(y) if isinstance(y, str) else y
        r = F.floor((F.lit(float(self.extent.ymax)) - y) / F.lit(float(self.yres)))
        return F.least(r, F.lit(self.nrow - 1)).cast("int")

    def cell(self, row: Column | str = "row", col: Column | str = "col") -> Column:
        row, col = (F.col(c) if isinstance(c, str) else c for c in (row, col))
        return row.cast("long") * self.ncol + col

    def x(self, col: Column | str = "col") -> Column:
        col = F.col(col) if isinstance(col, str) else col
        return F.lit(float(self.extent.xmin)) + (col + F.lit(0.5)) * F.lit(float(self.xres))

    def y(self, row: Column | str = "row") -> Column:
        row = F.col(row) if isinstance(row, str) else row
        return F.lit(float(self.extent.ymax)) - (row + F.lit(0.5)) * F.lit(float(self.yres))

    def box(self, row: Column | str = "row", col: Column | str = "col") -> dict[str, Column]:
        """The sides of a cell: ``xmin``, ``xmax``, ``ymin``, ``ymax``."""
        x, y = self.x(col), self.y(row)
        return {"xmin": x - self.xres / 2, "xmax": x + self.xres / 2, "ymin": y - self.yres / 2, "ymax": y + self.yres / 2}

    def with_cells(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Add ``row`` and ``col``; points outside go."""
        return points.where(self.extent.inside(x, y)).withColumns({"row": self.row(y), "col": self.col(x)})

    def dense(self, spark, window: Extent | None = None) -> DataFrame:
        """Every cell ``(row, col)``, or those of a window, made on the executors."""
        r0, r1, c0, c1 = (0, self.nrow - 1, 0, self.ncol - 1)
        if window is not None:
            if not window.overlaps(self.extent):
                return spark.createDataFrame([], "row int, col int")
            r0, r1, c0, c1 = self.rows_cols(window, "out")
        wide = c1 - c0 + 1
        ids = spark.range((r1 - r0 + 1) * wide)
        return ids.select(F.expr(f"cast(id div {wide} + {r0} as int)").alias("row"), (F.col("id") % wide + c0).cast("int").alias("col"))

    def spans(self, extents: DataFrame, how: str = "near") -> DataFrame:
        """Add the first and last row and column, ``_r0, _r1, _c0, _c1``, of the cells that each ``(xmin, xmax, ymin, ymax, ...)`` covers, snapped as asked."""
        snap = {"near": (lambda v: F.floor(v + 0.5),) * 2, "out": (lambda v: F.floor(v + 1e-9), lambda v: F.ceil(v - 1e-9)), "in": (lambda v: F.ceil(v - 1e-9), lambda v: F.floor(v + 1e-9))}
        low, high = snap[how]
        e = self.extent
        px = lambda c: (F.col(c) - F.lit(float(e.xmin))) / F.lit(float(self.xres))
        py = lambda c: (F.lit(float(e.ymax)) - F.col(c)) / F.lit(float(self.yres))
        return extents.withColumns(
            {
                "_c0": F.greatest(low(px("xmin")), F.lit(0)).cast("int"),
                "_c1": (F.least(high(px("xmax")), F.lit(self.ncol)) - 1).cast("int"),
                "_r0": F.greatest(low(py("ymax")), F.lit(0)).cast("int"),
                "_r1": (F.least(high(py("ymin")), F.lit(self.nrow)) - 1).cast("int"),
            }
        ).where("_c0 <= _c1 and _r0 <= _r1")

    def runs(self, extents: DataFrame, how: str = "near") -> DataFrame:
        """Explode ``(xmin, xmax, ymin, ymax, ...)`` rows to the rows of cells they cover: ``row`` and the first and last column, ``_c0`` and ``_c1``.

        The runs are dealt over tasks by the size of the grid, as few boxes may cover many cells.
        """
        out = self.spans(extents, how).withColumn("row", F.explode(F.sequence("_r0", "_r1"))).drop("_r0", "_r1")
        tasks = min(self.nrow, MAX_TASKS, self.ncell // CELLS_PER_TASK)
        return out.repartition(tasks, "row") if tasks > 1 else out

    def covered(self, extents: DataFrame, how: str = "near") -> DataFrame:
        """Explode ``(xmin, xmax, ymin, ymax, ...)`` rows to the cells they cover, snapped as asked.

        A range join as a range of cells: every extent yields its own cells, none compares with all.
        """
        return self.runs(extents, how).withColumn("col", F.explode(F.sequence("_c0", "_c1"))).drop("_c0", "_c1")

    def tallies(self, extents: DataFrame, sums: dict[str, Column] | None = None, how: str = "out") -> DataFrame:
        """``(row, a, z, n, *sums)``: runs of cells, columns ``a`` to ``z``, that ``n`` extents cover, and their sums of whole-number columns.

        Each run is a step up at its first column and a step down after its last one; what is shuffled grows with
        the rows of the boxes, not with their cells.
        """
        sums = {"n": F.lit(1), **(sums or {})}
        runs = self.runs(extents, how).select("row", "_c0", "_c1", *[v.cast("long").alias(c) for c, v in sums.items()])
        ends = F.array(*[F.struct(F.col(c).alias("a"), *[(F.col(n) * s).alias(n) for n in sums]) for c, s in (("_c0", 1), ("_c1", -1))])
        steps = runs.withColumn("_c1", F.col("_c1") + 1).select("row", F.explode(ends).alias("s")).groupBy("row", "s.a").agg(*[F.sum(f"s.{n}").alias(n) for n in sums])
        along = Window.partitionBy("row").orderBy("a")
        up_to = along.rowsBetween(Window.unboundedPreceding, 0)
        out = steps.select("row", "a", (F.lead("a").over(along) - 1).alias("z"), *[F.sum(n).over(up_to).alias(n) for n in sums])
        return out.where("n > 0")

    def along(self, runs: DataFrame) -> DataFrame:
        """The cells of runs ``(row, a, z, ...)``: ``(row, col, ...)``."""
        tasks = min(self.nrow, MAX_TASKS, self.ncell // CELLS_PER_TASK)
        spread = runs.repartition(tasks, "row") if tasks > 1 else runs
        return spread.withColumn("col", F.explode(F.sequence("a", "z"))).drop("a", "z")
