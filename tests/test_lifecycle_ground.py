"""Ground in whole runs."""

import math

import numpy as np
import pytest
from raster_rows import tidy

from gridcanopy.functions.grid import Extent, Grid
from gridcanopy.functions.crs import Crs
from gridcanopy.plans.config import RunConfig
from gridcanopy.plans.lifecycle import Run, open_run, topo_products
from gridcanopy.sources.las import write_las
from gridcanopy.sources.rasters import tiff_bytes

WKT = 'PROJCS["UTM",AUTHORITY["EPSG","32610"]]'


def test_solar_radiation_takes_the_cells_latitude(spark):
    """A slope of 45 degrees to the south at the equator: 1 + cos 0 cos 45 + sin 0 ... = 1.7071."""
    g = Grid(Extent(500000, 500003, 0, 3), 3, 3)
    dem = tidy(spark, [[2.0] * 3, [1.0] * 3, [0.0] * 3])
    for crs, latitude in ((Crs(32610), 0.0), (Crs(0), 45.0)):
        run = Run(spark, RunConfig(cellsize=1.0, topo_scale=()), None, [(dem, g)], g, crs=crs)
        row = topo_products(run)["topo_metrics"].where("row = 1 and col = 1").first()
        phi, s, a = (math.radians(v) for v in (latitude, row["Slope"], row["Aspect"]))
        expected = 1 + math.cos(phi) * math.cos(s) + math.sin(phi) * math.sin(s) * math.cos(math.pi - a)
        assert math.isclose(row["SolarRadiationIndex"], expected, abs_tol=1e-4)


@pytest.mark.parametrize("stated", ["", "EPSG:4326"])
def test_ground_in_another_system(spark, tmp_path, stated):
    """Points in UTM over a plane that rises eastwards, given in degrees: heights are all 5."""
    rng = np.random.default_rng(1)
    n = 200
    x, y = np.round(rng.uniform(500000, 500040, n), 2), np.round(rng.uniform(5000000, 5000040, n), 2)
    z = np.round(300 + 0.5 * (x - 500000) + 5, 2)
    one = np.ones(n, int)
    write_las(f"{tmp_path}/a.las", {
        "x": x, "y": y, "z": z, "intensity": one, "return_number": one, "number_of_returns": one,
        "classification": one, "withheld": np.zeros(n, bool), "scan_angle": 0 * one,
    }, 6, wkt=WKT)
    lon, lat, size = -123.0, 45.1545, 0.00002  # the points lie near 45.1536
    g = Grid(Extent(lon - 100 * size, lon + 100 * size, lat - 120 * size, lat + 0.0), 120, 200)
    metres = math.radians(1) * 6378137 * 0.9996 * math.cos(math.radians(45.153)) * 1.00169  # of a degree of longitude
    plane = np.fromfunction(lambda r, c: 300 + 0.5 * metres * size * (c - 99.5), (120, 200))
    (tmp_path / "dem.tif").write_bytes(tiff_bytes(plane, g, None if stated else 4326))
    options = dict(las=(f"{tmp_path}/a.las",), output=f"{tmp_path}/out", cellsize=10.0, topo_scale=(), las_units="metre", dem_crs=stated)
    got = open_run(spark, RunConfig(dem=(f"{tmp_path}/dem.tif",), **options)).heights().toPandas()
    assert len(got) == n and np.allclose(got["z"], 5, atol=0.1)
    far = Grid(Extent(10, 11, 10, 11), 4, 4)
    (tmp_path / "far.tif").write_bytes(tiff_bytes(np.zeros((4, 4)), far, None if stated else 4326))
    with pytest.raises(ValueError, match="none of it overlaps"):
        open_run(spark, RunConfig(dem=(f"{tmp_path}/far.tif",), **options))
