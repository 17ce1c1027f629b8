"""Coordinate systems: texts as trees, keys, tolerant comparison, projections against published and other figures."""

import math

import pytest
from pyspark.sql import functions as F

from gridcanopy.functions.crs import Crs, from_geo_keys, geo_keys, parsed_systems, read_tree
from gridcanopy.functions.units import LinearUnit

GEO = 'GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101,AUTHORITY["EPSG","7019"]],AUTHORITY["EPSG","6269"]],PRIMEM["Greenwich",0,AUTHORITY["EPSG","8901"]],UNIT["degree",0.0174532925199433,AUTHORITY["EPSG","9122"]],AUTHORITY["EPSG","4269"]]'
UTM10 = f'PROJCS["NAD83 / UTM zone 10N",{GEO},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-123],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1,AUTHORITY["EPSG","9001"]],AXIS["Easting",EAST],AXIS["Northing",NORTH],AUTHORITY["EPSG","26910"]]'
COMPOUND = f'COMPD_CS["x",{UTM10},VERT_CS["NAVD88 height (ftUS)",VERT_DATUM["North American Vertical Datum 1988",2005,AUTHORITY["EPSG","5103"]],UNIT["US survey foot",0.304800609601219,AUTHORITY["EPSG","9003"]],AXIS["Up",UP],AUTHORITY["EPSG","6360"]]]'
PRJ = 'PROJCS["NAD_1983_HARN_StatePlane_Washington_South_FIPS_4602_Feet",GEOGCS["GCS_North_American_1983_HARN",DATUM["D_North_American_1983_HARN",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",1640416.666666667],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-120.5],PARAMETER["Standard_Parallel_1",45.83333333333334],PARAMETER["Standard_Parallel_2",47.33333333333334],PARAMETER["Latitude_Of_Origin",45.33333333333334],UNIT["Foot_US",0.3048006096012192]]'
WKT2 = 'COMPOUNDCRS["c",PROJCRS["NAD83(2011) / UTM zone 11N",BASEGEOGCRS["NAD83(2011)",DATUM["NAD83 (National Spatial Reference System 2011)",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]],ID["EPSG",6318]],CONVERSION["UTM zone 11N",METHOD["Transverse Mercator",ID["EPSG",9807]],PARAMETER["Latitude of natural origin",0,ANGLEUNIT["degree",0.0174532925199433],ID["EPSG",8801]],PARAMETER["Longitude of natural origin",-117,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Scale factor at natural origin",0.9996,SCALEUNIT["unity",1]],PARAMETER["False easting",500000,LENGTHUNIT["metre",1]],PARAMETER["False northing",0,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["(E)",east,ORDER[1],LENGTHUNIT["metre",1]],AXIS["(N)",north,ORDER[2],LENGTHUNIT["metre",1]],ID["EPSG",6340]],VERTCRS["NAVD88 height",VDATUM["North American Vertical Datum 1988"],CS[vertical,1],AXIS["gravity-related height (H)",up,LENGTHUNIT["metre",1]],ID["EPSG",5703]]]'


def test_tree():
    t = read_tree('A["x ""y""", 1.5, B(2, word), C[]]')
    assert t.keyword == "A" and t.values == ['x "y"', 1.5] and t.first("B").values == [2.0, "word"] and t.first("C").nodes == []
    for bad in ("A[", "A[]]", "", "A[B[1]", "hello"):
        with pytest.raises(ValueError):
            read_tree(bad)


def test_compound_systems_keep_their_parts():
    c = Crs.parse(COMPOUND)
    assert (c.epsg, c.vertical, c.z_unit.name, c.xy_unit.name, c.zone) == (26910, 6360, "us survey foot", "metre", (10, True))
    c = Crs.parse(WKT2)
    assert (c.epsg, c.vertical, c.z_unit.name, c.zone, c.same_place(Crs(6340))) == (6340, 5703, "metre", (11, True), True)
    assert Crs.parse(f"BOUNDCRS[SOURCECRS[{UTM10}],TARGETCRS[{GEO}]]").epsg == 26910
    assert Crs.parse(GEO).geographic and Crs.parse(GEO).epsg == 4269 and Crs.parse(GEO).z_unit.metres is None


def test_units_of_codes():
    """Horizontal and vertical units as codes define them; heights follow the plane where nothing else is said."""
    want = {"": (None, None), "2927": ("us survey foot", "us survey foot"), "6340": ("metre", "metre"), "2927+5703": ("us survey foot", "metre"), "4269": (None, None), "4326+5703": (None, "metre")}
    for text, (xy, z) in want.items():
        c = Crs.parse(text)
        assert (c.xy_unit.metres and c.xy_unit.name, c.z_unit.metres and c.z_unit.name) == (xy, z), text
    assert Crs.parse("2927", LinearUnit.named("m")).z_unit.name == "metre" and Crs.parse("", LinearUnit.named("ft")).z_unit.name == "foot"
    assert [Crs.parse(t).projected for t in ("2927", "2927+5703", "4326", "4326+5703")] == [True, True, False, False]


def test_agreement():
    against = Crs.parse("6340+5703")
    flat = {"": True, "6340": True, "2927+5703": False, "4269": False, "6340+5702": True, "26911": False}
    up = {"": True, "2927": False, "2927+5703": True, "4269": True, "6340+5702": False}
    for text, same in flat.items():
        assert against.same_place(Crs.parse(text)) is same and Crs.parse(text).same_place(against) is same, text
    for text, same in up.items():
        assert against.z_unit.consistent(Crs.parse(text).z_unit) is same, text
    assert not against.consistent(Crs.parse("6340+5703", LinearUnit.named("foot")))
    # parallels in the other order, a false easting in feet and no code: the same place as the code
    c = Crs.parse(PRJ)
    assert c.epsg == 0 and c.unit.name == "us survey foot" and c.same_place(Crs(2927)) and c.key == Crs.parse("2927").key
    assert not c.same_place(Crs(32149)) and Crs.parse(UTM10).key == Crs.parse("26910").key != Crs.parse("32610").key


def test_state_planes_are_no_utm_zones(spark):
    assert Crs(26941).zone is None and Crs(26941).projection.method == "lcc" and Crs(26910).zone == (10, True) and Crs(32733).zone == (33, False)
    assert Crs(26968).projection.method == "tmerc" and Crs(26968).zone is None
    with pytest.raises(ValueError, match="not in the tables"):
        Crs(31370).transform(Crs(4326), F.lit(0.0), F.lit(0.0))


def test_proj_strings():
    assert Crs.parse("+proj=utm +zone=11 +datum=NAD83 +units=m +no_defs +type=crs").epsg == 26911
    assert Crs.parse("+proj=utm +zone=33 +south").epsg == 32733 and Crs.parse("+proj=longlat +datum=NAD83").epsg == 4269
    text = "+proj=lcc +lat_1=47.33333333333334 +lat_2=45.83333333333334 +lat_0=45.33333333333334 +lon_0=-120.5 +x_0=500000.0001016001 +y_0=0 +datum=NAD83 +units=us-ft"
    c = Crs.parse(text)
    assert c.projection.near(Crs(2927).projection) and c.unit.name == "us survey foot"
    with pytest.raises(ValueError):
        Crs.parse("+proj=sterea +lat_0=52")


def test_geo_keys():
    directory = (1, 1, 0, 4, 1024, 0, 1, 1, 3072, 0, 1, 26910, 3076, 0, 1, 9001, 4099, 0, 1, 9003)
    c = from_geo_keys(geo_keys(directory))
    assert (c.epsg, c.z_unit.name) == (26910, "us survey foot")
    doubles = (45 + 1 / 3, -120.5, 47 + 1 / 3, 45 + 5 / 6, 1640416.6666666667, 0.0)
    own = (1, 1, 0, 9, 1024, 0, 1, 1, 2048, 0, 1, 4152, 3072, 0, 1, 32767, 3075, 0, 1, 8, 3076, 0, 1, 9003, *(v for k, n in ((3085, 0), (3084, 1), (3078, 2), (3079, 3), (3086, 4), (3087, 5)) for v in (k, 34736, 1, n)))
    c = from_geo_keys(geo_keys(own, doubles))
    assert c.same_place(Crs(2927)) and c.z_unit.name == "us survey foot"
    assert not from_geo_keys({}).known and from_geo_keys({2048: 4326}).geographic


def test_wkt_round_trip():
    for text in ("2927+5703", "26910", "4326", "5070", "26968", "6340+6360", "4326+5703", "2269"):
        c = Crs.parse(text)
        again = Crs.parse(c.to_wkt())
        assert again.same_place(c) and again.z_unit.consistent(c.z_unit) and (again.z_unit.metres is None) == (c.z_unit.metres is None) and again.key == c.key, text


def _move(spark, source, to, points):
    x, y = source.transform(to, F.col("x"), F.col("y"))
    return [tuple(r) for r in spark.createDataFrame(points, "x double, y double").coalesce(1).select(x, y).collect()]


def test_state_plane_to_utm(spark):
    """Washington South in feet to UTM 11: figures known to a metre."""
    got = _move(spark, Crs(2927), Crs(32611), [(1000.0, 1000.0), (5000.0, 5000.0)])
    for (x, y), (wx, wy) in zip(got, [(-275004, 5047656), (-273726, 5048831)]):
        assert abs(x - wx) < 1 and abs(y - wy) < 1


def test_published_lambert_example(spark):
    """A worked example of the conformal conic with two parallels in feet (Clarke 1866, Texas South Central)."""
    text = "+proj=lcc +lat_1=28.38333333333333 +lat_2=30.28333333333333 +lat_0=27.83333333333333 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +datum=NAD27 +units=us-ft"
    ((x, y),) = _move(spark, Crs.parse("4267"), Crs.parse(text), [(-96.0, 28.5)])
    assert abs(x - 2963503.91) < 0.02 and abs(y - 254759.80) < 0.02


def test_albers_and_inverse_of_all(spark):
    """Albers keeps areas; every projection's inverse gives back the place to a millimetre."""
    points = [(-119.0 + 0.3 * k, 45.5 + 0.4 * k) for k in range(6)]
    for code in (2927, 26941, 26968, 26970, 5070, 26910, 32710, 2269):
        back = _move(spark, Crs(code), Crs(4269), _move(spark, Crs(4269), Crs(code), points))
        for (lon, lat), (a, b) in zip(points, back):
            assert abs(lon - a) < 1e-8 and abs(lat - b) < 1e-8, code
    step = 0.01
    e2 = 2 / 298.257222101 - 1 / 298.257222101**2
    for lon, lat in ((-100.0, 30.0), (-80.0, 45.0)):
        corners = [(lon, lat), (lon + step, lat), (lon + step, lat + step), (lon, lat + step)]
        p = _move(spark, Crs(4269), Crs(5070), corners)
        area = abs(sum(p[k][0] * p[k - 3][1] - p[k - 3][0] * p[k][1] for k in range(4))) / 2

        def band(v):  # area below a latitude for one radian of longitude
            s, e = math.sin(math.radians(v)), math.sqrt(e2)
            return 6378137.0**2 * (1 - e2) / 2 * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

        assert math.isclose(area, math.radians(step) * (band(lat + step) - band(lat)), rel_tol=1e-6)


def test_systems_of_a_table(spark):
    rows = spark.createDataFrame([(COMPOUND,), (UTM10,), (None,), ("",), ("nonsense",), (UTM10,), ("EPSG:26910",)], "wkt string")
    got = {r["crs_text"]: r for r in parsed_systems(rows, "wkt").collect()}
    assert len(got) == 6 and not got["nonsense"]["readable"] and got[None]["readable"] and got[None]["epsg"] is None
    assert got[COMPOUND]["z_unit"] == "us survey foot" and got[UTM10]["crs_key"] == got["EPSG:26910"]["crs_key"]
