"""Rasters as rows, for tests: to and from DataFrames."""


def cells(df, *names):
    """``{(row, col): value or tuple}``"""
    names = names or ("value",)
    return {(r["row"], r["col"]): r[names[0]] if len(names) == 1 else tuple(r[n] for n in names) for r in df.collect()}


def tidy(spark, rows):
    """A tidy raster from rows of values, None for no data."""
    data = [(r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line) if v is not None]
    return spark.createDataFrame(data, "row int, col int, value double")
