"""Line dedup over overlapping windows of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Remove lines covered by a repeated window of ``width`` consecutive lines.

    A text is split at newlines.  Each run of ``width`` lines is one window; of equal windows
    anywhere in the corpus the first by (id, hash of the text, position) stays and the lines of all
    later ones go, where overlapping windows are merged into one set of covered positions.

    Defined cases: a null text stays null and has no lines; an empty text is one empty line;
    texts of fewer than ``width`` lines are untouched; windows of blank lines only are no repeats.
    Rows with equal id and text are one document and get the same result; a null id is an id
    that sorts last.  All columns are kept as they are, whatever their names; ``text_col`` is
    replaced and ``n_lines`` and ``n_removed`` (int) are added (replacing columns so named).
    Windows are compared by two 64-bit hashes.
    """
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_removed")]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
        F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines"),
    )
    windows = _windows(base, width)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "th", "pos")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    later = windows.join(first, ["h1", "h2"]).where(order != F.col("first")).select("id", "th", "pos")
    spread = F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(width)])))
    covered = (
        later.groupBy("id", "th")
        .agg(F.collect_set("pos").alias("starts"))
        .select(F.col("id").alias("cid"), F.col("th").alias("cth"), F.array_distinct(spread).alias("gone"))
    )
    joined = base.join(covered, F.col("id").eqNullSafe(F.col("cid")) & (F.col("th") == F.col("cth")), "left")
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(kept, lambda i: F.element_at("lines", i))
    )
    return joined.select(
        "row.*",
        F.array_join(left, "\n").alias(text_col),
        F.coalesce(F.size("lines"), F.lit(0)).cast("int").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("int").alias("n_removed"),
    ).select(*_order(docs.columns))


def _windows(base: DataFrame, width: int) -> DataFrame:
    """``(id, th, pos, h1, h2)``: one row for each run of ``width`` lines that are not all blank."""
    parts = [F.element_at("lines", F.col("pos") + k) for k in range(width)]
    return (
        base.where(F.size("lines") >= width)
        .select("id", "th", "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - (width - 1))).alias("pos"))
        .where(F.trim(F.concat(*parts)) != "")
        .select("id", "th", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(width), *parts).alias("h2"))
    )


def _order(columns: list[str]) -> list:
    names = [c for c in columns if c.lower() not in ("n_lines", "n_removed")]
    return [F.col(f"`{c}`") for c in names] + ["n_lines", "n_removed"]


def clean_documents(docs: DataFrame) -> DataFrame:
    """The cleaned documents with their own columns; a column ``n_chars`` counts anew where lines went."""
    clash = {c: f"__{k}" for k, c in enumerate(docs.columns) if c.lower() in ("n_lines", "n_removed")}
    out = dedup_lines(docs.withColumnsRenamed(clash))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        counted = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted)
    return out.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
