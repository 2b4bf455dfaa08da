"""Reading raw tables, settling their column names, and merging keyed tables into one wide table."""

from __future__ import annotations

import re
import warnings
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinalis.constants import COLUMN_ALIASES
from ordinalis.session import settle

READERS = ("parquet", "csv", "json", "orc")


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(name, format, n_files, bytes) of the tables in a folder, each a file or a folder of files; contents are not read.

    Hidden files are left out, and so are files that no reader knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    base = urlsplit(folder).path.rstrip("/")
    top = F.regexp_extract("path", "^[^/]*(?://[^/]*)?" + re.escape(base) + "/([^/]+)", 1)
    return (files.select(F.regexp_extract(top, r"^(.*)\.([A-Za-z]+)$", 1).alias("name"),
                         F.lower(F.regexp_extract(top, r"\.([A-Za-z]+)$", 1)).alias("format"), "length")
            .filter(F.col("format").isin(*READERS) & ~F.col("name").startswith("."))
            .groupBy("name", "format").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes")))


def scan_layout(listing: DataFrame) -> DataFrame:
    """Tag the listing: several columnar tables are merged, one is read alone, otherwise the first CSV is taken."""
    columnar = F.count_if(F.col("format") != "csv").alias("columnar")
    layout = (F.when(F.col("columnar") >= 2, "multi").when(F.col("columnar") == 1, "single").otherwise("csv"))
    picked = listing.agg(columnar, F.min(F.when(F.col("format") == "csv", F.col("name"))).alias("first_csv"))
    kind, first_csv = picked.select(layout).scalar(), picked.select("first_csv").scalar()
    used = (((kind != "csv") & (F.col("format") != "csv")) | ((kind == "csv") & (F.col("name") == first_csv)))
    return listing.select("name", "format", "n_files", "bytes", kind.alias("layout"), used.alias("used"))


def scan_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The layout of a folder with what its used tables hold: n_rows and n_columns, NULL for tables that are not used.

    Rows are counted by Spark from file footers where the format has them.  Files of one table may differ in columns: the
    merged schema counts.  Only names come to the driver.
    """
    layout = settle(scan_layout(list_tables(spark, folder)))
    used = sorted(tuple(r) for r in layout.filter("used").select("name", "format").collect())
    counted = []
    for name, fmt in used:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read.option("mergeSchema", True)
        rows = reader.format(fmt).load(f"{folder.rstrip('/')}/{name}.{fmt}")
        counted.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), F.lit(fmt).alias("format"), "n_rows", F.lit(len(rows.columns)).alias("n_columns")))
    if not counted:
        return layout.withColumns({"n_rows": F.lit(None).cast("long"), "n_columns": F.lit(None).cast("int")})
    return layout.join(reduce(DataFrame.unionByName, counted), ["name", "format"], "left")


def load_tables(spark: SparkSession, paths: dict[str, str], schemas: dict | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames by name; the format follows the file extension (CSV columns stay strings unless a schema is given)."""
    out = {}
    for name, path in paths.items():
        fmt = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if fmt not in READERS:
            raise ValueError(f"{name}: no reader for {path!r}")
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        out[name] = reader.format(fmt).load(path)
    return out


def normalize_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Strip column names and apply the alias map."""
    aliases = COLUMN_ALIASES if aliases is None else aliases
    renames = {}
    for c in df.columns:
        name = c.strip()
        renames[c] = aliases.get(name, name)
    return df.withColumnsRenamed(renames)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required column(s) {missing}; found {len(df.columns)} columns: {df.columns[:8]}...")
    return df


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Strings to double, unreadable values to NULL."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in columns if c in df.columns})


def _add_new(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    new = [c for c in other.columns if c not in base.columns]
    if not new:
        return base
    return base.join(other.select(key, *new), key, "left")


def merge_tables(tables: dict[str, DataFrame], key: str, place_key: str | None = None) -> DataFrame:
    """Left-join every table on `key`, widest first, adding only columns not yet there; then the place-keyed tables.

    Join strategies are left to AQE.  Tables with neither key are skipped with a warning.
    """
    keyed = sorted(((n, t) for n, t in tables.items() if key in t.columns), key=lambda x: (-len(x[1].columns), x[0]))
    if not keyed:
        raise ValueError(f"no table has the key {key!r}; seen {sorted(tables)}")
    base = keyed[0][1]
    for _, t in keyed[1:]:
        base = _add_new(base, t, key)
    for name, t in tables.items():
        if key in t.columns:
            continue
        if place_key and place_key in t.columns and place_key in base.columns:
            base = _add_new(base, t, place_key)
        else:
            warnings.warn(f"table {name!r} has no usable join key and is skipped", stacklevel=2)
    return base


def merge_sheets(sheets: list[DataFrame], key: str) -> DataFrame:
    """Same idea in the given order: first keyed table is the base; without any key the first table is returned."""
    named = [normalize_columns(s) for s in sheets]
    keyed = [s for s in named if key in s.columns]
    if not keyed:
        return sheets[0]
    base = keyed[0]
    for s in keyed[1:]:
        base = _add_new(base, s, key)
    return base
