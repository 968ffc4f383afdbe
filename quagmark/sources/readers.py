"""Readers of the outside formats: delimited files, JSON, catalogues, feature collections, sheet indexes, workbooks, numpy archives, ASCII grids, raw float rasters; and writers."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quagmark.functions.scalar import status_value


def from_bytes(text: Column, encoding: str) -> Column:
    """A text that was read as ISO 8859-1 in the single-byte encoding that it really has: Spark reads few encodings, but that one keeps every byte."""
    high = bytes(range(0x80, 0x100))
    return F.translate(text, high.decode("iso-8859-1"), "".join(bytes([b]).decode(encoding, "replace") for b in high))


def weather_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "cp1250") -> DataFrame:
    """A headerless weather file: for every value column ``x`` with a status column ``x_status`` the status decides; decimal commas are read."""
    raw = spark.read.csv(path, schema=", ".join(f"`{c}` string" for c in columns), encoding="iso-8859-1")
    raw = raw.select(*(from_bytes(F.col(f"`{c}`"), encoding).alias(c) for c in columns))
    out = []
    for c in columns:
        if c.endswith("_status"):
            continue
        if f"{c}_status" in columns:
            number = F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
            out.append(status_value(number, F.trim(f"{c}_status")).alias(c))
        else:
            out.append(F.trim(c).alias(c))
    return raw.select(*out)


def columnar_json(texts: DataFrame, column: str, block: str, time: str, values: list[str]) -> DataFrame:
    """Rows of a JSON text that holds parallel arrays: {block: {time: [...], value: [...]}}; what is no number is null."""
    fields = ", ".join([f"`{time}`: array<string>", *(f"`{v}`: array<string>" for v in values)])
    parsed = texts.select(F.from_json(column, f"struct<`{block}`: struct<{fields}>>").alias("j"))
    zipped = parsed.select(F.inline(F.arrays_zip(*(F.col(f"j.{block}.{c}").alias(c) for c in [time, *values]))))
    return zipped.select(F.try_to_timestamp(F.col(time)).alias(time), *(F.col(v).try_cast("double").alias(v) for v in values))


def feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: (name, kind, props, rings); a point is a ring of one place."""
    schema = "struct<features: array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>>"
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))
    f = texts.select(F.explode("j.features").alias("f")).select(F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = F.when(F.col("kind") == "Point", F.array(F.array(F.from_json("c", "array<double>")))).when(F.col("kind") == "Polygon", F.from_json("c", "array<array<array<double>>>"))
    return f.select(F.get(F.map_values("props"), F.lit(0)).alias("name"), "kind", "props", rings.alias("rings"))


def sheet_index(texts: DataFrame, column: str, layer: str) -> DataFrame:
    """One map of plain fields per sheet of an XML feature index."""
    members = F.regexp_extract_all(column, F.lit(rf"(?s)<(?:\w+:)?{layer}[ >].*?</(?:\w+:)?{layer}>"), F.lit(0))
    one = texts.select(F.explode(members).alias("m"))
    pattern = r"<(?:\w+:)?(\w+)>([^<]*)</"
    return one.select(F.map_from_arrays(F.regexp_extract_all("m", F.lit(pattern), F.lit(1)), F.regexp_extract_all("m", F.lit(pattern), F.lit(2))).alias("fields"))


def logger_csv(spark: SparkSession, path: str, time: str, shift_minutes: int = -30) -> DataFrame:
    """A logger's table with a header; stamps of interval ends are shifted to UTC interval middles."""
    raw = spark.read.csv(path, header=True)
    return raw.select((F.try_to_timestamp(F.col(f"`{time}`")) + F.expr(f"INTERVAL {shift_minutes} MINUTES")).alias("time_utc"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != time))


def parsed_files(spark: SparkSession, path: str, pattern: str, parse: Callable[[str, bytes], dict[str, Any]], schema: str) -> DataFrame:
    """The rows that ``parse`` (path and content -> columns) makes of every file below ``path`` whose name fits ``pattern``.

    Files are listed and read through Spark, from any file system that it knows, a task each where they are large; rows travel as columns.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse(name, bytes(content)), columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(work, schema)


CELLS = "path string, row int, col int, value double"


def _cells(path: str, grid: np.ndarray, missing: float | None) -> dict[str, Any]:
    rows, cols = np.indices(grid.shape)
    flat = grid.astype(float).ravel()
    known = np.where(flat == missing, np.nan, flat) if missing is not None else flat
    return {"path": path, "row": rows.ravel(), "col": cols.ravel(), "value": pd.array(np.where(np.isnan(known), None, known), "Float64")}


def parse_ascii_grid(path: str, content: bytes) -> dict[str, Any]:
    """An ESRI ASCII grid: six header lines, then rows from the north."""
    lines = content.decode().split("\n")
    head = {k.lower(): float(v) for k, v in (x.split() for x in lines[:6])}
    return _cells(path, np.array(" ".join(lines[6:]).split(), float).reshape(int(head["nrows"]), int(head["ncols"])), head.get("nodata_value"))


def ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of the ESRI ASCII grids (.asc) below a folder."""
    return parsed_files(spark, path, "*.asc", parse_ascii_grid, CELLS)


def raw_floats(spark: SparkSession, path: str, suffix: str = "ztd", nodata: float | None = None) -> DataFrame:
    """(path, row, col, value) of raw float32 rasters, each beside a text header (path + .rsc) with WIDTH and FILE_LENGTH."""
    read = lambda pattern: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    heads = read(f"*.{suffix}.rsc").select(F.regexp_replace("path", r"\.rsc$", "").alias("path"), F.col("content").cast("string").alias("head"))
    both = read(f"*.{suffix}").select("path", "content").join(heads, "path")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content, head in batch[["path", "content", "head"]].itertuples(index=False, name=None):
                sizes = dict(x.split()[:2] for x in head.splitlines() if x.strip())
                yield pd.DataFrame(_cells(name, np.frombuffer(content, "<f4").reshape(int(sizes["FILE_LENGTH"]), int(sizes["WIDTH"])), nodata))

    return both.mapInPandas(work, CELLS)


def parse_arrays(path: str, content: bytes) -> dict[str, Any]:
    """The arrays of one or two dimensions of a numpy archive, as cells; truth values and whole numbers become numbers, other arrays are passed over."""
    parts = []
    with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
        for name in arrays.files:
            x = np.atleast_2d(arrays[name])
            if x.ndim == 2 and x.dtype.kind in "biuf":
                parts.append(pd.DataFrame({"name": name, **_cells(path, x, None)}))
    return pd.concat(parts).to_dict("list") if parts else {}


def scene_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, col, value) of the numpy archives (.npz), one per scene, below a folder."""
    return parsed_files(spark, path, "*.npz", parse_arrays, "path string, name string, row int, col int, value double")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_workbook(path: str, content: bytes) -> dict[str, Any]:
    """The cells of a workbook (.xlsx): their text and, for solid fills with a colour of their own, the colour as ARGB."""
    out: dict[str, list] = {k: [] for k in ("path", "sheet", "row", "col", "value", "fill")}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")
        texts = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in tree("xl/sharedStrings.xml")]
        styles = tree("xl/styles.xml")
        fills = []
        for fill in styles.iterfind(f"{_SHEET}fills/{_SHEET}fill"):
            pattern = fill.find(f"{_SHEET}patternFill")
            colour = pattern.find(f"{_SHEET}fgColor") if pattern is not None and pattern.get("patternType") == "solid" else None
            fills.append(None if colour is None else colour.get("rgb"))
        of_style = [fills[int(x.get("fillId", 0))] if int(x.get("fillId", 0)) < len(fills) else None for x in styles.iterfind(f"{_SHEET}cellXfs/{_SHEET}xf")]
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in tree("xl/workbook.xml").iterfind(f"{_SHEET}sheets/{_SHEET}sheet"):
            for c in tree(f"xl/{targets[sheet.get(_LINK)]}").iter(f"{_SHEET}c"):
                letters = c.get("r").rstrip("0123456789")
                col = 0
                for letter in letters:
                    col = 26 * col + ord(letter) - 64
                value, kind = c.find(f"{_SHEET}v"), c.get("t")
                text = None if value is None else value.text
                if kind == "s" and text is not None:
                    text = texts[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                style = int(c.get("s", 0))
                for k, v in zip(out, (path, sheet.get("name"), int(c.get("r")[len(letters) :]), col, text, of_style[style] if style < len(of_style) else None), strict=True):
                    out[k].append(v)
    return out


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value, fill), rows and columns from 1, of the workbooks below a folder."""
    return parsed_files(spark, path, "*.xlsx", parse_workbook, "path string, sheet string, row int, col int, value string, fill string")


def flagged_cells(cells: DataFrame, fill: str) -> DataFrame:
    """(path, sheet, row, column): the cells below the heading that are filled with a colour, by data row (from 0) and heading."""
    names = cells.where("row = 1").select("path", "sheet", "col", F.col("value").alias("column"))
    hit = cells.where((F.col("row") > 1) & (F.col("fill") == fill))
    return hit.join(names, ["path", "sheet", "col"]).select("path", "sheet", (F.col("row") - 2).alias("row"), "column")


def motion_points(spark: SparkSession, path: str) -> DataFrame:
    """(the point's own columns, date, mm) of wide tables of ground motion, whose columns named yyyyMMdd hold the displacement on that day."""
    raw = spark.read.csv(path, header=True)
    days = [c for c in raw.columns if re.fullmatch(r"\d{8}", c)]
    own = [c for c in raw.columns if c not in days]
    long = raw.unpivot([F.col(f"`{c}`") for c in own], [F.col(f"`{c}`") for c in days], "date", "mm")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    return long.select(*(number(c).alias(c) if c.lower() in ("latitude", "lat", "longitude", "lon", "easting", "northing", "height", "mean_velocity") else F.col(f"`{c}`") for c in own), F.to_date("date", "yyyyMMdd").alias("date"), number("mm").alias("mm"))


def catalogue_items(texts: DataFrame, column: str) -> DataFrame:
    """(id, datetime, cloud_cover, bbox, asset, href, scale, offset): the assets of the items of a catalogue answer (a STAC feature collection); without scale and offset 1 and 0."""
    band = "struct<scale: double, offset: double>"
    asset = f"struct<href: string, `raster:bands`: array<{band}>>"
    item = f"struct<id: string, bbox: array<double>, properties: struct<datetime: string, `eo:cloud_cover`: double>, assets: map<string, {asset}>>"
    one = texts.select(F.explode(F.from_json(column, f"struct<features: array<{item}>>")["features"]).alias("f"))
    each = one.select("f.id", F.try_to_timestamp(F.col("f.properties.datetime")).alias("datetime"), F.col("f.properties.`eo:cloud_cover`").alias("cloud_cover"), "f.bbox", F.explode("f.assets").alias("asset", "a"))
    first = F.get(F.col("a.`raster:bands`"), F.lit(0))
    return each.select("id", "datetime", "cloud_cover", "bbox", "asset", F.col("a.href").alias("href"), F.coalesce(first["scale"], F.lit(1.0)).alias("scale"), F.coalesce(first["offset"], F.lit(0.0)).alias("offset"))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row (``json``), for which numbers that JSON has not (NaN, infinite) are null, days are yyyy-MM-dd and nulls are kept."""

    def clean(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.abs(c) < float("inf"), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
            c = F.transform(c, lambda x: F.when(F.abs(x) < float("inf"), x))
        return c.alias(f.name)

    return df.select(F.to_json(F.struct(*map(clean, df.schema)), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}).alias("json"))


def store(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet in zstd, in hive partitions if asked."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_folders(spark: SparkSession, root: str, marker: str = "ok") -> list[str]:
    """The sub-folders that carry their completion marker, on any file system that Spark knows."""
    path, fs = _path(spark, root)
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory() and fs.exists(_path(spark, f"{x.getPath()}/{marker}")[0]))


def manifest(spark: SparkSession, name: str, /, **what) -> None:
    """A run's parameters and products as JSON."""
    path, fs = _path(spark, name)
    out = fs.create(path, True)
    try:
        out.write(bytearray(json.dumps(what, indent=1, sort_keys=True, default=str), "utf-8"))
    finally:
        out.close()
