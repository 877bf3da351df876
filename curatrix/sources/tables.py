"""Scans and sinks by file suffix, image discovery, reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.constants import IMAGE_EXTENSIONS


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str, limit: int | None = None, schema=None, lenient: bool = False) -> DataFrame:
    """CSV, JSON lines, JSON (an array or lines), or Parquet, by the path's suffix. lenient drops malformed CSV rows.

    A .json path holds an array or one document if its first files begin with [ or with a document over several lines; as
    written by Spark it holds lines. Arrays are read whole by one task each, as their format asks.
    """
    kind, reader = suffix(path), spark.read
    if schema is not None and kind not in (".parquet", ".pq"):
        reader = reader.schema(schema)
    if kind == ".csv":
        df = reader.csv(path, header=True, multiLine=True, escape='"', inferSchema=schema is None, mode="DROPMALFORMED" if lenient else "PERMISSIVE")
    elif kind in (".jsonl", ".ndjson"):
        df = reader.json(path)
    elif kind == ".json":
        df = reader.option("multiLine", not _holds_lines(spark, path)).json(path)
    elif kind in (".parquet", ".pq"):
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown table format: {path}")
    return df.limit(limit) if limit is not None else df


def _holds_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank is a whole JSON document, and no array."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first:
        return False
    try:
        return isinstance(json.loads(first[0]["value"]), dict)
    except ValueError:
        return False


def write_table(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """The format follows the suffix; single writes one file where a contract asks for one."""
    kind = suffix(path)
    writer = (df.coalesce(1) if single else df).write.mode(mode)
    if kind == ".csv":
        writer.csv(path, header=True, escape='"')
    elif kind in (".jsonl", ".ndjson", ".json"):
        writer.option("ignoreNullFields", False).json(path)
    elif kind in (".parquet", ".pq"):
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table format: {path}")


def write_submission(df: DataFrame, path: str, position: str = "pos") -> None:
    """Exactly id and result, in the input's order, as one CSV file."""
    df.orderBy(position).select("id", "result").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_requests(df: DataFrame, path: str) -> None:
    """One JSON document a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def discover_images(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(id, images): files <root>/<id>/<name> with a picture's suffix, by name. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = files.where(kind.isin(*[e.lower() for e in extensions])).select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path")
    listed = F.array_sort(F.collect_list(F.struct("name", "path")))
    return found.groupBy("id").agg(F.transform(listed, lambda x: x["path"]).alias("images"))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def document_json(metrics: Mapping | DataFrame, indent: int = 2) -> str:
    """A metrics document: a mapping, or a small (section, metric, value) table."""
    if isinstance(metrics, DataFrame):
        nested: dict = {}
        for r in metrics.collect():
            nested.setdefault(r["section"], {})[r["metric"]] = r["value"]
        metrics = nested
    return json.dumps(metrics, ensure_ascii=False, indent=indent, sort_keys=True)


def write_document(spark: SparkSession, metrics: Mapping | DataFrame, path: str) -> None:
    """The metrics document as one text file under path."""
    spark.createDataFrame([(document_json(metrics),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> None:
    """Every report as a CSV table folder/<name>.csv with its header, empty ones too. Arrays and structs become JSON text."""
    for name, df in reports.items():
        nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
        write_table(df.withColumns({c: F.to_json(c) for c in nested}) if nested else df, f"{folder}/{name}.csv", single=True)


def document_markdown(title: str, metrics: DataFrame) -> str:
    """The same table as Markdown, a heading for each section."""
    lines, section = [f"# {title}"], None
    for r in metrics.orderBy("section", "metric").collect():
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section}", "", "| metric | value |", "| --- | --- |"]
        lines.append(f"| {r['metric']} | {r['value']} |")
    return "\n".join(lines) + "\n"


def experiment_log(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """(rows, columns, duplicate_keys, ragged_rows) of a CSV log: its ids must be unique and its rows as long as its header."""
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    schema = ", ".join(f"`{c}` string" for c in names) + ", _ragged string"
    reader = spark.read.option("columnPruning", False)  # else short and long rows aren't noticed
    rows = reader.csv(path, header=True, multiLine=True, escape='"', schema=schema, columnNameOfCorruptRecord="_ragged", enforceSchema=True)
    return rows.agg(F.count("*").alias("rows"), F.lit(len(names)).alias("columns"), (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"), F.count_if(F.col("_ragged").isNotNull()).alias("ragged_rows"))
