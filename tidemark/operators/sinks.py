"""Writers: tables, documents and exports [K01 K06-K09 K12-K14 F40 F45]."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    """The file system of a table, and the places of the table, of a new one and of the one before."""
    jvm = spark.sparkContext._jvm
    places = [jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old")]
    return places[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *places


def recovered(spark: SparkSession, path: str) -> str:
    """path, after a replacement that broke off has been ended: the new table if it was whole, else the one before [K01]."""
    fs, target, fresh, old = _paths(spark, path)
    if not fs.exists(target):
        whole = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh, "_SUCCESS"))
        if whole or fs.exists(old):
            fs.rename(fresh if whole else old, target)
    return path


def replace_table(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Writes df as the table at path, sorted within files so that range filters skip row groups [K01].

    df may read the table it replaces: it is written beside it first, and swapped in by the file system. The table
    before stays as path.old until the swap is done; ``recovered`` ends a swap that broke off between its two renames.
    """
    spark = df.sparkSession
    made = df.sortWithinPartitions(*order) if order else df
    made.write.mode("overwrite").parquet(f"{path}.new")
    fs, target, fresh, old = _paths(spark, path)
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        raise OSError(f"{path} can't be put in place")
    fs.delete(old, True)


def write_text(text: str, path: str) -> bool:
    """Writes a document on the driver if it differs from what is there; whether it did [K06-K08]."""
    raw = text.encode()
    try:
        with open(path, "rb") as f:
            if f.read() == raw:
                return False
    except FileNotFoundError:
        pass
    with open(f"{path}.tmp", "wb") as f:
        f.write(raw)
    os.replace(f"{path}.tmp", path)
    return True


def write_json(document: dict, path: str) -> bool:
    return write_text(json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2) + "\n", path)


def write_csv(df: DataFrame, path: str, limit: int = 100_000, bom: bool = True) -> bool:
    """A small export in one file, with a byte-order mark for spreadsheets; fails beyond the limit [K07 K09]."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows(rows)
    return write_text(("\ufeff" if bom else "") + out.getvalue(), path)


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(name, bytes, sha256) of the files under path; fails if a required one is missing [K12 F45]."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if required:
        there = {r["name"] for r in files.where(F.col("name").isin(*required)).select("name").collect()}
        if missing := sorted(set(required) - there):
            raise FileNotFoundError(", ".join(missing))
    return files.orderBy("name")


def markdown_table(df: DataFrame, title: str, limit: int = 50) -> str:
    """The first rows of a report as Markdown [K13 O07]."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(limit).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def metadata(df: DataFrame, ym: str, **more: object) -> dict:
    """Counts and extent of a table, for its metadata document [K14 A36]."""
    r = df.agg(F.count("*").alias("rows"), F.min(ym).alias("min"), F.max(ym).alias("max")).first()
    return {"rows": r["rows"], f"{ym}_min": r["min"], f"{ym}_max": r["max"], **more}


def file_name(text: str) -> str:
    """text with what file names can't have replaced by underscores [F40]."""
    return re.sub(r"_+", "_", re.sub(r'[\\/:*?"<>|\s]+', "_", text)).strip("_") or "export"


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
