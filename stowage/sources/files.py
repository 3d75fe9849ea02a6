"""Delimited exports in and out (S1, S2, S9, S12); the tables they become live in a workspace."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions.contracts import ContractError
from stowage.sources.workspace import ConflictError, Workspace, align

__all__ = ["ConflictError", "Workspace", "align", "export_bytes", "header_report", "normalize_header", "read_export",
           "write_csv", "write_json_file"]


def normalize_header(name: str) -> str:
    """Case- and whitespace-insensitive header key."""
    return re.sub(r"\s+", " ", name.strip()).lower()


def _matched(raw: DataFrame, header_map: dict[str, str]) -> dict[str, str | None]:
    """The export's own spelling of each header, None where it is absent."""
    by_key = {normalize_header(c): c for c in raw.columns}
    return {h: by_key.get(normalize_header(h)) for h in header_map}


def header_report(spark: SparkSession, path: str, header_map: dict[str, str], sep: str = ",") -> DataFrame:
    """(header, found, present) for every header that the export must have; only the header line is read."""
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    return spark.createDataFrame([(h, f, int(f is not None)) for h, f in _matched(raw, header_map).items()],
                                 "header string, found string, present int")


def input_order() -> F.Column:
    """The place of a row in an export of any number of files: file, start of the split, place in the split.

    Rows of one split are read in order by one task, and splits of a file are ordered by their start, so the order of
    these keys is the order of the lines, however the files are split.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("place"))


def read_export(spark: SparkSession, path: str, header_map: dict[str, str], sep: str = ",",
                order_col: str | None = None) -> DataFrame:
    """S1 + S2: read a delimited export with every column as text, match headers loosely, rename to contract names.

    ``header_map`` maps the export's header spelling to the contract column name; ``order_col`` adds the
    :func:`input_order` of each row.  Raises when a required header is absent.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    found = _matched(raw, header_map)
    missing = [h for h, f in found.items() if f is None]
    if missing:
        raise ContractError(f"missing headers: {missing}")
    cols = [F.col(f"`{found[h]}`").cast("string").alias(target) for h, target in header_map.items()]
    return raw.select(*cols, *([input_order().alias(order_col)] if order_col else []))


def export_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of an export's files, from their listing; no content is read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def write_csv(df: DataFrame, path: str) -> str:
    """Export a table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json_file(df: DataFrame, path: str) -> str:
    """A bounded table as one file of JSON lines, for inspection."""
    df.repartition(1).write.mode("overwrite").json(path)
    return path
