"""Sources and sinks: tab-separated archives, JSON lines, line lists, exclusive and checked writes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the members of a filing archive.
FILINGS = T.StructType([T.StructField(n, t) for n, t in (("adsh", T.StringType()), ("cik", T.LongType()), ("name", T.StringType()), ("sic", T.IntegerType()), ("form", T.StringType()), ("period", T.StringType()), ("fy", T.IntegerType()), ("fp", T.StringType()), ("aciks", T.StringType()))])
PRESENTATION = T.StructType([T.StructField(n, t) for n, t in (("adsh", T.StringType()), ("report", T.IntegerType()), ("line", T.IntegerType()), ("stmt", T.StringType()), ("inpth", T.IntegerType()), ("tag", T.StringType()), ("version", T.StringType()), ("plabel", T.StringType()), ("negating", T.IntegerType()))])

LINES_A_BATCH = 50_000


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A tab-separated file with a header and no quoting. Columns are found by name; ``strict`` fails on a malformed line,
    otherwise its fields that cannot be read are null."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", mode="FAILFAST" if strict else "PERMISSIVE", inferSchema=False)
    return raw.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if strict else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_archive_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line_no, line) of a text member of zip archives, one task an archive.

    Only the names of the archives pass through Spark; each task opens its archive where it lies and reads
    the member line by line, so an archive may be larger than memory.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["path"]:
                store, name = pafs.FileSystem.from_uri(archive)
                with store.open_input_file(name) as raw, zipfile.ZipFile(raw) as z:
                    if member not in z.namelist():
                        continue
                    with z.open(member) as file:
                        text = enumerate(io.TextIOWrapper(file, encoding="utf-8", errors="replace", newline="\n"))
                        while rows := [(archive, k, line.rstrip("\r\n")) for k, line in islice(text, LINES_A_BATCH)]:
                            yield pd.DataFrame(rows, columns=["archive", "line_no", "line"])

    names = spark.read.format("binaryFile").load(path).select("path")
    return names.repartition(max(1, names.count())).mapInPandas(lines, "archive STRING, line_no BIGINT, line STRING")


def parse_lines(lines: DataFrame, schema: T.StructType, names: list[str]) -> DataFrame:
    """Fields of tab-separated lines whose columns stand in the order of ``names``; the header line is skipped."""
    parts = F.split("line", "\t", -1)
    place = {n: k for k, n in enumerate(names)}
    kept = lines.where("line_no > 0")
    return kept.select("archive", "line_no", *[F.nullif(F.get(parts, place[f.name]), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def routed_lines(lines: DataFrame, routed: DataFrame) -> DataFrame:
    """Lines whose first field is a routed id; all others are dropped before any further field is parsed."""
    ids = routed.select(F.col("adsh").alias("_id")).distinct()
    return lines.withColumn("_id", F.substring_index("line", "\t", 1)).join(ids, "_id", "left_semi").drop("_id")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a given schema; ``strict`` refuses a malformed line."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file, without comments and blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')")


def write_exclusive(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write to a path that must not exist; what is written becomes visible whole, by the commit protocol."""
    df.write.mode("errorifexists").options(**options).format(fmt).save(path)


def write_payloads(rows: DataFrame, path: str, key: str) -> None:
    """Rows as gzip JSON lines in a folder a key, sorted within it."""
    rows.repartition(key).sortWithinPartitions(key, *[c for c in rows.columns if c != key]).write.mode("errorifexists").partitionBy(key).json(path, compression="gzip", ignoreNullFields=False)


def refuse(violations: DataFrame, shown: int = 5) -> None:
    """Raise if an assertion view is not empty, naming the first rows."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError("refused: " + "; ".join(str(r.asDict()) for r in rows))


def write_checked(df: DataFrame, violations: DataFrame, path: str) -> None:
    """Write a table only if its assertion view is empty."""
    refuse(violations)
    write_exclusive(df, path)


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n) of keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
