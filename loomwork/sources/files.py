"""Files in and out: delimited text, JSON lines, metadata, reports."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import written

MESSAGE_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")


#: Written CSV keeps blanks at the ends of values.
_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def string_schema(columns: tuple[str, ...] = MESSAGE_COLUMNS, corrupt: str | None = "_corrupt_record") -> T.StructType:
    names = [*columns, *([corrupt] if corrupt else [])]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_messages_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = MESSAGE_COLUMNS) -> DataFrame:
    """Quoted CSV with line breaks inside fields; every column text, nothing inferred.

    Rows with too many fields are dropped, short rows are kept with nulls.  The words ``NA`` and
    ``None`` stay text."""
    rows = (
        spark.read.schema(string_schema(columns))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("quote", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )
    # fields are counted outside quotes; the first column is named because a scan may not read the raw row alone
    bare = F.regexp_replace(F.coalesce("_corrupt_record", F.lit("")), r'"(?:[^"]|"")*"', "")
    bad = (F.size(F.split(bare, ",")) > len(columns)) & (F.length(F.coalesce(F.col(columns[0]), F.lit(""))) >= 0)
    return rows.filter(~bad).drop("_corrupt_record")


def messages_table(spark: SparkSession, path: str, columns: tuple[str, ...] = MESSAGE_COLUMNS, rows_per_file: int = 2_000_000) -> DataFrame:
    """The messages of quoted CSV files as a Parquet table, written once to the shared folder.

    A quoted field may hold line breaks, so a CSV file can be split nowhere without reading it from its
    start: each file is one task.  What is written can be split anywhere; everything after reads that."""
    return written(read_messages_csv(spark, path, columns), "messages", max_rows=rows_per_file)


def sample_rows(df: DataFrame, rows: int = 200) -> DataFrame:
    """The first ``rows`` rows with ``inbound`` as a boolean (null where unknown), to look at a schema.  A sampling operator."""
    flag = F.when(F.lower(F.trim("inbound")) == "true", True).when(F.lower(F.trim("inbound")) == "false", False)
    return df.limit(rows).withColumn("inbound", flag)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header and a fixed order of columns; ``mode`` is ``append``, ``overwrite`` or ``errorifexists``.

    An append adds files to the folder, each with its header; rows already there are not read."""
    df.select(*(columns or df.columns)).write.mode(mode).options(**_CSV).csv(path)


def check_columns(df: DataFrame, required: tuple[str, ...]) -> None:
    """Raise if a required column is missing; further columns are fine."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_sorted_csv(df: DataFrame, path: str, order: list, overwrite: bool = False) -> None:
    """Range-partitioned sort, so that the parts in their order are sorted; an empty table gives a header only."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.orderBy(*order).write.mode(mode).options(**_CSV).csv(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def table_hash(df: DataFrame) -> DataFrame:
    """``n_rows, content_hash``: the same for any order and partitioning of the same rows.

    The hash sums four 32-bit parts of each row's SHA-256, so rows are never gathered."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    part = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"p{i}") for i, p in enumerate(part)])
    return sums.select("n_rows", F.sha2(F.concat_ws("-", *[F.col(f"p{i}").cast("string") for i in range(4)], F.col("n_rows").cast("string")), 256).alias("content_hash"))


def metadata_json(metrics: DataFrame, notes: dict[str, Any]) -> str:
    """A one-row table of figures and notes as JSON."""
    row = metrics.first()
    return json.dumps({"figures": row.asDict(recursive=True) if row else {}, **notes}, default=str, indent=2, sort_keys=True)


def markdown_table(df: DataFrame, rows: int = 100) -> str:
    """The first rows as a Markdown table, for reports; a last line says if there are more."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    found = df.limit(rows + 1).collect()  # a bounded report
    body = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in found[:rows]]
    return "\n".join([head, *body, *(["", f"Only the first {rows} rows."] if len(found) > rows else [])])


def markdown_report(title: str, sections: list[tuple[str, DataFrame | str]]) -> str:
    """A report of headed sections, each a text or a table."""
    parts = [f"# {title}"]
    for head, content in sections:
        parts += [f"## {head}", content if isinstance(content, str) else markdown_table(content)]
    return "\n\n".join(parts) + "\n"
