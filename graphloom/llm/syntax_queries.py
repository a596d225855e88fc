"""Queries of problem 5."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.sourcetext import decode, registered
from graphloom.llm.syntax import cause, problems
from graphloom.queries import table


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for path, content, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = problems(language, content)
            if found:
                out.append((path, language, sum(p.cost for p in found), found[0].line, cause(found, decode(content)[0])))
            else:
                out.append((path, language, 0, None, None))
        cols = list(zip(*out)) if out else [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "language", "edits", "line", "cause"])


def checked_files(files: DataFrame, extensions: DataFrame) -> DataFrame:
    """(path, language, edits, line, cause) per row with a registered extension and non-null content.

    edits is the sum of the least repairs of all units and brackets, 0 for valid, blank and empty files; line and cause are of the
    first edit. A unit that needs more than ``syntax.REPAIR`` edits counts one more than that, so edits is then a lower
    bound. Repeated rows come repeatedly; null paths and null contents are left out.
    """
    return registered(files, extensions).mapInArrow(_check, "path string, language string, edits int, line int, cause string")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return checked_files(table(spark, folder, "source_files"), table(spark, folder, "scanner_extensions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a parser of their extension's language rejects."""
    return _checked(spark, folder).where("edits > 0").select("path").distinct()


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Files, invalid files and their share per repository and language; and how many of them an earlier run named."""
    files = _checked(spark, folder).groupBy("path", "language").agg(F.max("edits").alias("edits"))
    clean = F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), r"^\./", "")
    hints = table(spark, folder, "parse_errors").where("reason RLIKE '(?i)syntax error|unexpected token'").select(clean.alias("path")).distinct()
    marked = files.join(hints.withColumn("hinted", F.lit(1)), "path", "left")
    grouped = marked.groupBy(F.substring_index("path", "/", 1).alias("repo"), "language")
    bad = F.col("edits") > 0
    return grouped.agg(F.count("*").alias("files"), F.count_if(bad).alias("invalid"), F.round(F.count_if(bad) / F.count("*"), 6).alias("rate"), F.count_if(bad & F.col("hinted").isNotNull()).alias("known_before"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
