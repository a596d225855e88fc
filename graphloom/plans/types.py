"""Type names in signatures, and small relational steps of the pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.plans.resolve import nearest_definitions

_PIECE = re.compile(r"-> |: |[A-Za-z_][A-Za-z0-9_]*|.", re.S)


def pieces(signature: str, own: str) -> list[tuple[str, bool]]:
    """A signature cut into pieces, each with whether it names a type other than ``own``.

    A type stands behind ``: `` and ``-> `` up to the next comma or bracket, and anywhere inside ``<...>``.
    """
    out, typed, depth = [], False, 0
    for piece in _PIECE.findall(signature):
        if piece == "<":
            depth, typed = depth + 1, True
        elif piece == ">" and depth:
            depth -= 1
            typed = depth > 0
        elif piece in ("-> ", ": "):
            typed = True
        elif piece in (",", "(", ")") and not depth:
            typed = False
        named = piece[0].isascii() and (piece[0].isalpha() or piece[0] == "_")
        out.append((piece, named and typed and piece != own))
    return out


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        cut = [pieces(s or "", n or "") for s, n in zip(batch["signature"], batch["name"])]
        yield pd.DataFrame({"gid": batch["gid"], "file_path": batch["file_path"], "text": [[t for t, _ in c] for c in cut], "type": [[y for _, y in c] for c in cut]})


def typed_signatures(symbols: DataFrame) -> DataFrame:
    """(gid, signature): signatures with type names replaced by the short id of the type they stand for.

    ``symbols``: gid, sid, file_path, name, scoped_name, category, signature, ord. A name means the type of its own file, else
    the nearest one by folders (ties by id); without one it stays. Null signatures stay null.
    """
    rows = durable(symbols.where("signature IS NOT NULL").select("gid", "file_path", "name", "signature").mapInPandas(_cut, "gid string, file_path string, text array<string>, type array<boolean>"))
    types = symbols.where("category = 'type'")
    used = F.transform(F.filter(F.arrays_zip("text", "type"), lambda p: p["type"]), lambda p: p["text"])
    names = rows.df.select("gid", "file_path", F.explode(F.array_distinct(used)).alias("name"))
    known = nearest_definitions(names.select("file_path", "name"), types).where("resolved").join(types.select(F.col("gid").alias("target"), "sid"), "target")
    maps = names.join(known.select("file_path", "name", "sid"), ["file_path", "name"]).groupBy("gid").agg(F.map_from_entries(F.collect_list(F.struct("name", "sid"))).alias("ids"))
    filled = F.array_join(F.transform(F.arrays_zip("text", "type"), lambda p: F.when(p["type"], F.coalesce(F.col("ids")[p["text"]], p["text"])).otherwise(p["text"])), "")
    out = rows.df.join(maps, "gid", "left").select("gid", filled.alias("signature"))
    return out.unionByName(symbols.where("signature IS NULL").select("gid", "signature"))


def name_ordinals(symbols: DataFrame) -> DataFrame:
    """(file_path, name, ordinal): names of a file numbered from 1 by their first occurrence; one byte, so 256 is 0 again."""
    first = symbols.groupBy("file_path", "name").agg(F.min("ord").alias("first"))
    return first.select("file_path", "name", F.pmod(F.row_number().over(Window.partitionBy("file_path").orderBy("first", "name")), F.lit(256)).alias("ordinal"))


def only_current(history: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``history`` (file, ...) whose file still exists in ``files`` (path)."""
    return history.join(files.where("path IS NOT NULL").select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def without_edges(edges: DataFrame) -> DataFrame:
    """No edges, of the same columns."""
    return edges.where(F.lit(False))


def pipeline_counts(files: DataFrame, symbols: DataFrame, edges: DataFrame, errors: DataFrame) -> DataFrame:
    """(files, symbols, edges, errors): one row with the sizes of a run."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in (("files", files), ("symbols", symbols), ("edges", edges), ("errors", errors))]
    out = counts[0].withColumn("_k", F.lit(0))
    for one in counts[1:]:  # one row each
        out = out.join(F.broadcast(one.withColumn("_k", F.lit(0))), "_k")
    return out.drop("_k")
