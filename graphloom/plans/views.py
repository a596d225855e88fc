"""The graph as derived views over symbols and edges.

Symbols are one row per id; edges stay a bag (parallel edges count), with kinds trimmed and in
lower case, and count only where both ends are symbols. Package is a file's folder, language its extension.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def kind_of(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, r"^\s+|\s+$", ""))


@dataclass
class Graph:
    symbols: DataFrame  # id, name, file_path, package, category, kind, abstract
    edges: DataFrame  # src, dst, kind, ord: both ends resolved

    @property
    def uses(self) -> DataFrame:
        """All edges but containment."""
        return self.edges.where("kind <> 'contains'")

    @property
    def contains(self) -> DataFrame:
        return self.edges.where("kind = 'contains'")

    def fans(self) -> DataFrame:
        """(id, fan_in, fan_out) in edges, for symbols with any."""
        ends = self.uses.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(self.uses.select("dst", F.lit(1), F.lit(0)))
        return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))

    def last_parent(self, kinds: list[str]) -> DataFrame:
        """(child, parent) by the edge of highest ord (then greatest other end) of ``kinds``; contains runs parent to child, the others child to parent."""
        rows = self.edges.where(F.col("kind").isin(kinds))
        up = F.col("kind") == "contains"
        rows = rows.select(F.when(up, F.col("dst")).otherwise(F.col("src")).alias("child"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("parent"), "ord")
        return rows.groupBy("child").agg(F.max(F.struct("ord", "parent"))["parent"].alias("parent"))

    def package_edges(self) -> DataFrame:
        """(src, dst, weight) between different packages."""
        pack = self.symbols.select("id", "package")
        both = self.uses.join(pack.select(F.col("id").alias("src"), F.col("package").alias("a")), "src").join(pack.select(F.col("id").alias("dst"), F.col("package").alias("b")), "dst")
        return both.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))


def build_graph(symbols: DataFrame, edges: DataFrame) -> Graph:
    """``symbols``: id, name, file_path, category, kind, properties; null and empty ids are left out."""
    rows = symbols.where(F.col("id") != "")
    abstract = F.coalesce(F.element_at("properties", F.lit("abstract")) == "true", F.lit(False))
    wide = rows.select("id", F.struct("name", "file_path", "category", "kind", abstract.alias("abstract")).alias("s"))
    one = wide.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.*").withColumn("package", folder_of(F.col("file_path")))
    kept = edges.where((F.col("src") != "") & (F.col("dst") != "")).select("src", "dst", kind_of(F.col("kind")).alias("kind"), "ord").where("kind <> ''")
    ids = one.select("id")
    resolved = kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(one, resolved)
