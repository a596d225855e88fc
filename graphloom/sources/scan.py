"""Sources: files of a tree by extension, ignore rules and test names; slices of their text; commit logs."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders of tools and caches that are never scanned (fixed values).
PRUNED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".venv", "venv")
TEST_FOLDERS = ("__tests__", "test", "tests", "spec", "specs")
#: Test names by extension: prefixes and suffixes of the base name (fixed values).
TEST_NAMES = {
    ".py": (("test_",), ("_test",)), ".pyi": (("test_",), ("_test",)), ".rb": (("test_",), ("_test", "_spec")), ".go": ((), ("_test",)), ".c": ((), ("_test",)), ".h": ((), ("_test",)),
    ".cpp": ((), ("_test",)), ".hpp": ((), ("_test",)), ".cc": ((), ("_test",)), ".cxx": ((), ("_test",)), ".hxx": ((), ("_test",)),
    ".rs": ((), ("_test",)), ".java": ((), ("Test", "Tests", "Spec", "Suite")), ".scala": ((), ("Test", "Tests", "Spec", "Suite")), ".sc": ((), ("Test", "Tests", "Spec", "Suite")),
    ".cs": ((), ("Test", "Tests", "Spec")), ".php": ((), ("Test", "Spec")),
}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def is_pruned(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in PRUNED]))


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    base = F.element_at(parts, -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    named = F.lit(False)
    for ext, (before, after) in TEST_NAMES.items():
        hit = F.lit(False)
        for x in before:
            hit = hit | base.startswith(x)
        for x in after:
            hit = hit | stem.endswith(x)
        named = named | (base.endswith(ext) & hit)
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in TEST_FOLDERS])) | base.contains(".test.") | base.contains(".spec.") | named


def _pattern(line: str) -> tuple[re.Pattern, bool] | None:
    """One ignore rule as (pattern over the relative path, whether it takes back)."""
    rule = line.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    back = rule.startswith("!")
    rule = rule[1:] if back else rule
    only_folder, rooted = rule.endswith("/"), "/" in rule.rstrip("/")
    rule = rule.strip("/")
    body = re.escape(rule).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    tail = "/.*" if only_folder else "(?:/.*)?"
    return re.compile(("^" if rooted else "^(?:.*/)?") + body + tail + "$"), back


def ignored_by(rules: list[str]):
    """Column function: is the path ignored by these lines (the last rule that matches decides)?"""
    compiled = [p for p in map(_pattern, rules) if p]

    @F.pandas_udf("boolean")
    def check(paths: pd.Series) -> pd.Series:
        def one(path: str) -> bool:
            out = False
            for pattern, back in compiled:
                if pattern.match(path or ""):
                    out = not back
            return out

        return paths.map(one)

    return check


def select_sources(files: DataFrame, extensions: DataFrame, rules: list[str] | None = None, tests: bool = False) -> DataFrame:
    """Files (path, ...) with a registered extension, outside pruned folders, not ignored, and no tests unless ``tests``."""
    known = F.broadcast(extensions.where("ext IS NOT NULL").select(F.col("ext").alias("_e")).distinct())  # a closed list
    rows = files.where(F.col("path").isNotNull() & ~is_pruned(F.col("path")))
    if not tests:
        rows = rows.where(~is_test(F.col("path")))
    rows = rows.withColumn("_e", extension(F.col("path"))).join(known, "_e", "left_semi").drop("_e")
    return rows.where(~ignored_by(rules)(F.col("path"))) if rules else rows


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below ``root``, paths relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "file:" + str(Path(root).resolve()) if "://" not in root else root
    return rows.select(F.regexp_replace("path", "^" + re.escape(base) + "/*", "").alias("path"), "content")


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (1-based, both included) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


class CommitLog(DataSource):
    """Commits and their files of a Git repository: ``spark.read.format("commit_log").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return "commit_id string, ts bigint, n_parents int, path string, additions int, deletions int"

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)


class _CommitReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder, self.most = options.get("path", "."), int(options.get("max_commits", "2000"))

    def partitions(self):
        return [InputPartition(0)]  # one repository is one log, bounded by max_commits

    def read(self, partition):
        done = subprocess.run(["git", "-C", self.folder, "log", f"-n{self.most}", "--numstat", "--no-renames", "--format=%x00%H %ct %P"], capture_output=True, text=True, check=True)
        for block in done.stdout.split("\0")[1:]:
            head, *rest = block.strip("\n").split("\n")
            commit, ts, *parents = head.split()
            rows = [x.split("\t") for x in rest if x.count("\t") == 2] or [["0", "0", None]]
            for add, cut, path in rows:
                yield commit, int(ts), len(parents), path, int(add) if add.isdigit() else 0, int(cut) if cut.isdigit() else 0


def matches_any(path: str, globs: list[str]) -> bool:
    """Shell-style match, for small driver-side lists."""
    return any(fnmatch.fnmatch(path, g) for g in globs)
