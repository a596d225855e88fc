"""Change history: per-file metrics, temporal coupling and hotspot scores.

Inputs: commits (commit_id, ts, n_parents) and commit_files (commit_id, path, additions, deletions).
Everything is one pass of aggregation per result; the pair join is per commit and bounded by the bulk limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90.0


def look_back_days(text: str) -> int:
    """Days of a look-back such as 90d, 6w, 12mo or 1y; ValueError for anything else."""
    import re

    m = re.fullmatch(r"([1-9]\d*)(mo|[dwy])", text.strip())
    if not m:
        raise ValueError(f"not a look-back: {text!r}")
    return int(m.group(1)) * {"d": 1, "w": 7, "mo": 30, "y": 365}[m.group(2)]


def recency(ts: Column, now: Column) -> Column:
    """Weight of a change: 1 now, halved every HALF_LIFE_DAYS; a change in the future counts as now."""
    days = F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")), F.lit(0)) / 86_400_000_000.0
    return F.exp(-F.log(F.lit(2.0)) * days / HALF_LIFE_DAYS)


def commit_window(commits: DataFrame, files: DataFrame, max_files: int = 50, max_commits: int | None = 2000, since: Column | None = None, merges: bool = False) -> DataFrame:
    """(commit_id, ts, n_files, merge, bulk): the newest ``max_commits`` commits (all if None) and why they are skipped."""
    rows = commits if since is None else commits.where(F.col("ts") >= since)
    newest = rows if max_commits is None else rows.orderBy(F.col("ts").desc(), "commit_id").limit(max_commits)
    n = files.groupBy("commit_id").agg(F.count_distinct("path").alias("n_files"))
    out = newest.join(n, "commit_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    merge = F.lit(False) if merges else F.col("n_parents") > 1
    return out.select("commit_id", "ts", "n_files", merge.alias("merge"), (~merge & (F.col("n_files") > max_files)).alias("bulk"))


def commit_counters(window: DataFrame) -> DataFrame:
    """(visited, analyzed, merges_skipped, bulk_skipped)."""
    return window.agg(F.count("*").alias("visited"), F.count_if(~F.col("merge") & ~F.col("bulk")).alias("analyzed"), F.count_if("merge").alias("merges_skipped"), F.count_if("bulk").alias("bulk_skipped"))


def touched(window: DataFrame, files: DataFrame) -> DataFrame:
    """(commit_id, ts, path, additions, deletions): one row per analyzed commit and file."""
    per = files.groupBy("commit_id", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    return window.where("NOT merge AND NOT bulk").select("commit_id", "ts").join(per, "commit_id")


def file_metrics(rows: DataFrame, now: Column) -> DataFrame:
    """(path, commits, additions, deletions, recency_score, last_changed)."""
    return rows.groupBy("path").agg(
        F.count("*").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.sum(recency(F.col("ts"), now)).alias("recency_score"), F.max("ts").alias("last_changed"))


def co_changes(rows: DataFrame) -> DataFrame:
    """(left, right, n): commits that changed both, left < right."""
    a = rows.select("commit_id", F.col("path").alias("left"))
    b = rows.select("commit_id", F.col("path").alias("right"))
    return a.join(b, "commit_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("n"))


def couplings(pairs: DataFrame, metrics: DataFrame, least: int = 3) -> DataFrame:
    """(left, right, n, strength): n over the smaller commit count, for pairs changed together ``least`` times."""
    c = metrics.select("path", "commits")
    rows = pairs.where(F.col("n") >= least).join(c.select(F.col("path").alias("left"), F.col("commits").alias("a")), "left").join(c.select(F.col("path").alias("right"), F.col("commits").alias("b")), "right")
    rows = rows.select("left", "right", "n", (F.col("n") / F.least("a", "b")).alias("strength"))
    return rows.orderBy(F.col("strength").desc(), F.col("n").desc(), "left", "right")


def confidence(analyzed: Column) -> Column:
    return F.when(analyzed >= 100, "high").when(analyzed >= 30, "medium").otherwise("low")


def _share(value: Column, most: Column, logged: bool) -> Column:
    part = F.log1p(value) / F.log1p(most) if logged else value / most
    return F.when((value > 0) & (most > 0), part).otherwise(F.lit(0.0))


def hotspots(metrics: DataFrame, structure: DataFrame, top: int = 0) -> DataFrame:
    """(file, history, structure, score): history times (0.5 + 0.5 structure), over files with history.

    ``structure``: path, pagerank, betweenness, transitive; files without it count as zeros. The maxima that scale the
    parts are one row, joined as such.
    """
    rows = metrics.join(structure, "path", "left").select(
        "path", "commits", (F.col("additions") + F.col("deletions")).alias("churn"), "recency_score",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pagerank", "betweenness", "transitive")])
    names = ("commits", "churn", "recency_score", "pagerank", "betweenness", "transitive")
    most = rows.agg(*[F.max(c).alias(f"m_{c}") for c in names])
    part = lambda c, logged: _share(F.col(c), F.col(f"m_{c}"), logged)
    history = 0.45 * part("commits", True) + 0.35 * part("churn", True) + 0.20 * part("recency_score", False)
    shape = 0.40 * part("pagerank", False) + 0.35 * part("transitive", True) + 0.25 * part("betweenness", False)
    out = rows.join(F.broadcast(most)).select(F.col("path").alias("file"), history.alias("history"), shape.alias("structure"))
    out = out.withColumn("score", F.col("history") * (0.5 + 0.5 * F.col("structure"))).orderBy(F.col("score").desc(), "file")
    return out.limit(top) if top else out


def file_graph(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(src, dst): files that use each other, once per pair, without self-loops, containment and imports. ``home``: id, file_path."""
    rows = edges.where("kind NOT IN ('contains', 'imports')").select("src", "dst")
    both = rows.join(home.select(F.col("id").alias("src"), F.col("file_path").alias("a")), "src").join(home.select(F.col("id").alias("dst"), F.col("file_path").alias("b")), "dst")
    return both.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
