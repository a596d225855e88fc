"""Sinks as relations: symbol lines, edge blocks, dictionary, text blocks, JSON; and writers for them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.common import durable

NO_LINES = 500


def property_text(properties: Column) -> Column:
    """Sorted ``k`` (value true) or ``k=v``, joined by spaces."""
    entries = F.array_sort(F.map_entries(properties))
    return F.array_join(F.transform(entries, lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), " ")


def symbol_lines(symbols: DataFrame) -> DataFrame:
    """(file_path, ord, line) of symbols with sid, span and properties."""
    place = F.when(F.col("span.start") == F.col("span.end"), F.concat(F.lit("L"), F.col("span.start"))).otherwise(F.concat(F.lit("L"), F.col("span.start"), F.lit("-L"), F.col("span.end")))
    props = property_text(F.coalesce("properties", F.create_map().cast("map<string,string>")))
    line = F.concat_ws(" ", "sid", F.concat_ws("/", "category", "kind"), place, F.when(F.trim(F.col("signature")) != "", F.trim(F.regexp_replace("signature", r"\s+", " "))), F.when(props != "", F.concat(F.lit("{"), props, F.lit("}"))))
    return symbols.select("file_path", "ord", line.alias("line"))


def edge_blocks(edges: DataFrame) -> DataFrame:
    """(src, kind, targets): targets of each source and kind in order, as text; distinct, first occurrence first."""
    first = edges.groupBy("src", "kind", "dst").agg(F.min("ord").alias("ord"))
    rows = first.groupBy("src", "kind").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("x"))
    return rows.select("src", "kind", F.array_join(F.transform("x", lambda e: e["dst"]), ", ").alias("targets"))


def json_edges(edges: DataFrame, home: DataFrame) -> DataFrame:
    """(position_file, src, kind, dst, json): one JSON object per edge, in the order of file, source, kind and target."""
    rows = edges.join(home.select(F.col("id").alias("src"), "file_path"), "src").select(F.col("file_path").alias("position_file"), "src", "kind", "dst")
    return rows.withColumn("json", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind"))).orderBy("position_file", "src", "kind", "dst")


def running(df: DataFrame, by: str, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row in the order of ``by`` (unique), by ranges: no task sees all rows."""
    ranged = durable(df.withColumn("_v", value).repartitionByRange(by).withColumn("_p", F.spark_partition_id())).df
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("_p").agg(F.sum("_v").alias("_s"))  # one row per partition
    starts = parts.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.withColumn("_i", inside).join(F.broadcast(starts), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_v", "_p", "_i", "_b")


def dictionary(tokens: DataFrame) -> DataFrame:
    """(code, token): codes d0, d1, ... in token order for tokens (token, count) that are longer than their code; nulls take no part.

    The number only moves on where a code is given, and codes grow with it: all codes of one length are given together, to the
    next tokens in order that are longer, so there are as many rounds as digits.
    """
    rows = tokens.where("count > 0 AND length(token) > 2").select("token", F.length("token").alias("n"))
    rows, start, out, size = durable(rows).df, None, None, 2
    while True:
        given = 10 ** (size - 2) if size > 2 else 0
        room = 10 ** (size - 1) - given
        now = rows.where(F.col("n") > size)
        now = durable(running(now if start is None else now.where(F.col("token") > start), "token", F.lit(1), "k").where(F.col("k") < room)).df
        one = now.select(F.concat(F.lit("d"), (F.col("k") + given).cast("string")).alias("code"), "token")
        out = one if out is None else out.unionByName(one)
        last = now.agg(F.count("*"), F.max("token")).first()
        if last[0] < room:
            return out
        start, size = last[1], size + 1


def flat_blocks(blocks: DataFrame, most: int = NO_LINES) -> DataFrame:
    """(file_path, lines, part): file blocks in order, filled greedily into parts of at most ``most`` lines, numbered from 0.

    A part opens with a line of its own, and a block joins it if two more lines still fit behind it; a block longer than a
    part stands alone. Where a part that starts at a block ends follows from running sums alone, so the next start of every
    block is known at once, and doubling these steps marks the starts in logarithmically many rounds.
    """
    room = most - 3
    placed = running(blocks.select("file_path", "lines"), "file_path", F.lit(1), "pos")
    placed = durable(running(placed, "file_path", F.col("lines"), "before").withColumn("bucket", F.floor(F.col("before") / most)))
    ends = placed.df.select((F.col("before") + F.col("lines")).alias("end"), "pos")
    # the last block of a part that starts here ends within ``room`` of the start, so in this bucket or the next
    reach = placed.df.select("pos", (F.col("before") + room).alias("limit"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("b"))
    latest = ends.withColumn("b", F.floor((F.col("end")) / most))
    steps = reach.join(latest.select("b", "end", F.col("pos").alias("p2")), "b", "left").where("end IS NULL OR end <= limit").groupBy("pos").agg(F.max("p2").alias("last"))
    jump = durable(placed.df.select("pos").join(steps, "pos", "left").select("pos", (F.greatest(F.coalesce("last", "pos"), "pos") + 1).alias("next")))
    starts = durable(placed.df.where("pos = 0").select("pos"))
    while True:
        ahead = starts.df.join(jump.df, "pos").select(F.col("next").alias("pos")).join(placed.df.select("pos"), "pos").join(starts.df, "pos", "left_anti")
        ahead = durable(ahead)
        if not ahead.df.limit(1).count():
            break
        starts = durable(starts.df.unionByName(ahead.df), drop=(starts, ahead))
        jump = durable(jump.df.join(jump.df.select(F.col("pos").alias("next"), F.col("next").alias("n2")), "next", "left").select("pos", F.coalesce("n2", "next").alias("next")), drop=(jump,))
    marked = placed.df.join(starts.df.withColumn("opens", F.lit(1)), "pos", "left").select("file_path", "lines", F.coalesce("opens", F.lit(0)).alias("opens"))
    return running(marked, "file_path", F.col("opens"), "part").select("file_path", "lines", (F.col("part") + F.col("opens") - 1).cast("bigint").alias("part"))


_SYMBOL = r"^(S\d+) (\w+)/(\w+) L(\d+)(?:-L(\d+))?(?: (.*?))?(?: \{([^{}]*)\})?$"


def read_lines(lines: DataFrame) -> DataFrame:
    """(sid, category, kind, start, end, signature, properties) of symbol lines: the reader of ``symbol_lines``."""
    part = lambda k: F.regexp_extract("line", _SYMBOL, k)
    start = part(4).cast("int")
    return lines.where(F.col("line").rlike(_SYMBOL)).select(
        part(1).alias("sid"), part(2).alias("category"), part(3).alias("kind"), start.alias("start"),
        F.coalesce(F.when(part(5) != "", part(5).cast("int")), start).alias("end"), part(6).alias("signature"), part(7).alias("properties"))


def guard_output(folder: str, suffix: str, clean: bool = False) -> None:
    """Refuse a folder that holds files of ``suffix`` from before, or remove them where ``clean``."""
    old = sorted(Path(folder).glob(f"*{suffix}")) if Path(folder).is_dir() else []
    if old and not clean:
        raise FileExistsError(f"{len(old)} {suffix} files in {folder}")
    for f in old:
        f.unlink()


def write_json(df: DataFrame, folder: str, clean: bool = False) -> None:
    df.write.mode("overwrite" if clean else "errorifexists").json(folder)


def write_text(lines: DataFrame, folder: str, clean: bool = False) -> None:
    """Lines (file_path, ord, line) as one folder per part of files, in order within a file."""
    out = lines.repartition("file_path").sortWithinPartitions("file_path", "ord").select("line")
    out.write.mode("overwrite" if clean else "errorifexists").text(folder)


_PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title><body><svg id="g" width="100%" height="900"></svg>
<script>const data = DATA;
const svg = document.getElementById("g"), at = {}, n = data.nodes.length;
data.nodes.forEach((d, i) => { const a = 2 * Math.PI * i / n; at[d.id] = [600 + 400 * Math.cos(a), 450 + 400 * Math.sin(a)]; });
const add = (t, o) => { const e = document.createElementNS("http://www.w3.org/2000/svg", t); for (const k in o) e.setAttribute(k, o[k]); svg.append(e); return e; };
data.edges.forEach(e => at[e.src] && at[e.dst] && add("line", {x1: at[e.src][0], y1: at[e.src][1], x2: at[e.dst][0], y2: at[e.dst][1], stroke: "#bbb"}));
data.nodes.forEach(d => { const c = add("circle", {cx: at[d.id][0], cy: at[d.id][1], r: 4}); c.append(Object.assign(document.createElementNS("http://www.w3.org/2000/svg", "title"), {textContent: d.id})); });
</script></body>"""


def html_page(nodes: DataFrame, edges: DataFrame, limit: int = 5000) -> str:
    """One self-contained page of the graph; for graphs of at most ``limit`` nodes and 4 * limit edges."""
    import json

    ns = [r.asDict() for r in nodes.limit(limit + 1).collect()]
    es = [r.asDict() for r in edges.limit(4 * limit + 1).collect()]
    if len(ns) > limit or len(es) > 4 * limit:
        raise ValueError("too many nodes or edges for one page")
    return _PAGE.replace("DATA", json.dumps({"nodes": ns, "edges": es}).replace("</", "<\\/"), 1)


def analysis_report(spark: SparkSession, sections: dict[str, DataFrame]) -> DataFrame:
    """(section, place, line): titled sections with all their rows in their order; one without rows says so."""
    out = None
    for title, df in sections.items():
        text = df.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in df.columns]).alias("line"))
        placed = durable(text.withColumn("at", F.monotonically_increasing_id())).df
        # the id holds the partition above 33 bits of the row: rows of the partitions before give the place
        part = F.shiftright("at", 33)
        sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
        rows = placed.join(before, part == F.col("part")).select("line", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("place"))
        if sizes.isEmpty():
            rows = spark.createDataFrame([("none detected", 0)], "line string, place int")
        one = rows.select(F.lit(title).alias("section"), "place", "line")
        out = one if out is None else out.unionByName(one)
    return out
