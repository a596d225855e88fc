"""Text documents of a graph as relations: sections with their lines, one document or one per source file, and their reader.

A document has the sections [symbols], [edges] and [errors]; an empty section but the first is left out, and a blank line stands
between sections. Lines carry their place, so writing a document is a sort and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sinks.reports import guard_output, running, symbol_lines, write_text

SECTIONS = ("symbols", "edges", "errors")


def edge_lines(edges: DataFrame) -> DataFrame:
    """(file_path, ord, line) of edges (file_path, src, kind, dst, ord): one line per source and kind, in order of their first edge.

    Targets stand in order of their edges and stay repeated where an edge is.
    """
    groups = edges.groupBy("file_path", "src", "kind").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("x"))
    return groups.select("file_path", "ord", F.concat("src", F.lit(" --"), "kind", F.lit("--> "), F.array_join(F.transform("x", lambda e: e["dst"]), ", ")).alias("line"))


def error_lines(errors: DataFrame) -> DataFrame:
    """(file_path, ord, line) of errors (file_path, reason); a null reason is empty text, rows without a path are left out."""
    return errors.where("file_path IS NOT NULL").select("file_path", F.lit(0).cast("bigint").alias("ord"), F.concat(F.lit("- "), "file_path", F.lit(": "), F.coalesce("reason", F.lit(""))).alias("line"))


def block_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, section, ord, line): the blocks of all files. ``symbols``: with sid, as for ``symbol_lines``; ``edges``: as for ``edge_lines``."""
    heads = symbols.select("file_path").distinct().select("file_path", F.lit("symbols").alias("section"), F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("## "), "file_path").alias("line"))
    own = symbol_lines(symbols).select("file_path", F.lit("symbols").alias("section"), F.col("ord").cast("bigint").alias("ord"), "line")
    return heads.unionByName(own).unionByName(edge_lines(edges).select("file_path", F.lit("edges").alias("section"), F.col("ord").cast("bigint").alias("ord"), "line"))


def inline_document(blocks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(place, line): one document of all blocks, files in order, edges behind all symbols; places from 0."""
    rows = blocks.select("section", "file_path", "ord", "line")
    if errors is not None:
        rows = rows.unionByName(error_lines(errors).select(F.lit("errors").alias("section"), "file_path", "ord", "line"))
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
    rows = rows.select(F.struct(rank.alias("rank"), F.lit(1).alias("part"), "file_path", "ord", "line").alias("key"), "line")
    nothing, before = F.lit("").alias("file_path"), F.lit(-2).cast("bigint").alias("ord")
    present = rows.select(F.col("key.rank").alias("rank")).distinct().unionByName(rows.sparkSession.createDataFrame([(1,)], "rank int")).distinct()
    title = F.concat(F.lit("["), F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("rank")), F.lit("]"))
    heads = present.select("rank", F.explode(F.array(F.struct(F.lit(-1).alias("part"), F.lit("").alias("line")), F.struct(F.lit(0).alias("part"), title.alias("line")))).alias("h")).where("rank > 1 OR h.part = 0")
    heads = heads.select(F.struct("rank", F.col("h.part").alias("part"), nothing, before, F.col("h.line").alias("line")).alias("key"), F.col("h.line").alias("line"))
    # equal rows have equal keys and lines, so their order among each other does not show
    keyed = rows.unionByName(heads).withColumn("nth", F.monotonically_increasing_id()).select(F.struct("key", "nth").alias("key"), "line")
    return running(keyed, "key", F.lit(1), "place").select("place", "line")


def tree_documents(blocks: DataFrame, suffix: str = ".map", most: int = 500) -> DataFrame:
    """(document, part, place, line): one document per source file, in parts of at most ``most`` lines (more than 3), numbered from 0.

    A part takes symbol lines first and edge lines into the room they leave, if there is room for more than the section's head;
    every part has its own [symbols] head. Which part and place a line has follows from its number in its block.
    """
    if most < 5:
        raise ValueError("a part needs room for two heads and a line")
    order = Window.partitionBy("file_path", "section").orderBy("ord", "line")
    rows = blocks.withColumn("k", F.row_number().over(order) - 1)
    sizes = blocks.groupBy("file_path").agg(F.count_if(F.col("section") == "symbols").alias("s"), F.count_if(F.col("section") == "edges").alias("e"))
    s, e, k = F.col("s"), F.col("e"), F.col("k")
    whole = 1 + s + F.when(e > 0, e + 2).otherwise(0) <= most
    last = F.greatest(F.ceil(s / (most - 1)) - 1, F.lit(0))
    rest = s - last * (most - 1)
    room = F.when(whole, e).otherwise(F.when(rest + 3 < most, most - 3 - rest).otherwise(0))
    symbol = F.when(whole, F.struct(F.lit(0).cast("bigint").alias("part"), (k + 1).cast("bigint").alias("place"))).otherwise(F.struct(F.floor(k / (most - 1)).alias("part"), (k % (most - 1) + 1).cast("bigint").alias("place")))
    first = k < room
    part = F.when(whole, F.lit(0).cast("bigint")).when(first, last).otherwise(last + 1 + F.floor((k - room) / (most - 3)))
    place = F.when(whole | first, F.when(whole, s).otherwise(rest) + 3 + k).otherwise((k - room) % (most - 3) + 3)
    edge = F.struct(part.alias("part"), place.cast("bigint").alias("place"))
    placed = rows.join(sizes, "file_path").withColumn("at", F.when(F.col("section") == "symbols", symbol).otherwise(edge)).select("file_path", "section", "at.*", "line")
    heads = placed.groupBy("file_path", "part").agg(F.min(F.when(F.col("section") == "edges", F.col("place"))).alias("edge"))
    nul = F.lit(None).cast("bigint")
    titles = heads.select("file_path", "part", F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("place"), F.lit("[symbols]").alias("line")), F.struct(F.coalesce(F.col("edge") - 2, nul).alias("place"), F.lit("").alias("line")), F.struct(F.coalesce(F.col("edge") - 1, nul).alias("place"), F.lit("[edges]").alias("line")))).alias("h"))
    titles = titles.select("file_path", "part", "h.*").where("place IS NOT NULL")
    document = F.concat("file_path", F.lit(suffix))  # with its extension: a.c and a.h are two documents
    return placed.select("file_path", "part", "place", "line").unionByName(titles).select(document.alias("document"), "part", "place", "line")


def read_document(lines: DataFrame) -> DataFrame:
    """(document, place, section, file_path, line): content lines of (document, place, line) with the section and file they stand in.

    Both are carried forward from the last head above; blank lines and heads are left out. A document is bounded by its writer's
    line limit, so a window per document holds no unbounded group.
    """
    text = F.trim("line")
    head = F.regexp_extract(text, r"^\[(dict|symbols|edges|errors)\]$", 1)
    path = F.regexp_extract(text, r"^## (.*)$", 1)
    above = Window.partitionBy("document").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_h", F.when(head != "", head)).withColumn("_f", F.when(path != "", path))
    rows = rows.withColumn("section", F.last("_h", True).over(above)).withColumn("file_path", F.when(F.col("section") == "symbols", F.last("_f", True).over(above)))
    return rows.where("_h IS NULL AND _f IS NULL AND trim(line) <> ''").select("document", "place", "section", "file_path", "line")


def _number(column: str) -> Column:
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def hotspot_lines(entries: DataFrame) -> DataFrame:
    """(file, line) of hotspot entries; numbers that are null or NaN print as 0, a missing date as a dash."""
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in ("commits", "churn", "transitive_in")]
    day = F.coalesce(F.date_format("last_changed", "yyyy-MM-dd"), F.lit("-"))
    shape = "score=%.3f history=%.3f structure=%.3f commits=%d churn=%d transitive_fan_in=%d pagerank=%.6f betweenness=%.6f last_changed=%s | %s"
    return entries.select("file", F.format_string(shape, _number("score"), _number("history_score"), _number("structure_score"), *counts, _number("pagerank"), _number("betweenness"), day, F.col("file")).alias("line"))


def coupling_lines(couplings: DataFrame) -> DataFrame:
    """(left, right, line) of temporal couplings (left, right, n, strength)."""
    return couplings.select("left", "right", F.format_string("strength=%.3f cochanges=%d %s <-> %s", F.col("strength"), F.col("n"), F.col("left"), F.col("right")).alias("line"))


def duplicate_lines(pairs: DataFrame) -> DataFrame:
    """(line) of scored pairs (similarity, left, right), with the cosine where there is one."""
    start = F.format_string("similarity:%d%%", F.col("similarity").cast("int"))
    middle = F.when(F.col("cosine").isNotNull(), F.format_string("  cosine:%.2f", F.col("cosine"))).otherwise("") if "cosine" in pairs.columns else F.lit("")
    return pairs.select(F.concat(start, middle, F.lit("  "), "left", F.lit(" <-> "), "right").alias("line"))


def emit(blocks: DataFrame, folder: str, form: str = "flat", errors: DataFrame | None = None, clean: bool = False, most: int = 500) -> None:
    """Write a graph: ``inline`` as one document, ``flat`` file by file, ``tree`` in parts per source file, ``json`` as rows."""
    if form == "inline":
        write_text(inline_document(blocks, errors).select(F.lit("all").alias("file_path"), F.col("place").alias("ord"), "line"), folder, clean)
    elif form == "tree":
        rows = tree_documents(blocks, most=most).select(F.concat_ws("#", "document", "part").alias("file_path"), F.col("place").alias("ord"), "line")
        rows.repartition("file_path").sortWithinPartitions("file_path", "ord").write.partitionBy("file_path").mode("overwrite" if clean else "errorifexists").text(folder)
    elif form == "flat":
        order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
        write_text(blocks.withColumn("ord", order * F.lit(1 << 40) + F.col("ord")), folder, clean)
    elif form == "json":
        blocks.write.mode("overwrite" if clean else "errorifexists").json(folder)
    else:
        raise ValueError(f"unknown form {form}")


__all__ = ["block_lines", "coupling_lines", "duplicate_lines", "edge_lines", "emit", "error_lines", "guard_output", "hotspot_lines", "inline_document", "read_document", "tree_documents"]
