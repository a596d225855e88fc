"""Near-duplicate short byte strings (problem 6): pivot distance tables over parity fingerprints.

A string's set of windows is folded to a fingerprint of 256 parity bits. Hamming distance of two
fingerprints is at most the size of the symmetric difference of the sets, and for a Jaccard
similarity s of sets of sizes a and b that size is at most (a + b)(1 - s)/(1 + s). Each string
gets a table of Hamming distances to fixed reference fingerprints (the zero vector, masks of
single segments, and fingerprints of a bounded sample of the strings themselves). By the triangle
inequality the largest coordinate difference of two tables is a lower bound of their distance, so
a pair whose difference exceeds the limit is discarded without loss; survivors are verified on
the strings.

A pivot table alone would have to be compared with every other table. The pairs it is asked about
are therefore those that share some of their rarest windows: two sets of similarity s share at
least m elements of their prefixes, the a - ceil(s * a) + m rarest windows of each (any common
order of windows is right; counts in a fixed table of 2^18 cells make the prefixes selective).
With m = SHARED > 1 a single window in common by chance makes no candidate.

Equal strings are one class throughout; only the last step expands classes to pairs of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import durable

CELLS = 1 << 18
WIDTH = 256
SEGMENTS = 4
REFERENCES = 11
SHARED = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio, odd


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * _ODD
    return v ^ (v >> np.uint64(29))


def windows(data: bytes, step: int, length: int) -> np.ndarray:
    """Distinct 64-bit keys of all ``length``-element windows; an element has ``step`` bytes."""
    raw = np.frombuffer(data, np.uint8 if step == 1 else ">u4").astype(np.uint64)
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    n, key = len(raw) - length + 1, np.zeros(len(raw) - length + 1, np.uint64)
    for k in range(length):
        key = (key << np.uint64(8)) | raw[k : k + n] if step == 1 else _mix(key + raw[k : k + n])
    return np.unique(_mix(key) if step == 1 else key)


def _cells(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            keys = [windows(x, s, length) for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if keys:
                total += np.bincount((np.concatenate(keys) >> np.uint64(46)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    return run


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """256 parity bits of a set of keys; segment k holds the bits of keys whose cell is k modulo SEGMENTS."""
    bit = (keys & np.uint64(WIDTH - 1)).astype(np.int64)
    return (np.bincount(bit, minlength=WIDTH) & 1).astype(np.int8)


def _table(length: int, similarity: float, counts: np.ndarray, references: np.ndarray):
    """Kernel: class -> its prefix windows, size and pivot distances."""
    base = references.astype(np.int32)
    span = WIDTH // SEGMENTS
    masks = np.zeros((SEGMENTS, WIDTH), np.int32)
    for k in range(SEGMENTS):
        masks[k, k * span : (k + 1) * span] = 1
    pivots = np.concatenate([np.zeros((1, WIDTH), np.int32), masks, base])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, prefixes, prints = [], [], [], []
            for cls, x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys = windows(x, s, length)
                n = len(keys)
                take = n - int(np.ceil(similarity * n - 1e-9)) + SHARED
                order = np.lexsort((keys, counts[(keys >> np.uint64(46)).astype(np.int64)]))[:take]
                kept.append(cls), sizes.append(n), prefixes.append(keys[order].view(np.int64)), prints.append(fingerprint(keys))
            f = np.stack(prints).astype(np.int32) if prints else np.zeros((0, WIDTH), np.int32)
            far = f.sum(1)[:, None] + pivots.sum(1)[None, :] - 2 * (f @ pivots.T)
            arrays = [pa.array(kept, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            arrays.append(pa.array(list(far.astype(np.int16)), pa.list_(pa.int16())))
            yield pa.RecordBatch.from_arrays(arrays, names=["cls", "size", "prefix", "far"])

    return run


def _verify(length: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, s = (batch.column(k).to_pylist() for k in range(5))
            keep, last, keys = [], None, None
            for k in range(len(a)):
                if x[k] is not last:
                    last, keys = x[k], windows(x[k], s[k], length)
                other = windows(y[k], s[k], length)
                both = len(np.intersect1d(keys, other, assume_unique=True))
                keep.append(both >= similarity * (len(keys) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similar_classes(texts: DataFrame, similarity: float = 0.70, length: int = 5) -> tuple[DataFrame, DataFrame]:
    """Classes of equal strings and the pairs of classes that are similar.

    ``texts``: (id, part, data binary, step): strings are compared within ``part``; step is the bytes
    an element has (1, or 4 for UTF-32 text). Gives (id, part, cls) for every row, and (a, b), a < b, for every
    pair of different classes whose window sets share at least ``similarity`` of their union.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", F.unhex(F.md5(F.concat(F.encode(F.col("part"), "utf-8"), F.lit(b"\x00"), F.col("step").cast("string").cast("binary"), F.col("data")))))
    keyed = durable(keyed.dropDuplicates(["id", "key"]))
    classes = keyed.df.groupBy("key").agg(F.first("part").alias("part"), F.first("data").alias("data"), F.first("step").alias("step"))
    classes = durable(classes.withColumn("cls", F.monotonically_increasing_id()))
    cells = classes.df.select("data", "step").mapInArrow(_cells(length), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(CELLS, np.int64)  # a table of fixed size, whatever the number of strings
    for cell, n in cells.collect():
        counts[cell] = n
    sample = [bytes(r[0]) for r in classes.df.orderBy("key").limit(REFERENCES).select("data", "step").collect()] if REFERENCES else []
    steps = [r[0] for r in classes.df.orderBy("key").limit(REFERENCES).select("step").collect()]
    prints = [fingerprint(windows(x, s, length)) for x, s in zip(sample, steps)]
    prints += [np.zeros(WIDTH, np.int8)] * (REFERENCES - len(prints))
    table = classes.df.select("cls", "data", "step").mapInArrow(_table(length, similarity, counts, np.stack(prints)), "cls bigint, size int, prefix array<bigint>, far array<smallint>")
    table = durable(table.join(classes.df.select("cls", "part"), "cls"))
    entries = durable(table.df.select("part", "cls", "size", F.posexplode("prefix").alias("at", "window")))
    lonely = entries.df.groupBy("part", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = durable(entries.df.join(lonely, ["part", "window"], "left_semi"), drop=(entries,))
    one = shared.df.select("part", "window", *[F.col(c).alias(f"{c}_a") for c in ("cls", "size", "at")])
    two = shared.df.select("part", "window", *[F.col(c).alias(f"{c}_b") for c in ("cls", "size", "at")])
    sizes = F.col("size_a") + F.col("size_b")
    # what is left of both sets from the shared window on bounds the overlap (positional bound)
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + F.least("at_a", "at_b")
    need = sizes * (similarity / (1 + similarity)) - 1e-9
    near = one.join(two, ["part", "window"]).where((F.col("cls_a") < F.col("cls_b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-9) & (rest >= need))
    pairs = durable(near.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("size_a", "size_b")).alias("least")).where(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(similarity * F.col("least") - 1e-9))).select("a", "b"), drop=(shared,))
    # the pivot tables discard pairs before their strings are fetched
    left = pairs.df.join(table.df.select(F.col("cls").alias("a"), F.col("size").alias("size_a"), F.col("far").alias("far_a")), "a")
    tables = left.join(table.df.select(F.col("cls").alias("b"), F.col("size").alias("size_b"), F.col("far").alias("far_b")), "b")
    furthest = F.array_max(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x - y)))
    close = tables.where(furthest <= sizes * ((1 - similarity) / (1 + similarity)) + 1e-9).select("a", "b")
    left = classes.df.select(F.col("cls").alias("a"), F.col("data").alias("x"), "step")
    right = classes.df.select(F.col("cls").alias("b"), F.col("data").alias("y"))
    both = close.join(left, "a").join(right, "b").select("a", "b", "x", "y", "step")
    similar = durable(both.mapInArrow(_verify(length, similarity), "a bigint, b bigint"), drop=(pairs, table))
    members = durable(keyed.df.select("id", "part", "key").join(classes.df.select("key", "cls"), "key").select("id", "part", "cls"))
    return members.df, similar.df


def symbol_strings(symbols: DataFrame) -> DataFrame:
    """(id, part, data, step) of the symbols that take part.

    A body of at least 24 bytes takes part as bytes; a symbol with a null or empty body takes part by its
    signature, lower-cased and without white space, if that has at least 40 characters. Bodies and signatures are
    compared among themselves and within a category (null is one of its own); symbols without id take no part.
    """
    body = F.coalesce(F.octet_length("body_tokens"), F.lit(0))
    named = symbols.where("id IS NOT NULL")
    category = F.coalesce(F.concat(F.lit("c"), F.col("category")), F.lit("-"))
    bodies = named.where(body >= 24).select("id", F.concat(F.lit("body/"), category).alias("part"), F.col("body_tokens").alias("data"), F.lit(1).alias("step"))
    sign = F.regexp_replace(F.lower("signature"), r"(?U)\s+", "")
    signs = named.where(body == 0).select("id", F.concat(F.lit("sign/"), category).alias("part"), sign.alias("s")).where(F.length("s") >= 40)
    return bodies.unionByName(signs.select("id", "part", F.encode("s", "utf-32").alias("data"), F.lit(4).alias("step")))


def similar_pairs(members: DataFrame, similar: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b in byte order: members of similar classes and of one class."""
    left = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = similar.join(left, "a").join(right, "b").select("x", "y")
    inside = members.join(members.groupBy("cls").count().where("count > 1").select("cls"), "cls").select("cls", F.col("id").alias("x"))
    within = inside.join(inside.withColumnRenamed("x", "y"), "cls").where("x < y").select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
