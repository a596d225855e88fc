"""The k most similar vectors of every vector (problem 1): a hash-prefix forest.

Each tree hashes a vector to a string of 64 signs of random projections and keeps all strings of a space as one sorted array, cut
into buckets over the cluster. The rows that share the first x signs with a vector are a block of that array. A search descends
to the longest prefix that anyone shares and then ascends, in all trees by the same number of signs, until the blocks of all
trees together hold ``candidates(n)`` rows; that length is the vector's level. Everything in its blocks is compared by exact
cosine, and what leaves a task is only the best k of a row. A block that reaches over several buckets is searched in
each of them: the vector visits them as a query. No window cuts a block.

Levels are found from sorted arrays of a sample (``SAMPLE`` rows at most, the only thing sent to all tasks): block sizes are the
sample's, scaled up, and exact where the space is smaller than its sample. The sample decides only how far to ascend; every
vector is indexed and searched for.

The number of rows looked at grows with the square root of the space and the number of trees with its logarithm
(``candidates``, ``trees_for``), so work and shuffle grow by n^1.5 log n at most.

Copies of a vector would fill every block, so at most k + 1 of them (those of smallest id) are indexed; every further copy takes
its answer from the first. The trees run one after another, so no more than one tree's shuffle is on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import durable

TREES = 8
BLOCK = 512
REACH = 48
SAMPLE = 16_384
ROWS_A_TASK = 16_384
DEEPEST = 40
_BASE = "id bigint, space string, unit binary, copy binary, words array<bigint>"


def candidates(rows: int) -> int:
    """How many rows the blocks of a vector hold together at least, in a space of ``rows``: REACH times the root."""
    return int(REACH * max(1, rows) ** 0.5)


def trees_for(rows: int) -> int:
    """How many trees a forest with ``rows`` in its largest space has: eight up to 50,000 rows, eight more with every doubling."""
    return TREES + 8 * max(0, int(np.ceil(np.log2(max(rows, 1) / 50_000))))


def usable_vectors(vec: str, length: int | None = None):
    """Condition: not null, of the right length, not all zero, without null or NaN elements."""
    v = F.col(f"`{vec}`")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return good if length is None else good & (F.size(v) == length)


def _hasher(seed: int, trees: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby(batch["vec"].map(len)):
                if width not in planes:
                    planes[width] = np.random.default_rng(seed).standard_normal((width, 64 * trees)).astype(np.float32)
                raw = np.stack(part["vec"].to_numpy()).astype(np.float32)
                unit = raw.astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                bits = (unit.astype(np.float32) @ planes[width]) > 0
                words = np.packbits(bits.reshape(len(part), trees, 64), axis=2).view(">u8")[:, :, 0].astype(np.int64)
                same = np.round(unit, 6) + 0.0
                yield pd.DataFrame({"id": part["id"].to_numpy(), "space": part["space"].to_numpy(), "unit": [u.tobytes() for u in raw], "copy": [xxhash.xxh3_128_digest(s.tobytes()) for s in same], "words": list(words)})

    return run


def block_of(words: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word with the same first ``levels`` signs."""
    rest = np.where(levels == 0, np.uint64(2**64 - 1), (np.uint64(1) << (np.uint64(64) - np.maximum(levels, 1).astype(np.uint64))) - np.uint64(1))
    return words & ~rest, words | rest


class Space:
    """What is known of a space: its rows, and per tree a sorted sample of words and the borders of the buckets."""

    def __init__(self, rows: int, words: np.ndarray, first_bucket: int) -> None:
        self.rows, self.first = rows, first_bucket
        self.words = np.sort(words, axis=0)
        self.buckets = -(-rows // ROWS_A_TASK) if len(words) else 1
        self.borders = self.words[(np.arange(1, self.buckets) * len(words)) // self.buckets]

    def levels(self, words: np.ndarray) -> np.ndarray:
        """The longest prefix at which the blocks of all trees hold enough rows, by bisection; 0 is the whole space."""
        n = len(words)
        if not len(self.words):
            return np.zeros(n, np.int64)  # the sample has none of its few rows: all are one block
        enough = candidates(self.rows) * len(self.words) / self.rows
        low, high = np.zeros(n, np.int64), np.full(n, DEEPEST, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            held = np.zeros(n)
            for t in range(words.shape[1]):
                first, last = block_of(words[:, t], middle)
                held += np.searchsorted(self.words[:, t], last, "right") - np.searchsorted(self.words[:, t], first, "left")
            low, high = np.where(held >= enough, middle, low), np.where(held >= enough, high, middle - 1)
        return low


def _router(spaces):
    """Adds level, and per tree the bucket of the row and the first and last bucket its block reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = spaces.value
        for batch in batches:
            for name, part in batch.groupby("space", sort=False):
                space = known[name]
                words = np.stack(part["words"].to_numpy()).astype(np.int64).view(np.uint64)
                levels = space.levels(words)
                own, low, high = (np.zeros(words.shape, np.int32) for _ in range(3))
                for t in range(words.shape[1]):
                    first, last = block_of(words[:, t], levels)
                    for target, key in ((own, words[:, t]), (low, first), (high, last)):
                        target[:, t] = space.first + np.searchsorted(space.borders[:, t], key, "right")
                yield part.assign(level=levels.astype(np.int32), own=list(own), low=list(low), high=list(high))

    return run


_FOUND = pa.schema([("space", pa.string()), ("id", pa.int64()), ("others", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])


def _vectors(column: pa.Array) -> np.ndarray:
    """The equally long vectors of a binary column as one matrix, without a loop over rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), -1)


def _search(k: int, at_least: float):
    """Kernel over the buckets of a tree: (space, id) -> the best k of what the buckets hold of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        rows = pa.Table.from_batches(whole)
        codes = rows.column("space").combine_chunks().dictionary_encode().indices.to_numpy()
        bucket = rows.column("bucket").to_numpy()
        by = np.lexsort((codes, bucket))
        rows = rows.take(pa.array(by)).combine_chunks()
        ends = np.flatnonzero(np.append((np.diff(bucket[by]) != 0) | (np.diff(codes[by]) != 0), True)) + 1
        for begin, end in zip([0, *ends[:-1]], ends):
            part = rows.slice(begin, end - begin).to_batches()[0]
            column = lambda name: part.column(part.schema.get_field_index(name))  # noqa: E731, B023
            word = column("word").to_numpy().view(np.uint64)
            level = column("level").to_numpy().astype(np.int64)
            ids, home = column("id").to_numpy(), column("home").to_numpy(zero_copy_only=False)
            unit = _vectors(column("unit")).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            there = np.flatnonzero(home)
            there = there[np.argsort(word[there], kind="stable")]
            if not len(there):
                continue
            held, vectors, names = word[there], unit[there], ids[there]
            low = vectors.astype(np.float32)
            first, last = block_of(word, level)
            left, right = np.searchsorted(held, first, "left"), np.searchsorted(held, last, "right")
            order = np.lexsort((word, level))
            space = column("space")[0].as_py()
            for start in range(0, len(order), BLOCK):
                some = order[start : start + BLOCK]
                a, z = left[some].min(), right[some].max()
                if a >= z:
                    continue
                sims = unit[some].astype(np.float32) @ low[a:z].T
                sims[names[None, a:z] == ids[some, None]] = -2.0
                most = min(4 * k, z - a)
                near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                exact = np.round(np.einsum("ik,ijk->ij", unit[some], vectors[a:z][near]), 6)
                other = names[a:z][near]
                exact[other == ids[some, None]] = -2.0
                best = np.lexsort((other, -exact), axis=1)[:, :k]
                exact, other = np.take_along_axis(exact, best, 1), np.take_along_axis(other, best, 1)
                keep = exact >= max(at_least, -1.5)
                any_kept = keep.any(axis=1)
                offsets = pa.array(np.append(0, np.cumsum(keep[any_kept].sum(1))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (other, exact)]
                yield pa.RecordBatch.from_arrays([pa.array([space] * int(any_kept.sum()), pa.string()), pa.array(ids[some][any_kept]), *lists], schema=_FOUND)

    return run


def forest_neighbours(vectors: DataFrame, k: int = 5, at_least: float = -1.0, seed: int = 7) -> DataFrame:
    """(space, id, other, similarity, place): the k most similar others of the same space.

    ``vectors``: id bigint (unique within its space's family of ids), space string, vec array of
    numbers, all usable (``usable_vectors``) and of one length per space. similarity is the cosine
    rounded to 6 decimals; ties go to the smaller id; pairs below ``at_least`` are left out. Empty
    input gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select("id", "space", F.transform("vec", lambda x: x.cast("float")).alias("vec"))
    sizes = {r[0]: r[1] for r in base.groupBy("space").count().collect()}
    if not sizes:
        return spark.createDataFrame([], "space string, id bigint, other bigint, similarity double, place int")
    trees = trees_for(max(sizes.values()))
    hashed = durable(base.mapInPandas(_hasher(seed, trees), _BASE))
    # Of equal vectors the k + 1 smallest ids are indexed; repeated rows of an id are copies as well.
    crowded = durable(hashed.df.groupBy("space", "copy").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").drop("n"))
    surplus, index = None, hashed
    if crowded.df.limit(1).count():
        marked = hashed.df.join(crowded.df, ["space", "copy"], "left")
        members = durable(marked.where("first IS NOT NULL").groupBy("space", "copy", "id").agg(F.first("first").alias("first"), F.first("unit").alias("unit"), F.first("words").alias("words")))
        narrow = members.df.select("space", "copy", "id", "first", F.pmod(F.xxhash64("id"), F.lit(64)).alias("b"))
        cut = narrow.withColumn("r", F.row_number().over(Window.partitionBy("space", "copy", "b").orderBy("id"))).where(F.col("r") <= k + 1)
        kept = cut.withColumn("r", F.row_number().over(Window.partitionBy("space", "copy").orderBy("id"))).where(F.col("r") <= k + 1).select("space", "id")
        kept = durable(kept)
        surplus = durable(members.df.select("space", "id", "first").join(kept.df, ["space", "id"], "left_anti"))
        alone = marked.where("first IS NULL").select(hashed.df.columns)
        index = durable(alone.unionByName(members.df.join(kept.df, ["space", "id"]).select(hashed.df.columns)), drop=(hashed, members))
    sizes = {r[0]: r[1] for r in index.df.groupBy("space").count().collect()}
    # about SAMPLE rows, whatever the table's size: those whose hash is smallest
    words: dict[str, list] = {n: [] for n in sizes}
    chosen = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / sum(sizes.values())) * (1 << 30)))
    for name, row in index.df.where(chosen).select("space", "words").collect():
        words[name].append(row)
    spaces, bucket = {}, 0
    for name in sorted(sizes):
        spaces[name] = Space(sizes[name], np.array(words[name], np.int64).reshape(-1, trees).view(np.uint64), bucket)
        bucket += spaces[name].buckets
    known = spark.sparkContext.broadcast(spaces)
    routed = durable(index.df.drop("copy").mapInPandas(_router(known), "id bigint, space string, unit binary, words array<bigint>, level int, own array<int>, low array<int>, high array<int>"), drop=(index,))
    tasks = max(1, min(bucket, -(-sum(sizes.values()) // ROWS_A_TASK) * 2))
    lists = []
    for t in range(trees):
        visits = routed.df.select("id", "space", "level", "unit", F.col("words")[t].alias("word"), F.col("own")[t].alias("own"), F.explode(F.sequence(F.col("low")[t], F.col("high")[t])).alias("bucket"))
        tree = visits.select("id", "space", "level", "unit", "word", "bucket", (F.col("own") == F.col("bucket")).alias("home")).repartition(tasks, "bucket")
        lists.append(durable(tree.mapInArrow(_search(k, at_least), "space string, id bigint, others array<bigint>, sims array<double>")))
        spark._jvm.System.gc()  # lets Spark remove the finished tree's shuffle files
    routed.drop()
    merged = None
    for found in lists:
        one = found.df.select("space", "id", F.transform(F.arrays_zip("others", "sims"), lambda x: F.struct((-x["sims"]).alias("s"), x["others"].alias("o"))).alias("near"))
        merged = one if merged is None else merged.unionByName(one)
    # at most TREES * k rows of an id meet here, and each tree's list of it is short
    best = merged.groupBy("space", "id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    if surplus is not None:
        best = durable(best).df
        own = F.array(F.struct(F.lit(-1.0).alias("s"), F.col("first").alias("o")))
        answers = best.select("space", F.col("id").alias("first"), "near")
        more = surplus.df.join(answers, ["space", "first"], "left").select("space", "id", F.slice(F.array_sort(F.concat(own, F.coalesce("near", F.array().cast(best.schema["near"].dataType)))), 1, k).alias("near"))
        best = best.unionByName(more)
    return best.select("space", "id", F.posexplode("near").alias("p", "x")).select("space", "id", F.col("x.o").alias("other"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).alias("place"))
