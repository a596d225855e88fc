"""Evaluation texts inside training text (problem 9): a prefix-filtered set join.

A document holds n consecutive words of an item iff some item-sized window (n words, i.e. the
n - 4 five-word shingles in it) is contained in the document in one piece. One pass over the
documents keeps the runs of consecutive shingles that occur in any item and are long enough for a
window (length bound). The runs' shingles are counted over the corpus; each window is represented
by its rarest shingle, the only token its prefix needs for full containment. Documents and windows
are joined on it, placed by its position (positional bound), and verified shingle by shingle.

Items are the small side; they are handed to the tasks in blocks of at most ``BLOCK_WORDS`` words,
one pass over the documents per block, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import durable
from graphloom.llm.rendering import visible, words

SHINGLE = 5
BLOCK_WORDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio, odd


def _shingle_keys(ids: np.ndarray) -> np.ndarray:
    """64-bit key of every five consecutive word numbers; 0 where a word is unknown."""
    if len(ids) < SHINGLE:
        return np.zeros(0, np.uint64)
    n = len(ids) - SHINGLE + 1
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        part = ids[k : k + n]
        known &= part > 0
        key = (key ^ part.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return np.where(known, key, np.uint64(0))


def _runs(vocabulary: dict[str, int], keys: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, last = vocabulary.get, len(keys) - 1
        for batch in batches:
            docs, starts, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([get(w, 0) for w in words(visible(text))], np.int64)
                own = _shingle_keys(ids)
                if len(own) < length:
                    continue
                hit = (own != 0) & (keys[np.minimum(np.searchsorted(keys, own), last)] == own)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for a, b in zip(edges[::2], edges[1::2]):
                    if b - a >= length:
                        docs.append(doc), starts.append(int(a)), found.append(own[a:b].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "start", "run"])

    return run


def _blocks(items: list[tuple[int, list[str]]]) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, at_least: int = 13) -> DataFrame:
    """(doc_id, item_id): the document holds ``at_least`` consecutive words of the item.

    ``documents``: doc_id, text; ``items``: item_id, text. Words are those of ``rendering.words``
    over ``rendering.visible``. Null texts and items of fewer words hold nothing; repeated
    documents each count; every pair comes once. Items are read by the driver (``toLocalIterator``)
    and used in blocks of bounded size.
    """
    spark, length = documents.sparkSession, at_least - SHINGLE + 1
    source = documents.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    wanted = items.where(F.col("item_id").isNotNull() & (F.col("text") != "")).select(F.col("item_id").cast("bigint"), "text")
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint")
    texts = ((r[0], words(visible(r[1]))) for r in wanted.toLocalIterator())
    for block in _blocks([t for t in texts if len(t[1]) >= at_least]):
        vocabulary = {w: n for n, w in enumerate(sorted({w for _, ws in block for w in ws}), 1)}
        windows = []
        for item, ws in block:
            own = _shingle_keys(np.array([vocabulary[w] for w in ws], np.int64)).view(np.int64).tolist()
            windows += [(item, own[o : o + length]) for o in range(len(own) - length + 1)]
        keys = np.unique(np.array([k for _, ks in windows for k in ks], np.int64).view(np.uint64))
        runs = durable(source.mapInArrow(_runs(vocabulary, keys, length), "doc_id bigint, start bigint, run array<bigint>"))
        table = spark.createDataFrame(windows, "item_id bigint, shingles array<bigint>").distinct()
        places = runs.df.select("doc_id", "start", F.posexplode("run").alias("at", "shingle"))
        df = places.groupBy("shingle").agg(F.count("*").alias("df"))
        # the rarest shingle of a window; one that occurs nowhere rules the window out
        seen = table.select("item_id", "shingles", F.posexplode("shingles").alias("offset", "shingle")).join(df, "shingle")
        per = seen.groupBy("item_id", "shingles").agg(F.count("*").alias("n"), F.min(F.struct("df", "shingle", "offset")).alias("rarest"))
        prefix = per.where(F.col("n") == length).select("item_id", "shingles", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset"))
        prefix = durable(prefix)  # no more rows than the block's words
        at = places.join(F.broadcast(prefix.df), "shingle")
        at = at.where((F.col("at") >= F.col("offset"))).select("doc_id", "start", (F.col("at") - F.col("offset")).alias("from"), "item_id", "shingles")
        checked = at.join(runs.df, ["doc_id", "start"]).where((F.col("from") + length <= F.size("run")) & (F.slice("run", F.col("from") + 1, length) == F.col("shingles")))
        out = out.unionByName(checked.select("doc_id", "item_id").distinct())
    return out.distinct()
