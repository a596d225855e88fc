"""Sums over the shortest paths from every source, by a kernel that holds the links of the graph.

A block of sources goes to a task together with all links, packed into rows of arrays, so the links are shuffled once for each
block. That fits graphs of up to MOST_LINKS links; a larger one is left to the rounds of its caller, which spread the state.
Within a task sources run in batches over the part of the graph that they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import durable

#: Distinct links that a task may hold (24 bytes each, and as much again while they are sorted).
MOST_LINKS = 1 << 22
#: Sources of a batch at most, and its sources times the links that they reach.
BATCH, VISITS = 256, 1 << 21
#: Sources of a block on average, blocks at least where there are more, and links of all blocks together, which bound the number of blocks beyond that.
BLOCK, LEAST, COPIES = 1024, 24, 1 << 24


def _after(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each link out of ``nodes``: the position of its node and its own number."""
    degree = first[nodes + 1] - first[nodes]
    at = np.repeat(np.arange(len(nodes)), degree)
    return at, np.arange(len(at)) + np.repeat(first[nodes] - (np.cumsum(degree) - degree), degree)


class _Links:
    """Links by their source, with room for the state of a batch; the room is left as it was found."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, times: np.ndarray) -> None:
        self.names, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        order = np.argsort(ends[: len(src)], kind="stable")
        self.to, self.times = ends[len(src) :][order], times[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ends[: len(src)], minlength=len(self.names)))])
        self.seen, self.number = np.zeros(len(self.names), bool), np.zeros(len(self.names), np.int64)
        room = max(VISITS, len(self.names))
        self.level, self.mark = np.full(room, -1, np.int32), np.zeros(room, np.int64)
        self.paths, self.delta = np.zeros(room), np.zeros(room)

    def reached(self, starts: np.ndarray) -> np.ndarray:
        """The nodes reached from any of ``starts``, in order."""
        front, found = starts, [starts]
        self.seen[starts] = True
        while len(front):
            step = self.to[_after(self.first, front)[1]]
            front = np.unique(step[~self.seen[step]])
            self.seen[front] = True
            found.append(front)
        found = np.sort(np.concatenate(found))
        self.seen[found] = False
        return found

    def add(self, starts: np.ndarray, paths: bool, sums: np.ndarray, hits: np.ndarray) -> int:
        """Adds the sums of as many of ``starts`` as a batch holds; their number."""
        part = self.reached(starts)
        self.number[part] = np.arange(len(part))
        links = _after(self.first, part)[1]
        first = np.concatenate([[0], np.cumsum(self.first[part + 1] - self.first[part])])
        to, times, size = self.number[self.to[links]], self.times[links], len(part)
        starts = starts[: max(1, VISITS // max(len(links), size))]
        front = np.arange(len(starts)) * size + self.number[starts]
        self.level[front], self.paths[front] = 0, 1.0
        steps, found = [], [front]
        while len(front):
            node = front % size
            at, link = _after(first, node)
            key = (front - node)[at] + to[link]
            new = np.flatnonzero(self.level[key] < 0)
            at, link, key = front[at[new]], link[new], key[new]
            if paths:
                weight = times[link]
                np.add.at(self.paths, key, self.paths[at] * weight)
                steps.append((at, key, weight))
            self.mark[key] = np.arange(len(key))
            front = key[self.mark[key] == np.arange(len(key))]
            self.level[front] = len(found)
            found.append(front)
        keys = np.concatenate(found[1:])
        hits[part] += np.bincount(keys % size, minlength=size)
        if paths:
            for at, key, weight in reversed(steps):
                np.add.at(self.delta, at, self.paths[at] * weight / self.paths[key] * (1 + self.delta[key]))
            sums[part] += np.bincount(keys % size, self.delta[keys], size)
        for x, empty in ((self.level, -1), (self.paths, 0), (self.delta, 0)):
            x[keys] = x[found[0]] = empty
        return len(starts)


def _summed(paths: bool):
    """Kernel: the sums of the sources of a block."""

    def run(table: pa.Table) -> pa.Table:
        src, dst, times, start = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("src", "i8"), ("dst", "i8"), ("times", "f8"), ("start", "?")))
        links = _Links(src, dst, times)
        starts = np.searchsorted(links.names, np.unique(src[start]))
        starts = starts[starts % table["blocks"][0].as_py() == table["block"][0].as_py()]
        sums, hits, done = np.zeros(len(links.names)), np.zeros(len(links.names), np.int64), 0
        while done < len(starts):
            done += links.add(starts[done : done + BATCH], paths, sums, hits)
        some = np.flatnonzero(hits)
        return pa.table({"n": links.names[some], "d": sums[some], "reachers": hits[some]})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = [b.column(k).to_numpy(zero_copy_only=False).astype(kind).tobytes() for k, kind in enumerate(("i8", "i8", "f8", "?"))]
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["src", "dst", "times", "start"])


def path_sums(links: DataFrame, paths: bool = True) -> DataFrame | None:
    """(id, d, reachers) of nodes that another one reaches: the dependencies of all sources on it, and how many they are; None if there are too many links.

    ``links``: a written table of distinct src, dst with m, the number of parallel edges, and start, whether paths from src count;
    no src is its dst. Without ``paths`` d is 0.
    """
    n = links.count()
    if n > MOST_LINKS:
        return None
    if not n:
        return links.select(F.col("src").alias("id"), F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("reachers"))
    ids = durable(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("n", F.monotonically_increasing_id())).df
    numbered = links.join(ids.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(ids.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst")
    packed = durable(numbered.select("s", "t", F.col("m").cast("double"), "start").mapInArrow(_packed, "src binary, dst binary, times binary, start binary")).df
    starts = links.where("start").select("src").distinct().count()
    blocks = max(1, min(-(-starts // BLOCK), max(LEAST, COPIES // n)))
    every = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("blocks", F.lit(blocks))
    parts = durable(every.repartition(blocks, "block").groupBy("block").applyInArrow(_summed(paths), "n bigint, d double, reachers bigint")).df
    return parts.groupBy("n").agg(F.sum("d").alias("d"), F.sum("reachers").alias("reachers")).join(ids, "n").select("id", "d", "reachers")
