"""Filling containers of fixed capacity with texts (problem 8): bounded-space online packing.

Every partition counts tokens and packs as it reads: it keeps ``windows`` open containers, places
an item where it fits best (least space left), and, when none fits, closes the fullest and opens a
new one. Memory is bounded by the number of open windows, whatever the partition holds. What is
still open at the end of all partitions is merged in a second pass over those few containers, in
tasks of ``LEFTOVERS_A_TASK`` of them, so no task ever sees them all at scale.

A text longer than the capacity gives full containers of its own and one remainder; nothing else
is split. Token counts come from a public byte-level tokenizer whose file is a parameter; it is
read once per Python worker and never copied.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import durable

CAPACITY = 2048
WINDOWS = 256
LEFTOVERS_A_TASK = 50_000
TOKENIZER = os.environ.get("GRAPHLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pre-splitting pattern of that vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, object] = {}
_ROWS = "container string, doc_id bigint, piece int, first_token bigint, n_tokens int, open boolean"


def encoder(path: str):
    """The tokenizer of ``path``, kept for the life of the worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


#: The pre-split pattern ends a piece here, and what follows is split alike with or without what stands before.
_CUT = re.compile(r"(?<=[^\W_])(?=[ \n])")


def token_count(enc, text: str, chunk: int = 200_000) -> int:
    """Tokens of the whole text. A long text is counted in stretches of about ``chunk`` characters that are cut where the pre-split
    pattern cuts anyway (behind a letter or digit, before a space or line end), so the sum is the count of the whole."""
    total, start = 0, 0
    while start < len(text):
        found = _CUT.search(text, start + chunk) if start + chunk < len(text) else None
        end = found.start() if found else len(text)
        total += len(enc.encode_ordinary(text[start:end]))
        start = end
    return total


class Packer:
    """The open windows of one task; ``put`` returns the container of an item, ``closed`` collects full ones."""

    def __init__(self, capacity: int, windows: int, name: Callable[[int], str]) -> None:
        self.capacity, self.windows, self.name = capacity, windows, name
        self.free: list[tuple[int, int]] = []  # (space left, number), sorted
        self.count = 0

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def put(self, size: int) -> str:
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            left, number = self.free.pop(at)
        else:
            if len(self.free) >= self.windows:
                self.free.pop(0)  # the fullest is emitted
            left, number = self.capacity, self.new()
        if left > size:
            bisect.insort(self.free, (left - size, number))
        return self.name(number)


def _pack(capacity: int, windows: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(capacity, windows, lambda n: f"{part}-{n}")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, piece, first = token_count(enc, text), 0, 0
                while left > capacity:
                    out.append((packer.name(packer.new()), doc, piece, first, capacity))
                    left, piece, first = left - capacity, piece + 1, first + capacity
                out.append((packer.put(left), doc, piece, first, left))
            yield _batch(out, set())
        # the open ones are named in a last batch, to be joined by container
        if packer.free:
            rest = [(packer.name(n), None, None, left, None) for left, n in packer.free]
            yield _batch(rest, {r[0] for r in rest})

    return run


def _batch(rows: list[tuple], opened: set) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    arrays.append(pa.array([bool(opened)] * len(rows), pa.bool_()))
    return pa.RecordBatch.from_arrays(arrays, names=["container", "doc_id", "piece", "first_token", "n_tokens", "open"])


def _merge(capacity: int):
    """Best-fit decreasing over the open containers of one task (a bounded number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        items = sorted(((used, name) for b in batches for name, used in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: (-x[0], x[1]))
        packer = Packer(capacity, len(items) + 1, lambda n: f"m{part}-{n}")
        names = [(name, packer.put(used)) for used, name in items]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string())], names=["container", "merged"])

    return run


def pack_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, first_token, n_tokens): every text exactly once.

    Null and empty texts are left out; repeated texts and repeated ids are packed once per row. A
    text longer than ``capacity`` comes in pieces numbered from 0, each from token ``first_token`` on. The sum of
    n_tokens of a container never exceeds ``capacity``. An empty table gives no rows.
    """
    rows = documents.where(F.col(f"`{text}`") != "").select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    placed = durable(rows.mapInArrow(_pack(capacity, windows, tokenizer), _ROWS))
    leftovers = placed.df.where("open").select("container", (F.lit(capacity) - F.col("first_token")).alias("used"))
    n = leftovers.count()
    tasks = max(1, -(-n // LEFTOVERS_A_TASK))
    merged = durable(leftovers.repartition(tasks, F.xxhash64("container")).mapInArrow(_merge(capacity), "container string, merged string"))
    full = placed.df.where("NOT open").join(merged.df, "container", "left")
    return full.select(F.coalesce("merged", "container").alias("container"), "doc_id", "piece", "first_token", "n_tokens")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, share): how much of the capacity of all containers is used."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("share"))

