"""How many near vectors of a large space lie in the blocks a vector is searched in (no Spark: the forest's own words and levels)."""

import numpy as np
import pytest

from graphloom.llm import forest


@pytest.mark.parametrize(("rows", "cosine", "least"), [(60_000, 0.7, 0.85), (60_000, 0.8, 0.95), (300_000, 0.7, 0.88)])
def test_recall_in_a_large_space(rows, cosine, least):
    trees, family, part, rng = forest.trees_for(rows), 6, 60_000, np.random.default_rng(5)
    planes = rng.standard_normal((128, 64 * trees)).astype(np.float32)
    words = np.empty((rows, trees), np.uint64)
    for at in range(0, rows, part):
        centre = rng.standard_normal((part // family, 128)).astype(np.float32).repeat(family, 0)
        bits = (np.float32(cosine**0.5) * centre + np.float32((1 - cosine) ** 0.5) * rng.standard_normal((part, 128)).astype(np.float32)) @ planes > 0
        words[at : at + part] = np.packbits(bits.reshape(part, trees, 64), axis=2).view(">u8")[:, :, 0]
    space = forest.Space(rows, words[rng.choice(rows, forest.SAMPLE, replace=False)].copy(), 0)
    queries = rng.choice(rows, 300, replace=False)
    levels, found = space.levels(words[queries]), 0
    for q, level in zip(queries, levels):
        mates = [x for x in range(q // family * family, q // family * family + family) if x != q]
        ends = [forest.block_of(words[q : q + 1, t], np.array([level])) for t in range(trees)]
        found += sum(any(low[0] <= words[x, t] <= high[0] for t, (low, high) in enumerate(ends)) for x in mates)
    assert found >= least * 5 * len(queries)
    held = sum(((words[:, t] >= low) & (words[:, t] <= high)).sum() for t in range(trees) for low, high in [[x[0] for x in forest.block_of(words[queries[:1], t], levels[:1])]])
    assert held < 4 * forest.candidates(rows)
