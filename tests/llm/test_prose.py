"""Texts that are not among the inspected examples: the mixture alone has to tell them apart."""

import random

from graphloom.llm import textstats

NAMES = "Halden Brook, Merrow, Tilling, Oxcombe, Dunmere, Fallow End, Harrowby, Lindley, Quarrel Hill, Stanmoor".split(", ")
VERBS = "was built, was sold, had been closed, was described, has been restored, was found, is known".split(", ")
TAILS = "after the flood of 1911, by the sons of a miller, in the north of the county, because the road had moved, with most of its windows, and it has not been used since".split(", ")


def prose(rnd):
    lines = [f"The {rnd.choice(['church', 'quarry', 'inn', 'ferry'])} of {rnd.choice(NAMES)} {rnd.choice(VERBS)} {rnd.choice(TAILS)}." for _ in range(rnd.randrange(4, 12))]
    return ("\n\n" if rnd.random() < 0.3 else " ").join(lines)


def listing(rnd):
    mark = rnd.choice(["* ", "# ", "- "])
    return "\n".join(f"{mark}{rnd.choice(['', '[['])}{rnd.choice(NAMES)} ({rnd.randrange(1700, 2000)})" for _ in range(rnd.randrange(6, 20)))


def tabular(rnd):
    rows = "\n".join(f"|-\n| {rnd.choice(NAMES)} || {rnd.randrange(99999)} || {rnd.random() * 100:.1f}" for _ in range(rnd.randrange(4, 12)))
    return "{| class=\"wikitable\"\n! Place !! Sheep !! Share\n" + rows + "\n|}"


def junk(rnd):
    return "\n".join(" ".join("".join(rnd.choice("qwertzuiopasdfghjkl") for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(3, 9)))


def test_held_out_texts(spark):
    rnd = random.Random(11)
    kinds = [prose] * 6 + [listing, tabular, junk]
    made = [(n, kinds[n % len(kinds)]) for n in range(540)]
    rows = [(n, f(rnd)) for n, f in made]
    got = {r.doc_id for r in textstats.not_prose(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {n for n, f in made if f is not prose}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
