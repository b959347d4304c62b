"""Folds of keys of all sizes: whole in one row, or composed of ranges."""

import random

import pytest

from verdigris.operators import events as E


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_ranges_compose_to_the_whole(spark, block):
    r = random.Random(block)
    rows = [(k, seq, r.choice(["confirm", "revise", "reject", "retire", "other"])) for k, n in ((1, 400), (2, 30), (3, 1), (None, 120)) for seq in r.sample(range(5000), n)]
    want = {}
    for k, _, d in sorted(rows, key=lambda x: (x[0] or 0, x[1])):
        state, applied, illegal = want.get(k, ("candidate", 0, 0))
        to = {(s, x): t for s, x, t in E.PROFILE_STEPS}.get((state, d))
        want[k] = (to or state, applied + (to is not None), illegal + (to is None))
    r.shuffle(rows)
    got = {x[0]: tuple(x[1:]) for x in E.fold(spark.createDataFrame(rows, "k int, seq int, d string"), "k", "seq", "d", E.PROFILE_STEPS, block=block).collect()}
    assert got == want
