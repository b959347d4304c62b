"""Crowded sets of fingerprints: the same links, and no table of places goes through the driver."""

import random

from pyspark.sql import functions as F

from verdigris.llm import simhash as S


def test_no_table_of_places_is_broadcast(spark, monkeypatch):
    r, asked, real = random.Random(3), [], S.cut
    near = {0x0123456789ABCDEF ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) for _ in range(200)} | {r.getrandbits(62) for _ in range(50)}
    fps = spark.createDataFrame([(f,) for f in sorted(near)], "fp bigint").groupBy("fp").agg(F.count("*")).select("fp")
    monkeypatch.setattr(S, "cut", lambda df: (asked.append(df), real(df))[1])
    links = S._links(fps, 4, 64)
    found = {tuple(x) for x in links.collect()}
    for df in (*asked, links):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The same components as all pairs within the distance.
    root = {f: f for f in near}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    def parts(pairs):
        root.update({f: f for f in near})
        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {f: top(f) for f in near}

    every = [(a, b) for a in near for b in near if b < a and (a ^ b).bit_count() <= 4]
    assert all((a ^ b).bit_count() <= 4 for a, b in found) and parts(found) == parts(every)
