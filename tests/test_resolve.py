import random

import pytest
from pyspark.sql import functions as F

import model
from textwarden.operators.resolve import (overlap_groups, ranked, resolve_table, survivors)
from textwarden.operators.scan import FINDINGS, FINDING

CASES = [
    ([(0, 10, .7), (5, 15, .9)], [(5, 15, .9)]),
    ([(0, 10, .9), (5, 15, .9)], [(0, 10, .9)]),
    ([(0, 10, .9), (10, 20, .7)], [(0, 10, .9), (10, 20, .7)]),
    ([(0, 10, .6), (5, 15, .9), (12, 20, .7)], [(5, 15, .9)]),
    ([(0, 10, .9), (5, 15, .7), (12, 20, .6)], [(0, 10, .9), (12, 20, .6)]),
    ([(0, 40, .7), (5, 10, .7), (20, 30, .8), (32, 38, .6)], [(20, 30, .8), (32, 38, .6)]),
]


def random_lists(n, seed=3):
    rng = random.Random(seed)
    lists = []
    for _ in range(n):
        rows = []
        for _ in range(rng.randint(0, 12)):
            start = rng.randint(0, 60)
            rows.append((start, start + rng.randint(1, 15), rng.choice([.6, .7, .8, .9])))
        lists.append(rows)
    return lists


def as_rows(lists):
    """(id, source, rule_ord, start, end, conf): scan order is by source then rule."""
    return [(i, 1, k, s, e, c) for i, rows in enumerate(lists) for k, (s, e, c) in enumerate(rows)]


def finding_table(spark, lists):
    df = spark.createDataFrame(as_rows(lists), "id bigint, source int, rule_ord int, "
                               "start_pos bigint, end_pos bigint, confidence double")
    return df.select("id", F.expr(
        f"cast(struct(source, rule_ord, 't', 'd', confidence, start_pos, end_pos, 'HIGH', '', '', '') "
        f"AS {FINDING})").alias("f")).select("id", "f.*")


def expected(rows):
    return [(s, e, c) for _, s, e, c in model.dedupe([("t", *r) for r in rows])]


def test_survivors(spark):
    lists = [c[0] for c in CASES] + random_lists(400)
    for given, want in CASES:
        assert sorted(expected(given)) == want
    df = finding_table(spark, lists).groupBy("id").agg(F.array_sort(F.collect_list(
        F.struct("rule_ord", F.struct(*[c.split(":")[0] for c in FINDING[7:-1].split(",")]).alias("f"))
    )).alias("x")).select("id", F.expr(f"cast(x.f AS {FINDINGS})").alias("findings"))
    rows = df.select("id", F.expr(survivors("findings")).alias("kept"),
                     F.expr(ranked(survivors("findings"))).alias("best")).collect()
    assert len(rows) == sum(bool(x) for x in lists)
    for r in rows:
        want = sorted(expected(lists[r.id]))
        kept = [(f.start_pos, f.end_pos, f.confidence) for f in r.kept]
        assert kept == want
        assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
        assert [(f.start_pos, f.end_pos, f.confidence) for f in r.best] == sorted(
            want, key=lambda f: -f[2])


@pytest.mark.parametrize("stretch", [1, 7, 1 << 16])
def test_table_form_equals_array_form(spark, stretch, monkeypatch):
    """Also where texts are cut into many stretches."""
    import textwarden.operators.resolve as module
    monkeypatch.setattr(module, "overlap_groups",
                        lambda df, key: overlap_groups(df, key, stretch))
    lists = [c[0] for c in CASES] + random_lists(150, seed=stretch)
    # one text with a long chain of overlaps and many findings
    lists.append([(i * 3, i * 3 + 4, .6 + i % 3 / 10) for i in range(300)])
    got = {}
    table = finding_table(spark, lists)
    for r in resolve_table(table.unionAll(table.where("id % 3 = 0")), "id").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos, r.confidence))
    for i, rows in enumerate(lists):
        assert sorted(got.get(i, [])) == sorted(expected(rows))
