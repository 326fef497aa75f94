"""The sweep over nested intervals against a plain search, and against the parsers."""

import random

import pytest
from vigilake.operators import calls, intervals
from vigilake.plans.projects import FILES


@pytest.mark.parametrize("slab", [3, 17, 1000])
def test_innermost_as_by_a_search(spark, slab):
    rnd = random.Random(slab)
    rows, points = [], []

    def nest(key, a, b, depth):
        rows.append((key, a, b, f"{key}{a}-{b}"))
        while depth < 5 and b - a > 4 and rnd.random() < 0.8:
            c = rnd.randrange(a + 1, b)
            d = rnd.randrange(c, b)
            nest(key, c, d, depth + 1)
            a = d + 1

    for key in "xy":
        for start in (0, 150, 400):
            nest(key, start, start + rnd.randrange(40, 140), 0)
        points += [(key, rnd.randrange(-5, 600), None, f"p{i % 50}") for i in range(200)]
    points += [(None, 5, None, "n"), ("x", None, None, "m"), ("z", 5, None, "z")]
    odd = [(None, 0, 500, "no key"), ("x", 90, 10, "turned"), ("x", None, 9, "no place")]
    df = spark.createDataFrame(rows + points + odd, "key string, at long, last long, name string").repartition(4)
    got = sorted(((r.key, r.at, r.name, r.around and r.around.name) for r in intervals.innermost(df, "key", ["name"], slab).collect()), key=str)

    def inner(key, at):
        around = [r for r in rows if key == r[0] and at is not None and r[1] <= at <= r[2]]
        return max(around, key=lambda r: (r[1], -r[2]))[3] if around else None

    assert got == sorted(((k, at, name, inner(k, at)) for k, at, _, name in points), key=str)
    assert intervals.innermost(df.limit(0), "key", ["name"]).count() == 0


@pytest.mark.parametrize("slab", [1, 5, 20_000])
def test_calls_as_the_parsers_have_them(spark, slab):
    files = spark.createDataFrame([(f"{i}/{f[0]}", f[1]) for i, f in enumerate(FILES)] + [("null.py", None), ("bad.py", "def (")], "path string, content string")
    want = calls.calls(files).drop("language", "snippet")
    got = calls.calls_by_sweep(files, slab)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 20
