"""JSON arrays cut by byte ranges against the json module."""

import json
import random

import pytest
from vigilake.sources import elements, trees


def values(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rnd.choice(["", "a}b", '"{', "\\", "é}]", '\\"}', "[{", "x" * rnd.randrange(40), "},{", "\n\t"])
    if kind == 2:
        return rnd.choice([1, 2.5, None, True])
    if kind == 3:
        return []
    if kind == 4:
        return [values(rnd, depth + 1) for _ in range(rnd.randrange(3))]
    return {rnd.choice(["entries", "k}", "log", 'q"', "results"]) + str(i) * rnd.randrange(2): values(rnd, depth + 1) for i in range(rnd.randrange(4))}


def document(rnd, keys, n):
    entry = lambda i: {"i": i, "v": values(rnd), "w": {"x": [values(rnd)]}}
    array = [e for i in range(n) for e in ([entry(i)] if rnd.random() < 0.9 else [7, entry(i), [{"no": 1}]])]
    before, after = {"creator": {"name": "}", "o": {"p": {}}}, "pages": [{"id": 1}, {"id": {}}]}, {"comment": {"a": {"b": {}, "c": {}}}, "other": [{"z": 1}, {"z": 2}]}
    body = before | {keys[-1]: array} | after
    for k in reversed(keys[:-1]):
        body = {"version": {"q": {"r": {}}}, k: body, "end": {"s": {"t": {}}}}
    return body, [e for e in array if isinstance(e, dict)]


@pytest.mark.parametrize("keys", [("log", "entries"), ("messages",), ("a", "b", "results")])
def test_elements_as_by_the_json_module(spark, tmp_path, keys):
    rnd = random.Random(len(keys))
    want = {}
    for f in range(5):
        body, mine = document(rnd, keys, rnd.choice([0, 1, 7, 60]))
        text = json.dumps(body, indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
        (tmp_path / f"f{f}.json").write_text(text + rnd.choice(["", "\n"]))
        want[f"f{f}.json"] = mine
    (tmp_path / "g.json").write_text("")
    (tmp_path / "h.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "300b", "37b"):  # down to ranges of less than an element
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b")
            rows = elements.json_elements(spark, str(tmp_path), keys).collect()
            assert len({r.seq for r in rows}) == len(rows)
            got = {name: [] for name in want}
            for r in sorted(rows, key=lambda r: r.seq):
                got[r.file.rpartition("/")[2]].append(json.loads(r.text))
            assert got == want
            assert [r.file for r in sorted(rows, key=lambda r: r.seq)] == sorted(r.file for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"log": {"entries": [{"request": {"method": "GET", "url": f"https://a.b/{i}"}, "response": {"status": 200}} for i in range(2000)]}}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        raw = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert raw.rdd.getNumPartitions() > 5
        rows = trees.har(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.path for r in rows] == [f"/{i}" for i in range(2000)]


def test_documents_that_are_cut_off(spark, tmp_path):
    whole = json.dumps({"log": {"entries": [{"i": i} for i in range(5)]}})
    for i, cut in enumerate((len(whole) - 8, 30, 3)):
        (tmp_path / f"{i}.json").write_text(whole[:cut])
    assert [r.text for r in elements.json_elements(spark, str(tmp_path), ("log", "entries")).orderBy("seq").collect()][:4] == [f'{{"i": {i}}}' for i in range(4)]
