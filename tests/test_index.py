"""The index of a tree that follows its files by digests of folders."""

import os

from vigilake.sources import trees
from vigilake.streaming import index

SCHEMA = "path string, modified timestamp, variables array<string>, imports array<string>"


def write(root, name, text, at=1_700_000_000):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (at, at))


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    for d in range(30):
        for f in range(4):
            write(root, f"d{d % 6}/e{d}/f{f}.py", f"import m{d}_{f}\n")
    write(root, "top.py", "import os\n")
    write(root, "d0/odd [x]{y}.py", "import re\n")
    empty = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "folder string, own string, whole string")
    asked = []
    tree = trees.whole_tree
    monkeypatch.setattr(index, "whole_tree", lambda s, r, named=None: (asked.append(named), tree(s, r, named))[1])
    now = lambda i: {r.path: tuple(r.imports) for r in i.collect()}
    first, digests, read = index.sync(spark, str(root), *empty)
    assert read.count() == 122 and now(first)["top.py"] == ("os",) and now(first)["d0/odd [x]{y}.py"] == ("re",) and len(now(first)) == 122
    same, again, read = index.sync(spark, str(root), first, digests)
    assert read.count() == 0 and now(same) == now(first) and sorted(map(tuple, again.collect())) == sorted(map(tuple, digests.collect())) and asked[-1] == []
    write(root, "d2/e8/f1.py", "import changed\n", 1_700_000_100)
    write(root, "d2/new/g.js", "require('x')")
    os.remove(root / "d3/e9/f0.py")
    for f in range(4):
        os.remove(root / f"d5/e29/f{f}.py")  # a whole folder
    third, later, read = index.sync(spark, str(root), same, again)
    assert sorted(asked[-1]) == ["d2/e8/f1.py", "d2/new/g.js"] and sorted(r.path for r in read.collect()) == sorted(asked[-1])
    want = now(first) | {"d2/e8/f1.py": ("changed",), "d2/new/g.js": ("x",)}
    assert now(third) == {p: v for p, v in want.items() if (root / p).exists()}
    whole = lambda d: {r.folder: r.whole for r in d.collect()}
    old, new = whole(again), whole(later)
    assert {f for f in old.keys() | new.keys() if old.get(f) != new.get(f)} == {"", "d2", "d2/e8", "d2/new", "d3", "d3/e9", "d5", "d5/e29"}
    monkeypatch.setattr(index, "NAMED", 1)
    fourth, _, read = index.sync(spark, str(root), first, digests)
    assert asked[-1] is None and now(fourth) == now(third) and read.count() == 2


def test_listing_reads_no_content(spark, tmp_path):
    write(tmp_path, "a.py", "x")
    plan = trees.listing(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
