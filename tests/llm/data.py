"""Small document tables that hold the awkward cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and", "é", "ß!"]
    rows = []
    passage = " ".join(rnd.choices(vocab, k=55))
    for i in range(n):
        kind = i % 10
        words = rnd.choices(vocab, k=rnd.choice([3, 19, 20, 21, 60, 150, 300]))
        if kind in (1, 2) and rows:  # exact and near copies
            words = (rnd.choice([r for r in rows if r[1]])[1]).split(" ")
            if kind == 2 and len(words) > 10:
                words = list(words)
                words[len(words) // 2] = "changed"
        if kind in (3, 4):
            words = words[:30] + passage.split(" ") + words[30:]
        if kind == 5:
            words = ["a", "b"] * 30 + words
        sep = "\n" if kind == 6 else " "
        rows.append((i * 3, sep.join(words), "en", f"s{i % 4}" if i % 7 else None, None))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \t\n ", "en", "s1", 4), (1003, "one", "en", "s2", 3)]
    rows += [(1004, " ".join(rnd.choices(vocab, k=9000)), "en", "s1", None), (None, passage, "en", "s1", None)]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


def frame(spark, rows, partitions=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)
