from pyspark.sql import functions as F
from vigilake.operators import claims, pages


def test_script_urls(spark):
    html = """<script src="/a.js"></script><SCRIPT async src='b.js'></script><script src="//c.example/c.js"></script><script src="https://d.example/d.js"></script><script src="/a.js"></script>"""
    rows = [(html, "https://h.example:8/x/y.html?q=/z"), (html, "http://h.example"), ("", "http://h.example"), (None, None)]
    got = [r.u for r in spark.createDataFrame(rows, "html string, base string").select(pages.script_urls(F.col("html"), F.col("base")).alias("u")).collect()]
    far = ["https://c.example/c.js", "https://d.example/d.js"]
    assert got == [sorted([*far, "https://h.example:8/a.js", "https://h.example:8/x/b.js"]), sorted([*far, "http://h.example/a.js", "http://h.example/b.js"]), [], None]


def test_headers_ignore_case_and_empty_maps(spark):
    df = spark.sql("select map('x-FRAME-options', '1') as h union all select cast(map() as map<string, string>)")
    assert [len(r.m) for r in df.select(pages.missing_headers(F.col("h")).alias("m")).collect()] == [5, 6]


def test_file_claims_trim_names(spark):
    found = spark.createDataFrame([(1, "path ' conf0.yml'"), (2, None), (3, "see 'app.py'")], "id long, text string")
    got = claims.file_claims(found, spark.createDataFrame([("app.py",)], "name string")).collect()
    assert {tuple(r) for r in got} == {(1, "conf0.yml")} and len(got) == 2  # named in two ways
    assert claims.file_claims(found.limit(0), found.select(F.col("text").alias("name"))).count() == 0
