"""Queries that write tables and files and read them back, that follow an order over pages, and that ask in rounds; and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents as A
from ..operators import pages as P
from ..operators import reports as W
from ..operators import traffic as T
from ..operators.tables import shared_folder
from ..sources import trees
from ..sources.document import write_document
from ..sources.elements import json_elements
from ..sources.keyed import KeyedTable
from .projects import read
from .reporting import _F, _findings


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of orders after an upsert and an update."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    orders = read(spark, sf, "orders").select(columns)
    store = KeyedTable.create(orders, _new(spark, "orders"), ["o_orderkey"], 16)
    to = lambda some, status, seq: some.withColumns({"o_orderstatus": F.lit(status), "o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(seq)})
    key = F.col("o_orderkey")
    new = to(orders.where(key % 70 == 0), "N", 1).withColumn("o_orderkey", -1 - key)
    store.upsert(to(orders.where(key % 50 == 0), "X", 1).unionByName(to(orders.where(key % 100 == 0), "Y", 2)).unionByName(new), F.col("seq"))
    store.update(orders.where(key % 30 == 0).select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice")), ["o_orderstatus", "o_totalprice"])
    return store.read()


def _report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of a JSON report, from the one file that it was written to."""
    path = f"{_new(spark, 'report')}.json"
    write_document(W.json_export(_findings(spark, sf), "seq"), path)
    kind = "cwe string, severity string, title string, description string, file string, line bigint, confidence bigint, remediation string, function string"
    return json_elements(spark, path, ("findings",)).select(F.from_json("text", kind).alias("f")).select("f.*")


def _capture(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of a HAR file that pages were written to."""
    pages = read(spark, sf, "pages")
    path = f"{_new(spark, 'capture')}.har"
    header = lambda value: F.struct(F.lit("Cookie").alias("name"), value.alias("value"))
    request = F.struct(F.lit("GET").alias("method"), "url", F.array(header(F.lit("old")), header(F.concat(F.lit("s="), F.col("page_id").cast("string")))).alias("headers"))
    response = F.struct((F.col("page_id") % 3 + 200).alias("status"), F.struct(F.length("html").alias("size"), F.col("html").alias("text")).alias("content"))
    first = pages.agg(F.min("page_id").alias("first"))
    line = F.concat(F.when(F.col("page_id") > F.col("first"), ",").otherwise(""), F.to_json(F.struct(request.alias("request"), response.alias("response"))))
    entries = pages.crossJoin(F.broadcast(first)).select(F.lit(2).alias("part"), F.col("page_id").alias("seq"), F.lit(0).alias("n"), line.alias("line"))  # one row
    once = lambda part, text: first.select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("n"), F.lit(text).alias("line"))
    write_document(once(1, '{"log":{"version":"1.2","pages":[{"id":"p"}],"entries":[').unionByName(entries).unionByName(once(3, "]}}")), path)
    return trees.har(spark, path).select("method", "url", "path", F.col("headers")["Cookie"].alias("cookie"), "status", "size")


def _first_sight(spark: SparkSession, sf: str) -> DataFrame:
    site = F.concat(F.lit("x"), (F.col("page_id") % 3).cast("string"), F.lit(".com"))
    link = lambda n: F.concat(F.lit(' href="https://h'), n.cast("string"), F.lit("."), site, F.lit('/a"'))
    pages = read(spark, sf, "pages").select(site.alias("site"), F.col("page_id").alias("seq"), "url", F.concat(link(F.col("page_id") % 17), link(F.floor(F.col("page_id") / 20))).alias("html"))
    return P.first_sight(pages).withColumn("hosts", F.array_join("hosts", ","))


def _scripts(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda i: F.concat(F.lit('<script src="/s'), F.col("page_id").cast("string"), F.lit(f'-{i:02d}.js"></script>'))
    return read(spark, sf, "pages").select("page_id", F.array_join(P.scripts_read(F.concat(*[tag(i) for i in range(24, -1, -1)]), F.lit("https://a.example/x/y")), ",").alias("scripts"))


def _rounds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Three rounds over documents: a third is found real, a third not, a third is never answered in JSON; half of what all would cost is the budget."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    hooks = docs.select(F.col("doc_id").alias("hook_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 == 0, "verified").otherwise("pending").alias("status"), F.lit(0.25).alias("confidence"))
    raw = ['{"finding": {"title": "x", "is_vulnerable": true}}', '```json\n{"finding": {"is_vulnerable": false}}\n```', "no answer"]
    answers = docs.select((F.col("doc_id") % 3 + 1).cast("int").alias("round"), F.col("doc_id").alias("hook_id"), F.element_at(F.array(*map(F.lit, raw)), (F.col("doc_id") % 3 + 1).cast("int")).alias("raw"), F.col("n_chars").alias("cost"))
    budget = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0] // 2
    return A.audit_rounds(hooks, answers, budget)


def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor(F.col("event_id") / 2)
    signed = F.col("event_id") % 2 == 0
    messages = read(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.lit("GET").alias("method"), F.concat(F.lit("/p"), (n % 300).cast("string")).alias("path"),
        F.when(signed, F.create_map(F.lit("Cookie"), F.lit("a"))).otherwise(F.create_map(F.lit("Accept"), F.lit("x"))).alias("headers"),
        F.when(signed, 200).otherwise(F.element_at(F.array(*map(F.lit, (401, 200, 302, 403, 404))), (n % 5 + 1).cast("int"))).alias("status"), F.lit(None).cast("string").alias("body"),
        F.when(~signed & (n % 4 == 0), "*").otherwise("").alias("cors"),
    )
    return T.traffic_report(messages, "x.example")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stored_upsert": _stored,
        "report_file": _report_file,
        "har_capture": _capture,
        "first_sight": _first_sight,
        "scripts_read": _scripts,
        "audit_rounds": lambda s, d: _rounds(s, d)[0].select("hook_id", "status", "confidence"),
        "audit_spend": lambda s, d: _rounds(s, d)[1],
        "traffic_report": _traffic,
    }


_ROUNDS = """h as (select doc_id, n_chars as n, doc_id % 3 as k, case when doc_id % 7 = 0 then 'verified' else 'pending' end as s0 from documents), g as (select cast(floor((sum(n) // 2) * 0.9::double) as bigint) as gate from h),
c1 as (select *, case when k = 0 then n else 0 end as cost, coalesce(sum(case when k = 0 then n else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from h where s0 = 'pending'),
a1 as (select doc_id, cost, b < gate as asked from c1, g), t1 as (select coalesce(sum(cost) filter (asked), 0) as spent, count(*) filter (asked) as asked, count(*) filter (not asked) as refused from a1),
h1 as (select h.*, case when a1.asked then case when k = 0 then 'verified' else 'analyzing' end else s0 end as s1, coalesce(a1.asked and k = 0, false) as d1 from h left join a1 using (doc_id)),
c2 as (select *, case when k = 1 then n else 0 end as cost, coalesce(sum(case when k = 1 then n else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from h1 where s1 in ('pending', 'analyzing')),
a2 as (select doc_id, cost, b + t1.spent < gate as asked from c2, g, t1), t2 as (select (select spent from t1) + coalesce(sum(cost) filter (asked), 0) as spent, count(*) filter (asked) as asked, count(*) filter (not asked) as refused from a2),
h2 as (select h1.*, case when a2.asked then case when k = 1 then 'false_positive' else 'analyzing' end else s1 end as s2, coalesce(a2.asked and k = 1, false) as d2 from h1 left join a2 using (doc_id)),
c3 as (select *, case when k = 2 then n else 0 end as cost, coalesce(sum(case when k = 2 then n else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from h2 where s2 in ('pending', 'analyzing')),
a3 as (select doc_id, cost, b + t2.spent < gate as asked from c3, g, t2), t3 as (select (select spent from t2) + coalesce(sum(cost) filter (asked), 0) as spent, count(*) filter (asked) as asked, count(*) filter (not asked) as refused from a3)"""


def oracle_sql() -> dict[str, str]:
    step = lambda i, text: f"select 4 as part, place as seq, {i} as n, {text} as line from f"
    return {
        "stored_upsert": """with c as (select o_orderkey, case when o_orderkey % 100 = 0 then 'Y' when o_orderkey % 50 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 30 = 0 then 0.0::double when o_orderkey % 50 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders)
select * from c union all select -1 - o_orderkey, 'N', o_totalprice + 1 from orders where o_orderkey % 70 = 0""",
        "report_file": f"with {_F} select coalesce(cwe, 'CWE-0') as cwe, coalesce(severity, 'info') as severity, coalesce(title, '') as title, coalesce(description, '') as description, coalesce(file_path, '') as file, cast(coalesce(line_start, 0) as bigint) as line, cast(coalesce(confidence, 50) as bigint) as confidence, coalesce(remediation, '') as remediation, coalesce(func_name, '') as function from f",
        "har_capture": "select 'GET' as method, url, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) as path, 's=' || cast(page_id as varchar) as cookie, cast(page_id % 3 + 200 as int) as status, cast(length(html) as bigint) as size from pages",
        "first_sight": """with p as (select 'x' || cast(page_id % 3 as varchar) || '.com' as site, page_id, url from pages), s as (select site, page_id, url, unnest(list_distinct(['h' || cast(page_id % 17 as varchar) || '.' || site, 'h' || cast(page_id // 20 as varchar) || '.' || site])) as host from p),
f as (select site, host, min(page_id) as seq from s group by 1, 2) select f.site, f.seq, p.url, count(*) as n, array_to_string(list_sort(list(host)), ',') as hosts from f join p on f.seq = p.page_id group by 1, 2, 3""",
        "scripts_read": "select page_id, array_to_string([ 'https://a.example/s' || cast(page_id as varchar) || '-' || lpad(cast(i as varchar), 2, '0') || '.js' for i in range(20)], ',') as scripts from pages",
        "audit_rounds": f"with {_ROUNDS} select doc_id as hook_id, case when a3.asked then 'analyzing' else s2 end as status, case when d1 then 0.5::double when d2 then 0.0::double else 0.25::double end as confidence from h2 left join a3 using (doc_id)",
        "audit_spend": f"with {_ROUNDS} select cast(1 as int) as round, asked, refused, cast(spent as bigint) as spent from t1 union all select 2, asked, refused, cast(spent as bigint) from t2 where asked + refused > 0 union all select 3, asked, refused, cast(spent as bigint) from t3 where asked + refused > 0",
        "traffic_report": f"""with m as (select event_id as seq, (event_id // 2) as n, event_id % 2 = 0 as signed from events), a as (select n % 300 as p, arg_max(n, seq) as n from m where not signed group by 1),
d as (select m.seq, a.p, [401, 200, 302, 403, 404][a.n % 5 + 1] as st, a.n % 4 = 0 as cors from m join a on m.n % 300 = a.p where signed),
f as (select *, '/p' || cast(p as varchar) as path, st in (200, 404) as open, row_number() over (order by case when st in (200, 404) then 1 else 2 end, seq) as place from d where st in (200, 404) or cors),
c as (select (select count(*) from m where signed) as a, (select count(*) from m where not signed) as b, (select count(*) from f) as c),
o as (select unnest([{{'part': 1, 'n': 0, 'line': '[TRAFFIC_DIFF] target: x.example'}}, {{'part': 1, 'n': 1, 'line': '  Signed-in requests: ' || cast(a as varchar)}}, {{'part': 1, 'n': 2, 'line': '  Anonymous requests: ' || cast(b as varchar)}}, {{'part': 1, 'n': 3, 'line': ''}}, {{'part': 1, 'n': 4, 'line': '  Differences: ' || cast(c as varchar)}}, {{'part': 3, 'n': 0, 'line': ''}}, {{'part': 3, 'n': 1, 'line': '  Guides (' || cast(c as varchar) || '):'}}]) as x from c)
select x.part as part, cast(0 as bigint) as seq, x.n as n, x.line as line from o
union all select 2, place, 0, '    [' || case when open then 'MEDIUM' else 'LOW' end || '] GET ' || path from f
union all select 2, place, 1, '           ' || case when open then 'STATUS_MISMATCH' else 'HEADER_LEAK' end || ': 200 signed in, ' || cast(st as varchar) || ' without...' from f
union all {step(0, "'    [F' || cast(place as varchar) || '] ' || case when open then 'Authentication anomaly: ' else 'To be verified: ' end || path || ' (confidence: ' || case when open then '60' else '30' end || '%)'")}
union all {step(1, "case when open then '      1. Open ' || path || ' in a private window' else '      1. Find out what the endpoint is for' end")}
union all {step(2, "case when open then '      2. Compare the signed-in answer with the anonymous one' else '      2. Judge whether its authentication is as intended' end")}
union all {step(3, "case when open then '      3. Judge whether user or business data leaks' else '      3. Check how it treats its parameters' end")}
union all {step(4, "case when open then '      4. Sensitive fields leak: high' else '      [!] To be verified by hand' end")}
union all {step(5, "'      5. Public configuration only: normal'")} where open
union all {step(6, "'      [!] To be verified by hand'")} where open""",
    }
