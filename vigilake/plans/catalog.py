"""Relational queries over the driver's tables, and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import agents as A
from ..operators import encryption as E
from ..operators import hooks as H
from ..operators import knowledge as N
from ..operators import pages as P
from ..operators import reports as W
from ..operators import store as S
from ..operators import traffic as T
from .audit import read


def _traffic(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = read(spark, sf, "pages")
    p = F.col("page_id")
    same = [p.alias("seq"), F.lit("GET").alias("method"), F.concat(F.lit("/p/"), (p % 97).cast("string")).alias("path")]
    ours = pages.select(*same, F.when(p % 11 == 0, 403).otherwise(200).alias("status"), F.col("html").alias("body"), F.lit("").alias("cors"))
    theirs = pages.select(*same, F.when(p % 5 == 0, 401).when(p % 7 == 0, 500).otherwise(200).alias("status"), F.when(p % 3 == 0, F.col("html")).otherwise("short").alias("body"), F.when(p % 4 == 0, "*").otherwise("").alias("cors"))
    return ours, theirs


_PLAIN = "substr(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 2000)"
_PIECES = "list_distinct(list_transform(generate_series(0, cast(floor((length({0}) - 1) / 50.0) as bigint)), lambda i: substr({0}, cast(i * 50 + 1 as bigint), 50)))"
_TRAFFIC = f"""with ours as (select page_id as seq, 'GET' as method, '/p/' || cast(page_id % 97 as varchar) as path, case when page_id % 11 = 0 then 403 else 200 end as status, {_PLAIN.format('html')} as body, '' as cors from pages),
theirs as (select page_id as seq, 'GET' as method, '/p/' || cast(page_id % 97 as varchar) as path, case when page_id % 5 = 0 then 401 when page_id % 7 = 0 then 500 else 200 end as status,
  case when page_id % 3 = 0 then {_PLAIN.format('html')} else 'short' end as body, case when page_id % 4 = 0 then '*' else '' end as cors from pages),
last as (select * from theirs qualify row_number() over (partition by method, path order by seq desc) = 1),
pairs as (select o.*, l.status as s2, l.body as b2, l.cors as c2, {_PIECES.format('o.body')} as x, {_PIECES.format('l.body')} as y from ours o join last l using (method, path)),
sim as (select *, case when length(body) = 0 or length(b2) = 0 then 0.0 else len(list_intersect(x, y)) / cast(len(list_distinct(list_concat(x, y))) as double) end as likeness from pairs),
kinds as (select *, case when status = 200 and s2 = 200 and length(body) > 0 and length(b2) > 100 and likeness > 0.7 then 'BODY_LEAK' when status = 200 and s2 not in (401, 403, 302) then 'STATUS_MISMATCH'
  when c2 <> cors and contains(c2, '*') then 'HEADER_LEAK' end as diff_type from sim),
found as (select seq, method, path, case diff_type when 'BODY_LEAK' then 'HIGH' when 'STATUS_MISMATCH' then 'MEDIUM' else 'LOW' end as severity,
  cast(case diff_type when 'BODY_LEAK' then 0 when 'STATUS_MISMATCH' then 1 else 2 end as int) as rank, diff_type, status as status_in, s2 as status_anon,
  case diff_type when 'BODY_LEAK' then 80 when 'STATUS_MISMATCH' then 60 else 30 end as guide_score from kinds where diff_type is not null)"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("tokens", F.floor(F.col("value")).cast("long"))


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(F.col("event_type").alias("agent"), F.col("tokens").alias("prompt"), (F.col("tokens") * 2).alias("completion"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.col("props").alias("entity"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return read(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(F.array_sort(found), ",").alias("links"))


def _topk(spark: SparkSession, sf: str) -> DataFrame:
    """Of every twentieth vector the three most similar of all."""
    e = read(spark, sf, "embeddings")
    found = N.similar(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("pid"), F.col("embedding").alias("v")), 3, 0.1)
    return N.listed(found).select("id", "pid", "rank", F.round("score", 6).alias("score"))


_ROLES = {"user": "prosecutor", "assistant": "defender", "system": "jury"}


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair]), F.col("role"))
    raw = F.format_string('Here: {"verdict":"%s","final_score":%d.5,"reasoning":"turn %d"} FINAL_RESULT', F.when(F.col("conv_id") % 2 == 0, "valid").otherwise("invalid"), F.length("text").cast("long"), "turn")
    return A.trials(c.select(F.col("conv_id").alias("finding_id"), F.col("turn").alias("round"), role.alias("role"), raw.alias("raw")))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda c, **names: F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)], F.lit(""), F.lit("")), F.when(F.col(c).isin(*names), F.col(c)).otherwise(""))
    hooks = read(spark, sf, "orders").select(pick("o_orderstatus", O="pending", F="verified").alias("status"))
    findings = read(spark, sf, "lineitem").select(pick("l_returnflag", R="true_positive", A="invalid").alias("verdict"))
    tasks = read(spark, sf, "customer").select(pick("c_mktsegment", BUILDING="queued", MACHINERY="running").alias("status"))
    return S.stats(hooks, findings, tasks, read(spark, sf, "events"))


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    named = F.when(rank == "1", "critical").when(rank == "2", "high").when(rank == "3", "medium").when(rank == "4", "low")
    return H.severity_summary(read(spark, sf, "orders").withColumn("sev", named), "sev")


def _update(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changes = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("o_orderstatus"))
    return S.update(orders, changes, ["o_orderkey"], ["o_orderstatus"])


def _append(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    return S.append(table, read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey")


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    hooks = read(spark, sf, "orders").select(F.col("o_custkey").alias("hook_id"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("func"), "o_orderkey")
    return A.with_hook(read(spark, sf, "customer").select(F.col("c_custkey").alias("hook_id"), "c_name"), hooks, "o_orderkey")


def _of_hooks(spark: SparkSession, sf: str) -> DataFrame:
    findings = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("hook_id"), F.col("o_orderpriority").alias("title"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("severity"),
        F.when(F.col("o_orderkey") % 2 == 0, "CWE-89").alias("cwe_id"), F.when(F.col("o_orderkey") % 3 == 0, "x").alias("poc_code"),
    )
    return A.findings_of_hooks(read(spark, sf, "customer").select(F.col("c_custkey").alias("hook_id")), findings)


#: First lines of PHP files, and the signature that each holds.
_HEADS = ["<?php //0046a ionCube loader", "<?php echo 1;", "<?php eval(base64_decode('x'));", "<?php\n// ionCube on the second line", "@Zend Guard;", "x" * 190 + "php_screw"]


def _encryption(spark: SparkSession, sf: str) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    ending = F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".PHP")
    files = read(spark, sf, "documents").select(F.col("lang").alias("project"), F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), ending).alias("path"), F.concat(head, F.lit("\n"), "text").cast("binary").alias("content"))
    return E.encryption_report(files)


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    path = F.concat(F.when(F.col("user_id") % 3 == 0, "/api/").when(F.col("user_id") % 3 == 1, "/v2/").otherwise("/u/"), (F.col("user_id") % 20).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.upper("event_type").alias("method"), path.alias("bare"), F.concat(path, F.lit("?e="), F.col("event_id").cast("string")).alias("path"), F.col("value"))


def _dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.concat(F.repeat(F.lit("x"), 79), (F.col("user_id") % 7).cast("string"), F.col("props")).alias("title"))
    return P.first_findings(e, "event_id").select("event_id", "category")


def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return S.recent(read(spark, sf, "events").select("ts", "event_id", "event_type"), "ts").select("event_id", "event_type")


def _hooks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "analyzing").otherwise("verified")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("hook_id"), status.alias("status"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("severity"), F.when(F.col("o_custkey") % 2 == 0, "input_source").otherwise("CWE-89").alias("hook_type"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as answers: every second one fails, and all name users."""
    p = F.col("page_id")
    return read(spark, sf, "pages").select(p.alias("id"), F.when(p % 2 == 0, 200).when(p % 3 == 0, 403).otherwise(404).alias("status"), F.concat("html", F.when(p % 5 > 0, ' "userId": 1, "token": 2, phone').otherwise("")).alias("body"))


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    a = _answers(spark, sf)
    told = lambda c: F.array_join(c, ",")
    return a.select("id", told(P.sensitive_fields(F.col("status"), F.col("body"))).alias("large"), told(P.signed_in_fields(F.col("status"), F.col("body"))).alias("signed_in"), P.behind_firewall(F.col("status"), F.col("body")).alias("firewall"))


def _both(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two checks of pages together, equal ones kept."""
    p = read(spark, sf, "pages").select("page_id", "html")
    told = lambda where, name: p.where(where).select("page_id", F.lit(name).alias("found"))
    return told(F.col("html").contains("<script"), "script").unionByName(told(F.col("html").contains("href="), "link")).unionByName(told(F.col("html").contains("href="), "link"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in two: those sure enough, and all others, unknown ones with them."""
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 9 == 0).alias("verified"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey") % 100).alias("confidence"))
    sure, others = W.split(o)
    return sure.withColumn("part", F.lit("sure")).unionByName(others.withColumn("part", F.lit("open"))).select("o_orderkey", "part")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "severity_summary": _severity,
        "db_stats": _stats,
        "table_counts": lambda s, d: S.counts(hooks=read(s, d, "orders"), findings=read(s, d, "lineitem"), patterns=read(s, d, "part")),
        "token_usage": lambda s, d: S.usage(_usage(s, d)),
        "budget_share": lambda s, d: S.budget_share(_usage(s, d), 2_000_000).select("total_tokens", F.round("pct", 6).alias("pct")),
        "budget_gate": lambda s, d: S.budget_gate(_events(s, d).select("user_id", "event_id", "tokens"), "user_id", "event_id", F.col("tokens"), 2000),
        "budget_gate_all": lambda s, d: S.budget_gate(_events(s, d).select("event_id", "tokens"), None, "event_id", F.col("tokens"), 200_000),
        "event_hash_chain": lambda s, d: S.chain_ends(S.hash_chain(_log(s, d), "user_id"), "user_id"),
        "event_hashes": lambda s, d: S.hash_chain(_log(s, d), "user_id"),
        "upsert_hooks": lambda s, d: S.upsert(read(s, d, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], F.col("event_id")),
        "append_ids": _append,
        "list_hooks": lambda s, d: S.listed(read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), o_orderstatus="O", o_orderpriority=None),
        "hook_filter": lambda s, d: H.chosen(_hooks(s, d), status="pending", severity="high", hook_type="input_source"),
        "pending_hooks": lambda s, d: H.pending(_hooks(s, d), 100).select("hook_id"),
        "sensitive_answers": _fields,
        "finding_union": _both,
        "finding_split": _parts,
        "recent_events": _recent,
        "update_status": _update,
        "fk_violations": lambda s, d: S.dangling(read(s, d, "documents").select("doc_id", "source"), read(s, d, "labels"), "doc_id", "doc_id"),
        "finding_hook_lookup": _lookup,
        "findings_of_hooks": _of_hooks,
        "traffic_diff": lambda s, d: T.diff(*_traffic(s, d)),
        "verification_guides": lambda s, d: T.guides(T.diff(*_traffic(s, d))),
        "api_endpoints": lambda s, d: T.api_endpoints(_endpoints(s, d).select("method", F.col("bare").alias("path"))),
        "first_endpoints": lambda s, d: T.first_of_each(_endpoints(s, d).drop("bare")).select("method", "bare", "seq"),
        "first_fifty_endpoints": lambda s, d: T.first_of_each(_endpoints(s, d).drop("bare"), 50).select("method", "bare", "seq"),
        "finding_dedup": _dedup,
        "link_extract": _links,
        "semantic_topk": _topk,
        "trial_rollup": _trials,
        "encryption_report": _encryption,
    }


_E = "(select *, cast(floor(value) as bigint) as tokens from events)"
_SEVERITY = "case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' when '4' then 'low' end"
_EVERY = "(values " + ", ".join(f"('{s}', {i})" for i, s in enumerate(R.SEVERITIES)) + ") e(severity, ord)"
_COS = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})))"
_HEADS_SQL = "[" + ", ".join("'" + h.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for h in _HEADS) + "]"
_LOGGED = "(select user_id, event_id, event_type || '|' || coalesce(props, '') || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') as told from events)"
_ENDPOINTS = "(select event_id, upper(event_type) as method, case user_id % 3 when 0 then '/api/' when 1 then '/v2/' else '/u/' end || cast(user_id % 20 as varchar) as bare from events)"
_SIGNED = "['SourceGuardian', 'php_screw', 'ionCube', 'Zend Guard', 'eval(base64_decode']"


def _said(kind: str, steps: list[str]) -> str:
    return f"when '{kind}' then " + " || chr(10) || ".join("'" + s.replace("{path}", "' || path || '").replace("{method}", "' || method || '") + "'" for s in steps)


def oracle_sql() -> dict[str, str]:
    steps = " ".join(_said(k, v) for k, v in T.STEPS.items())
    return {
        "severity_summary": f"with c as (select {_SEVERITY} as severity, count(*) as n from orders group by 1) select e.severity, cast(ord as int) as ord, coalesce(n, 0) as n from {_EVERY} left join c on e.severity = c.severity",
        "db_stats": "select (select count(*) from orders) as hooks_total, (select count(*) from orders where o_orderstatus = 'O') as hooks_pending, (select count(*) from lineitem) as findings_total, (select count(*) from lineitem where l_returnflag = 'R') as findings_true_positive, (select count(*) from customer where c_mktsegment = 'BUILDING') as tasks_queued, (select count(*) from customer where c_mktsegment = 'MACHINERY') as tasks_running, (select count(*) from events) as events_logged",
        "table_counts": "select 'hooks' as name, count(*) as n from orders union all select 'findings', count(*) from lineitem union all select 'patterns', count(*) from part",
        "token_usage": f"select event_type as agent, cast(sum(tokens) as bigint) as total_prompt, cast(sum(tokens * 2) as bigint) as total_completion from {_E} group by 1",
        "budget_share": f"select cast(sum(tokens * 3) as bigint) as total_tokens, round(sum(tokens * 3) / 2000000.0::double * 100, 6) as pct from {_E}",
        "budget_gate": f"with s as (select user_id, event_id, tokens, cast(coalesce(sum(tokens) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as spent_before from {_E}) select *, spent_before >= 1800 as refused from s",
        "budget_gate_all": f"with s as (select event_id, tokens, cast(coalesce(sum(tokens) over (order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as spent_before from {_E}) select *, spent_before >= 180000 as refused from s",
        "event_hash_chain": f"with g as (select user_id, list(told order by event_id) as l from {_LOGGED} group by 1) select user_id, cast(len(l) as bigint) as n_events, list_reduce(list_prepend(repeat('0', 64), l), lambda h, x: sha256(h || '|' || x)) as last_hash from g",
        "event_hashes": f"with recursive r as (select *, row_number() over (partition by user_id order by event_id) as p from {_LOGGED}), c as (select user_id, event_id, p, sha256(repeat('0', 64) || '|' || told) as hash from r where p = 1 union all select r.user_id, r.event_id, r.p, sha256(c.hash || '|' || r.told) from r join c on r.user_id = c.user_id and r.p = c.p + 1) select user_id, event_id as seq, hash from c",
        "upsert_hooks": "select user_id, event_type, max(event_id) as event_id, arg_max(props, event_id) as props from events group by 1, 2",
        "append_ids": "select cast(s_suppkey as bigint) as id, s_name as name from supplier union all select cast((select max(s_suppkey) from supplier) + row_number() over (order by c_custkey) as bigint), c_name from customer",
        "list_hooks": "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'O'",
        "hook_filter": "select o_orderkey as hook_id, 'pending' as status, 'high' as severity, 'input_source' as hook_type from orders where o_orderstatus = 'O' and o_orderpriority = '2-HIGH' and o_custkey % 2 = 0",
        "pending_hooks": "select o_orderkey as hook_id from orders where o_orderstatus = 'O' order by 1 limit 100",
        "sensitive_answers": """with a as (select page_id as id, case when page_id % 2 = 0 then 200 when page_id % 3 = 0 then 403 else 404 end as status, html || case when page_id % 5 > 0 then ' "userId": 1, "token": 2, phone' else '' end as body from pages)
select id, case when status = 200 and length(body) > 1000 then array_to_string([f for f in ['"userId"', '"telphone"', '"phone"', '"nickname"', '"avatar"', '"orderId"', '"token"', '"password"'] if contains(body, f)], ',') else '' end as large,
  case when status = 200 and length(body) >= 500 then array_to_string([f for f in ['telephone', 'phone', 'userId', 'nickname', 'orderId', 'token'] if contains(body, f)], ',') else '' end as signed_in,
  status = 403 or len([m for m in ['waf', 'blocked', 'forbidden', 'request rejected', 'security policy', 'chaitin', 'safeine', 'cloudflare'] if contains(lower(body), m)]) > 0 as firewall from a""",
        "finding_union": "select page_id, 'script' as found from pages where contains(html, '<script') union all select page_id, 'link' from pages where contains(html, 'href=') union all select page_id, 'link' from pages where contains(html, 'href=')",
        "finding_split": "select o_orderkey, case when o_orderkey % 9 = 0 or (o_custkey % 4 > 0 and o_custkey % 100 >= 80) then 'sure' else 'open' end as part from orders",
        "recent_events": "select event_id, event_type from events order by ts desc, event_id, event_type limit 5",
        "update_status": "with n as (select l_orderkey, max(l_linestatus) as s from lineitem where l_returnflag = 'R' group by 1) select o_orderkey, coalesce(s, o_orderstatus) as o_orderstatus from orders left join n on o_orderkey = l_orderkey",
        "fk_violations": "select doc_id, source from documents where doc_id is not null and not exists (select 1 from labels where labels.doc_id = documents.doc_id)",
        "finding_hook_lookup": "with f as (select o_custkey, arg_min({'p': o_orderpriority, 'f': o_orderstatus}, o_orderkey) as h from orders group by 1) select c_custkey as hook_id, c_name, h.p as path, h.f as func from customer left join f on c_custkey = o_custkey",
        "findings_of_hooks": "select c_custkey as hook_id, o_orderkey as finding_id, 'Finding: ' || coalesce(o_orderpriority, '?') || chr(10) || 'Severity: ' || coalesce(nullif(o_orderstatus, 'P'), '?') || ' | CWE: ' || case when o_orderkey % 2 = 0 then 'CWE-89' else 'N/A' end || chr(10) || 'PoC:' || chr(10) || case when o_orderkey % 3 = 0 then 'x' else '(none)' end as text from customer join orders on c_custkey = o_custkey",
        "traffic_diff": f"{_TRAFFIC} select * from found",
        "verification_guides": f"{_TRAFFIC} select 'F' || cast(row_number() over (order by rank, seq) as varchar) as finding_id, seq, severity, diff_type, case diff_type when 'STATUS_MISMATCH' then 'Authentication anomaly: ' when 'BODY_LEAK' then 'Unauthenticated access: ' else 'To be verified: ' end || path as title, cast(guide_score as int) as confidence, false as auto_verifiable, case diff_type {steps} end as steps from found",
        "api_endpoints": f"select distinct method || ' ' || bare as endpoint from {_ENDPOINTS} where contains(bare, '/api/') or contains(bare, '/v2/')",
        "first_endpoints": f"select method, bare, cast(min(event_id) as bigint) as seq from {_ENDPOINTS} group by 1, 2",
        "first_fifty_endpoints": f"select method, bare, cast(min(event_id) as bigint) as seq from {_ENDPOINTS} group by 1, 2 order by 3 limit 50",
        "finding_dedup": "select min(event_id) as event_id, event_type as category from events group by event_type, user_id % 7",
        "link_extract": "with l as (select page_id, list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) as x from pages) select page_id, cast(len(x) as bigint) as n_links, array_to_string(x, ',') as links from l",
        "semantic_topk": f"with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), s as (select a.vec_id as id, b.vec_id as pid, {_COS.format('a.e', 'b.e')} as score from v a join v b on a.vec_id % 20 = 0), r as (select id, pid, cast(row_number() over (partition by id order by score desc, pid) as int) as rank, score from s) select id, pid, rank, round(score, 6) as score from r where rank <= 3 and score > 0.1",
        "trial_rollup": """with v as (select conv_id, turn, role, '{"verdict":"' || case when conv_id % 2 = 0 then 'valid' else 'invalid' end || '","final_score":' || cast(length(text) as varchar) || '.5,"reasoning":"turn ' || cast(turn as varchar) || '"}' as j, length(text) as n from conversations),
g as (select conv_id, coalesce(max(turn) filter (role in ('user', 'assistant')), 0) as rounds, coalesce(arg_max(j, turn) filter (role = 'user'), '{}') as p, coalesce(arg_max(j, turn) filter (role = 'assistant'), '{}') as d,
  arg_max({'n': n, 't': turn}, turn) filter (role = 'system') as s from v group by 1)
select 'TRIAL-' || cast(conv_id as varchar) || '-R' || cast(rounds as varchar) as trial_id, conv_id as finding_id, rounds, p as prosecutor_view, d as defender_view, '{}' as judge_summary,
  case when s is null then 'unknown' when conv_id % 2 = 0 then 'valid' else 'invalid' end as jury_verdict, case when s is null then 0.0 else cast(s.n as double) + 0.5 end as jury_score,
  case when s is null then '' else 'turn ' || cast(s.t as varchar) end as jury_reasoning, cast(case when s is not null and conv_id % 2 = 0 then 25 else 0 end as int) as points from g""",
        "encryption_report": f"""with f as (select lang as project, lpad(cast(doc_id as varchar), 12, '0') || case when doc_id % 5 = 0 then '.txt' else '.PHP' end as path, doc_id % 5 <> 0 as php, {_HEADS_SQL}[doc_id % {len(_HEADS)} + 1] as head, text from documents),
r as (select *, row_number() over (partition by project order by path) as place from f where php),
j as (select project, path, place, len([s for s in {_SIGNED} if contains(string_split(substr(head || chr(10), 1, 200), chr(10))[1], s)]) > 0 as enc, [s for s in {_SIGNED} if contains(substr(head || chr(10) || text, 1, 500), s)][1] as kind from r where place <= 500),
t as (select project, count(*) filter (php) as total from f group by 1),
g as (select project, count(*) filter (enc) as n, arg_min(kind, place) filter (kind is not null and place <= 5) as kind, array_to_string(list_sort(list(path) filter (enc))[1:10], ',') as samples from j group by 1)
select t.project, total as total_files, coalesce(n, 0) as encrypted_files, round(coalesce(n, 0) / cast(greatest(total, 1) as double), 6) as ratio, coalesce(kind, 'none') as kind,
  case when coalesce(n, 0) / cast(greatest(total, 1) as double) >= 0.3 then 'skip' when coalesce(n, 0) / cast(greatest(total, 1) as double) >= 0.1 then 'risky' else 'safe' end as verdict, coalesce(samples, '') as samples from t left join g on t.project is not distinct from g.project""",
    }
