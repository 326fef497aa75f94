"""Captured pages and headers: missing headers, cookie flags, cross-origin rules, hosts, scripts and routes.

Column expressions only: a page is judged where it is read, and nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def missing_headers(headers: Column) -> Column:
    """Names of the security headers that a map of headers lacks, whatever their case, in the rule table's order."""
    have = F.transform(F.map_keys(headers), F.lower)
    return F.filter(F.array(*map(F.lit, R.SECURITY_HEADERS)), lambda h: ~F.array_contains(have, F.lower(h)))


def weak_cookies(set_cookie: Column) -> Column:
    """'name: missing flags' for each part between commas that lacks a flag. Null has none."""

    def told(part: Column) -> Column:
        name = F.when(part.contains("="), F.substring_index(part, "=", 1)).otherwise(F.substring(part, 1, 20))
        lacking = F.filter(F.array(*map(F.lit, R.COOKIE_FLAGS)), lambda f: ~F.contains(part, f))
        return F.when(F.size(lacking) > 0, F.concat(name, F.lit(": missing "), F.array_join(lacking, ", ")))

    parts = F.filter(F.transform(F.split(F.coalesce(set_cookie, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.filter(F.transform(parts, told), lambda x: x.isNotNull())


def cors_severity(origin: Column, credentials: Column) -> Column:
    return F.when((origin == "*") & (credentials == "true"), "medium").when(origin == "*", "low")


def root_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def script_urls(html: Column, base: Column) -> Column:
    """Distinct addresses of scripts, those without a scheme resolved against the page's own."""
    found = F.array_union(*(F.regexp_extract_all(html, F.lit(p), 1) for p in R.SCRIPT_SOURCES))
    origin = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]*/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    made = lambda s: F.when(s.startswith("//"), F.concat(F.lit("https:"), s)).when(s.startswith("http"), s).when(s.startswith("/"), F.concat(origin, s)).otherwise(F.concat(folder, s))
    return F.array_sort(F.array_distinct(F.transform(found, made)))


def vendor_check(findings: DataFrame) -> DataFrame:
    """findings (category, severity, tier) with vendor_category and accepted. Unknown tiers count as default, unmapped categories as themselves."""
    mapped = F.create_map(*[F.lit(x) for pair in R.VENDOR_CATEGORIES.items() for x in pair])
    rules = {f"{tier}/{severity}": names for tier, rows in R.VENDOR_ACCEPTS.items() for severity, names in rows.items()}
    accepts = F.create_map(*[x for key, names in rules.items() for x in (F.lit(key), F.array(*map(F.lit, names)))])
    tier = F.when(F.col("tier").isin(list(R.VENDOR_ACCEPTS)), F.col("tier")).otherwise("default")
    category = F.coalesce(F.try_element_at(mapped, F.col("category")), F.col("category"))
    fits = F.array_contains(F.try_element_at(accepts, F.concat_ws("/", tier, F.col("severity"))), category)
    return findings.withColumns({"vendor_category": category, "accepted": F.coalesce(fits, F.lit(False))})


def without_rejected(findings: DataFrame) -> DataFrame:
    """Findings whose category has no rejected finding at all. The categories are few: they are aggregated before the join."""
    bad = findings.where("not accepted").select("category").distinct()
    return findings.join(bad, "category", "left_anti")


# what a page gives away
def technologies(html: Column) -> Column:
    """'name=version' of each technology that a text shows, 'name=detected' where it names no version, in the rule table's order."""

    def told(name: str, pattern: str) -> Column:
        version = F.regexp_extract(html, "(?iu)" + pattern, 1) if "(" in pattern.replace("(?:", "") else F.lit("")
        return F.when(html.rlike("(?iu)" + pattern), F.concat(F.lit(name + "="), F.coalesce(F.nullif(version, F.lit("")), F.lit("detected"))))

    return F.filter(F.array(*(told(n, p) for n, p in R.TECHNOLOGIES.items())), lambda x: x.isNotNull())


def subdomains(html: Column, host: Column, seen: Column | None = None) -> Column:
    """Distinct hosts below the root of a host that a text links to, sorted, without those seen before."""
    root = F.lower(root_of(host))
    upto = lambda h: F.length(h) - F.position(F.reverse(root), F.reverse(F.lower(h))) + 1
    inside = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)https?://([\w.-]+)"), 1), lambda h: F.contains(F.lower(h), root))
    found = F.array_sort(F.array_distinct(F.transform(inside, lambda h: F.substring(h, F.lit(1), upto(h)))))
    return found if seen is None else F.array_except(found, seen)


def first_sight(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """pages (site, seq, url, html): for each page that shows hosts below its site's root which no earlier page of the site did: site, seq, url, n, hosts.

    A host is new on the page where it is seen first by seq (of equal ones the smaller url); seen (site, host) were known before. Each
    (site, host) meets once, in a pre-aggregated minimum, however many pages show it; hosts are told apart as they are written.
    """
    shown = pages.select("site", "seq", "url", F.explode(subdomains(F.col("html"), F.col("site"))).alias("host"))
    first = shown.groupBy("site", "host").agg(F.min(F.struct("seq", "url")).alias("f"))
    if seen is not None:
        first = first.join(seen.select("site", "host").distinct(), ["site", "host"], "left_anti")
    return first.groupBy("site", "f.seq", "f.url").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("host")).alias("hosts"))


def first_sight_stream(pages: DataFrame, forget: str) -> DataFrame:
    """A stream of pages (site, url, html, at timestamp): site, url, host, at of each host when it is first seen; what was not seen for `forget` is new again."""
    shown = pages.select("site", "url", "at", F.explode(subdomains(F.col("html"), F.col("site"))).alias("host"))
    return shown.withWatermark("at", forget).dropDuplicatesWithinWatermark(["site", "host"])


SCRIPTS_READ, ENDPOINTS_ASKED = 20, 40


def scripts_read(html: Column, base: Column, most: int = SCRIPTS_READ) -> Column:
    """The scripts of a page that are looked into: the first ones by address."""
    return F.slice(script_urls(html, base), 1, most)


MOST_SECRETS, MOST_ROUTES = 3, 15


def secrets(body: Column) -> Column:
    """The first MOST_SECRETS secrets of a text by rule, then place: (type, severity, length, sha256). Values stay out.

    A value has 8 to 200 letters, is no address and no literal; its first 60 letters are hashed.
    """

    def of(kind: str, pattern: str, severity: str) -> Column:
        made = lambda v: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.length(v).alias("length"), F.sha2(F.substring(v, 1, 60), 256).alias("sha256"))
        fits = lambda v: F.length(v).between(8, 200) & ~v.startswith("http") & ~v.isin("undefined", "null", "true", "false")
        return F.transform(F.filter(F.regexp_extract_all(body, F.lit("(?iu)" + pattern), 1), fits), made)

    return F.slice(F.flatten(F.array(*(of(*rule) for rule in R.SECRETS))), 1, MOST_SECRETS)


def api_routes(body: Column) -> Column:
    """Distinct routes of more than five letters that a text names, sorted; none if there are three or fewer."""
    found = F.flatten(F.array(*(F.regexp_extract_all(body, F.lit("(?iu)" + p), 1) for p in R.API_ROUTES)))
    asset = lambda a: a.rlike(r"\.(js|css|png|jpg|svg)$")
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda a: (F.length(a) > 5) & ~asset(a))))
    return F.when(F.size(kept) > 3, kept).otherwise(F.array().cast("array<string>"))


# captured answers
def hidden_paths(body: Column) -> Column:
    """Paths that a robots.txt keeps away, in order; none if there are two or fewer."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)Disallow:\s*(/\S+)"), 1)
    return F.when(F.size(found) > 2, found).otherwise(F.array().cast("array<string>"))


def permissive_policy(path: Column, body: Column) -> Column:
    """A cross-domain policy file that lets anyone in."""
    return F.coalesce(path.isin("/crossdomain.xml", "/clientaccesspolicy.xml") & F.lower(body).contains("allow-access-from") & body.contains("*"), F.lit(False))


def info_leaks(answers: DataFrame) -> DataFrame:
    """answers (url, path, status, body): one finding for a robots.txt that hides more than two paths, or a permissive policy."""
    there = answers.where((F.col("status") == 200) & (F.length("body") > 10))
    hidden = F.when(F.col("path") == "/robots.txt", hidden_paths(F.col("body"))).otherwise(F.array().cast("array<string>"))
    rows = there.withColumns({"hidden": hidden, "open": permissive_policy(F.col("path"), F.col("body"))}).where((F.size("hidden") > 0) | F.col("open"))
    title = F.when(F.col("open"), F.concat(F.lit("Permissive "), "path", F.lit(" Policy"))).otherwise(F.concat(F.lit("Robots.txt Reveals "), F.size("hidden").cast("string"), F.lit(" Hidden Paths")))
    return rows.select("url", "path", F.lit("low").alias("severity"), F.when(F.col("open"), "CWE-942").otherwise("CWE-200").alias("cwe"), title.alias("title"), F.array_join(F.slice("hidden", 1, 15), "\n").alias("evidence"))


def exposure(path: Column, status: Column) -> Column:
    """How severe it is that a well-known path answers so; null if it means nothing."""
    files, tools = path.isin("/.env", "/.git/HEAD"), path.isin("/swagger-ui.html", "/swagger-ui/index.html", "/actuator/health")
    found = F.when(files, "critical").when(tools, "medium").when(path == "/admin", "low")
    return F.when(status == 200, found).when((status == 403) & (files | path.isin("/swagger-ui.html", "/actuator/health")), "info")


def endpoint_findings(answers: DataFrame) -> DataFrame:
    """answers (url, path, status): for each site the sensitive files (high) and the tools (medium) that answer.

    The paths judged are a fixed few, so a site's list is bounded.
    """
    level = exposure(F.col("path"), F.col("status"))
    rows = answers.select("url", "path", level.alias("level")).where(F.col("level").isin("critical", "medium"))
    sites = rows.groupBy("url", "level").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    is_file, n = F.col("level") == "critical", F.size("paths").cast("string")
    title = F.concat(F.when(is_file, "Sensitive File Exposure (").otherwise("Development Endpoint Exposure ("), n, F.lit(" endpoint(s))"))
    return sites.select("url", F.when(is_file, "high").otherwise("medium").alias("severity"), F.when(is_file, "CWE-538").otherwise("CWE-200").alias("cwe"), title.alias("title"), F.array_join("paths", "\n").alias("evidence"), F.when(is_file, 80).otherwise(65).alias("confidence"))


def _in_order(body: Column, fields: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, fields)), lambda f: F.contains(body, f))


def sensitive_fields(status: Column, body: Column) -> Column:
    """Names of user data in a large answer, quoted, in the rule table's order; none in answers of 1,000 letters or fewer."""
    return F.when((status == 200) & (F.length(body) > 1000), _in_order(body, R.FIELDS_OF_LARGE)).otherwise(F.array().cast("array<string>"))


def signed_in_fields(status: Column, body: Column) -> Column:
    """Names of user data in an answer to a signed-in request of 500 letters or more."""
    return F.when((status == 200) & (F.length(body) >= 500), _in_order(body, R.FIELDS_OF_SIGNED_IN)).otherwise(F.array().cast("array<string>"))


def leak_confidence(status: Column, body: Column) -> Column:
    """70 for an answer of more than 50 letters that holds user data, else 30."""
    return F.when((status == 200) & (F.length(body) > 50) & body.rlike(R.LEAK), 70).otherwise(30)


def resource_ids(body: Column, n: int = 5) -> Column:
    """The first n 'name=number' of ids that a JSON text holds."""
    names, numbers = (F.regexp_extract_all(body, F.lit(R.RESOURCE_ID), i) for i in (1, 2))
    return F.slice(F.zip_with(names, numbers, lambda a, b: F.concat_ws("=", a, b)), 1, n)


def live(status: Column, size: Column, fallback: Column) -> Column:
    """An endpoint exists; not if it answers with the page that a single-page site sends for anything."""
    return F.coalesce(status.isin(200, 301, 302, 401, 403, 405) & ~F.coalesce((status == 200) & (size == fallback), F.lit(False)), F.lit(False))


def paths_for(found: Column) -> Column:
    """Well-known paths for an array of technologies, distinct and sorted."""
    more = [F.when(F.array_contains(found, name), F.array(*map(F.lit, paths))).otherwise(F.array().cast("array<string>")) for name, paths in R.PATHS_BY_TECH.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(F.array(*map(F.lit, R.PATHS_ALWAYS)), *more))))


def behind_firewall(status: Column, body: Column) -> Column:
    """An answer to a suspicious request that a firewall gave."""
    said = F.exists(F.array(*map(F.lit, R.FIREWALL_MARKS)), lambda m: F.contains(F.lower(body), m))
    return F.coalesce(status.isin(403, 406, 468, 501), F.lit(False)) | F.coalesce(said, F.lit(False))


def check_route(category: Column, cwe: Column) -> Column:
    """Which check verifies a finding; 'guide' if none does and someone has to look."""
    category, cwe = F.coalesce(category, F.lit("")), F.coalesce(cwe, F.lit(""))
    return (
        F.when(category == "security_header", "headers").when(category == "cookie_security", "cookies")
        .when(cwe.contains("CWE-89") | F.lower(category).contains("sql"), "sql").when(cwe.contains("CWE-78") | F.lower(category).contains("command"), "command")
        .when(category == "cors_misconfig", "cors").when(category == "endpoint_exposure", "endpoint").otherwise("guide")
    )


def look_for(cwe: Column, path: Column, line: Column, func: Column) -> Column:
    """Steps to review a finding by hand, by its class."""
    cwe = F.coalesce(cwe, F.lit(""))
    start = F.concat(F.lit("1. Open "), F.coalesce(path, F.lit("unknown file")), F.lit(", line "), F.coalesce(line.cast("string"), F.lit("?")))
    name = F.concat(F.coalesce(func, F.lit("unknown function")), F.lit("()"))
    steps = lambda *rest: F.array(start, *[r if isinstance(r, Column) else F.lit(r) for r in rest])
    return (
        F.when(cwe.contains("CWE-502"), steps(F.concat(F.lit("2. Find who calls "), name), "3. Judge whether a caller takes user input", "4. Input of users: high", "5. Internal data: false positive"))
        .when(cwe.contains("CWE-94"), steps(F.concat(F.lit("2. Follow how the arguments of "), name, F.lit(" are made")), "3. Look for data that users control", "4. Users control all of it: critical", "5. Strictly filtered: lower, or false positive"))
        .when(cwe.contains("CWE-22"), steps("2. See whether the path is made of user input", "3. Check that it cannot leave its folder", "4. Other files can be read: high"))
        .otherwise(steps("2. Follow where the arguments come from", "3. Judge under what conditions it can be reached", "4. Decide whether it is real"))
    )


def first_findings(findings: DataFrame, seq: str) -> DataFrame:
    """The first finding of each category and first 80 letters of its title."""
    rows = findings.withColumn("_title", F.substring("title", 1, 80))
    kept = rows.groupBy("category", "_title").agg(F.min_by(F.struct(*findings.columns), seq).alias("_f"))
    return kept.select("_f.*")
