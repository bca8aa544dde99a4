"""Named queries over stored records: filters, pages, seeds, answers of models, schemas, exports and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.urls import host
from tessera.operators import actions, crawl, evolve, html_records, profile, resolve, robots, tables
from tessera.operators.evolve import Field, Schema
from tessera.plans.registry import HOST, query
from tessera.sources import sinks
from tessera.sources import tables as sources
from tessera.streaming import events as streams

# --- filters and pages --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equal_fields(t):
    return tables.matching(t("orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def listed_values(t):
    return tables.matching(t("orders"), o_orderpriority=["1-URGENT", "5-LOW"]).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def null_values(t):
    rows = t("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("resolved_at"))
    return tables.matching(rows, resolved_at=None).select("c_custkey")


@query("SELECT c_custkey, nullif(c_acctbal, abs(c_acctbal)) AS quality FROM customer WHERE nullif(c_acctbal, abs(c_acctbal)) >= -500")
def least_quality(t):
    rows = t("customer").select("c_custkey", F.nullif("c_acctbal", F.abs("c_acctbal")).alias("quality"))
    return tables.least_quality(rows, "quality", -500.0)


@query("SELECT c_custkey FROM customer WHERE coalesce(nullif(c_acctbal, abs(c_acctbal)), 0) >= -500")
def least_quality_in_memory(t):
    rows = t("customer").select("c_custkey", F.nullif("c_acctbal", F.abs("c_acctbal")).alias("quality"))
    return tables.least_quality(rows, "quality", -500.0, missing=0.0).select("c_custkey")


SOURCES = "CASE o_orderstatus WHEN 'O' THEN 'remote:' || o_orderpriority WHEN 'F' THEN 'local' END"


@query(f"SELECT 'local' AS origin, count(*) AS n FROM orders WHERE {SOURCES} IS NULL OR {SOURCES} = 'local' UNION ALL SELECT 'remote', count(*) FROM orders WHERE {SOURCES} LIKE 'remote:%'")
def source_filter(t):
    named = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("remote:"), F.col("o_orderpriority"))).when(F.col("o_orderstatus") == "F", "local")
    rows = t("orders").select(named.alias("source"))
    counts = [tables.from_source(rows, "source", kind).agg(F.lit(kind).alias("origin"), F.count("*").alias("n")) for kind in ("local", "remote")]
    return counts[0].union(counts[1])


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def plain_search(t):
    return tables.search_plain(t("documents"), "License", F.col("text")).select("doc_id")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def changed_since(t):
    return tables.changed_since(t("events"), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id", "ts")


@query("SELECT event_id, event_type FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 250")
def keyset_page_by_id(t):
    return tables.keyset_page(t("events"), ["event_id"], (200,), 250).select("event_id", "event_type")


@query("SELECT o_orderdate, o_orderkey FROM orders JOIN (SELECT min(o_orderdate) AS low FROM orders) ON o_orderdate > low OR (o_orderdate = low AND o_orderkey > 100) ORDER BY 1, 2 LIMIT 120")
def keyset_page_ascending(t):
    low = t("orders").agg(F.min("o_orderdate").alias("d")).first()["d"]
    return tables.keyset_page(t("orders"), ["o_orderdate", "o_orderkey"], (low, 100), 120).select("o_orderdate", "o_orderkey")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def latest_events(t):
    return streams.latest_events(t("events")).select("event_id", "event_type")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")
def since_days(t):
    latest = t("orders").agg(F.max("o_orderdate").alias("d")).first()["d"]
    return profile.since_days(t("orders"), "o_orderdate", 90, F.lit(latest)).select("o_orderkey", "o_orderdate")


@query(f"SELECT DISTINCT {HOST} AS host FROM pages")
def distinct_hosts(t):
    return t("pages").select(host("url").alias("host")).distinct()


# --- tables that change -------------------------------------------------------------------------------------------------

LATER = "SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE event_type = 'click')"


@query(f"SELECT event_id, event_type FROM ({LATER}) WHERE event_type <> 'click'")
def pulled_rows(t):
    rows = t("events").select("event_id", "ts", "event_type")
    return sources.pulled_since(rows, rows.where("event_type = 'click'"), "ts", "event_id").select("event_id", "event_type")


@query("""SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2
UNION ALL SELECT c_custkey, 'none', -1 FROM customer""")
def upsert_two_keys(t):
    old = t("customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.lit(-1).cast("long").alias("event_id"))
    new = t("events").select("user_id", "event_type", "event_id", F.col("event_id").alias("seq"))
    return tables.upsert(old, new, ["user_id", "event_type"], "seq")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '[REDACTED]' ELSE c_name END AS c_name FROM customer")
def redacted_tenant(t):
    rows = t("customer").withColumn("tenant_id", F.col("c_mktsegment"))
    return tables.redacted_log(rows, "BUILDING", ["c_name"]).select("c_custkey", "c_name")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'changed schema' END AS reason FROM pages")
def reextraction_flags(t):
    return tables.flagged(t("pages"), F.startswith("url", F.lit("https")), "changed schema").select("page_id", "reason")


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') >= 3 + c_nationkey % 4 AS over FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_nationkey""")
def page_quotas(t):
    tasks = t("orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    quotas = t("customer").select(F.col("c_custkey").alias("job_id"), (3 + F.col("c_nationkey") % 4).alias("quota"))
    return tables.over_quota(tasks, quotas).select(F.col("job_id").alias("o_custkey"), "over")


@query("""SELECT count(*) FILTER (WHERE c_custkey IS NULL) AS orphaned, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey""")
def health_counts(t):
    tasks = t("orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"))
    jobs = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("job_id"))
    return profile.health(tasks, jobs, "job_id")


@query("SELECT c_nationkey AS tenant_id, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS bytes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def storage_by_tenant(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("tenant_id")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("bytes"))


# --- crawling -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')")
def extractable_pages(t):
    kind = F.when(F.col("event_type") == "view", "single_entry").when(F.col("event_type") == "purchase", "partial").otherwise("navigation")
    return crawl.extractable(t("events").withColumn("classification", kind)).select("event_id", "event_type")


@query("""SELECT s_suppkey, s_url AS url, CASE WHEN s_nationkey % 3 = 0 THEN 0.5 WHEN s_nationkey % 3 = 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS score,
  CASE WHEN s_nationkey % 3 = 2 THEN 'partial' ELSE 'unknown' END AS expected, CASE WHEN s_nationkey % 3 = 1 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT *, 'https://a.com/' || s_suppkey AS s_url FROM supplier)""")
def scored_links(t):
    rows = t("supplier").withColumn("url", F.concat(F.lit("https://a.com/"), F.col("s_suppkey").cast("string"))).withColumn("k", F.col("s_nationkey") % 3)
    answers = rows.select(
        "url",
        F.when(F.col("k") == 0, "0").when(F.col("k") == 1, "7.5").otherwise("0.25").alias("score"),
        F.when(F.col("k") == 2, "partial").otherwise("odd").alias("expected"),
        F.when(F.col("k") == 1, "high").alias("priority"),
    )
    return crawl.score_links(rows.select("s_suppkey", "url"), answers)


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'single_entry' WHEN 1 THEN 'navigation' ELSE 'irrelevant' END AS classification,
  CASE page_id % 4 WHEN 0 THEN 'static' ELSE 'skip' END AS strategy, CASE page_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM pages""")
def classified_pages(t):
    kind = F.col("page_id") % 4
    told = F.when(kind == 0, '{"classification": "single_entry", "strategy": "static", "confidence": 3}').when(kind == 1, '{"classification": "navigation", "confidence": 0.5}').when(kind == 2, "no JSON")
    answers = t("pages").select("page_id", told.alias("answer")).where("answer IS NOT NULL")
    return crawl.classified(t("pages").select("page_id"), answers)


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0 OR (s_nationkey % 3 = 1 AND s_suppkey % 7 <> 0) OR (s_nationkey % 3 = 2 AND (s_suppkey::VARCHAR LIKE '1%' OR s_suppkey::VARCHAR LIKE '%5'))""")
def robots_rules(t):
    kind = F.col("n_nationkey") % 3
    closed = F.when(kind == 0, "User-agent: other\nDisallow: /\n").when(kind == 1, "User-agent: *\nDisallow: /*/7mod0/\n\nUser-agent: Tessera # own\nAllow: /\nDisallow: /*/mod0\n")
    body = F.coalesce(closed, F.lit("User-Agent: a\nUser-agent: *\nDisallow: /shop\nAllow: /shop/1\nAllow: /shop*5/mod*$\nCrawl-delay: 2\n"))
    files = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("host"), body.alias("body"))
    url = F.concat(F.lit("https://N"), F.col("s_nationkey").cast("string"), F.lit(".com/shop/"), F.col("s_suppkey").cast("string"), F.lit("/mod"), (F.col("s_suppkey") % 7).cast("string"))
    rules = robots.rule_rows(robots.parse_robots(files, "Tessera/1.0"))
    return robots.robots_allowed(t("supplier").select("s_suppkey", url.alias("url")), rules).select("s_suppkey")


@query("""SELECT p_partkey // 40 AS page_id, p_partkey % 40 + 0 AS place, '{"brand": "' || p_brand || '", "code": "P' || p_partkey || '", "name": "' || p_name || '", "price": ' || p_retailprice::DOUBLE::VARCHAR || '}' AS data FROM part""")
def catalog_tables(t):
    """Headed tables with a cell over all rows, a cell over two columns and a table of navigation before them."""
    part = t("part")
    cell = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))), cell(F.col("p_name")), cell(F.col("p_brand")), F.lit("<td>$ "), F.format_string("%.2f", "p_retailprice"), F.lit("<td colspan=2>x</tr>"))
    pages = part.groupBy(F.expr("p_partkey div 40").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    head = "<table><tr><td>home</table><table><tr><th>Code<th>Product name<th>Brand<th>Retail price<th>A<th>B</tr>"
    pages = pages.select("page_id", F.lit("https://s.t/").alias("url"), F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html"))
    schema = evolve.Schema(1, (evolve.Field("code", required=True), evolve.Field("name", description="product"), evolve.Field("brand"), evolve.Field("price", "number", description="retail price")))
    found = html_records.extract_records(pages, schema).where("method = 'table'")
    return found.select("page_id", (F.regexp_extract("data", '"code": "P([0-9]+)"', 1).cast("long") % 40).alias("place"), "data")


@query("""SELECT s_suppkey // 20 AS page_id, '{"name": "' || s_name || '", "phone": "T-' || s_nationkey || '", "url": "https://s.t/s/' || s_suppkey || '"}' AS data FROM supplier
WHERE s_suppkey // 20 IN (SELECT s_suppkey // 20 FROM supplier GROUP BY 1 HAVING count(*) >= 2)""")
def catalog_blocks(t):
    """Cards of a list page, between other blocks."""
    card = F.concat(F.lit('<div class="card supplier"><h3 class="supplier-name">'), "s_name", F.lit('</h3><span class="phone">T-'), F.col("s_nationkey").cast("string"), F.lit('</span><a href="/s/'), F.col("s_suppkey").cast("string"), F.lit('#top">more</a></div>'))
    pages = t("supplier").groupBy(F.expr("s_suppkey div 20").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    pages = pages.select("page_id", F.lit("https://s.t/list").alias("url"), F.concat(F.lit('<div class="note">hello</div><div class="list">'), "cards", F.lit('</div><ul><li class="x">a<li class="x">b</ul>')).alias("html"))
    schema = evolve.Schema(1, (evolve.Field("name", required=True), evolve.Field("phone"), evolve.Field("url", "url")))
    return html_records.extract_records(pages, schema).where("method = 'blocks'").select("page_id", "data")


@query("""SELECT n_nationkey AS page_id, 'title' AS part, 0::BIGINT AS seq, n_name AS data FROM nation
UNION ALL SELECT n_nationkey, 'link', 0, '{"rel": null, "text": "region", "url": "https://s.t/r/' || n_regionkey || '"}' FROM nation
UNION ALL SELECT n_nationkey, 'chunk', 0, '# ' || n_name || chr(10) || chr(10) || 'region' FROM nation
UNION ALL SELECT n_nationkey, 'chunk', 1, repeat('x', 30) FROM nation""")
def nation_page_parts(t):
    html = F.concat(F.lit("<title>"), "n_name", F.lit("</title><body><h1>"), "n_name", F.lit('</h1><p><a href="/r/'), F.col("n_regionkey").cast("string"), F.lit('">region</a></p><p>' + "x" * 30 + "</p></body>"))
    pages = t("nation").select(F.col("n_nationkey").cast("long").alias("page_id"), F.lit("https://s.t/").alias("url"), html.alias("html"))
    return html_records.page_parts(pages, most_chunk=30).select("page_id", "part", "seq", "data")


@query("""SELECT 'https://a.com/' || s_suppkey AS url, s_suppkey AS seq, CASE WHEN s_nationkey < 8 THEN 'duplicate' WHEN s_nationkey < 16 THEN 'crawled' ELSE 'new' END AS kind FROM supplier
UNION ALL SELECT 'ftp://a.com/' || n_nationkey, n_nationkey, 'invalid' FROM nation""")
def sorted_seeds(t):
    url = F.concat(F.lit("https://a.com/"), F.col("s_suppkey").cast("string")).alias("url")
    rows = t("supplier").select(url, F.col("s_suppkey").alias("seq"))
    again = t("supplier").select(F.concat(url, F.lit("#top")).alias("url"), (F.col("s_suppkey") + 1_000_000).alias("seq"))
    odd = t("nation").select(F.concat(F.lit("ftp://a.com/"), F.col("n_nationkey").cast("string")).alias("url"), F.col("n_nationkey").alias("seq"))
    pick = lambda low, high: t("supplier").where((F.col("s_nationkey") >= low) & (F.col("s_nationkey") < high)).select(url)
    return crawl.sort_seeds(rows.union(again).union(odd), pick(0, 8), pick(8, 16))


@query("""SELECT s_suppkey::VARCHAR AS url, CASE WHEN s_nationkey < 20 THEN s_nationkey * 2 ELSE -1 END AS ms_delta, CASE WHEN s_nationkey < 20 THEN s_suppkey % 2 ELSE 0 END AS n_both,
  1 + (s_suppkey % 2) - CASE WHEN s_nationkey < 20 THEN s_suppkey % 2 ELSE 0 END AS n_only_a, CASE WHEN s_nationkey < 20 THEN 1 ELSE 0 END AS n_only_b FROM supplier""")
def crawler_comparison(t):
    shared = F.when(F.col("s_suppkey") % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    one = t("supplier").select(F.col("s_suppkey").cast("string").alias("url"), F.lit(10).alias("length"), F.col("s_nationkey").alias("ms"), F.concat(shared, F.array(F.lit("a"))).alias("links"))
    two = t("supplier").where("s_nationkey < 20").select(F.col("s_suppkey").cast("string").alias("url"), F.lit(12).alias("length"), (F.col("s_nationkey") * 3).alias("ms"), F.concat(shared, F.array(F.lit("b"))).alias("links"))
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return crawl.compare_crawlers(one, two).select("url", F.coalesce("ms_delta", F.lit(-1)).alias("ms_delta"), size("both"), size("only_a"), size("only_b"))


# --- answers of models --------------------------------------------------------------------------------------------------


@query("SELECT n_name AS domain, CASE WHEN n_regionkey = 0 THEN 'high' ELSE 'low' END AS trust FROM nation WHERE n_regionkey < 2")
def trust_answers(t):
    answers = t("nation").select(F.col("n_name").alias("domain"), F.when(F.col("n_regionkey") == 0, "high").when(F.col("n_regionkey") == 1, "low").otherwise("odd").alias("trust"))
    other = answers.select(F.concat(F.lit("x"), "domain").alias("domain"), "trust")
    return resolve.trust_from_answers(t("nation").select(F.col("n_name").alias("domain")), answers.union(other))


@query("""SELECT c_custkey AS entity, 'name' AS field, '"' || c_name || '"' AS value, 'extracted' AS type FROM customer
UNION ALL SELECT c_custkey, 'city', '"x"', 'inferred' FROM customer WHERE c_nationkey >= 12 AND c_acctbal > 0""")
def filled_gaps(t):
    own = t("customer").select(F.col("c_custkey").alias("entity"), F.lit("name").alias("field"), F.concat(F.lit('"'), F.col("c_name"), F.lit('"')).alias("value"), F.lit("extracted").alias("type"))
    gaps = t("customer").select(F.col("c_custkey").alias("entity"), F.lit("city").alias("field"))
    told = t("customer").select(F.col("c_custkey").alias("entity"), F.lit("city").alias("field"), F.when(F.col("c_acctbal") > 0, '"x"').otherwise('""').alias("value"), (F.col("c_nationkey") / F.lit(24.0)).alias("confidence"))
    return resolve.fill_gaps(own, gaps, told)


@query("""SELECT c_custkey AS entity, CASE WHEN c_nationkey < 8 THEN c_name WHEN c_nationkey < 16 THEN c_mktsegment ELSE 'Entity ' || left(c_custkey::VARCHAR, 8) END AS label FROM customer""")
def entity_labels(t):
    data = F.create_map(F.lit("name"), F.when(F.col("c_nationkey") < 8, F.col("c_name")), F.lit("title"), F.when(F.col("c_nationkey") < 16, F.col("c_mktsegment")))
    return t("customer").select(F.col("c_custkey").alias("entity"), resolve.entity_label(data, F.col("c_custkey")).alias("label"))


@query("""SELECT p_partkey AS entity, 'name' AS field, to_json(p_name) AS before, to_json(upper(p_name)) AS after FROM part WHERE p_name <> upper(p_name)""")
def normalization_changes(t):
    cells = t("part").select(F.col("p_partkey").alias("entity"), F.lit("name").alias("field"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')).alias("value"))
    cells = cells.union(t("part").select("p_partkey", F.lit("size"), F.col("p_size").cast("string")))
    done = resolve.normalize_cells(cells, {"name": lambda v: X.normalize_text(v, casing="upper")})
    return resolve.changes(done)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'applied' WHEN o_custkey % 3 = 0 THEN 'approved' WHEN o_custkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status FROM orders""")
def reviewed_actions(t):
    pending = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("applied").alias("status"))
    kind = F.col("o_custkey") % 3
    verdicts = t("orders").select(F.col("o_orderkey").alias("id"), F.when(kind == 0, "approved").when(kind == 1, "rejected").otherwise("odd").alias("verdict"))
    return actions.review(pending, verdicts)


@query("""SELECT event_id, i AS seq, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE event_id % 3 WHEN 0 THEN (event_id + i)::VARCHAR WHEN 1 THEN 'x' END AS a
FROM events, (VALUES (0), (1)) v(i) WHERE event_id % 3 = 0 OR i = 0""")
def parsed_answers(t):
    k, n = F.col("event_id") % 3, F.col("event_id").cast("string")
    both = F.concat(F.lit('[{"a": "'), n, F.lit('"}, {"a": "'), (F.col("event_id") + 1).cast("string"), F.lit('"}]'))
    told = t("events").select("event_id", F.when(k == 0, both).when(k == 1, '{"data": {"a": "x"}, "confidence": 0.9}').otherwise("sorry").alias("answer"))
    return html_records.parse_answers(told).select("event_id", F.col("seq").cast("int").alias("seq"), "confidence", F.get_json_object("data", "$.a").alias("a"))


# --- schemas ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, p_name AS name, p_size::DOUBLE AS size, p_size > 25 AS big, NULL::DOUBLE AS odd FROM part""")
def projected_records(t):
    record = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_size") > 25).alias("big"), F.col("p_name").alias("odd")))
    schema = Schema(1, (Field("name"), Field("size", "number"), Field("big", "boolean"), Field("odd", "number")))
    return evolve.project(t("part").withColumn("json", record), "json", schema, ["p_partkey"])


@query("""SELECT p_partkey, p_retailprice::DOUBLE AS price, CASE p_brand WHEN 'Brand#11' THEN 'First' WHEN 'Brand#12' THEN 'First' WHEN 'Brand#13' THEN 'Third' ELSE p_brand END AS brand,
  p_size::VARCHAR AS size, 'left' || p_partkey % 3 AS left_code, NULL::VARCHAR AS right_code, p_size * 2.0::DOUBLE AS shape_width, 'tall' AS shape_height,
  CASE WHEN p_size > 10 THEN p_name ELSE p_type END AS title FROM part""")
def schema_after_actions(t):
    """All nine kinds of actions applied in order, and records of old and new versions read under the schema that they give."""
    first = Schema(1, tuple(Field(n) for n in ("name", "brand", "label", "box", "width", "tall", "code", "colour")) + (Field("size", "number"),))
    enum = {"type": "enum", "synonyms": {"First": ["Brand#11", "Brand#12"]}}
    acts = [
        {"type": "add_field", "definition": Field("price", "number"), "field": "price", "after": "name"},
        {"type": "remove_field", "field": "colour"},
        {"type": "modify_field", "field": "size", "changes": {"type": "string"}},
        {"type": "modify_field", "field": "width", "changes": {"type": "number"}},
        {"type": "rename_field", "field": "tall", "to": "height"},
        {"type": "merge_fields", "field": "title", "aliases": ["name", "label"], "definition": Field("title", required=True)},
        {"type": "split_field", "field": "code", "targets": [Field("left_code"), Field("right_code")]},
        {"type": "group_fields", "field": "shape", "sources": ["box", "width", "height"], "mapping": {"box": "kind"}},
        {"type": "set_normalization_rule", "field": "brand", "rule": enum},
        {"type": "update_enum_map", "field": "brand", "synonyms": {"Third": ["Brand#13"]}},
        {"type": "rename_field", "field": "none", "to": "nothing"},
    ]
    schema = evolve.apply_actions(first, acts)
    old = F.to_json(F.struct(F.when(F.col("p_size") > 10, F.col("p_name")).alias("name"), F.col("p_type").alias("label"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.concat(F.lit("left"), (F.col("p_partkey") % 3).cast("string")).alias("left_code"), F.struct((F.col("p_size") * 2).alias("width"), F.lit("tall").alias("height"), F.lit("x").alias("other")).alias("shape"), F.lit("red").alias("colour")))
    rows = evolve.read_under(t("part").withColumn("json", old), "json", schema, ["p_partkey"])
    return rows.select("p_partkey", "price", "brand", "size", "left_code", "right_code", F.col("shape.width").alias("shape_width"), F.col("shape.height").alias("shape_height"), "title")


@query("""SELECT p_partkey AS extraction_id, 'brand' AS name, to_json(p_brand)::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part""")
def unmapped_fields(t):
    record = F.to_json(F.struct(F.col("p_name").alias("Name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    rows = t("part").select("p_partkey", F.col("p_partkey").alias("ord"), record.alias("json"))
    return evolve.unmapped_of_records(rows, "p_partkey", "json", Schema(1, (Field("name"),))).select("extraction_id", "name", "value")


@query("SELECT lower(n_name) AS key FROM nation WHERE n_name NOT IN ('FRANCE', 'CHINA')")
def candidate_fields(t):
    seen = t("nation").select(F.lower("n_name").alias("key"))
    return evolve.new_candidates(seen, Schema(1, (Field("France"), Field("china"))))


@query("""SELECT c_mktsegment AS name, 'string' AS type, count(c_name)::DOUBLE / (SELECT count(*) FROM customer) AS fill_rate, count(DISTINCT c_name) AS unique_count FROM customer GROUP BY 1
UNION ALL SELECT 'absent', 'string', 0, 0""")
def data_dictionary(t):
    cells = t("customer").select(F.col("c_custkey").alias("entity"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("field"), F.col("c_name").alias("value"), F.lit(None).cast("double").alias("number"))
    fields = cells.select(F.col("field").alias("name")).distinct().union(t("region").sparkSession.createDataFrame([("absent",)], "name string"))
    fields = fields.select("name", F.lit("string").alias("type"))
    return profile.data_dictionary(fields, profile.field_statistics(cells, cells.count()), False).select("name", "type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fill_rate", "unique_count")])


# --- records ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, left(c_name, 10) AS name, c_mktsegment AS segment FROM customer")
def sanitized_records(t):
    data = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("other"), F.lit("x"))
    clean = html_records.sanitize(t("customer").select("c_custkey", data.alias("data")), "data", Schema(1, (Field("name"), Field("segment"))), caps={"name": 10})
    return clean.where(~F.map_contains_key("data", "other")).select("c_custkey", F.col("data")["name"].alias("name"), F.col("data")["segment"].alias("segment"))


@query("""SELECT c_custkey, c_custkey % 100 = 1 AND c_custkey < 30000 AS echo, c_custkey % 3 = 0 AS leak, length(c_mktsegment) = 8 AS full FROM customer""")
def scanned_output(t):
    """Values of thousands of characters against a prompt of thousands, of which some quote a run of it."""
    names = [f"Customer#{i:09d} of the list" for i in range(1, 300)]
    prompt = " ".join(names)
    quote = F.when((F.col("c_custkey") % 100 == 1) & (F.col("c_custkey") < 30_000), F.concat(F.lit(f" {names[0]} {names[1]}"[3:50]), F.lit(" and more"))).otherwise(F.lit(""))
    filler = F.concat(F.repeat(F.concat(F.col("c_name"), F.lit(" says ")), 60), quote, F.repeat(F.lit("so on "), 100))
    note = F.when(F.col("c_custkey") % 3 == 0, "see segment").otherwise("plain")
    data = F.create_map(F.lit("name"), filler, F.lit("segment"), F.col("c_mktsegment"), F.lit("note"), note)
    # Dealt out before the texts are made, which are far larger than the table.
    customers = t("customer")
    parts = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = customers.repartition(parts, "c_custkey").select("c_custkey", data.alias("data"), F.lit(prompt).alias("prompt"))
    flags = html_records.scan_output(rows, "data", "prompt", {"segment": 8, "note": 99, "name": 1})
    kinds = {"prompt_echo": "echo", "field_name_leak": "leak", "cap_hit": "full"}
    found = flags.groupBy("c_custkey").agg(*[F.max(F.col("kind") == k).alias(n) for k, n in kinds.items()])
    return rows.join(found.hint("merge"), "c_custkey", "left").select("c_custkey", *[F.coalesce(n, F.lit(False)).alias(n) for n in kinds.values()])


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i FROM orders)
SELECT i // 250 AS page, count(*) AS rows, arg_min(o_orderkey, i) AS first_key, arg_max(o_orderkey, i) AS last_key, min(o_totalprice) AS first_price, max(o_totalprice) AS last_price FROM n GROUP BY 1""")
def page_bounds(t):
    found = tables.page_bounds(t("orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 250)
    return found.select("page", "rows", F.col("first.o_orderkey").alias("first_key"), F.col("last.o_orderkey").alias("last_key"), F.col("first.o_totalprice").alias("first_price"), F.col("last.o_totalprice").alias("last_price"))


@query("""SELECT event_id, '{"a":[1,{"b":' || event_id || ',"c":null}],"z":"' || event_type || '"}' AS json FROM events""")
def stable_json(t):
    raw = F.concat(F.lit('{ "z": "'), F.col("event_type"), F.lit('", "a": [1, {"c": null, "b": '), F.col("event_id").cast("string"), F.lit("}] }"))
    return t("events").select("event_id", X.canonical_json(raw).alias("json"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' ELSE 'string' END AS type, event_id % 6 NOT IN (1, 4, 5) AS meaningful FROM events""")
def json_kinds(t):
    kind = F.col("event_id") % 6
    raw = F.when(kind == 0, F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit("}"))).when(kind == 1, "[]").when(kind == 2, F.col("event_id").cast("string")).when(kind == 3, "true").when(kind == 4, '""').otherwise("null")
    return t("events").select("event_id", X.infer_type(raw).alias("type"), X.meaningful(raw).alias("meaningful"))


# --- exports and logs ---------------------------------------------------------------------------------------------------


def exported(t):
    """Parts as entities of a finished job."""
    data = F.create_map(F.lit("name"), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.lit("size"), F.col("p_size").cast("string"), F.lit("tags"), F.concat(F.lit('["'), F.col("p_type"), F.lit('"]')))
    return t("part").select(F.col("p_partkey").alias("entity"), data.alias("data"), F.lit(None).cast("double").alias("quality"), F.array(F.col("p_brand")).alias("categories"), (F.col("p_size") % 3).cast("long").alias("source_count"))


EXPORT = Schema(1, (Field("name", required=True), Field("size", "number"), Field("tags", "array", item=Field("item"))))


@query("""SELECT '{"data":{"name":' || to_json(p_name) || ',"size":' || p_size || '},"categories":[' || to_json(p_brand) || '],"sourceCount":' || p_size % 3 || '}' AS value FROM part""")
def json_export(t):
    return sinks.json_rows(exported(t), ["name", "size"])


@query("""SELECT p_partkey AS entity, p_name || ',' || p_size || ',"[""' || p_type || '""]"' AS value FROM part""")
def csv_export(t):
    return sinks.csv_rows(exported(t), EXPORT)


@query("""SELECT p_partkey AS entity, p_name AS name, p_size::DOUBLE AS size, '["' || p_type || '"]' AS tags FROM part""")
def typed_export(t):
    return sinks.typed(exported(t), EXPORT)


@query("""SELECT event_id, type FROM (SELECT event_id, event_type AS type FROM events WHERE user_id = 1 AND event_id > 5 UNION ALL
  SELECT 5, 'replay_truncated' FROM (SELECT min(event_id) AS low FROM events WHERE user_id = 1) WHERE low > 6)""")
def replayed_events(t):
    log = t("events").select("event_id", F.col("event_type").alias("type"), F.lit("j").alias("job_id"), F.col("user_id").cast("string").alias("tenant_id"))
    return streams.replay(log, 5, "1").select("event_id", "type")
