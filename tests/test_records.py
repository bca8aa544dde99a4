import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl, evolve, html_records, match, resolve, robots, tables
from tessera.operators.evolve import Field, Schema


def groups(df, key="id"):
    out = defaultdict(set)
    for r in df.collect():
        out[r["entity"]].add(r[key])
    return {frozenset(v) for v in out.values()}


def test_exact(spark):
    df = spark.createDataFrame([(1, "Widget", "1"), (2, " WIDGET ", "1"), (3, "Gadget", "1"), (4, None, "1"), (5, None, "1"), (6, "", "1"), (7, "", "1")], "id long, a string, b string")
    assert groups(match.match_exact(df, "id", ["a", "b"])) == {frozenset(x) for x in ({1, 2}, {3}, {4}, {5}, {6, 7})}
    assert groups(match.match_exact(df, "id", [])) == {frozenset(range(1, 8))}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))


def brute(rows, link):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            pairs = [(x or "", y or "") for x, y in zip(rows[i][1:], rows[j][1:], strict=True)]
            comparable = [p for p in pairs if p[0] or p[1]]
            if comparable and link(comparable):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    out = defaultdict(set)
    for i, r in enumerate(rows):
        out[find(i)].add(r[0])
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_composite_and_fuzzy_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
    rows = [(i, rng.choice([None, "", "x", "y", "z"]), rng.choice(["", "p", "q"]), word()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    composite = brute([r[:3] for r in rows], lambda ps: sum(x == y for x, y in ps) / len(ps) >= 0.6)
    assert groups(match.match_composite(df, "id", ["a", "b"], 0.6)) == composite
    fuzzy = brute([(r[0], r[3]) for r in rows], lambda ps: sum(alike(x, y) for x, y in ps) / len(ps) >= 0.7)
    assert groups(match.match_fuzzy(df, "id", ["c"], 0.7)) == fuzzy
    two = brute([(r[0], r[1], r[3]) for r in rows], lambda ps: sum(alike(x, y) for x, y in ps) / len(ps) >= 0.7 - 1e-12)
    assert groups(match.match_fuzzy(df, "id", ["a", "c"], 0.7)) == two


@pytest.mark.parametrize(("seed", "threshold"), [(3, 0.6), (4, 0.5), (5, 0.75), (6, 1.0)])
def test_composite_of_many_keys(spark, seed, threshold):
    rng = random.Random(seed)
    rows = [(i, *(rng.choice([None, "", "x", "y", "z"][: 5 - k % 2]) for k in range(4))) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    assert groups(match.match_composite(df, "id", ["a", "b", "c", "d"], threshold)) == brute(rows, lambda ps: sum(x == y for x, y in ps) / len(ps) >= threshold)


@pytest.mark.parametrize(("seed", "threshold"), [(3, 0.75), (4, 0.85), (5, 0.4)])
def test_fuzzy_of_three_keys(spark, seed, threshold):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab") for _ in range(rng.randint(0, n)))
    rows = [(i, word(8), word(6), rng.choice(["", "Brand", "Bland", None, "other"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    want = brute(rows, lambda ps: sum(alike(x, y) for x, y in ps) / len(ps) >= threshold - 1e-12)
    assert groups(match.match_fuzzy(df, "id", ["a", "b", "c"], threshold)) == want


def test_fuzzy_rows_of_one_brand_do_not_all_meet(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(10, 16))) for _ in range(2000)]
    names += [n[:-1] + "#" for n in names[:300]]
    classes = spark.createDataFrame([(i, n, "acme") for i, n in enumerate(names)], "id long, k0 string, k1 string")
    found = match.fuzzy_candidates(classes, ["k0", "k1"], 0.85, match.Scratch(spark, "t"))
    assert 300 <= found.count() < 2 * 2300


def test_composite_ties_grow_with_rows(spark, monkeypatch):
    """Rows that share three of four keys are tied to one, not to each other."""
    seen = []
    whole = match.closed
    monkeypatch.setattr(match, "closed", lambda *args: seen.append(args[4].count()) or whole(*args))
    df = spark.range(3000).selectExpr("id", "'x' AS a", "'y' AS b", "'z' AS c", "cast(id AS string) AS d")
    assert match.match_composite(df, "id", ["a", "b", "c", "d"], 0.75).select("entity").distinct().count() == 1
    assert seen == [2999]


CASES = [
    ("most_common", [("blue", "a"), ("red", "b"), ("blue", "c"), ("red", "d"), ("blue", "e")], ("blue", "a", True)),
    ("most_common", [("4.5", "a"), ("4.0", "b"), ("4.5", "c"), ("4.0", "d")], ("4.5", "a", True)),
    ("most_recent", [("19.99", "a"), ("24.99", "b"), ("21.99", "c")], ("24.99", "b", True)),
    ("source_priority", [("5", "blog"), ("4.8", "official"), ("5.0", "trusted")], ("4.8", "official", True)),
    ("most_complete", [('"s"', "a"), ('"long one"', "b"), ('"mid"', "c")], ('"long one"', "b", True)),
    ("most_common", [("1", "a"), ("1", "b")], ("1", "a", False)),
]


@pytest.mark.parametrize(("strategy", "values", "expected"), CASES)
def test_conflicts(spark, strategy, values, expected):
    days = ["2024-01-10", "2024-02-15", "2024-01-20", "2024-01-01", "2024-01-02"]
    cells = spark.createDataFrame([("e", "f", i, v, s, days[i]) for i, (v, s) in enumerate(values)], "entity string, field string, ord long, value string, source string, crawled_at string")
    trust = spark.createDataFrame([("blog", "low"), ("official", "authoritative"), ("trusted", "high")], "source string, trust string")
    row = resolve.resolve(cells, strategy, trust).first()
    assert (row["value"], row["source"], row["had_conflict"]) == expected
    assert (row["resolution"] is None) == (not expected[2])


def test_gaps_and_merge(spark):
    done = spark.createDataFrame([("e", "name", '"x"'), ("g", "price", "1")], "entity string, field string, value string")
    merged = resolve.merge_records(done)
    gaps = resolve.missing_fields(merged, ["name", "price"])
    assert {tuple(r) for r in gaps.collect()} == {("e", "price"), ("g", "name")}
    answers = spark.createDataFrame([("e", "price", "2", 0.9), ("g", "name", '""', 0.9), ("g", "other", "1", 0.9), ("e", "price", "3", 0.4)], "entity string, field string, value string, confidence double")
    assert {tuple(r) for r in resolve.fill_gaps(done, gaps, answers).collect()} == {("e", "name", '"x"'), ("g", "price", "1"), ("e", "price", "2")}


def test_schema_actions():
    schema = Schema(1, (Field("a"), Field("b", "number"), Field("c")))
    names = lambda s: [f.name for f in s.fields]
    new = evolve.apply_actions(schema, [{"type": "add_field", "field": "d", "definition": Field("d"), "after": "a"}, {"type": "remove_field", "field": "c"}, {"type": "remove_field", "field": "zz"}])
    assert names(new) == ["a", "d", "b"] and (new.version, new.parent) == (2, 1)
    assert evolve.apply_actions(schema, [{"type": "remove_field", "field": "zz"}]) is schema
    merged = evolve.apply_actions(schema, [{"type": "merge_fields", "field": "a", "aliases": ["c"]}])
    assert names(merged) == ["a", "b"] and merged.aliases == (("a", ("c",)),)
    grouped = evolve.apply_actions(schema, [{"type": "group_fields", "field": "g", "sources": ["b", "c"]}])
    assert names(grouped) == ["a", "g"] and [f.name for f in grouped.fields[1].fields] == ["b", "c"]
    split = evolve.apply_actions(schema, [{"type": "split_field", "field": "b", "targets": [Field("x"), Field("y")]}, {"type": "rename_field", "field": "x", "to": "z"}])
    assert names(split) == ["a", "z", "y", "c"]
    assert names(evolve.apply_actions(schema, [{"type": "merge_fields", "field": "n", "aliases": ["a", "b", "n"]}])) == ["c", "n"]
    renamed = evolve.apply_actions(schema, [{"type": "group_fields", "field": "g", "sources": ["c", "a", "zz"], "mapping": {"c": "x"}}])
    assert names(renamed) == ["g", "b"] and [f.name for f in renamed.fields[0].fields] == ["x", "a"]
    typed = evolve.apply_actions(schema, [{"type": "modify_field", "field": "b", "changes": {"type": "boolean", "odd": 1}}, {"type": "add_field", "field": "a", "definition": Field("a")}])
    assert typed.fields[1].type == "boolean" and typed.version == 2 and names(typed) == names(schema)
    ruled = evolve.apply_actions(schema, [{"type": "set_normalization_rule", "field": "a", "rule": {"type": "enum", "synonyms": {"B": ["b"]}}}, {"type": "update_enum_map", "field": "a", "synonyms": {"C": ["c"]}}])
    assert ruled.fields[0].rule["synonyms"] == {"B": ["b"], "C": ["c"]}


def test_projection(spark):
    df = spark.createDataFrame([(1, '{"a":"x","b":2}'), (2, '{"a":3,"b":"no"}'), (3, "broken")], "id long, data string")
    rows = evolve.project(df, "data", Schema(1, (Field("a"), Field("b", "number"))), ["id"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.0), (2, "3", None), (3, None, None)]


def test_unmapped(spark):
    rows = [(1, 1, "Phone Number", "1", "string"), (2, 2, "phone_number", "2", "number"), (3, 3, "PHONE  NUMBER", "1", "number"), (3, 4, "PHONE  NUMBER", None, "string")]
    df = spark.createDataFrame(rows, "extraction_id long, ord long, name string, value string, type string")
    row = evolve.aggregate_unmapped(df, 4).first()
    assert (row["key"], row["occurrences"], row["frequency"], row["dominant_type"], row["sample_values"]) == ("phone_number", 3, 0.75, "string", ["1", "2"])
    assert row["observed_names"] == ["Phone Number", "phone_number", "PHONE  NUMBER"]


def test_link_scores_and_robots(spark):
    links = spark.createDataFrame([("https://a.com/x",), ("https://a.com/y",), ("https://b.com/z",)], "url string")
    answers = spark.createDataFrame([("https://a.com/x", "0", "odd", "high"), ("https://a.com/y", "7", "partial", "none")], "url string, score string, expected string, priority string")
    assert {tuple(r) for r in crawl.score_links(links, answers).collect()} == {("https://a.com/x", 0.5, "unknown", "high"), ("https://a.com/y", 1.0, "partial", "medium"), ("https://b.com/z", 0.5, "unknown", "medium")}
    rules = spark.createDataFrame([("a.com", "/", False), ("a.com", "/x", True)], "host string, pattern string, allow boolean")
    assert {r["url"] for r in robots.robots_allowed(links, rules).collect()} == {"https://a.com/x", "https://b.com/z"}


ROBOTS = """# all
User-agent: *
Disallow: /private/
Allow: /private/open
Disallow: /*.pdf$
Crawl-delay: 1.5

User-agent: Other
User-agent: tessera/2.0
Disallow: /a*b
Allow: /a?b\\Ec
disallow:
crawl-delay: 3
Sitemap: https://x/y
"""


def plain_allowed(rules, path):
    """Every rule tried on a path."""
    found = [(len(p), a) for p, a in rules if re.match("".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + ("$" if p.endswith("$") else ""), path, re.S)]
    return max(found, default=(0, True))[1]


def test_robots_files(spark):
    files = spark.createDataFrame([("A.com", ROBOTS), ("b.com", None), ("c.com", "<html>no</html>")], "host string, body string")
    for agent, delay in (("Tessera/1.0", 3000), ("crawler", 1500)):
        parsed = robots.parse_robots(files, agent)
        assert [tuple(r) for r in robots.crawl_delays(parsed).collect()] == [("a.com", delay)]
        rules = robots.rule_rows(parsed)
        own = [(r["pattern"], r["allow"]) for r in rules.collect()]
        paths = ["/", "/private/", "/private/x", "/private/open/1", "/x.pdf", "/x.pdf?q", "/ab", "/axxb", "/a?b", "/a?b\\Ec", "/b"]
        urls = spark.createDataFrame([(f"https://{h}{p}",) for h in ("a.com", "b.com") for p in paths], "url string")
        want = {f"https://a.com{p}" for p in paths if plain_allowed(own, p)} | {f"https://b.com{p}" for p in paths}
        assert {r["url"] for r in robots.robots_allowed(urls, rules).collect()} == want and len(own) == 3 - (agent == "Tessera/1.0")


def test_robots_of_very_many_rules(spark):
    rules = spark.range(10_000).selectExpr("'a.com' AS host", "concat('/p', lpad(id, 5, '0')) AS pattern", "id % 3 = 0 AS allow")
    urls = spark.range(5_000).selectExpr("concat('https://a.com/p', lpad(id * 3 + 1, 5, '0'), '/x') AS url")
    assert robots.robots_allowed(urls, rules).count() == 5_000 - 3_333


def test_ids_beside_nulls(spark):
    df = spark.createDataFrame([(2**60 + 1, "https://s.t/", '<a href="/a">A</a>'), (None, "https://s.t/", '<a href="/b">B</a>')], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["text"]) for r in html_records.extract_links(df).collect()} == {(2**60 + 1, "A"), (None, "B")}


def test_long_values_and_the_archive(spark, tmp_path):
    prompt = " ".join(f"rule{i}" for i in range(3000))
    echo = "x" * 5000 + prompt[7000:7040] + "y" * 5000
    near = "x" * 5000 + prompt[7000:7039] + "#" + "y" * 5000
    rows = [(1, {"note": echo}, prompt), (2, {"note": near}, prompt), (3, {"note": None}, None), (4, {"note": "é" * 600}, "é" * 39)]
    df = spark.createDataFrame(rows, "id long, data map<string,string>, prompt string")
    flags = html_records.scan_output(df, "data", "prompt", {"note": 1})
    assert [(r["id"], r["kind"]) for r in flags.collect()] == [(1, "prompt_echo")]
    kept = html_records.archive_suspicious(df, flags.select("id", "kind", "field"), "id", {"job": "j"}, str(tmp_path)).collect()
    assert [(r["id"], r["job"], [tuple(f) for f in r["flags"]]) for r in kept] == [(1, "j", [("prompt_echo", "note")])]


def test_sources_of_values(spark):
    cells = spark.createDataFrame([("e", "f", i, f"s{i}", str(i), str(i % 2)) for i in range(5)] + [("e", "f", 9, "s9", None, None)], "entity string, field string, ord long, source string, raw string, value string")
    [row] = resolve.gathered_sources(resolve.provenance_sources(cells), most=3).collect()
    assert (row["n_sources"], [tuple(s) for s in row["sources"]]) == (5, [("s0", "0", "0"), ("s1", "1", "1"), ("s2", "2", "0")])
    [done] = resolve.provenance(cells, resolve.resolve(cells, "most_common")).collect()
    assert (done["type"], done["n_sources"]) == ("resolved", 5)


def test_links_and_text(spark):
    page = '<title>T</title><body><h1>Head</h1><a href="/a#x">A</a><a href="/a">B</a><a href="mailto:x">m</a><ul><li>one<li>two</ul><table><tr><td>1<td>2</table><script>no</script></body>'
    df = spark.createDataFrame([(1, "https://s.t/", page), (2, None, None)], "page_id long, url string, html string")
    assert [(r["url"], r["text"]) for r in html_records.extract_links(df).collect()] == [("https://s.t/a", "A")]
    row = html_records.preprocess(df).where("page_id = 1").first()
    assert row["title"] == "T" and "# Head" in row["content"] and "- one" in row["content"] and "1 | 2" in row["content"] and "no" not in row["content"]


def test_tables_and_blocks(spark):
    table = "<table><tr><th>Domain<th>Type<th>Sponsoring Manager</tr><tr><td><a href='/d/aaa'>.aaa</a><td>generic<td>AAA Inc</tr><tr><td><a href='/d/bbb'>.bbb</a><td>generic<td>BBB Inc</tr></table>"
    cards = "".join(f'<div class="country card"><h3 class="country-name">{n}</h3><span class="country-capital">{c}</span><span class="country-population">{p}</span></div>' for n, c, p in (("Andorra", "Andorra la Vella", 84000), ("Chad", "N'Djamena", 5)))
    df = spark.createDataFrame([(1, "https://s.t/", table), (2, "https://s.t/", cards)], "page_id long, url string, html string")
    domains = Schema(1, (Field("domain", required=True), Field("type"), Field("manager", required=True), Field("record_url", "url")))
    found = [r["data"] for r in html_records.extract_tables(df, domains).orderBy("seq").collect()]
    assert found[0] == '{"domain": ".aaa", "manager": "AAA Inc", "record_url": "https://s.t/d/aaa", "type": "generic"}' and len(found) == 2
    countries = Schema(1, (Field("name", required=True), Field("capital"), Field("population", "number")))
    found = [r["data"] for r in html_records.extract_blocks(df, countries).orderBy("seq").collect()]
    assert found[0] == '{"capital": "Andorra la Vella", "name": "Andorra", "population": 84000.0}' and len(found) == 2


def test_chunks():
    text = "# A\n" + "x" * 50 + "\n\n" + "y" * 30 + "\n\n" + "z" * 130
    parts = html_records.chunks(text, 60)
    assert all(len(p) <= 60 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_scan(spark):
    prompt = "Extract the name and the price of every product that you can find on this page."
    df = spark.createDataFrame([(1, {"name": prompt[5:60], "price": "has name inside"}, prompt), (2, {"name": "ok"}, prompt)], "id long, data map<string,string>, prompt string")
    found = {(r["id"], r["field"], r["kind"]) for r in html_records.scan_output(df, "data", "prompt", {"name": 2, "price": 99}).collect()}
    assert found == {(1, "name", "prompt_echo"), (1, "name", "field_name_leak"), (1, "price", "field_name_leak"), (2, "name", "cap_hit")}


@pytest.mark.parametrize("window, few", [(1, 0), (7, 0), (7, 200_000), (40, 0), (40, 200_000)])
def test_scan_against_all_runs(spark, tmp_path, monkeypatch, window, few):
    monkeypatch.setattr(html_records, "FEW_CHARACTERS", few)
    rng = random.Random(window)
    text = lambda n: "".join(rng.choices("abcdé 😀", k=n))
    prompts = [text(n) for n in (window - 1, window, 90, 700, 700)]
    rows = [(0, {"note": None, "size": "note"}, None), (1, {"note": prompts[1], "size": ""}, prompts[1])]
    for i in range(2, 150):
        prompt = rng.choice(prompts)
        at, n = rng.randrange(len(prompt) + 1), window + rng.choice((-1, 0, 1))
        value = text(rng.choice((0, 3, 130, 300))) + prompt[at : at + n] + text(rng.choice((0, 5, 200)))
        rows.append((i, {"note": value, "size": value[:60]}, prompt))
    spark.createDataFrame(rows, "id long, data map<string,string>, prompt string").write.parquet(f"{tmp_path}/records")
    flags = html_records.scan_output(spark.read.parquet(f"{tmp_path}/records"), "data", "prompt", {"note": 60, "size": 9}, window)
    runs = lambda v: (v[i : i + window] for i in range(len(v) - window + 1))
    want = {(i, f, "prompt_echo") for i, data, prompt in rows for f, v in data.items() if any(r in (prompt or "") for r in runs(v or ""))}
    want |= {(0, "size", "field_name_leak")} | {(i, f, "cap_hit") for i, data, _ in rows for f, v in data.items() if v is not None and len(v) == {"note": 60, "size": 9}[f]}
    assert sorted(tuple(r) for r in flags.select("id", "field", "kind").collect()) == sorted(want)
    # What grows with the records is never broadcast.
    assert flags._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == (2 if few else 0)


def test_pages_and_upserts(spark):
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    first = tables.keyset_page(df, ["x", "id"], None, 4).collect()
    assert [(r["x"], r["id"]) for r in first] == [(0, 0), (0, 3), (0, 6), (0, 9)]
    second = tables.keyset_page(df, ["x", "id"], (0, 9), 4).collect()
    assert [(r["x"], r["id"]) for r in second] == [(1, 1), (1, 4), (1, 7), (2, 2)]
    assert tables.read_cursor(tables.next_cursor(first, ["x", "id"], 4)) == ["0", "9"] and tables.next_cursor(first, ["x"], 5) is None
    batch = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (20, 9, 3)], "id long, x long, seq long")
    new = tables.upsert(df, batch, ["id"], "seq")
    assert {(r["id"], r["x"]) for r in new.where("id in (1, 20)").collect()} == {(1, 8), (20, 9)} and new.count() == 11
    assert tuple(tables.upsert_counts(df, batch, ["id"]).first()) == (1, 2)
    assert [len(p) for p in tables.pages_of(df, "id", 4)] == [4, 4, 2]


def test_unmapped_of_records(spark):
    df = spark.createDataFrame([(1, 1, '{"a":1,"Extra":"x","more":[2]}'), (2, 2, "broken")], "id long, ord long, data string")
    found = evolve.unmapped_of_records(df, "id", "data", Schema(1, (Field("A"),))).collect()
    assert {(r["extraction_id"], r["name"], r["value"]) for r in found} == {(1, "Extra", '"x"'), (1, "more", "[2]")}


def test_answers(spark):
    rows = [(1, '[{"a":1},{"a":2}]'), (2, '{"data":{"a":3},"confidence":0.9}'), (3, '{"records":[{"a":4}]}'), (4, "oops")]
    found = html_records.parse_answers(spark.createDataFrame(rows, "id long, answer string")).collect()
    assert {(r["id"], r["seq"], r["data"], r["confidence"]) for r in found} == {(1, 0, '{"a":1}', 0.5), (1, 1, '{"a":2}', 0.5), (2, 0, '{"a":3}', 0.9), (3, 0, '{"a":4}', 0.5), (4, 0, "{}", 0.0)}
    pages = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    told = spark.createDataFrame([(1, '{"classification":"single_entry","strategy":"css","confidence":7}'), (2, '{"classification":"odd"}')], "page_id long, answer string")
    assert {tuple(r) for r in crawl.classified(pages, told).collect()} == {(1, "single_entry", "css", 1.0), (2, "irrelevant", "skip", 0.0), (3, "irrelevant", "skip", 0.0)}


def test_singles_and_sanitize(spark):
    page = '<h1>Lamp</h1><img src="/i.png"><span class="price">$29.99</span><p class="brand">Acme</p><ul class="tags"><li>a</li><li>b</li></ul>'
    df = spark.createDataFrame([(1, "https://s.t/", page)], "page_id long, url string, html string")
    schema = Schema(1, (Field("title"), Field("price", "currency"), Field("brand"), Field("image_url", "url"), Field("missing")))
    row = html_records.extract_singles(df, schema).first()
    assert row["data"] == '{"brand": "Acme", "image_url": "https://s.t/i.png", "price": "$29.99", "title": "Lamp"}' and abs(row["confidence"] - 0.48) < 1e-9
    assert '"price": "$29.99"' in html_records.extract_singles(df, None).first()["data"]
    maps = spark.createDataFrame([({"title": "abcdef", "odd": "x"},)], "data map<string,string>")
    assert html_records.sanitize(maps, "data", schema, caps={"title": 3}).first()["data"] == {"title": "abc"}


def test_normalized_cells(spark):
    from tessera.functions import text as X

    rows = [("e", "name", '" the  LAMP "'), ("e", "price", '"$5"'), ("e", "price", "5"), ("e", "tags", '"a, b"'), ("e", "other", '"x"'), ("e", "name", None), ("e", "name", '"Fine"')]
    cells = spark.createDataFrame([(e, f, i, v) for i, (e, f, v) in enumerate(rows)], "entity string, field string, ord long, value string")
    rules = {"name": lambda c: X.normalize_text(c, casing="title"), "price": X.normalize_currency, "tags": X.normalize_list}
    done = resolve.normalize_cells(cells, rules)
    assert [r["value"] for r in done.orderBy("ord").collect()] == ['"The Lamp"', '"5.00"', '"5.00"', '["a","b"]', '"x"', None, '"Fine"']
    assert [r["before"] for r in resolve.changes(done).orderBy("ord").collect()] == ['" the  LAMP "', '"$5"', "5", '"a, b"']


def test_rules_are_worked_out_once(spark):
    from tessera.functions import text as X

    rows = ['"[a"', '"{ a"', '"[A"', "5.00", "5", '"b', '"\\u0041"', '"\\"a"', '""', "true", None]
    cells = spark.createDataFrame([("e", f, i, v) for i, v in enumerate(rows) for f in ("name", "price", "other")], "entity string, field string, ord long, value string")
    done = resolve.normalize_cells(cells, {"name": lambda c: X.normalize_text(c, casing="upper"), "price": X.normalize_currency})
    got = {f: [r["value"] for r in done.where(F.col("field") == f).orderBy("ord").collect()] for f in ("name", "price", "other")}
    assert got["other"] == rows and got["price"] == [*rows[:3], "5.00", '"5.00"', '""', *rows[6:8], '"0.00"', "true", None]
    assert got["name"] == ['"[A"', '"{ A"', '"[A"', "5.00", "5", '""', '"\\u0041"', '"\\"A"', '""', "true", None]
    # A filter on the values does not repeat their rules.
    plan = resolve.changes(done)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and plan.count("parseJson(") == 1


def test_prompts():
    fields = (Field("name", required=True, description="What it is"), Field("price", "currency"), Field("size", "object", fields=(Field("w", "number"),)), Field("kind", "enum", enum_values=("a", "b")))
    assert evolve.describe_fields(fields).splitlines()[0] == "- name [string] (required): What it is" and "  - w [number]" in evolve.describe_fields(fields)
    shape = evolve.json_schema(fields)
    assert shape["required"] == ["name"] and shape["properties"]["price"]["properties"]["amount"] == {"type": "number"} and shape["properties"]["kind"]["enum"] == ["a", "b"]
