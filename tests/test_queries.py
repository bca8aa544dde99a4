"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as driver  # noqa: E402
from tessera.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{float(value):.6f}" if isinstance(value, float) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = driver.queries()[name](spark, SF).toPandas(), duck.sql(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(registry.QUERIES) <= set(driver.queries())


def test_whole_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(3000)]
    text = " \n ".join(words) + ', said "X"'
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r["doc_id"]: r[1] for r in driver.queries()[n](spark, str(tmp_path)).collect()} for n in ("normalize_whole_text", "csv_escape_whole_text", "match_words_whole_text")}
    assert got["normalize_whole_text"] == {1: " ".join(text.split()).lower(), 2: None}
    assert got["csv_escape_whole_text"] == {1: '"' + text.replace('"', '""') + '"', 2: ""}
    assert got["match_words_whole_text"][1] == len(words) + 1


def test_all_rows(spark, duck, tmp_path):
    got = {n: driver.queries()[n](spark, SF).collect() for n in ("provenance_types_all", "upsert_counts_all", "proposed_groups_all")}
    assert sum(r["n_sources"] for r in got["provenance_types_all"]) == duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    assert {r["type"] for r in got["provenance_types_all"]} == {"resolved", "normalized", "merged", "extracted"}
    assert len({r["entity"] for r in got["proposed_groups_all"]}) == duck.sql("SELECT count(DISTINCT p_size % 7) FROM part").fetchall()[0][0]
    # A customer beyond the 50th is known.
    spark.createDataFrame([(7,), (60,), (61,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7,), (60,), (60,), (99,), (99,)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in driver.queries()["upsert_counts_all"](spark, str(tmp_path)).collect()] == [(1, 4)]


def test_titles_of_odd_pages(spark, duck, tmp_path):
    titles = ["<title>a &&&&amp</title>", "<title>token = &quot;7f</title>", "<title> a\n&amp; \tb </title><h1>H</h1>", "<h1>H</h1>", "<title>a<b>c</b></title>", "<title lang='x'>a</title>", "", None]
    spark.createDataFrame(list(enumerate(titles)), "page_id long, html string").selectExpr("*", "'https://s.t/' AS url").write.parquet(f"{tmp_path}/pages.parquet")
    sql = driver.oracle_sql()["page_titles"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(driver.queries()["page_titles"](spark, str(tmp_path)).toPandas()) == rows_of(duck.sql(sql).df())
    read = {r["page_id"]: r["title"] for r in driver.queries()["decoded_page_titles"](spark, str(tmp_path)).collect()}
    assert [read[i] for i in (0, 1, 2, 3, 6, 7)] == ["a &&&&", 'token = "7f', "a & b", "H", None, None]
