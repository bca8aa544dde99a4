"""The pipeline's stages, each on what the one before it kept."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import near_groups, plain_counts, words_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        kept.append((docs, docs := spark.read.parquet(str(tmp_path / str(i)))))
        if i < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    texts = [[{r["doc_id"]: r["text"] for r in df.collect()} for df in pair] for pair in kept[:3]]
    (all_docs, good), (_, single), (_, cut) = texts
    fails = lambda t: (n := plain_counts(t))[0] < 20 or 100 * n[4] > 30 * n[0]
    assert not any(fails(t) for t in good.values()) and set(good) == {i for i, t in all_docs.items() if not fails(t)}
    groups = near_groups(list(good.items()), 80)
    assert set(single) == {i for i, (_, low) in groups.items() if i == low}
    assert all(len(cut[i]) <= len(single[i]) for i in cut)
    sizes = Counter()
    for r in kept[3][1].collect():
        sizes[r["doc_id"]] += len(words_of(r["text"]))
    assert set(sizes) <= set(cut) and all(n <= 3 * len(words_of(cut[i])) for i, n in sizes.items())
    fill = kept[4][1].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert fill[0] <= 4096 and fill[1] <= -(-fill[2] // 4096) + 3
    assert corpus_pipeline.run(spark, SF).count() == kept[4][1].count()


def test_one_of_repeated_rows_stays(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en", "s", 1)] * 3 + [(2, long, "en", "s", 1), (None, long + " end", "en", "s", 1)]
    rows += [(None, "another text of no id at all", "en", None, 1)] * 2 + [(5, "of its own words, told once", "en", "s", 1), (5, "some other words by that id", None, "s", 1)]
    rows += [(None, None, None, None, None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_copies(spark, docs, SF).collect()
    texts = sorted((str(r["doc_id"]), str(r["text"])[:12]) for r in left)
    assert texts == sorted([("1", long[:12]), ("None", "another text"), ("5", "of its own w"), ("5", "some other w"), ("None", "None"), ("6", "")])


def test_odd_documents_pass_all_stages(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rng_words = lambda seed: " ".join(f"w{(seed * 7919 + i * 104729) % 5003}" for i in range(80))
    shared = rng_words(99)
    rows = [(1, rng_words(1), "en", "a", 1), (2, rng_words(2), "en", None, 1), (None, rng_words(3) + " " + shared, "en", "a", 1), (None, rng_words(4) + " " + shared, "en", "b", 1)]
    rows += [(5, rng_words(5), "en", "b", 1)] * 3 + [(6, rng_words(6), None, "b", 1), (6, rng_words(7), None, "b", 1), (7, None, None, None, None), (8, "", "en", "a", 0), (2**60 + 1, rng_words(8), "en", "a", 1)]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    texts = [Counter(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/{i}").collect()) for i in range(3)]
    assert texts[0] == Counter({1: 1, 2: 1, None: 2, 5: 3, 6: 2, 2**60 + 1: 1}) and texts[1] == Counter({1: 1, 2: 1, None: 2, 5: 1, 6: 2, 2**60 + 1: 1})
    kept = [r["text"] for r in spark.read.parquet(f"{tmp_path}/2").where("doc_id IS NULL").collect()]
    assert sum(shared in t for t in kept) == 1
    assert 2**60 + 1 in {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
