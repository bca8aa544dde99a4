"""The opN_ queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import perspectives
from tessera.llm.html_text import main_text
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_report
from tessera.llm.negatives import hard_negatives
from tessera.llm.neighbours import nearest
from tessera.llm.packing import pack
from tessera.llm.periodic import periodic_runs
from tessera.llm.personal import BASE_KINDS, personal_data
from tessera.llm.quality import COUNTS, bind, quality_rules, split_words
from tessera.llm.substrings import repeats_report
from tessera.llm.token_counts import token_counts
from tessera.llm.toxicity import toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules(table(spark, folder, "documents"), carry=["doc_id"])
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, t,
    [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM starts),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM windows WHERE n > 1),
covered AS (SELECT doc_id, sum(g)::BIGINT AS n_repeat_words FROM gaps GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
ruled AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 3 * n_words AS failed FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE failed)::DOUBLE AS f FROM ruled GROUP BY source),
mean AS (SELECT sum(f) / sum(n) AS m FROM hosts),
spread AS (SELECT m, (sum(n * pow(f / n - m, 2)) - m * (1 - m) * count(*)) / sum(n) AS v FROM hosts, mean GROUP BY m),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 10000) ELSE 10000 END AS k FROM spread),
verdicts AS (SELECT source, (f + m * k) / (n + k) <= m + 0.5 * (1 - m) AS host_ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM base JOIN verdicts ON base.source IS NOT DISTINCT FROM verdicts.source
"""

def op1_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), model_file=tokenizer_file("piece_bpe_32k.model"))


def op2_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives(table(spark, folder, "conversations"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE role END AS r0, coalesce(text, '') AS t0 FROM conversations),
named AS (
  SELECT conv_id, turn, replace(replace(r0, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') AS role,
    replace(replace(t0, '<|im_start|>', '<| im_start |>'), '<|im_end|>', '<| im_end |>') AS said FROM t),
numbered AS (SELECT *, coalesce(turn // 256, 9223372036854775807) AS number FROM named),
rows AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, number ORDER BY turn NULLS LAST, role, md5(said)) - 1) // 256 AS sub FROM numbered),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM rows WHERE role <> 'system'),
seen AS (
  SELECT rows.*, speaker,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user ' || role END || chr(10) AS head,
    said || '<|im_end|>' AS tail
  FROM rows JOIN speakers ON rows.conv_id IS NOT DISTINCT FROM speakers.conv_id),
placed AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, speaker, number, sub
    ORDER BY turn NULLS LAST, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM seen),
parts AS (
  SELECT conv_id, speaker, number, sub, string_agg(head || tail || chr(10), '' ORDER BY turn NULLS LAST, role, said) AS text,
    coalesce(string_agg(low::BIGINT || ':' || (low + length(tail))::BIGINT, ',' ORDER BY low) FILTER (WHERE role = speaker), '') AS spans,
    coalesce(sum(length(tail)) FILTER (WHERE role = speaker), 0)::BIGINT AS n_trained
  FROM placed GROUP BY conv_id, speaker, number, sub)
SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY number, sub) AS part, text,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY number, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin,
  length(text)::BIGINT AS n_chars, spans, n_trained
FROM parts
"""


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op5_factorization_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats_report(table(spark, folder, "documents"))


def op7_host_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(table(spark, folder, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_file=tokenizer_file())


def op11_distance_key_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def words_in_cycles(doc_id: Column, text: Column) -> Column:
    """The contract's text of a document: where its id's hash is divisible by ten, words from one on come round again."""
    h, words = F.crc32(doc_id.cast("string")), split_words(text)

    def turned(state: Column) -> Column:
        ws, a, p = state["ws"], state["a"], state["p"]
        return F.array_join(F.transform(ws, lambda w, i: F.when(i >= a, F.get(ws, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    def planned(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = g % n
        return bind(F.struct(ws.alias("ws"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), turned)

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), bind(words, planned)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", words_in_cycles(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    runs = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = periodic_runs(docs).withColumn("longest", longest)
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        "longest.length",
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(runs, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_crf_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in BASE_KINDS]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_trie_token_counts": op1_trie_token_counts,
    "op2_projected_neighbours": op2_projected_neighbours,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op10_sum_of_squares_packing": op10_sum_of_squares_packing,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_factorization_toxicity": op5_factorization_toxicity,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_host_suffix_array": op7_host_suffix_array,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op11_distance_key_negatives": op11_distance_key_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_crf_personal_data": op13_crf_personal_data,
}
ORACLES: dict[str, str] = {"op4_perspective_rotation": OP4_SQL, "op9_quality_rules": OP9_SQL}
