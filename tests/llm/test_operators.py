"""Operators against plain versions of themselves, and the cases that every one of them has to take."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, minhash, mixing, neighbours, packing, quality, queries, substrings, suffixes, token_counts, toxicity
from tessera.llm.chat import perspectives
from tessera.llm.queries import tokenizer_file

SPACE = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string"


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def odd_documents():
    """Nulls, empty and blank texts, repeated rows, ties, one word, very long ones."""
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (5, "x y " * 4000, "b"), (5, "x y " * 4000, "b"), (None, "stray row", None), (6, "é ü 　 wide", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns with the names of outputs must not disturb.
    return spark.createDataFrame(odd_documents(), DOCS).withColumn("kept", F.lit("mine")).withColumn("score", F.lit(7)).withColumn("size", F.lit("s"))


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- token counts


def best_cut(word, lexicon):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * lexicon.byte, -(best[end - 1][1] + size))]
        options += [(best[b][0] + lexicon.pieces[word[b:end]], -(best[b][1] + 1)) for b in range(end) if word[b:end] in lexicon.pieces]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark, odd):
    lexicon = token_counts.zipf_lexicon(tokenizer_file("piece_bpe_32k.model"))
    rows = token_counts.token_counts(odd, model_file=tokenizer_file("piece_bpe_32k.model"), most_words=3).collect()
    count = Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in rows)
    ascii_words = lambda t: [w.decode() for w in (t or "").encode().split()]
    want = Counter((i, len(ascii_words(t)), sum(best_cut("▁" + w, lexicon) for w in ascii_words(t))) for i, t, _ in odd_documents())
    assert count == want
    assert token_counts.token_counts(empty(spark), model_file=tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_trie_shares_prefixes():
    rng = random.Random(3)
    lexicon = token_counts.Lexicon({"a": -1.0, "ab": -1.5, "b": -1.2, "bab": -1.1, "aa": -2.0}, -4.0)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    assert token_counts.trie_counts(words, lexicon) == [best_cut(w, lexicon) for w in words]


# --- neighbours


def answers(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    data = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    data[100:300] = data[100]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (1250, []), (None, [1.0] * 16)]
    rows += [(1200, [1.0, 2.0]), (1300, [2.0, 1.0]), (1301, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("row", F.lit("clash"))
    got = answers(neighbours.nearest(df, F.col("vec_id") % 50 == 0, cell_rows=120, block_queries=7))
    x = data.astype(float)
    norms, hits, total = np.sqrt((x * x).sum(axis=1)), 0, 0
    assert set(got) == {*range(0, 900, 50), 1200, 1300}
    assert [i for i, _ in got[1200]] == [1301, 1300] and got[1300][0][1] == pytest.approx(3 / 10**0.5)
    for q in range(0, 900, 50):
        cos = (x * x[q]).sum(axis=1) / (norms * norms[q])
        order = [i for i in np.lexsort((np.arange(900), -cos)) if i != q][:5]
        hits, total = hits + len({i for i, _ in got[q]} & set(order)), total + 5
        assert all(abs(cos[i] - s) < 1e-12 for i, s in got[q]) and len(got[q]) == 5
    assert hits / total >= 0.9
    assert [i for i, _ in got[150]] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(7, [1.0, 2.0, 3.0])] * 6 + [(100 + i, rng.normal(size=3).tolist()) for i in range(10)] + [(50, [1.1, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cell in (16_384, 2):
        assert [i for i, _ in answers(neighbours.nearest(df, F.col("vec_id") == 50, cell_rows=cell))[50]] == [7] * 5
        assert [i for i, _ in answers(neighbours.nearest(df, F.col("vec_id") == 7, cell_rows=cell))[7]] == [7] * 30
    huge = [(0, [3e200, 4e200]), (1, [4e300, 3e300]), (2, [1e-200, 0.0]), (3, [-1e308, 1e308]), (4, [5e-324, 0.0])]
    got = answers(neighbours.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [1, 2, 4, 3] and [s for _, s in got[0]] == pytest.approx([24 / 25, 0.6, 0.6, 0.1 * 2**0.5])
    same = spark.range(20_000).selectExpr("id AS vec_id", "array(1.0D, 2.0D, 2.0D) AS embedding")
    got = answers(neighbours.nearest(same, F.col("vec_id") % 5000 == 0, cell_rows=1000))
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i in range(6) if i != q][:5] for q in range(0, 20_000, 5000)}


def test_cells_far_away_are_passed_by(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(64, 24))
    x = np.repeat(centres, 200, axis=0) + 0.02 * rng.normal(size=(64 * 200, 24))
    points = x / np.sqrt((x * x).sum(axis=1))[:, None] @ neighbours.projection(24, 20240)
    tree = neighbours.CellTree(points[::5], 40)
    cells = tree.cell_of(points)
    assert tree.cells >= 60 and np.bincount(cells, minlength=tree.cells).max() < 500
    numbers = np.arange(tree.cells)
    low, high = (np.stack([f(points[cells == c], axis=0) for c in numbers]) for f in (np.min, np.max))
    import pyarrow as pa

    batch = pa.table({"row": [0], "vec_id": [0], "vector": [[1.0]], "dim": pa.array([24], pa.int32()), "cell": [int(cells[0])], "bound": [0.999], "point": [points[0].tolist()]})
    opened = list(neighbours.open_cells({24: (numbers, low, high)}, neighbours.chi_square_point(0.95))(iter(batch.to_batches())))
    assert sum(b.num_rows for b in opened) <= 4


# --- near duplicates


def shingle_set(text, length=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()


def near_groups(rows, percent):
    sets, parent = {i: shingle_set(t) for i, t, *_ in rows}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("percent", "block"), [(80, 1024), (85, 1024), (80, 2)])
def test_near_duplicates(spark, percent, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(percent)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for base in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 200]))]
        for _ in range(12):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + base, " ".join(own).title() if rng.random() < 0.3 else " ".join(own), "s"))
    rows += [(900, "few words", "s"), (901, "FEW  words", "s"), (902, "few words more", "s"), (903, None, "s"), (904, " ", "s"), (-5, rows[0][1], "s")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), percent=percent).collect()}
    want = near_groups(rows, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_odd(spark, odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(odd_documents())
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(9)
    pool = minhash.mixed(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    pairs = []
    for shared in (0, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        pairs.append([*(m.tolist() for m in minhash.packed_bits(np.stack([minhash.minima(a), minhash.minima(b)]))), shared / (2000 - shared)])
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, truth double")
    for r in df.select(minhash.estimated(F.col("a"), F.col("b")).alias("e"), "truth").collect():
        assert abs(r["e"] - r["truth"]) < 0.16


# --- chat


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 600, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, None, "eve", "é"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in perspectives(df).collect()}
    assert set(got) == {(1, "ann", 1), (1, "ann", 2), (1, "bob", 1), (1, "bob", 2), (1, "unknown", 1), (1, "unknown", 2), (None, "ann", 1), (3, "eve", 1)}
    ann = got[1, "ann", 1]
    assert ann["text"] == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi <| im_end |><|im_end|>\n<|im_start|>user bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    spans = [tuple(map(int, s.split(":"))) for s in ann["spans"].split(",")]
    assert [ann["text"][a:b] for a, b in spans] == ["hi <| im_end |><|im_end|>", "bye<|im_end|>"]
    assert ann["n_trained"] == sum(b - a for a, b in spans) and got[1, "ann", 2]["begin"] == ann["n_chars"] == len(ann["text"])
    assert got[1, "unknown", 2]["text"] == "<|im_start|>assistant\nlate<|im_end|>\n" and got[1, "unknown", 1]["spans"] == ""
    assert perspectives(df.where("false")).count() == 0


def test_crowded_turns(spark):
    rng = random.Random(4)
    rows = [(1, rng.choice([None, 0, 0, 1, 7]), rng.choice(["ann", "bob", "system"]), rng.choice(["yes", "no", "é" * 40, None])) for _ in range(300)]
    rows += [(None, None, "eve", "same")] * 50 + [(2, i, "ann", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = db.sql(queries.OP4_SQL.replace("256", "8")).df()
    got = perspectives(df, part_turns=8).toPandas()
    texts = lambda frame: sorted(tuple(map(str, r)) for r in frame[got.columns].fillna({"conv_id": -1}).astype({"conv_id": "int64"}).itertuples(index=False))
    assert len(got) > 60 and texts(got) == texts(want)
    assert got["text"].str.count("im_start").max() == 8


# --- toxicity


def toxic_rows(n, seed=5):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "nasty,", "awful"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark, odd):
    rows, labels = toxic_rows(1500)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    truth, held = dict(labels), [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    # Held-out labels are not read.
    turned = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    strange = toxicity.toxicity(odd, marks).collect()
    assert len(strange) == len(odd_documents()) and all(0 <= r["score"] <= 1 for r in strange)
    assert toxicity.toxicity(empty(spark), marks).count() == 0
    assert all(r["score"] == pytest.approx(0.5) for r in toxicity.toxicity(odd, marks.where("false")).collect())


def test_machine_learns_pairs():
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(3000)]
    labels = np.array([int((0 in r) and (1 in r)) for r in rows])
    machine = toxicity.fit(np.arange(6), rows, labels, epochs=60)
    assert ((machine.score(rows) > 0.5) == labels).mean() > 0.97
    assert np.abs(machine.factors[0] @ machine.factors[1]) > 0.5


def test_pairs_are_counted_in_parts():
    rng = np.random.default_rng(31)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(400)]
    label = np.array([{3, 7} <= set(r.tolist()) or rng.random() < 0.05 for r in rows]).astype(int)
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    whole = toxicity.interacting(flat, sizes, label, np.arange(40), 2.5)
    assert 2 <= len(whole) < 40
    for most in (1, 37, 1000):
        assert toxicity.interacting(flat, sizes, label, np.arange(40), 2.5, most).tolist() == whole.tolist()


def test_scores_are_sums_over_pairs():
    rng = np.random.default_rng(15)
    machine = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [np.flatnonzero(rng.random(9) < 0.4).astype(np.int32) for _ in range(200)] + [np.empty(0, dtype=np.int32)]
    for row, got in zip(rows, machine.score(rows), strict=True):
        raw = 0.3 + sum(machine.weights[i] for i in row)
        raw += sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(row) for j in row[:n])
        assert got == pytest.approx(1 / (1 + math.exp(-raw)))


def test_terms_that_only_their_pair_tells(spark):
    rng = random.Random(16)
    rows, labels = [], []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([rng.choice([f"w{n}" for n in range(200)]) for _ in range(8)] + ["left"] * a + ["right"] * b), "s"))
        labels.append((i, int(a != b)))
    docs, marks = spark.createDataFrame([*rows, *rows[:50]], DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, marks).collect() if r["held_out"]}
    assert sum((got[i] > 0.5) == bool(labels[i][1]) for i in got) / len(got) > 0.97


def test_pairs_of_neutral_terms(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(6000):
        words = [rng.choice([f"w{n}" for n in range(300)]) for _ in range(rng.randint(5, 30))]
        group, insult = rng.random() < 0.15, rng.random() < 0.15
        vile = not group and not insult and rng.random() < 0.15
        words += ["group"] * group + ["insult"] * insult + ["vile"] * vile
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(vile or (group and insult))))
    truth = dict(labels)
    used = [(words.split(), truth[i]) for i, words, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    for term in ("group", "insult"):
        with_it, ones = [y for w, y in used if term in w], sum(y for _, y in used)
        share = len(with_it) / len(used)
        error = (share * (1 - share) * (1 / ones + 1 / (len(used) - ones))) ** 0.5
        assert abs(sum(with_it) / ones - (len(with_it) - sum(with_it)) / (len(used) - ones)) < 5 * error
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, marks).collect() if r["held_out"]}
    pairs = [i for i in got if {"group", "insult"} <= set(rows[i][1].split())]
    alone = [i for i in got if len({"group", "insult"} & set(rows[i][1].split())) == 1]
    assert len(pairs) > 20 and sum(got[i] for i in pairs) / len(pairs) > 0.9
    assert sum(got[i] for i in alone) / len(alone) < 0.05


# --- substrings


def test_deep_shallow_sort():
    rng = random.Random(7)
    text = bytes(rng.choice(b"ab") for _ in range(1500)) + bytes(300) + b"abcabcabc" * 60
    data = np.frombuffer(text, dtype=np.uint8)
    starts = np.arange(len(data) - 100)
    for shallow in (8, 32, 96):
        order, cls = suffixes.deep_shallow_sort(data, starts, starts % 3, 100, shallow)
        keys = [(i % 3, text[i : i + 100]) for i in order]
        assert keys == sorted(keys) and all((keys[i] == keys[i - 1]) == (cls[i] == cls[i - 1]) for i in range(1, len(keys)))


def test_sort_of_several_lengths():
    rng = random.Random(8)
    text = bytes(rng.choice(b"ab") for _ in range(40)) * 60
    data, starts = np.frombuffer(text, dtype=np.uint8), np.array([rng.randrange(len(text) - 168) for _ in range(900)])
    groups = np.array([rng.randrange(5) for _ in starts])
    lengths = np.array([100, 101, 120, 133, 168])[groups]
    order, cls = suffixes.deep_shallow_sort(data, starts, groups, lengths)
    keys = [(groups[i], text[starts[i] : starts[i] + lengths[i]]) for i in order]
    assert keys == sorted(keys) and all((keys[i] == keys[i - 1]) == (cls[i] == cls[i - 1]) for i in range(1, len(keys)))


def cut_plain(rows, length):
    seen, out = {}, {}
    for i, text in sorted((i, t or "") for i, t, *_ in rows):
        body = text.encode()
        mark = np.zeros(len(body), dtype=bool)
        for p in range(len(body) - length + 1):
            if seen.setdefault(body[p : p + length], (i, p)) != (i, p):
                mark[p : p + length] = True
        spans = int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum())
        rest = bytes(np.frombuffer(body, dtype=np.uint8)[~mark])
        out[i] = (len(body), int(mark.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def passage_rows(seed, n=150):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(60, 400))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.7 else "".join(rng.choice("xyzw ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        rows.append((i - 20, "".join(parts), "s"))
    return [*rows, (900, None, "s"), (901, "", "s"), (902, "a" * 500, "s"), (903, "ab" * 300, "s")]


@pytest.mark.parametrize("hot_limit", [30_000, 2])
def test_repeats(spark, hot_limit):
    rows = passage_rows(hot_limit)
    docs = spark.createDataFrame(rows, DOCS)
    scratch = substrings.Scratch(spark, "t")
    _, bodies = substrings.keyed_bodies(docs, scratch, "doc_id", "text", ["doc_id"])
    ranges = substrings.repeated_ranges(bodies, scratch, 100, hot_limit)
    got = bodies.join(ranges, "doc_id", "left").select("doc_id", "body", "ranges").mapInArrow(substrings.digest_rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    want = cut_plain(rows, 100)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want
    if hot_limit > 2:
        left = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
        assert left[900] is None and all(len((left[i] or "").encode()) <= want[i][0] - want[i][1] for i in want)


def test_repeats_odd(spark, odd):
    rows = substrings.repeats_report(odd).collect()
    assert len(rows) == len(odd_documents()) and {r["n_bytes"] for r in rows if r["doc_id"] == 5} == {16000}
    assert substrings.repeats_report(empty(spark)).count() == 0
    clash = spark.createDataFrame([(1, "r" * 150 + "s" * 150, 3), (2, "r" * 150, 4)], "doc_id long, text string, __ranges int").withColumn("ranges", F.lit("mine"))
    assert {(r["doc_id"], r["text"], r["__ranges"], r["ranges"]) for r in substrings.remove_repeats(clash).collect()} == {(1, "rs", 3, "mine"), (2, "", 4, "mine")}


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(8)
    text = " ".join(f"word{rng.randint(0, 900)}" for _ in range(500))
    head = " ".join(f"head{rng.randint(0, 900)}" for _ in range(60))
    rows = [(7, text + head, "s")] * 2000 + [(9, "of its own " + head, "s")] + [(None, head * 2, "s")] * 3
    unequal = [(20, "x" * 30 + text[:400], "s"), (20, text[:300] + "y" * 30, "s"), (20, "no copy of anything", "s")]
    docs = spark.createDataFrame(rows + unequal, DOCS)
    got = Counter(tuple(r) for r in substrings.repeats_report(docs).collect())
    distinct = {7: text + head, 9: rows[2000][1]}
    _, documents = substrings.keyed_bodies(docs, substrings.Scratch(spark, "t"), "doc_id", "text", ["doc_id"])
    keys = {bytes(r["body"]).decode(): r["doc_id"] for r in documents.collect()}
    assert len(keys) == 6 and [keys[t] for t in distinct.values()] == [7, 9] and keys[head * 2] >= 2**62 and sum(keys[t] == 20 for _, t, _ in unequal) == 1
    want = cut_plain([(k, t, "s") for t, k in keys.items()], 100)
    assert got == Counter((i, *want[keys[t]]) for i, t, _ in rows + unequal)
    assert want[7][1:3] == (0, 0) and want[9][2] == 1
    left = substrings.remove_repeats(docs).collect()
    assert Counter(r["doc_id"] for r in left) == Counter(i for i, _, _ in rows + unequal) and {r["text"] for r in left if r["doc_id"] == 7} == {text + head}


# --- html


def block_texts(page):
    return [text for text, _ in html_text.content_blocks(page)]


def test_blocks():
    page = """<html><head><title>T</title></head><body><header>H</header><div id="cookie-notice">C</div><article><h1>A &amp; B</h1>
    <p>one<b> two<p>three <i>four</i><br>five<ul><li>x<li>y</ul><form>F</form><div class="comments"><p>no</div>tail</article><aside>S</aside>
    <script>if(a<b){"</p>"}</script><p>out</body>"""
    assert html_text.content_blocks(page) == [(t, 0) for t in ["A & B", "one two", "three four five", "x", "y", "tail"]] + [("out", 1)]
    assert block_texts("<p>a &lt; b</p><div class=ad>zz<p>q</div>k") == ["a < b", "k"]
    assert block_texts('<div class="post has-sidebar ad-free"><p>in</p><div class="siteFooter">x</div></div>') == ["in"]
    for odd_page in ("", "<<<>>", "<!-- x", '<a href="x>y', "<p" * 2000, "</div>" * 50, "<nav><p>all"):
        html_text.content_blocks(odd_page)


def test_blocks_lose_no_text():
    raw = "<p>İİİİİİİİİİİİ</p><SCRIPT>x()</Script ><p>abcdefghij klm</p><p>tail</p>"
    assert block_texts(raw) == ["İ" * 12, "abcdefghij klm", "tail"]
    for name in ('class="page menu-open"', 'class="layout-header-fixed"', 'id="related-work"', 'class="sidebar"'):
        assert block_texts(f"<body><div {name}><p>the only text</p><p>and more</p></div></body>") == ["the only text", "and more"]
    assert block_texts('<form id="all"><h1>t</h1><p>long text of a page</p><p>and more</p></form><nav>n</nav><p>x</p>') == ["t", "long text of a page", "and more", "x"]
    assert block_texts("<main><p>the report</p></main><article><p>teaser</p></article>") == ["the report", "teaser"]
    assert block_texts('<p>a <span class="ad"><span>x</span> y</span> b</p>') == ["a b"]
    assert block_texts('<article><p>Sh.</p></article><div class="ad"><p>very long</p><p>advert of several blocks</p></div>') == ["Sh."]
    assert block_texts('<p>short</p><div id="comments"><p>many more</p><p>words of readers</p></div>') == ["short"]
    assert block_texts('<article><header class="entry-header"><h1>title</h1></header><p>x</p></article>') == ["title", "x"]


def test_repeated_suffixes():
    rng = np.random.default_rng(8)
    for _ in range(200):
        sizes = rng.integers(0, 12, rng.integers(1, 6))
        tokens, pages, length, least = rng.integers(0, 3, sizes.sum()), np.repeat(np.arange(len(sizes)), sizes), int(rng.integers(1, 6)), int(rng.integers(2, 4))
        held = defaultdict(set)
        runs = [i for i in range(len(tokens) - length + 1) if pages[i] == pages[i + length - 1]]
        for i in runs:
            held[tuple(tokens[i : i + length])].add(pages[i])
        want = {i: n for i in runs if (n := len(held[tuple(tokens[i : i + length])])) >= least}
        at, counts = html_text.repeated_suffixes(tokens, pages, length, least)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == want


def plain_main_text(rows, length=8, least=3, shares=(0.5, 0.01)):
    """Every run of every page, counted by host in a dictionary."""
    read, held, pages = [], defaultdict(set), Counter()
    for n, (i, url, page) in enumerate(rows):
        m = re.match(r"https?://([^/]+)", url or "")
        # A short block counts as a run of its own.
        filled = lambda words: words if len(words) >= length else ["<", *words, *[">"] * (length - 1 - len(words))]
        tokens = [(w, k, b) for b, (t, k) in enumerate(html_text.content_blocks(page or "")) for w in filled(t.split())]
        read.append((i, url, m[1] if m else n, tokens))
        pages[read[-1][2]] += 1
        for at in range(len(tokens) - length + 1):
            held[read[-1][2], tuple(w for w, _, _ in tokens[at : at + length])].add(n)
    out = []
    for i, url, host, tokens in read:
        gone = set()
        for at in range(len(tokens) - length + 1):
            part = tokens[at : at + length]
            share = shares[min(k for _, k, _ in part)]
            if len(held[host, tuple(w for w, _, _ in part)]) >= max(least, math.ceil(share * pages[host])):
                gone.update(range(at, at + length))
        main = {n for n, (_, k, _) in enumerate(tokens) if k == 0}
        if main and main <= gone:
            gone -= main
        blocks = defaultdict(list)
        for n, (w, _, b) in enumerate(tokens):
            if n not in gone and w not in ("<", ">"):
                blocks[b].append(w)
        text = "\n".join(" ".join(b) for b in blocks.values())
        out.append((i, url, text, len(text)))
    return out


def test_main_text(spark):
    rng = random.Random(9)
    notice = "please read our terms before you go on to use this site today"
    rare = "this passage is said again in a few of the articles here but not in many"
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    rows = [(i, f"https://h.com/{i}", f"<body><p>{prose()}</p><p>{notice if i % 5 else prose()}</p><p>{prose()} {rare if i % 4 == 0 else ''}</p></body>") for i in range(60)]
    rows += [(i, f"https://z.com/{i}", f"<body><p>{rare if i < 70 else notice}</p><article><p>{prose()}</p><p>{prose() if i % 4 else rare}</p></article></body>") for i in range(60, 110)]
    rows += [(i, "https://wall.com/", f'<div class="cookie-banner"><p>{notice}</p><p>and so on</p></div>') for i in range(110, 114)]
    rows += [(i, "https://same.com/", f"<p>{prose() if i == 114 else rare}</p>") for i in range(114, 119)]
    rows += [(200, "https://other.com/", "<p>only\n page</p>"), (201, None, None), (202, "no host", "<p>x&nbsp;y"), (202, "no host", "<p>x&nbsp;y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    want = plain_main_text(rows)
    for shard in (400, 10):
        got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.main_text(df, shard_pages=shard).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    texts = {i: text for i, _, text, _ in want}
    # The pages of a host decide: the notice of most pages goes, a passage of some stays unless it stands beside the articles.
    assert not any(notice in texts[i] for i in range(110)) and rare in texts[4] and texts[110] == ""
    assert [texts[i].count(rare) for i in (61, 64, 115)] == [0, 1, 1] and texts[202] == "x y"
    assert html_text.main_text(df.where("false")).count() == 0


def test_pages_of_a_host_decide_about_short_and_named_blocks(spark):
    """The text told by the fixture itself: what each page has of its own, between what its host repeats."""
    rng = random.Random(21)
    prose = lambda n=25: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        lead, body, dishes, found, short = prose(), prose(), prose(12), prose(12), prose(3)
        inside = f'<div class="banner">{lead}</div><p>{body}</p><div class="menu">{dishes}</div><div class="search">{found}</div><p>{short}</p>'
        around = '<div>Home About Contact</div>{}<div>Follow us</div><div class="user-feedback"><p>I like it %d</p></div>' % i
        rows.append((i, f"https://plain.com/{i}", around.format(f"<p>{lead}</p><p>{body}</p><p>{short}</p>")))
        want[i] = "\n".join((lead, body, short))
        again = '<div class="menu">All our pages at a glance, sorted by their names</div>' if i % 2 else ""
        rows.append((100 + i, f"https://zoned.com/{i}", f"<nav>Home</nav><article>{inside}{again}<fieldset>{found} too</fieldset></article>"))
        want[100 + i] = "\n".join((lead, body, dishes, found, short, f"{found} too"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == want


def test_large_group_of_equal_pages(spark):
    rows = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS page_id", "'https://a.com/' AS url", "'<p>one two three four five six seven eight nine</p>' AS html")
    got = html_text.main_text(rows).groupBy("text").count().collect()
    assert [tuple(r) for r in got] == [("one two three four five six seven eight nine", 5000)]


# --- mixing


def test_targets():
    assert mixing.targets([80, 80, 80], [5, 2, 1], 3) == pytest.approx([150, 60, 30])
    capped = mixing.targets([1000, 10, 10], [1, 5, 5], 3)
    assert capped == pytest.approx([960, 30, 30]) and sum(capped) == pytest.approx(1020)
    assert mixing.targets([0, 0], [5, 2], 3) == [0.0, 0.0] and mixing.targets([], [], 3) == []


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(42).cast("long")).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def plain_targets(sizes, weights, most_repeats):
    """Each source's share of all words by weight, but at most most_repeats times its size; the excess goes to the others by weight."""
    out, left, open_ones = [0.0] * len(sizes), float(sum(sizes)), [i for i, n in enumerate(sizes) if n]
    while open_ones:
        rate = left / sum(weights[i] for i in open_ones)
        over = [i for i in open_ones if weights[i] * rate > most_repeats * sizes[i]]
        for i in over or open_ones:
            out[i] = float(most_repeats * sizes[i]) if over else weights[i] * rate
            left -= out[i]
        open_ones = [i for i in open_ones if i not in set(over)] if over else []
    return out


def test_mix(spark, odd):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    report = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    assert {i: r["size"] for i, r in report.items()} == {i: len(words_of(t)) for i, t, _ in rows}
    names = ["a", "b", "c", None]
    sizes = [sum(len(words_of(t)) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, plain_targets(sizes, [5, 2, 1, 5], 3), strict=True))
    for n, size in zip(names, sizes, strict=True):
        own = [report[i] for i, _, s in rows if s == n]
        assert {(r["source_size"], round(r["target"], 6)) for r in own} == {(size, round(want[n], 6))}
        assert abs(sum(r["taken"] for r in own) - want[n]) <= 64
    assert all(r["taken"] <= 3 * r["size"] for r in report.values())
    assert {i: r["taken"] for i, r in report.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs.repartition(3)).collect()}
    texts, out = {i: words_of(t) for i, t, _ in rows}, Counter()
    for r in mixing.mix_documents(docs).collect():
        own = words_of(r["text"])
        assert set(own) <= set(texts[r["doc_id"]]) and len(set(own)) == len(own)
        out[r["doc_id"]] += len(own)
    assert all(out[i] == r["taken"] for i, r in report.items())
    strange = mixing.mix_report(odd.drop("size")).collect()
    assert len(strange) == len(odd_documents()) and all(r["taken"] <= 3 * r["size"] for r in strange)
    clash = docs.limit(20).selectExpr("*", "'x' AS src", "'y' AS target", "'z' AS round", "1 AS taken", "2 AS size", "3 AS __size", "4 AS row", "5 AS `a.b`", "6 AS doc")
    assert {tuple(r)[3:] for r in mixing.mix_documents(clash).collect()} == {("x", "y", "z", 1, 2, 3, 4, 5, 6)}
    assert mixing.mix_report(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_mix_of_equal_rows(spark):
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c d' AS text", "'s' AS source").union(spark.createDataFrame([(1, "x y", "t")], DOCS))
    assert mixing.mix_report(rows).count() == 3001
    placed, _ = mixing.mix(rows, bucket_rows=100)
    begins = [r["begin"] for r in placed.where("size = 4").select("begin").collect()]
    assert sorted(begins) == list(range(0, 12_000, 4))


def test_mix_of_many_sources(spark, monkeypatch):
    """In groups of few, to the targets of a plain plan."""
    monkeypatch.setattr(mixing, "SOURCES_OF_A_GROUP", 16)
    rng = random.Random(19)
    names = sorted(f"s{i}" for i in range(50)) + [None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 5, 90, 400])), names[min(50, int(rng.expovariate(0.08)))]) for i in range(300)]
    rows += [(1000 + i, None, n) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, DOCS)
    report = {r["doc_id"]: r for r in mixing.mix_report(docs, block=8).collect()}
    assert {i: r["size"] for i, r in report.items()} == {i: len(words_of(t)) for i, t, _ in rows}
    sizes = [sum(len(words_of(t)) for _, t, s in rows if s == n) for n in names]
    for n, size, target in zip(names, sizes, plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(51)], 3), strict=True):
        own = [i for i, _, s in rows if s == n]
        assert {(report[i]["source_size"], round(report[i]["target"], 6)) for i in own} == {(size, round(target, 6))}
        assert abs(sum(report[i]["taken"] for i in own) - target) < 2 * max(1, min(8, size // 256))
    assert all(r["taken"] <= 3 * r["size"] for r in report.values())
    again = mixing.mix_report(docs.repartition(3), block=8).collect()
    assert {i: r["taken"] for i, r in report.items()} == {r["doc_id"]: r["taken"] for r in again}


def test_mix_of_sources_smaller_than_a_block(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "'a b c d e f g h i j' AS text", "concat('s', lpad(id, 6, '0')) AS source")
    rows = mixing.mix_report(docs).collect()
    assert abs(sum(r["taken"] for r in rows) - 100_000) <= 32 and all(abs(r["taken"] - r["target"]) <= 1 for r in rows)


def test_mix_against_plain_slots(spark):
    """Every slot of every source, permuted one by one, against the operator's joins."""
    rng = random.Random(17)
    rows = [(i, " ".join(["w"] * rng.randint(0, 90)), rng.choice("abc")) for i in range(80)]
    placed, takes = mixing.mix(spark.createDataFrame(rows, DOCS), block=8)
    spots, wanted = placed.collect(), Counter()
    for r in takes.collect():
        wanted[r["src"], r["begin"]] += r["taken"]
    plan = {r["src"]: (r["block"], r["blocks"], r["source_size"], r["target"]) for r in spots}
    used = defaultdict(Counter)
    for r in takes.select("src", "round", "index").distinct().collect():
        used[r["src"]][r["round"], r["index"]] += 1
    carried = Counter()
    for src, (block, blocks, size, target) in sorted(plan.items()):
        assert block == min(8, max(1, size // 256)) and blocks == -(-size // block)
        full = min(int(target // size), 3)
        part = math.floor((target - full * size) / block + carried[block] + 0.5)
        carried[block] += (target - full * size) / block - part
        rounds = Counter(r for r, _ in used[src])
        assert rounds == Counter({r: n for r, n in [(r, blocks) for r in range(full)] + [(full, part)] if n})
        for r in spots:
            if r["src"] == src and r["size"]:
                own = sum(max(0, min(r["begin"] + r["size"], block * (i + 1)) - max(r["begin"], block * i)) for _, i in used[src])
                assert wanted[src, r["begin"]] == own


# --- quality


def plain_counts(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        good = " ".join(rng.choice(["ab", "c#d", "é", "f|g", "h\ni"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 90)))
        rows.append((i, good if i % 3 else "same words again and again in every line here\n" * rng.randint(1, 6), "junk" if not i % 3 else rng.choice(["x", None])))
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, _ in rows:
        n = plain_counts(text)
        assert tuple(got[i][c] for c in quality.COUNTS) == n
        assert got[i]["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    strange = quality.quality_rules(odd.withColumn("host_ok", F.lit("x")).withColumn("n_words", F.lit("x"))).collect()
    assert sorted(tuple(r[c] for c in quality.COUNTS) for r in strange) == sorted(plain_counts(t) for _, t, _ in odd_documents())
    assert quality.quality_rules(empty(spark)).count() == 0


def test_hosts_of_junk_go(spark):
    hosts = spark.createDataFrame([("junk", 1000, 990), ("fine", 1000, 10), ("small", 2, 2)], "h string, n long, failed long")
    ok = {r["h"]: r["host_ok"] for r in quality.host_verdicts(hosts, 0.8).collect()}
    assert ok == {"junk": False, "fine": True, "small": True} or ok == {"junk": False, "fine": True, "small": False}


def test_documents_go_with_their_host(spark):
    """Documents that pass by themselves go with a host of failures by other rules, and only with such a host."""
    plain = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    failing = [
        lambda i: " ".join(f"{i}#{j}|$" for j in range(40)),
        lambda i: "one two\n" * 5 + plain(i),
        lambda i: " ".join(f"{chr(97 + j % 26)}{j % 10}" for j in range(i, i + 90)),
    ]
    rows, bad = [], set()
    for host, n, share in [("junk", 200, 0.8), ("a", 400, 0.1), ("b", 400, 0.1), ("c", 400, 0.12), (None, 300, 0.05)]:
        for k in range(n):
            i, fails = len(rows), k < share * n
            bad |= {i} if fails else set()
            rows.append((i, failing[i % 3](i) if fails else plain(i), host))
    rows.append((len(rows), failing[0](0), "one"))
    docs = spark.createDataFrame(rows, DOCS)
    clashing = docs.withColumns({c: F.lit(7) for c in ("__host", "__ok", "host", "of", "doc", "c", "failed", "n_lines", "host_ok")})
    for given in (docs, clashing):
        got = {r["doc_id"]: r for r in quality.quality_rules(given).collect()}
        assert set(quality.quality_rules(given).columns) == {*given.columns, *quality.COUNTS, "base_failed", "host_rate", "kept"}
        for i, text, host in rows:
            n = plain_counts(text)
            base = n[0] < 20 or 100 * n[4] > 30 * n[0]
            assert got[i]["base_failed"] == base and got[i]["kept"] == (not base and host != "junk"), (i, host)
    assert sum(not r["base_failed"] and r["source"] == "junk" for r in got.values()) > 100


# --- packing


def test_packing(spark, odd):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["Hello,", "wörld", "it's", "x.y", "<|endoftext|>", "42", "…", "naïve."]) for _ in range(rng.randint(0, 300))), "s") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "source"))
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer_file=tokenizer_file(), capacity=512, group_size=60).collect()]
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(tokenizer_file()), Counter()
    for i, text, _ in [*rows, *odd_documents()]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for n, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == want
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty(spark), tokenizer_file=tokenizer_file()).count() == 0
    large = [(None, "a"), (2**60 + 1, "b c"), (2**53 + 1, "d"), (-(2**62) - 1, None)]
    found = packing.pack(spark.createDataFrame(large, "doc_id long, text string").coalesce(1), tokenizer_file=tokenizer_file()).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in large}


def test_ids_of_any_text():
    from tokenizers import Tokenizer
    import pyarrow as pa

    tokenizer, rng, file = Tokenizer.from_file(tokenizer_file()), random.Random(14), tokenizer_file()
    near = "aZ6÷×İıßẞſKÅé.,.,'s ’\u0307\u0301\u00a0\u0085\u2028\u3000\u200d\x1c\x0b\t\n^~`<|>ǅﬁΣςжЖ中あ👍🏽\u0378"
    texts = ["".join(rng.choice(near) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randint(0, 9))) + rng.choice([".", ",", "<|endoftext|>", ""]) for _ in range(20_000)]
    ids, ends = packing.WordIds(file).of_texts(pa.array(texts, pa.large_string()))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b, w in zip(texts, ends[:-1], ends[1:], want, strict=True) if ids[a:b].tolist() != w]
    assert wrong == []


def test_equal_rows_are_dealt(spark):
    rows = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b c' AS text")
    packed = packing.pack(rows, tokenizer_file=tokenizer_file(), capacity=64, group_size=500)
    groups = packed.groupBy(F.expr("sequence_id >> 32").alias("g")).count().collect()
    assert len(groups) == 6 and sum(r["count"] for r in groups) == 3000 and max(r["count"] for r in groups) < 1000


def test_sum_of_squares_wastes_little():
    rng = np.random.default_rng(13)
    lengths = np.minimum(4096, np.exp(rng.normal(6, 1, 20_000)).astype(int) + 1)
    bins, offsets = packing.pack_group(lengths, 4096)
    assert bins.max() + 1 <= 1.002 * -(-lengths.sum() // 4096)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 4096 and (offsets + lengths <= 4096).all()
