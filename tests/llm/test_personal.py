"""Personal data: patterns against plain code, the field against all paths, spans against labelled lines held out."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import crf, personal, queries
from tests.llm.test_operators import empty, odd, odd_documents  # noqa: F401 (a fixture)

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    ds = [int(d) for d in digits][::-1]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(ds)) % 10 == 0


def plain_base(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    holds = {
        "email": lambda t: True,
        "ip": lambda t: all(int(p) <= 255 for p in t.split(".")),
        "card": lambda t: 16 <= len(digits(t)) <= 19 and plain_luhn(digits(t)),
        "phone": lambda t: 8 <= len(digits(t)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if holds[k](m[0])]


@pytest.fixture(scope="module")
def field():
    return crf.fit(personal.labelled_rows(), ["email", "phone", "name", "address"])


def test_patterns():
    rng, found = random.Random(3), Counter()
    for _ in range(20_000):
        parts = ["a", "b.c", "@", "@", ".", "-", "+", "1", "25", "255", "256", "007", " ", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "4000056655665556", "é", "+49 30 123456", "_", "\n", "٣"]
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert personal.base_spans(text) == plain_base(text), text
        found.update(k for k, _, _ in plain_base(text))
    assert min(found[k] for k in PLAIN) > 100


def test_patterns_in_long_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000):
        personal.base_spans(text)


def all_paths(scores, pairs):
    n, y = scores.shape
    for path in itertools.product(range(y), repeat=n):
        whole = (0, *path, 0)
        yield sum(scores[t, a] for t, a in enumerate(path)) + sum(pairs[a, b] for a, b in itertools.pairwise(whole)), path


def test_likelihood_and_slope():
    rows = [("call 12 now", [(5, 7, "phone")]), ("no", []), ("1 2", [(0, 1, "phone"), (2, 3, "phone")])]
    labels = ["O", "B-phone", "I-phone"]
    sequences = crf.sequences_of(rows, labels)
    features = {f: i for i, f in enumerate(sorted({f for tokens, _ in sequences for t in tokens for f in t} | {"pad"}))}
    value = crf.Likelihood(sequences, features, 3, 0.1)
    theta = np.random.default_rng(1).normal(size=5 * len(features) * 3 + 9)
    weights, pairs = theta[:-9].reshape(5, len(features), 3), theta[-9:].reshape(3, 3)
    want = 0.05 * (theta**2).sum()
    for tokens, tags in sequences:
        padded = [crf.PAD] * 2 + tokens + [crf.PAD] * 2
        scores = np.array([[sum(weights[2 - k, features[f], y] for k in range(-2, 3) for f in padded[t + 2 + k]) for y in range(3)] for t in range(len(tokens))])
        paths = dict((p, s) for s, p in all_paths(scores, pairs))
        want += np.log(np.exp(list(paths.values())).sum()) - paths[tuple(tags)]
    got, slope = value(theta)
    assert got == pytest.approx(want)
    for i in random.Random(2).sample(range(len(theta)), 60):
        step = np.zeros_like(theta)
        step[i] = 1e-5
        assert (value(theta + step)[0] - value(theta - step)[0]) / 2e-5 == pytest.approx(slope[i], abs=1e-4)


def test_viterbi():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths = np.sort(rng.integers(1, 6, 4))
        scores, pairs = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3))
        found = crf.viterbi(scores[:, : lengths[-1]], pairs, lengths)
        for s, f, n in zip(scores, found, lengths, strict=True):
            assert tuple(f[:n]) == max(all_paths(s[:n], pairs))[1] and not f[n:].any()


def test_leaving_tokens_out_changes_nothing(field):
    rows = [text for text, _ in personal.labelled_rows(2, 31)]
    texts = [*rows, " ".join(rows), "", "\n\n", "Mr. " * 300, "at dot 555 " * 200]
    tokens = [crf.TOKEN.findall(t) for t in texts]
    assert ["".join(t) for t in tokens] == texts
    for (a, b), (c, d) in zip(crf.Decoder(field).decode(tokens), crf.Decoder(field).decode(tokens, everything=True), strict=True):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()


def test_held_out_lines(field):
    decoder, hit, wrong, missed = crf.Decoder(field), 0, 0, 0
    rows = personal.labelled_rows(10, 977)
    tokens = [crf.TOKEN.findall(t) for t, _ in rows]
    for (text, spans), own, (places, labels) in zip(rows, tokens, decoder.decode(tokens), strict=True):
        got = {(a, b, k) for a, b, k in crf.spans_of(field.labels, own, places, labels) if personal.plausible(k, text[a:b])}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + missed) > 0.97 and hit / (hit + wrong) > 0.97


def test_added_spans(spark):
    texts = ["They said: write to jane at post dot org today, please.", "Tel. 0171/234567 and +49 30 1234567", "with Mrs. Anna Keller, who lives at 12 Baker Street there", "Nothing of that kind here. The end of it.", "a@b.co"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in personal.personal_data(docs, masked=True).collect()}
    found = {i: [(s["kind"], texts[i][s["start"] : s["end"]], s["base"]) for s in r["spans"]] for i, r in rows.items()}
    assert found[0] == [("email", "jane at post dot org", False)]
    assert found[1] == [("phone", "0171/234567", False), ("phone", "+49 30 1234567", True)]
    assert found[2] == [("name", "Anna Keller", False), ("address", "12 Baker Street", False)]
    assert found[3] == [] and found[4] == [("email", "a@b.co", True)]
    assert rows[2]["masked"] == "with Mrs. [name], who lives at [address] there" and rows[3]["masked"] == texts[3]
    table = personal.labelled_table(spark)
    assert [[tuple(s) for s in r["spans"]] for r in personal.personal_data(docs, table).orderBy("doc_id").collect()] == [[tuple(s) for s in rows[i]["spans"]] for i in range(5)]
    none = personal.personal_data(docs, table.limit(0)).collect()
    assert all(s["base"] for r in none for s in r["spans"]) and sum(len(r["spans"]) for r in none) == 2


def test_odd_rows_and_query(spark, odd, tmp_path):  # noqa: F811
    assert Counter((r["doc_id"], len(r["spans"])) for r in personal.personal_data(odd).collect()) == Counter((i, 0) for i, _, _ in odd_documents())
    assert personal.personal_data(empty(spark)).count() == 0
    rows = [(1, "é x.1@mail.example.com 1.2.3.4 and 1.2.3.4"), (2, "4111-1111-1111-1111 Herr Anton Meier +1 (017) 555-7713"), (3, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op13_crf_personal_data"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        base = plain_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(k == x for x, _, _ in base) for k in PLAIN]
        assert set(joined.split(",")) <= set(got[i]["spans"].split(","))
    assert got[1]["spans"] == "email:2:22,ip:23:30,ip:35:42" and got[2]["spans"] == "card:0:19,phone:37:54,name:25:36"
