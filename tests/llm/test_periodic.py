"""Periodic runs against plain search for every period, and the contract's query against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter

from tessera.llm import queries
from tessera.llm.periodic import group_runs, periodic_runs
from tests.llm.test_operators import empty, odd, odd_documents, words_of  # noqa: F401 (a fixture)

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least_words=6, least_times=4):
    n, found = len(words), {}
    for q in range(1, n // least_times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def knotted(rng):
    """Runs in runs: short words of few letters repeated, and repeated again."""
    words = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
        words += (base * rng.randint(1, 9))[: rng.randint(1, 80)]
        if rng.random() < 0.3:
            words = (words * rng.randint(1, 6))[:400]
    return words


def test_all_runs_are_found():
    rng, found = random.Random(2), 0
    for _ in range(400):
        texts = [knotted(rng) for _ in range(rng.randint(1, 4))]
        for words, (ws, runs) in zip(texts, group_runs([" ".join(t).encode() for t in texts], 6, 4), strict=True):
            assert [w.decode() for w in ws] == words and runs == plain_runs(words)
            found += len(runs)
    assert found > 3000


def test_runs_among_runs_of_far_smaller_periods():
    # Blocks of one repeated word fill the period of a longer run.
    for a, b in ((40, 1), (16, 16), (17, 15), (33, 30), (64, 63)):
        words = (["x"] * a + ["y"] * b) * 5 + ["x"] * 7
        [(_, runs)] = group_runs([" ".join(words).encode()], 6, 4)
        assert runs == plain_runs(words) and (0, len(words), a + b) in runs


def test_long_texts_take_linear_time():
    texts = ["a " * 150_000, "a b " * 75_000, " ".join(str(i % 30_000) for i in range(150_000))]
    got = [runs for _, runs in group_runs([t.encode() for t in texts], 6, 4)]
    assert got == [[(0, 150_000, 1)], [(0, 150_000, 2)], [(0, 150_000, 30_000)]]


def test_odd_rows(spark, odd):  # noqa: F811
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs(odd).collect())
    want = Counter()
    for i, text, _ in odd_documents():
        words = words_of(text)
        runs = plain_runs(words)
        want[i, len(words), tuple(runs), plain_collapsed(words, runs)] += 1
    assert got == want and any(runs for _, _, runs, _ in got)
    assert periodic_runs(empty(spark)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(knotted(rng) + [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 200))])) for i in range(120)]
    rows += [(200 + i, None) for i in range(12)] + [(300 + i, " \n") for i in range(12)] + [(None, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest, want, planted = lambda t: hashlib.sha256(t.encode()).hexdigest(), Counter(), 0
    for i, text in rows:
        words, h = SPACE.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], planted + 1
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[i, len(runs), *longest, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(plain_collapsed(words, runs))] += 1
    assert Counter(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())) == want and planted > 5
