"""Periodic runs of words: aligned blocks of powers of two, found again by an automaton over integers, then extended exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import grouped_bytes

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
FAR = np.iinfo(np.int64).max


def gaps_to_next(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How far on each word occurs again in its document (FAR: not again)."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    key = owner * (int(numbers.max(initial=0)) + 1) + numbers
    order = np.argsort(key, kind="stable")
    gaps = np.full(len(numbers), FAR)
    same = key[order[1:]] == key[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values that are `least` long or longer."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    begins, ends = turns[::2], turns[1::2]
    wide = ends - begins >= least
    return begins[wide], ends[wide]


def equal_from(words: np.ndarray, at: int, q: int) -> int:
    """The first place from `at` on whose word differs from the one q words on, or has none there."""
    end, step = len(words) - q, 16
    while at < end:
        to = min(end, at + step)
        differ = words[at:to] != words[at + q : to + q]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 2
    return max(at, end)


def equal_back(words: np.ndarray, at: int, q: int) -> int:
    """The first place of the stretch that ends before `at` of words equal to those q words on."""
    step = 16
    while at > 0:
        to = max(0, at - step)
        differ = words[to:at] != words[to + q : at + q]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = to, step * 2
    return 0


def block_seeds(words: np.ndarray, block: int, places: list[int]) -> list[tuple[int, np.ndarray]]:
    """Each place with those from `block` to 2 * block - 1 words on where the same block of words begins."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    known: dict[bytes, int] = {}
    numbers = []
    for p in places:
        own = words[p : p + block]
        numbers.append(known.setdefault(own.tobytes(), len(known)))
        if numbers[-1] == len(known) - 1:
            automaton.add_word(tuple(own.tolist()), numbers[-1])
    automaton.make_automaton()
    met: list[list[int]] = [[] for _ in known]
    at = 0
    while at < len(places):
        # What lies near each other is read in one go.
        low = places[at]
        while at + 1 < len(places) and places[at + 1] <= places[at] + 3 * block:
            at += 1
        for end, number in automaton.iter(tuple(words[low : places[at] + 3 * block].tolist())):
            met[number].append(low + end - block + 1)
        at += 1
    found = [np.unique(m) for m in met]
    return [(p, f[np.searchsorted(f, p + block) : np.searchsorted(f, p + 2 * block)]) for p, f in ((p, found[n]) for p, n in zip(places, numbers, strict=True))]


def run_seeds(found: dict[tuple[int, int], int], block: int) -> list[tuple[int, np.ndarray]]:
    """The same from runs of periods below a quarter of the block that hold a block: pairs of equal length and period."""
    alike: dict[tuple[int, int], list[int]] = {}
    for (low, end), q in found.items():
        if 4 * q < block <= end - low:
            alike.setdefault((q, end - low), []).append(low)
    out = []
    for begins in alike.values():
        at = np.sort(np.array(begins))
        out += [(int(p), at[np.searchsorted(at, p + block) : np.searchsorted(at, p + 2 * block)]) for p in at]
    return out


def runs_of(words: np.ndarray, scales: list[tuple[int, list[tuple[int, int]]]], least_words: int, least_times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document, by start and period.

    scales: block lengths, ascending, with the stretches where a run of a period from the block length to just below its
    double can have its words but the last period. Aligned blocks inside a run of a far smaller period would keep the
    automaton busy with their own repeats; runs around them repeat those smaller runs whole, and are found by them.
    """
    reach = np.arange(len(words))
    small = np.arange(len(words))  # the same for periods below a quarter of the block
    found: dict[tuple[int, int], int] = {}
    for block, parts in scales:
        for (low, end), q in found.items():
            if 4 * q < block:
                np.maximum(small[low:end], end, out=small[low:end])
        places = []
        for u, v in parts:
            at = np.arange(-(-u // block) * block, v - block + 1, block)
            # What lies in a known run, the block's second place included, has that run's period, not one of its own.
            places += at[(reach[at] < at + 3 * block) & (small[at] < at + block)].tolist()
        met = [(p, near[near + block > reach[p]]) for p, near in [*(block_seeds(words, block, places) if places else []), *run_seeds(found, block)]]
        if not met:
            continue
        begins = np.concatenate([np.full(len(near), p) for p, near in met])
        distances = np.concatenate([near - p for p, near in met])
        order = np.lexsort((begins, distances))
        last, upto = 0, -1
        for p, q in zip(begins[order].tolist(), distances[order].tolist(), strict=True):
            # A stretch of equal words is extended from the first of its seeds only.
            if q == last and p < upto:
                continue
            low, last, upto = equal_back(words, p, q), q, equal_from(words, p, q)
            end = upto + q
            # The same words with a smaller period were found at a smaller scale.
            if end - low >= max(least_words, least_times * q) and (low, end) not in found:
                found[low, end] = q
        for (low, end), q in found.items():
            if q >= block:
                np.maximum(reach[low:end], end, out=reach[low:end])
    return sorted((low, end - low, q) for (low, end), q in found.items())


def group_runs(texts: list[bytes], least_words: int, least_times: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs.

    Inside a run of period q, all words but the last q occur again at most q words on; so a run can only be where
    least_times - 1 times its period such words follow each other. That is looked up for all texts at once, and leaves few
    places of common prose to search.
    """
    known: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    numbers = [np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws)) for ws in words]
    ends = np.cumsum([len(n) for n in numbers]).astype(np.int64)
    flat = np.concatenate([*numbers, np.empty(0, dtype=np.int64)])
    gaps = gaps_to_next(flat, ends)
    scales: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    block, longest = 1, max(map(len, words), default=0)
    while least_times * block <= longest:
        begins, stops = stretches(gaps < 2 * block, max((least_times - 1) * block, least_words - 2 * block + 1))
        owners = np.searchsorted(ends, begins, side="right")
        for i in np.unique(owners).tolist():
            first = int(ends[i]) - len(numbers[i])
            own = owners == i
            scales.setdefault(i, []).append((block, list(zip((begins[own] - first).tolist(), (stops[own] - first).tolist(), strict=True))))
        block *= 2
    for i, ws in enumerate(words):
        yield ws, runs_of(numbers[i], scales[i], least_words, least_times) if i in scales else []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(least_words: int, least_times: int):
    """For mapInArrow: (doc_id, text) to RUNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in grouped_bytes(batches):
            rows = [(len(ws), runs, collapsed(ws, runs)) for ws, runs in group_runs(texts, least_words, least_times)]
            flat = np.array([r for _, runs, _ in rows for r in runs], dtype=np.int64).reshape(-1, 3)
            columns = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            at = pa.array(np.concatenate([[0], np.cumsum([len(runs) for _, runs, _ in rows])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([n for n, _, _ in rows], pa.int64()), pa.ListArray.from_arrays(at, columns), pa.array([c for _, _, c in rows], pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 6, least_times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and the collapsed text of each row.

    A run is a longest stretch of consecutive words in which words that stand its smallest period apart are equal, of
    least_words words and least_times periods at least (least_times: 4 or more). The collapsed text joins by one space the
    words that no run holds after its first period. For each power of two, aligned blocks of so many words are searched by
    an Aho-Corasick automaton over word numbers; a block that occurs again from one to two block lengths on is extended to
    both sides. A run of at least four periods holds such a block whole, so none is missed.

    Each text is worked on by itself, in groups of about two megabytes; nothing is shuffled. Words are what white space of
    ASCII parts. Null text: no words, no runs, an empty text. Empty and blank texts: the same. Null or repeated ids and
    repeated rows: each row has its own result. Empty table: empty result. Only id_col and text_col are read, so other
    columns do not matter.
    """
    if least_times < 4:
        raise ValueError("blocks are sure to be found in runs of four periods or more")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(find_runs(least_words, least_times), RUNS).withColumn("collapsed", F.col("collapsed").cast("string"))
