"""Removal of long substrings that occur earlier, within or across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minhash import mixed
from tessera.plans.scratch import Scratch
from tessera.llm.suffixes import deep_shallow_sort
from tessera.llm.words import grouped_bytes

GRAM = 32
PLACE_BITS = 31
BYTE_CODES = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64)
STEP_CODES = np.random.default_rng(20240502).integers(0, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A stretch's fingerprint, document, and place: start << 18 | windows << 10 | anchor's offset << 2 | state. Of COPY rows, fp
#: is a range of bytes to remove, low << 32 | high.
STRETCHES = "fp long, doc_id long, place long"
LONE, FIRST, OTHER, COPY = range(4)
START, WINDOWS, STATE = "place >> 18", "(place >> 10) & 255", "place & 3"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place."""
    x, step = BYTE_CODES[data], 1
    for code in STEP_CODES[: GRAM.bit_length() - 1]:
        y = x[:-step] * code
        y += x[step:]
        x, step = y, 2 * step
    return mixed(x)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one anchor: text number, start in all texts, windows, anchor's offset, fingerprint.

    A window is `length` bytes; its anchor is the gram of least hash in it, the leftmost of equals. So a window's anchor
    depends on its bytes alone: equal windows have equal fingerprints, at equal offsets.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = (np.empty(0, dtype=np.int64),) * 4 + (np.empty(0, dtype=np.uint64),)
    if len(data) < length:
        return none
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data)
    low = np.uint64(2**PLACE_BITS - 1)
    least = sliding_minimum((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    long = sizes >= length
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, begins[long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(edge[: len(anchor)], dtype=np.int8).astype(bool)
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (edge[1 : len(anchor)] == 1)])
    start = np.flatnonzero(valid & change)
    stop = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]]))
    if not len(start):
        return none
    # Empty texts share their place with the text behind them, which is the one that holds the start.
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start, stop - start + 1, anchor[start] - start, hashes[anchor[start]]


def equal_stretches(data: np.ndarray, begin: np.ndarray, length: int, windows: np.ndarray, offset: np.ndarray, fp: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches by fingerprint and content, those of one content by document and start; and which are copies of an earlier one.

    Deep-shallow sorting of the bytes decides what is equal. A repeated row of the table is no earlier occurrence.
    """
    _, group = np.unique(np.stack([fp.view(np.int64), windows << 8 | offset]), axis=1, return_inverse=True)
    order, cls = deep_shallow_sort(data, begin, group, windows + length - 1)
    by = np.lexsort((start[order], doc[order], cls))
    order, cls = order[by], cls[by]
    first = np.concatenate([[True], cls[1:] != cls[:-1]])[: len(cls)]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    return order, (doc[order] != doc[head]) | (start[order] != start[head])


def joined(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of documents, joined where they touch."""
    by = np.lexsort((low, doc))
    doc, low, high = doc[by], low[by], high[by]
    # Documents one behind the other, so that a running maximum never reaches from one into the next.
    shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])[: len(doc)]) << 32
    reach = np.maximum.accumulate(shift + high)
    new = np.concatenate([[True], (shift + low)[1:] > reach[:-1]])[: len(doc)]
    last = np.concatenate([new[1:], [True]])[: len(doc)]
    return doc[new], low[new], (reach - shift)[last]


def cut_stretches(length: int):
    """For mapInArrow: (doc_id, text) to STRETCHES; copies among the texts at hand are ranges to remove already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in grouped_bytes(batches, 1_000_000):
            by_key = sorted(range(len(keys)), key=keys.__getitem__)
            texts = [texts[i] for i in by_key]
            text, begin, windows, offset, fp = stretches(texts, length)
            if not len(text):
                continue
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            start = begin - (np.cumsum(sizes) - sizes)[text]
            doc = np.array([keys[i] for i in by_key], dtype=np.int64)[text]
            # Only what shares its fingerprint can have a copy here.
            by_fp = np.argsort(fp, kind="stable")
            same = fp[by_fp][1:] == fp[by_fp][:-1]
            shared = by_fp[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            state = np.full(len(fp), LONE)
            if len(shared):
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                order, copy = equal_stretches(data, begin[shared], length, windows[shared], offset[shared], fp[shared], doc[shared], start[shared])
                state[shared[order[copy]]] = COPY
                kept = shared[order[~copy]]
                at, size = np.unique(fp[kept], return_counts=True)
                several = size[np.searchsorted(at, fp[kept])] > 1
                state[kept[several]] = OTHER
                first = np.unique(fp[kept[several]], return_index=True)[1]
                state[kept[several][first]] = FIRST
            out, copies = state != COPY, state == COPY
            of_doc, low, high = joined(doc[copies], start[copies], (start + windows - 1 + length)[copies])
            columns = [
                np.concatenate([fp[out].view(np.int64), low << 32 | high]),
                np.concatenate([doc[out], of_doc]),
                np.concatenate([(start << 18 | windows << 10 | offset << 2 | state)[out], np.full(len(low), COPY)]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fp", "doc_id", "place"])

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows in the order of fp: those whose fingerprint occurs again or is known to."""
    held, current, known = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, state = batch.column("fp").to_numpy(), batch.column("place").to_numpy() & 3
        first = np.concatenate([[True], fp[1:] != fp[:-1]])
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        yes = (size > 1) | (np.bincount(group, weights=state != LONE) > 0)
        if fp[0] == current:
            yes[0] = True
            if held is not None:
                yield held
        same = group[-1] == 0 and fp[0] == current
        held, current = None, fp[-1]
        take = yes[group]
        if not yes[-1] and not same:
            held = batch.slice(batch.num_rows - 1)
        out = batch.filter(pa.array(take))
        if out.num_rows:
            yield out


def compare_windows(length: int, block: int = 15_000):
    """For mapInArrow over (fp, doc_id, place, hot, body) in the order of fp: byte ranges that occur earlier in a stretch of
    the same fingerprint, as kind 0 rows (doc_id, low, high).

    Whole stretches are sorted first; of equal ones only the earliest goes on. Where a fingerprint has several contents,
    their windows are sorted. Of hot fingerprints only a part may be at hand, so the earliest of equal windows follows as
    kind 1 with its hash.
    """

    def sort_block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        fp, doc, place, hot = (t.column(c).to_numpy() for c in ("fp", "doc_id", "place", "hot"))
        bodies = t.column("body").to_pylist()
        data = np.frombuffer(b"".join(bodies), dtype=np.uint8)
        sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
        begins = np.cumsum(sizes) - sizes
        windows, offset, start = (place >> 10) & 255, (place >> 2) & 255, place >> 18
        order, copy = equal_stretches(data, begins, length, windows, offset, fp, doc, start)
        copies = order[copy]
        yield found(0, *joined(doc[copies], start[copies], (start + windows - 1 + length)[copies]))
        own = order[~copy]
        _, of_fp, size = np.unique(fp[own], return_inverse=True, return_counts=True)
        own = own[(size[of_fp] > 1) | hot[own]]
        if not len(own):
            return
        row = np.repeat(own, windows[own])
        shift = np.arange(len(row)) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
        _, of_fp = np.unique(fp[row], return_inverse=True)
        order, cls = deep_shallow_sort(data, begins[row] + shift, of_fp * 256 + (offset[row] - shift), length)
        r, at = row[order], (start[row] + shift)[order]
        by = np.lexsort((at, doc[r], cls))
        r, at, cls = r[by], at[by], cls[by]
        first = np.concatenate([[True], cls[1:] != cls[:-1]])
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        later = (doc[r] != doc[r[head]]) | (at != at[head])
        yield found(0, *joined(doc[r[later]], at[later], at[later] + length))
        keep = np.flatnonzero(~later & hot[r])
        places = (begins[r] + at - start[r])[keep].tolist()
        digests = [hashlib.blake2b(data[a : a + length].tobytes(), digest_size=16).digest() for a in places]
        yield found(1, doc[r[keep]], at[keep], at[keep] + length, digests)

    def found(kind: int, doc: np.ndarray, low: np.ndarray, high: np.ndarray, window: list[bytes] | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(doc), kind, dtype=np.int32)), pa.array(doc), pa.array(low), pa.array(high)]
        columns.append(pa.array(window, pa.binary()) if window is not None else pa.nulls(len(doc), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_id", "low", "high", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            while batch.num_rows:
                if n < block:
                    part = batch.slice(0, block - n)
                else:  # up to the end of the fingerprint at hand
                    fp = rows[-1].column("fp")[-1].as_py()
                    same = int((batch.column("fp").to_numpy() == fp).cumprod().sum())
                    if not same:
                        yield from sort_block(rows)
                        rows, n = [], 0
                        continue
                    part = batch.slice(0, same)
                rows.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
        if rows:
            yield from sort_block(rows)

    return run


def joined_ranges(packed: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges, in order, that cover the same places as low << 32 | high."""
    packed = np.sort(packed)
    low, high = packed >> 32, np.maximum.accumulate(packed & 0xFFFFFFFF)
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return list(zip(low[new].tolist(), high[np.concatenate([new[1:], [True]])].tolist(), strict=True))


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int, hot_limit: int = 30_000) -> DataFrame:
    """(doc_id, ranges): what to remove of each document (doc_id, body) that repeats anything, as low << 32 | high.

    Windows are cut into stretches by their anchors; only stretches of repeated fingerprints go on, with their bytes, and
    are sorted, and of those with several contents the windows too: each fingerprint in one task, or, beyond hot_limit
    stretches, in several that exchange hashes of their first windows.
    """
    cut = docs.select("doc_id", F.col("body").cast("string").alias("text")).mapInArrow(cut_stretches(length), STRETCHES)
    # What is known to be repeated need not meet the others: it is dealt evenly, so no fingerprint grows hot.
    route = F.when(F.expr(STATE) < OTHER, F.col("fp")).otherwise(F.xxhash64("doc_id", "place"))
    found = scratch.keep(cut.repartition(route).sortWithinPartitions("fp").mapInArrow(repeated, STRETCHES), "stretches")
    copies = found.where(F.expr(STATE) == COPY).select("doc_id", F.col("fp").alias("range"))
    waiting = found.where(F.expr(STATE) != COPY)

    hot = scratch.keep(waiting.groupBy("fp").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_limit), "hot")
    parts = F.coalesce(F.ceil(F.col("rows") / hot_limit), F.lit(1))
    wanted = waiting.join(hot, "fp", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), parts)).withColumn("hot", parts > 1)
    body = F.expr(f"substring(body, cast(({START}) + 1 AS int), cast(({WINDOWS}) - 1 + {length} AS int))")
    bodies = wanted.join(docs, "doc_id").select("fp", "doc_id", "place", "hot", "part", body.alias("body"))
    split = bodies.repartition("fp", "part").sortWithinPartitions("fp", "part").drop("part")
    shape = "kind int, doc_id long, low long, high long, window binary"
    compared = scratch.keep(split.mapInArrow(compare_windows(length), shape), "compared")
    opened = compared.where("kind = 1")
    opening = opened.groupBy("window").agg(F.min(F.struct("doc_id", "low")).alias("first"))
    beaten = opened.join(opening, "window").where("doc_id <> first.doc_id OR low <> first.low")
    packed = F.shiftleft(F.col("low"), 32).bitwiseOR(F.col("high")).alias("range")
    ranges = copies.union(compared.where("kind = 0").select("doc_id", packed)).union(beaten.select("doc_id", packed))
    # Kept, so that the shuffles that led here are gone before texts meet their ranges.
    ranges = scratch.keep(ranges.groupBy("doc_id").agg(F.collect_list("range").alias("ranges")), "ranges")
    scratch.drop("stretches", "hot", "compared")
    return ranges


def digest_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (doc_id, body, ranges) to what is removed and a hash of the rest."""
    for batch in batches:
        out = []
        for key, body, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("body"), batch.column("ranges"), strict=True):
            body = body.as_py() or b""
            spans = joined_ranges(ranges.values.to_numpy()) if ranges.is_valid else []
            rest, at = hashlib.sha256(), 0
            for low, high in spans:
                rest.update(body[at:low])
                at = high
            rest.update(body[at:])
            out.append((key, len(body), sum(h - l for l, h in spans), len(spans), rest.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*out, strict=True) if out else [[]] * 5
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, types, strict=True)], names=names)


def rewrite(text_col: str, ranges_col: str):
    """For mapInArrow: rows with ranges, without them and with the text that remains; bytes of cut characters go too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            names = [n for n in batch.schema.names if n != ranges_col]
            texts = []
            for text, ranges in zip(batch.column(text_col), batch.column(ranges_col), strict=True):
                if ranges.is_valid:
                    body, at, rest = text.as_py().encode(), 0, []
                    for low, high in joined_ranges(ranges.values.to_numpy()):
                        rest.append(body[at:low])
                        at = high
                    texts.append(b"".join([*rest, body[at:]]).decode("utf-8", "ignore"))
                else:
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(n).type) if n == text_col else batch.column(n) for n in names], names=names)

    return run


def keyed_bodies(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, documents): every row of docs with the columns to carry in `doc`, its bytes and the key of its document; and the
    distinct documents (doc_id, body), by key.

    The key is the doc_id. Rows that share a doc_id are one document if their texts are equal; of unequal ones that with the
    smallest hash has the doc_id for its key, and the others, like rows without an id, come behind all documents, in the
    order of a hash of their id and text.
    """
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in carry)).alias("doc")
    rows = docs.select(F.col(id_col).cast("long").alias("of"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), whole)
    # Ids only; none in most tables.
    shared = rows.groupBy("of").agg(F.count("*").alias("n")).where("n > 1 OR of IS NULL").select(F.col("of").alias("shared"))
    shared = scratch.keep(shared, "shared")
    if shared.isEmpty():
        keyed = rows.withColumnRenamed("of", "key")
        return keyed, keyed.select(F.col("key").alias("doc_id"), "body")
    told = rows.join(shared, F.col("of").eqNullSafe(F.col("shared")), "left_semi").select(F.col("of").alias("shared"), F.xxhash64("body").alias("content"))
    least = scratch.keep(told.groupBy("shared").agg(F.min("content").alias("least")), "least")
    own = F.when(F.col("least").isNull() | (F.col("of").isNotNull() & (F.xxhash64("body") == F.col("least"))), F.col("of"))
    behind = F.xxhash64("of", "body").bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**62)
    keyed = rows.join(least, F.col("of").eqNullSafe(F.col("shared")), "left").withColumn("key", F.coalesce(own, behind))
    documents = keyed.select(F.col("key").alias("doc_id"), "body", "least")
    alone, copies = documents.where("least IS NULL").drop("least"), documents.where("least IS NOT NULL").drop("least")
    return keyed.select("key", "body", "doc"), scratch.keep(alone.union(copies.dropDuplicates(["doc_id"])), "documents")


def with_ranges(docs: DataFrame, id_col: str, text_col: str, length: int, carry: list[str]) -> DataFrame:
    """The rows of keyed_bodies with the ranges to remove of each."""
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, documents = keyed_bodies(docs, scratch, id_col, text_col, carry)
    ranges = repeated_ranges(documents, scratch, length).withColumnRenamed("doc_id", "key")
    return rows.join(ranges, "key", "left")


def repeats_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, a hash of the rest.

    Texts count as UTF-8 bytes. A byte goes if a `length`-byte string covers it that also starts earlier: in a document of
    smaller doc_id, or further ahead in the same one. Strings never cross documents and are judged on the input.

    Null text: an empty one. Repeated rows (one doc_id, equal texts) are one document, no copies of each other, and all have
    its result. Of unequal texts with one doc_id that with the smallest hash stands at that id; the others, and rows without
    an id, stand behind all documents, in the order of a hash. Texts shorter than `length` lose nothing. Empty table: empty
    result. Only id_col and text_col are read, so other columns do not matter. Memory is that of one text, of up to 2 GB, and
    a few megabytes more.
    """
    rows = with_ranges(docs, id_col, text_col, length, [id_col])
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select(F.col("doc").getField(id_col).cast("long").alias("doc_id"), "body", "ranges").mapInArrow(digest_rest, shape)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """docs with the text that `repeats_report` leaves; characters that a removed range cuts into go whole."""
    rows = with_ranges(docs, id_col, text_col, length, docs.columns).drop("body")
    # A name that no column of docs has.
    ranges = "_" * (1 + max(map(len, docs.columns))) + "ranges"
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns]
    return rows.select(*own, F.col("ranges").alias(ranges)).mapInArrow(rewrite(text_col, ranges), docs.schema)
