"""Packing of tokenized documents into sequences of fixed length by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch
from tessera.llm.words import grouped_texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Token ids of texts, worked out once for each distinct word of a group.

    The tokenizer lowers case, drops white space and lets no token cross it, so the ids of a text are those of its words
    in order. It also parts a letter from a full stop or comma behind it; doing that beforehand leaves fewer distinct
    words. Ids of up to `most` words are remembered from one group to the next, then forgotten all at once.
    """

    def __init__(self, tokenizer_file: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(tokenizer_file), most, {}

    def of_words(self, words: list[str]) -> list[bytes]:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = words
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for word, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = np.asarray(got.ids, dtype="<u4").tobytes()
        return [known[w] for w in words]

    def of_texts(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (one place more than texts)."""
        # Special tokens keep their case.
        special = pc.match_substring(texts, "<|")
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([.,])", "\\1 \\2")
        words = pc.ascii_split_whitespace(pc.if_else(special, texts, parted))
        flat = words.flatten().dictionary_encode()
        ids = self.of_words(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        begins = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        index = flat.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths[index])])
        places = np.arange(ends[-1]) + np.repeat(begins[index] - ends[:-1], lengths[index])
        offsets = words.offsets.to_numpy()
        return pool[places], ends[offsets - offsets[0]]


def cut_pieces(tokenizer_file: str, capacity: int, end_id: int):
    """For mapInArrow: (doc_id, text) to the pieces of each document's ids with end_id behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(tokenizer_file)
        end = np.asarray([end_id], dtype="<u4")
        for keys, texts in grouped_texts(batches, 3_000_000):
            ids, ends = known.of_texts(texts)
            rows: list[tuple] = []
            for key, a, b in zip(keys, ends[:-1], ends[1:], strict=True):
                own = np.concatenate([ids[a:b], end])
                for piece, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((key, piece, at, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed in the given order.

    counts[g] is the number of open bins with g free places. An item of size s goes to the open or new bin for which the
    sum of the squared counts becomes smallest; of equal choices, to the fullest bin. Moving a bin from gap g to gap h
    changes that sum by 2 (counts[h] - counts[g]) + 2; half a bin at gap 0 and at full capacity accounts for bins that
    leave and enter the sum.
    """
    counts = np.zeros(capacity + 1)
    counts[0], counts[capacity] = -0.5, 0.5
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i in order:
        s = int(lengths[i])
        here = counts[s:]
        gap = s + int(np.argmin(np.where(here > 0, counts[: capacity - s + 1] - here, np.inf)))
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack_group(lengths: np.ndarray, capacity: int, shares: tuple[float, ...] = (0.1, 0.05, 0.2)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by the order that needs the fewest bins.

    The rule is at its best with items in random order; a share of the smallest ones, the longest first, comes last and
    fills what the others left open. The first share that reaches the least possible number of bins is taken.
    """
    least, best = -(-int(lengths.sum()) // capacity), None
    by_size = np.argsort(lengths, kind="stable")
    for share in shares:
        small, large = np.split(by_size, [int(share * len(lengths))])
        found = sum_of_squares(lengths, capacity, np.concatenate([np.random.default_rng(len(lengths)).permutation(large), small[::-1]]))
        if best is None or found[0].max() < best[0].max():
            best = found
        if best[0].max() + 1 <= least:
            break
    return best


def place(capacity: int):
    """For applyInArrow: the pieces of one group, each with its sequence and its place there."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.take(pc.sort_indices(group, sort_keys=order)).select([c.split()[0] for c in PIECES.split(", ")])
        bins, offsets = pack_group(group.column("length").to_numpy(), capacity)
        return group.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(
    docs: DataFrame,
    *,
    tokenizer_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    group_size: int = 50_000,
) -> DataFrame:
    """Pieces of documents' token ids, packed into sequences of at most `capacity` tokens.

    Each document's ids end with end_id; only documents longer than the capacity are cut. Pieces, a few numbers each, are
    dealt at random by their number in the written table of pieces into groups of about group_size, whatever their number
    and however many are alike, and each group is packed on its own: with tens of thousands of pieces a group wastes about
    as little as all pieces together would.

    Null text: the end id alone. Null or repeated ids: each row is packed on its own. Empty table: empty result. Only
    id_col and text_col are read, so other columns do not matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.keep(source.mapInArrow(cut_pieces(tokenizer_file, capacity, end_id), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_size))
    # The rows of a written table have the same numbers whenever a lost task is run again.
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(place(capacity), PACKED)
