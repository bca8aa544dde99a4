"""Texts in Arrow batches, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def grouped_texts(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[list, pa.Array]]:
    """Keys and texts (null: empty) of batches with columns (key, text), in groups of about `most` bytes."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        keys = batch.column(0).to_pylist()
        size, begin = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n
            if size >= most or i + 1 == len(keys):
                yield keys[begin : i + 1], texts[begin : i + 1]
                size, begin = 0, i + 1


def grouped_bytes(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """The same with UTF-8 bytes of each text."""
    for keys, texts in grouped_texts(batches, most):
        yield keys, texts.cast(pa.large_binary()).to_pylist()
