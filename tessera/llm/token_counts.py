"""Token counts under a unigram lexicon: one forward pass over a trie of the distinct words of many texts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import grouped_texts

MARK = "▁"


@dataclass
class Lexicon:
    """Log probabilities of pieces, and of each byte of a character that no piece covers."""

    pieces: dict[str, float]
    byte: float

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)


def zipf_lexicon(model_file: str) -> Lexicon:
    """The ordinary pieces of a sentencepiece file; the n-th of them is as likely as 1 / (n + 1) by Zipf's law.

    The file's own scores are ranks of merges, not probabilities. Bytes are less likely than any piece.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ordinary = [i for i in range(model.get_piece_size()) if not any(test(i) for test in special)]
    total = np.log(np.sum(1 / np.arange(2, len(ordinary) + 2)))
    pieces = {model.id_to_piece(i): float(-np.log(n + 2) - total) for n, i in enumerate(sorted(ordinary, key=lambda i: -model.get_score(i)))}
    return Lexicon(pieces, min(pieces.values()) - 1)


def trie_counts(words: list[str], lexicon: Lexicon) -> list[int]:
    """Tokens of each of the sorted distinct words, by the likeliest cut into pieces; of equal ones, by the fewest.

    The words are the ends of paths in a trie, which their order walks depth first. A node's best score over all cuts of
    its prefix rests on the nodes above it alone, so it is worked out once for all words that share the prefix; the path
    down to the last word is all that is held.
    """
    pieces, longest, out = lexicon.pieces, lexicon.longest, []
    best, count, last = [0.0], [0], ""
    for word in words:
        # Nodes that the last word's path has too.
        depth = 0 if word[:1] != last[:1] else len(os.path.commonprefix((word, last)))
        del best[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "replace"))
            top, few = best[end - 1] + size * lexicon.byte, count[end - 1] + size
            for begin in range(max(0, end - longest), end):
                score = pieces.get(word[begin:end])
                if score is not None:
                    score += best[begin]
                    if score > top or (score == top and count[begin] + 1 < few):
                        top, few = score, count[begin] + 1
            best.append(top)
            count.append(few)
        out.append(count[-1])
        last = word
    return out


def count_words(lexicon: Lexicon, most: int):
    """For mapInArrow: (doc_id, text) to words and tokens; counts of up to `most` words are remembered between groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for keys, texts in grouped_texts(batches):
            lists = pc.ascii_split_whitespace(texts)
            words = lists.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            new = sorted(MARK + w for w in distinct if w and w not in known)
            if len(known) + len(new) > most:
                known.clear()
                new = sorted(MARK + w for w in distinct if w)
            known.update(zip((w[1:] for w in new), trie_counts(new, lexicon), strict=True))
            tokens = np.array([known[w] if w else 0 for w in distinct], dtype=np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            real = np.array([bool(w) for w in distinct], dtype=np.int64)[words.indices.to_numpy(zero_copy_only=False)]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (real, tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, *, model_file: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 300_000) -> DataFrame:
    """doc_id, n_words and n_tokens for each row of docs.

    Words are what ASCII white space parts; each counts with a mark of its beginning in front, as the lexicon has it. The
    lexicon is of fixed size and goes to every task. No shuffle; a task holds the counts of at most most_words words.

    Null or empty text, or text without words: zeros. Null or repeated ids: each row counts. Empty table: empty result.
    Only id_col and text_col are read, so other columns do not matter.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(count_words(zipf_lexicon(model_file), most_words), "doc_id long, n_words long, n_tokens long")
