"""Deep-shallow sorting of suffixes: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

WORD = 8


def big_words(data: np.ndarray) -> np.ndarray:
    """At each place of data (bytes, with seven more behind the last place) its next eight bytes as a number that sorts alike."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by group and then by their first `depth` words, and the segments of those equal so far.

    All segments are split at once: each around the median of three of its symbols at its depth, in three ways, of which
    the equal part goes on one word deeper.
    """
    order = np.argsort(groups, kind="stable")
    _, segment = np.unique(groups[order], return_inverse=True)
    level = np.zeros(segment[-1] + 1 if len(segment) else 0, dtype=np.int64)
    while True:
        size = np.bincount(segment, minlength=len(level))
        active = (size > 1) & (level < depth)
        if not active.any():
            return order, segment
        at = np.flatnonzero(active[segment])
        own = segment[at]
        symbol = words[starts[order[at]] + WORD * level[own]]
        place = np.cumsum(active) - 1
        low = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        high = np.concatenate([low[1:], [len(own)]]) - 1
        pivot = np.sort(np.stack([symbol[low], symbol[(low + high) // 2], symbol[high]]), axis=0)[1]
        side = (symbol >= pivot[place[own]]).astype(np.int64) + (symbol > pivot[place[own]])
        key = 3 * own + side
        to = np.argsort(key, kind="stable")
        order[at], key = order[at][to], key[to]
        # Parts of segments, in order, become segments; those at rest keep their one part.
        part = 3 * segment
        part[at] = key
        kept, segment = np.unique(part, return_inverse=True)
        level = level[kept // 3] + ((kept % 3 == 1) & active[kept // 3])


class BlindTrie:
    """Orders numbers of `bits` bits by the bits in which they differ: nodes hold a place only, leaves hold equal members."""

    def __init__(self, bits: int) -> None:
        self.bits, self.root = bits, None

    def insert(self, value: int, member: int) -> None:
        node = self.root
        if node is None:
            self.root = (value, [member])
            return
        last = self.bits - 1
        while len(node) == 3:
            node = node[1 + (value >> (last - node[0]) & 1)]
        differ = node[0] ^ value
        if not differ:
            node[1].append(member)
            return
        bit = self.bits - differ.bit_length()
        above, here = None, self.root
        while len(here) == 3 and here[0] < bit:
            above, here = here, here[1 + (value >> (last - here[0]) & 1)]
        leaf = (value, [member])
        new = [bit, here, leaf] if value >> (last - bit) & 1 else [bit, leaf, here]
        if above is None:
            self.root = new
        else:
            above[1 + (value >> (last - above[0]) & 1)] = new

    def leaves(self) -> list[list[int]]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[2], node[1]]
            else:
                out.append(node[1])
        return out


def deep_shallow_sort(
    data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int | np.ndarray, shallow: int = 32
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the `length`-byte prefixes of suffixes within groups, and for each place of the order its class of equals.

    Lengths may be an array; then those of one group are equal.
    """
    lengths = np.broadcast_to(length, starts.shape)
    shallow = min(shallow, int(lengths.min(initial=shallow))) // WORD * WORD
    padded = np.concatenate([data, np.zeros(WORD, dtype=np.uint8)])
    order, segment = multikey_quicksort(big_words(padded), starts, groups, shallow // WORD)
    size = np.bincount(segment)
    begin = np.cumsum(size) - size
    new_class = np.ones(len(order), dtype=bool)
    text = data.tobytes()
    for b, n, deep in zip(begin[size > 1].tolist(), size[size > 1].tolist(), lengths[order[begin[size > 1]]].tolist(), strict=True):
        trie, members = BlindTrie(8 * (deep - shallow)), order[b : b + n].tolist()
        for member, s in zip(members, starts[members].tolist(), strict=True):
            trie.insert(int.from_bytes(text[s + shallow : s + deep]), member)
        at = b
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            new_class[at + 1 : at + len(leaf)] = False
            at += len(leaf)
    return order, np.cumsum(new_class) - 1
