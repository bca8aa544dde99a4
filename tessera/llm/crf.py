"""A linear-chain conditional random field over word shapes: fitted on a small labelled table, decoded by Viterbi in batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Every character is in one token; a blank before a token belongs to it.
TOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\w\s]| ?_|\s")
REACH = 2
PAD = ("pad",)


def word_shape(word: str) -> str:
    if word[0].isdigit():
        return f"d{min(len(word), 12)}"
    if not word[0].isalpha():
        return word if word.isascii() and not word.isspace() else "nl" if word == "\n" else "other"
    if word.islower() or not word[0].isupper():
        return "x1" if len(word) == 1 else "x"
    return "X1" if len(word) == 1 else "XX" if word.isupper() else "Xx"


def token_features(token: str) -> tuple[str, ...]:
    """Shape, the blank before it, lower-cased word and ending of a token."""
    word = token[1:] if token[0] == " " and len(token) > 1 else token
    shape = word_shape(word)
    blank = "_" if len(word) < len(token) else ""
    found = [shape, blank + "+" + shape]
    if word[0].isalpha():
        low = word.lower()
        found += ["w:" + low, "e:" + low[-6:]] if len(low) > 6 else ["w:" + low]
    return tuple(found)


@dataclass
class Crf:
    """Weights of features at offsets -REACH to REACH for each label, and of label pairs. Label 0 stands for no span."""

    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray  # offset, feature, label
    pairs: np.ndarray  # label before, label

    def class_weights(self, numbers: tuple[int, ...]) -> np.ndarray:
        """What a token of these features adds to the labels of the tokens at each offset from it."""
        return self.weights[:, list(numbers)].sum(axis=1)


def sequences_of(rows: list[tuple[str, list[tuple[int, int, str]]]], labels: list[str]) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Features and labels of the tokens of texts with (begin, end, kind) spans."""
    at = {name: i for i, name in enumerate(labels)}
    out = []
    for text, spans in rows:
        tokens, place, tags = TOKEN.findall(text), 0, []
        for token in tokens:
            begin = place + (token[0] == " " and len(token) > 1)
            span = next(((b, k) for b, e, k in spans if b <= begin < e), None)
            tags.append(0 if span is None else at[("B-" if span[0] == begin else "I-") + span[1]])
            place += len(token)
        if tokens:
            out.append(([token_features(t) for t in tokens], tags))
    return out


class Likelihood:
    """The negative log-likelihood of labelled sequences with its gradient; before and after a sequence stands label 0."""

    def __init__(self, sequences: list[tuple[list[tuple[str, ...]], list[int]]], features: dict[str, int], labels: int, decay: float) -> None:
        self.shape, self.decay = (2 * REACH + 1, len(features), labels), decay
        self.n, self.longest = len(sequences), max(len(tags) for _, tags in sequences)
        self.lengths = np.array([len(tags) for _, tags in sequences])
        self.tags = np.zeros((self.n, self.longest), dtype=np.int64)
        cells, numbers = [], []
        for i, (tokens, tags) in enumerate(sequences):
            self.tags[i, : len(tags)] = tags
            padded = [PAD] * REACH + tokens + [PAD] * REACH
            for t in range(len(tokens)):
                for k in range(2 * REACH + 1):
                    for f in padded[t + k]:
                        if f in features:
                            cells.append(i * self.longest + t)
                            numbers.append((2 * REACH - k) * len(features) + features[f])
        self.cells, self.numbers = np.array(cells), np.array(numbers)
        self.mask = np.arange(self.longest) < self.lengths[:, None]

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        k, f, y = self.shape
        weights, pairs = theta[: k * f * y].reshape(k * f, y), theta[k * f * y :].reshape(y, y)
        scores = np.zeros((self.n * self.longest, y))
        for label in range(y):
            scores[:, label] = np.bincount(self.cells, weights[self.numbers, label], minlength=len(scores))
        scores = scores.reshape(self.n, self.longest, y)
        # Sums over all paths, scaled so that those up to each token add up to 1.
        tops = scores.max(axis=2)
        scaled, step = np.exp(scores - tops[:, :, None]), np.exp(pairs)
        ahead, back, sums = np.empty_like(scores), np.empty_like(scores), np.empty_like(tops)
        for t in range(self.longest):
            ahead[:, t] = (ahead[:, t - 1] @ step if t else step[0]) * scaled[:, t]
            sums[:, t] = ahead[:, t].sum(axis=1)
            ahead[:, t] /= sums[:, t, None]
        rows, last = np.arange(self.n), self.lengths - 1
        end = ahead[rows, last] @ step[:, 0]
        total = ((np.log(sums) + tops) * self.mask).sum(axis=1) + np.log(end)
        close = step[:, 0] / end[:, None]
        for t in range(self.longest - 1, -1, -1):
            if t + 1 < self.longest:
                scaled[:, t + 1] *= back[:, t + 1] / sums[:, t + 1, None]
            back[:, t] = np.where((last == t)[:, None], close, scaled[:, t + 1] @ step.T if t + 1 < self.longest else 0)
        shares = ahead * back * self.mask[:, :, None]
        seen = np.zeros_like(scores)
        np.put_along_axis(seen, self.tags[:, :, None], 1.0, axis=2)
        seen *= self.mask[:, :, None]
        value = float(total.sum() - (scores * seen).sum())
        slope = (shares - seen).reshape(-1, y)
        by_weight = np.empty((k * f, y))
        for label in range(y):
            by_weight[:, label] = np.bincount(self.numbers, slope[self.cells, label], minlength=k * f)
        by_pair = np.zeros((y, y))
        before = np.concatenate([np.zeros((self.n, 1), dtype=np.int64), self.tags], axis=1)
        after = np.where(np.arange(self.longest + 1) < self.lengths[:, None], np.concatenate([self.tags, np.zeros((self.n, 1), dtype=np.int64)], axis=1), 0)
        used = np.arange(self.longest + 1) <= self.lengths[:, None]
        steps = np.bincount((before * y + after)[used], minlength=y * y).reshape(y, y)
        value -= float((steps * pairs).sum())
        by_pair -= steps
        by_pair[0] += shares[:, 0].sum(axis=0)
        by_pair[:, 0] += shares[rows, last].sum(axis=0)
        for t in range(1, self.longest):
            by_pair += step * (ahead[:, t - 1].T @ (scaled[:, t] * self.mask[:, t, None]))
        gradient = np.concatenate([by_weight.ravel(), by_pair.ravel()])
        return value + 0.5 * self.decay * dot(theta, theta), gradient + self.decay * theta


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Summed in one order on every machine, unlike a @ b."""
    return float((a * b).sum())


def descend(function, start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps."""
    x, (value, gradient), moves = start, function(start), []
    for _ in range(steps):
        direction, kept = -gradient, []
        for s, g in reversed(moves):
            kept.append(dot(s, direction) / dot(s, g))
            direction = direction - kept[-1] * g
        if moves:
            s, g = moves[-1]
            direction = direction * (dot(s, g) / dot(g, g))
        for (s, g), a in zip(moves, reversed(kept), strict=True):
            direction = direction + (a - dot(g, direction) / dot(s, g)) * s
        step, slope = (1.0 if moves else 1.0 / max(1.0, float(np.abs(gradient).sum()))), dot(gradient, direction)
        while step > 1e-10:
            new_value, new_gradient = function(x + step * direction)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, g = step * direction, new_gradient - gradient
        done = abs(value - new_value) < 1e-5 * abs(value)
        x, value, gradient = x + s, new_value, new_gradient
        if dot(s, g) > 1e-12:
            moves = [*moves, (s, g)][-memory:]
        if done:
            break
    return x


def fit(rows: list[tuple[str, list[tuple[int, int, str]]]], kinds: list[str], *, decay: float = 0.3, least: int = 2, steps: int = 80) -> Crf:
    """A field fitted on texts with (begin, end, kind) spans; features seen fewer than `least` times are left out."""
    labels = ["O", *(f"{p}-{k}" for k in kinds for p in "BI")]
    sequences = sequences_of(rows, labels)
    counts: dict[str, int] = {PAD[0]: least}
    for tokens, _ in sequences:
        for f in (f for token in tokens for f in token):
            counts[f] = counts.get(f, 0) + 1
    features = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    size = (2 * REACH + 1, len(features), len(labels))
    theta = np.zeros(size[0] * size[1] * size[2] + len(labels) ** 2)
    if sequences:
        theta = descend(Likelihood(sequences, features, len(labels), decay), theta, steps)
    cut = size[0] * size[1] * size[2]
    return Crf(labels, features, theta[:cut].reshape(size), theta[cut:].reshape(len(labels), len(labels)))


def viterbi(scores: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels of sequences (padded), with label 0 before and behind each."""
    n, longest, y = scores.shape
    best, came = pairs[0] + scores[:, 0], np.zeros((n, longest, y), dtype=np.int8)
    ends = np.zeros(n, dtype=np.int64)
    for t in range(longest):
        if t:
            ways = best[:, :, None] + pairs
            came[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        at = lengths == t + 1
        ends[at] = (best[at] + pairs[:, 0]).argmax(axis=1)
    found = np.zeros((n, longest), dtype=np.int64)
    here = np.zeros(n, dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        here = np.where(lengths == t + 1, ends, here)
        found[:, t] = np.where(lengths > t, here, 0)
        here = came[np.arange(n), t, here]
    return found


class TokenClasses(dict):
    """The number of each token's class; the weights of new classes are added to `rows`."""

    def __init__(self, crf: Crf, rows: list[np.ndarray]) -> None:
        self.crf, self.rows, self.numbers = crf, rows, {}

    def __missing__(self, token: str) -> int:
        features = tuple(self.crf.features[f] for f in token_features(token) if f in self.crf.features)
        number = self.numbers.get(features)
        if number is None:
            number = self.numbers[features] = len(self.rows)
            self.rows.append(self.crf.class_weights(features))
        self[token] = number
        return number


class Decoder:
    """Labels of the tokens of many texts at once.

    A token's share of the scores depends on the class of its features only, and there are few classes. Labels other than 0
    in a row gain at most what each of their tokens gains at best over label 0, the best pair into it included: tokens that
    no such stretch with a gain can hold have label 0 on the best path. Only the others, mostly near cues, are decoded, each
    stretch on its own between labels 0. That leaves the best path of the whole text as it is. Gains are first bounded from
    each neighbour's best, then worked out for the tokens left.
    """

    def __init__(self, crf: Crf, most_tokens: int = 300_000) -> None:
        self.crf, self.most = crf, most_tokens
        self.rows = [crf.class_weights(tuple(crf.features[f] for f in PAD))]
        self.known = TokenClasses(crf, self.rows)
        self.into = crf.pairs[:, 1:].max(axis=0) - crf.pairs[0, 0]
        self.edge = float(crf.pairs[1:, 0].max() - crf.pairs[0, 0])
        self.tables()

    def tables(self) -> None:
        self.weights = np.stack(self.rows)  # class, offset, label
        over = self.weights[:, :, 1:] - self.weights[:, :, :1]
        over[:, REACH] += self.into
        self.gain = over.max(axis=2)

    def classes_of(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        out = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(self.rows) > len(self.weights):
            self.tables()
        return out

    def can_gain(self, gain: np.ndarray) -> np.ndarray:
        """Whether some stretch around each place gains as a whole; the slack covers rounding of the sums."""
        total = np.cumsum(gain)
        before = np.concatenate([[0.0], total[:-1]])
        upto = total - np.minimum.accumulate(before)
        onward = np.maximum.accumulate(total[::-1])[::-1] - before
        return upto + onward - gain + self.edge > -1e-3

    def decode(self, texts: list[list[str]], everything: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of tokens the places of labels other than 0, and the labels. everything: leave no token out."""
        ends = np.cumsum([len(t) + REACH for t in texts])
        classes = np.zeros(int(ends[-1]) + REACH if texts else 0, dtype=np.int64)
        inside = np.zeros(len(classes), dtype=bool)
        flat = self.classes_of([token for t in texts for token in t])
        begins = ends - np.array([len(t) for t in texts], dtype=np.int64) if texts else ends
        done = 0
        for begin, t in zip(begins.tolist(), texts, strict=True):
            classes[begin : begin + len(t)] = flat[done : done + len(t)]
            inside[begin : begin + len(t)] = True
            done += len(t)
        body = np.flatnonzero(inside)
        if not len(body):
            return [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in texts]
        gain = np.full(len(classes), -1e3)
        gain[body] = sum(self.gain[classes[body + k], REACH - k] for k in range(-REACH, REACH + 1))
        open_ = inside & (self.can_gain(gain) | everything)
        if not everything:
            left = np.flatnonzero(open_)
            scores = sum(self.weights[classes[left + k], REACH - k] for k in range(-REACH, REACH + 1))
            gain[left] = (scores[:, 1:] - scores[:, :1] + self.into).max(axis=1)
            gain[inside & ~open_] = -1e3
            open_ = inside & self.can_gain(gain)
        turns = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
        lows, sizes = turns[::2], turns[1::2] - turns[::2]
        labels = np.zeros(len(classes), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # Stretches of like length, about a hundred thousand tokens at once.
            to = at + 1
            while to < len(order) and sizes[order[to]] <= 2 * sizes[order[at]] and (to - at) * sizes[order[to]] < 100_000:
                to += 1
            own, lengths = lows[order[at:to]], sizes[order[at:to]]
            places = own[:, None] + np.minimum(np.arange(lengths[-1]), lengths[:, None] - 1)
            scores = sum(self.weights[classes[places + k], REACH - k] for k in range(-REACH, REACH + 1))
            found = viterbi(scores, self.crf.pairs, lengths)
            valid = np.arange(lengths[-1]) < lengths[:, None]
            labels[places[valid]] = found[valid]
            at = to
        hits = np.flatnonzero(labels)
        owner = np.searchsorted(ends, hits, side="right")
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [(hits[a:b] - begin, labels[hits[a:b]]) for a, b, begin in zip(cuts[:-1], cuts[1:], begins.tolist(), strict=True)]


def spans_of(labels: list[str], tokens: list[str], places: np.ndarray, found: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, kind) in characters of the labelled tokens of a text."""
    if not len(places):
        return []
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    out: list[tuple[int, int, str]] = []
    last = -2
    for i, label in zip(places.tolist(), found.tolist(), strict=True):
        part, kind = labels[label].split("-")
        token = tokens[i]
        begin, end = int(offsets[i]) + (token[0] == " " and len(token) > 1), int(offsets[i + 1])
        if part == "I" and last == i - 1 and out[-1][2] == kind:
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((begin, end, kind))
        last = i
    return out
