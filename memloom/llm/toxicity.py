"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

A text is cut into sentences and those into words of letters: signs within a word are dropped ("id-iot"), digits and signs
that stand for letters are read as those, and runs of one-letter words are joined ("i d i o t"). The kernel counts what two
spans have in common as three-letter subsequences, gaps allowed: each occurrence weighs DECAY to the power of its length,
so an insult with an inserted letter keeps most of its subsequences; a word that these make suspicious is also measured without
each of its inner letters. A span is a word, or two adjoining words of a sentence, whose
subsequences may lie across the space; the marks around words count as letters. The kernel is normalised; where that can't
lift a span above NEAR, its length in feature space is taken from its number of letters, which is never too long.

Labels are for documents, so training labels sentences first. All sentences of clean documents are clean; a sentence of a
toxic document is toxic if it has a span whose letter groups mark toxic documents (its witness). A sentence's margin is that
of its worst span. Witnesses with an inserted letter are further toxic examples, and witnesses with other letters at either
end or in the middle clean ones.
Landmarks are witnesses, unlike one another, and clean spans; the machine is a linear one, trained by Newton steps on the
squared hinge loss, over the Nystroem map. It is linear in the subsequences, so its landmarks are folded into one weight for
each three letters: exact, and scoring is linear in the text, with bounded memory.

A document's score is the larger of two logistic curves: one over its worst sentence's margin, bent at PLAIN, what all its
sentences exceed MILD by (as a logarithm), and its number of sentences (as a logarithm), so that several mild insults add up;
the other over the worst sentence's margin alone, so that one plain insult is enough in a long text. The curves are fitted to margins that machines trained on the other
half of the documents give.

Defined results: a null, empty or wordless text has one sentence with the margin WORDLESS, below any clean word's; repeated
rows score alike; an empty table gives no rows; without usable labels every score is 0; input columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import own, replacing, sampled, slices

DECAY = 0.8
#: Distances between the three letters.
STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
LETTERS, MARK = 45, 44
FEATURES = LETTERS**3
#: Letters by byte: 1 to 26; digits and signs that stand for letters as those; 27 other digits; bytes of other scripts 28 to 43; 0 the rest.
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = 27
for _sign, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _CODE[ord(_sign)] = ord(_letter) - 96
_CODE[128:] = 28 + (np.arange(128) & 15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
WORDLESS, MILD, PLAIN = -3.0, 0.0, 1.5
#: Spans with an inserted letter that are made of a witness.
INSERTED = 4
#: How many clean documents a toxic one counts as in the curves.
TOXIC_COUNTS = 1.2
#: The margin from which a word is tried without each of its inner letters, what that costs, and the letters of such a word at most.
NEAR, MENDED, LONGEST = -0.2, 0.3, 40
#: Slots between sentences: two marks around as many zeros as a subsequence can reach.
_APART = 6


@dataclass(frozen=True)
class Training:
    """Parameters. `sample`: labelled documents at most, the first by a hash of doc_id, a fifth of them toxic where there are so many, of `most_bytes` at most together."""

    sample: int = 3000
    most_bytes: int = 32 << 20
    witnesses: int = 1500
    clean_spans: int = 6000
    landmarks: int = 200
    group: int = 5
    varied: int = 400
    pool: int = 60_000
    worst: int = 2000
    rounds: int = 3
    goal: float = 1.0
    ridge: float = 1e-4
    seed: int = 11


def norm(letters: np.ndarray) -> np.ndarray:
    """The length in feature space of a span of so many letters, marks included, whose subsequences all differ; other spans are longer."""
    n = np.asarray(letters, np.float64)
    return np.sqrt(np.maximum(sum(DECAY ** (2 * sum(gaps) + 2) * np.maximum(n - sum(gaps), 0) for gaps in STEPS), DECAY**6))


@dataclass(frozen=True)
class Words:
    """Words side by side: letters with the marks around each, where those marks are, the sentence of each word, the text of each sentence."""

    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray) -> Words:
        """Of texts side by side, with a line's end before, between and after them."""
        code, space = _CODE[data], _SPACE[data]
        stop = data == 10
        stop[:-1] |= _STOP[data[:-1]] & space[1:]
        at = np.flatnonzero((code > 0) | space)
        apart = space[at]
        at = at[~apart | np.concatenate([[True], ~apart[:-1]])]
        code, apart, sentence = code[at], space[at], np.cumsum(stop)[at]
        between = np.flatnonzero(apart)
        if len(between) < 2:
            return cls(*(np.zeros(0, np.int64) for _ in range(5)))
        first = between[:-1] + 1
        of = sentence[first]
        single = np.diff(between) == 2
        joined = single[:-1] & single[1:] & (of[:-1] == of[1:])
        gone = np.zeros(len(at), bool)
        gone[between[1:-1][joined]] = True
        begins = np.concatenate([[True], ~joined])
        first, of = first[begins], of[begins]
        raw = at[first]
        code, apart = code[~gone], apart[~gone]
        size = np.ones(len(code), np.int64)
        between = np.flatnonzero(apart)
        code[between] = MARK
        far = np.concatenate([[True], of[1:] != of[:-1], [True]])
        size[between[far]] = _APART
        place = np.cumsum(size) - size
        out = np.repeat(code, size)
        for k in range(1, _APART - 1):
            out[place[between[far]] + k] = 0
        own_sentence = np.cumsum(far[:-1]) - 1
        text = np.searchsorted(starts, raw[far[:-1]], "right") - 1
        return cls(out.astype(np.int32), place[between[:-1]] + size[between[:-1]] - 1, place[between[1:]], own_sentence, text)

    @classmethod
    def listed(cls, spans: list[bytes]) -> Words:
        """Of spans, each a sentence of its own."""
        lens = np.array([len(s) for s in spans])
        start = np.cumsum(lens + _APART) - lens - _APART + 1
        code = np.zeros(int(lens.sum()) + _APART * (len(spans) + 1), np.int32)
        code[np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())] = np.frombuffer(b"".join(spans), np.uint8)
        return cls(code, start, start + lens - 1, np.arange(len(spans)), np.arange(len(spans)))

    def subsequences(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """For each choice of distances: their sum, their weight, and the subsequence at each place."""
        for gaps in STEPS:
            n, at = len(self.code) - sum(gaps), 0
            ids = self.code[:n].copy()
            for gap in gaps:
                at += gap
                ids *= LETTERS
                ids += self.code[at : at + n]
            yield at, DECAY ** (at + 1), ids

    def left(self) -> np.ndarray:
        """How far the mark after the word is, for each place from the mark before it on."""
        out = np.zeros(len(self.code), np.int64)
        size = self.end - self.start
        at = np.repeat(self.start - np.cumsum(size) + size, size) + np.arange(size.sum())
        out[at] = np.repeat(self.end, size) - at
        return out

    def spans(self, one: dict[bytes, bytes]) -> list[list[bytes]]:
        """For each sentence, its words and pairs of words, with marks around them, each distinct one held once."""
        raw = self.code.astype(np.uint8).tobytes()
        out: list[list[bytes]] = [[] for _ in range(len(self.text))]
        last = before = -1
        for s, a, b in zip(self.sentence.tolist(), self.start.tolist(), self.end.tolist(), strict=True):
            word = raw[a : b + 1]
            out[s].append(one.setdefault(word, word))
            if s == last:
                both = raw[before : b + 1]
                out[s].append(one.setdefault(both, both))
            last, before = s, a
        return out


def _summed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans that are listed: span, subsequence, and the weight of its occurrences together."""
    size = np.diff(np.append(words.start, len(words.code)))
    of = np.concatenate([np.full(words.start[0], -1), np.repeat(np.arange(len(size)), size)]) if len(size) else np.zeros(0, np.int64)
    keys, weights = [], []
    for _, weight, ids in words.subsequences():
        at = np.flatnonzero((ids % LETTERS > 0) & (ids // LETTERS % LETTERS > 0) & (ids // LETTERS**2 > 0))
        keys.append(of[at] * FEATURES + ids[at])
        weights.append(np.full(len(at), weight))
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    return keys // FEATURES, keys % FEATURES, np.bincount(back, np.concatenate(weights), len(keys))


def norms(words: Words) -> np.ndarray:
    """The lengths of listed spans in feature space."""
    span, _, value = _summed(words)
    return np.sqrt(np.maximum(np.bincount(span, value * value, len(words.start)), DECAY**6))


def phi(span: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A span in the kernel's feature space, normalised: its subsequences and their values."""
    words = Words.listed([span])
    _, ids, value = _summed(words)
    return ids, value / norms(words)[0]


@dataclass(frozen=True)
class Landmarks:
    """weight[row[subsequence], landmark]: the landmarks in feature space, over the subsequences that any of them has; the last row is zero."""

    row: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, spans: list[bytes]) -> Landmarks:
        each = [phi(s) for s in spans]
        used = np.unique(np.concatenate([ids for ids, _ in each]))
        row = np.full(FEATURES, len(used), np.int32)
        row[used] = np.arange(len(used))
        weight = np.zeros((len(used) + 1, len(spans)), np.float32)
        for j, (ids, values) in enumerate(each):
            weight[row[ids], j] = values
        return cls(row, weight)

    def folded(self, share: np.ndarray) -> np.ndarray:
        """One weight for each subsequence: the landmarks', by share."""
        return (self.weight @ share).astype(np.float32)[self.row]


def kernel(spans: list[bytes], marks: Landmarks, batch: int = 1000) -> np.ndarray:
    """The kernel of each span with each landmark."""
    out = [np.zeros((0, marks.weight.shape[1]), np.float32)]
    for i in range(0, len(spans), batch):
        some = spans[i : i + batch]
        words = Words.listed(some)
        total = np.zeros((len(words.code), marks.weight.shape[1]), np.float32)
        for _, weight, ids in words.subsequences():
            row = marks.row[ids]
            at = np.flatnonzero(row < len(marks.weight) - 1)
            total[at] += np.float32(weight) * marks.weight[row[at]]
        out.append(np.add.reduceat(total, words.start, axis=0) / norms(words)[:, None])
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    """weights[subsequence] and bias of a span's margin; two curves over what evidence() gives, of all of it and of the worst margin alone, and their offsets."""

    weights: np.ndarray
    bias: float
    curves: tuple[tuple[float, ...], ...] = ((1.0, 0.0, 0.0, 0.0),)
    offsets: tuple[float, ...] = (0.0,)

    def margins_of(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The margin of each word, the places of words that another of the sentence follows, and the margins of those pairs."""
        inside, across = np.zeros(len(words.code)), np.zeros(len(words.code))
        left = words.left()
        for reach, weight, ids in words.subsequences():
            v = weight * self.weights[ids]
            within = left[: len(ids)] >= reach
            inside[: len(ids)] += np.where(within, v, 0)
            across[: len(ids)] += np.where(within, 0, v)
        one, over, size = np.add.reduceat(inside, words.start), np.add.reduceat(across, words.start), words.end - words.start + 1
        pair = np.flatnonzero(words.sentence[1:] == words.sentence[:-1])
        both = (one[pair] + one[pair + 1] + over[pair]) / norm(size[pair] + size[pair + 1] - 1)
        return one / norm(size) + self.bias, pair, both + self.bias

    def worst(self, words: Words, mend: bool = True) -> np.ndarray:
        """Each sentence's largest margin over its words and pairs of words. A word that is somewhat like a toxic one also counts as what it is without one inner letter, less MENDED."""
        margin, pair, both = self.margins_of(words)
        raw = words.code.astype(np.uint8).tobytes()
        near = np.flatnonzero(margin > NEAR)
        spans = [raw[a : b + 1] for a, b in zip(words.start[near].tolist(), words.end[near].tolist(), strict=True)]
        margin[near] = self.exact(spans, margin[near])
        far = np.flatnonzero(both > NEAR)
        both[far] = self.exact([raw[a : b + 1] for a, b in zip(words.start[pair[far]].tolist(), words.end[pair[far] + 1].tolist(), strict=True)], both[far])
        out = margin.copy()
        out[pair] = np.maximum(out[pair], both)
        tried = [(i, s) for i, s, m in zip(near.tolist(), spans, margin[near].tolist(), strict=True) if m > NEAR and 6 < len(s) <= LONGEST + 2] if mend else []
        if tried:
            mended = [s[:k] + s[k + 1 :] for _, s in tried for k in range(2, len(s) - 2)]
            got = self.exact(mended, self.margins_of(Words.listed(mended))[0])
            counts, at = np.array([len(s) - 4 for _, s in tried]), np.array([i for i, _ in tried])
            out[at] = np.maximum(out[at], np.maximum.reduceat(got, np.cumsum(counts) - counts) - MENDED)
        return np.maximum.reduceat(out, np.flatnonzero(np.diff(words.sentence, prepend=-1)))

    def exact(self, spans: list[bytes], margin: np.ndarray) -> np.ndarray:
        """Margins by the spans' own lengths in feature space, from those by norm()."""
        if not spans:
            return margin
        return self.bias + (margin - self.bias) * norm(np.array([len(s) for s in spans])) / norms(Words.listed(spans))

    def evidence(self, texts) -> np.ndarray:
        """For each text: its worst sentence's margin, what that exceeds PLAIN by, log(1 + what its sentences exceed MILD by), log(sentences)."""
        out = [np.zeros((0, 4))]
        for data, starts, _ in slices((None if t is None else t.lower() for t in texts), 1 << 19):
            words = Words.of(data, starts)
            got = np.tile([WORDLESS, 0.0, 0.0, 0.0], (len(starts), 1))
            if len(words.start):
                margin = self.worst(words)
                has = np.unique(words.text)
                first = np.searchsorted(words.text, has)
                got[has, 0] = np.maximum.reduceat(margin, first)
                got[has, 1] = np.maximum(got[has, 0] - PLAIN, 0)
                got[has, 2] = np.log1p(np.add.reduceat(np.maximum(margin - MILD, 0), first))
                got[has, 3] = np.log(np.diff(np.append(first, len(margin))))
            out.append(got)
        return np.concatenate(out)

    def margins(self, texts) -> np.ndarray:
        return self.evidence(texts)[:, 0]

    def score(self, texts) -> np.ndarray:
        odds = self.evidence(texts) @ np.array(self.curves).T + np.array(self.offsets)
        return 1 / (1 + np.exp(-np.clip(odds.max(1), -30, 30)))


NOTHING = Model(np.zeros(FEATURES, np.float32), 0.0, ((0.0, 0.0, 0.0, 0.0),), (-30.0,))


def sentences(texts: list[str | None]) -> list[list[list[bytes]]]:
    """The spans of each sentence of each text."""
    out: list[list[list[bytes]]] = []
    one: dict[bytes, bytes] = {}
    for data, starts, _ in slices(None if t is None else t.lower() for t in texts):
        words = Words.of(data, starts)
        own_: list[list[list[bytes]]] = [[] for _ in starts]
        for text, spans in zip(words.text.tolist(), words.spans(one), strict=True):
            own_[text].append(spans)
        out += own_
    return out


@dataclass(frozen=True)
class Spoken:
    """A text's sentences, as sentences() gives them, made anew whenever they are gone through: training holds no spans of all documents at once."""

    text: str

    def __iter__(self) -> Iterator[list[bytes]]:
        return iter(sentences([self.text])[0])

    def __len__(self) -> int:
        return len(sentences([self.text])[0])


def _groups(span: bytes, n: int) -> set[bytes]:
    return {span[i : i + n] for i in range(max(1, len(span) - n + 1))}


def _varied(span: bytes, rng: np.random.Generator) -> tuple[list[bytes], list[bytes]]:
    """The span with an inserted letter, INSERTED times, and with other letters: at its end, at its beginning, in the middle."""
    inner, n = span[1:-1], len(span) - 2
    other = lambda k: bytes(rng.integers(1, 27, k).tolist())
    mark = bytes([MARK])
    toxic = [mark + inner[:k] + other(1) + inner[k:] + mark for k in rng.integers(1, n, INSERTED)]
    half = max(2, n // 2)
    changed = [other(1) + inner, inner[:-1] + other(1), inner[:-half] + other(half), other(half) + inner[half:], inner[: n // 2] + other(2) + inner[n // 2 + 2 :], inner[:half]]
    return toxic, [mark + x + mark for x in changed if x != inner and x]


def fit(toxic: Sequence[Collection[list[bytes]]], clean: Sequence[Collection[list[bytes]]], how: Training = Training()) -> Model:
    """A machine from the sentences of each toxic and each clean document, as lists of spans; its curve is not fitted yet."""
    if not any(toxic) or not any(clean):
        return NOTHING
    rng = np.random.default_rng(how.seed)
    seen: dict[int, dict[bytes, int]] = {0: {}, 1: {}}
    counts: dict[int, dict[bytes, int]] = {0: {}, 1: {}}
    for y, docs in ((1, toxic), (0, clean)):
        for doc in docs:
            spans = {w for s in doc for w in s}
            for w in spans:
                counts[y][w] = counts[y].get(w, 0) + 1
            for g in {g for w in spans for g in _groups(w, how.group)}:
                if y or g in seen[1]:
                    seen[y][g] = seen[y].get(g, 0) + 1
    rate = {g: np.log((n + 0.1) / len(toxic) / ((seen[0].get(g, 0) + 0.5) / len(clean))) * np.sqrt(n) for g, n in seen[1].items()}
    best = {w: max(rate[g] for g in _groups(w, how.group)) for w in counts[1]}
    worth = lambda w: (best[w], -len(w), w)  # noqa: E731  of two spans that share the worst group, the shorter
    found: dict[bytes, float] = {}
    for doc in toxic:
        top = max((best[w] for s in doc for w in s), default=0.0)
        for s in doc:  # the sentences with a span nearly as bad as the document's worst are toxic
            if s and (value := best[w := max(s, key=worth)]) >= 0.8 * top and value > 0:
                found[w] = max(found.get(w, 0), value)
    witnesses = sorted((w for w in found if w not in counts[0] and len(w) > 3), key=lambda w: (-found[w], w))[: how.witnesses]
    if not witnesses:
        return NOTHING
    del seen, rate, best
    clean_spans = sorted(counts[0])
    clean_spans.sort(key=lambda w: -counts[0][w])
    # the commonest spans, and as many others
    pick = lambda n: [*clean_spans[: n // 2], *(clean_spans[n // 2 + i] for i in np.sort(rng.permutation(max(0, len(clean_spans) - n // 2))[: n - n // 2]))]
    some, pool = pick(how.clean_spans), pick(how.pool)
    told, met = {w: counts[1][w] for w in witnesses}, {w: counts[0][w] for w in some + pool}
    del counts, clean_spans
    chosen: list[int] = []
    nearest = np.zeros(len(witnesses))
    for i in range(len(witnesses)):
        if len(chosen) < how.landmarks * 2 // 3 and nearest[i] < 0.7:
            chosen.append(i)
            nearest = np.maximum(nearest, kernel(witnesses, Landmarks.of([witnesses[i]]))[:, 0])
    commonest = [w for w in sorted(witnesses, key=lambda w: (-told[w], w)) if len(w) > 5][: how.varied]
    varied = [_varied(w, rng) for w in commonest]
    broken = [x for xs, _ in varied for x in xs]
    alike = [x for _, xs in varied for x in xs if x not in found]
    hard: dict[bytes, None] = {}
    near = some
    for _ in range(how.rounds):
        marks = Landmarks.of([witnesses[i] for i in chosen] + near[: how.landmarks - len(chosen)])
        val, vec = np.linalg.eigh(marks.weight.T @ marks.weight + 1e-4 * np.eye(marks.weight.shape[1]))
        root = vec / np.sqrt(np.maximum(val, 1e-6)) @ vec.T
        spans = witnesses + broken + some + list(hard) + alike
        known = np.concatenate([kernel(spans, marks) @ root, np.zeros((1, len(root)))])  # the last: a span like none of the landmarks, clean
        x = np.concatenate([known, np.ones((len(known), 1))], axis=1)
        n = len(witnesses) + len(broken)
        goal = np.where(np.arange(len(known)) < n, how.goal, -1.0)
        shares = [np.sqrt([told[w] for w in witnesses]), np.sqrt([told[w] for w in commonest for _ in range(INSERTED)]), np.array([met[w] for w in some + list(hard)], float) ** 0.5, np.ones(len(alike)), np.ones(1)]
        share = np.concatenate([part * s / max(s.sum(), 1e-9) for part, s in zip((0.2, 0.3, 0.35, 0.1, 0.05), shares, strict=True)])
        w = _newton(x, goal, share, how.ridge)
        model = Model(marks.folded(root @ w[:-1]), float(w[-1]))
        margin = np.concatenate([model.worst(Words.listed(pool[i : i + 4000]), mend=False) for i in range(0, len(pool), 4000)])
        worst = [pool[i] for i in np.argsort(-margin, kind="stable")[: how.worst] if margin[i] > -1]
        hard |= dict.fromkeys(worst)
        near = worst + some
    return model


def _newton(x: np.ndarray, goal: np.ndarray, share: np.ndarray, ridge: float) -> np.ndarray:
    """Least weighted squared hinge loss, margins reaching for their goal; steps are damped, as full ones can go round in circles."""
    w, y = np.zeros(x.shape[1]), np.sign(goal)

    def loss(w: np.ndarray) -> float:
        return float(share @ np.maximum(0, y * (goal - x @ w)) ** 2 + ridge * (w @ w))

    for _ in range(60):
        active = y * (goal - x @ w) > 0
        part = x[active] * share[active, None]
        step = np.linalg.solve(part.T @ x[active] + ridge * np.eye(x.shape[1]), part.T @ goal[active]) - w
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        if now - loss(w + size * step) <= 1e-9:
            break
        w = w + size * step
    return w


def curve(evidence: np.ndarray, y: np.ndarray, used: list[bool], ridge: float = 0.3) -> tuple[tuple[float, ...], float]:
    """A logistic curve over the evidence that is used, by Newton steps, shrunk a little. A larger margin or excess never lowers a score."""
    x = np.concatenate([evidence, np.ones((len(evidence), 1))], axis=1)
    each = np.where(y == 1, TOXIC_COUNTS, 1.0)
    use, pull = np.array([*used, True]), ridge * np.array([1, 1, 1, 1, 0.0])
    while True:
        w = np.zeros(5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = (x.T * (each * p * (1 - p) + 1e-6)) @ x + np.diag(pull + 1e-9)
            step = np.linalg.solve(bend[np.ix_(use, use)], (x.T @ (each * (p - y)) + pull * w)[use])
            w[use] -= step
            if np.abs(step).max() < 1e-8:
                break
        bad = use & (w < 0) & np.array([True, True, True, False, False])
        if not bad.any():
            return tuple(w[:4].tolist()), float(w[4])
        use &= ~bad


def fitted(texts: list[str], labels: list[int], how: Training = Training()) -> Model:
    """A machine with its curve, from labelled documents."""
    y, said = np.array(labels), [Spoken(t) for t in texts]
    some = lambda on, label: [said[i] for i in np.flatnonzero(on & (y == label))]
    evidence = np.zeros((len(y), 4))
    half = np.arange(len(y)) % 2 == 0
    for mine in (half, ~half):
        evidence[mine] = fit(some(~mine, 1), some(~mine, 0), how).evidence([texts[i] for i in np.flatnonzero(mine)])
    machine = fit(some(half | ~half, 1), some(half | ~half, 0), how)
    if machine is NOTHING:
        return NOTHING
    curves, offsets = zip(*(curve(evidence, y, used) for used in ([True] * 4, [True, True, False, False])), strict=True)
    return Model(machine.weights, machine.bias, curves, offsets)


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A machine from the labelled rows of docs that aren't held out: at most `sample` rows, of `most_bytes` of text at most, reach the driver, whole; copies count once."""
    rows = sampled(docs, labels, "toxic", {0: how.sample - how.sample // 5, 1: how.sample // 5}, how.most_bytes).select("o", "y", "text").collect()
    unique = sorted({(r["o"], r["y"], r["text"]) for r in rows})
    unique = list({(y, t): (y, t) for _, y, t in unique}.values())
    del rows
    return fitted([t for _, t in unique], [y for y, _ in unique], how)


def probability(docs: DataFrame, model: Model) -> Column:
    """The probability of label 1 (0 to 1) of docs' texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts))

    return scored(own(docs, "text"))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with `score` (0 to 1, higher: toxic likelier) and `predicted` (1 if score >= threshold, else 0)."""
    out = replacing(docs, "score", "predicted")
    out = out.withColumn("score", probability(out, model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with their own columns only."""
    return docs.where(probability(docs, model) < threshold)
