"""Whole texts to token ids with a public tokenizer.

The tokenizer's pre-tokenizer drops white space and never looks across it, so a text's ids are those of its words side by
side, and those of a word that signs end are its own and then theirs. Each Python worker keeps the ids of words that it has met,
up to a bound, and asks the library only for others, many at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat
from string import punctuation

import numpy as np

END_ID = 1
#: Words whose ids a worker keeps, texts and new words that it takes at a time.
KEPT_WORDS, TEXTS, NEW_WORDS = 500_000, 2_048, 2_000
#: Bytes of text that it takes at a time, for each word that it keeps: each distinct word among them is looked up once.
TEXT_BYTES = 8
#: Stands between words that go to the library; a token of its own.
_BETWEEN = "\x01"
#: What the last token of a word ends with.
_WORD_END = "</w>"
_encoders: dict[tuple[str, int], WordEncoder] = {}


def _words(texts):
    """Of an Arrow array of texts: how many words each has, and all words.

    Lower-cases A-Z, as the tokenizer will, to meet fewer words; but for texts in which that could make a special token.
    """
    import pyarrow.compute as pc

    texts = pc.replace_substring(texts, "\n", " ")  # a new array: ascii_lower errs on one whose offsets don't begin with 0, as of a cast slice
    lower = pc.ascii_lower(texts)
    if pc.any(special := pc.match_substring(texts, "<|")).as_py():
        lower = pc.if_else(special, texts, lower)
    words = pc.split_pattern(lower, " ")
    return np.diff(words.offsets.to_numpy()), words.flatten()


def _arrow(texts: list[str | None]):
    """Texts as an Arrow array without nulls; lone surrogates, which UTF-8 lacks, are replaced."""
    import pyarrow as pa

    return pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_string())


def _sliced(texts, most: int) -> Iterator:
    """Texts, of Python or of an Arrow array, as Arrow arrays of TEXTS at most, whole texts until they reach `most` bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.Array):
        whole = pc.fill_null(texts.cast(pa.large_string()), "")
        upto = np.cumsum(pc.binary_length(whole).to_numpy())
        at = 0
        while at < len(whole):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)) + 1
            yield whole[at : (at := min(end, at + TEXTS, len(whole)))]
        return
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t or "")
        if len(some) == TEXTS or held >= most:
            yield _arrow(some)
            some, held = [], 0
    if some:
        yield _arrow(some)


def _cut_signs(words):
    """Of an Arrow array of words: twice as many, each word without the signs at its end, then those.

    Cut only after a letter or digit of ASCII or Latin-1, which stay such in the tokenizer's normal form; not in what could be a special token.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    cuts = at[1:].copy()
    ended = np.flatnonzero(at[1:] > at[:-1])
    ended = ended[_SIGN[raw[at[ended + 1] - 1]]]
    if len(ended):
        some = words.take(pa.array(ended))
        end = at[ended] + pc.binary_length(pc.ascii_rtrim(some, punctuation)).to_numpy()
        last, before = raw[np.maximum(end - 1, 0)], raw[np.maximum(end - 2, 0)]
        latin = (last >= 0x80) & (before == 0xC3) & (last != 0x97) & (last != 0xB7)
        whole = pc.match_substring(some, "<|").to_numpy(zero_copy_only=False)
        good = (end > at[ended]) & (_ALNUM[last] | latin & (end > at[ended] + 1)) & ~whole
        cuts[ended[good]] = end[good]
    both = np.empty(2 * len(words) + 1, np.int64)
    both[::2], both[1::2] = at, cuts
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both), data)


def _kinds(words) -> np.ndarray:
    """Of an Arrow array of words: 0 if its letters are plain ones, 2 if what stands between words is in it, else 1."""
    import pyarrow.compute as pc

    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    odd = np.cumsum(np.append(False, ~_PLAIN[np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)]), dtype=np.int64)
    return np.where((odd[at[1:]] == odd[at[:-1]]) & (at[1:] > at[:-1]), 0, 1 + pc.match_substring(words, _BETWEEN).to_numpy(zero_copy_only=False))


def _side_by_side(number: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with so many ids each, in a row: the ids of these ones side by side, and where each one's end."""
    first, n = np.cumsum(size) - size, size.take(number)
    upto = np.cumsum(n)
    at = np.repeat(first.take(number) - upto + n, n)
    at += np.arange(len(at))
    return ids.take(at), upto


#: Bytes of words that neither normalizing nor pre-tokenizing changes, a-z and à-ÿ but ÷; the characters that stand for their bytes, in UTF-16; signs that end words, and ASCII letters and digits.
_PLAIN = np.array([b in b"abcdefghijklmnopqrstuvwxyz\xc3" or 0xA0 <= b <= 0xBF and b != 0xB7 for b in range(256)])
_KEPT_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = np.array([b if b in _KEPT_BYTES or b == ord("\n") else 256 + sum(x not in _KEPT_BYTES for x in range(b)) for b in range(256)], "<u2")
_SIGN, _ALNUM = (np.array([b < 128 and f(chr(b)) for b in range(256)]) for f in (punctuation.__contains__, str.isalnum))


class WordEncoder:
    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        (self._between,) = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self._merging = Tokenizer.from_file(path)  # the same without the steps that leave plain words alone
        self._merging.normalizer = None
        self._merging.pre_tokenizer = None
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self._kept = kept
        # words met, without signs at their ends, and signs, by number: their ids side by side, how many each has
        self._met, self._known, self._size = {"": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64)
        probe = "the naïve größe ñandú of zzyzx ÿ".split()
        if self._merged(probe)[0].tobytes() != b"".join(map(self._ids_of, probe)) or self._ids_of("größe!*") != self._ids_of("größe") + self._ids_of("!*"):
            raise ValueError("not a tokenizer of words")

    @property
    def _ids(self) -> dict[str, np.ndarray]:
        """The ids of what is kept, by word."""
        return dict(zip(self._met, np.split(self._known, np.cumsum(self._size)[:-1]), strict=True))

    def _ids_of(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words side by side, and how many each has."""
        as_bytes = _BYTE.take(np.frombuffer("\n".join(words).encode(), np.uint8)).tobytes().decode("utf-16-le").split("\n")
        ids = np.array(self._merging.encode_batch_fast([as_bytes], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        size = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
        if len(size) != len(words):
            raise ValueError("not a tokenizer of words")
        return ids, size

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words, but for what stands between them."""
        found = np.array(self._tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        between = found == self._between
        return found[~between], np.diff([-1, *np.flatnonzero(between), len(found)]) - 1

    def _learn(self, words: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words, in order of their kinds, by the library, side by side, and how many each has."""
        plain, others = np.searchsorted(kinds, [1, 2]).tolist()
        got = [self._merged(words[i : min(i + NEW_WORDS, plain)]) for i in range(0, plain, NEW_WORDS)]
        got += [self._others(words[i : min(i + NEW_WORDS, others)]) for i in range(plain, others, NEW_WORDS)]
        got += [(ids := np.frombuffer(self._ids_of(w), "<u4"), np.array([len(ids)])) for w in words[others:]]
        return np.concatenate([ids for ids, _ in got]), np.concatenate([size for _, size in got])

    def _ids_of_words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array's distinct words side by side, and how many each has; keeps those that it has asked for, while there is room."""
        parts = _cut_signs(words).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self._met.get, distinct, repeat(-1)), np.int64, len(distinct))
        known, size = self._known, self._size
        if len(gaps := np.flatnonzero(number < 0)):
            kinds = _kinds(parts.dictionary)[gaps]
            order = np.argsort(kinds, kind="stable")
            gaps, first = gaps[order], len(size)
            new = [distinct[i] for i in gaps.tolist()]
            ids, n = self._learn(new, kinds[order])
            known, size = np.concatenate([known, ids]), np.concatenate([size, n])
            number[gaps] = np.arange(first, len(size))
            if len(size) <= self._kept:
                self._met.update(zip(new, range(first, len(size)), strict=True))
                self._known, self._size = known, size
        ids, upto = _side_by_side(number.take(parts.indices.to_numpy()), known, size)
        return ids, np.diff(upto[1::2], prepend=0)

    def encode(self, texts, end_id: int = END_ID) -> Iterator[bytes]:
        """The ids of each text, of an iterable or an Arrow array, as little-endian unsigned 32-bit integers, end id included."""
        for some in _sliced(texts, TEXT_BYTES * self._kept):
            ids, ends = self._flat(some, end_id)
            raw, at = memoryview(ids).cast("B"), 0
            for end in (4 * ends).tolist():
                yield bytes(raw[at:end])
                at = end

    def _flat(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array's texts side by side, and where each text's end."""
        counts, words = _words(texts)
        words = words.dictionary_encode()
        ids, size = self._ids_of_words(words.dictionary)
        # the end id goes after each text's last word, as one word more
        last = np.cumsum(counts)
        number = np.insert(words.indices.to_numpy(), last, len(size))
        flat, upto = _side_by_side(number, np.append(ids, np.uint32(end_id)), np.append(size, 1))
        return flat, upto[last + np.arange(len(last))]


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """This worker's encoder of the vocabulary file, which keeps the ids of so many words. The file is installed on every node, or shipped with --files."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = WordEncoder(path, kept)
    return _encoders[path, kept]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
