"""An adaptive context-mixing range coder for token ids.

A segment's ids become symbols in order of frequency. Three orders predict each: order 2 (the two symbols before it, hashed)
and order 1 (the one before it) name the id that followed most often, each with a class of how sure it is; order 0 has a
frequency for every symbol. The prediction is their mixture, w2 [x is order 2's] + w1 [x is order 1's] + w0 p0(x) (both named by
order 1, its best and its second best, where order 2 is less sure), and it
drives a range coder with 48-bit registers (whole numbers in doubles), one step an id. The mixture's weights adapt: a block holds a
pair for every two classes and moves it towards what it sees, from the segment's averages on.

Ids are cut into blocks that are coded on their own, each from the same state and with a checksum of its ids; only the
segment's predictions come before them. Blocks are coded side by side, a lane of numpy vectors each. Carries are left in the
words and settled at the end. Ids may have up to 32 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"ACM2"
#: Ids of a segment, up to an eighth more, so that a chunk's last document makes none of its own; lanes; ids of a block at least.
SEGMENT, LANES, SHORTEST = 1 << 22, 2048, 512
#: Symbols that are looked at together where no step waits for the one before it.
ROWS_OF = 1 << 14
#: Bits of a hashed order-2 context, classes of sureness, bits of the mixture's weights, how fast they move.
SLOT_BITS, CLASS_BITS, WEIGHT_BITS, RATE = 15, 3, 12, 6
CLASSES, SYMBOL_BITS = 1 << CLASS_BITS, 32 - CLASS_BITS
#: What the adaptive weights count to.
FULL = 65_535
_WHOLE, _LEAST, _WORD = 2.0**48, 2.0**32, 65_536.0


def _slot(before: np.ndarray, before_that: np.ndarray, bits: int) -> np.ndarray:
    return (before * np.uint32(0x9E3779B1) + before_that * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)


def _turned(table: np.ndarray, tile: int = 64) -> np.ndarray:
    """The table with rows and columns exchanged, a strip at a time, which stays in the processor's cache."""
    out = np.empty(table.shape[::-1], table.dtype)
    for i in range(0, len(table), tile):
        out[:, i : i + tile] = table[i : i + tile].T
    return out


def _leaders(context: np.ndarray, symbol: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The commonest symbol after each context, the second commonest, and the class of the first's share."""
    bits = 32 - max(1, contexts - 1).bit_length()
    if int(symbol.max(initial=0)) >> bits:
        key, bits = context.astype(np.uint64) << np.uint64(32) | symbol, 32
    else:
        key = context << np.uint32(bits) | symbol
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(key)]]))
    of, what = (key[first] >> key.dtype.type(bits)).astype(np.int64), (key[first] & key.dtype.type((1 << bits) - 1)).astype(np.uint32)
    best, second, sure = np.zeros(contexts, np.uint32), np.ones(contexts, np.uint32), np.zeros(contexts, np.uint8)
    if not len(key):
        return best, second, sure
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    total, of = np.add.reduceat(n, head), of[head]
    # the largest count, the smallest symbol if several have it: places count down below the counts
    places = np.int64((1 << 23) - 1)
    n = n << 23 | places - np.arange(len(n))
    top = np.maximum.reduceat(n, head)
    at = places - (top & places)
    best[of] = what[at]
    second[best == 1] = 0
    n[at] = 0
    next_top = np.maximum.reduceat(n, head)
    more = next_top > 0
    second[of[more]] = what[places - (next_top[more] & places)]
    sure[of] = np.minimum(CLASSES * ((top >> 23) - 0.5) / (total + 1), CLASSES - 1).astype(np.uint8)
    return best, second, sure


class Predictions:
    """What a segment knows of its ids before any block: symbols, order-0 frequencies, what order 1 and order 2 name, first weights."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, one: np.ndarray, sure1: np.ndarray, two: np.ndarray, sure2: np.ndarray, weights: np.ndarray):
        self.ids, self.freq, self.one, self.sure1, self.two, self.sure2, self.weights = ids, freq, one, sure1, two, sure2, weights
        self.bits, self.slot_bits = int(freq.sum()).bit_length() - 1, len(two).bit_length() - 1
        self.upto = np.cumsum(freq) - freq
        # what the steps look up, side by side; a class stands above its symbol, which has SYMBOL_BITS at most
        self.place = self.upto + 1j * freq
        shift = np.uint64(SYMBOL_BITS)
        self.of_one = one[:, 0].astype(np.uint64) | sure1.astype(np.uint64) << shift | one[:, 1].astype(np.uint64) << np.uint64(32)
        self.of_two = two.astype(np.uint32) | sure2.astype(np.uint32) << np.uint32(SYMBOL_BITS)

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> tuple[Predictions, np.ndarray]:
        """Of a segment's ids, and their symbols. The weights are still to be set."""
        if int(ids.max(initial=0)) < 1 << 20:
            count = np.bincount(ids)
            known = np.flatnonzero(count)
            order = np.argsort(-count[known], kind="stable")
            known = known[order]
            count, place = count[known], np.zeros(len(count), np.uint32)
            place[known] = np.arange(len(known))
            symbols = place[ids]
        else:
            known, back, count = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(known), np.uint32)
            rank[order] = np.arange(len(known))
            known, count, symbols = known[order], count[order], rank[back]
        m, n = len(known), len(ids)
        bits = max(15, m.bit_length() + 2)
        freq = 1 + count * ((1 << bits) - m) // max(1, n)
        freq[0] += (1 << bits) - freq.sum()
        slot_bits = max(6, min(SLOT_BITS, n.bit_length() - 7))
        before, before_that = _history(symbols, block)
        one = _leaders(before, symbols, m)
        two = _leaders(_slot(before, before_that, slot_bits), symbols, 1 << slot_bits)
        return cls(known.astype(np.uint32), freq.astype(np.float64), np.stack(one[:2], axis=1), one[2], two[0], two[2], np.zeros((CLASSES**2, 2), np.int32)), symbols

    def named(self, before: np.ndarray, before_that: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first symbol that is named, the second, and the pair of classes. Where order 2 is less sure than order 1, both are order 1's; elsewhere order 2's is first."""
        two, ones = self.of_two.take(_slot(before, before_that, self.slot_bits)), self.of_one.take(before).view(np.uint32)
        one, second = ones[::2], ones[1::2]
        class2, class1 = two >> np.uint32(SYMBOL_BITS), one >> np.uint32(SYMBOL_BITS)
        one = one & np.uint32((1 << SYMBOL_BITS) - 1)
        two &= np.uint32((1 << SYMBOL_BITS) - 1)
        two = np.where(class2 < class1, one, two)
        class2 <<= np.uint32(CLASS_BITS)
        class2 += class1
        return two, np.where(one == two, second, one), class2

    def kinds(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lanes: steps x lanes symbols. 0 where the first that is named is right, 1 where the second is, else 2; and the pair of classes. Sets the weights."""
        kinds, contexts = np.empty(lanes.shape, np.int8), np.empty(lanes.shape, np.int8)
        steps, width = lanes.shape
        seen = np.zeros(3 * CLASSES**2, np.int64)
        rows, padded = max(1, ROWS_OF // width), np.concatenate([np.zeros((2, width), np.uint32), lanes])
        for t in range(0, steps, rows):
            end = min(t + rows, steps)
            before_that, before, x = (padded[t + k : end + k].reshape(-1) for k in range(3))
            two, one, context = self.named(before, before_that)
            miss = x != two
            kind = np.add(miss, miss & (x != one), dtype=np.int8)
            kinds[t:end], contexts[t:end] = kind.reshape(-1, width), context.reshape(-1, width)
            context *= np.uint32(3)
            context += kind.view(np.uint8)
            seen += np.bincount(context, minlength=len(seen))
        share = seen.reshape(-1, 3) + (0.3, 0.3, 1.0)
        self.weights[:] = np.floor(FULL * share[:, :2] / share.sum(1, keepdims=True))
        return kinds, contexts

    def dump(self) -> bytes:
        wide = np.uint16 if len(self.ids) <= 1 << 16 else np.uint32
        parts = [self.ids.astype("<u4"), self.freq.astype("<u4"), self.one.T.astype(wide), self.sure1, self.two.astype(wide), self.sure2, self.weights.astype("<u2")]
        raw = zlib.compress(b"".join(np.ascontiguousarray(p).tobytes() for p in parts), 1)
        return struct.pack("<III", len(self.ids), self.slot_bits, len(raw)) + raw

    @classmethod
    def load(cls, data: bytes, at: int) -> Predictions:
        m, slot_bits, size = struct.unpack_from("<III", data, at)
        raw = zlib.decompress(data[at + 12 : at + 12 + size])
        wide, place, got, slots = np.dtype(np.uint16 if m <= 1 << 16 else np.uint32), 0, [], 1 << slot_bits
        for kind, n in ((np.dtype("<u4"), m), (np.dtype("<u4"), m), (wide, 2 * m), (np.dtype("u1"), m), (wide, slots), (np.dtype("u1"), slots), (np.dtype("<u2"), 2 * CLASSES**2)):
            got.append(np.frombuffer(raw, kind, n, place))
            place += n * kind.itemsize
        ids, freq, one, sure1, two, sure2, weights = got
        return cls(ids, freq.astype(np.float64), one.reshape(2, m).T.astype(np.uint32), sure1, two, sure2, weights.reshape(-1, 2).astype(np.int32))


def _history(symbols: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each and the one before that; symbol 0 where a block begins."""
    before, before_that = np.zeros(len(symbols), np.uint32), np.zeros(len(symbols), np.uint32)
    before[1:], before_that[2:] = symbols[:-1], symbols[:-2]
    before[::block] = before_that[::block] = before_that[1::block] = 0
    return before, before_that


class Weights:
    """The adaptive weights of the lanes: for each pair of classes, order 2's and order 1's share, counted to FULL. Lanes of a pair lie side by side."""

    def __init__(self, lanes: int, first: np.ndarray):
        self.table = np.repeat(np.ascontiguousarray(first, np.int32).view(np.int64).reshape(-1), lanes)
        self.base, self.lanes = np.arange(lanes, dtype=np.int64), np.int64(lanes)
        self.goal = np.array([[FULL, 0], [0, FULL], [0, 0]], np.int32).view(np.int64).reshape(-1)

    def shares(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both shares of 1 << WEIGHT_BITS: at least 1 each, and something is left for order 0."""
        self.cell = context * self.lanes
        self.cell += self.base
        self.held = self.table.take(self.cell).view(np.int32)
        share = (self.held >> 4) - (self.held >> 9) + 1
        return share[::2].astype(np.float64), share[1::2].astype(np.float64)

    def learn(self, kind: np.ndarray) -> None:
        held = self.held
        held += (self.goal.take(kind).view(np.int32) - held) >> RATE
        self.table[self.cell] = held.view(np.int64)


def _parts(size: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges: what order 2 gets, what both orders get, and the unit of the rest, a whole number of which order 0 has."""
    unit = np.floor(size * 2.0**-WEIGHT_BITS)
    a *= unit
    b *= unit
    b += a
    unit *= 2.0**WEIGHT_BITS
    unit -= b
    unit *= 2.0**-bits
    return a, b, np.floor(unit, out=unit)


def _encode_lanes(symbols: np.ndarray, kinds: np.ndarray, contexts: np.ndarray, known: Predictions) -> tuple[np.ndarray, np.ndarray]:
    """All of them steps x lanes. The lanes' words, lane after lane, and how many each has."""
    steps, lanes = symbols.shape
    weights = Weights(lanes, known.weights)
    low, size = np.zeros(lanes), np.full(lanes, _WHOLE)
    words, sent = [], []
    for t in range(steps):
        kind = kinds[t]
        a, b, each = _parts(size, *weights.shares(contexts[t]), known.bits)
        weights.learn(kind)
        one, rest, place = kind == 1, kind == 2, known.place.take(symbols[t])
        low += np.where(rest, b + each * place.real, np.where(one, a, 0.0))
        size = np.where(rest, each * place.imag, np.where(one, b - a, a))
        short = size < _LEAST
        while short.any():
            high = np.floor(low * (1 / _LEAST))
            words.append(high.astype(np.uint32))
            sent.append(short)
            low = np.where(short, (low - high * _LEAST) * _WORD, low)
            size = np.where(short, size * _WORD, size)
            short = size < _LEAST
    words.append(np.ceil(low * (1 / _LEAST)).astype(np.uint32))  # a value within the range whose other words are zero
    sent.append(np.ones(lanes, bool))
    on = np.stack(sent)
    out = _turned(np.stack(words))[_turned(on)]
    while len(over := np.flatnonzero(out >> np.uint32(16))):
        out[over] &= np.uint32(0xFFFF)
        out[over - 1] += np.uint32(1)
    return out, on.sum(0)


def _decode_lanes(words: np.ndarray, starts: np.ndarray, steps: int, known: Predictions) -> np.ndarray:
    """words of all lanes side by side, where each lane's start: steps x lanes symbols."""
    lanes = len(starts)
    weights = Weights(lanes, known.weights)
    symbol_at = np.repeat(np.arange(len(known.freq), dtype=np.uint16 if len(known.freq) <= 1 << 16 else np.uint32), known.freq.astype(np.int64))
    pos = starts.astype(np.int64)
    code = np.zeros(lanes)  # how far the coded value is above the range's start
    for _ in range(3):
        code = code * _WORD + words[pos]
        pos += 1
    size = np.full(lanes, _WHOLE)
    out = np.zeros((steps, lanes), np.uint32)
    before = before_that = np.zeros(lanes, np.uint32)
    for t in range(steps):
        two, one, context = known.named(before, before_that)
        a, b, each = _parts(size, *weights.shares(context), known.bits)
        late, rest = code >= a, code >= b
        weights.learn(late.astype(np.int8) + rest)
        left = code - b
        x = symbol_at.take((left / each).astype(np.int64), mode="clip")
        place = known.place.take(x)
        value = np.where(rest, x, np.where(late, one, two))
        code = np.where(rest, left - each * place.real, np.where(late, code - a, code))
        size = np.where(rest, each * place.imag, np.where(late, b - a, a))
        short = size < _LEAST
        while short.any():
            code = np.where(short, code * _WORD + words.take(pos), code)
            size = np.where(short, size * _WORD, size)
            pos += short
            short = size < _LEAST
        out[t] = value
        before_that, before = before, value
    return out


def encode(ids: np.ndarray) -> bytes:
    """ids of up to 32 bits, of any number, as a chunk: its segments, each with predictions, and its blocks' sizes, checksums and words."""
    ids = np.ascontiguousarray(ids, "<u4")
    parts = [MAGIC, struct.pack("<Q", len(ids))]
    size = -(-len(ids) // max(1, -(-len(ids) // (SEGMENT + SEGMENT // 8))))
    for i in range(0, len(ids), size or 1):
        parts += _segment(ids[i : i + size])
    return b"".join(parts)


def _segment(ids: np.ndarray) -> list[bytes]:
    n = len(ids)
    block = max(SHORTEST, -(-n // LANES))
    blocks = -(-n // block)
    sums = [zlib.crc32(ids[i * block : (i + 1) * block]) for i in range(blocks)]
    known, symbols = Predictions.of(ids, block)
    padded = np.zeros(blocks * block, np.uint32)
    padded[:n] = symbols
    lanes = _turned(padded.reshape(blocks, block))
    words, used = _encode_lanes(lanes, *known.kinds(lanes), known)
    table = struct.pack("<III", n, block, blocks) + used.astype("<u4").tobytes() + np.array(sums, "<u4").tobytes() + known.dump()
    return [struct.pack("<II", len(table), zlib.crc32(table)), table, words.astype("<u2").tobytes()]


def decode(data: bytes) -> np.ndarray:
    """The ids of a chunk; one that is cut short, or a block whose checksum differs, raises ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of coded ids")
    try:
        (total,) = struct.unpack_from("<Q", data, 4)
        at, parts = 12, []
        while sum(map(len, parts)) < total:
            ids, at = _read_segment(data, at)
            parts.append(ids)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError("a chunk of coded ids is damaged") from e
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _read_segment(data: bytes, at: int) -> tuple[np.ndarray, int]:
    length, check = struct.unpack_from("<II", data, at)
    table = data[at + 8 : at + 8 + length]
    if zlib.crc32(table) != check:
        raise ValueError("a segment's table does not match its checksum")
    n, block, blocks = struct.unpack_from("<III", table)
    size = np.frombuffer(table, "<u4", blocks, 12).astype(np.int64)
    sums = np.frombuffer(table, "<u4", blocks, 12 + 4 * blocks)
    known, at = Predictions.load(table, 12 + 8 * blocks), at + 8 + length
    words = _after_ends(np.frombuffer(data, "<u2", int(size.sum()), at), size)
    symbols = _decode_lanes(words, np.cumsum(size + 3) - size - 3, block, known)
    ids = known.ids.astype("<u4").take(_turned(symbols).reshape(-1)[:n])
    for i in range(blocks):
        if zlib.crc32(ids[i * block : (i + 1) * block]) != sums[i]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids, at + 2 * int(size.sum())


def _after_ends(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words with three of zero after each lane's, which the decoder reads beyond its end."""
    out = np.zeros(len(words) + 3 * len(size) + 4, np.uint16)
    ends = np.cumsum(size)
    for i, (start, end) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
        out[start + 3 * i : end + 3 * i] = words[start:end]
    return out
