"""An adaptive context-mixing range coder for token ids, run over many blocks in lockstep.

Every block is a lane of its own: models and coder start anew in each, so blocks can be decoded alone, and numpy takes
one step of all lanes at once. For each id
- order 2 (the two ids before) and order 1 (the id before) each predict an id, with a confidence;
- "it is what order 2 predicts" has a probability that mixes, in the logistic domain with weights learned in the block,
  what both confidences and the block's own count of the predicted id (order 0) say; "if not, it is what order 1
  predicts" likewise. Both make one choice of three, coded in one step;
- an id that neither predicts is coded by order 0, in one step: the frequencies given for its block, by `frequencies` of
  all blocks that lie together, or, where none are given, all ids alike.
All arithmetic is on integers, so a block decodes alike on any machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

T2, T1, T0 = 1 << 12, 1 << 11, 1 << 10
#: Ids below this are counted in an array with a place for each.
COUNTED = 1 << 20
#: The greatest confidence, and contexts of a probability that is mixed.
MOST, CONTEXTS = 7, 16
_FULL = (1 << 64) - 1
_S32, _S16 = np.uint64(32), np.uint64(16)
#: A lane whose range is below this shifts 32 bits.
_LEAST = np.uint64(1 << 32)
_ZERO = np.uint64(0)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int32)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log(max(p, 0.5) / (4096 - max(p, 0.5)))))) for p in range(4096)], np.int32)
_LEVEL = np.array([0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 6, 6, *[7] * 244], np.int64)


class _Writer:
    def __init__(self, lanes: int, most_words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
        self.out, self.at = np.zeros((lanes, most_words), np.uint32), np.zeros(lanes, np.int64)

    def _shift(self, k):
        """What is settled of lanes k goes out."""
        lane_at, low = self.at[k], self.low[k]
        self.out[k, lane_at] = (low >> _S32).astype(np.uint32)
        self.at[k] = lane_at + 1
        self.low[k] = low << _S32
        self.range[k] <<= _S32

    def _carry(self, k):
        """One is added to the words that lanes k have put out."""
        at = self.at[k] - 1
        while len(k):
            self.out[k, at] += np.uint32(1)
            more = self.out[k, at] == 0
            k, at = k[more], at[more] - 1

    def choice(self, m, a, b, k):
        """k: 0, 1 or 2, of probabilities a, b - a and the rest, in 1/65536."""
        rng, low = self.range[:m], self.low[:m]
        r = rng >> _S16
        ra, rb = r * a, r * b
        first, last = k == 0, k == 2
        add = np.where(first, _ZERO, np.where(last, rb, ra))
        np.subtract(np.where(first, ra, np.where(last, rng, rb)), add, out=rng)
        low += add
        over = np.flatnonzero(low < add)
        if len(over):
            self._carry(over)
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            self._shift(small)
        return k

    def symbol(self, on, tables, at):
        """at: the ids' places in the tables."""
        r = self.range[on] >> tables.bits[on]
        add = r * tables.start.take(at)
        low, rng = self.low[on] + add, r * tables.freq.take(at)
        self.low[on], self.range[on] = low, rng
        over = on[low < add]
        if len(over):
            self._carry(over)
        small = on[rng < _LEAST]
        if len(small):
            self._shift(small)

    def bytes(self) -> list[bytes]:
        out = []
        for lane in range(len(self.low)):
            tail = [int(self.low[lane]) >> 32, int(self.low[lane]) & 0xFFFFFFFF]
            out.append(np.r_[self.out[lane, : self.at[lane]], np.array(tail, np.uint32)].astype("<u4").tobytes())
        return out


class _Reader:
    def __init__(self, blocks: list[bytes]):
        lanes = len(blocks)
        self.range = np.full(lanes, _FULL, np.uint64)
        longest = max(len(b) for b in blocks) // 4 + 3
        self.words = np.zeros((lanes, longest), np.uint32)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 4] = np.frombuffer(b[: len(b) // 4 * 4], "<u4")
        #: How far the code lies above the writer's low.
        self.code = (self.words[:, 0].astype(np.uint64) << _S32) | self.words[:, 1]
        self.at = np.full(lanes, 2, np.int64)

    def _shift(self, k):
        at = np.minimum(self.at[k], self.words.shape[1] - 1)
        self.code[k] = (self.code[k] << _S32) | self.words[k, at]
        self.at[k] = at + 1
        self.range[k] <<= _S32

    def choice(self, m, a, b, _):
        rng, code = self.range[:m], self.code[:m]
        r = rng >> _S16
        ra, rb = r * a, r * b
        past, last = code >= ra, code >= rb
        add = np.where(past, np.where(last, rb, ra), _ZERO)
        np.subtract(np.where(past, np.where(last, rng, rb), ra), add, out=rng)
        code -= add
        small = np.flatnonzero(rng < _LEAST)
        if len(small):
            self._shift(small)
        return past.astype(np.int8) + last

    def symbol(self, on, tables, _):
        code = self.code[on]
        r = self.range[on] >> tables.bits[on]
        at = tables.slots.take(tables.slot[on] + np.minimum((code // np.maximum(r, np.uint64(1))).astype(np.int64), tables.last[on]))
        code -= r * tables.start.take(at)
        rng = r * tables.freq.take(at)
        self.code[on], self.range[on] = code, rng
        small = on[rng < _LEAST]
        if len(small):
            self._shift(small)
        return tables.ids.take(at)


def frequencies(ids: np.ndarray) -> bytes:
    """Order 0 for blocks of these ids: the ids that are met and their frequencies, scaled to a power of two at most."""
    if len(ids) and ids.max() < COUNTED:
        n = np.bincount(ids)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(ids, return_counts=True)
    bits = max(16, len(found).bit_length() + 2)
    scaled = 1 + n.astype(np.int64) * ((1 << bits) - len(found)) // max(len(ids), 1)
    return struct.pack("<BI", bits, len(found)) + zlib.compress(np.r_[np.diff(found.astype(np.int64), prepend=0), scaled].astype("<u4").tobytes())


def _parsed(data: bytes | None, nibbles: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, ids, frequencies); without data all ids alike."""
    size = 16**nibbles
    if data is None:
        return 4 * nibbles, np.arange(size), np.ones(size, np.int64)
    bits, n = struct.unpack_from("<BI", data)
    both = np.frombuffer(zlib.decompress(data[5:]), "<u4").astype(np.int64)
    ids, freq = np.cumsum(both[:n]), both[n:]
    if len(both) != 2 * n or (n and (ids[-1] >= size or freq.min() < 1 or freq.sum() > 1 << bits)):
        raise ValueError("frequencies of token ids are damaged, or an id is too large")
    return bits, ids, freq


class _Tables:
    """The frequencies of all lanes, one set after another: whose a place is, where its slots start, how many there are."""

    def __init__(self, given: list[bytes | None], nibbles: int):
        self.kinds = {x: i for i, x in enumerate(dict.fromkeys(given))}
        self.sets = [_parsed(x, nibbles) for x in self.kinds]
        self.kind = np.array([self.kinds[x] for x in given], np.int64)
        firsts = np.cumsum([0] + [len(ids) for _, ids, _ in self.sets])
        self.first, self.bits = firsts[self.kind], np.array([b for b, _, _ in self.sets], np.uint64)[self.kind]
        self.ids = np.concatenate([ids for _, ids, _ in self.sets]).astype(np.int32)
        self.freq = np.concatenate([f for _, _, f in self.sets]).astype(np.uint64)
        self.start = np.concatenate([np.cumsum(f) - f for _, _, f in self.sets]).astype(np.uint64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The place of every id (steps, lanes) in its lane's set."""
        out = np.zeros(ids.shape, np.int32)
        for i, (_, known, _) in enumerate(self.sets):
            lanes = np.flatnonzero(self.kind == i)
            if len(known):
                number = np.zeros(int(known[-1]) + 1, np.int32)
                number[known] = np.arange(len(known))
                out[:, lanes] = number.take(ids[:, lanes], mode="clip") + np.int32(self.first[lanes[0]])
        return out

    def with_slots(self) -> _Tables:
        """For reading: the place that each slot belongs to."""
        sizes = np.array([1 << b for b, _, _ in self.sets])
        self.slots, at = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
        place = 0
        for (_, ids, freq), k in zip(self.sets, at.tolist()):
            self.slots[k : k + int(freq.sum())] = np.repeat(np.arange(place, place + len(ids), dtype=np.int32), freq)
            place += len(ids)
        self.slot, self.last = at[self.kind], (sizes - 1)[self.kind]
        return self


def _bounds(mixed: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the second and third of three choices start, in 1/65536; every choice that is valid, and the third, has a share."""
    share = (np.minimum(np.maximum(mixed << 4, 48), 65536 - 48) * valid).astype(np.uint64)
    a = share[0]
    return a, a + np.maximum((np.uint64(65536) - a) * share[1] >> _S16, valid[1])


def _run(coder, lens: np.ndarray, tables: _Tables, ids: np.ndarray | None) -> np.ndarray:
    """The model, for either direction; lens is in descending order. ids: (steps, lanes) if they are to be written."""
    lanes, steps = len(lens), int(lens[0]) if len(lens) else 0
    out = np.zeros((steps, lanes), np.int32) if ids is None else ids
    places = None if ids is None else tables.places(ids)
    lane = np.arange(lanes)
    # what orders 2 and 1 predict, and how surely: id << 3 | confidence
    predicted = np.zeros(lanes * (T2 + T1), np.int32)
    own = np.stack([lane * T2, lanes * T2 + lane * T1])
    seen, own_seen = np.zeros(lanes * T0, np.uint8), lane * T0
    # for each of three models and two decisions: probabilities of yes by context, and weights by whether orders agree
    chance, weight = np.full(6 * lanes * CONTEXTS, 1 << 15, np.int32), np.full(6 * lanes * 2, (1 << 16) * 2 // 5, np.int32)
    own_chance = (np.arange(6 * lanes) * CONTEXTS).reshape(3, 2, lanes)
    own_weight = (np.arange(6 * lanes) * 2).reshape(3, 2, lanes)
    before, hash2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    live = np.searchsorted(-lens, -np.arange(steps), "left")
    m, context, slot, valid, made, step = -1, None, None, None, None, None
    for t in range(steps):
        if m != live[t]:
            m = int(live[t])
            context, slot, valid = np.empty((3, 2, m), np.int64), np.empty((2, m), np.int64), np.empty((2, m), bool)
            made, step = np.empty((2, m), bool), np.empty((3, 2, m), np.int32)
            at0, at1, atw, ats = own[:, :m], own_chance[:, :, :m], own_weight[:, :, :m], own_seen[:m]
            before, hash2 = before[:m], hash2[:m]
        hash1 = before * 40503
        slot[0] = ((hash1 ^ hash2) >> 3) & (T2 - 1)
        slot[1] = (hash1 >> 4) & (T1 - 1)
        hash2 = before * 60493
        slot += at0
        entry = predicted.take(slot, mode="clip")
        c, f = entry >> 3, entry & 7
        agree = c[0] == c[1]
        np.greater(f, 0, out=valid)
        valid[1] &= ~(agree & valid[0])  # what order 1 predicts is asked if it is anything else
        context[0] = f * 2 + agree
        context[1] = context[0, ::-1]
        context[2] = _LEVEL.take(seen.take(ats + (c & (T0 - 1))))
        context += at1
        p = chance.take(context, mode="clip")
        s = _STRETCH.take(p >> 4, mode="clip")
        at_weight = atw + agree
        w = weight.take(at_weight, mode="clip")
        # weights stay under 2^18 and stretched values under 2^11: three products fit 31 bits
        np.multiply(w, s, out=step)
        total = step[0] + step[1]
        total += step[2]
        total >>= 16
        total += 2047
        mixed = _SQUASH.take(total, mode="clip")
        a, b = _bounds(mixed, valid)
        x = None if ids is None else ids[t, :m]
        k = coder.choice(m, a, b, None if x is None else np.where(valid[0] & (x == c[0]), 0, np.where(valid[1] & (x == c[1]), 1, 2)))
        esc = np.flatnonzero(k == 2)
        if x is None:
            x = np.where(k == 0, c[0], c[1])
            if len(esc):
                x[esc] = coder.symbol(esc, tables, None)
            out[t, :m] = x
        elif len(esc):
            coder.symbol(esc, tables, places[t].take(esc))
        # the decisions that were made are learned from
        np.equal(k, 0, out=made[0])
        np.equal(k, 1, out=made[1])
        valid[1] &= k > 0
        np.subtract(made * np.int32(65535), p, out=step)
        step >>= 4
        step *= valid
        p += step
        chance[context] = p
        s *= (made * np.int32(4095) - mixed) * valid * np.int32(6)
        s += 2048
        s >>= 12
        w += s
        weight[at_weight] = np.clip(w, -(1 << 18), 1 << 18, out=w)
        right = c == x
        kept = f >> 1
        predicted[slot] = np.where(right, entry + (f < MOST), np.where(kept > 0, (entry & -8) | kept, x << 3 | 1))
        i0 = ats + (x & (T0 - 1))
        seen[i0] = np.minimum(seen.take(i0), 254) + 1
        before = x.astype(np.int64)
    return out


def compress(blocks: list[np.ndarray], nibbles: int = 4, order0: list[bytes | None] | None = None) -> list[bytes]:
    """Each block of ids (below 16 ** nibbles) by itself, with its order 0: `frequencies` that hold all its ids, or none."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lens = np.array([len(blocks[i]) for i in order], np.int64)
    if not len(lens) or not lens[0]:
        return [b"\0" * 8 for _ in blocks]
    ids = np.zeros((int(lens[0]), len(blocks)), np.int32)
    for row, i in enumerate(order):
        ids[: len(blocks[i]), row] = blocks[i]
    w = _Writer(len(blocks), int(lens[0]) * 2 + 8)
    _run(w, lens, _Tables([order0[i] if order0 else None for i in order], nibbles), ids)
    out: list[bytes] = [b""] * len(blocks)
    for i, data in zip(order, w.bytes()):
        out[i] = data
    return out


def expand(blocks: list[bytes], lens: list[int], nibbles: int = 4, order0: list[bytes | None] | None = None) -> list[np.ndarray]:
    order = sorted(range(len(blocks)), key=lambda i: -lens[i])
    sizes = np.array([lens[i] for i in order], np.int64)
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, np.uint32) for _ in blocks]
    ids = _run(_Reader([blocks[i] for i in order]), sizes, _Tables([order0[i] if order0 else None for i in order], nibbles).with_slots(), None)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for row, i in enumerate(order):
        out[i] = ids[: lens[i], row].astype(np.uint32)
    return out
