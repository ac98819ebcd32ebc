"""An adaptive context-mixing range coder for token ids.

A block holds up to ``BLOCK`` ids, starts from a model of its own and carries a CRC-32 of
its ids, so any block decodes alone.  Within a block an id is predicted by

* order 2: the likeliest id after the two before it (a hashed table with confidences),
* order 1: the likeliest id after the one before it,
* order 0: the counts of the block's ids so far, from a start that the header tells (of
  each id the number of bits of its count).

An id is coded in two parts.  The first tells which order foresaw it: the order-2
candidate, the order-1 candidate or neither.  The chance of each candidate mixes three
adaptive estimates in the logistic domain (by order-2 confidence, by order-1 confidence
and agreement, by both with the candidate's order-0 class) with weights that learn from
their errors.  The second part, where neither did, is the id's place among the order-0
frequencies, from which both failed candidates are taken out.

A block is dealt to up to ``LANES`` lanes, each a run of neighbouring ids with a range
coder (64-bit state, 32-bit words, carries) of its own.  One numpy operation advances all
lanes by one id, and all lanes share one model, which learns at the end of each epoch (1
step at first, ``EPOCH`` later) from the ids that both sides know by then.  Only integers
are used, so any machine decodes what any other wrote.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK, LANES, STEPS, EPOCH = 1 << 20, 4096, 64, 32
SLOTS = 16  # bits of the order-2 table's size
LEVELS, BUCKETS = 8, 8  # confidences of a candidate, classes of its order-0 frequency
STATES = LEVELS * LEVELS * 2 * BUCKETS
FIRST, SECOND = 12, 18  # bits of the two parts' frequencies
NONE, ONE = 1 << 16, 1 << 17  # no candidate; one level of confidence
I32, I64, U32, U64 = np.int32, np.int64, np.uint32, np.uint64
FULL, WORD = U64(1) << U64(32), U64(32)
#: Logistic curve for -2047 to 2047 in steps of 1/256, as chances of 4096; and the least argument that reaches each chance.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], I64)
STRETCH = np.searchsorted(SQUASH, np.arange(4096)).clip(0, 4094) - 2047
_STATE = np.arange(STATES)
#: The parts of a state: order-2 confidence, order-1 confidence with agreement, all.
PARTS = (_STATE // (STATES // LEVELS), _STATE // BUCKETS % (2 * LEVELS), _STATE)
HAS2 = PARTS[0] > 0
HAS1 = (PARTS[1] > 1) & (PARTS[1] & 1 == 0)
#: What a candidate's entry gains when it hits, by confidence; what it loses when it fails (its place, at 1 or less).
GAIN = np.array([ONE * (n + 1 < LEVELS) for n in range(LEVELS)], I32)
LOSS = np.array([ONE * (n + 1 >> 1) for n in range(LEVELS)], I32)


def shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``n`` ids."""
    lanes = min(LANES, max(1, n // STEPS))
    return lanes, -(-n // lanes)


def epochs(steps: int) -> list[tuple[int, int]]:
    ends = [e for e in (1, 2, 4, 8, 16) if e < steps] + list(range(EPOCH, steps, EPOCH)) + [steps]
    return list(zip([0, *ends], ends))


class Chance:
    """The chance of a hit in each state: three adaptive estimates, mixed in the logistic domain."""

    def __init__(self):
        self.hits = [np.full(p.max() + 1, 1, I64) for p in PARTS]
        self.seen = [np.full(p.max() + 1, 3, I64) for p in PARTS]
        self.w = [20_000, 20_000, 40_000]  # of 65,536
        self.mix()

    def mix(self) -> None:
        self.st = [STRETCH[np.clip((h << 12) // n, 1, 4095)][p] for h, n, p in zip(self.hits, self.seen, PARTS)]
        self.p = SQUASH[np.clip(sum(w * s for w, s in zip(self.w, self.st)) >> 16, -2047, 2047) + 2047]

    def learn(self, seen: np.ndarray, hits: np.ndarray) -> None:
        """Adapt to how often each state came and hit."""
        n = int(seen.sum())
        if n:
            err = (hits << 12) - seen * self.p
            self.w = [min(1 << 17, max(-(1 << 15), w + int((err * s).sum()) // n // 64)) for w, s in zip(self.w, self.st)]
        for k, p in enumerate(PARTS):
            self.hits[k] += np.bincount(p, hits, len(self.hits[k])).astype(I64)
            self.seen[k] += np.bincount(p, seen, len(self.seen[k])).astype(I64)
        self.mix()


class Model:
    """The adaptive state of a block; frozen within an epoch.

    ``sizes``: bits of the count of each of the block's ids, which go by their rank in it.
    """

    def __init__(self, sizes: np.ndarray):
        self.n = len(sizes)
        self.t1, self.t2 = np.full(self.n + 1, NONE, I32), np.full(1 << SLOTS, NONE, I32)
        self.second, self.first = Chance(), Chance()
        self.counts = (3 << sizes.astype(I64)) >> 1  # between the least and the greatest such count, twice
        self.freeze()

    def freeze(self) -> None:
        """What an epoch codes with: frequencies of the first part by state and outcome, and order-0 places."""
        a = np.where(HAS2, np.maximum(self.second.p * 4000 >> 12, 1), 0)
        b = np.where(HAS1, np.maximum(self.first.p * (4000 - a) >> 12, 1), 0)
        self.freq = np.stack([a, b, 4096 - a - b], axis=1).ravel().astype(U64)
        self.start = np.stack([a * 0, a, a + b], axis=1).ravel().astype(U64)
        self.ends = a.astype(U64), (a + b).astype(U64)
        total = int(self.counts.sum())
        freq = self.counts * ((1 << SECOND) - self.n) // total + 1
        freq[0] += (1 << SECOND) - int(freq.sum())
        self.count = np.zeros(NONE + 1, I32)  # no candidate: nothing to take out
        self.cum = np.zeros(NONE + 1, I32)
        self.count[: self.n] = freq
        self.cum[: self.n] = np.cumsum(freq) - freq
        self.bucket = np.zeros(NONE + 1, I32)
        self.bucket[: self.n] = np.searchsorted([2, 6, 20, 60, 200, 600, 2000], freq, side="right")

    def inverse(self) -> np.ndarray:
        """For decoding: the id at each order-0 place."""
        return np.repeat(np.arange(self.n, dtype=np.uint16), self.count[: self.n])

    def predict(self, a: np.ndarray, b: np.ndarray):
        """State, table entries and candidates, the order-2 slot, after ids ``b`` then ``a``."""
        slot = (a * I32(0x1E3779B1) + b * I32(0x05EBCA6B)) * I32(0x42B2AE35) >> I32(32 - SLOTS) & I32((1 << SLOTS) - 1)
        e2, e1 = self.t2.take(slot, mode="clip"), self.t1.take(a, mode="clip")
        c2, c1 = e2 & I32(ONE - 1), e1 & I32(ONE - 1)
        state = (e2 >> I32(17)) << I32(3)
        state |= e1 >> I32(17)
        state <<= I32(1)
        state |= c1 == c2
        state <<= I32(3)
        state |= self.bucket.take(np.minimum(c1, c2), mode="clip")
        return state, e2, e1, c2, c1, slot

    def exclude(self, c2: np.ndarray, c1: np.ndarray):
        """The places of both candidates, the lower first, and their frequencies."""
        lo, hi = np.minimum(c2, c1), np.maximum(c2, c1)
        return self.cum.take(lo, mode="clip"), self.cum.take(hi, mode="clip"), self.count.take(lo, mode="clip"), self.count.take(hi, mode="clip") * (lo != hi)

    def learn(self, x, a, state, e2, e1, c2, c1, slot) -> None:
        """Adapt to ids ``x`` that followed ``a`` (flat, in step order)."""
        hit2, hit1 = x == c2, x == c1
        outcome = np.where(hit2, I32(0), I32(2) - hit1)
        by = np.bincount(state * I32(3) + outcome, minlength=3 * STATES).reshape(STATES, 3)
        self.second.learn(by.sum(axis=1) * HAS2, by[:, 0] * HAS2)
        self.first.learn((by[:, 1] + by[:, 2]) * HAS1, by[:, 1] * HAS1)
        self.counts += np.bincount(x, minlength=self.n) << 1
        fresh = x + I32(ONE)
        for table, at, e, hit in ((self.t2, slot, e2, hit2), (self.t1, a, e1, hit1)):
            n = e >> I32(17)
            table[at] = np.where(hit, e + GAIN.take(n), np.where(n > 1, e - LOSS.take(n), fresh))
        self.freeze()


def _alphabet(sizes: np.ndarray) -> np.ndarray:
    """The block's ids by rank, the most frequent sizes first."""
    present = np.flatnonzero(sizes)
    return present[np.argsort(-sizes[present].astype(I64), kind="stable")]


def encode(ids: np.ndarray) -> bytes:
    """The payload of one block of 1 to BLOCK ids below 65,536."""
    n = len(ids)
    lanes, steps = shape(n)
    sizes = np.frexp(np.bincount(ids, minlength=1 << 16).astype(np.float64))[1].astype(np.uint8)  # bits of each count
    letters = _alphabet(sizes)
    rank = np.zeros(1 << 16, I32)
    rank[letters] = np.arange(len(letters))
    grid = np.zeros((lanes, steps), I32)
    grid.ravel()[:n] = rank[ids]
    grid = np.concatenate([np.zeros((2, lanes), I32), grid.T])  # two steps before the first
    active = -(-(n - np.arange(steps)) // steps)  # the first lanes still have an id at a step
    words, sent, carried = np.zeros((steps, lanes), U32), np.zeros((steps, lanes), bool), np.zeros((steps, lanes), bool)
    low, rng = np.zeros(lanes, U64), np.full(lanes, ~U64(0))
    model, lane = Model(sizes[letters]), np.arange(lanes)
    for begin, end in epochs(steps):
        x, a, b = grid[begin + 2 : end + 2], grid[begin + 1 : end + 1], grid[begin:end]
        how = model.predict(a, b)
        state, _, _, c2, c1, _ = how
        outcome = np.where(x == c2, I32(0), I32(2) - (x == c1))
        miss = outcome == 2
        cum2, cum1, y2, y1 = model.exclude(c2, c1)
        start = model.cum.take(x, mode="clip")
        start = ((start - y2 * (cum2 < start) - y1 * (cum1 < start)) * miss).astype(U64)
        freq, total = np.where(miss, model.count.take(x, mode="clip"), 1).astype(U64), np.where(miss, (1 << SECOND) - y2 - y1, 1).astype(U64)
        which = state * I32(3) + outcome
        start1, freq1 = model.start.take(which, mode="clip"), model.freq.take(which, mode="clip")
        for k in range(end - begin):
            t = begin + k
            m = int(active[t])
            lo, rg = low[:m], rng[:m]
            r = rg >> U64(FIRST)
            more = r * start1[k, :m]
            r *= freq1[k, :m]
            r //= total[k, :m]
            more += r * start[k, :m]
            lo += more
            np.less(lo, more, out=carried[t, :m])
            np.multiply(r, freq[k, :m], out=rg)
            small = np.less(rg, FULL, out=sent[t, :m])
            words[t, :m] = lo >> WORD
            shift = small.astype(U64) << U64(5)
            lo <<= shift
            rg <<= shift
        known = None if n == lanes * steps else (lane * steps + np.arange(begin, end)[:, None] < n).ravel()
        model.learn(*(v.ravel() if known is None else v.ravel()[known] for v in (x, a, *how)))
    before = low.copy()
    low += FULL - U64(1)  # a word that lies within the range; all further ones are zero
    kept, flat = sent.T, words.T
    made = flat[kept].astype(I64)  # lane after lane
    size = kept.sum(axis=1)
    first = np.cumsum(size) - size
    t, at = np.nonzero(carried)
    prior = np.cumsum(sent, axis=0, dtype=np.int16)[t, at].astype(I64) - sent[t, at] - 1
    last = np.flatnonzero(low < before)
    np.add.at(made, first[at] + prior, 1)
    np.add.at(made, (first + size)[last] - 1, 1)
    while (over := np.flatnonzero(made >> 32)).size:
        made[over] -= 1 << 32
        np.add.at(made, over - 1, 1)
    body = np.insert(made, first + size, (low >> WORD).astype(I64))
    head = zlib.compress(sizes.tobytes(), 6)
    return len(head).to_bytes(4, "little") + head + (size + 1).astype("<u2").tobytes() + body.astype("<u4").tobytes()


def decode(payload: bytes, n: int) -> np.ndarray:
    """The ids of a block from its payload and length."""
    lanes, steps = shape(n)
    head = 4 + int.from_bytes(payload[:4], "little")
    sizes = np.frombuffer(zlib.decompress(payload[4:head]), np.uint8)
    letters = _alphabet(sizes)
    long = np.frombuffer(payload, "<u2", lanes, head).astype(I64)
    words = np.frombuffer(payload[head + 2 * lanes :] + bytes(8), "<u4").astype(U64)
    stop, nothing = np.cumsum(long), len(words) - 1  # beyond a lane's end come zeros
    place = stop - long
    code = words[place] << WORD | np.where(long > 1, words[place + 1], U64(0))
    place += 2
    active = -(-(n - np.arange(steps)) // steps)
    grid = np.zeros((steps + 2, lanes), I32)
    rng, model, lane = np.full(lanes, ~U64(0)), Model(sizes[letters]), np.arange(lanes)
    for begin, end in epochs(steps):
        inverse, hows = model.inverse(), []
        for t in range(begin, end):
            m = int(active[t])
            how = model.predict(grid[t + 1], grid[t])
            hows.append(how)
            state, _, _, c2, c1, _ = (v[:m] for v in how)
            cd, rg = code[:m], rng[:m]
            r = rg >> U64(FIRST)
            v = cd // r
            outcome = (v >= model.ends[0].take(state, mode="clip")).astype(I32)
            outcome += v >= model.ends[1].take(state, mode="clip")
            which = state * I32(3) + outcome
            cd -= r * model.start.take(which, mode="clip")
            r *= model.freq.take(which, mode="clip")
            miss = outcome == 2
            cum2, cum1, y2, y1 = model.exclude(c2, c1)
            r //= np.where(miss, (1 << SECOND) - y2 - y1, 1).astype(U64)
            v = (cd // r).astype(I32) * miss
            at = v + y2 * (v >= cum2)  # step over the candidates that were taken out
            at += y1 * (at >= cum1)
            x = np.where(miss, inverse.take(at, mode="clip"), np.where(outcome == 0, c2, c1)).astype(I32)
            grid[t + 2, :m] = x
            v -= at - model.cum.take(x, mode="clip")
            v *= miss
            cd -= r * v.astype(U64)
            np.multiply(r, np.where(miss, model.count.take(x, mode="clip"), 1).astype(U64), out=rg)
            small = np.flatnonzero(rg < FULL)
            at = place[small]
            cd[small] = cd[small] << WORD | words[np.where(at < stop[small], at, nothing)]
            place[small] = at + 1
            rg[small] <<= WORD
        known = None if n == lanes * steps else (lane * steps + np.arange(begin, end)[:, None] < n).ravel()
        flat = grid[begin + 2 : end + 2], grid[begin + 1 : end + 1], *(np.concatenate(z) for z in zip(*hows))
        model.learn(*(v.ravel() if known is None else v.ravel()[known] for v in flat))
    return letters[np.ascontiguousarray(grid[2:].T).ravel()[:n]].astype("<u2")


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u2").tobytes())
