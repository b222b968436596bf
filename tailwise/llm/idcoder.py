"""Context-mixing range coder for token ids, many blocks at a time.

Three models predict each id: the frequencies of a segment's ids (order 0, stored once before the segment's blocks),
the last id seen after the previous id (order 1), and after the previous two (order 2). Their mixture drives the
coder: shares of the interval go to the order-2 id, the order-1 id and the order-0 distribution, by mixing three sets
of adaptive counts, chosen by the confidence of the two contexts and by the last outcome, with weights that follow
how well each has predicted; counts, weights and shares are brought up to date every STRETCH ids, sooner at a block's
start. Within the third share an id has its part of the order-0 distribution, so an id is one
coding step in any case.

A block holds up to BLOCK ids and starts with fresh counts, weights and contexts; it needs the segment's frequencies
and no other block. So all blocks of a segment advance together, one id a step, as NumPy vectors; the arithmetic is
on integers only, so any machine decodes what another has encoded. Ids have up to 32 bits.

Format of a segment, all numbers little-endian: "TWF3", number of distinct ids (4 bytes), bits of a frequency
(4 bytes), CRC-32 of the table (4 bytes), the ids in order (4 bytes each), their frequencies (4 bytes each), both
compressed by zlib after their length (4 bytes); then the blocks. A block: "TWB3", number of ids (4 bytes), CRC-32 of
the ids (4 bytes), length of the coded bytes (4 bytes), coded bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
TABLE, MAGIC = b"TWF3", b"TWB3"
#: Bits of an order-0 frequency at least, bits of an outcome's share at most, and slots of a block's contexts.
LEAST_BITS, SHARE_BITS, SLOTS = 18, 12, 2048
#: Of both together: the coder's range has 32 bits or more.
BITS = 32
ORDER2, ORDER1, ORDER0 = range(3)
#: Last outcome and confidences of two contexts; counts of a state at most; steps between two mixtures.
STATES, MOST_SEEN, STRETCH = 48, 2048, 128
HALF = np.uint64(32)
LOW_HALF = np.uint64((1 << 32) - 1)
U, I, J = np.uint64, np.int64, np.int32


class Prior:
    """Order-0 frequencies of a segment; ids are known by their places in it."""

    def __init__(self, values: np.ndarray, freq: np.ndarray, bits: int):
        self.values, self.freq, self.bits = values, freq, bits
        self.start = np.concatenate((np.zeros(1, I), np.cumsum(freq)))
        self.share_bits = min(SHARE_BITS, BITS - bits)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray]:
        """The table of these ids, and their places in it."""
        if ids.max() < 1 << 22:  # counted without sorting
            count = np.bincount(ids)
            values = np.flatnonzero(count)
            place = np.zeros(len(count), J)
            place[values] = np.arange(len(values))
            count, places = count[values], place[ids]
        else:
            values, count = np.unique(ids.astype(I), return_counts=True)
            places = np.searchsorted(values, ids).astype(J)
        bits = max(LEAST_BITS, len(values).bit_length() + 1)
        freq = 1 + count * ((1 << bits) - len(values)) // count.sum()
        freq[np.argmax(freq)] += (1 << bits) - freq.sum()
        return cls(values, freq, bits), places

    def pack(self) -> bytes:
        raw = self.values.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        body = zlib.compress(raw)
        return TABLE + struct.pack("<IIII", len(self.values), self.bits, zlib.crc32(raw), len(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Prior, int]:
        """The table at the start of a segment, and where its blocks begin."""
        if len(data) < 20 or data[:4] != TABLE:
            raise ValueError("not a segment of ids")
        n, bits, crc, size = struct.unpack("<IIII", data[4:20])
        try:
            raw = zlib.decompress(data[20 : 20 + size])
        except zlib.error as e:
            raise ValueError("a segment's table is damaged") from e
        if zlib.crc32(raw) != crc or len(raw) != 8 * n:
            raise ValueError("a segment's table has a wrong checksum")
        return cls(np.frombuffer(raw, "<u4", n).astype(I), np.frombuffer(raw, "<u4", offset=4 * n).astype(I), bits), 20 + size

    def places(self) -> np.ndarray:
        """Which id's part of the distribution holds each of its 2**bits places."""
        return np.repeat(np.arange(len(self.values), dtype=J), self.freq)


class Model:
    """Contexts and adaptive counts of each lane. Ids are places in the prior.

    An entry of a context is id * 4 + confidence. A state is the last outcome and the two confidences; shares holds where
    the order-1 and the order-0 share of each state and lane begin, 16 bits each, until the next call of learn."""

    def __init__(self, lanes: int, share_bits: int, n_ids: int):
        self.lanes, self.top = lanes, 1 << share_bits
        self.kind = np.uint16 if n_ids <= 1 << 14 else np.uint32
        self.after = np.zeros(2 * lanes * SLOTS, self.kind)
        self.base = (np.arange(2 * lanes) * SLOTS).reshape(2, lanes)
        # Outcome, state of the set, lane. The third set is of the last outcomes, the others of the confidences.
        self.seen = [np.ones((3, m, lanes), J) for m in (4, 4, 3)]
        self.weight = np.full((3, lanes), 8, J)
        self._mix()

    def slots(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Places of the entries after these ids, for orders 1 and 2."""
        hashed = ids * J(40_503)
        out = np.empty((*ids.shape[:-1], 2, ids.shape[-1]), I)
        np.add((hashed >> 4) & J(SLOTS - 1), self.base[0], out=out[..., 0, :])
        np.add(((hashed ^ (before * J(25_717))) >> 3) & J(SLOTS - 1), self.base[1], out=out[..., 1, :])
        return out

    def enter(self, slots: np.ndarray, entries: np.ndarray, ids4: np.ndarray) -> None:
        """Ids (times 4) follow the contexts of these entries."""
        new = entries ^ ids4  # the confidence where the guess was right
        right = new < 4
        np.minimum(new, 2, out=new)
        new += 1
        new *= right
        new += ids4
        self.after[slots] = new

    def learn(self, log: np.ndarray) -> None:
        """Take in outcomes, each as (outcome * STATES + state) * lanes + lane, and mix the shares anew."""
        found = np.bincount(log.ravel(), minlength=3 * STATES * self.lanes).astype(J).reshape(3, 3, 4, 4, self.lanes)
        both = found.sum(axis=1, dtype=J)
        for k, own in enumerate((both.sum(axis=2, dtype=J), both.sum(axis=1, dtype=J), found.sum(axis=(2, 3), dtype=J))):
            seen = self.seen[k]
            right = np.where(seen * 2 > seen.sum(axis=0, dtype=J), own, -own).sum(axis=(0, 1), dtype=J)
            self.weight[k] = np.clip(self.weight[k] + (right >> 2), 1, 24)
            seen += own * J(8)
            np.copyto(seen, (seen >> 1) | 1, where=seen.sum(axis=0, dtype=J) > MOST_SEEN)
        self._mix()

    def _mix(self) -> None:
        one, two, last = (seen * w for seen, w in zip(self.seen, self.weight, strict=True))
        mixed = last[:, :, None, None] + one[:, None, :, None] + two[:, None, None, :]
        total = mixed.sum(axis=0, dtype=J)
        first = mixed[0] * J(self.top - 6) // total + 1
        second = first + mixed[1] * J(self.top - 6) // total + 1
        self.shares = (first | (second << 16)).reshape(-1)


def _stretches(steps: int) -> list[tuple[int, int]]:
    """Steps between two calls of learn: short at first, when little is known."""
    cuts = [0, *(t for t in (8, 16, 32, 64) if t < steps), *range(STRETCH, steps, STRETCH), steps]
    return list(zip(cuts, cuts[1:], strict=False))


class Writer:
    """Vector range coder on 64 bits that moves 32 bits at a time: the range stays at 2**32 or more, and carries go
    into the words already written."""

    def __init__(self, lanes: int, bits: int, steps: int):
        self.bits, self.low, self.range = U(bits), np.zeros(lanes, U), np.full(lanes, ~U(0), U)
        self.room = steps + 2  # a step moves one word at most
        self.words, self.at = np.zeros(lanes * self.room, np.uint32), np.arange(lanes) * self.room

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        low, rng = self.low[:n], self.range[:n]
        rng >>= self.bits
        add = rng * start
        low += add
        rng *= size
        carry, back = np.flatnonzero(low < add), 1
        while len(carry):
            at = self.at[carry] - back
            more = self.words[at] + np.uint32(1)
            self.words[at] = more
            carry, back = carry[more == 0], back + 1
        todo = np.flatnonzero(rng <= LOW_HALF)
        at, lo = self.at[todo], low[todo]
        self.words[at] = lo >> HALF
        self.at[todo] = at + 1
        low[todo] = lo << HALF
        rng[todo] <<= HALF

    def finish(self) -> list[bytes]:
        for part in (self.low >> HALF, self.low & LOW_HALF):
            self.words[self.at] = part
            self.at += 1
        return [self.words[k * self.room : end].astype("<u4").tobytes() for k, end in enumerate(self.at.tolist())]


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A table of frequencies and the blocks of ids, in order. The last block may be shorter; no ids, no bytes."""
    ids = np.asarray(ids)
    if not len(ids):
        return b""
    if not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
        raise ValueError("ids are unsigned and have 32 bits at most")
    prior, places = Prior.of(ids)
    block = min(block, len(ids))
    lanes = -(-len(ids) // block)
    last = len(ids) - (lanes - 1) * block
    # The two rows before the first are the contexts of a block's start.
    grid = np.zeros((block + 2, lanes), J)
    grid[2:, : lanes - 1] = places[: len(ids) - last].reshape(lanes - 1, block).T
    grid[2 : last + 2, lanes - 1] = places[len(ids) - last :]
    del places
    model, coder, bits = Model(lanes, prior.share_bits, len(prior.values)), Writer(lanes, prior.share_bits + prior.bits, block), prior.bits
    lane, before = np.arange(lanes), np.full((1, lanes), ORDER0)
    for t, end in _stretches(block):
        x = grid[t + 2 : end + 2]
        slots, ids4 = model.slots(grid[t + 1 : end + 1], grid[t:end]), (x << 2).astype(model.kind)
        entries = np.empty(slots.shape, model.kind)
        for k in range(end - t):
            np.take(model.after, slots[k], out=entries[k], mode="clip")
            model.enter(slots[k], entries[k], ids4[k])
        sure = (entries & 3).astype(J)
        guess1, guess2 = (entries[:, k] >> 2 for k in (0, 1))
        what = np.where(x == guess2, ORDER2, np.where(x == guess1, ORDER1, ORDER0))
        state = (np.concatenate((before, what[:-1])) * 16 + (sure[:, 0] * 4 + sure[:, 1])) * lanes + lane
        before = what[-1:]
        shares = model.shares.take(state).astype(I)
        first, second = shares & 0xFFFF, shares >> 16
        rest = model.top - second
        start, size = (second << bits) + prior.start.take(x) * rest, prior.freq.take(x) * rest
        hit = np.nonzero(what != ORDER0)
        one, first, second = what[hit] == ORDER1, first[hit], second[hit]
        start[hit] = np.where(one, first, 0) << bits
        size[hit] = np.where(one, second - first, first) << bits
        start, size = start.view(U), size.view(U)
        for k in range(end - t):
            n = lanes if t + k < last else lanes - 1
            coder.narrow(n, start[k, :n], size[k, :n])
        if end < block:
            model.learn(what * (STATES * lanes) + state)
    out = [prior.pack()]
    for k, body in enumerate(coder.finish()):
        own = ids[k * block : (k + 1) * block].astype("<u4").tobytes()
        out.append(MAGIC + struct.pack("<III", len(own) // 4, zlib.crc32(own), len(body)) + body)
    return b"".join(out)


def split_blocks(data: bytes) -> list[bytes]:
    blocks, at = [], 0
    while at < len(data):
        size = 16 + struct.unpack("<I", data[at + 12 : at + 16])[0] if at + 16 <= len(data) else 16
        blocks.append(data[at : at + size])
        at += size
    return blocks


def decode_blocks(prior: Prior, blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of each block, whichever blocks of a segment these are. A damaged block raises ValueError."""
    if not blocks:
        return []
    heads = []
    for b in blocks:
        if len(b) < 16 or b[:4] != MAGIC:
            raise ValueError("not a block of ids")
        heads.append(struct.unpack("<III", b[4:16]))
        if len(b) != 16 + heads[-1][2] or heads[-1][2] % 4:
            raise ValueError("a block is cut short")
    counts = [h[0] for h in heads]
    lanes, steps, room = len(blocks), max(counts), max(h[2] for h in heads) // 4 + 4
    words = np.zeros((lanes, room), np.uint32)
    for k, b in enumerate(blocks):
        words[k, : heads[k][2] // 4] = np.frombuffer(b, "<u4", offset=16)
    words, at = words.reshape(-1), np.arange(lanes) * room + 2
    left, rng = (words[at - 2].astype(U) << HALF) | words[at - 1], np.full(lanes, ~U(0), U)
    model, bits, top = Model(lanes, prior.share_bits, len(prior.values)), prior.bits, 1 << prior.share_bits
    shift, most, place_of = U(prior.share_bits + bits), (1 << (prior.share_bits + bits)) - 1, prior.places()
    lane, start_state = np.arange(lanes), np.arange(lanes) + ORDER0 * 16 * lanes
    last, entries = start_state, np.empty((2, lanes), model.kind)
    # Lanes go on after their ends; what they find there is left out. The two rows before the first are contexts.
    grid = np.zeros((steps + 2, lanes), J)
    for t, end in _stretches(steps):
        log = np.empty((end - t, lanes), I)
        for k in range(t, end):
            slots = model.slots(grid[k + 1], grid[k])
            np.take(model.after, slots, out=entries, mode="clip")
            sure = entries & 3
            state = (sure[0] * 4 + sure[1]).astype(I) * lanes + last
            shares = model.shares.take(state).astype(I)
            second = shares >> 16
            # Where the code lies in the range.
            rng >>= shift
            place = np.minimum((left // rng).view(I), most)
            rest, begin = top - second, second << bits
            own = place - begin
            x = place_of.take((own / rest).astype(I), mode="clip")  # below 2**53, so the division is exact
            start, size = prior.start.take(x) * rest + begin, prior.freq.take(x) * rest
            last = start_state
            np.add(state, ORDER0 * STATES * lanes, out=log[k - t])
            hit = np.flatnonzero(own < 0)
            if len(hit):
                first, second = shares[hit] & 0xFFFF, second[hit]
                one = (place[hit] >> bits) >= first
                start[hit] = np.where(one, first, 0) << bits
                size[hit] = np.where(one, second - first, first) << bits
                x[hit] = np.where(one, entries[0, hit], entries[1, hit]) >> 2
                last = start_state.copy()
                last[hit] = one * (ORDER1 * 16 * lanes) + lane[hit]
                log[k - t, hit] = state[hit] + one * (ORDER1 * STATES * lanes)
            left -= rng * start.view(U)
            rng *= size.view(U)
            todo = np.flatnonzero(rng <= LOW_HALF)
            own = at[todo]
            left[todo] = (left[todo] << HALF) | words.take(own, mode="clip")
            at[todo] = own + 1
            rng[todo] <<= HALF
            grid[k + 2] = x
            model.enter(slots, entries, (x << 2).astype(model.kind))
        if end < steps:
            model.learn(log)
    out, values = [], prior.values.astype("<u4")
    for k, (n, crc, _) in enumerate(heads):
        ids = values[grid[2 : n + 2, k]]
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        out.append(ids)
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment."""
    if not data:
        return np.zeros(0, "<u4")
    prior, at = Prior.unpack(data)
    return np.concatenate(decode_blocks(prior, split_blocks(data[at:])))
