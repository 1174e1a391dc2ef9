"""Token files: ids in blocks packed by an adaptive context-mixing range coder.

A file holds a run of documents in order of their ids. Its payload: a header (magic, counts, lengths of the
documents, and for each block its bytes and the CRC-32 of its ids), then the blocks. Blocks are coded
independently: each starts with an empty model, so any of them can be read alone and damage stays inside one.

Within a block, the id seen last after the same two ids (order 2) and the one seen last after the same one
id (order 1) are predictions, and so is every id of the block by how often it was seen (order 0). A decision says
which of them holds, the first that does, or none; its frequencies mix two adaptive tables, one by the confidence of each
prediction, with weights that follow whichever has predicted better; they and the counts are renewed every few ids. Order 0 codes the id by its
count among those seen; an id that is new codes its number of bits by an adaptive table, then its lower bits as they are. All
decisions drive one range coder. The blocks of a file advance in step, one array operation for all of them; ids that were seen
are told by their rank of first appearance, so that a block's whole state is some 80 kB.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklines.llm.common import cut, small

MAGIC = b"TOKMIX03"
BLOCK = 4096
SLOTS = 8192
#: Blocks that advance in step; some 80 kB each.
TOGETHER = 2048
#: Steps between two refreshes of a block's frequencies; totals of frequencies as a power of two.
REFRESH = 64
SCALE = 12
#: Ids lie below this; a larger one raises.
MAX_ID = 1 << 20
CLASSES = 21
_U, _H = np.uint64, np.uint16
TOP, BOTTOM = _U(1 << 48), _U(1 << 44)


class _Coder:
    """Range coders of all blocks, in step, 16 bits out or in at a time. Decoding if given 16-bit words."""

    def __init__(self, n: int, words: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.low, self.range = np.zeros(n, _U), np.full(n, 0xFFFFFFFFFFFFFFFF, _U)
        self.words = words
        if words is None:
            self.out, self.pos = np.zeros((n, 2 * BLOCK + 64), np.uint16), np.zeros(n, np.int64)
        else:
            self.pos, self.code = starts.astype(np.int64), np.zeros(n, _U)
            for _ in range(4):
                self.code = (self.code << _U(16)) | words[self.pos]
                self.pos += 1

    def settle(self, m: int) -> None:
        """Move the leading bits that are known out (or the next ones in) for the first m blocks."""
        todo = None
        low, rng = self.low[:m], self.range[:m]
        while True:
            a, r = (low, rng) if todo is None else (low[todo], rng[todo])
            loose = (a ^ (a + r)) < TOP
            some = np.flatnonzero(loose | (r < BOTTOM))
            if not len(some):
                return
            todo = some if todo is None else todo[some]
            a, r, loose = a[some], r[some], loose[some]
            if not loose.all():
                r = np.where(loose, r, (_U(0) - a) & (BOTTOM - _U(1)))
            pos = self.pos[todo]
            if self.words is None:
                self.out[todo, pos] = a >> _U(48)
            else:
                self.code[todo] = (self.code[todo] << _U(16)) | self.words[np.minimum(pos, len(self.words) - 1)]
            self.pos[todo] = pos + 1
            low[todo], rng[todo] = a << _U(16), r << _U(16)

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[np.arange(len(self.low)), self.pos] = self.low >> _U(48)
            self.low <<= _U(16)
            self.pos += 1
        return [self.out[i, : self.pos[i]].astype("<u2").tobytes() for i in range(len(self.low))]


class _Model:
    """The blocks' adaptive states. Ids are told by their place: their rank by first appearance in the block.

    A slot of the contexts holds the place seen last there, times 4, plus how sure it is (0 to 3; 0: nothing seen). What each step adds to the tables
    waits for refresh(). Until then an id that is new since counts as seen once.
    """

    def __init__(self, n: int, contexts: bool = True):
        self.n, self.base2, self.base, self.sixteen = n, np.arange(n) * SLOTS, np.arange(n) * BLOCK, np.arange(n) * 16
        self.two, self.one = np.zeros(n * SLOTS * contexts, _H), np.zeros(n * BLOCK * contexts, _H)
        self.by2, self.by1 = (np.tile(np.array([1, 1, 8, 4], np.int32), (n, 4, 1)) for _ in "21")
        self.weight, self.magnitude = np.full(n, 128, np.int32), np.ones((n, CLASSES), np.int32)
        self.last1, self.last2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.count, self.known = np.ones(n * BLOCK, _H), np.zeros(n, np.int64)
        self.waiting, self.past = 0, np.stack([self.sixteen, self.sixteen, self.base])[:, None].repeat(REFRESH, axis=1)  # its own of each block, also past its end

    def refresh(self) -> None:
        """Take in what has waited; mix the two tables of frequencies by weight, scale the magnitudes, and sum the counts of places."""
        n = self.n
        if self.waiting:
            k2, k1, at = self.past[:, : self.waiting]
            gain = np.sign(self.p2.ravel().take(k2) - self.p1.ravel().take(k1)).sum(axis=0, dtype=np.int32)
            self.weight = np.clip(self.weight + 2 * gain, 16, 240)
            self.by2 += 2 * np.bincount(k2.ravel(), minlength=16 * n).astype(np.int32).reshape(n, 4, 4)
            self.by1 += 2 * np.bincount(k1.ravel(), minlength=16 * n).astype(np.int32).reshape(n, 4, 4)
            np.add.at(self.count, at.ravel(), _H(1))
            self.waiting = 0
        self.p2 = (self.by2 << SCALE) // self.by2.sum(axis=2, keepdims=True)
        self.p1 = (self.by1 << SCALE) // self.by1.sum(axis=2, keepdims=True)
        w = self.weight[:, None, None, None]
        mixed = (self.p2[:, :, None, :3] * w + self.p1[:, None, :, :3] * (256 - w)) >> 8
        sums = np.cumsum(np.maximum(mixed, 1), axis=3)
        sums = sums * ((1 << SCALE) - 64) // np.maximum(sums[..., 2:], (1 << SCALE) - 64) + np.arange(1, 4) * 16
        cum = np.zeros((*sums.shape[:3], 5), _U)
        cum[..., 1:4], cum[..., 4] = sums, 1 << SCALE
        self.cum = cum.ravel()
        sums = np.cumsum(self.magnitude, axis=1)
        scaled = sums * ((1 << SCALE) - CLASSES) // sums[:, -1:] + np.arange(1, CLASSES + 1)
        self.sizes = np.concatenate([np.zeros((n, 1), _U), scaled.astype(_U)], axis=1)
        self.half = 1  # half the places that are summed, a power of two
        while 2 * self.half < min(BLOCK, int(self.known.max()) + REFRESH + 1):
            self.half *= 2
        below = np.zeros((n, 2 * self.half + 1), _H)
        np.cumsum(self.count.reshape(n, BLOCK)[:, : 2 * self.half], axis=1, dtype=_H, out=below[:, 1:])
        self.below, self.wide = below.ravel(), 2 * self.half + 1

    def predict(self, m: int):
        """Of the first m blocks: places of the two contexts, what stands there, how sure, and the row of the decision's cumulative frequencies."""
        last1 = self.last1[:m]
        at1 = self.base[:m] + last1
        at2 = self.base2[:m] + _slots(last1, self.last2[:m])
        s2, s1 = self.two.take(at2), self.one.take(at1)
        c2, c1 = s2 & _H(3), s1 & _H(3)
        return at2, at1, s2 >> _H(2), s1 >> _H(2), c2, c1, self.sixteen[:m] + (c2 * _H(4) + c1)

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the counts of all places known."""
        return self.below.take(rows * self.wide + self.known.take(rows)).astype(_U)

    def before(self, rows: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the places before this one, its count)."""
        at = rows * self.wide + place
        below = self.below.take(at)
        return below.astype(_U), (self.below.take(at + 1) - below).astype(_U)

    def at(self, rows: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """The place whose counts hold the aim-th."""
        at, aim, step = rows * self.wide, aim.astype(_H), self.half
        while step:
            at += step * (self.below.take(at + step) <= aim)
            step //= 2
        return at - rows * self.wide

    def take(self, c2: np.ndarray, c1: np.ndarray, choice: np.ndarray, place: np.ndarray, fresh: np.ndarray) -> None:
        """See the next places of each of the first blocks, a row for each step up to a refresh; fresh: where a place appears for the first time."""
        t, m = choice.shape
        np.add(self.sixteen[:m], c2 * 4 + choice, out=self.past[0, :t, :m])
        np.add(self.sixteen[:m], c1 * 4 + choice, out=self.past[1, :t, :m])
        np.add(self.base[:m], place, out=self.past[2, :t, :m])
        self.count[self.past[2, :t, :m][fresh]] -= _H(1)  # one is there already
        self.waiting = t
        self.known[:m] += fresh.sum(axis=0)

    def update(self, state, choice: np.ndarray, place: np.ndarray, new: np.ndarray) -> None:
        """See one more place of each of the first blocks; new: the blocks in which it appears for the first time."""
        at2, at1, p2, p1, c2, c1, row = state
        m, past, t = len(place), self.past, self.waiting
        np.add(self.sixteen[:m], c2 * _H(4) + choice, out=past[0, t, :m])
        np.add(self.sixteen[:m], c1 * _H(4) + choice, out=past[1, t, :m])
        np.add(self.base[:m], place, out=past[2, t, :m])
        self.count[past[2, t].take(new)] -= _H(1)  # one is there already
        self.waiting += 1
        self.known[new] += 1
        four = place * _H(4)
        self.two[at2] = four + np.where(p2 == place, np.minimum(c2 + _H(1), _H(3)), _H(1))
        self.one[at1] = four + np.where(p1 == place, np.minimum(c1 + _H(1), _H(3)), _H(1))
        self.last2[:m] = self.last1[:m]
        self.last1[:m] = place


def _slots(last1: np.ndarray, last2: np.ndarray) -> np.ndarray:
    """The slot of the context of two places."""
    return (last1 * np.uint32(0x9E3779B1) ^ last2 * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(19)


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.frexp(ids.astype(np.float64))[1]


def _places(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each id's rank by first appearance in its row, whether it is the first)."""
    order = np.argsort(grid, axis=1, kind="stable")
    ordered = np.take_along_axis(grid, order, axis=1)
    begins = np.ones(grid.shape, bool)
    begins[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    order += np.arange(len(grid))[:, None] * BLOCK
    order, begins = order.ravel(), begins.ravel()
    first = np.zeros(grid.size, bool)
    heads = order[begins]
    first[heads] = True
    rank = (np.cumsum(first.reshape(grid.shape), axis=1, dtype=_H) - _H(1)).ravel()
    place = np.empty(grid.size, _H)
    place[order] = rank[heads[np.cumsum(begins) - 1]]
    return place.reshape(grid.shape), first.reshape(grid.shape)


def _seen(slots: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how sure each place's slot is before it is seen, whether the place that stands there is this one), a row for each block."""
    order = np.argsort(slots, axis=1, kind="stable")
    ordered, stands = np.take_along_axis(slots, order, axis=1), np.take_along_axis(places, order, axis=1)
    told = ordered[:, 1:] == ordered[:, :-1]
    again = told & (stands[:, 1:] == stands[:, :-1])
    sure = np.zeros(slots.shape, np.uint8)
    sure[:, 1:] = told
    sure[:, 2:] += told[:, 1:] & again[:, :-1]
    sure[:, 3:] += told[:, 2:] & again[:, 1:-1] & again[:, :-2]
    sure[:, 1:] += again.view(np.uint8) << 2
    out = np.empty_like(sure)
    np.put_along_axis(out, order, sure, axis=1)
    return out & 3, out > 3


def _decisions(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each place 16 x how sure order 2 is, 4 x how sure order 1 is, and the decision: as decoding in step meets them."""
    last1, last2 = np.zeros(places.shape, np.uint32), np.zeros(places.shape, np.uint32)
    last1[:, 1:], last2[:, 2:] = places[:, :-1], places[:, :-2]
    (c2, hit2), (c1, hit1) = _seen(_slots(last1, last2).astype(_H), places), _seen(last1.astype(_H), places)
    return c2 << 4 | c1 << 2 | np.where(hit2, 0, np.where(hit1, 1, 2 + first)).astype(np.uint8)


def _in_step(sizes: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(blocks by their number of ids, the longest first; how many of them reach beyond each step)."""
    return np.argsort(-sizes, kind="stable"), (len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), "right")).tolist()


def _intervals(model: _Model, ids: np.ndarray, places: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is coded between two refreshes, a row for each step: the decision's start and size (of 2^SCALE); then the start, size and total of the place or of the number of bits, the bits below, and their value."""
    m = told.shape[1]
    lane, choice = np.arange(m), told & 3
    fresh = choice == 3
    at = lane * 80 + ((told >> 2) * np.uint8(5) + choice)
    start = model.cum.take(at)
    size = model.cum.take(at + 1) - start
    below, rest, wide, count, total = (np.full(told.shape, x, _U) for x in (0, 0, 0, 1, 1))
    old = np.flatnonzero(choice == 2)
    if len(old):
        known = model.known[:m] + np.cumsum(fresh, axis=0) - fresh
        rows = old % m
        below.ravel()[old], count.ravel()[old] = model.before(rows, places.ravel()[old])
        total.ravel()[old] = model.below.take(rows * model.wide + known.ravel()[old])
    new = np.flatnonzero(fresh)
    if len(new):
        v, rows = ids.ravel()[new], new % m
        cls = _bits(v)
        begin, low_bits = model.sizes[rows, cls], np.maximum(cls - 1, 0).astype(_U)
        below.ravel()[new], count.ravel()[new], total.ravel()[new] = begin, model.sizes[rows, cls + 1] - begin, 1 << SCALE
        wide.ravel()[new], rest.ravel()[new] = low_bits, v - (cls > 0) * (_U(1) << low_bits)
        np.add.at(model.magnitude, (rows, cls), 4)
    model.take(told >> 4, told >> 2 & 3, choice, places, fresh)
    return start, size, below, count, total, wide, rest


def encode_blocks(parts: list[np.ndarray]) -> list[bytes]:
    """Blocks of up to BLOCK ids each, coded each on its own."""
    if len(parts) > TOGETHER:
        return [b for a in range(0, len(parts), TOGETHER) for b in encode_blocks(parts[a : a + TOGETHER])]
    n = len(parts)
    order, reach = _in_step(np.array([len(x) for x in parts], np.int64))
    grid, places, told = np.zeros((BLOCK, n), np.uint32), np.zeros((BLOCK, n), _H), np.zeros((BLOCK, n), np.uint8)
    for a in range(0, n, 32):
        some = np.zeros((min(32, n - a), BLOCK), np.uint32)
        for row, k in zip(some, order[a : a + 32], strict=True):
            row[: len(parts[k])] = parts[k]
        ranks = _places(some.astype(_H) if some.max() < 1 << 16 else some)
        grid[:, a : a + 32], places[:, a : a + 32], told[:, a : a + 32] = some.T, ranks[0].T, _decisions(*ranks).T
    coder, model = _Coder(n), _Model(n, contexts=False)
    for a in range(0, len(reach), REFRESH):
        model.refresh()
        m, steps = reach[a], slice(a, min(a + REFRESH, len(reach)))
        start, size, below, count, total, wide, rest = _intervals(model, grid[steps, :m], places[steps, :m], told[steps, :m])
        for t, m in enumerate(reach[steps]):
            low, rng = coder.low[:m], coder.range[:m]
            unit = rng >> _U(SCALE)
            low += start[t, :m] * unit
            np.multiply(size[t, :m], unit, out=rng)
            unit = rng // total[t, :m]
            low += below[t, :m] * unit
            np.right_shift(np.multiply(count[t, :m], unit, out=unit), wide[t, :m], out=rng)
            low += rest[t, :m] * rng
            coder.settle(m)
    return [coded for _, coded in sorted(zip(order.tolist(), coder.finish(), strict=True))]


def decode_blocks(blocks: list[bytes], sizes: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """A row for each coded block, of so many ids (all below its top), with any numbers beyond."""
    n = len(blocks)
    if n > TOGETHER:
        return np.concatenate([decode_blocks(blocks[a : a + TOGETHER], sizes[a : a + TOGETHER], tops[a : a + TOGETHER]) for a in range(0, n, TOGETHER)])
    order, reach = _in_step(sizes)
    words = np.frombuffer(b"".join([*(blocks[k] for k in order), b"\0" * 64]), "<u2").astype(_U)
    starts, tops = np.cumsum([0, *(len(blocks[k]) // 2 for k in order)])[:-1], tops[order]
    ids, places = np.zeros(n * BLOCK, np.uint32), np.zeros((BLOCK, n), _H)
    coder, model = _Coder(n, words, starts), _Model(n)
    for t, m in enumerate(reach):
        if t % REFRESH == 0:
            model.refresh()
        state = model.predict(m)
        p2, p1, row = state[2], state[3], state[6]
        low, rng, code = coder.low[:m], coder.range[:m], coder.code[:m]
        unit = rng >> _U(SCALE)
        aim, at = code - low, row * 5
        choice = sum((model.cum.take(at + k) * unit <= aim).view(np.uint8) for k in (1, 2, 3))  # damage: any, which checksums tell
        at += choice
        start = model.cum.take(at)
        low += start * unit
        np.multiply(model.cum.take(at + 1) - start, unit, out=rng)
        place = np.where(choice == 0, p2, p1)
        old = np.flatnonzero(choice == 2)
        if len(old):
            total = np.maximum(model.total(old), _U(1))
            unit, start = rng[old] // total, low[old]
            found = model.at(old, np.minimum((code[old] - start) // unit, total - _U(1)))
            before, many = model.before(old, found)
            low[old] = start + before * unit
            rng[old] = many * unit
            place[old] = found
        new = np.flatnonzero(choice == 3)
        if len(new):
            unit = rng[new] >> _U(SCALE)
            aim = code[new] - low[new]
            table = model.sizes[new]
            cls = (np.minimum(aim // unit, _U((1 << SCALE) - 1))[:, None] >= table[:, 1:]).sum(axis=1)
            begin = table[np.arange(len(new)), cls]
            wide = np.maximum(cls - 1, 0).astype(_U)
            inner = ((table[np.arange(len(new)), cls + 1] - begin) * unit) >> wide
            low_bits = np.minimum((aim - begin * unit) // inner, (_U(1) << wide) - _U(1))
            low[new] += begin * unit + low_bits * inner
            rng[new] = inner
            place[new] = known = model.known[new]
            ids[new * BLOCK + known] = np.minimum((cls > 0) * (_U(1) << wide) + low_bits, (tops[new] - 1).astype(_U))
            model.magnitude[new, cls] += 4
        coder.settle(m)
        model.update(state, choice, place, new)
        places[t, :m] = place
    out = np.empty((n, BLOCK), np.uint32)
    for a in range(0, n, 128):
        out[order[a : a + 128]] = ids.take(places[:, a : a + 128].T + model.base[a : a + 128, None])
    return out


def _blocks(n_ids: int) -> int:
    return -(-n_ids // BLOCK)


def pack_all(files: list[tuple[list[int | None], np.ndarray, np.ndarray]]) -> list[bytes]:
    """Files of documents with so many ids each, given as (doc_ids, lengths, ids); the blocks of all advance in step."""
    tops = [int(ids.max()) + 1 if len(ids) else 1 for _, _, ids in files]
    if max(tops, default=0) > MAX_ID:
        raise ValueError(f"ids must lie below {MAX_ID}, not {max(tops) - 1}")
    coded = iter(encode_blocks([ids[a : a + BLOCK] for _, _, ids in files for a in range(0, len(ids), BLOCK)]))
    out = []
    for (doc_ids, lengths, ids), top in zip(files, tops, strict=True):
        blocks = [next(coded) for _ in range(_blocks(len(ids)))]
        sums = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
        names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
        numbers = np.concatenate([np.asarray(lengths, "<u4"), np.array([len(b) for b in blocks], "<u4"), np.array(sums, "<u4")])
        head = names + numbers.astype("<u4").tobytes()
        out.append(MAGIC + struct.pack("<QQIII", len(lengths), len(ids), len(blocks), top, zlib.crc32(head)) + head + b"".join(blocks))
    return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents with so many ids each."""
    return pack_all([(doc_ids, lengths, ids)])[0]


def unpack_all(payloads: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each file; ValueError if a checksum doesn't hold. The blocks of all advance in step."""
    told, blocks, sizes, tops = [], [], [], []
    for payload in payloads:
        docs, count, n, top, crc = struct.unpack_from("<QQIII", payload, 8)
        at = 8 + struct.calcsize("<QQIII")
        end = at + 9 * docs + 4 * (docs + 2 * n)
        if payload[:8] != MAGIC or top > MAX_ID or zlib.crc32(payload[at:end]) != crc or n != _blocks(count):
            raise ValueError("not a token file, or its header is damaged")
        names = np.frombuffer(payload[at : at + 8 * docs], "<i8").tolist()
        missing = payload[at + 8 * docs : at + 9 * docs]
        head = np.frombuffer(payload[at + 9 * docs : end], "<u4").astype(np.int64)
        ends = end + np.cumsum(head[docs : docs + n])
        blocks += [payload[b - k : b] for b, k in zip(ends.tolist(), head[docs : docs + n].tolist(), strict=True)]
        sizes += [min(BLOCK, count - k * BLOCK) for k in range(n)]
        tops += [top] * n
        told.append(([None if gone else d for d, gone in zip(names, missing, strict=True)], head[:docs], count, head[docs + n :]))
    grid, at, out = decode_blocks(blocks, np.array(sizes, np.int64), np.array(tops, np.int64)), 0, []
    for names, lengths, count, sums in told:
        ids = grid[at : at + len(sums)].reshape(-1)[:count]
        at += len(sums)
        for k, want in enumerate(sums):
            if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != want:
                raise ValueError(f"block {k} is damaged")
        out.append((names, lengths, ids))
    return out


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; ValueError if a checksum doesn't hold."""
    return unpack_all([payload])[0]


#: White space of any engine; a space that starts a word, and one that doesn't.
_BLANKS = r"\s\u180e\u200b\ufeff"
_BLANK, _NEXT_WORD, _NO_WORD = (re.compile(x) for x in (rf"[{_BLANKS}]", rf" (?=[^{_BLANKS}])", rf" (?![^{_BLANKS}])"))
#: Letters of any version of Unicode and then marks, without the apostrophe: two tokens' worth, whatever follows.
_LETTERS, _MARKS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[!-&(-/:-@\[-`{-~]"
_MARKED, _MARKED_PART = re.compile(f"({_LETTERS}+)({_MARKS}+)"), re.compile(f"{_LETTERS}*{_MARKS}*")
#: Characters of words that a worker remembers, in both generations.
REMEMBERED = 10 << 20
#: Characters of words that the library gets side by side; it is slower with more.
LINE = 2048


class _Known(dict):
    """Ids of words in two generations: a word of the one before moves to this one when it is met, one of neither is None and noted as new."""

    def __init__(self):
        self.before, self.new, self.size, self.size_before = {}, set(), 0, 0

    def __missing__(self, word: str) -> bytes | None:
        ids = self.before.get(word)
        if ids is None:
            self.new.add(word)
            return None
        self[word] = ids
        self.size += len(word)
        return ids

    def turn(self) -> None:
        """Begin a generation if this one is full."""
        if self.size > REMEMBERED * 3 // 8:
            self.before, self.size_before = (dict(self), self.size) if self.size <= REMEMBERED * 5 // 8 else ({}, 0)
            self.clear()
            self.size = 0


class _Words:
    """Encodes texts with the library, each word once for as long as it is remembered.

    A byte-level tokenizer starts anew at every space that something other than white space follows, whatever stands before and after, so the ids of a
    text are those of its words in turn, each with its space. New words go to the library side by side; how many bytes each id
    stands for tells which are whose. Tokenizers of other kinds encode whole texts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer, told = Tokenizer.from_str(definition), json.loads(definition)
        pre, model, added = (told.get(k) or {} for k in ("pre_tokenizer", "model", "added_tokens"))
        self.apart = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or _BLANK.search(t["content"]) for t in added)
        )
        self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, k in (model.get("vocab") or {}).items() if self.apart else ():
            self.bytes[k] = len(token)  # a character for each byte
        for t in added if self.apart else ():
            self.bytes[t["id"]] = len(t["content"].encode())
        self.parted = self.apart and not any(_MARKED_PART.fullmatch(t["content"]) for t in added)
        self.words = _Known()  # by the word without its space; the first word of a text, which has none, with one

    def _library(self, texts: list[str]) -> Iterator[np.ndarray]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4")

    @property
    def size(self) -> int:
        """Characters of the words remembered."""
        return self.words.size + self.words.size_before

    def _learn(self) -> None:
        """Add the words that were noted as new; the marks that end letters are a text's first word of their own."""
        words, known, marked = self.words.new, self.words, []
        known.new = set()
        if self.parted:
            marked = [x.groups() for x in map(_MARKED.fullmatch, words) if x]
            words.difference_update([a + b for a, b in marked])
            for part in {x for a, b in marked for x in (a, " " + b)}:
                known[part]  # noqa: B018 (notes it)
            words |= known.new
            known.new = set()
        self._ask(words)
        known.update((a + b, known[a] + known[" " + b]) for a, b in marked)
        known.size += sum(map(len, words)) + sum(len(a) + len(b) for a, b in marked)

    def _ask(self, words: set[str]) -> None:
        alone, lines, size = [], [], LINE
        for word in words:
            if word[:1] == " ":
                alone.append(word)
                continue
            if size >= LINE:
                lines.append([])
                size = 0
            lines[-1].append(word)
            size += len(word) + 1
        texts = [" " + " ".join(line) for line in lines]
        for line, text, ids in zip(lines, texts, self._library(texts), strict=True):
            sizes = [len(w) for w in line] if text.isascii() else [len(w.encode()) for w in line]
            last = np.cumsum(self.bytes[ids])
            cuts = np.searchsorted(last, np.cumsum(np.array(sizes) + 1)) + 1
            if cuts[-1] != len(ids) or (last[cuts - 1] != np.cumsum(np.array(sizes) + 1)).any():
                raise ValueError("ids that don't end where words do")
            raw, ends = ids.tobytes(), (4 * cuts).tolist()
            self.words.update((w, raw[a:b]) for w, a, b in zip(line, [0, *ends], ends, strict=False))
        self.words.update((w, ids.tobytes()) for w, ids in zip(alone, self._library([w[1:] for w in alone]), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, little-endian, 32 bits each."""
        if not self.apart:
            yield from (ids.tobytes() for ids in self._library(texts))
            return
        split, found, known = [], [], self.words
        for text in texts:
            words = _NEXT_WORD.split(text) if _NO_WORD.search(text) else text.split(" ")
            words[0] = " " + words[0]
            split.append(words)
            found.append(list(map(known.__getitem__, words)))
        if known.new:
            self._learn()
        for words, ids in zip(split, found, strict=True):
            for k in [k for k, x in enumerate(ids) if x is None]:
                ids[k] = known[words[k]]
            yield b"".join(ids)
        known.turn()


@lru_cache(maxsize=2)
def _tokenizer(text: str) -> _Words:
    return _Words(text)


def _encoded(words: _Words, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text and the end id; a few texts are encoded together, without offsets."""
    held, size, end = [], 0, np.uint32(end_id).astype("<u4").tobytes()
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size > 1 << 18 or k + 1 == len(texts):
            for ids in words.encode(held):
                yield np.frombuffer(ids + end, "<u4")
            held, size = [], 0


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, file_ids: int = 6 << 20) -> DataFrame:
    """Encode docs(doc_id, text) and write token files, in ascending order of doc_id, to the shared folder.

    Returns the written table: part, number (their order is the files' order), n_ids, payload. A file ends
    with the document that takes it to file_ids ids. end_id follows each document. Null text counts as
    empty; rows without an id come first; rows that repeat an id all stay, in no set order. No rows: no files.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = _tokenizer(shared.value), TaskContext.get().partitionId()
        names, held, size, number, waiting = [], [], 0, 0, []

        def files() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, number
            for payload, (_, _, ids) in zip(pack_all(waiting), waiting, strict=True):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
                number += 1
            waiting = []

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(tokenizer, batch.column(1).to_pylist(), end_id), strict=True):
                names.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= file_ids:
                    if _blocks(size) + sum(_blocks(len(w[2])) for w in waiting) > TOGETHER:
                        yield from files()
                    waiting.append((names, np.array([len(h) for h in held]), np.concatenate(held)))
                    names, held, size = [], [], 0
        if names:
            waiting.append((names, np.array([len(h) for h in held]), np.concatenate(held)))
        yield from files()

    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(packed, "part int, number int, n_ids long, payload binary"), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in files that write_token_files() returned.

    start: ids of all documents before it; ids_crc32: unsigned CRC-32 of its ids as little-endian 32-bit integers.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))  # a row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(batch: pa.RecordBatch) -> Iterator[tuple]:
            held, n = [], 0
            for payload, n_ids in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                n += _blocks(n_ids)
                if held and n > TOGETHER:
                    yield from unpack_all(held)
                    held, n = [], _blocks(n_ids)
                held.append(payload.as_py())
            yield from unpack_all(held)

        for batch in batches:
            for start, (names, lengths, ids) in zip(batch.column(0).to_pylist(), opened(batch), strict=True):
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[b - n : b].tobytes()) for b, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array(sums, pa.int64())})

    placed = files.select("part", "number", "n_ids", "payload").join(small(offsets, files.count()), ["part", "number"])
    return placed.select("start", "payload", "n_ids").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
