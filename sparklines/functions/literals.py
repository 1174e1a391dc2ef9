"""Thousands of literals looked for at once: an index of one rare run of bytes (gram) of each literal.

The bytes of a batch of lines are one array; the grams at all places are looked up together in a table of bits, and the few
places that hit are compared with the literals that have that gram. So the time follows the bytes of the lines, hardly the number of literals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a gram at most, and bits of the table of a gram length.
GRAM, BITS = 4, 18
_MIX = np.uint32(0x9E3779B1)


class GramIndex:
    """Literals by a gram of each: the one that was rarest in the first lines seen, which changes the speed alone."""

    def __init__(self, literals: list[str]):
        distinct = {x.encode("utf-8", "surrogatepass") for x in literals}
        self.always = b"" in distinct
        self.by_length = {q: sorted(x for x in distinct if min(len(x), GRAM) == q) for q in range(1, GRAM + 1)}
        self.ready: dict[int, tuple] = {}

    @staticmethod
    def _grams(padded: np.ndarray, q: int) -> np.ndarray:
        every = np.ndarray(len(padded) - GRAM, "<u4", padded, strides=(1,))
        return every if q == GRAM else every & np.uint32((1 << 8 * q) - 1)

    @staticmethod
    def _places(grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> np.uint32(32 - BITS)

    def _prepare(self, q: int, places: np.ndarray) -> tuple:
        """(table, grams in order, for each its literals and where in them it stands)."""
        seen, chosen = np.bincount(places, minlength=1 << BITS), {}
        for literal in self.by_length[q]:
            own = self._grams(np.frombuffer(literal + bytes(GRAM), np.uint8), q)[: len(literal) - q + 1]
            at = int(seen[self._places(own)].argmin())
            chosen.setdefault(int(own[at]), []).append((np.frombuffer(literal, np.uint8), at))
        grams = np.array(sorted(chosen), np.uint32)
        table = np.zeros(1 << BITS, bool)
        table[self._places(grams)] = True
        return table, grams, [chosen[int(g)] for g in grams]

    def match(self, lines: pa.Array) -> pa.Array:
        """Whether each line holds any of the literals; null for null."""
        wide = np.int64 if pa.types.is_large_string(lines.type) or pa.types.is_large_binary(lines.type) else np.int32
        offsets = np.frombuffer(lines.buffers()[1], wide)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        hit = np.full(len(lines), self.always)
        if len(lines) and offsets[-1] > offsets[0]:
            data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
            for q in self.by_length:
                if self.by_length[q] and not self.always:
                    self._find(q, padded, offsets, hit)
        mask = lines.is_null().to_numpy(zero_copy_only=False)
        return pa.array(hit, pa.bool_(), mask=mask)

    def _find(self, q: int, padded: np.ndarray, offsets: np.ndarray, hit: np.ndarray) -> None:
        grams = self._grams(padded, q)
        places = self._places(grams)
        table, known, literals = self.ready[q] if q in self.ready else self.ready.setdefault(q, self._prepare(q, places))
        at = np.flatnonzero(table[places])
        which = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        true = known[which] == grams[at]
        at, which = at[true], which[true]
        row = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(which, kind="stable")
        bounds = np.flatnonzero(np.diff(which[order], prepend=-1))
        for own in np.split(order, bounds[1:]) if len(order) else []:
            own = own[~hit[row[own]]]
            for literal, inside in literals[which[own[0]]] if len(own) else []:
                begin, line = at[own] - inside, row[own]
                fits = (begin >= offsets[line]) & (begin + len(literal) <= offsets[line + 1])
                begin, line = begin[fits], line[fits]
                for k in range(0, len(literal), 8):  # a few bytes of all candidates at a time
                    part = literal[k : k + 8]
                    same = (padded[begin[:, None] + np.arange(k, k + len(part))] == part).all(axis=1)
                    begin, line = begin[same], line[same]
                hit[line] = True


def any_literal(text: Column, literals: list[str]) -> Column:
    """Whether a text holds any of the literals, by a GramIndex; null for null."""
    index = GramIndex(literals)

    @F.arrow_udf("boolean")
    def found(lines: pa.Array) -> pa.Array:
        return index.match(lines)

    return found(text)
