"""Words of whole texts as arrays: where they stand, and hashes of them, of runs of them and of their shingles."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters worked on at once; a longer text is parted at white space.
PIECE = 1 << 16
#: White space of str.split() among the bytes of ASCII; further white space is turned into spaces first.
_SPACE = bytes(c < 128 and chr(c).isspace() for c in range(256))
#: First bytes of further white space in UTF-8.
_LEADS = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
_WIDE, _BLANK = re.compile(r"[^\S\x00-\x7f]"), re.compile(r"\s")
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Random odd weights of the places in a run; places beyond weigh alike again, with another offset.
_WEIGHTS = np.random.default_rng(17).integers(1 << 63, size=4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, eight at a time."""
    eights = np.ndarray(len(raw), "<u8", raw + b"\0" * 8, strides=(1,))
    left, h, at = ends - starts, np.zeros(len(starts), np.uint64), starts
    h[:] = left
    todo = None
    while len(at):
        chunk = mixed((eights[at] & _FIRST[np.minimum(left, 8)]) * _GOLD)
        if todo is None:
            h = mixed(h + chunk)
        else:
            h[todo] = mixed(h[todo] * _GOLD + chunk)
        more = np.flatnonzero(left > 8)
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def lowered(text: str) -> str:
    """The text in lower case; characters that would become several stay, so that places hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_table(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the lower-cased words of the text, and the places of its line feeds; all in code points."""
    low, at, parts, breaks = lowered(text), 0, [], []
    while at < len(low):
        end = len(low)
        if end - at > PIECE:
            blank = _BLANK.search(low, at + PIECE)
            end = blank.end() if blank else end
        piece = low if end - at == len(low) else low[at:end]
        plain = piece.isascii()
        raw = piece.encode("utf-8", "surrogatepass")
        if not plain and any(lead in raw for lead in _LEADS):
            raw = _WIDE.sub(" ", piece).encode("utf-8", "surrogatepass")
        c = np.frombuffer(raw, np.uint8)
        space = np.frombuffer(b"\1" + raw.translate(_SPACE) + b"\1", bool)
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last, lines = edge[::2], edge[1::2], np.flatnonzero(c == 10)
        found = _word_hashes(raw, first, last)
        if not plain:
            place = np.concatenate([[0], np.cumsum((c & 0xC0) != 0x80)])
            first, last, lines = place[first], place[last], place[lines]
        parts.append((first + at, last + at, found))
        breaks.append(lines + at)
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    starts, ends, hashes = (p[0] if len(p) == 1 else np.concatenate(p) for p in zip(*parts, strict=True))
    return starts, ends, hashes, breaks[0] if len(breaks) == 1 else np.concatenate(breaks)


def word_batches(texts: Iterable[str]) -> Iterator[tuple]:
    """Texts a few at a time, short ones worked on together: (texts, starts, ends, hashes, doc, breaks, begin).

    starts, ends, hashes: as word_table() of the texts joined by one character; doc: the text of each word by its number in the batch;
    breaks: places of line feeds and of the joints; begin: where each text starts. No text: no batch.
    """
    held, size = [], 0

    def batch():
        begin = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        starts, ends, hashes, breaks = word_table(" ".join(held))
        doc = np.searchsorted(begin, starts, side="right") - 1
        return held, starts, ends, hashes, doc, np.sort(np.concatenate([breaks, begin[1:] - 1])), begin

    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size > PIECE // 2:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def word_tables(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """word_table() of each text; short texts are worked on together."""
    for held, starts, ends, hashes, doc, breaks, begin in word_batches(texts):
        at, lines = np.searchsorted(doc, np.arange(len(held) + 1)), np.searchsorted(breaks, [*begin, np.inf])
        for k, b in enumerate(begin.tolist()):
            w = slice(at[k], at[k + 1])
            yield starts[w] - b, ends[w] - b, hashes[w], breaks[lines[k] : lines[k + 1] - (k + 1 < len(held))] - b


def run_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key for each run of words that begins at starts, from the words' hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    if at.max() >= len(_WEIGHTS):
        hashes = hashes + (at // len(_WEIGHTS)).astype(np.uint64) * _GOLD
        at %= len(_WEIGHTS)
    return mixed(np.add.reduceat(hashes * _WEIGHTS[at], starts))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; fewer words: one of them all; none: none."""
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        out = out * _GOLD + hashes[i : i + len(out)]
    return out ^ (out >> np.uint64(31))


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """(sets, bands) keys of sets of shingles that begin at starts in flat: sets agree in a band's key if the band's minima agree."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64)
    keys = np.zeros((len(starts), bands), np.uint64)
    h, s = np.empty_like(flat), np.empty_like(flat)
    for k in range(bands * rows):
        np.multiply(flat, a[k], out=h)
        h += b[k]
        np.right_shift(h, np.uint64(29), out=s)
        h ^= s
        keys[:, k // rows] = (keys[:, k // rows] ^ np.minimum.reduceat(h, starts)) * _GOLD
    return (keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
