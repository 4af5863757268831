"""Words and word windows of many texts at once, as numpy arrays over UTF-8 bytes.

A word's hash mixes its bytes eight at a time; a window's one mixes the hashes of its two halves, and theirs of theirs,
so no regular pattern of letters or words cancels out. One pass gives every window of a whole batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Longer words are hashed one by one.
_LONG_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LEFT, _ENDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def byte_table(is_word, lower: bool = False) -> np.ndarray:
    """For each byte 0 where it parts words, else the byte (A-Z in lower case if asked); NUL, where it is part of
    words, is 255, which UTF-8 never has."""
    t = np.array([(b or 255) if is_word(b) else 0 for b in range(256)], dtype=np.uint8)
    if lower:
        t[65:91] = [b + 32 if is_word(b + 32) else 0 for b in range(65, 91)]
    return t


#: Words of anything but ASCII white space.
BLANK_SEPARATED = byte_table(lambda b: not (b == 32 or 9 <= b <= 13))
BLANK_SEPARATED_LOWER = byte_table(lambda b: not (b == 32 or 9 <= b <= 13), lower=True)
#: Words of ASCII letters, digits and all that is not ASCII.
ALNUM_LOWER = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0x7FB5D329728EA185)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of the rows lo..hi-1 of a batch; data is the rows' bytes with separators as 0."""

    lo: int
    hi: int
    raw: np.ndarray
    data: np.ndarray
    starts: np.ndarray  # bytes at which words start
    ends: np.ndarray
    rows: np.ndarray  # for each word, its row counted from lo
    first: np.ndarray  # for each row the index of its first word; one more entry at the end
    offsets: np.ndarray  # for each row its first byte; one more entry at the end

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, which)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; different ones for `which` 0, 1 and 2."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _LEFT + np.uint64(_SEEDS[which]))
    live = np.flatnonzero(size <= _LONG_WORD)
    for at in range(0, _LONG_WORD, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        h[live] = mix(h[live] ^ (eight[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def window_hashes(h: np.ndarray, length, at: np.ndarray | None = None, which: int = 1) -> np.ndarray:
    """Hash of `length` values (one number, or one for each place) from each place in `at` (all places by default)."""
    if at is None:
        at = np.arange(max(0, len(h) - length + 1))
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    lengths = np.full(len(at), length, dtype=np.int64) if np.isscalar(length) else np.asarray(length, dtype=np.int64)
    shortest, longest = int(lengths.min()), int(lengths.max())
    out = np.empty(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        level, width = mix(h + np.uint64(_SEEDS[which])), 1  # level[i]: hash of `width` values from i
        while width <= longest:
            if shortest < 2 * width:
                # Two spans of this width cover a window of up to twice as many values.
                here = slice(None) if longest < 2 * width and shortest >= width else np.flatnonzero((lengths >= width) & (lengths < 2 * width))
                a, n = at[here], lengths[here]
                out[here] = mix(level[a] * _ENDS + level[a + n - width] + n.astype(np.uint64))
            if 2 * width > longest:
                break
            level = mix(level[:-width] * _LEFT + level[width:])
            width *= 2
    return out


def chunks(texts: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """Words of all rows, about CHUNK_BYTES at a time; a longer row is a chunk of its own. A null has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offs, blob = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    blob = np.frombuffer(blob, dtype=np.uint8) if blob is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        yield split(blob[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], table, lo, hi)
        lo = hi


def split(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, lo: int, hi: int) -> Words:
    data = table[raw]
    inside = data != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(lo, hi, raw, data, starts, ends, rows, first, offsets)
