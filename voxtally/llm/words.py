"""Words of whole texts as numpy arrays, and hashes of words and of runs of words.

Texts stay in their Arrow buffers: nothing here makes a Python object per word. All
sums are taken modulo 2**64. Work arrays have a fixed block size, so a very long text
costs memory for its words only.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors get these functions by value; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1 << 17
SPACES = b" \t\n\x0b\x0c\r"
U = np.uint64


@dataclass
class Words:
    """``start`` and ``end`` are byte positions in ``data``; text i has the words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def is_word_byte() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def is_letter_byte() -> np.ndarray:
    """ASCII letters, and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins; a null text has none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8, high - low, low) if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, bounds - low


def find_words(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that ``table`` takes, by default of all but ASCII white space."""
    data, bounds = text_buffers(texts)
    inside = (is_word_byte() if table is None else table)[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def run_sums(values, n: int, base: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each run low to high: the sum of value[low + j] * base**j, from running sums.

    ``values(a, b)`` yields the 64-bit values of positions a to b. ``low`` and ``high``
    are sorted.
    """
    up, down = powers(base, BLOCK), powers(inverse(base), BLOCK)
    at_low, at_high = np.zeros(len(low), U), np.zeros(len(high), U)
    shift = np.zeros(len(low), U)
    total, ahead, back = 0, 1, 1
    step, unstep = pow(base, BLOCK, 1 << 64), pow(inverse(base), BLOCK, 1 << 64)
    for a in range(0, n + 1, BLOCK):
        b = min(a + BLOCK, n)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(values(a, b) * up[: b - a] * U(ahead), out=sums[1:])
        sums += U(total)
        i, j = np.searchsorted(low, [a, a + BLOCK])
        at_low[i:j] = sums[low[i:j] - a]
        shift[i:j] = down[low[i:j] - a] * U(back)
        i, j = np.searchsorted(high, [a, a + BLOCK])
        at_high[i:j] = sums[high[i:j] - a]
        total = int(sums[-1])
        ahead, back = ahead * step % (1 << 64), back * unstep % (1 << 64)
    return (at_high - at_low) * shift


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    table = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    data = words.data
    sums = run_sums(lambda a, b: table[data[a:b]], len(data), 0xD6E8FEB86659FD95, words.start, words.end)
    return mixed(sums + (words.end - words.start).astype(U) * U(0x9E3779B97F4A7C15))


def hash_word(word: str) -> int:
    """The hash ``word_hashes`` gives the one word of ``word``."""
    return int(word_hashes(find_words(pa.array([word])))[0])


def window_hashes(hashes: np.ndarray, size: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive values; entry i starts at value i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    low = np.arange(n)
    return mixed(run_sums(lambda a, b: hashes[a:b], len(hashes), base, low, low + size))


def window_starts(words: Words, size: int) -> np.ndarray:
    """First words of all windows of ``size`` words that lie within one text."""
    n = np.maximum(words.counts() - size + 1, 0)
    total = int(n.sum())
    shift = words.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else words.first[:-1]
    return np.arange(total) + np.repeat(shift, n)


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Consecutive parts of a batch whose texts have about ``limit`` bytes; a longer text is a part of its own."""
    size = np.diff(text_buffers(batch.column(column))[1])
    begin = total = 0
    for i, n in enumerate(size):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(size):
        yield batch.slice(begin)
