"""Hashes of words and of runs of words, over whole Arrow batches at once."""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
#: Words of up to so many bytes are hashed in blocks of eight; longer ones by BLAKE2.
BLOCKS = 4
#: Of a block, what belongs to a word with so many bytes left in it.
INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_rng = np.random.default_rng(20_240_607)
SEED, BLOCK_FACTOR, LEFT_FACTOR, GOLDEN = (int(x) | 1 for x in _rng.integers(2**62, 2**63, 4, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (fixed constants), in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def chunks(column):
    """(first row, bytes, offsets) of parts of a text column; null texts are empty."""
    import pyarrow as pa

    a = column.cast(pa.large_binary()).fill_null(b"")
    if not len(a):
        return
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, of each text the index of its first word and one more); fold: as with A-Z in lower case.

    Each block of eight bytes goes through a mix of its own, so that no pattern of bytes cancels out; a word of one block is told from
    all others of its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    edge = np.empty(n + 1, bool)  # before byte i there is a space or a text's start
    edge[0] = True
    edge[1:] = space
    edge[offsets] = True
    word = ~space
    start = np.flatnonzero(word & edge[:-1])
    after = np.empty(n, bool)  # after byte i there is a space or a text's end
    after[:-1] = space[1:]
    after[-1] = True
    inner = offsets[1:]
    after[inner[inner > 0] - 1] = True
    length = np.flatnonzero(word & after) + 1 - start
    padded = np.zeros(n + 8 * BLOCKS + 8, np.uint8)
    padded[:n] = FOLDED[data] if fold else data
    block = np.ndarray((n + 8 * BLOCKS + 1,), "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) * U64(SEED)
    for k in range(BLOCKS):
        at = np.flatnonzero(length > 8 * k) if k else slice(None)
        x = block[start[at] + 8 * k] & INSIDE[np.minimum(length[at] - 8 * k, 8)]
        x *= U64(BLOCK_FACTOR)
        h[at] = mix(h[at] ^ x)
    for i in np.flatnonzero(length > 8 * BLOCKS).tolist():
        whole = hashlib.blake2b(padded[start[i] : start[i] + length[i]], digest_size=8)
        h[i] = U64(int.from_bytes(whole.digest(), "little"))
    return h, np.searchsorted(start, offsets)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(LEFT_FACTOR)
    x += b
    return mix(x)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words from each place on, folded from runs of 1, 2, 4 ... words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while size <= k:
        if k & size:
            n = len(h) - done - size + 1
            out = part[:n] if out is None else _pair(out[:n], part[done : done + n])
            done += size
        if 2 * size <= k:
            part = _pair(part[:-size], part[size:])
        size *= 2
    return mix(out + U64(k * GOLDEN % 2**64))


class Joined:
    """A text's words, one space between them, with the bytes of any run of them."""

    def __init__(self, words: list[bytes]):
        self.words, self.bytes = words, memoryview(b" ".join(words))
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])

    def runs(self, start: np.ndarray, end: np.ndarray):
        """The bytes of the runs from start to end, one after another."""
        return (self.bytes[a : z - 1] for a, z in zip(self.at[start].tolist(), self.at[end].tolist(), strict=True))
