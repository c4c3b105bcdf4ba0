"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of a batch at once.

A-Z are lower-cased; words are runs of bytes other than space and tab to carriage return, so UTF-8 needs no decoding. A
shingle is `words` words in a row; a text with fewer words is one shingle; one without words has none.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _U(0x9E3779B97F4A7C15)
_WORD = _U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in buffer (text i is buffer[offsets[i]:offsets[i+1]]), and each text's number."""
    n = len(buffer)
    space = _SPACE[buffer]
    starts = ~space
    starts[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = ~space[heads]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    place = np.arange(n, dtype=np.int64)
    begin = np.zeros(n, np.int64)
    begin[at] = at
    place -= np.maximum.accumulate(begin)
    place[: at[0]] = 0
    place[space] = 0
    values = _BYTE[buffer]
    values *= _powers(int(place.max()) + 1, _STEP)[place]
    values[space] = 0
    sums = np.add.reduceat(values, at)
    counts = np.diff(np.searchsorted(at, offsets))
    return mixed(sums), counts


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and how many each text has."""
    hashes, counts = word_hashes(buffer, offsets)
    texts = len(offsets) - 1
    per = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    firsts = ends - counts
    text = np.repeat(np.arange(texts), per)
    begin = np.repeat(firsts, per) + (np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per))
    total = np.zeros(len(begin), np.uint64)
    last = np.repeat(ends, per)
    for k in range(words):
        at = begin + k
        inside = at < last
        total = total * _WORD + np.where(inside, hashes[np.minimum(at, max(0, len(hashes) - 1))] if len(hashes) else _U(0), _U(0))
    total = mixed(total)
    if not len(total):
        return total, np.zeros(texts, np.int64)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    return total[keep], np.bincount(text[keep], minlength=texts)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit key for each text's set of shingles, the same for equal sets; 0 for an empty set."""
    keys = np.zeros(len(counts), np.uint64)
    if len(hashes):
        full = counts > 0
        keys[full] = np.add.reduceat(mixed(hashes ^ _STEP), (np.cumsum(counts) - counts)[full])
        keys[full] = mixed(keys[full] ^ counts[full].astype(np.uint64))
        keys[full & (keys == 0)] = 1
    return keys.view(np.int64)
