"""Suffix order, Burrows-Wheeler transform and threshold-bounded common prefixes of a set of short byte strings."""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of the suffixes of data by their first 128 symbols, by doubling.

    data: bytes of strings, each followed by one separator; ends[i]: place of the separator of the string that holds i.
    Separators sort before bytes and differ from each other, so no common prefix runs past a string's end.
    """
    n = len(data)
    places = np.arange(n)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    left = ends - places
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes of 9 bits: a byte is 1 to 256, the end 0
        key = (key << np.uint64(9)) | np.where(left > k, padded[k : n + k] + np.uint64(1), np.uint64(0))
    own = left == 0
    _, rank = np.unique(key, return_inverse=True)
    rank = rank.astype(np.int64) + n
    rank[own] = np.arange(int(own.sum()))
    width = 7
    while width < 128:
        after = rank[np.minimum(places + width, ends)]
        pair = rank * (2 * n + 1) + after
        pair[own] = rank[own]
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable")


def long_prefixes(data: np.ndarray, order: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix order but the first, whether it shares `least` symbols or more with the row before.

    Interval expansion: starting from all rows, every interval of rows with a common prefix of length l is extended
    backwards by each symbol of its Burrows-Wheeler column, breadth first, so that common prefixes come by increasing
    value: where an extended interval ends, the prefix shared with the next row is l, if none shorter was met there.
    Only such intervals go on, at most one for each row in all. Rows still open when l reaches `least` share more.
    """
    n = len(order)
    before = order - 1
    separator = data.astype(np.int64) + 1
    separator[ends == np.arange(n)] = 0
    column = np.where(before >= 0, separator[np.maximum(before, 0)], 0)
    by_symbol = np.argsort(column, kind="stable")  # rows by symbol, then row: where each row's extension lands
    lands = np.empty(n, np.int64)
    lands[by_symbol] = np.arange(n)
    # Separators are n distinct symbols; they end every extension and lie first.
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    low, high = np.array([0]), np.array([n])
    # Rows that begin with a separator share nothing with their neighbours.
    heads = int((separator == 0).sum())
    open_[: heads + 1] = False
    for length in range(least):
        if not len(low):
            break
        width = high - low
        interval = np.repeat(np.arange(len(low)), width)
        rows = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + low[interval]
        symbol = column[rows]
        real = symbol > 0
        rows, interval, symbol = rows[real], interval[real], symbol[real]
        to = lands[rows]
        sort = np.argsort(to, kind="stable")
        to, interval, symbol = to[sort], interval[sort], symbol[sort]
        new = np.ones(len(to), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        starts = np.flatnonzero(new)
        low, high = to[starts], (to[np.append(starts[1:], len(to)) - 1] + 1 if len(to) else to)
        fresh = open_[high]
        low, high = low[fresh], high[fresh]
        open_[high] = False
        if length == 0:  # each separator is a string of one symbol too
            low, high = np.append(low, np.arange(heads)), np.append(high, np.arange(1, heads + 1))
    return open_[1:n]


def equal_windows(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, text number and offset of each substring of `least` bytes that occurs at two places or more of texts."""
    lengths = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    stops = np.cumsum(lengths + 1) - 1
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    ends = stops[text]
    order = suffix_order(data, ends)
    same = long_prefixes(data, order, ends, least)
    member = np.zeros(len(order), bool)
    member[1:] = same
    member[:-1] |= same
    label = np.cumsum(np.concatenate([[True], ~same]))
    at = order[member]
    return label[member], text[at], at - (stops[text[at]] - lengths[text[at]])
