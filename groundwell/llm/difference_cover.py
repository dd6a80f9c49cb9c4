"""Suffix sorting by a difference cover, for one part of a corpus in memory.

The places whose number modulo 3 is 1 or 2 are the sample. Their triples of characters are sorted
and named; if names repeat, the string of names is sorted by recursion, which gives the rank of each
sample suffix. The remaining suffixes are sorted by their first character and the rank of the suffix
behind it, and merged: against a sample suffix, one or two characters and a rank decide.
"""

from __future__ import annotations

import numpy as np


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct keys, and their number."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def suffix_order(chars: np.ndarray) -> np.ndarray:
    """The places of ``chars`` (int64, each from 1 to 2**31) in the order of the suffixes that begin there."""
    n = len(chars)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: chars[i:].tolist()), np.int64)
    text = np.concatenate([chars, np.zeros(3, np.int64)])
    top = int(chars.max()) + 1
    # With a place behind the end, a suffix of the first kind always stands behind one of the remaining.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    pairs = text[sample] * top + text[sample + 1]
    if top**3 < 1 << 62:
        names, count = _named(pairs * top + text[sample + 2])
    else:
        names, count = _named(_named(pairs)[0] * top + text[sample + 2])
    if count < len(sample):
        order = suffix_order(names + 1)
        rank_in_sample = np.empty(len(sample), np.int64)
        rank_in_sample[order] = np.arange(len(sample))
    else:
        rank_in_sample = names
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = rank_in_sample + 1
    m = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest_keys = text[rest] * m + rank[rest + 1]
    by_key = np.argsort(rest_keys)
    rest, rest_keys = rest[by_key], rest_keys[by_key]
    # How many sample suffixes of either kind are smaller than each remaining one.
    before = np.searchsorted(np.sort(text[one] * m + rank[one + 1]), rest_keys)
    heads, _ = _named(np.concatenate([text[two] * top + text[two + 1], text[rest] * top + text[rest + 1]]))
    behind = heads * m + np.concatenate([rank[two + 2], rank[rest + 2]])
    before += np.searchsorted(np.sort(behind[: len(two)]), behind[len(two) :])
    out = np.full(n + len(sample) - (n - len(rest)), -1, np.int64)
    out[np.arange(len(rest)) + before] = rest
    sorted_sample = np.empty(len(sample), np.int64)
    sorted_sample[rank_in_sample] = sample
    out[out < 0] = sorted_sample
    return out[out < n]


def equal_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of places in suffix order, those whose ``length`` bytes equal those of a neighbour. Each place has that many bytes."""
    if len(order) < 2:
        return order[:0]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view("<u8").ravel()
    left = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        left = left[wide[order[left] + at] == wide[order[left + 1] + at]]
    same = np.zeros(len(order), bool)
    same[left] = same[left + 1] = True
    return order[same]
