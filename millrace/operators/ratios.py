"""The best sequence ratio of each name among many others, by exact bounds over whole blocks of names; no pair is written."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

#: Numbers that a pair of letters is hashed to; names looked at together.
DIMENSIONS, NAMES, OTHERS = 256, 2048, 4096
_LETTERS = 28


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all names one after the other, each between two marks, and the length of each."""
    return np.frombuffer("".join(f"\x02{x}\x03" for x in names).encode("utf-32-le"), dtype=np.uint32), np.array([len(x) for x in names])


def gram_counts(names: list[str]) -> np.ndarray:
    """How often each (hashed) pair of neighbouring letters stands in each name with its marks."""
    codes, lengths = _codes(names)
    row = np.repeat(np.arange(len(names)), lengths + 2)
    inside = row[:-1] == row[1:]
    hashed = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    return np.bincount(row[:-1][inside] * DIMENSIONS + hashed[inside], minlength=len(names) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)


def _letters(names: list[str]) -> np.ndarray:
    """Letters as small numbers, one name a line; names end in a number that no letter has. Folding letters together only raises bounds."""
    codes, lengths = _codes(names)
    out = np.full((len(names), int(lengths.max(initial=0)) + 2), _LETTERS, dtype=np.uint8)
    out[np.arange(out.shape[1])[None, :] < (lengths + 2)[:, None]] = codes % _LETTERS
    out[np.arange(len(names)), lengths + 1] = _LETTERS
    return out[:, 1:]


def _masks(letters: np.ndarray) -> np.ndarray:
    """For each name and letter the bits of the places where it stands."""
    out = np.zeros((len(letters), _LETTERS + 1), dtype=np.uint64)
    rows = np.arange(len(letters))
    for i in range(min(64, letters.shape[1])):
        out[rows, letters[:, i]] |= np.uint64(1) << np.uint64(i)
    out[:, _LETTERS] = 0
    return out


def common_letters(masks: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair: no matching blocks hold more. Names of 64 letters and more count as common."""
    left = np.full(len(masks), np.uint64(0xFFFFFFFFFFFFFFFF))
    rows = np.arange(len(masks))
    for i in range(letters.shape[1]):
        hit = left & masks[rows, letters[:, i]]
        left = (left + hit) | (left - hit)
    own = (np.uint64(1) << np.minimum(lengths, 63).astype(np.uint64)) - np.uint64(1)
    return np.where(lengths < 64, np.bitwise_count(~left & own).astype(np.int64), lengths)


def _candidates(names: list[str], others: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of all pairs whose ratio can be ``least``, with an upper bound of it.

    M common letters in order leave at least 3 M - la - lb + 1 pairs of neighbours (marks counted) to both names: a letter
    without a partner spoils two pairs of its own name and one of the other. A product of counts is never below what is common.
    """
    la, lb = np.array([len(x) for x in names]), np.array([len(x) for x in others])
    a_order, b_order = np.argsort(la, kind="stable"), np.argsort(lb, kind="stable")
    for b0 in range(0, len(others), OTHERS):
        b = b_order[b0 : b0 + OTHERS]
        theirs = [others[j] for j in b]
        b_grams, b_letters, b_len = gram_counts(theirs), _letters(theirs), lb[b]
        for a0 in range(0, len(names), NAMES):
            a = a_order[a0 : a0 + NAMES]
            a_len = la[a]
            if a_len[-1] * (2 - least) < b_len[0] * least - 1e-6 or a_len[0] * least > b_len[-1] * (2 - least) + 1e-6:
                continue
            own = [names[i] for i in a]
            a_grams, a_masks = gram_counts(own), _masks(_letters(own))
            for length in np.unique(a_len).tolist():
                s, e = np.searchsorted(a_len, length), np.searchsorted(a_len, length, side="right")
                t, u = np.searchsorted(b_len, length * least / (2 - least) - 1e-6), np.searchsorted(b_len, length * (2 - least) / least + 1e-6, side="right")
                if t == u:
                    continue
                both = length + b_len[t:u]
                need = 3 * np.ceil(least * both / 2 - 1e-9) - both + 1
                i, j = np.nonzero(a_grams[s:e] @ b_grams[t:u].T >= need.astype(np.float32) - 0.5)
                for k in range(0, len(i), 1 << 18):
                    x, y = s + i[k : k + (1 << 18)], t + j[k : k + (1 << 18)]
                    bound = 2.0 * np.minimum(common_letters(a_masks[x], a_len[x], b_letters[y]), b_len[y]) / (a_len[x] + b_len[y])
                    keep = bound >= least - 1e-9
                    yield a[x[keep]], b[y[keep]], bound[keep]


def best_partners(names: list[str], others: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, ratio): for each name the one of ``others`` with the greatest sequence ratio of ``least`` or more, the first of
    equals; place -1 if there is none."""
    place, ratio = np.full(len(names), -1), np.zeros(len(names))
    for i, j, bound in _candidates(names, others, least):
        for k in np.lexsort((j, -bound, i)).tolist():
            x, y = int(i[k]), int(j[k])
            if bound[k] < ratio[x] - 1e-12:
                continue
            r = difflib.SequenceMatcher(None, names[x], others[y]).ratio()
            if r >= least and (r > ratio[x] or (r == ratio[x] and y < place[x])):
                place[x], ratio[x] = y, r
    return place, ratio
