"""Greedy string tiling of two word sequences by running Karp-Rabin matching."""

from heapq import heapify, heappop, heappush

import numpy as np

from newsloom.llm.bytewords import mixed

FIRST_SEARCH = 16
_BASE = 0xD1342543DE82EF95


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all windows of ``size`` words: differences of one running sum, shifted back."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = np.full(len(words), _BASE, np.uint64)
    down = np.full(len(words), pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * up, dtype=np.uint64)])
    return (total[size:] - total[:-size]) * down[:n]


def tiles(text: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in text, place in pattern, length)``: matches of ``least`` words or more that share no word.

    The longest match is marked first, of equal ones the one that begins first in the pattern, then in the text. Windows of the search length are met by their hashes, compared
    and drawn out to maximal matches between unmarked words; a match over twice the search length
    starts the search anew with that length, otherwise the length is halved down to ``least``.
    """
    a, b = text.tolist(), pattern.tolist()
    free_a, free_b = [True] * len(a), [True] * len(b)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(FIRST_SEARCH, len(b)))
    while True:
        longest, matches = _maximal_matches(text, pattern, a, b, free_a, free_b, size)
        if longest > 2 * size:
            size = longest
            continue
        # What is left of a match that others have cut goes back among the rest by its length.
        queue = [(-length, j, i) for i, j, length in matches]
        heapify(queue)
        while queue:
            length, j, i = heappop(queue)
            length = -length
            taken = [not (free_a[i + k] and free_b[j + k]) for k in range(length)]
            if not any(taken):
                found.append((i, j, length))
                free_a[i : i + length] = free_b[j : j + length] = [False] * length
                continue
            start = 0
            for k in range(length + 1):
                if k == length or taken[k]:
                    if k - start >= size:
                        heappush(queue, (start - k, j + start, i + start))
                    start = k + 1
        if size == least:
            return found
        size = max(least, size // 2)


def _maximal_matches(text, pattern, a, b, free_a, free_b, size):
    """The longest match and all maximal matches of ``size`` words or more between unmarked words."""
    table: dict[int, list[int]] = {}
    for j, h in enumerate(_window_hashes(pattern, size).tolist()):
        table.setdefault(h, []).append(j)
    hashes = _window_hashes(text, size)
    hits = np.flatnonzero(np.isin(hashes, np.fromiter(table, np.uint64, len(table)))).tolist()
    matches, longest = [], 0
    covered: dict[int, int] = {}  # by diagonal: up to where its last match goes
    for i in hits:
        for j in table[int(hashes[i])]:
            if covered.get(i - j, -1) > i:
                continue
            k = 0
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k >= size:
                covered[i - j] = i + k
                matches.append((i, j, k))
                longest = max(longest, k)
                if k > 2 * size:
                    return longest, matches
    return longest, matches


def covered_words(text: np.ndarray, pattern: np.ndarray, least: int) -> tuple[int, int, int]:
    """How many words of ``pattern`` the tiles cover, how many tiles there are, and the longest one."""
    lengths = [length for _, _, length in tiles(text, pattern, least)]
    return sum(lengths), len(lengths), max(lengths, default=0)
