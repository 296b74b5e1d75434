"""Guess cost of a value: log10 of the guesses of its cheapest segmentation into words, dates, repeats, walks and brute force.

Segments, with v in lower case unless said otherwise; each segment after the first has a further charge:

* word: log10 of its rank; 0.4 more unless all lower case or capitalised; 0.6 more (instead) if found with digits read as letters;
* date: eight digits with or without separators, year first or last, or a year alone;
* repeat: a whole number of times (two; three for one character) the same primitive unit. The unit costs its brute force or the
  guess cost of the unit at the left end of the longest stretch with this period, where log10 of the unit's length is added if the
  repeat begins elsewhere in the cycle. log10 of the times is added;
* walk: three or more steps to neighbouring keys or characters: log10 47 + 0.3 + log10 of the length;
* brute force: the sum of its characters' costs.

Every length of every kind is tried. Repeats and walks of all lengths come from one stack for each stretch (and place in its cycle):
their cost grows with the log of the length, so that an earlier start, once cheaper than a later one, stays cheaper, and most starts are
dropped for good. Stretches with a period are found from Lyndon roots (longest Lyndon words under both orders of characters). So time
is about proportional to the length times its log, for values of any length; no part is skipped.

Defined results: the empty value costs 0. Characters whose lower case is longer than one character stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import log10

import numpy as np

KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_DAY, _MONTH, _YEAR, _SEP = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]", "[-/.]?"
#: Forms of dates and the log10 of how many there are.
DATES = (
    (re.compile(_YEAR + _SEP + _MONTH + _SEP + _DAY), log10(366 * 120)),
    (re.compile(_DAY + _SEP + _MONTH + _SEP + _YEAR), log10(366 * 120)),
    (re.compile(_YEAR), log10(120)),
)
LEET = str.maketrans("@4310$5!7", "aaeiossit")
WALK_COST = log10(47) + 0.3
INFINITE = float("inf")


def _neighbours() -> set[tuple[str, str]]:
    pairs = set()
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c + 1), (r + 1, c), (r + 1, c - 1)):
                if rr < len(KEY_ROWS) and 0 <= cc < len(KEY_ROWS[rr]):
                    other = KEY_ROWS[rr][cc]
                    pairs |= {(key, other), (other, key)}
    return pairs


NEAR = _neighbours()


def is_step(a: str, b: str) -> bool:
    return (a, b) in NEAR or abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


def character_cost(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() and c.isascii() else log10(33)


def lowered(value: str) -> str:
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def word_cost(part: str, ranks: Mapping[str, int]) -> float:
    """Infinite if the part is no word."""
    low = lowered(part)
    rank, extra = ranks.get(low), 0.0 if part in (low, part.capitalize()) else 0.4
    if rank is None:
        rank, extra = ranks.get(low.translate(LEET)), 0.6
    return INFINITE if rank is None else log10(rank) + extra


class Starts:
    """Starts of segments that cost a fixed sum plus log10(length / unit); gives the cheapest for ends in ascending order."""

    def __init__(self, unit: int):
        self.unit = unit
        self.kept: list[tuple[int, float]] = []  # costs ascend with the starts

    def _overtakes(self, early: tuple[int, float], late: tuple[int, float]) -> float:
        """The end from which the earlier start is the cheaper one."""
        ratio = 10 ** min(late[1] - early[1], 300.0) - 1
        return late[0] + (late[0] - early[0]) / ratio if ratio > 0 else INFINITE

    def _cost(self, start: tuple[int, float], end: int) -> float:
        return start[1] + log10((end - start[0]) / self.unit)

    def add(self, at: int, cost: float) -> None:
        kept, new = self.kept, (at, cost)
        while kept and kept[-1][1] >= cost:
            kept.pop()
        while len(kept) > 1 and self._overtakes(kept[-2], kept[-1]) <= self._overtakes(kept[-1], new):
            kept.pop()
        kept.append(new)

    def cheapest(self, end: int) -> float:
        kept = self.kept
        while len(kept) > 1 and self._cost(kept[-2], end) <= self._cost(kept[-1], end):
            kept.pop()
        return self._cost(kept[-1], end)


def _suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, by doubling; the end of the text is below every character."""
    n, width = len(codes), 1
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    while width < n and ranks.max() < n:
        after = np.zeros(n, np.int64)
        after[:-width] = ranks[width:]
        ranks = np.unique(ranks * (n + 1) + after, return_inverse=True)[1] + 1
        width *= 2
    return ranks


def _agree(text: str, a: int, b: int) -> int:
    """How many characters from place a on equal those from b on; a < b."""
    same, width, n = 0, 1, len(text)
    while width:
        if b + same + width <= n and text[a + same : a + same + width] == text[b + same : b + same + width]:
            same += width
            width *= 2
        else:
            width //= 2
    return same


def repetitions(text: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of every maximal stretch that holds its smallest period twice or more."""
    n, back, found = len(text), text[::-1], set()
    if len(set(text)) == n:
        return []
    codes = np.array([ord(c) for c in text], np.int64)
    for order in (codes, -codes):
        ranks, after, stack = _suffix_ranks(order).tolist(), [n] * n, []
        for i in range(n - 1, -1, -1):
            while stack and ranks[stack[-1]] > ranks[i]:
                stack.pop()
            after[i] = stack[-1] if stack else n
            stack.append(i)
        known: dict[int, int] = {}  # period: end of its last stretch
        for i, j in enumerate(after):
            period = j - i  # of the longest Lyndon word that begins here
            if j > known.get(period, 0):  # not inside a stretch that is known
                end = j + _agree(text, i, j)
                start = i - _agree(back, n - j, n - i) if i else 0
                if end - start >= 2 * period:
                    found.add((start, end, period))
                    known[period] = end
    return sorted(found)


def guess_cost(value: str, ranks: Mapping[str, int], segment_cost: float) -> float:
    n = len(value)
    if not n:
        return 0.0
    low = lowered(value)
    plain = low.translate(LEET)
    longest = longest_key(ranks)
    single = [character_cost(c) for c in value]
    lower_sums = np.concatenate([[0.0], np.cumsum([character_cost(c) for c in low])]).tolist()
    opening: dict[int, list] = {}
    for start, end, period in repetitions(low):
        brute_unit = lower_sums[start + period] - lower_sums[start]
        unit = brute_unit if period == 1 else min(brute_unit, guess_cost(value[start : start + period], ranks, segment_cost))
        least = 2 * period if period > 1 else 3
        if start + least <= end:
            shifted = min(brute_unit, unit + log10(period))
            opening.setdefault(start + least, []).append((start, end, period, least, unit, shifted, {}))
    best = [INFINITE] * (n + 1)
    best[0] = 0.0
    brute, walked, walk, active = INFINITE, 0, Starts(1), []

    def charged(at: int) -> float:
        return best[at] + segment_cost if at else 0.0

    for i in range(n + 1):
        if i:
            # Segments that end here; words and dates have been offered from their starts.
            brute = min(charged(i - 1), brute) + single[i - 1]
            best[i] = min(best[i], brute)
            if i > 1 and not is_step(low[i - 2], low[i - 1]):
                walked, walk = i - 1, Starts(1)
            if i - walked >= 3:
                walk.add(i - 3, charged(i - 3) + WALK_COST)
                best[i] = min(best[i], walk.cheapest(i))
            active = [a for a in active if a[1] >= i] + opening.get(i, [])
            for start, _, period, least, unit, shifted, cycle in active:
                at = i - least
                place = (at - start) % period
                starts = cycle.setdefault(place, Starts(period))
                starts.add(at, charged(at) + (shifted if place else unit))
                best[i] = min(best[i], starts.cheapest(i))
        charge = charged(i)
        for end in range(i + 1, min(n, i + longest) + 1):
            if not plain[end - 1].isalpha():  # no word holds it, in either reading
                break
            if end - i >= 3 and (cost := word_cost_at(value, low, plain, i, end, ranks)) + charge < best[end]:
                best[end] = cost + charge
        if i < n and low[i].isdigit():
            for form, cost in DATES:
                if m := form.match(value, i):
                    best[m.end()] = min(best[m.end()], charge + cost)
    return best[n]


def word_cost_at(value: str, low: str, plain: str, start: int, end: int, ranks: Mapping[str, int]) -> float:
    """``word_cost`` of a part, without lowering it again unless it is a word."""
    if low[start:end] in ranks or plain[start:end] in ranks:
        return word_cost(value[start:end], ranks)
    return INFINITE


_LONGEST: dict[int, tuple[Mapping, int]] = {}


def longest_key(ranks: Mapping[str, int]) -> int:
    """Length of the longest word; found once for each vocabulary object."""
    known = _LONGEST.get(id(ranks))
    if known is None or known[0] is not ranks:
        known = _LONGEST[id(ranks)] = (ranks, max(map(len, ranks), default=0))
    return known[1]
