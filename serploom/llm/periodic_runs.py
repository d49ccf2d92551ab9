"""Runs: maximal stretches of words that repeat themselves, found in an enhanced suffix array.

Words of a text are numbered; prefix doubling sorts the suffixes and keeps the ranks of every doubling, which
answer any longest-common-extension question and give the LCP values. A stack over the LCP values yields the
LCP intervals as plain bounds, no tree nodes. For every interval of depth D the suffixes of all children but
the largest are tested: if ``ISA[i + D]`` or ``ISA[i - D]`` lies in the interval but in another child, a
branching square of period D stands there, that is the last square of a run. Squares are rotated to the left
as far as the period goes, and those that end in the same run under a multiple of its period are merged.

A run is reported if its length is at least ``min_length`` words and ``min_exponent`` periods. Such a run holds
two equal stretches of ``window`` words, so a text without equal stretches of that length has none and needs
no suffix array; this test may only err towards building one.

Defined results: words stand between ASCII white space, case matters; a null or empty text has no words, no
runs and an empty rest; rows with equal texts have equal results; extra columns stay untouched; an existing
column of the output's name is refused. A text is one cell and is held by one task, which takes some
4 log2(n) + 100 bytes for each of its n words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serploom.llm.common import WordHashes, bytes_of, refused, windows_hash

MIN_LENGTH = 6
MIN_EXPONENT = 4

RESULT = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"

#: suffixes expanded at a time
_PAIRS = 1 << 20


def needed(period: int, min_length: int, min_exponent: float) -> int:
    return max(min_length, math.ceil(min_exponent * period))


def window(min_length: int, min_exponent: float) -> int:
    """Words that two places of any reported run have in common at least."""
    periods = range(1, max(2, math.ceil(min_length / min_exponent) + 2))
    return max(1, min(needed(q, min_length, min_exponent) - q for q in periods))


def doubled_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Level j ranks the suffixes by their first 2**j words: equal ranks mean equal words. The last level has no ties."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(ids[order[1:]], ids[order[:-1]], out=fresh[1:])
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, sizes)
    levels = [rank.astype(np.int32)]
    tied = order[np.repeat(sizes > 1, sizes)]
    k = 1
    while len(tied):
        second = np.zeros(len(tied), np.int64)
        inside = tied + k < n
        second[inside] = rank[tied[inside] + k] + 1
        key = rank[tied] * (n + 1) + second
        place = np.argsort(key, kind="stable")
        tied, key = tied[place], key[place]
        old = rank[tied]
        new_part = np.empty(len(tied), bool)
        new_part[0] = True
        np.not_equal(key[1:], key[:-1], out=new_part[1:])
        new_group = np.empty(len(tied), bool)
        new_group[0] = True
        np.not_equal(old[1:], old[:-1], out=new_group[1:])
        at = np.arange(len(tied))
        parts = np.flatnonzero(new_part)
        sizes = np.diff(np.append(parts, len(tied)))
        part_start = np.repeat(parts, sizes)
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[tied] = old + part_start - group_start
        levels.append(rank.astype(np.int32))
        tied = tied[np.repeat(sizes > 1, sizes)]
        k *= 2
    return levels


def equal_stretches(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` words from a and from b are the same (both lie inside the text)."""
    level = np.floor(np.log2(length)).astype(np.int64)
    same = level < len(levels)
    for j in np.unique(level[same]):
        of = np.flatnonzero(same & (level == j))
        back = length[of] - (1 << int(j))
        r = levels[j]
        same[of] = (r[a[of]] == r[b[of]]) & (r[a[of] + back] == r[b[of] + back])
    return same


def lcp_values(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in order (0 for the first)."""
    n = len(suffixes)
    out = np.zeros(n, np.int64)
    of = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b, common = suffixes[of], suffixes[of + 1], np.zeros(len(of), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        met = np.zeros(len(of), bool)
        met[inside] = levels[j][x[inside]] == levels[j][y[inside]]
        common[met] += 1 << j
    out[of + 1] = common
    return out


def smaller_children(lcp: list[int], deepest: int, fewest: int) -> list[tuple[int, int, int, int, int]]:
    """(first, last, depth, left, right): all children but the largest of each LCP interval with at most that depth
    and at least so many suffixes."""
    out, stack = [], []
    lcp.append(0)
    for r in range(1, len(lcp)):
        depth, left = lcp[r], r - 1
        while stack and stack[-1][0] > depth:
            d, left, splits = stack.pop()
            if d <= deepest and r - left >= fewest:
                bounds = [left, *splits, r]
                largest = max(range(len(bounds) - 1), key=lambda c: bounds[c + 1] - bounds[c])
                out += [(bounds[c], bounds[c + 1] - 1, d, left, r - 1) for c in range(len(bounds) - 1) if c != largest]
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(r)
            else:
                stack.append((depth, left, [r]))
    return out


def branching_squares(suffixes: np.ndarray, inverse: np.ndarray, children: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of each square whose suffixes lie in different children of the interval of that depth."""
    n, starts, periods = len(suffixes), [], []
    table = np.array(children, np.int64).reshape(-1, 5)
    sizes = table[:, 1] - table[:, 0] + 1
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(_PAIRS, int(sizes.sum()) + _PAIRS, _PAIRS), side="left") + 1
    begin = 0
    for end in np.unique(np.minimum(cuts, len(table))):
        part, size = table[begin:end], sizes[begin:end]
        begin = end
        if not len(part):
            continue
        first, last, depth, left, right = (np.repeat(part[:, c], size) for c in range(5))
        at = np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + first
        i = suffixes[at]
        for partner, start in ((i + depth, i), (i - depth, i - depth)):
            ok = (partner >= 0) & (partner < n)
            r = inverse[np.where(ok, partner, 0)]
            ok &= (r >= left) & (r <= right) & ((r < first) | (r > last))
            starts.append(start[ok])
            periods.append(depth[ok])
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.empty(0, np.int64),) * 2


def rotated_left(ids: np.ndarray, at: int, period: int) -> int:
    """The first word of the stretch that has the period and goes through ``at``."""
    step = 64
    while at:
        low = max(0, at - step)
        other = np.flatnonzero(ids[low:at] != ids[low + period : at + period])
        if len(other):
            return low + int(other[-1]) + 1
        at, step = low, step * 2
    return 0


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    deepest = int(n / min_exponent)
    if n < needed(1, min_length, min_exponent):
        return []
    levels = doubled_ranks(ids)
    inverse = levels[-1].astype(np.int64)
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    children = smaller_children(lcp_values(levels, suffixes).tolist(), deepest, max(2, int(min_exponent)))
    start, period = branching_squares(suffixes, inverse, children)
    least = np.maximum(min_length, np.ceil(min_exponent * period).astype(np.int64))
    back = start + 2 * period - least
    ok = back >= 0
    start, period, back, least = start[ok], period[ok], back[ok], least[ok]
    ok = equal_stretches(levels, back, back + period, least - period)
    found: dict[int, list[tuple[int, int]]] = {}  # end -> (start, period), smallest period first
    for q, p, b in sorted(set(zip(period[ok].tolist(), start[ok].tolist(), back[ok].tolist(), strict=True))):
        known = found.setdefault(p + 2 * q, [])
        if not any(q % smaller == 0 and b >= s for s, smaller in known):
            known.append((rotated_left(ids, b, q), q))
    return sorted((s, e - s, q) for e, of in found.items() for s, q in of)


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def planted(words: list[bytes], seed: int) -> list[bytes]:
    """The words from a place on, replaced by a repetition of known place and period."""
    n = len(words)
    if not n:
        return words
    a = seed % n
    p = 1 + (n - a) // (3 + seed % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in keep.tolist()]


def with_runs(
    docs: DataFrame, text: str = "text", out: str = "runs", min_length: int = MIN_LENGTH, min_exponent: float = MIN_EXPONENT,
    plant: Column | None = None,
) -> DataFrame:
    """Adds the struct RESULT. ``plant``: a number, or null, per row; a number sets a repetition of known place (``planted``)
    into the text's words before they are searched, to see what the search finds."""
    refused(docs, out)
    equal_words = window(min_length, min_exponent)
    hashes = WordHashes()

    @F.arrow_udf(returnType=RESULT)
    def found(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        counts, runs, rest = [], [], []
        for t, seed in zip(texts, seeds, strict=True):
            words = t.as_py().split()
            if seed.is_valid:
                words = planted(words, seed.as_py())
            counts.append(len(words))
            windows = windows_hash(hashes(words), equal_words)
            windows.sort()
            of = []
            if len(windows) > 1 and (windows[1:] == windows[:-1]).any():
                of = runs_of(numbered(words), min_length, min_exponent)
                if of:
                    words = kept_words(words, of)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in of])
            rest.append(b" ".join(words))
        run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        arrays = [pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(rest, pa.binary())]
        return pa.StructArray.from_arrays(arrays, names=["n_words", "runs", "collapsed"])

    seed = F.lit(None).cast("bigint") if plant is None else plant.cast("bigint")
    return docs.withColumn(out, found.asNondeterministic()(bytes_of(F.col(text)), seed))


def longest(runs: Column) -> Column:
    """Struct length, start, period of the longest run, of equal ones that of the smallest start, then period (none: null)."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.struct(best.length.alias("length"), (-best.start).alias("start"), (-best.period).alias("period"))
