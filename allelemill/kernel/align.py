"""All minimal alignments of two sequences, from tables of longest-common-subsequence lengths.

With F[i, j] the length for the first i and j symbols and B[i, j] that for what follows, a cell (i, j) is a match of some
minimal alignment if its symbols agree and F[i, j] + 1 + B[i+1, j+1] is the whole length; its rank is F[i, j]. All other
results (unit edits, the spanning edit, edges, walks, normal forms) follow from the tables and the cells.

Minimal alignments leave the diagonals by no more than they delete and insert, so a band of that width has them all. Only
some rows of the forward table are kept; blocks of rows between them are made again, from the last block to the first, while
the backward table is rolled along. So there is no size beyond which an alignment is refused.
"""

from __future__ import annotations

import array
import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

PAD = 4
#: Cells of a block of rows, about; symbols of two windows up to which plain tables are used.
BLOCK_CELLS, SHORT = 1 << 22, 160
#: What is told of windows is remembered: of those of SMALL symbols together this often, of other short ones so often.
SMALL, REMEMBERED, SELDOM = 40, 1 << 17, 1 << 12
#: Symbols that an edit deletes and inserts up to which all its interleavings (70 at most) are remembered.
FEW = 8
#: Symbols beside a difference in the first window that is told of.
NEAR = 2
#: Edits up to which the spanning edit of long texts is told by furthest-reaching points.
FEW_EDITS = 16


class Edit(NamedTuple):
    """[start, end) of the reference is replaced by sequence."""

    start: int
    end: int
    sequence: str


class DistanceExceeded(ValueError):
    pass


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions and deletions that turn a into b; over `most` of them raise.

    Short texts by bits; of others furthest-reaching fronts tell while they are cheaper, which few edits of long texts are.
    """
    if len(a) + len(b) <= SHORT:
        distance = len(a) + len(b) - 2 * _common(a, b)
    else:
        distance = _fronts(a, b, most)
    if most is not None and distance > most:
        raise DistanceExceeded("more than the distance allowed")
    return distance


def _fronts(a: str, b: str, most: int | None = None) -> int:
    """The distance by fronts on diagonals (Wu et al., 1990): how far alignments get that delete p symbols of the shorter text.

    A front's step is a run of equal symbols, told by halving. Where the fronts would cost more than the pass by bits, that follows;
    with a bound they end as soon as no alignment within it can be.
    """
    if len(a) > len(b):
        a, b = b, a
    n, gap = len(a), len(b) - len(a)
    reach = {-1: -1}  # on the diagonal (place in b less place in a): the furthest place in b
    # A step costs about as much as some 40 symbols of the pass by bits, whose cost grows with both lengths.
    steps, enough = 0, n * (1 + n // 4000) // 40 if most is None else None

    def step(k: int) -> None:
        y = max(reach.get(k - 1, -1) + 1, reach.get(k + 1, -1))
        reach[k] = y + _run(a, b, y - k, y)

    p = 0
    while True:
        if most is not None and gap + 2 * p > most:
            raise DistanceExceeded("more than the distance allowed")
        for k in (*range(-p, gap), *range(gap + p, gap - 1, -1)):
            step(k)
        if reach[gap] >= len(b):
            return gap + 2 * p
        steps += gap + 2 * p + 1
        if enough is not None and steps > enough:
            return len(a) + len(b) - 2 * _common(a, b)
        p += 1


def _run(a: str, b: str, i: int, j: int) -> int:
    """How many symbols of a from i on agree with those of b from j on: pieces of twice the size until one differs, then its half."""
    most = min(len(a) - i, len(b) - j)
    done, size = 0, 8
    while done < most and a[i + done : i + min(done + size, most)] == b[j + done : j + min(done + size, most)]:
        done, size = min(done + size, most), size * 2
    while size and done < most:
        size //= 2
        end = min(done + size, most)
        if size and a[i + done : i + end] == b[j + done : j + end]:
            done = end
    return done


def _common(a: str, b: str) -> int:
    places: dict[str, int] = {}
    for i, symbol in enumerate(a):
        places[symbol] = places.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full  # zero bits mark where the length grows
    for symbol in b:
        hit = state & places.get(symbol, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def common_ends(a: str, b: str) -> tuple[int, int]:
    """Length of the common prefix, and of the common suffix of what remains of both; by halving."""
    n = min(len(a), len(b))
    if n <= SHORT:
        front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), n)
        return front, next((i for i, (x, y) in enumerate(zip(a[:front - 1 if front else None:-1], b[:front - 1 if front else None:-1])) if x != y), n - front)
    front = _agreeing(n, lambda k: a.startswith(b[:k]))
    return front, _agreeing(n - front, lambda k: k == 0 or a.endswith(b[-k:]))


def _agreeing(most: int, agrees) -> int:
    """The largest k up to most for which `agrees` holds (it holds for all smaller ones)."""
    low, step = 0, 1
    while step and low < most:
        k = min(low + step, most)
        if agrees(k):
            low, step = k, step * 2
        elif step > 1:
            step = max(1, min(step, k - low) // 2)
        else:
            break
    return low


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


#: Marks cells of a band that lie outside of the table.
_NONE = -(1 << 28)


class _Table:
    """Rows of common lengths: of all columns, or of a band of `width` columns that begins `gone` before the row's own."""

    def __init__(self, a: np.ndarray, b: np.ndarray, gone: int | None, width: int):
        self.a, self.b, self.gone, self.width = a, b, gone, width
        if gone is not None:
            padded = np.full(len(a) + width + gone + len(b), -1, dtype=np.int64)
            padded[gone : gone + len(b)] = b
            self.facing = np.lib.stride_tricks.sliding_window_view(padded, width)  # the symbol after each cell, -1 outside

    def first(self) -> np.ndarray:
        if self.gone is None:
            return np.zeros(self.width, dtype=np.int32)
        column = np.arange(self.width) - self.gone
        return np.where((column >= 0) & (column <= len(self.b)), 0, _NONE).astype(np.int32)

    def rows(self, row: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows low to high, both included; `row` is row low."""
        out = np.empty((high - low + 1, self.width), dtype=np.int32)
        out[0] = row
        for k, i in enumerate(range(low, high)):
            here, there = out[k], out[k + 1]
            if self.gone is None:
                there[0] = 0
                np.maximum.accumulate(np.maximum(here[1:], here[:-1] + (self.b == self.a[i])), out=there[1:])
            else:
                best = here + (self.facing[i] == self.a[i])
                np.maximum(best[:-1], here[1:], out=best[:-1])
                np.maximum.accumulate(best, out=there)
                there[max(0, len(self.b) + self.gone - i) :] = _NONE
        return out

    def match(self, low: int, high: int) -> np.ndarray:
        """Whether the symbols after the cells of rows low to high (not included) agree."""
        if self.gone is None:
            return self.a[low:high, None] == self.b[None, :]
        return self.a[low:high, None] == self.facing[low:high]


def _lengths(a: str, b: str) -> list[list[int]]:
    """The table of common lengths, whole."""
    rows = [[0] * (len(b) + 1)]
    for symbol in a:
        above, row, best = rows[-1], [0], 0
        for j, other in enumerate(b):
            if symbol == other:
                best = above[j] + 1
            elif above[j + 1] > best:
                best = above[j + 1]
            row.append(best)
        rows.append(row)
    return rows


class Alignments:
    """All minimal alignments of a reference window and its observed counterpart; results are shifted by `shift`."""

    def __init__(self, reference: str, observed: str, shift: int = 0):
        self.a, self.b, self.shift = reference, observed, shift
        self._counted: dict[bool, dict[tuple[int, int], int]] = {}
        self.distance = edit_distance(reference, observed)
        self.length = (len(reference) + len(observed) - self.distance) // 2
        if len(reference) + len(observed) <= SHORT:
            self._fill()
        else:
            self._sweep(_codes(reference), _codes(observed))

    def _fill(self) -> None:
        """What `_sweep` finds, by whole tables of a few symbols, which take less time than calls of numpy for each row."""
        a, b, n, m, whole = self.a, self.b, len(self.a), len(self.b), self.length
        ahead, behind = _lengths(a, b), [row[::-1] for row in _lengths(a[::-1], b[::-1])[::-1]]
        matches, gaps, puts = [], [], []
        for i in range(n + 1):
            low = max(0, i - n + whole)  # the band's columns of this row
            high = min(m, i - n + whole + self.distance)
            front, here = ahead[i], behind[i]
            if i < n:
                below, symbol = behind[i + 1], a[i]
                matches += [(i, j, front[j]) for j in range(low, min(high + 1, m)) if b[j] == symbol and front[j] + 1 + below[j + 1] == whole]
                if any(front[j] + below[j] == whole for j in range(low, high + 1)):
                    gaps.append(i)
            puts += [(i, j) for j in range(low, min(high + 1, m)) if front[j] + here[j + 1] == whole]
        self.cells = [[] for _ in range(whole)]
        for i, j, rank in matches:
            self.cells[rank].append((i, j))
        self._gaps = array.array("q", gaps)
        self._puts = array.array("q", [i for i, _ in puts]), array.array("q", [j for _, j in puts])

    def _sweep(self, x: np.ndarray, y: np.ndarray) -> None:
        """Matches by row (arrays row, column, rank), deleted places and insertions (row, column), block by block."""
        n, whole = len(x), self.length
        banded = self.distance < len(y)
        gone, width = (n - whole, self.distance + 1) if banded else (None, len(y) + 1)
        ahead, behind = _Table(x, y, gone, width), _Table(x[::-1], y[::-1], gone, width)
        step = max(1, BLOCK_CELLS // width)
        kept, row = [], ahead.first()
        for low in range(0, max(n, 1), step):
            kept.append((low, row))
            if low + step < n:
                row = ahead.rows(row, low, low + step)[-1].copy()
        row = behind.first()
        matches, gaps, puts = [], [], []
        for low, first in reversed(kept):
            high = min(low + step, n)
            front = ahead.rows(first, low, high)
            back = behind.rows(row, n - high, n - low)
            row = back[-1]
            back = back[::-1, ::-1]
            last = high + (high == n)  # rows whose insertions are this block's
            if banded:
                hit = ahead.match(low, high) & (front[:-1] + 1 + back[1:] == whole)
                gap = (front[:-1, 1:] + back[1:, :-1] == whole).any(axis=1)
            else:
                hit = ahead.match(low, high) & (front[:-1, :-1] + 1 + back[1:, 1:] == whole)
                gap = (front[:-1] + back[1:] == whole).any(axis=1)
            put = front[: last - low, :-1] + back[: last - low, 1:] == whole
            i, k = np.nonzero(hit)
            matches.append((i + low, i + low + k - gone if banded else k, front[i, k]))
            gaps.append(np.flatnonzero(gap) + low)
            i, k = np.nonzero(put)
            puts.append((i + low, i + low + k - gone if banded else k))
        self._rows, self._columns, self._of = (np.concatenate([m[c] for m in reversed(matches)]) for c in range(3))
        self._gaps = np.concatenate(gaps[::-1])
        self._puts = tuple(np.concatenate([p[c] for p in reversed(puts)]) for c in range(2))

    @functools.cached_property
    def cells(self) -> list[list[tuple[int, int]]]:
        """The matches of each rank, by row."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.length)]
        for r, c, rank in zip(self._rows.tolist(), self._columns.tolist(), self._of.tolist(), strict=True):
            out[rank].append((r, c))
        return out

    def unit_edits(self) -> list[tuple[int, str]]:
        """Every single deletion (position, "") and insertion (position, symbol) of some minimal alignment, sorted."""
        found = {(i + self.shift, "") for i in self._gaps.tolist()}
        found |= {(i + self.shift, self.b[j]) for i, j in zip(*(p.tolist() for p in self._puts), strict=True)}
        return sorted(found)

    def spanning(self) -> Edit:
        """The one edit that spans all unit edits; 0:0/ if there are none."""
        if not self.distance:
            return Edit(0, 0, "")
        low = min([*self._gaps[:1].tolist(), *self._puts[0][:1].tolist()])
        high = max([*(g + 1 for g in self._gaps[-1:].tolist()), *self._puts[0][-1:].tolist()])
        return Edit(low + self.shift, high + self.shift, self.b[low : high + len(self.b) - len(self.a)])

    def _ranks(self) -> list[list[tuple[int, int]]]:
        return [[(-1, -1)], *self.cells, [(len(self.a), len(self.b))]]

    def _edit(self, p: tuple[int, int], q: tuple[int, int]) -> Edit:
        return Edit(p[0] + 1 + self.shift, q[0] + self.shift, self.b[p[1] + 1 : q[1]])

    def steps(self) -> Iterator[tuple[tuple[int, int], tuple[int, int], Edit]]:
        """Neighbouring matches of minimal alignments and the edit between them (empty where they adjoin)."""
        ranks = self._ranks()
        for here, there in zip(ranks, ranks[1:], strict=False):
            for p in here:
                for q in there:
                    if p[0] < q[0] and p[1] < q[1]:
                        yield p, q, self._edit(p, q)

    def edges(self) -> list[Edit]:
        """The distinct edits between neighbouring matches, sorted."""
        return list(self._edges)

    @functools.cached_property
    def _edges(self) -> list[Edit]:
        return sorted({e for _, _, e in self.steps() if e.start < e.end or e.sequence})

    @functools.cached_property
    def _after(self) -> dict[tuple[int, int], list[tuple[tuple[int, int], Edit]]]:
        """The matches that follow each match, in order, and the edits between."""
        out: dict[tuple[int, int], list] = {}
        for p, q, e in self.steps():
            out.setdefault(p, []).append((q, e))
        return out

    def _ways(self, atomics: bool) -> dict[tuple[int, int], int]:
        """How many ways lead from each match to the end."""
        if atomics in self._counted:
            return self._counted[atomics]
        ways = self._counted[atomics] = {(len(self.a), len(self.b)): 1}
        for rank in self._ranks()[-2::-1]:
            for p in rank:
                ways[p] = sum(ways[q] * (forms(e) if atomics else 1) for q, e in self._after.get(p, ()))
        return ways

    def walks(self, limit: int | None = None, atomics: bool = False, first: int = 0) -> Iterator[list[Edit]]:
        """Minimal alignments as lists of edits, one by one, from number `first` on, at most `limit` of them; there may be
        exponentially many. With atomics each edit in every way of single deletions and insertions, in the order of
        `interleavings`. A walk is made from its number and the counts of ways alone, so any range of them can be made anywhere."""
        ways, sink = self._ways(atomics), (len(self.a), len(self.b))
        total = ways[-1, -1]
        for number in range(first, total if limit is None else min(total, first + limit)):
            cell, edits, left = (-1, -1), [], number
            while cell != sink:
                for q, e in self._after[cell]:
                    own = ways[q] * (forms(e) if atomics else 1)
                    if left < own:
                        break
                    left -= own
                form, left = divmod(left, ways[q])
                if e.start < e.end or e.sequence:
                    edits += interleaving(e, form) if atomics else [e]
                cell = q
            yield edits

    def walk_count(self, atomics: bool = False) -> int:
        """How many minimal alignments there are."""
        return self._ways(atomics)[-1, -1]

    def _between(self, ranks: list[list[tuple[int, int]]]) -> list[Edit]:
        fixed = [cells[0] for cells in ranks if len(cells) == 1]
        return [e for e in (self._edit(p, q) for p, q in zip(fixed, fixed[1:], strict=False)) if e.start < e.end or e.sequence]

    def local_spanning(self) -> list[Edit]:
        """The edits between matches that all minimal alignments have."""
        return self._between(self._ranks())

    def canonical(self) -> list[Edit]:
        """The edits between matches that all alignments of fewest separate edits have."""
        ranks = self._ranks()
        ahead, behind = self._fewest(ranks), self._fewest([[(-r, -c) for r, c in cells] for cells in ranks[::-1]])
        least = ahead[len(self.a), len(self.b)]
        return self._between([[c for c in cells if ahead[c] + behind[-c[0], -c[1]] == least] for cells in ranks])

    @staticmethod
    def _fewest(ranks: list[list[tuple[int, int]]]) -> dict[tuple[int, int], int]:
        """Edits needed at least to reach each match from the first rank."""
        cost = {ranks[0][0]: 0}
        for here, there in zip(ranks, ranks[1:], strict=False):
            for q in there:
                cost[q] = min(cost[p] + (p != (q[0] - 1, q[1] - 1)) for p in here if p[0] < q[0] and p[1] < q[1])
        return cost

    def stretches(self) -> list[tuple[int, int, int]]:
        """Maximal diagonal runs of matches: (row, column, length), by row and column."""
        cells = {c for rank in self.cells for c in rank}
        out = []
        for r, c in sorted(cells):
            if (r - 1, c - 1) not in cells:
                n = 1
                while (r + n, c + n) in cells:
                    n += 1
                out.append((r + self.shift, c + self.shift, n))
        return out

    def diagonal(self) -> list[Edit]:
        """A greedy alignment: step by step the match on the closing diagonal, else the one nearest the main diagonal."""
        goal = len(self.a) - len(self.b)
        at, out = (-1, -1), []
        for rank in self._ranks()[1:]:
            reach = [q for q in rank if at[0] < q[0] and at[1] < q[1]]
            q = min(reach, key=lambda q: (q[0] - q[1] != goal, abs(q[0] - q[1])))
            e = self._edit(at, q)
            if e.start < e.end or e.sequence:
                out.append(e)
            at = q
        return out


def patched(reference: str, edits: list[Edit]) -> str:
    """The reference with sorted edits applied."""
    out, at = [], 0
    for e in edits:
        out += [reference[at : e.start], e.sequence]
        at = e.end
    return "".join([*out, reference[at:]])


def moved(edits, by: int):
    """Edits, or one of them, so many symbols further on."""
    if isinstance(edits, Edit):
        return Edit(edits.start + by, edits.end + by, edits.sequence)
    return [moved(e, by) for e in edits]


def windowed(reference: str, observed: str) -> Alignments:
    """Alignments of a window around the difference, wide enough that nothing outside takes part; those of small texts are remembered.

    The window begins with what differs and grows by doubling until the spanning edit lies inside of it.
    """
    return (_windowed_small if len(reference) + len(observed) <= SMALL else _windowed)(reference, observed)


def _windowed(reference: str, observed: str) -> Alignments:
    if reference == observed:
        return Alignments("", "")
    front, back = common_ends(reference, observed)
    pad = PAD
    while True:
        low, tail = max(0, front - pad), max(0, back - pad)
        found = Alignments(reference[low : len(reference) - tail], observed[low : len(observed) - tail], low)
        whole = found.spanning()
        if (whole.start > low or low == 0) and (whole.end < len(reference) - tail or tail == 0):
            return Alignments(reference[whole.start : whole.end], whole.sequence, whole.start)
        pad *= 2


_windowed_small = functools.lru_cache(SELDOM)(_windowed)


class Told(NamedTuple):
    """What a window tells of an allele, in the window's own places; wide: the spanning edit reaches an inner border (1 the
    first, 2 the last, 3 both)."""

    distance: int
    spanning: Edit
    canonical: tuple[Edit, ...]
    local_spanning: tuple[Edit, ...]
    units: tuple[tuple[int, str], ...]
    wide: int


def _spanning(a: str, b: str) -> tuple[int, Edit]:
    """Distance and spanning edit of two short texts: symbols at the ends that all minimal alignments match are outside.

    Up to the first place that some minimal alignment edits, all of them match equal places, so one cell of a row tells.
    """
    n, m = len(a), len(b)
    ahead, behind = _lengths(a, b), _lengths(a[::-1], b[::-1])  # behind from the ends: of the last symbols
    whole = ahead[n][m]
    if n == m == whole:
        return 0, Edit(0, 0, "")
    low = 0
    while not (low < n and low + behind[n - low - 1][m - low] == whole or low < m and low + behind[n - low][m - low - 1] == whole):
        low += 1
    tail = 0
    while not (tail < n and tail + ahead[n - tail - 1][m - tail] == whole or tail < m and tail + ahead[n - tail][m - tail - 1] == whole):
        tail += 1
    return n + m - 2 * whole, Edit(low, n - tail, b[low : m - tail])


def _beside(a: str, b: str, most: int) -> tuple[int, int] | None:
    """The distance of two texts that differ, and how many symbols at their ends all minimal alignments match; None beyond `most` edits.

    A minimal alignment edits k symbols before the ends exactly if what precedes that deletion or insertion has one edit less. Along a
    diagonal fewer symbols never need more edits, so the furthest points of one edit less, on the diagonals beside the one that ends both
    texts, tell the first such place (points by number of edits: Ukkonen, 1985; runs of equal symbols are told by halving).
    """
    n, m = len(a), len(b)
    goal, before = n - m, {}
    for edits in range(most + 1):
        reach = {}
        for k in range(max(-edits, -m + (m + edits) % 2), min(edits, n) + 1, 2):  # the diagonal: place in a less place in b
            x = min(max(before.get(k - 1, -2) + 1, before.get(k + 1, -2)), n, m + k) if edits else 0
            reach[k] = x + _run(a, b, x, x - k)
        if reach.get(goal) == n:
            return edits, min(n - 1 - before.get(goal - 1, -1), n - before.get(goal + 1, -1))
        before = reach
    return None


def few_edits(a: str, b: str, most: int = FEW_EDITS) -> tuple[int, Edit] | None:
    """Distance and spanning edit of two texts that differ, at a cost that hardly grows with their length; None beyond `most` edits."""
    found = _beside(a, b, most)
    if found is None:
        return None
    distance, tail = found
    low = _beside(a[::-1], b[::-1], most)[1]
    return distance, Edit(low, len(a) - tail, b[low : len(b) - tail])


def _core(a: str, b: str) -> tuple[tuple[Edit, ...], tuple[Edit, ...], tuple[tuple[int, str], ...]]:
    """Canonical and local edits and unit edits of a spanning edit's two texts."""
    core = Alignments(a, b)
    return tuple(core.canonical()), tuple(core.local_spanning()), tuple(core.unit_edits())


_small_core = functools.lru_cache(REMEMBERED)(_core)


def _tell(reference: str, observed: str, at_start: bool, at_end: bool, whole: bool) -> Told:
    if len(reference) + len(observed) <= SHORT:
        distance, edit = _spanning(reference, observed)
    elif few := few_edits(reference, observed):
        distance, edit = few
    else:
        spread = Alignments(reference, observed)
        distance, edit = spread.distance, spread.spanning()
    wide = (edit.start == 0 and not at_start) + 2 * (edit.end == len(reference) and not at_end)
    if wide or not whole:
        return Told(distance, edit, (), (), (), wide)
    old = reference[edit.start : edit.end]
    canonical, local, units = (_small_core if len(old) + len(edit.sequence) <= SMALL else _core)(old, edit.sequence)
    at = edit.start
    return Told(distance, edit, tuple(moved(canonical, at)), tuple(moved(local, at)), tuple((p + at, x) for p, x in units), 0)


_small, _short = functools.lru_cache(REMEMBERED)(_tell), functools.lru_cache(SELDOM)(_tell)


def _renamed(a: str, b: str, at_start: bool, at_end: bool, whole: bool) -> Told:
    """What is told of two short windows, through windows with the symbols named by order of appearance.

    Which symbols agree is all that alignments depend on, so windows that differ in names only are told of once.
    """
    symbols = dict.fromkeys(a + b)
    names = {ord(c): chr(k) for k, c in enumerate(symbols)}
    tell = _small if len(a) + len(b) <= SMALL else _short
    found, own = tell(a.translate(names), b.translate(names), at_start, at_end, whole), dict(enumerate(symbols))
    back = lambda e: Edit(e.start, e.end, e.sequence.translate(own))
    # The names' order is not the symbols'.
    units = tuple(sorted((p, x.translate(own)) for p, x in found.units))
    return Told(found.distance, back(found.spanning), tuple(map(back, found.canonical)), tuple(map(back, found.local_spanning)), units, found.wide)


_known = functools.lru_cache(SELDOM)(_renamed)


def near(reference: str, observed: str, front: int, back: int, at_start: bool = True, at_end: bool = True, whole: bool = True) -> tuple[int, Told] | None:
    """Where a window around the difference begins, and what it tells, in its own places; front and back are the common ends of
    the two texts, which differ.

    The window grows on the side on which the spanning edit reaches its border. More symbols outside never make that edit
    smaller, so None if it reaches the texts' own end, where the reference goes on.
    """
    before = after = NEAR
    size = len(reference)
    while True:
        low, tail = max(0, front - before), max(0, back - after)
        a, b = reference[low : size - tail], observed[low : len(observed) - tail]
        tell = _known if len(a) + len(b) <= SMALL else _renamed if len(a) + len(b) <= SHORT else _tell
        found = tell(a, b, low == 0 and at_start, tail == 0 and at_end, whole)
        if not found.wide:
            return low, found
        if found.wide & 1:
            if low == 0:
                return None
            before += max(2, before // 2)
        if found.wide & 2:
            if tail == 0:
                return None
            after += max(2, after // 2)


def told(reference: str, observed: str, at_start: bool = True, at_end: bool = True, whole: bool = True) -> Told | None:
    """Everything about an allele from a window of its reference and what the allele makes of it, in the window's places.

    at_start and at_end: whether the window ends where its reference does. None if the window is too narrow to tell. Alleles
    come with few different surroundings, so what is told of short windows is remembered. Without `whole` only the distance and
    the spanning edit.
    """
    if reference == observed:
        return Told(0, Edit(0, 0, ""), (), (), (), 0)
    placed = near(reference, observed, *common_ends(reference, observed), at_start, at_end, whole)
    if placed is None:
        return None
    at, found = placed
    return Told(found.distance, moved(found.spanning, at), tuple(moved(found.canonical, at)), tuple(moved(found.local_spanning, at)), tuple((p + at, x) for p, x in found.units), 0)


class Spans(NamedTuple):
    """Of many pairs of texts: the distance, where the spanning edit begins and ends, and whether the texts are too narrow to tell."""

    distance: np.ndarray
    low: np.ndarray
    high: np.ndarray
    narrow: np.ndarray


def spans(references: list[str], observed: list[str], at_start: list[bool], at_end: list[bool]) -> Spans:
    """The spanning edits of many windows and what the alleles make of them, all at once: what `near` tells of each.

    Windows around the differences of as many symbols as PADS says, the next larger one for those whose edit reaches a border; few
    are left to the whole texts.
    """
    size = len(references)
    out = Spans(*(np.zeros(size, dtype=np.int64) for _ in range(3)), np.zeros(size, dtype=bool))
    short = np.fromiter((max(len(a), len(b)) <= WIDTH for a, b in zip(references, observed, strict=True)), bool, size)

    def alone(k: int) -> None:
        a, b = references[k], observed[k]
        few = few_edits(a, b) if a != b else (0, Edit(0, 0, ""))
        if few and few[0] and (few[1].start == 0 and not at_start[k] or few[1].end == len(a) and not at_end[k]):
            out.narrow[k] = True
        elif few or (found := told(a, b, at_start[k], at_end[k], False)):
            distance, edit = few or found[:2]
            out.distance[k], out.low[k], out.high[k] = distance, edit.start, edit.end
        else:
            out.narrow[k] = True

    for k in np.flatnonzero(~short).tolist():
        alone(k)
    left = np.flatnonzero(short & np.fromiter((a != b for a, b in zip(references, observed, strict=True)), bool, size))
    if not len(left):
        return out
    x, n = _matrix([references[k] for k in left.tolist()])
    y, m = _matrix([observed[k] for k in left.tolist()])
    begins, ends = np.asarray(at_start, dtype=bool)[left], np.asarray(at_end, dtype=bool)[left]
    front = _agreement(_part(x, 0 * n, n, 0), _part(y, 0 * m, m, 1))
    back = np.minimum(_agreement(_part(x, n - 1, n, 0, -1), _part(y, m - 1, m, 1, -1)), np.minimum(n, m) - front)
    todo = np.arange(len(left))
    for pad in PADS:
        again = []
        width = int((np.maximum(n, m)[todo] - np.maximum(0, front[todo] - pad) - np.maximum(0, back[todo] - pad)).max(initial=1))
        block = max(1, BLOCK_CELLS // (width + 1) ** 2)
        for k in range(0, len(todo), block):
            rows = todo[k : k + block]
            first, tail = np.maximum(0, front[rows] - pad), np.maximum(0, back[rows] - pad)
            na, nb = n[rows] - first - tail, m[rows] - first - tail
            distance, low, last = _bounds(x[rows], y[rows], first, na, nb)
            early, late = (low == 0) & ((first > 0) | ~begins[rows]), (last == 0) & ((tail > 0) | ~ends[rows])
            never = early & (first == 0) | late & (tail == 0)
            out.distance[left[rows]], out.low[left[rows]], out.high[left[rows]] = distance, first + low, first + na - last
            out.narrow[left[rows]] = never
            again.append(rows[(early | late) & ~never])
        todo = np.concatenate(again)
        if not len(todo):
            break
    for k in left[todo].tolist():
        alone(k)
    return out


#: Symbols of the texts that `spans` takes at once, and those beside a difference that it looks at, in turn; then all of them.
WIDTH = 1024
PADS = (5, 12)


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols as rows, and their lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(sizes.max()))
    return np.array(texts, dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width), sizes


def _part(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, side: int, step: int = 1) -> np.ndarray:
    """So many symbols of each row from `first` on, or backwards; what fills the rows agrees with no symbol and with no other side."""
    at = np.arange(int(sizes.max(initial=1)))
    inside = at < sizes[:, None]
    place = first[:, None] + step * at
    return np.where(inside, np.take_along_axis(x, np.where(inside, place, 0), axis=1), np.uint32(0xFFFFFFF0 + side))


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols at the rows' beginnings agree."""
    width = min(x.shape[1], y.shape[1])
    differ = x[:, :width] != y[:, :width]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def _all_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tables of common lengths of all rows: [symbols of x, row, symbols of y]."""
    out = np.zeros((x.shape[1] + 1, len(x), y.shape[1] + 1), dtype=np.int16)
    for i in range(x.shape[1]):
        np.maximum.accumulate(np.maximum(out[i, :, 1:], out[i, :, :-1] + (x[:, i, None] == y)), axis=1, out=out[i + 1, :, 1:])
    return out


def _bounds(x: np.ndarray, y: np.ndarray, first: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `_spanning` tells of n and m symbols of each row from `first` on: the distance, and how many symbols are outside at either end."""
    ahead = _all_lengths(_part(x, first, n, 0), _part(y, first, m, 1))
    behind = _all_lengths(_part(x, first + n - 1, n, 0, -1), _part(y, first + m - 1, m, 1, -1))
    whole = ahead[n, np.arange(len(n)), m]

    def outside(table: np.ndarray) -> np.ndarray:
        """The first step at which some minimal alignment, all of them matching equal places before, edits."""
        out, rows, k = np.zeros(len(n), dtype=np.int64), np.arange(len(n)), 0
        while len(rows):
            i, j = n[rows] - k, m[rows] - k
            cut = (i > 0) & (k + table[np.maximum(i - 1, 0), rows, j] == whole[rows])
            put = (j > 0) & (k + table[i, rows, np.maximum(j - 1, 0)] == whole[rows])
            out[rows] = k
            rows, k = rows[~(cut | put)], k + 1
        return out

    return n + m - 2 * whole, outside(behind), outside(ahead)


class Core(NamedTuple):
    """What a spanning edit's two texts tell, in places from its start: the fields of `Told`."""

    canonical: tuple[Edit, ...]
    local_spanning: tuple[Edit, ...]
    units: tuple[tuple[int, str], ...]


def _named_core(old: str, new: str) -> Core:
    """The core of short texts, through texts with the symbols named by order of appearance."""
    symbols = dict.fromkeys(old + new)
    names, own = {ord(c): chr(k) for k, c in enumerate(symbols)}, dict(enumerate(symbols))
    canonical, local, units = _small_core(old.translate(names), new.translate(names))
    back = lambda e: Edit(e.start, e.end, e.sequence.translate(own))
    return Core(tuple(map(back, canonical)), tuple(map(back, local)), tuple(sorted((p, x.translate(own)) for p, x in units)))


_known_core = functools.lru_cache(REMEMBERED)(_named_core)


def core(old: str, new: str) -> Core:
    """What is told of the two texts of a spanning edit; that of small ones is remembered."""
    return _known_core(old, new) if len(old) + len(new) <= SMALL else Core(*_core(old, new))


def relation(reference: str, lhs: str, rhs: str) -> str:
    """How two observed sequences relate: equivalent, disjoint, contains, is_contained or overlap."""
    if lhs == rhs:
        return "equivalent"
    left, right = edit_distance(reference, lhs), edit_distance(reference, rhs)
    apart = edit_distance(lhs, rhs)
    by_distance = by_distances(left, right, apart)
    if by_distance:
        return by_distance
    shared = set(told(reference, lhs).units) & set(told(reference, rhs).units)
    return "overlap" if shared else "disjoint"


def by_distances(left: int, right: int, apart: int) -> str | None:
    """The relation where the three distances decide it; the order of the tests matters."""
    if left + right == apart:
        return "disjoint"
    if left - right == apart:
        return "contains"
    if right - left == apart:
        return "is_contained"
    return None


def forms(edit: Edit) -> int:
    """In how many ways an edit is one of single deletions and insertions."""
    return math.comb(edit.end - edit.start + len(edit.sequence), len(edit.sequence))


def interleaving(edit: Edit, number: int) -> list[Edit]:
    """The way of that number to write an edit as deletions of one symbol and insertions.

    A way says how many of the new symbols come before each place of the deleted stretch and how many after it: rising
    numbers, one for each deleted symbol. Ways that insert earlier come first.
    """
    cut, new = edit.end - edit.start, len(edit.sequence)
    way, done = [], 0
    for k in range(cut):
        put = new
        # So many ways have this number here: the numbers that follow are no smaller.
        while number >= (own := math.comb(new - put + cut - k - 1, cut - k - 1)):
            number -= own
            put -= 1
        if put > done:
            way.append(Edit(edit.start + k, edit.start + k, edit.sequence[done:put]))
        way.append(Edit(edit.start + k, edit.start + k + 1, ""))
        done = put
    return [*way, Edit(edit.end, edit.end, edit.sequence[done:])] if new > done else way


def interleavings(edit: Edit, limit: int | None = None, first: int = 0) -> Iterator[list[Edit]]:
    """All ways to write an edit as deletions of one symbol and insertions, one by one, from number `first` on."""
    total = forms(edit)
    if edit.end - edit.start + len(edit.sequence) <= FEW:
        ways = _few_interleavings(edit.end - edit.start, edit.sequence)
        yield from (moved(way, edit.start) for way in ways[first : None if limit is None else first + limit])
        return
    for number in range(first, total if limit is None else min(total, first + limit)):
        yield interleaving(edit, number)


@functools.lru_cache(SELDOM)
def _few_interleavings(cut: int, sequence: str) -> list[list[Edit]]:
    """All of them for an edit at the start, of which there are few kinds."""
    whole = Edit(0, cut, sequence)
    return [interleaving(whole, number) for number in range(forms(whole))]


#: Primes below 2**31, and the base, of the names of parts.
MODULI, BASE = (2147483647, 2147483629), 1000003


def _prefixes(text: str, modulus: int) -> list[int]:
    """Names of a text's prefixes: sums of symbols times rising powers of the base."""
    out, power = [0], 1
    for symbol in text:
        out.append((out[-1] + (ord(symbol) + 1) * power) % modulus)
        power = power * BASE % modulus
    return out


def named_points(whole: Alignments) -> list[tuple[int, ...]]:
    """The matches and both ends, by row and column: row, column, and for each modulus h, u, x.

    (h of p + u of p * x of q) % modulus names the text that p and q make: the reference up to p, what is observed between
    them, and the reference from q on.
    """
    found = sorted({c for rank in whole._ranks() for c in rank})
    columns = []
    for modulus in MODULI:
        ahead, seen = _prefixes(whole.a, modulus), _prefixes(whole.b, modulus)
        power = lambda k, m=modulus: pow(BASE, k, m)
        own = []
        for r, c in found:
            u = power(r - c)
            here = ahead[r + 1] if r < len(whole.a) else 0, seen[c + 1] if c < len(whole.b) else 0
            rest = power(c - r) * (ahead[-1] - ahead[max(r, 0)])
            own.append(((here[0] - u * here[1]) % modulus, u, (seen[max(c, 0)] + rest) % modulus))
        columns.append(own)
    return [(*point, *one, *two) for point, one, two in zip(found, *columns, strict=True)]


def split(reference: str, shift: int, a: str, b: str, p: tuple[int, int], q: tuple[int, int]) -> dict:
    """What lies between two points of an allele's alignments (a to b, at `shift` of the reference) taken away: subtrahend and remainder
    (canonical), and how they and the allele relate."""
    before, after = reference[:shift], reference[shift + len(a) :]
    inner = a[: p[0] + 1] + b[p[1] + 1 : q[1]] + a[q[0] :]
    outer = b[: p[1] + 1] + a[p[0] + 1 : q[0]] + b[q[1] :]
    parts = [(text, told(reference, before + text + after)) for text in (b, inner, outer)]

    def relate(x: tuple[str, Told], y: tuple[str, Told]) -> str:
        if x[0] == y[0]:
            return "equivalent"
        # What surrounds both is equal, and no distance depends on it.
        found = by_distances(x[1].distance, y[1].distance, edit_distance(x[0], y[0]))
        return found or ("overlap" if set(x[1].units) & set(y[1].units) else "disjoint")

    minuend, subtrahend, remainder = parts
    return {
        "subtrahend": list(subtrahend[1].canonical), "remainder": list(remainder[1].canonical),
        "with_subtrahend": relate(minuend, subtrahend), "with_remainder": relate(minuend, remainder), "between": relate(subtrahend, remainder),
    }


def difference(reference: str, observed: str) -> list[dict]:
    """All distinct ways to take one edit away from an allele, one by one; `operators.differences` makes them of many alleles."""
    whole = windowed(reference, observed)
    points, seen, out = sorted({c for rank in whole._ranks() for c in rank}), set(), []
    for p in points:
        for q in points:
            text = whole.a[: p[0] + 1] + whole.b[p[1] + 1 : q[1]] + whole.a[q[0] :]
            if p[0] < q[0] and p[1] < q[1] and text not in seen:
                seen.add(text)
                out.append(split(reference, whole.shift, whole.a, whole.b, p, q))
    return out
