"""Pairwise alignment with affine gaps, as kernels over batches of pairs.

An alignment of a to b ends in one of three states: two characters aligned, a character of a skipped, or one of b.
Entering a skip costs ``open``, each skipped character ``extend``, and leaving it ``close``; scores are maximised.
``GLOBAL`` aligns all of both, ``SEMI`` leaves the ends of both free, ``LOCAL`` takes the best part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLOBAL, SEMI, LOCAL = 4, 2, 0
_LOW = -1e18


@dataclass(frozen=True)
class Cost:
    """Substitution costs by character (``pairs``; other characters by match and mismatch) and gap costs."""

    match: float = 0
    mismatch: float = -1
    open: float = 0
    extend: float = -1
    close: float = 0
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)

    def of(self, x: str, y: str) -> float:
        return self.pairs.get((x, y), self.match if x == y else self.mismatch)


def parse_cost(text: str) -> Cost:
    """``open extend close n c1 .. cn`` and n rows of n numbers; characters not named cost 0."""
    words = text.split()
    if len(words) < 4:
        raise ValueError("Incomplete cost.")
    gap, n = [int(w) for w in words[:3]], int(words[3])
    chars, numbers = words[4 : 4 + n], [int(w) for w in words[4 + n :]]
    if len(chars) != n or len(numbers) != n * n:
        raise ValueError("Incomplete cost.")
    pairs = {(x, y): numbers[i * n + j] for i, x in enumerate(chars) for j, y in enumerate(chars)}
    return Cost(0, 0, *gap, pairs)


def mangle(value: int, script: str) -> int:
    """Apply ``+ - * / =`` and their numbers from left to right."""
    words = script.split()
    if len(words) % 2:
        raise ValueError("Missing argument in a cost script.")
    for op, number in zip(words[::2], map(int, words[1::2]), strict=True):
        if op not in "+-*/=" or len(op) != 1:
            raise ValueError(f"Unknown operation {op} in a cost script.")
        value = {"+": value + number, "-": value - number, "*": value * number, "/": int(value / number) if number else 0, "=": number}[op]
    return value


def mangled(cost: Cost, pair_scripts: dict[tuple[str, str], str], open_script: str = "", extend_script: str = "", close_script: str = "") -> Cost:
    pairs = cost.pairs | {p: mangle(int(cost.of(*p)), s) for p, s in pair_scripts.items()}
    return Cost(cost.match, cost.mismatch, mangle(int(cost.open), open_script), mangle(int(cost.extend), extend_script), mangle(int(cost.close), close_script), pairs)


def parse_changes(text: str) -> tuple[dict[tuple[str, str], str], dict[str, str]]:
    """Scripts by pair of characters (``~ x y script``) and by gap cost (``Go script``, ``Gx script``, ``Gc script``), a line each."""
    pairs: dict[tuple[str, str], str] = {}
    gaps: dict[str, str] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        kind, *rest = line.split()
        if kind == "~" and len(rest) >= 2:
            where, key, script = pairs, (rest[0], rest[1]), rest[2:]
        elif kind in ("Go", "Gx", "Gc"):
            where, key, script = gaps, kind, rest
        else:
            raise ValueError(f"Malformed cost change: {line}")
        if key in where:
            raise ValueError(f"Changed twice: {line}")
        mangle(0, " ".join(script))  # raises if malformed
        where[key] = " ".join(script)
    return pairs, gaps


def change_costs(cost: Cost, text: str) -> Cost:
    """``cost`` after the scripts of ``parse_changes``, each as in ``mangle``; what is named twice is an error."""
    pairs, gaps = parse_changes(text)
    return mangled(cost, pairs, gaps.get("Go", ""), gaps.get("Gx", ""), gaps.get("Gc", ""))


@dataclass(frozen=True)
class Region:
    """A cost for a rectangle of (a, b) positions; ends are exclusive, -1 is open."""

    cost: Cost
    start_a: int = -1
    end_a: int = -1
    start_b: int = -1
    end_b: int = -1

    @property
    def closed(self) -> bool:
        return min(self.start_a, self.end_a, self.start_b, self.end_b) >= 0

    def window(self, n: int, m: int) -> tuple[slice, slice]:
        of = lambda lo, hi, size: slice(max(lo, 0), size if hi < 0 else min(hi, size))
        return of(self.start_a, self.end_a, n), of(self.start_b, self.end_b, m)


@dataclass
class Costs:
    """The costs of every cell: aligning a[i] to b[j], and of a gap's parts at cell (i, j) of the tables."""

    sub: np.ndarray
    open: np.ndarray
    extend: np.ndarray
    close: np.ndarray


def _substitution(a: str, b: str, cost: Cost) -> np.ndarray:
    ca, cb = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    s = np.where(ca[:, None] == cb[None, :], float(cost.match), float(cost.mismatch))
    for (x, y), v in cost.pairs.items():
        s[np.ix_(ca == ord(x), cb == ord(y))] = v
    return s


def spread(a: str, b: str, cost: Cost, regions: Sequence[Region] = ()) -> Costs:
    """``cost`` everywhere but in the regions: closed ones go over open ones, later ones over earlier ones."""
    n, m = len(a), len(b)
    sub = _substitution(a, b, cost)
    gaps = [np.full((n + 1, m + 1), float(v)) for v in (cost.open, cost.extend, cost.close)]
    for r in sorted(regions, key=lambda r: r.closed):
        rows, cols = r.window(n, m)
        sub[rows, cols] = _substitution(a[rows], b[cols], r.cost)
        # the step to cell (i, j) of the tables consumes the characters before it
        i, j = slice(rows.start + (rows.start > 0), rows.stop + 1), slice(cols.start + (cols.start > 0), cols.stop + 1)
        for table, v in zip(gaps, (r.cost.open, r.cost.extend, r.cost.close), strict=True):
            table[i, j] = v
    return Costs(sub, *gaps)


def tables(c: Costs, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores of prefixes by state: aligned, skipping a, skipping b.  Filled along diagonals, so in few numpy calls."""
    n, m = c.sub.shape
    M, X, Y = (np.full((n + 1, m + 1), _LOW) for _ in range(3))
    M[0, 0] = 0
    if ends != GLOBAL:
        M[:, 0] = M[0, :] = 0
    else:
        X[1:, 0] = np.cumsum(c.extend[1:, 0]) + (c.open[1, 0] if n else 0)
        Y[0, 1:] = np.cumsum(c.extend[0, 1:]) + (c.open[0, 1] if m else 0)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        p, q = i - 1, j - 1
        best = np.maximum(M[p, q], np.maximum(X[p, q], Y[p, q]) + c.close[p, q])
        if ends == LOCAL:
            best = np.maximum(best, 0)
        M[i, j] = best + c.sub[p, q]
        X[i, j] = np.maximum(X[p, j], np.maximum(M[p, j], Y[p, j] + c.close[p, j]) + c.open[i, j]) + c.extend[i, j]
        Y[i, j] = np.maximum(Y[i, q], np.maximum(M[i, q], X[i, q] + c.close[i, q]) + c.open[i, j]) + c.extend[i, j]
    return M, X, Y


def endings(t: tuple[np.ndarray, np.ndarray, np.ndarray], c: Costs, ends: int) -> list[tuple[float, int, int, str]]:
    """(score, i, j, state) of all ways to end."""
    M, X, Y = t
    n, m = c.sub.shape
    if ends == GLOBAL:
        return [(float(M[n, m]), n, m, "M"), (float(X[n, m] + c.close[n, m]), n, m, "X"), (float(Y[n, m] + c.close[n, m]), n, m, "Y")]
    if ends == SEMI:
        cells = [(n, j) for j in range(m + 1)] + [(i, m) for i in range(n)]
    else:
        cells = [(0, 0), *zip(*(x.tolist() for x in np.nonzero(M > 0)), strict=True)]
    return [(float(M[i, j]), i, j, "M") for i, j in cells]


def paths(t: tuple[np.ndarray, np.ndarray, np.ndarray], c: Costs, ends: int, least: float, scores: int = 1, most: int = 1) -> Iterator[tuple[float, list[tuple[int, int]]]]:
    """(score, path) of alignments of at least ``least``, the best first: ``scores`` different ones, ``most`` paths of each.

    A path is a list of (a index or -1, b index or -1).  The tables bound what any unfinished path can still reach, so
    the search takes the most promising one first and never extends one that falls short.
    """
    table = dict(zip("MXY", t, strict=True))
    order = count()
    heap = [(-s, next(order), i, j, k, s - float(table[k][i, j]), None) for s, i, j, k in endings(t, c, ends) if s >= least - 1e-6 and s > _LOW / 2]
    heapq.heapify(heap)
    found: dict[float, int] = {}
    while heap:
        total, _, x, y, state, after, tail = heapq.heappop(heap)
        score = round(-total, 6) + 0.0
        if (score not in found and len(found) == scores) or found.get(score, 0) >= most:
            if len(found) == scores and all(v >= most for v in found.values()):
                return
            continue
        if state == "M" and (x == y == 0 or (ends != GLOBAL and (x == 0 or y == 0)) or x < 0):
            found[score] = found.get(score, 0) + 1
            path = []
            while tail is not None:
                step, tail = tail
                path.append(step)
            yield score, path
            continue
        if state == "M":
            p, q, step, cost = x - 1, y - 1, (x - 1, y - 1), float(c.sub[x - 1, y - 1])
            options = [("M", 0.0), ("X", float(c.close[p, q])), ("Y", float(c.close[p, q]))]
        else:
            p, q = (x - 1, y) if state == "X" else (x, y - 1)
            if p < 0 or q < 0:
                continue
            step, cost, opened = ((p, -1) if state == "X" else (-1, q)), float(c.extend[x, y]), float(c.open[x, y])
            other = "Y" if state == "X" else "X"
            options = [(state, 0.0), ("M", opened), (other, opened + float(c.close[p, q]))]
        if ends == LOCAL and state == "M" and p > 0 and q > 0 and cost + after >= least - 1e-6:
            heapq.heappush(heap, (-(cost + after), next(order), -1, -1, "M", 0.0, (step, tail)))
        for k, v in options:
            here = float(table[k][p, q])
            # a local path that could as well start here does so
            if here <= _LOW / 2 or (ends == LOCAL and k == "M" and p > 0 and q > 0 and here <= 0):
                continue
            if here + v + cost + after >= least - 1e-6:
                heapq.heappush(heap, (-(here + v + cost + after), next(order), p, q, k, v + cost + after, (step, tail)))


def cigar_of(path: list[tuple[int, int]], b_length: int) -> tuple[str, int]:
    """(CIGAR, start in a): runs of M, D (a only) and I (b only); unaligned ends of b are S."""
    ops = ["M" if x >= 0 and y >= 0 else "D" if x >= 0 else "I" for x, y in path]
    used = [y for _, y in path if y >= 0]
    head, tail = (used[0], b_length - 1 - used[-1]) if used else (b_length, 0)
    runs: list[list] = [["S", head]] if head else []
    for op in ops:
        if runs and runs[-1][0] == op:
            runs[-1][1] += 1
        else:
            runs.append([op, 1])
    if tail:
        runs.append(["S", tail])
    return "".join(f"{n}{op}" for op, n in runs), next((x for x, _ in path if x >= 0), -1)


def read_log10(a: str, b: str, path: list[tuple[int, int]], qual: list[float], open_: float, extend: float) -> float:
    """log10 probability of a read b given the alignment: by its base qualities, and by gap costs for all not aligned."""
    total, gap = 0.0, None
    used = [y for _, y in path if y >= 0]
    for n in (used[0], len(b) - 1 - used[-1]) if used else (len(b), 0):
        total += open_ + n * extend if n else 0.0
    for x, y in path:
        kind = "D" if y < 0 else "I" if x < 0 else None
        if kind is None:
            q = qual[y]
            total += np.log10(max(1 - 10**q, 1e-300)) if a[x] == b[y] else q + np.log10(1 / 3)
        else:
            total += extend + (open_ if kind != gap else 0.0)
        gap = kind
    return float(total)


#: Cells of one diagonal that are filled together, over all pairs of a group.
_GROUP_CELLS = 1 << 16
#: Entries of a table of substitution costs over the characters of a batch.
_TABLE_CELLS = 1 << 22


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """The lengths of texts, all their characters as places in an alphabet, and the alphabet."""
    letters, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    return np.array([len(x) for x in texts], np.int64), codes, letters.astype("<u4").tobytes().decode("utf-32-le")


def _padded(codes: np.ndarray, starts: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    """A column for each text: its codes, and ``pad`` behind them."""
    i = np.arange(n.max(initial=0))[:, None]
    return np.where(i < n, np.append(codes, pad)[np.minimum(starts + i, len(codes))], pad)


def best_scores(a: Sequence[str], b: Sequence[str], cost: Cost, ends: int) -> np.ndarray:
    """The best score of each pair, as ``tables`` and ``endings`` give it where costs are the same in all cells.

    Pairs of similar lengths go together, a diagonal of all their tables at a time; only the last three diagonals are kept.
    """
    if len(a) == 0:
        return np.zeros(0)
    (n, codes_a, letters_a), (m, codes_b, letters_b) = _codes(a), _codes(b)
    if len(a) > 1 and len(letters_a) * len(letters_b) > _TABLE_CELLS:
        half = len(a) // 2
        return np.concatenate([best_scores(a[:half], b[:half], cost, ends), best_scores(a[half:], b[half:], cost, ends)])
    sub = np.full((len(letters_a) + 1, len(letters_b) + 1), _LOW)  # the last ones stand behind the ends
    sub[:-1, :-1] = _substitution(letters_a, letters_b, cost)
    starts_a, starts_b = np.cumsum(n) - n, np.cumsum(m) - m
    best = np.empty(len(a))
    order = np.lexsort((m, np.ceil(2 * np.log2(n + 1))))
    while len(order):
        # as many as the longest of them allows
        longest = np.maximum.accumulate(n[order[:_GROUP_CELLS]]) + 1
        size = max(1, int(np.count_nonzero(longest * np.arange(1, len(longest) + 1) <= _GROUP_CELLS)))
        some, order = order[:size], order[size:]
        columns = _padded(codes_a, starts_a[some], n[some], len(letters_a)), _padded(codes_b, starts_b[some], m[some], len(letters_b))
        best[some] = _group_scores(*columns, n[some], m[some], sub, cost, ends)
    return best


def _group_scores(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, sub: np.ndarray, cost: Cost, ends: int) -> np.ndarray:
    """``best_scores`` of pairs whose padded codes are the columns of a and b."""
    rows, cols, pairs = len(a), len(b), len(n)
    opened, extend, close = float(cost.open), float(cost.extend), float(cost.close)
    border = np.concatenate([[_LOW], np.cumsum(np.full(max(rows, cols), extend)) + opened]) if ends == GLOBAL else np.full(max(rows, cols) + 1, _LOW)
    best, column = np.full(pairs, 0.0 if ends == LOCAL else -np.inf), np.arange(pairs)
    sub, width, a = sub.ravel(), sub.shape[1], a * sub.shape[1]
    before = now = None
    for d in range(rows + cols + 1):
        M, X, Y = new = np.full((3, rows + 1, pairs), _LOW)
        if d <= cols:
            M[0], Y[0] = 0.0 if d == 0 or ends != GLOBAL else _LOW, border[d]
        if d <= rows:
            M[d], X[d] = 0.0 if d == 0 or ends != GLOBAL else _LOW, border[d]
        low, high = max(1, d - cols), min(rows, d - 1)
        if low <= high:
            (M2, X2, Y2), (M1, X1, Y1) = before[:, low - 1 : high], now[:, low - 1 : high]
            came = np.maximum(M2, np.maximum(X2, Y2) + close)
            if ends == LOCAL:
                came = np.maximum(came, 0)
            M[low : high + 1] = came + sub[a[low - 1 : high] + b[d - high - 1 : d - low][::-1]]
            X[low : high + 1] = np.maximum(X1, np.maximum(M1, Y1 + close) + opened) + extend
            M1, X1, Y1 = now[:, low : high + 1]
            Y[low : high + 1] = np.maximum(Y1, np.maximum(M1, X1 + close) + opened) + extend
        if ends == LOCAL:
            best = np.maximum(best, M.max(0, where=M > 0, initial=0))
        elif ends == SEMI:
            for i in (n, d - m):  # where a ends, and where b ends
                here = column[(i >= 0) & (i <= n) & (d - i >= 0) & (d - i <= m)]
                best[here] = np.maximum(best[here], M[i[here], here])
        else:
            here = column[n + m == d]
            i = n[here]
            best[here] = np.maximum(M[i, here], np.maximum(X[i, here], Y[i, here]) + close)
        before, now = now, new
    return best


def align(
    pairs: DataFrame, cost: Cost = Cost(), ends: int = GLOBAL, most: int = 0, scores: int = 1, least: float | None = None, regions: Sequence[Region] = (), gap_log10: tuple[float, float] = (-4.0, -1.0)
) -> DataFrame:
    """pairs (pair_id, a, b) -> (pair_id, score), the best score.

    With ``most`` > 0 there is a row for each alignment found: up to ``most`` of each of the ``scores`` highest different
    scores that are at least ``least`` (by default only the best one counts).  These rows have path_ind, cigar, start_a and
    log10_p, the read being b with the qualities of the optional array qual.  Null sequences give no row.  Memory is
    seven tables of (|a| + 1)(|b| + 1) doubles and the paths under way, or where one cost gives one score, a few diagonals.
    """
    each = most > 0
    regions = tuple(regions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not each and not regions:
                batch = batch.filter(pc.and_(batch.column(1).is_valid(), batch.column(2).is_valid()))
                best = best_scores(batch.column(1).to_pylist(), batch.column(2).to_pylist(), cost, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], ["pair_id", "score"])
                continue
            out: list[tuple] = []
            for pair_id, a, b, qual in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None or b is None:
                    continue
                c = spread(a, b, cost, regions)
                t = tables(c, ends)
                best = max(s for s, _, _, _ in endings(t, c, ends))
                if not each:
                    out.append((pair_id, best))
                    continue
                for k, (score, path) in enumerate(paths(t, c, ends, best if least is None else least, scores, most)):
                    out.append((pair_id, score, k, *cigar_of(path, len(b)), read_log10(a, b, path, qual or [-3.0] * len(b), *gap_log10)))
            names = ["pair_id", "score", "path_ind", "cigar", "start_a", "log10_p"][: 6 if each else 2]
            types = [pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], types[c]) for c in range(len(names))], names)

    qual = F.col("qual").cast("array<double>") if "qual" in pairs.columns else F.lit(None).cast("array<double>")
    rows = pairs.select(F.col("pair_id").cast("long"), "a", "b", qual.alias("qual"))
    return rows.mapInArrow(run, "pair_id long, score double" + ", path_ind long, cigar string, start_a long, log10_p double" * each)
