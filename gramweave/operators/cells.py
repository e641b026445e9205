"""Sums and order statistics over all pairs of small operators, made inside the cells of pairs: no pair is a row, is shuffled or is written.

A pass walks every cell in tiles and lets out sums by subject, or counts by bin.  What is shuffled grows with subjects x blocks, or with bins; a place in the
order of all pairs is found in a few passes, each of which makes the spectra anew, for a spectrum costs less than a row of a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gramweave.functions import kernels
from gramweave.functions.masked import _double
from gramweave.session import stored

#: Rows of a block at most, and blocks at least: a block's rows are sent to as many cells as there are blocks.
CELL_ROWS, BLOCKS = 8_000, 12
#: Bytes of a block's matrices where they may be wide.
BLOCK_BYTES = 16 << 20
#: Pairs of a tile, and bytes of the matrices of one where spectra have no closed form; and columns of one whose pairs are let out as rows.
TILE, TILE_BYTES, RUN = 1 << 15, 8 << 20, 1024

#: A block: ids and rows; the right one is the left one itself in a cell of one block.
Side = tuple[pa.Array, np.ndarray]
Work = Callable[[Iterator[tuple[Side, Side]]], Iterator[pa.RecordBatch]]


def _cells(batches: Iterator[pa.RecordBatch], work: Work) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (i, j, role): ``work`` gets the two sides of each cell in turn."""

    def sides() -> Iterator[tuple[Side, Side]]:
        at: tuple[int, int] | None = None
        held: list[list[pa.RecordBatch]] = [[], []]

        def stacked(side: list[pa.RecordBatch]) -> Side:
            rows = pa.Table.from_batches(side).combine_chunks().to_batches()[0]
            return rows.column("s"), rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

        def cell() -> Iterator[tuple[Side, Side]]:
            if held[0] and (held[1] or at[0] == at[1]):
                left = stacked(held[0])
                yield left, left if at[0] == at[1] else stacked(held[1])

        for batch in batches:
            i, j, role = (batch.column(c).to_numpy() for c in ("i", "j", "role"))
            new = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(role) != 0)]) if len(i) else []
            for lo, hi in zip(new, np.r_[new[1:], len(i)], strict=True):
                if (key := (int(i[lo]), int(j[lo]))) != at:
                    yield from cell()
                    at, held = key, [[], []]
                held[int(role[lo])].append(batch.slice(lo, hi - lo))
        yield from cell()

    return work(sides())


def dealt(df: DataFrame, values: Column, blocks: int = BLOCKS, count: int | None = None) -> DataFrame:
    """(i, j, role, s, v): every row in each cell of its block, whole cells in a task.  Ids must be distinct; ``count`` says how many there are, where that is known."""
    blocks = max(blocks, -(-(df.count() if count is None else count) // CELL_ROWS))
    block = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, "_b").alias("i"), F.greatest(k, "_b").alias("j")))
    rows = df.select("s", values.cast("array<double>").alias("v"), block.alias("_b")).select("s", "v", "_b", F.inline(cells))
    rows = rows.select("i", "j", (F.col("_b") != F.col("i")).cast("int").alias("role"), "s", "v")
    # Cells are numbered and dealt in turn: no task gets many more than another, as hashes would have it.
    tasks = min(blocks * (blocks + 1) // 2, max(200, 4 * df.sparkSession.sparkContext.defaultParallelism))
    number = (F.col("i") * blocks - F.floor(F.col("i") * (F.col("i") - 1) / 2) + F.col("j") - F.col("i")).cast("int")
    return rows.repartitionById(tasks, number % tasks).sortWithinPartitions("i", "j", "role")


def passed(rows: DataFrame, work: Work, schema: str) -> DataFrame:
    """One pass of ``work`` over the cells of ``dealt`` rows."""
    return rows.mapInArrow(partial(_cells, work=work), schema)


def tiles(n: int, m: int, same: bool, size: int) -> Iterator[tuple[slice, slice]]:
    """A cell in tiles of about ``size`` pairs; of one block with itself those on and above the diagonal, square ones."""
    if same:
        edge = max(1, int(size**0.5))
        yield from ((slice(a, a + edge), slice(b, b + edge)) for a in range(0, n, edge) for b in range(a, n, edge))
    else:
        wide = min(m, max(1, int(size**0.5) * 4))
        high = max(1, size // wide)
        yield from ((slice(a, a + high), slice(b, b + wide)) for a in range(0, n, high) for b in range(0, m, wide))


def spectrum(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """|eigenvalues| of the difference of every row of ``a`` and every row of ``b``, row-major n x n matrices: n arrays [rows of a, rows of b]."""
    n = int(round(a.shape[1] ** 0.5))
    if n == 3:
        return [np.abs(x) for x in kernels.eigenvalues3(*(a[:, k, None] - b[None, :, k] for k in (0, 4, 8, 1, 2, 5)))]
    d = (a[:, None, :] - b[None, :, :]).reshape(len(a), len(b), n, n)
    return list(np.moveaxis(np.abs(np.linalg.eigvalsh(d)), -1, 0))


def distance_matrices(rows: np.ndarray, grid: Sequence[float]) -> list[np.ndarray]:
    """Schatten distances of all rows, row-major n x n matrices, at every p, made in tiles."""
    out = [np.zeros((len(rows), len(rows))) for _ in grid]
    for a, b in tiles(len(rows), len(rows), True, _size(rows.shape[1])):
        sigma = spectrum(rows[a], rows[b])
        for d, p in zip(out, grid, strict=True):
            d[a, b] = kernels.schatten_of(sigma, p)
    for d in out:
        upper = np.triu(d, 1)
        np.add(upper, upper.T, out=d)
    return out


def squares(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Squared differences of every row of ``a`` and every row of ``b``, an array a cell."""
    return [(x[:, None] - y[None, :]) ** 2 for x, y in zip(a.T, b.T, strict=True)]


def _size(cells: int) -> int:
    return TILE if cells == 9 else max(1, min(TILE, TILE_BYTES // (8 * cells)))


def _subject_sums(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], gamma: float | None, groups: int) -> Iterator[pa.RecordBatch]:
    """(p, s, total, square, most): by group of the other end, sums over pairs of exp(-gamma d^2), or of d with those of d^2 and the largest d."""
    for (s, left), (t, right) in cells:
        same = left is right
        sides = (left,) if same else (left, right)
        # The numbers of a row's groups stand behind its matrix, -1 for none.
        member = []
        for rows in sides:
            own = np.zeros((len(rows), groups))
            for c in range(width, rows.shape[1]):
                k = rows[:, c].astype(int)
                own[np.flatnonzero(k >= 0), k[k >= 0]] = 1.0
            member.append(own)
        sums = [np.zeros((2, len(grid), len(rows), groups)) for rows in sides]
        tops = [np.zeros((len(grid), len(rows), groups)) for rows in sides]
        for a, b in tiles(len(left), len(right), same, _size(width)):
            sigma = spectrum(left[a, :width], right[b, :width])
            for i, p in enumerate(grid):
                d = kernels.schatten_of(sigma, p)
                values = d if gamma is None else np.exp(-gamma * d * d)
                turns = [(0, a, -1, b, lambda x: x)]
                if not (same and a == b):
                    turns.append((-1, b, 0, a, np.transpose))
                for own, x, other, y, turned in turns:
                    sums[own][0, i, x] += turned(values) @ member[other][y]
                    if gamma is None:
                        sums[own][1, i, x] += turned(values * values) @ member[other][y]
                        for g in range(groups):
                            some = turned(values)[:, member[other][y, g] > 0]
                            if some.shape[1]:
                                tops[own][i, x, g] = np.maximum(tops[own][i, x, g], some.max(axis=1))
        for ids, total, top in zip((s,) if same else (s, t), sums, tops, strict=True):
            for i, p in enumerate(grid):
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, groups), pa.int32()), pa.array(x.ravel())) for x in (total[0, i], total[1, i], top[i])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), float(p))), ids, *lists], ["p", "s", "total", "square", "most"])


def subject_sums(operators: DataFrame, grid: Sequence[float], groups: int, gamma: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(p, s, total, square, most): per subject and p, sums over its pairs by group of the other end, as arrays of ``groups`` numbers: of exp(-gamma d^2), or
    without ``gamma`` of d, of d^2, and the largest d.

    ``operators`` is (s, rho, member), member the numbers of a subject's groups (all arrays of one length, -1 for no group).  A subject's pair with itself counts, with
    distance 0.
    """
    kind = dict(operators.dtypes)["s"]
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    schema = f"p double, s {kind}, total array<double>, square array<double>, most array<double>"
    made = passed(dealt(operators, F.concat("rho", "member"), blocks), partial(_subject_sums, width=width, grid=tuple(map(float, grid)), gamma=gamma, groups=groups), schema)
    column = lambda f, c: F.array(*(f(F.get(c, F.lit(g))) for g in range(groups))).alias(c)
    return made.groupBy("p", "s").agg(column(F.sum, "total"), column(F.sum, "square"), column(F.max, "most"))


def _frobenius_sums(cells: Iterator[tuple[Side, Side]]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, 0.0, 0.0
    for (_, left), (_, right) in cells:
        same = left is right
        sizes = [np.einsum("ij,ij->i", x, x) for x in (left, right)]
        for a, b in tiles(len(left), len(right), same, TILE):
            d2 = np.maximum(sizes[0][a, None] + sizes[1][None, b] - 2 * (left[a] @ right[b].T), 0.0)
            if same and a == b:
                d2 = d2[np.triu_indices(len(d2), 1)]
            n, total, square = n + d2.size, total + float(np.sqrt(d2).sum()), square + float(d2.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([square])], ["n", "total", "square"])


def frobenius_sums(operators: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row (n, total, square): pairs, and sums of their Frobenius distances and of the squares, by the Gram identity.  ``operators`` is (s, rho)."""
    made = passed(dealt(operators, F.col("rho"), blocks), _frobenius_sums, "n long, total double, square double")
    return made.agg(*(F.sum(c).alias(c) for c in ("n", "total", "square")))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of every row of ``a`` and every row of ``b``, added up column by column as ``_sizes`` are: of equal rows they are the sizes to the last bit."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] * y
    return out


def _sizes(a: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a))
    for x in a.T:
        out += x * x
    return out


def _ordered(s: pa.Array, t: pa.Array | None) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The ids of both sides in their order, of whatever kind they are; and by side its rows as the order has them, with their places in it."""
    ids = s if t is None else pa.concat_arrays([s, t])
    sort = pc.array_sort_indices(ids).to_numpy().astype(np.int64)
    sides = [np.flatnonzero(sort < len(s)), np.flatnonzero(sort >= len(s))]
    return ids.take(pa.array(sort)), [(sort[at] - k * len(s), at) for k, at in enumerate(sides)]


def _oriented(cells: Iterator[tuple[Side, Side]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]]:
    """(rows, columns, which of their pairs have s < t, the ids s and t of these) by tiles of about ``size`` pairs: pairs whose s is in the left block, then those whose s is in
    the right one.  An s is a run of up to RUN rows, and the next has the same t, which columnar files store in few bytes."""
    for (s, left), (t, right) in cells:
        same = left is right
        ids, ((rows, one), (columns, two)) = _ordered(s, None if same else t)
        own = (left[rows], one)
        other = own if same else (right[columns], two)
        run = min(RUN, size)
        high = max(1, size // run)
        for (a, first), (b, second) in ((own, other),) if same else ((own, other), (other, own)):
            for x, y in ((slice(i, i + high), slice(j, j + run)) for i in range(0, len(a), high) for j in range(0, len(b), run)):
                if first[x][0] < second[y][-1]:
                    ends = np.broadcast_arrays(first[x, None], second[None, y])
                    some = ends[0] < ends[1]
                    yield a[x], b[y], some, [ids.take(pa.array(e[some])) for e in ends]


def _frobenius_distances(cells: Iterator[tuple[Side, Side]]) -> Iterator[pa.RecordBatch]:
    for a, b, some, ends in _oriented(cells, TILE):
        d = np.sqrt(np.maximum(_sizes(a)[:, None] + _sizes(b)[None, :] - 2 * _inner(a, b), 0.0))
        yield pa.RecordBatch.from_arrays([*ends, pa.array(d[some])], ["s", "t", "d"])


def frobenius_distances(operators: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(s, t, d) of every pair s < t of operators (s, rho) by the Gram identity, some TILE pairs at a time; a block has BLOCK_BYTES of matrices at most, however wide they are."""
    kind = dict(operators.dtypes)["s"]
    size, n = operators.agg(F.coalesce(F.sum(F.size("rho")), F.lit(0)), F.count(F.lit(1))).first()
    return passed(dealt(operators, F.col("rho"), max(blocks, -(-8 * size // BLOCK_BYTES)), n), _frobenius_distances, f"s {kind}, t {kind}, d double")


def _rank_one_distances(cells: Iterator[tuple[Side, Side]], grid: Sequence[float]) -> Iterator[pa.RecordBatch]:
    for (s, left), (t, right) in cells:
        same = left is right
        names = [np.asarray(x) for x in (s, t)]
        sizes = [np.einsum("ij,ij->i", x, x) for x in (left, right)]
        for a, b in tiles(len(left), len(right), same, TILE):
            sigma = kernels.spectra_rank_one(sizes[0][a, None], sizes[1][None, b], left[a] @ right[b].T)
            one, other = np.broadcast_arrays(names[0][a, None], names[1][None, b])
            some = np.triu(np.ones(one.shape, bool), 1) if same and a == b else np.ones(one.shape, bool)
            one, other = one[some], other[some]
            ends = [pa.array(np.where(one < other, one, other)), pa.array(np.where(one < other, other, one))]
            for p in grid:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), p)), *ends, pa.array(kernels.schatten_of(sigma, p)[some])], ["p", "s", "t", "d"])


def rank_one_distances(factors: DataFrame, grid: Sequence[float], blocks: int = BLOCKS) -> DataFrame:
    """(p, s, t, d) of every pair s < t of factors (s, f) of rank one: inner products of tiles and a closed form; ids are numbers."""
    kind = dict(factors.dtypes)["s"]
    return passed(dealt(factors, F.col("f"), blocks), partial(_rank_one_distances, grid=tuple(map(float, grid))), f"p double, s {kind}, t {kind}, d double")


def _grid_rows(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], values: Values) -> Iterator[pa.RecordBatch]:
    for a, b, some, ends in _oriented(cells, _size(width)):
        for p, x in zip(grid, values(spectrum(a, b)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends[0]), p)), *ends, pa.array(x[some], from_pandas=True)], ["p", "s", "t", "x"])


def grid_rows(operators: DataFrame, grid: Sequence[float], values: Values, blocks: int = BLOCKS) -> DataFrame:
    """(p, s, t, x) of every pair s < t of operators (s, rho) for each p: what ``values`` makes of the spectra of a tile, NULL for NaN.  No pair is shuffled."""
    kind = dict(operators.dtypes)["s"]
    size, n, width = operators.agg(F.coalesce(F.sum(F.size("rho")), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.size("rho")), F.lit(0))).first()
    rows = dealt(operators, F.col("rho"), max(blocks, -(-8 * size // BLOCK_BYTES)), n)
    return passed(rows, partial(_grid_rows, width=width, grid=tuple(map(float, grid)), values=values), f"p double, s {kind}, t {kind}, x double")


def _profile_sums(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """(s, square, cross): by subject sums over its pairs of d^2 at every p, and of d * d at the p before from the second p on."""
    for (s, left), (t, right) in cells:
        same = left is right
        sums = [np.zeros((2, len(rows), len(grid))) for rows in ((left,) if same else (left, right))]
        for a, b in tiles(len(left), len(right), same, _size(width)):
            sigma = spectrum(left[a, :width], right[b, :width])
            before = None
            for i, p in enumerate(grid):
                d = kernels.schatten_of(sigma, p)
                for kind, x in enumerate((d * d, None if before is None else d * before)):
                    if x is not None:
                        sums[0][kind, a, i] += x.sum(axis=1)
                        if not (same and a == b):
                            sums[-1][kind, b, i] += x.sum(axis=0)
                before = d
        for ids, (square, cross) in zip((s,) if same else (s, t), sums, strict=True):
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(grid)), pa.int32()), pa.array(x.ravel())) for x in (square, cross)]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["s", "square", "cross"])


def profile_sums(operators: DataFrame, grid: Sequence[float], blocks: int = BLOCKS) -> DataFrame:
    """(s, square, cross) of operators (s, rho): per subject, sums over its pairs of d^2 at every p of the grid, and of d * d at the p before (0 at the first)."""
    kind = dict(operators.dtypes)["s"]
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    made = passed(dealt(operators, F.col("rho"), blocks), partial(_profile_sums, width=width, grid=tuple(map(float, grid))), f"s {kind}, square array<double>, cross array<double>")
    return made.groupBy("s").agg(*(F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(len(grid)))).alias(c) for c in ("square", "cross")))


#: What is stored of (p, ids of the rows, ids of the columns, distances), and which of these cells are there; arrays of one shape.
Stored = Callable[[float, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

FAULTS = ("there", "not_finite", "negative", "asymmetric", "diagonal")


def _faults(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], kept: Stored | None, tol: float) -> Iterator[pa.RecordBatch]:
    found = np.zeros((len(grid), len(FAULTS)), np.int64)
    for (s, left), (t, right) in cells:
        same = left is right
        ids = [np.asarray(x) for x in (s, t)]
        for a, b in tiles(len(left), len(right), same, _size(width)):
            sigma = spectrum(left[a, :width], right[b, :width])
            one, other = np.broadcast_arrays(ids[0][a, None], ids[1][None, b])
            for i, p in enumerate(grid):
                d = kernels.schatten_of(sigma, p)
                both = [kept(p, x, y, d) if kept else (d, np.ones(d.shape, bool)) for x, y in ((one, other), (other, one))]
                # A tile on the diagonal has both orders of its pairs already.
                for (x, has), (y, turned) in (both,) if same and a == b else (both, both[::-1]):
                    faulty = (~np.isfinite(x), x < -tol, ~turned | ~(np.abs(x - y) <= tol), (one == other) & ~(np.abs(x) <= tol))
                    found[i] += [int(np.count_nonzero(f & has)) for f in (has, *faulty)]
    yield pa.RecordBatch.from_arrays([pa.array(np.array(grid, float)), *map(pa.array, np.ascontiguousarray(found.T))], ["p", *FAULTS])


def distance_faults(operators: DataFrame, grid: Sequence[float], kept: Stored | None = None, tol: float = 1e-7, blocks: int = BLOCKS) -> DataFrame:
    """(p, there, not_finite, negative, asymmetric, diagonal): what ``readers.distance_faults`` counts, over the distances of operators (s, rho) in both orders and on the
    diagonal, as they are made inside the cells of pairs; ``there`` counts them.  ``kept`` says what is stored of them, all as they are by default.  Ids are numbers."""
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    work = partial(_faults, width=width, grid=tuple(map(float, grid)), kept=kept, tol=tol)
    made = passed(dealt(operators, F.col("rho"), blocks), work, ", ".join(["p double", *(f"{c} long" for c in FAULTS)]))
    return made.groupBy("p").agg(*(F.sum(c).alias(c) for c in FAULTS))


# Places in the order of all pairs

#: Bits of a double below those that name its first bin: 16 bins an octave.
SHIFT = 48
#: Bins that an interval is cut into, and rows of a bin that are put in order.
CUT, BIN_ROWS = 4096, 50_000

#: Values of a tile's pairs from their spectra, an array a key; not negative, NaN for a pair that has none.
Values = Callable[[list[np.ndarray]], Iterator[np.ndarray]]
#: What the values of a tile are made of: arrays [rows of a, rows of b], the ``spectrum`` or ``squares``.
Measure = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]
#: By key the intervals looked at, as whole numbers in the order of doubles: first ones and ends, in order.
Looked = dict[int, tuple[np.ndarray, np.ndarray]]


def _valued(cells: Iterator[tuple[Side, Side]], width: int, values: Values, measure: Measure) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, values, groups of the tile's rows, groups of its columns), every pair once."""
    for (_, left), (_, right) in cells:
        same = left is right
        for a, b in tiles(len(left), len(right), same, _size(width)):
            for k, x in enumerate(values(measure(left[a, :width], right[b, :width]))):
                if same and a == b:
                    x = np.where(np.triu(np.ones(x.shape, bool), 1), x, np.nan)
                yield k, x, left[a, width:] > 0, right[b, width:] > 0


def _counted(found: dict[tuple[int, int], np.ndarray], squares: dict[tuple[int, int], float]) -> Iterator[pa.RecordBatch]:
    for (k, g), n in found.items():
        bins = np.flatnonzero(n)
        where = np.append(bins, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), k, np.int32)), pa.array(np.full(len(where), g, np.int32)), pa.array(where.astype(np.int64)), pa.array(np.append(n[bins], 0)), pa.array(np.append(np.zeros(len(bins)), squares.get((k, g), 0.0)))], ["k", "g", "bin", "n", "square"])


def _first_bins(cells: Iterator[tuple[Side, Side]], width: int, values: Values, measure: Measure = spectrum) -> Iterator[pa.RecordBatch]:
    """(k, g, bin, n, square) by the leading bits of values; bin -1 has the sum of their squares."""
    found: dict[tuple[int, int], np.ndarray] = {}
    squares: dict[tuple[int, int], float] = {}
    for k, x, rows, columns in _valued(cells, width, values, measure):
        known = ~np.isnan(x)
        square = np.where(known, x * x, 0.0)
        total = np.einsum("ag,ag->g", square @ columns.astype(float), rows.astype(float))
        bins = np.where(known, (x + 0.0).view(np.int64) >> SHIFT, 1 << (63 - SHIFT))
        least = int(bins.min())
        for g in range(rows.shape[1]):
            own = bins if rows[:, g].all() and columns[:, g].all() else bins[np.ix_(rows[:, g], columns[:, g])]
            n = np.bincount(own.ravel() - least)
            held = found.setdefault((k, g), np.zeros((1 << (63 - SHIFT)) + 1, np.int64))
            held[least : least + len(n)] += n
            squares[k, g] = squares.get((k, g), 0.0) + float(total[g])
    yield from _counted({key: n[:-1] for key, n in found.items()}, squares)


def _inside(cells: Iterator[tuple[Side, Side]], width: int, values: Values, looked: Looked) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(key, group, intervals, values as whole numbers) of those values that lie in the intervals."""
    for k, x, rows, columns in _valued(cells, width, values, spectrum):
        if k in looked:
            low, high = looked[k]
            order = (x + 0.0).view(np.int64).ravel()
            some = np.flatnonzero((order >= low[0]) & (order < high[-1]))
            at = np.searchsorted(low, order[some], "right") - 1
            fine = order[some] < high[at]
            some, at = some[fine], at[fine]
            if len(some):
                r, c = np.divmod(some, x.shape[1])
                for g in range(rows.shape[1]):
                    both = rows[r, g] & columns[c, g]
                    if both.any():
                        yield k, g, at[both], order[some[both]]


def _step(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(high - low) // CUT))


def _finer_bins(cells: Iterator[tuple[Side, Side]], width: int, values: Values, looked: Looked) -> Iterator[pa.RecordBatch]:
    """(k, g, bin, n, square): intervals cut into CUT bins; bins are numbered through all of a key's intervals."""
    found: dict[tuple[int, int], np.ndarray] = {}
    for k, g, at, order in _inside(cells, width, values, looked):
        low, high = looked[k]
        bins = at * CUT + (order - low[at]) // _step(low, high)[at]
        held = found.setdefault((k, g), np.zeros(len(low) * CUT, np.int64))
        held += np.bincount(bins, minlength=len(held))
    yield from _counted(found, {})


def _held(cells: Iterator[tuple[Side, Side]], width: int, values: Values, looked: Looked) -> Iterator[pa.RecordBatch]:
    """(k, g, interval, value, n): the values in the intervals, equal ones of a tile once."""
    for k, g, at, order in _inside(cells, width, values, looked):
        both, n = np.unique(np.stack([at, order]), axis=1, return_counts=True)
        size = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, g, np.int32)), pa.array(both[0].astype(np.int32)), pa.array(both[1]), pa.array(n)], ["k", "g", "interval", "value", "n"])


def _looked(targets: Sequence[dict]) -> tuple[Looked, list[int]]:
    """The intervals of some targets by key, and each target's number among its key's."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for t in targets:
        spans.setdefault(t["k"], []).append(t["span"])
    ordered = {k: sorted(set(x)) for k, x in spans.items()}
    return {k: (np.array([a for a, _ in x]), np.array([b for _, b in x])) for k, x in ordered.items()}, [ordered[t["k"]].index(t["span"]) for t in targets]


def pair_points(operators: DataFrame, values: Values, groups: int, points: Sequence[float], blocks: int = BLOCKS) -> list[dict]:
    """For each key of ``values`` and each group of subjects: k, g, n (pairs with a value), square (sum of the values' squares) and, for each of ``points``,
    (lo, hi, at): the values at the places around it and how far it lies beyond the lower.  Exact; pairs without a value are left out.

    ``operators`` is a stored table (s, rho, member), member a 1 or 0 for each group; a pair is in the groups of both ends.  The driver holds counts by bin and two places for each key,
    group and point.
    """
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    # Every pass deals the rows anew, which costs less than the table of the cells' rows.
    cells = dealt(operators, F.concat("rho", "member"), blocks)
    counts = "k int, g int, bin long, n long, square double"

    def binned(work: Callable, **more: Looked) -> dict[tuple[int, int], dict[int, tuple[int, float]]]:
        made = passed(cells, partial(work, width=width, values=values, **more), counts).groupBy("k", "g", "bin").agg(F.sum("n").alias("n"), F.sum("square").alias("square"))
        out: dict[tuple[int, int], dict[int, tuple[int, float]]] = {}
        for r in made.toLocalIterator():
            out.setdefault((r.k, r.g), {})[r.bin] = (r.n, r.square)
        return out

    def placed(own: dict[int, tuple[int, float]], place: int) -> tuple[int, int, int]:
        """Bin, place within it and its rows."""
        before = 0
        for b in sorted(own):
            if b >= 0 and before <= place < before + own[b][0]:
                return b, place - before, own[b][0]
            before += own[b][0] if b >= 0 else 0
        raise AssertionError("a place beyond the values")

    out, targets = [], []
    for (k, g), own in sorted(binned(_first_bins).items()):
        n = sum(x for b, (x, _) in own.items() if b >= 0)
        row = {"k": k, "g": g, "n": n, "square": own[-1][1], "points": []}
        for q in points if n else ():
            exact = q * (n - 1)
            ends = []
            for place in (int(np.floor(exact)), int(np.ceil(exact))):
                b, inner, held = placed(own, place)
                ends.append({"k": k, "g": g, "span": (b << SHIFT, (b + 1) << SHIFT), "place": inner, "held": held})
            row["points"].append((*ends, exact - np.floor(exact)))
            targets += ends
        out.append(row)
    single = lambda t: t["span"][1] - t["span"][0] == 1
    while large := [t for t in targets if t["held"] > BIN_ROWS and not single(t)]:
        looked, at = _looked(large)
        made = binned(_finer_bins, looked=looked)
        for t, j in zip(large, at, strict=True):
            low, high = (x[j : j + 1] for x in looked[t["k"]])
            own = {b: x for b, x in made[t["k"], t["g"]].items() if j * CUT <= b < (j + 1) * CUT}
            b, t["place"], t["held"] = placed(own, t["place"])
            step = int(_step(low, high)[0])
            first = int(low[0]) + (b - j * CUT) * step
            t["span"] = (first, min(first + step, int(high[0])))
    if small := [t for t in targets if not single(t)]:
        looked, at = _looked(small)
        spark = operators.sparkSession
        want = spark.createDataFrame([(i, t["k"], t["g"], j, t["place"]) for i, (t, j) in enumerate(zip(small, at, strict=True))], "target int, k int, g int, interval int, place long")
        some = passed(cells, partial(_held, width=width, values=values, looked=looked), "k int, g int, interval int, value long, n long")
        upto = F.sum("n").over(W.partitionBy("k", "g", "interval").orderBy("value"))
        some = some.groupBy("k", "g", "interval", "value").agg(F.sum("n").alias("n")).withColumn("upto", upto)
        for r in some.join(F.broadcast(want), ["k", "g", "interval"]).where("place < upto and place >= upto - n").select("target", "value").collect():
            small[r.target]["span"] = (r.value, r.value + 1)
    number = lambda t: float(np.array([t["span"][0]]).view(float)[0])
    for row in out:
        row["points"] = [(number(lo), number(hi), float(x)) for lo, hi, x in row["points"]]
    return out


def _pair_sums(cells: Iterator[tuple[Side, Side]], width: int, values: Values) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, float]] = {}
    for made in _tile_values(cells, width, values):
        for k, x in enumerate(made):
            n, total = found.get(k, (0, 0.0))
            found[k] = n + len(x), total + float(x.sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([x for _, x in found.values()], pa.float64())], ["k", "n", "total"])


def pair_sums(operators: DataFrame, values: Values, blocks: int = BLOCKS) -> dict[int, tuple[int, float]]:
    """By key of ``values`` the number of all pairs of operators (s, rho) with a value, and the sum of these; no keys without pairs."""
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    made = passed(dealt(operators, F.col("rho"), blocks), partial(_pair_sums, width=width, values=values), "k int, n long, total double")
    return {r.k: (r.n, r.total) for r in made.groupBy("k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect()}


# Ranks of all pairs

#: Bins of near equal counts in which the values of a key are ranked; a bin's values share their mean rank, as ties do.
RANK_BINS = 1 << 17
#: The most that bins of more than one double may add up to, as the sum of their cubed shares of all pairs; beyond it, the largest are cut again.
TIED = 1e-9
#: Values that a task puts in order at a time.
SORTED = 1 << 20

#: By key the first doubles of its bins, in order.
Edges = dict[int, np.ndarray]


def _tile_values(cells: Iterator[tuple[Side, Side]], width: int, values: Values, measure: Measure = spectrum) -> Iterator[list[np.ndarray]]:
    """A tile's pairs at all keys, each pair once; those without a value at the first key are left out."""
    for (_, left), (_, right) in cells:
        same = left is right
        for a, b in tiles(len(left), len(right), same, _size(width)):
            made = [x + 0.0 for x in values(measure(left[a, :width], right[b, :width]))]
            known = ~np.isnan(made[0])
            if same and a == b:
                known &= np.triu(np.ones(known.shape, bool), 1)
            yield [x[known] for x in made] if not known.all() else [x.ravel() for x in made]


def _bin_counts(cells: Iterator[tuple[Side, Side]], width: int, values: Values, measure: Measure, edges: Edges) -> Iterator[pa.RecordBatch]:
    """(k, bin, n): values by bin; batches of them are put in order, and the bins' edges looked up there."""
    held: dict[int, list[np.ndarray]] = {k: [] for k in edges}
    found = {k: np.zeros(len(x), np.int64) for k, x in edges.items()}

    def counted(k: int) -> None:
        if held[k]:
            upto = np.searchsorted(np.sort(np.concatenate(held[k])), edges[k], "left")
            found[k] += np.diff(np.append(upto, sum(map(len, held[k]))))
            held[k].clear()

    for made in _tile_values(cells, width, values, measure):
        for k in edges:
            held[k].append(made[k])
            if sum(map(len, held[k])) >= SORTED:
                counted(k)
    for k, n in found.items():
        counted(k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], ["k", "bin", "n"])


def _rank_sums(cells: Iterator[tuple[Side, Side]], width: int, values: Values, measure: Measure, edges: Edges, ranks: dict[int, np.ndarray], first: int, wanted: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    """(k, bin, value, n, cross, total): of bin -1 the sums of rank x rank at ``first`` and of values; of the wanted bins their values, equal ones of a tile once."""
    sums = {k: np.zeros(2) for k in edges}
    names = ["k", "bin", "value", "n", "cross", "total"]
    for made in _tile_values(cells, width, values, measure):
        places = {k: np.searchsorted(x, made[k], "right") - 1 for k, x in edges.items()}
        base = ranks[first][places[first]]
        for k, at in places.items():
            sums[k] += ranks[k][at] @ base, made[k].sum()
            for b in wanted[k]:
                value, n = np.unique(made[k][at == b], return_counts=True)
                if size := len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array(np.full(size, b, np.int32)), pa.array(value), pa.array(n), pa.array(np.zeros(size)), pa.array(np.zeros(size))], names)
    for k, (cross, total) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([-1], pa.int32()), pa.array([0.0]), pa.array([0]), pa.array([cross]), pa.array([total])], names)


def _cut(low: np.ndarray, high: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Bins of whole numbers cut into about n * share equal ones each: first ones and ends."""
    parts = np.maximum(1, np.minimum(high - low, np.ceil(n * share).astype(np.int64)))
    step = -(-(high - low) // parts)
    parts = -(-(high - low) // step)
    of = np.repeat(np.arange(len(low)), parts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = low[of] + inner * step[of]
    return first, np.minimum(first + step[of], high[of])


def pair_ranks(operators: DataFrame, values: Values, keys: int, first: int, blocks: int = BLOCKS, measure: Measure = spectrum) -> list[dict]:
    """For each of the ``keys`` of ``values``: k, n (pairs with a value), mean, median (exact) and rho, the rank correlation with the values of key ``first``; None without
    pairs, rho also for fewer than three or for values that are all equal.  Values are not negative; a key has one wherever key 0 has one.

    No pair is a row, none is sorted or stored: passes over the cells count the leading bits of values, then the values in RANK_BINS bins of near equal counts, and
    then add up products of ranks.  Ranks are those of the bins: values of one bin count as tied, each bin with a share of some 1 / RANK_BINS of all pairs, or one double.  What this
    moves rho by is of the order of the bins' cubed shares added up, TIED at most.  ``operators`` is a stored table (s, rho).  The driver holds the bins, a task bins and SORTED values.
    """
    width = operators.select(F.max(F.size("rho"))).first()[0] or 0
    cells = dealt(operators, F.col("rho"), blocks)
    leading = passed(dealt(operators, F.concat("rho", F.array(F.lit(1.0))), blocks), partial(_first_bins, width=width, values=values, measure=measure), "k int, g int, bin long, n long, square double")
    coarse: dict[int, dict[int, int]] = {k: {} for k in range(keys)}
    for r in leading.where("bin >= 0").groupBy("k", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        coarse[r.k][r.bin] = r.n
    total = sum(coarse[0].values())
    if not total:
        return [{"k": k, "n": 0, "mean": None, "median": None, "rho": None} for k in range(keys)]
    bins = {}
    for k, own in coarse.items():
        at = np.array(sorted(own), np.int64)
        bins[k] = (at << SHIFT, (at + 1) << SHIFT, np.array([own[b] for b in at.tolist()], np.int64))
    asked = list(range(keys))
    while asked:
        for k in asked:
            low, high, n = bins[k]
            # Only bins over their share are cut; in the first round these are nearly all.
            low, high = _cut(low, high, np.where(n * RANK_BINS > total, n, 0), RANK_BINS / total)
            bins[k] = low, high, np.zeros(len(low), np.int64)
        edges = {k: bins[k][0].view(float) for k in asked}
        made = passed(cells, partial(_bin_counts, width=width, values=values, measure=measure, edges=edges), "k int, bin int, n long").groupBy("k", "bin").agg(F.sum("n").alias("n"))
        for k, own in made.toPandas().groupby("k"):
            bins[k][2][own["bin"].to_numpy()] = own["n"].to_numpy()
        tied = {k: float(((n[high - low > 1] / total) ** 3).sum()) for k, (low, high, n) in bins.items()}
        asked = [k for k in range(keys) if tied[k] > TIED and (bins[k][2][bins[k][1] - bins[k][0] > 1] * RANK_BINS > total).any()]
    ranks, spread, wanted, places = {}, {}, {}, {}
    for k, (low, _, n) in bins.items():
        upto = np.cumsum(n)
        ranks[k] = (upto - n + (n + 1) / 2 - (total + 1) / 2) / total
        spread[k] = float((n * ranks[k] ** 2).sum())
        middle = [(total - 1) // 2, total // 2]
        at = np.searchsorted(upto, middle, "right").tolist()
        wanted[k] = sorted(set(at))
        places[k] = [(b, place - int(upto[b] - n[b])) for b, place in zip(at, middle, strict=True)]
    edges = {k: low.view(float) for k, (low, _, _) in bins.items()}
    work = partial(_rank_sums, width=width, values=values, measure=measure, edges=edges, ranks=ranks, first=first, wanted=wanted)
    added = stored(passed(cells, work, "k int, bin int, value double, n long, cross double, total double").groupBy("k", "bin", "value").agg(*(F.sum(c).alias(c) for c in ("n", "cross", "total"))), "rank-sums")
    sums = {r.k: (r.cross, r.total) for r in added.where("bin < 0").collect()}
    asked_places = operators.sparkSession.createDataFrame([(k, b, place) for k, x in places.items() for b, place in dict.fromkeys(x)], "k int, bin int, place long")
    upto = F.sum("n").over(W.partitionBy("k", "bin").orderBy("value"))
    some = added.where("bin >= 0").withColumn("upto", upto).join(F.broadcast(asked_places), ["k", "bin"]).where("place < upto and place >= upto - n")
    point = {(r.k, r.bin, r.place): r.value for r in some.select("k", "bin", "place", "value").collect()}
    out = []
    for k in range(keys):
        lo, hi = (point[k, *x] for x in places[k])
        scale = (spread[k] * spread[first]) ** 0.5
        out.append({"k": k, "n": total, "mean": sums[k][1] / total, "median": (lo + hi) / 2, "rho": sums[k][0] / scale if total >= 3 and scale > 0 else None})
    return out


# Fields between held-out subjects and support vectors

#: Bins of near equal counts in which the values of a field are ranked.
FIELD_BINS = 1 << 16
#: Fields that a pass ranks, values of one that a task puts in order at a time, and bins in a row of counts.
FIELDS, FIELD_SORTED, PART = 48, 1 << 17, 1 << 12


class Compared(NamedTuple):
    """A field at p and at the reference: over the held-out subjects of a group and the support vectors with a weight in column ``own`` or ``ref``, weight times kernel; or
    with ``bare`` the kernel alone, over the support vectors of ``ref``.  ``p`` and ``p0`` are places in the grid; a column of -1 has no weights."""

    p: int
    p0: int
    gamma: float
    gamma0: float
    group: int
    own: int
    ref: int
    bare: bool

    @property
    def same_kernel(self) -> bool:
        return (self.p, self.gamma) == (self.p0, self.gamma0)

    @property
    def same(self) -> bool:
        return self.same_kernel and (self.bare or self.own == self.ref)


def dealt_between(left: DataFrame, right: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(i, j, role, s, v) of two tables (s, v): every row of one meets every row of the other in one cell, whole cells in a task.  Blocks of the right are numbered
    after those of the left.  Ids of a table must be distinct."""
    n, m = (max(blocks, -(-rows.count() // CELL_ROWS)) for rows in (left, right))
    block = lambda k: F.pmod(F.xxhash64("s"), F.lit(k)).cast("int")
    every = lambda first, k: F.explode(F.sequence(F.lit(first), F.lit(first + k - 1)))
    one = left.select(block(n).alias("i"), every(n, m).alias("j"), F.lit(0).alias("role"), "s", "v")
    other = right.select(every(0, n).alias("i"), (block(m) + n).alias("j"), F.lit(1).alias("role"), "s", "v")
    # Fewer tasks than ``dealt`` has: each lets out the bins of all fields.
    tasks = min(n * m, max(48, 4 * left.sparkSession.sparkContext.defaultParallelism))
    number = F.col("i") * m + F.col("j") - n
    return one.unionByName(other).repartitionById(tasks, (number % tasks).cast("int")).sortWithinPartitions("i", "j", "role")


def _fields(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], asked: Sequence[Compared]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, values at p, values at the reference) of a tile; one array twice where both are the same.  A subject has no value with itself.

    Distances from s to t and from t to s may differ by rounding, so they may rank apart where each is held out and supports the other in one fold, which no machine has."""
    for (s, left), (t, right) in cells:
        held, weights = left[:, width:] > 0, right[:, width:]
        itself = pc.fill_null(pc.index_in(t, value_set=s), -1).to_numpy()
        has = ~np.isnan(weights)
        none = np.zeros(len(right), bool)
        weight = lambda k: np.where(has[:, k], weights[:, k], 0.0) if k >= 0 else np.zeros(len(right))
        some = lambda k: has[:, k] if k >= 0 else none
        over = [some(c.ref) if c.bare else some(c.own) | some(c.ref) for c in asked]
        alpha = [(weight(c.own), weight(c.ref)) for c in asked]
        for a, b in tiles(len(left), len(right), False, _size(width)):
            sigma = spectrum(left[a, :width], right[b, :width])
            square = {p: kernels.schatten_of(sigma, grid[p]) ** 2 for p in {x for c in asked for x in (c.p, c.p0)}}
            for k, c in enumerate(asked):
                rows, columns = np.flatnonzero(held[a, c.group]), np.flatnonzero(over[k][b])
                if not (len(rows) and len(columns)):
                    continue
                at = np.ix_(rows, columns)
                x = np.exp(-c.gamma * square[c.p][at])
                x0 = x if c.same_kernel else np.exp(-c.gamma0 * square[c.p0][at])
                if not c.bare:
                    first = x
                    x = first * alpha[k][0][b][columns] + 0.0
                    x0 = x if c.same else (first if c.same_kernel else x0) * alpha[k][1][b][columns] + 0.0
                known = ~(np.isnan(x) | np.isnan(x0))
                meets = itself[b][columns] - a.start
                if ((meets >= 0) & (meets < a.stop - a.start)).any():
                    known &= rows[:, None] != meets[None, :]
                if known.all():
                    yield k, x.ravel(), x.ravel() if x0 is x else x0.ravel()
                else:
                    yield k, x[known], x[known] if x0 is x else x0[known]


def _places(c: Compared, k: int) -> tuple[int, int]:
    """Numbers of the fields of the comparison ``k``."""
    return 2 * k, 2 * k if c.same else 2 * k + 1


def _field_counts(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], asked: Sequence[Compared], edges: Edges) -> Iterator[pa.RecordBatch]:
    """(k, part, n): a field's values by bin, PART bins a row; batches of them are put in order, and the bins' edges looked up there."""
    held: dict[int, list[np.ndarray]] = {k: [] for k in edges}
    found = {k: np.zeros(-(-len(x) // PART) * PART, np.int64) for k, x in edges.items()}

    def counted(k: int) -> None:
        if held[k]:
            upto = np.searchsorted(np.sort(np.concatenate(held[k])), edges[k], "left")
            found[k][: len(edges[k])] += np.diff(np.append(upto, sum(map(len, held[k]))))
            held[k].clear()

    for number, x, x0 in _fields(cells, width, grid, asked):
        for k, values in dict(zip(_places(asked[number], number), (x, x0), strict=True)).items():
            if k in edges:
                held[k].append(values)
                if sum(map(len, held[k])) >= FIELD_SORTED:
                    counted(k)
    for k in edges:
        counted(k)
        n = found[k].reshape(-1, PART)
        some = np.flatnonzero(n.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * PART + 1, PART), pa.int32()), pa.array(n[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), lists], ["k", "part", "n"])


def _added(rows: pa.Table) -> pa.Table:
    n = rows.column("n").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
    return pa.table({"k": rows.column("k").slice(0, 1), "part": rows.column("part").slice(0, 1), "n": pa.array([n], pa.list_(pa.int64()))})


def _bin_of(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Each value's bin; looked up in order, which takes half the time."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.searchsorted(edges, x[order], "right") - 1
    return out


def _field_sums(cells: Iterator[tuple[Side, Side]], width: int, grid: Sequence[float], asked: Sequence[Compared], edges: Edges, ranks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(k, cross, product, square, square0): of each comparison the sums of rank x rank, of value x value and of squares."""
    sums = np.zeros((len(asked), 4))
    for number, x, x0 in _fields(cells, width, grid, asked):
        one, other = _places(asked[number], number)
        r = ranks[one][_bin_of(edges[one], x)]
        r0 = r if other == one else ranks[other][_bin_of(edges[other], x0)]
        sums[number] += r @ r0, x @ x0, x @ x, x0 @ x0
    columns = [pa.array(np.arange(len(asked)), pa.int32()), *map(pa.array, np.ascontiguousarray(sums.T))]
    yield pa.RecordBatch.from_arrays(columns, ["k", "cross", "product", "square", "square0"])


def field_agreement(held: DataFrame, support: DataFrame, grid: Sequence[float], asked: Sequence[Compared], blocks: int = BLOCKS) -> list[dict]:
    """For each of the ``asked`` comparisons: n (values), cosine and rho, the rank correlation of its two fields; None for a zero vector, rho also for fewer than three values
    or a constant field.

    ``held`` is a stored table (s, rho, member), member a 1 or 0 for each group; ``support`` one of (s, rho, weight), weight a number for each column, NaN for none.  Matrices have
    finite cells.  No value is a row, none is sorted by Spark or stored: passes over the cells count the leading bits of values, then the values in FIELD_BINS bins
    of near equal counts, and then add up products.  Values of one bin count as tied, as in ``pair_ranks``; zeros have a bin of their own.  What is shuffled are the
    rows, a block as often as the other side has blocks, and counts by bin.  The driver holds the bins of FIELDS fields, a task as many, and FIELD_SORTED values of each.
    """
    most = FIELDS // 2
    if len(asked) > most:
        return [x for i in range(0, len(asked), most) for x in field_agreement(held, support, grid, asked[i : i + most], blocks)]
    width = held.select(F.max(F.size("rho"))).first()[0] or 0
    left, right = (rows.select("s", F.concat("rho", more).cast("array<double>").alias("v")) for rows, more in ((held, "member"), (support, "weight")))
    rows = dealt_between(left, right, blocks)
    work = {"width": width, "grid": tuple(map(float, grid)), "asked": tuple(asked)}
    last = 0x7FF0
    leading = np.insert(np.arange(-last, last, dtype=np.int64) << SHIFT, last + 1, 1)
    fields = sorted({k for i, c in enumerate(asked) for k in _places(c, i)})
    bins = {k: (leading, np.append(leading[1:], np.int64(last) << SHIFT), np.zeros(len(leading), np.int64)) for k in fields}
    open_ = fields
    while open_:
        made = passed(rows, partial(_field_counts, edges={k: _double(bins[k][0]) for k in open_}, **work), "k int, part int, n array<long>")
        made = made.groupBy("k", "part").applyInArrow(_added, "k int, part int, n array<long>").toArrow()
        for k, part, n in zip(made.column("k").to_pylist(), made.column("part").to_pylist(), made.column("n").combine_chunks(), strict=True):
            own = bins[k][2][part * PART : (part + 1) * PART]
            own[:] = n.values.to_numpy()[: len(own)]
        total = {k: int(bins[k][2].sum()) for k in fields}
        ranges = {k: (high - low > 1) & (n > 1) for k, (low, high, n) in bins.items()}
        tied = {k: float(((n[ranges[k]] / max(1, total[k])) ** 3).sum()) for k, (_, _, n) in bins.items()}
        open_ = [k for k in open_ if tied[k] > TIED and (bins[k][2][ranges[k]] * FIELD_BINS > total[k]).any()]
        for k in open_:
            low, high, n = (x[bins[k][2] > 0] for x in bins[k])
            # Only bins over their share are cut.
            low, high = _cut(low, high, np.where(n * FIELD_BINS > total[k], n, 0), FIELD_BINS / total[k])
            bins[k] = low, high, np.zeros(len(low), np.int64)
    ranks, spread = {}, {}
    for k, (_, _, n) in bins.items():
        ranks[k] = (np.cumsum(n) - n + (n + 1) / 2 - (total[k] + 1) / 2) / max(1, total[k])
        spread[k] = float((n * ranks[k] ** 2).sum())
    edges = {k: _double(low) for k, (low, _, _) in bins.items()}
    sums = passed(rows, partial(_field_sums, edges=edges, ranks=ranks, **work), "k int, cross double, product double, square double, square0 double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("cross", "product", "square", "square0")))
    found = {r.k: r for r in sums.collect()}
    out = []
    for i, c in enumerate(asked):
        one, other = _places(c, i)
        r, n = found.get(i), total[one]
        scale, size = ((spread[one] * spread[other]) ** 0.5, r.square**0.5 * r.square0**0.5) if n else (0.0, 0.0)
        out.append({"n": n, "cosine": r.product / size if size > 0 else None, "rho": r.cross / scale if n >= 3 and scale > 0 else None})
    return out


# Sums over support vectors

def node_changes(a: np.ndarray, b: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances at p of every row of ``a`` and every row of ``b``, row-major n x n matrices, and their nodes' first-order contributions [node, rows, columns]."""
    n = int(round(a.shape[1] ** 0.5))
    d = (a[:, None, :] - b[None, :, :]).reshape(-1, n, n)
    size, c = kernels.contributions_of(d, p)
    shape = len(a), len(b)
    return size.reshape(shape), np.ascontiguousarray(c.T).reshape(n, *shape)


def _support_sums(cells: Iterator[tuple[Side, Side]], width: int, units: Sequence[tuple[float, int, int, float]], bare: bool) -> Iterator[pa.RecordBatch]:
    """(unit, s, n, total): of each unit (p, group, column, gamma) and each row held out in its group the support vectors with a weight in its column, and the sums over
    them of weight (K - K without the node), by node, or with ``bare`` of weight K alone."""
    nodes = 1 if bare else int(round(width**0.5))
    for (s, left), (t, right) in cells:
        held, weights = left[:, width:] > 0, right[:, width:]
        has = ~np.isnan(weights)
        itself = pc.fill_null(pc.index_in(s, value_set=t), -1).to_numpy()
        total = np.zeros((len(units), len(left), nodes))
        for a, b in tiles(len(left), len(right), False, max(1, _size(width) // (1 if width == 9 else 2))):
            for p in sorted({u[0] for u in units}):
                if bare:
                    square, without = kernels.schatten_of(spectrum(left[a, :width], right[b, :width]), p) ** 2, None
                else:
                    d, c = node_changes(left[a, :width], right[b, :width], p)
                    square, without = d * d, np.maximum(d - c, 0.0) ** 2
                for gamma in sorted({u[3] for u in units if u[0] == p}):
                    own = [k for k, u in enumerate(units) if (u[0], u[3]) == (p, gamma) and has[b, u[2]].any() and held[a, u[1]].any()]
                    if own:
                        change = np.exp(-gamma * square)[None] if bare else np.exp(-gamma * square) - np.exp(-gamma * without)
                        alpha = np.nan_to_num(weights[b][:, [units[k][2] for k in own]])
                        total[own, a] += np.einsum("nak->kan", change @ alpha)
        for k, (_, group, column, _) in enumerate(units):
            rows = np.flatnonzero(held[:, group])
            n = np.count_nonzero(has[:, column]) - np.where(itself[rows] >= 0, has[np.maximum(itself[rows], 0), column], False)
            rows, n = rows[n > 0], n[n > 0]
            sums = total[k, rows]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, nodes), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), s.take(pa.array(rows)), pa.array(n.astype(np.int64)), lists], ["unit", "s", "n", "total"])


def support_sums(held: DataFrame, support: DataFrame, units: Sequence[tuple[float, int, int, float]], bare: bool = False, blocks: int = BLOCKS) -> DataFrame:
    """(unit, s, total): for each of ``units`` (p, group, column, gamma) and each subject held out in its group, by node, the sum over the support vectors with a weight in
    the column of weight (K - K without the node), or with ``bare`` one sum of weight K, K the kernel exp(-gamma d^2) at p; subjects that meet no support vector but themselves are left out.

    ``held`` is a stored table (s, rho, member), member a 1 or 0 for each group; ``support`` one of (s, rho, weight), weight a number for each column, NaN for none.  No pair is a row: what
    is shuffled are the rows, a block as often as the other side has blocks, and a row for each unit, subject and block."""
    width = held.select(F.max(F.size("rho"))).first()[0] or 0
    nodes = 1 if bare else int(round(width**0.5))
    left, right = (rows.select("s", F.concat("rho", more).cast("array<double>").alias("v")) for rows, more in ((held, "member"), (support, "weight")))
    made = passed(dealt_between(left, right, blocks), partial(_support_sums, width=width, units=tuple(units), bare=bare), f"unit int, s {dict(held.dtypes)['s']}, n long, total array<double>")
    return made.groupBy("unit", "s").agg(F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(nodes))).alias("total"))
