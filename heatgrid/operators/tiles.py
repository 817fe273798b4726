"""Rasters in blocks: a row a tile of SIZE x SIZE cells (S7, J16, G2-G4, and G16 with A9).

A tile is (tr, tc) and, for each layer, its values as 64-bit floats, row by row, not-a-number where there is none. Map
algebra joins layers tile by tile; resampling sends each tile of the result the rows and columns of the source that it
needs; sums over discs take two look-ups a row of a disc in sums along the rows of a tile. A cell of a join costs its 8
bytes instead of its keys, and a task works on whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.grid import Grid

SIZE = 256
#: Points of a tile that one task takes; a tile with more goes to several.
POINTS_A_GROUP = 100_000

Arrays = dict[str, np.ndarray]


def _array(data: bytes | None, size: int) -> np.ndarray:
    return np.full((size, size), np.nan) if data is None else np.frombuffer(data, "<f8").reshape(size, size)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<f8").tobytes()


def _schema(layers: list[str]) -> str:
    return ", ".join(["tr int", "tc int", *[f"`{v}` binary" for v in layers]])


def to_tiles(cells: DataFrame, layers: list[str], size: int = SIZE) -> DataFrame:
    """Tiles of a cell table (row, col and a column a layer); cells that come twice have one of their values, tiles without cells do not come."""

    def build(group: pa.Table) -> pa.Table:
        row, col = group.column("row").to_numpy(), group.column("col").to_numpy()
        out = [pa.array([int(row[0] // size)], pa.int32()), pa.array([int(col[0] // size)], pa.int32())]
        for v in layers:
            own = np.full((size, size), np.nan)
            own[row % size, col % size] = group.column(v).to_numpy().astype(float)
            out.append(pa.array([_bytes(own)], pa.binary()))
        return pa.table(out, names=["tr", "tc", *layers])

    own = cells.where("row IS NOT NULL AND col IS NOT NULL").select(F.col("row").cast("long"), F.col("col").cast("long"), *[F.col(f"`{v}`").cast("double") for v in layers])
    keyed = own.withColumns({"__tr": F.floor(F.col("row") / size), "__tc": F.floor(F.col("col") / size)})
    return keyed.groupBy("__tr", "__tc").applyInArrow(build, _schema(layers))


def to_cells(tiles: DataFrame, layers: list[str], size: int = SIZE) -> DataFrame:
    """(row, col, layers) of the cells that have a value in any layer; not-a-numbers are null."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = [_array(r[v], size) for v in layers]
                i, j = np.nonzero(~np.all([np.isnan(x) for x in own], axis=0))
                values = [pa.array(x[i, j], from_pandas=True) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array((i + r["tr"] * size).astype(np.int32)), pa.array((j + r["tc"] * size).astype(np.int32)), *values], ["row", "col", *layers])

    return tiles.select("tr", "tc", *layers).mapInArrow(cells, ", ".join(["row int", "col int", *[f"`{v}` double" for v in layers]]))


def algebra(tiles: DataFrame, layers: list[str], function: Callable[[Arrays], Arrays], out: list[str], size: int = SIZE) -> DataFrame:
    """Tiles of the layers that function() gives for those of a tile; no tile needs another, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                made = function({v: _array(batch.column(v)[i].as_py(), size) for v in layers})
                yield pa.RecordBatch.from_arrays([batch.column("tr").slice(i, 1), batch.column("tc").slice(i, 1), *[pa.array([_bytes(made[v])], pa.binary()) for v in out]], ["tr", "tc", *out])

    return tiles.select("tr", "tc", *layers).mapInArrow(run, _schema(out))


def aligned(a: DataFrame, b: DataFrame, grid_a: Grid, grid_b: Grid, how: str = "inner") -> DataFrame:
    """Layers of two tile tables side by side; their grids must be the same."""
    if grid_a != grid_b:
        raise ValueError(f"grids differ: {grid_a}, {grid_b}")
    return a.join(b, ["tr", "tc"], how)


# ---- resampling


def _steps(source: Grid, target: Grid, axis: str) -> tuple[float, float]:
    """(a, b): the centre of target cell i lies at a + b i in cells of the source, whose centres are whole numbers."""
    b = target.dx / source.dx if axis == "x" else target.dy / source.dy
    gap = (target.x0 - source.x0) / source.dx if axis == "x" else (source.y0 - target.y0) / source.dy
    return gap + b / 2 - 0.5, b


def _places(source: Grid, target: Grid, axis: str, first: int, size: int, how: str) -> np.ndarray:
    """For target cells from first on: where their centres are in the source, in cells (nearest: whole ones)."""
    i = np.arange(first, first + size)
    # as for single cells, from the coordinates of the centre
    at = (target.x0 + (i + 0.5) * target.dx - source.x0) / source.dx if axis == "x" else (source.y0 - (target.y0 - (i + 0.5) * target.dy)) / source.dy
    return np.floor(at) if how == "nearest" else at - 0.5


def _needed(places: np.ndarray) -> np.ndarray:
    low = np.floor(places).astype(np.int64)
    return np.unique(np.concatenate([low, low + 1]))


def resample(tiles: DataFrame, value: str, source: Grid, target: Grid, how: str = "bilinear", size: int = SIZE) -> DataFrame:
    """Tiles of one layer on another grid: bilinear (missing cells do not weigh) or nearest (the cell that the centre lies in).

    A tile of the result gets, from each tile of the source, just the rows and columns that its centres are next to: twice
    its own number at most, however much finer the source is.
    """
    last = {"y": -(-target.nrows // size) - 1, "x": -(-target.ncols // size) - 1}

    def spans(axis: str, tile: int) -> range:
        """Tiles of the result whose centres are next to cells of a source tile."""
        a, b = _steps(source, target, axis)
        first, end = (tile * size - 2 - a) / b, ((tile + 1) * size + 1 - a) / b
        return range(max(0, int(first // size)), min(last[axis], int(end // size)) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, rows = _array(r[value], size), []
                for i in spans("y", r["tr"]):
                    need_r = _needed(_places(source, target, "y", i * size, size, how)) - r["tr"] * size
                    need_r = need_r[(need_r >= 0) & (need_r < size)]
                    for j in spans("x", r["tc"]):
                        need_c = _needed(_places(source, target, "x", j * size, size, how)) - r["tc"] * size
                        need_c = need_c[(need_c >= 0) & (need_c < size)]
                        part = own[np.ix_(need_r, need_c)]
                        if not np.isnan(part).all():
                            rows.append((i, j, (need_r + r["tr"] * size).tolist(), (need_c + r["tc"] * size).tolist(), _bytes(part)))
                if rows:
                    types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["tr", "tc", "rows", "cols", "part"])

    def build(group: pa.Table) -> pa.Table:
        i, j = group.column("tr")[0].as_py(), group.column("tc")[0].as_py()
        y, x = _places(source, target, "y", i * size, size, how), _places(source, target, "x", j * size, size, how)
        rows, cols = _needed(y), _needed(x)
        whole = np.full((len(rows), len(cols)), np.nan)
        for r in group.to_pylist():
            own = np.frombuffer(r["part"], "<f8").reshape(len(r["rows"]), len(r["cols"]))
            whole[np.ix_(np.searchsorted(rows, r["rows"]), np.searchsorted(cols, r["cols"]))] = own
        low_y, low_x = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        total, weight = np.zeros((size, size)), np.zeros((size, size))
        for dr in (0, 1):
            for dc in (0, 1):
                wy, wx = (y - low_y if dr else 1 - (y - low_y)), (x - low_x if dc else 1 - (x - low_x))
                own = whole[np.ix_(np.searchsorted(rows, low_y + dr), np.searchsorted(cols, low_x + dc))]
                w = np.outer(wy, wx) * ~np.isnan(own)
                total += np.where(w > 0, own, 0.0) * w
                weight += w
        with np.errstate(invalid="ignore"):
            out = np.where(weight > 0, total / weight, np.nan)
        out[max(0, target.nrows - i * size) :], out[:, max(0, target.ncols - j * size) :] = np.nan, np.nan
        return pa.table([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([_bytes(out)], pa.binary())], names=["tr", "tc", value])

    sent = tiles.select("tr", "tc", value).mapInArrow(send, "tr int, tc int, rows array<bigint>, cols array<bigint>, part binary")
    return sent.groupBy("tr", "tc").applyInArrow(build, _schema([value]))


def resample_counts(tiles: DataFrame, value: str, source: Grid, target: Grid, size: int = SIZE) -> DataFrame:
    """Counts on another grid with their total kept: a source cell is dealt by area over the target cells it overlaps.

    Both axes are apart: a source tile gives a target tile the product of its shares by row, its counts and its shares by
    column, of the rows and columns that they have in common; those of all source tiles are summed.
    """

    def overlap(axis: str, tile: int, other: int) -> tuple[int, np.ndarray]:
        """(first target cell, shares [target, source]) of a source tile's cells in a target tile."""
        step, width, gap = (target.dx, source.dx, target.x0 - source.x0) if axis == "x" else (target.dy, source.dy, source.y0 - target.y0)
        t, s = np.arange(other * size, (other + 1) * size), np.arange(tile * size, (tile + 1) * size)
        low, high = np.maximum.outer(gap + t * step, s * width), np.minimum.outer(gap + (t + 1) * step, (s + 1) * width)
        shares = np.maximum(high - low, 0.0) / width
        limit = target.ncols if axis == "x" else target.nrows
        shares[t >= limit] = 0.0
        used = np.flatnonzero(shares.any(axis=1))
        return (int(used[0]), shares[used[0] : used[-1] + 1]) if len(used) else (0, shares[:0])

    def spans(axis: str, tile: int) -> range:
        step, width, gap, n = (target.dx, source.dx, target.x0 - source.x0, target.ncols) if axis == "x" else (target.dy, source.dy, source.y0 - target.y0, target.nrows)
        first, end = (tile * size * width - gap) / step, ((tile + 1) * size * width - gap) / step
        return range(max(0, int(first // size)), min(-(-n // size) - 1, int(end // size)) + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = _array(r[value], size)
                known, counts = ~np.isnan(own), np.nan_to_num(own)
                for i in spans("y", r["tr"]):
                    y0, by_row = overlap("y", r["tr"], i)
                    for j in spans("x", r["tc"]):
                        x0, by_col = overlap("x", r["tc"], j)
                        if by_row.size and by_col.size:
                            part = by_row @ counts @ by_col.T
                            part[(by_row > 0) @ known.astype(float) @ (by_col.T > 0) == 0] = np.nan  # no known count overlaps
                            if not np.isnan(part).all():
                                columns = [pa.array([v], pa.int32()) for v in (i, j, y0, x0, part.shape[1])] + [pa.array([_bytes(part)], pa.binary())]
                                yield pa.RecordBatch.from_arrays(columns, ["tr", "tc", "y0", "x0", "wide", "part"])

    def build(group: pa.Table) -> pa.Table:
        total, known = np.zeros((size, size)), np.zeros((size, size), bool)
        for r in group.to_pylist():
            part = np.frombuffer(r["part"], "<f8").reshape(-1, r["wide"])
            place = np.s_[r["y0"] : r["y0"] + part.shape[0], r["x0"] : r["x0"] + part.shape[1]]
            total[place] += np.nan_to_num(part)
            known[place] |= ~np.isnan(part)
        total[~known] = np.nan
        return pa.table([group.column("tr").slice(0, 1), group.column("tc").slice(0, 1), pa.array([_bytes(total)], pa.binary())], names=["tr", "tc", value])

    sent = tiles.select("tr", "tc", value).mapInArrow(send, "tr int, tc int, y0 int, x0 int, wide int, part binary")
    return sent.groupBy("tr", "tc").applyInArrow(build, _schema([value]))


# ---- discs


def disc_sums(points: DataFrame, tiles: DataFrame, value: str, key: str, radius: float, grid: Grid, size: int = SIZE, points_a_group: int = POINTS_A_GROUP) -> DataFrame:
    """(key, n, sum, mean) over the known cells whose centre is within the radius of each point (key, x, y; unique keys).

    A point meets the tiles that its disc's box touches; in each row of a disc that a tile has, the sum along the row is the
    difference of two sums from the tile's left side. So a disc takes two look-ups a row, whatever its area. Points of a tile
    that has very many are dealt over tasks, each with the tile. Points without known cells have n 0 and no mean; null
    coordinates have no cells.
    """
    x, y, s = F.col("x"), F.col("y"), float(size)
    span = lambda a, b: F.sequence(F.floor(a / s), F.floor(b / s))
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(key).alias("__key"), "x", "y")
    at = at.withColumn("tr", F.explode(span(grid.row(y + radius), grid.row(y - radius)))).withColumn("tc", F.explode(span(grid.col(x - radius), grid.col(x + radius))))
    at = at.select("__key", "x", "y", F.col("tr").cast("int"), F.col("tc").cast("int"))
    many = at.groupBy("tr", "tc").agg(F.count("*").alias("__n")).where(F.col("__n") > points_a_group).select("tr", "tc", F.ceil(F.col("__n") / points_a_group).cast("int").alias("__salts"))
    many = F.broadcast(many)  # one tile in points_a_group points at most
    salts = F.coalesce("__salts", F.lit(1))
    at = at.join(many, ["tr", "tc"], "left").withColumn("salt", F.pmod(F.xxhash64("__key"), salts).cast("int")).drop("__salts")
    own = tiles.select("tr", "tc", F.col(value).alias("__tile")).join(many, ["tr", "tc"], "left").select("tr", "tc", "__tile", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    kind = at.schema["__key"].dataType

    def sums(_: tuple, places: pa.Table, tile: pa.Table) -> pa.Table:
        keys = places.column("__key")
        n, total = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        if len(tile) and len(keys):
            own = _array(tile.column("__tile")[0].as_py(), size)
            known = ~np.isnan(own)
            along = np.zeros((size, size + 1))
            count = np.zeros((size, size + 1), np.int64)
            np.cumsum(np.where(known, own, 0.0), axis=1, out=along[:, 1:])
            np.cumsum(known, axis=1, out=count[:, 1:])
            r0, c0 = tile.column("tr")[0].as_py() * size, tile.column("tc")[0].as_py() * size
            px, py = places.column("x").to_numpy(), places.column("y").to_numpy()
            u, v = (px - grid.x0) / grid.dx - 0.5 - c0, (grid.y0 - py) / grid.dy - 0.5 - r0  # in cells, whole at centres
            reach = radius / grid.dy
            for step in range(int(2 * reach) + 2):  # the rows of all discs, one after the other
                row = np.ceil(v - reach).astype(np.int64) + step
                inside = radius**2 - ((row - v) * grid.dy) ** 2
                half = np.sqrt(np.maximum(inside, 0.0)) / grid.dx
                low, high = np.clip(np.ceil(u - half), 0, size).astype(np.int64), np.clip(np.floor(u + half) + 1, 0, size).astype(np.int64)
                ok = (inside >= 0) & (row >= 0) & (row < size) & (low < high)
                r, a, b = row[ok], low[ok], high[ok]
                n[ok] += count[r, b] - count[r, a]
                total[ok] += along[r, b] - along[r, a]
        return pa.table([keys, pa.array(n), pa.array(total)], names=["__key", "n", "sum"])

    parts = at.groupBy("tr", "tc", "salt").cogroup(own.groupBy("tr", "tc", "salt")).applyInArrow(sums, f"__key {kind.simpleString()}, n long, sum double")
    found = parts.groupBy("__key").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
    out = points.select(F.col(key)).join(found, F.col(key) == F.col("__key"), "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("sum")).alias("sum"), F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("mean"))
