"""Models evaluated over a grid of cells.

The cells of a model are generated inside its own row, so no join is needed, and
what is counted per model is aggregated before it leaves the task. Where just the
strike cells matter, blocks that cannot hold one are skipped first.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.functions import net
from calledzone.operators.models import lookup_weights, usable_models
from calledzone.session import spread


@dataclass(frozen=True)
class Grid:
    """Both ends belong to the grid; coordinates are whole steps, so they do not drift."""

    x: tuple[int, int]
    z: tuple[int, int]
    per_foot: int


AREA_GRID = Grid((-2, 2), (-2, 2), S.AREA_CELLS_PER_FOOT)
BATTER_GRID = Grid((-2, 2), (1, 6), S.BATTER_CELLS_PER_FOOT)
BATTER_MAP_GRID = Grid((-2, 2), (1, 6), S.AREA_CELLS_PER_FOOT)


# Cells per side of the blocks that are ruled out as a whole.
BLOCK = 10
# Far above rounding error, far below any weight that matters.
MARGIN = 1e-6


def _steps(ends: tuple[int, int], per_foot: int, by: int = 1) -> str:
    return f"explode(sequence({ends[0] * per_foot}, {ends[1] * per_foot}, {by}))"


def _cells(columns: DataFrame, cells_z: str, scale: str) -> DataFrame:
    """Cells of the columns given; the part of the net that only x drives is done per column."""
    folded = columns.selectExpr("*", f"CAST(ix AS DOUBLE) / {scale} AS x")
    kept = [c for c in ("model_key", "x", "bz") if c in folded.columns]
    folded = folded.selectExpr(*kept, *net.fold_first_input("x"))
    return folded.selectExpr("*", f"{cells_z} AS iz").selectExpr("*", f"CAST(iz AS DOUBLE) / {scale} AS z")


def _blocks(weights: DataFrame, grid: Grid) -> DataFrame:
    return weights.selectExpr("*", f"{_steps(grid.x, grid.per_foot, BLOCK)} AS bx").selectExpr(
        "*", f"{_steps(grid.z, grid.per_foot, BLOCK)} AS bz")


def _sure_rows(models: DataFrame, grid: Grid) -> DataFrame:
    """(model_key, low, high): lowest and highest of the first cells of blocks that are strikes beyond rounding error."""
    scale = f"{float(grid.per_foot)}D"
    blocks = _blocks(spread(lookup_weights(models, 2, "model_key"), "model_key"), grid)
    first = [f"(CAST(bx AS DOUBLE) / {scale})", f"(CAST(bz AS DOUBLE) / {scale})"]
    sure = blocks.where(f"{net.net_total(first)} >= {MARGIN}D")
    return sure.groupBy("model_key").agg(F.min("bz").alias("low"), F.max("bz").alias("high"))


def _strike_blocks(models: DataFrame, grid: Grid, ends: bool = False) -> DataFrame:
    """Blocks of cells that may hold a strike: where the bound over the block is not negative.

    With `ends` just those that may hold a model's highest or lowest strike, which a sure one bounds.
    """
    scale, half = f"{float(grid.per_foot)}D", (BLOCK - 1) / 2
    reach = half / grid.per_foot
    weights = spread(lookup_weights(models, 2, "model_key"), "model_key").selectExpr("*", *net.lifts(reach, reach))
    if ends:
        blocks = _blocks(weights.join(_sure_rows(models, grid), "model_key", "left"), grid).where(
            f"high IS NULL OR bz + {BLOCK - 1} >= high OR bz <= low")
    else:
        blocks = _blocks(weights, grid)
    centre = [f"((bx + {half}D) / {scale})", f"((bz + {half}D) / {scale})"]
    return blocks.where(f"{net.net_total(centre, lifted=True)} >= -{MARGIN}D")


def _strike_cells(models: DataFrame, grid: Grid, strike: str, ends: bool = False) -> DataFrame:
    """Cells whose output total passes `strike`; with `ends` all that lie highest or lowest, and some others."""
    last_x, last_z = grid.x[1] * grid.per_foot, grid.z[1] * grid.per_foot
    columns = _strike_blocks(models, grid, ends).selectExpr(
        "*", f"explode(sequence(bx, least(bx + {BLOCK - 1}, {last_x}))) AS ix"
    )
    cells_z = f"explode(sequence(bz, least(bz + {BLOCK - 1}, {last_z})))"
    cells = _cells(columns, cells_z, f"{float(grid.per_foot)}D")
    return cells.where(f"{net.net_total(['z'])} {strike}").select("model_key", "z")


def over_grid(models: DataFrame, grid: Grid) -> DataFrame:
    """Probability p of every cell (x, z) of the grid, per usable model."""
    weights = spread(lookup_weights(models, 2, "model_key"), "model_key")
    columns = weights.selectExpr("*", f"{_steps(grid.x, grid.per_foot)} AS ix")
    cells = _cells(columns, _steps(grid.z, grid.per_foot), f"{float(grid.per_foot)}D")
    return cells.select("model_key", "x", "z", net.net_score(["z"]).alias("p"))


def zone_extents(models: DataFrame, grid: Grid = BATTER_GRID) -> DataFrame:
    """Highest and lowest cell each usable model calls a strike at least half the time.

    A model that has no such cell gets nulls.
    """
    limits = _strike_cells(models, grid, ">= 0", ends=True).groupBy("model_key").agg(
        F.max("z").alias("sz_top"), F.min("z").alias("sz_bot")
    )
    return usable_models(models).select("model_key").join(limits, "model_key", "left")


def strike_cells(models: DataFrame, grid: Grid = AREA_GRID) -> DataFrame:
    """Number of cells each usable model calls a strike more often than not."""
    counts = _strike_cells(models, grid, "> 0").groupBy("model_key").agg(F.count("*").alias("cells"))
    counted = usable_models(models).select("model_key").join(counts, "model_key", "left")
    return counted.withColumn("cells", F.coalesce("cells", F.lit(0)))


def square_inches(cells, height, per_foot: int = S.AREA_CELLS_PER_FOOT):
    """Area of scaled cells: a cell's height is half the zone's height per unit."""
    per_unit = F.lit(float(per_foot * per_foot))
    return cells / per_unit * height / F.lit(2.0) * F.lit(float(S.SQUARE_INCHES_PER_FOOT))
