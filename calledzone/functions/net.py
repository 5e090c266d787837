"""Scores: the net's forward pass and what is computed from its probability."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_HIDDEN = 5


def _logistic(x: str) -> str:
    return f"(1D / (1D + exp(-({x}))))"


def weight_columns(inputs: int, prefix: str = "") -> dict[str, Column]:
    """A model's weights as plain numbers, to be taken out before it meets pitches or cells.

    Units a model does not have get zeros and add nothing to the score; a model
    without weights gets a null bias, and with it a null score.
    """
    columns = {f"{prefix}o0": "get(w_out, 0)"}
    for unit in range(1, MAX_HIDDEN + 1):
        columns[f"{prefix}o{unit}"] = f"coalesce(get(w_out, {unit}), 0D)"
        for i in range(inputs + 1):
            columns[f"{prefix}h{unit}_{i}"] = f"coalesce(get(get(w_hidden, {unit - 1}), {i}), 0D)"
    return {name: F.expr(text) for name, text in columns.items()}


def net_total(inputs: Sequence[str | float], prefix: str = "", lifted: bool = False) -> str:
    """What the output unit adds up; a score is at least one half exactly when this is not negative."""
    values = [f"{v}D" if isinstance(v, (int, float)) else v for v in inputs]
    total = f"{prefix}o0"
    for unit in range(1, MAX_HIDDEN + 1):
        drive = f"{prefix}h{unit}_0"
        for i, value in enumerate(values, start=1):
            drive += f" + {prefix}h{unit}_{i} * {value}"
        if lifted:
            drive += f" + lift{unit}"
        total += f" + {prefix}o{unit} * {_logistic(drive)}"
    return total


def lifts(half_x: float, half_z: float) -> list[str]:
    """Shift of each unit that makes `net_total` at a block's centre its bound over the block.

    A unit rises or falls along both axes, so its largest share is at the corner
    this far from the centre.
    """
    return [
        f"signum(o{u}) * (abs(h{u}_1) * {half_x}D + abs(h{u}_2) * {half_z}D) AS lift{u}"
        for u in range(1, MAX_HIDDEN + 1)
    ]


def net_score(inputs: Sequence[str | float], prefix: str = "") -> Column:
    """Called-strike probability: one hidden layer of logistic units over `weight_columns`.

    Inputs are column names or numbers. Written out unit by unit, because array
    lambdas leave generated code.
    """
    return F.expr(_logistic(net_total(inputs, prefix)))


def fold_first_input(value: str) -> list[str]:
    """Weights of a two-input net with the first input fixed: a net of the second alone."""
    kept = ["o0"]
    for unit in range(1, MAX_HIDDEN + 1):
        kept += [
            f"o{unit}", f"h{unit}_0 + h{unit}_1 * {value} AS h{unit}_0", f"h{unit}_2 AS h{unit}_1"
        ]
    return kept


def call_score(p: Column, c: Column) -> Column:
    """Credit for the call: positive when it follows the model, worse the surer the model was."""
    return (F.lit(2.0) * p - F.lit(1.0)) * (c - p)


def shrink(own: Column, n: Column, pooled: Column, regress: Column) -> Column:
    """Own estimate pulled to the pooled one with the weight of `regress` pitches."""
    return (n * own + regress * pooled) / (n + regress)


def usable(status: Column, sse: Column) -> Column:
    return F.coalesce((status == "ok") & (sse != 0), F.lit(False))


def rounded_label(caption: str, value: Column) -> Column:
    return F.concat(F.lit(f"{caption} = "), F.round(value, 3).cast("string"))
