"""Many small nets fitted at once.

Pitches at the same place are counted together before they move, which leaves the
error and its gradient unchanged. A model whose points fit one task is fitted
there; one with more points stays spread out, and each step sums its measurements
over the cluster. Both ways run the same damped Gauss-Newton steps, a few hundred at most as a rule.

Sums are taken in blocks of points in their order, and blocks are added in theirs, wherever they lie: a model's weights
do not depend on how its points are dealt to tasks, nor on whether they fit one.
"""

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators.placement import dealt_by_cost
from calledzone.operators.running import with_running
from calledzone.session import materialise, ship_package, small_side, spread

# Points of one model held by one task: about 150 MB while measured, at four inputs.
TASK_POINTS = 200_000
# Points looked at together.
BLOCK_POINTS = 200_000
# Points of one partial sum.
SUM_POINTS = 50_000
# Points measured at once, few enough for their slopes to stay in a core's cache.
PIECE_POINTS = 2048
# Points of small models that are fitted side by side.
SIDE_BY_SIDE = 8192
# Steps damped more than this no longer move a weight: the error cannot be lowered further.
DAMPING_END = 1e14
# A fit that gains less than this share of its error in so many steps has stopped moving.
STALL_STEPS, STALL_GAIN = 200, 1e-3


@dataclass(frozen=True)
class FitRule:
    """Hidden units by sample size, when to stop, and how few pitches are too few."""

    hidden: int
    threshold_floor: float
    rows_per_threshold: int
    max_steps: int = S.MAX_FIT_STEPS
    min_rows: int = 1
    hidden_large: int | None = None
    large_rows: int = 0
    seed: int = 0
    # A fit that does not end well is begun again from other weights, so many times in all.
    starts: int = 1

    def units(self, rows: int) -> int:
        large = self.hidden_large is not None and rows > self.large_rows
        return self.hidden_large if large else self.hidden

    def threshold(self, rows: int) -> float:
        return max(self.threshold_floor, rows / self.rows_per_threshold)


# Sample-size rules of the four kinds of net.
POOLED_RULE = FitRule(hidden=5, threshold_floor=0.02, rows_per_threshold=100_000)
INDIVIDUAL_RULE = FitRule(
    hidden=4, hidden_large=5, large_rows=1500, threshold_floor=0.02, rows_per_threshold=100_000
)
MOVEMENT_RULE = FitRule(hidden=5, threshold_floor=0.02, rows_per_threshold=50_000)
BATTER_RULE = FitRule(
    hidden=4, threshold_floor=0.01, rows_per_threshold=100_000,
    max_steps=S.MAX_BATTER_FIT_STEPS, min_rows=S.MIN_BATTER_PITCHES,
)


def training_points(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct places per model with their pitches `n` and strikes `s`."""
    known = rows.dropna(subset=list(features))
    return known.groupBy("model_key", *features).agg(
        F.count("*").alias("n"), F.sum("c").alias("s")
    )


def inputs_of(pdf: pd.DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs with the bias column first, pitches and strikes of each point."""
    x = np.column_stack([np.ones(len(pdf)), pdf[list(features)].to_numpy(float)])
    return x, pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)


def _stacked(points: list[tuple]) -> tuple:
    """(inputs, pitches, strikes) of models with as many points, models first; inputs by points and by columns."""
    x, n, s = (np.stack(values) for values in zip(*points))
    return x, n, s, np.ascontiguousarray(x.transpose(0, 2, 1))


def _pieces(points: int) -> list[slice]:
    return [slice(i, i + PIECE_POINTS) for i in range(0, points, PIECE_POINTS)]


# Arrays that are filled anew at every step; fresh memory would cost more than what is worked out in it.
_room: dict[str, np.ndarray] = {}


def _array(name: str, *shape: int) -> np.ndarray:
    size = int(np.prod(shape))
    if name not in _room or len(_room[name]) < size:
        _room[name] = np.empty(size)
    return _room[name][:size].reshape(shape)


class Measured:
    """Models of one number of points at their weights `w`: half the squared error of each over its pitches.

    Slopes are worked out on demand, for the models that need them. Only the order of the work is one for many models;
    each model's sums are those it would have alone, to the last bit.
    """

    def __init__(self, w: np.ndarray, units: int, points: tuple):
        self.w, self.units, self.points = w, units, points
        x, n, s, _ = points
        cut = units * x.shape[2]
        into = w[:, :cut].reshape(-1, units, x.shape[2]).transpose(0, 2, 1)
        self.a, self.p = np.empty((*n.shape, units)), np.empty(n.shape)
        for part in _pieces(n.shape[1]):
            with np.errstate(over="ignore"):
                a = 1.0 / (1.0 + np.exp(-(x[:, part] @ into)))
                self.p[:, part] = 1.0 / (1.0 + np.exp(-(w[:, cut, None] + (a @ w[:, cut + 1 :, None])[:, :, 0])))
            self.a[:, part] = a
        self.loss = 0.5 * (s * (1.0 - self.p) ** 2 + (n - s) * self.p**2).sum(axis=1)

    def slopes(self, which: np.ndarray):
        """Gradients and Gauss-Newton curvatures of the models that `which` marks."""
        w, a, p, (x, n, s, columns) = self.w, self.a, self.p, self.points
        if not which.all():
            w, a, p, n, s, columns = (values[which] for values in (w, a, p, n, s, columns))
        models, inputs, size = columns.shape
        cut = self.units * inputs
        through, weighted = (_array(name, models, size, w.shape[1]) for name in ("through", "weighted"))
        for part in _pieces(size):
            q, units = p[:, part], a[:, part].transpose(0, 2, 1).copy()
            slope = (q * (1.0 - q))[:, None]
            by_weight = _array("by_weight", models, w.shape[1], q.shape[1])
            back = w[:, cut + 1 :, None] * units * (1.0 - units)
            np.multiply(back[:, :, None], columns[:, None, :, part], out=by_weight[:, :cut].reshape(models, -1, inputs, q.shape[1]))
            by_weight[:, cut], by_weight[:, cut + 1 :] = 1.0, units
            by_weight *= slope
            through[:, part] = by_weight.transpose(0, 2, 1)
            by_weight *= n[:, None, part]
            weighted[:, part] = by_weight.transpose(0, 2, 1)
        gradient = (n * p - s)[:, None] @ through
        return gradient[:, 0], through.transpose(0, 2, 1) @ weighted


def measure(w: np.ndarray, units: int, x: np.ndarray, n: np.ndarray, s: np.ndarray):
    """Half the squared error over all pitches, its gradient, and the Gauss-Newton curvature."""
    measured = Measured(w[None], units, _stacked([(x, n, s)]))
    gradient, curvature = measured.slopes(np.array([True]))
    return measured.loss[0], gradient[0], curvature[0]


def weights_of(inputs: int, units: int) -> int:
    """Weights of a net: those into each unit with its bias, and those out of them with one more."""
    return units * (inputs + 1) + units + 1


class Descents:
    """Damped Gauss-Newton (Marquardt, 1963) of nets of one size side by side, a measurement a step, from up to `starts` places.

    `w` holds the places to measure next. A step that lowers the error is kept and the damping
    relaxed; any other is taken back and damped more. The first start that ends well is the result; if none
    does, the one with the smallest error. No model's steps depend on the others.
    """

    def __init__(self, keys: Sequence[str], rows: Sequence[int], inputs: int, rule: FitRule):
        self.keys, self.rows, self.inputs, self.rule = list(keys), [int(n) for n in rows], inputs, rule
        (self.units,) = {rule.units(n) for n in self.rows}
        number, size = len(self.keys), weights_of(inputs, self.units)
        self.threshold = np.array([rule.threshold(n) for n in self.rows])
        self.status = np.full(number, "", dtype="<U13")
        self.w, self.best, self.gradient = (np.zeros((number, size)) for _ in range(3))
        self.curvature = np.zeros((number, size, size))
        self.sse, self.damping, self.raise_by, self.mark = (np.zeros(number) for _ in range(4))
        self.steps, self.start = np.zeros(number, int), np.full(number, -1)
        self.first = np.ones(number, bool)
        # Error, weights and steps of the best start so far, of those that did not end well.
        self.results: list[tuple | None] = [None] * number
        for i in range(number):
            self._begin(i)

    def _begin(self, i: int) -> None:
        """Seeded weights of the next start; the first one's seed is the model's key alone."""
        self.start[i] += 1
        seed = zlib.crc32(self.keys[i].encode()) + self.rule.seed
        draw = np.random.default_rng([seed, int(self.start[i])] if self.start[i] else seed)
        self.w[i] = self.best[i] = draw.standard_normal(self.w.shape[1])
        self.sse[i], self.steps[i], self.status[i] = np.nan, 0, ""
        self.damping[i], self.raise_by[i], self.mark[i], self.first[i] = 1e-2, 2.0, np.inf, True

    def running(self) -> np.ndarray:
        """Numbers of the models that go on."""
        return np.flatnonzero(self.status == "")

    def advance(self, at: np.ndarray, loss: np.ndarray, slopes) -> None:
        """Take in what was measured at the `w` of models `at`; each stops, begins again, or gets its next place.

        `slopes` gives gradients and curvatures of the models marked in its argument.
        """
        self._step(at, loss, slopes)
        for i in at[self.status[at] != ""]:
            self._end(int(i))

    def _step(self, at, loss, slopes) -> None:
        lower = self.first[at] | (loss < self.sse[at])
        kept = lower & np.isfinite(loss)
        if kept.any():
            gradient, curvature = slopes(kept)
            finite = np.isfinite(gradient).all(axis=1)
            kept[kept] = finite
            i = at[kept]
            self.best[i], self.sse[i] = self.w[i], loss[kept]
            self.gradient[i], self.curvature[i] = gradient[finite], curvature[finite]
            self.damping[i], self.raise_by[i] = np.maximum(self.damping[i] / 3.0, 1e-9), 2.0
        broken = self.first[at] & ~kept
        self.sse[at[broken]], self.status[at[broken]] = loss[broken], "error"
        worse = at[~kept & ~broken]
        self.damping[worse] *= self.raise_by[worse]
        self.raise_by[worse] *= 2.0
        self.first[at] = False
        at = at[~broken]
        well = np.abs(self.gradient[at]).max(axis=1, initial=0.0) < self.threshold[at]
        self.status[at[well]] = "ok"
        at = at[~well]
        over = (self.steps[at] >= self.rule.max_steps) | (self.damping[at] > DAMPING_END) | self._stalled(at)
        self.status[at[over]] = "not_converged"
        at = at[~over]
        if len(at):
            damped = self.curvature[at]
            scale = np.diagonal(damped, axis1=1, axis2=2)
            ridge = self.damping[at, None] * (scale + 1e-6 * scale.max(axis=1, keepdims=True) + 1e-12)
            number = np.arange(damped.shape[1])
            damped[:, number, number] += ridge
            self.w[at] = self.best[at] - np.linalg.solve(damped, self.gradient[at][:, :, None])[:, :, 0]
            self.steps[at] += 1

    def _stalled(self, at: np.ndarray) -> np.ndarray:
        stalled = (self.steps[at] > 0) & (self.steps[at] % STALL_STEPS == 0)
        if stalled.any():
            i = at[stalled]
            before, self.mark[i] = self.mark[i], self.sse[i]
            stalled[stalled] = self.sse[i] > before * (1.0 - STALL_GAIN)
        return stalled

    def _end(self, i: int) -> None:
        if self.status[i] == "ok":
            return
        error = np.nan_to_num(self.sse[i], nan=np.inf)
        if self.results[i] is None or error < self.results[i][0]:
            self.results[i] = (error, self.best[i].copy(), int(self.steps[i]), str(self.status[i]), float(self.sse[i]))
        if self.start[i] + 1 < self.rule.starts:
            self._begin(i)
        else:
            _, self.best[i], self.steps[i], self.status[i], self.sse[i] = self.results[i]

    def fit_rows(self, features: Sequence[str]) -> list[dict]:
        split = self.units * (self.inputs + 1)
        return [{
            "model_key": key, "features": list(features), "hidden": self.units,
            "w_hidden": best[:split].reshape(self.units, self.inputs + 1).tolist(),
            "w_out": best[split:].tolist(), "n_train": rows, "sse": float(sse),
            "steps": int(steps), "status": str(status),
        } for key, rows, best, sse, steps, status in zip(
            self.keys, self.rows, self.best, self.sse, self.steps, self.status)]


class Descent:
    """The descent of a single net."""

    def __init__(self, key: str, rows: int, inputs: int, rule: FitRule):
        self.one = Descents([key], [rows], inputs, rule)

    w = property(lambda self: self.one.w[0].copy())
    units = property(lambda self: self.one.units)
    sse = property(lambda self: float(self.one.sse[0]))
    steps = property(lambda self: int(self.one.steps[0]))
    status = property(lambda self: str(self.one.status[0]))
    start = property(lambda self: int(self.one.start[0]))
    running = property(lambda self: not self.status)

    def advance(self, loss: float, gradient: np.ndarray, curvature: np.ndarray) -> None:
        """Take in what was measured at `w`; stop, begin again, or choose the next place."""
        self.one.advance(np.array([0]), np.array([float(loss)]), lambda which: (gradient[None], curvature[None]))

    def fit_row(self, features: Sequence[str]) -> dict:
        return self.one.fit_rows(features)[0]


def _descend(models: list[tuple[str, int, list[tuple]]], features: Sequence[str], rule: FitRule) -> list[dict]:
    """Fit models (key, pitches, blocks of points) whose nets are of one size, side by side up to a bounded number of points.

    Models of as many points are measured together. One that is done makes room for the next.
    """
    shapes = [tuple(len(block[1]) for block in blocks) for _, _, blocks in models]
    order = sorted(range(len(models)), key=lambda i: shapes[i])
    models, shapes = [models[i] for i in order], [shapes[i] for i in order]
    points = np.array([sum(shape) for shape in shapes])
    begins = [i for i, shape in enumerate(shapes) if i == 0 or shape != shapes[i - 1]]
    groups = [(begin, [_stacked(list(parts)) for parts in zip(*[m[2] for m in models[begin:end]])])
              for begin, end in zip(begins, [*begins[1:], len(models)])]
    group = np.repeat(np.arange(len(begins)), np.diff([*begins, len(models)]))
    descents = Descents([m[0] for m in models], [m[1] for m in models], len(features), rule)
    held, parts = np.array([], int), []
    while len(at := descents.running()):
        at = at[: max(1, np.searchsorted(np.cumsum(points[at]), SIDE_BY_SIDE, side="right"))]
        if not np.array_equal(at, held):
            held, cuts = at, [0, *(np.flatnonzero(np.diff(group[at])) + 1), len(at)]
            parts = [(slice(*cut), _taken(*groups[group[at[cut[0]]]], at[slice(*cut)])) for cut in zip(cuts, cuts[1:])]
        measured = [(part, [Measured(descents.w[at[part]], descents.units, block) for block in blocks]) for part, blocks in parts]

        def slopes(which):
            found = [[one.slopes(which[part]) for one in blocks] for part, blocks in measured if which[part].any()]
            sums = [[sum(terms) for terms in zip(*blocks)] for blocks in found]
            return tuple(np.concatenate(values) for values in zip(*sums))

        descents.advance(at, np.concatenate([sum(one.loss for one in blocks) for _, blocks in measured]), slopes)
    return descents.fit_rows(features)


def _taken(begin: int, blocks: list[tuple], at: np.ndarray) -> list[tuple]:
    """Points of the models `at` of a group, which are stacked from number `begin` on."""
    if len(at) == len(blocks[0][1]):
        return blocks
    return [tuple(values[at - begin] for values in block) for block in blocks]


def _fit_block(
    pdf: pd.DataFrame, features: Sequence[str], rule: FitRule, sum_points: int = SUM_POINTS
) -> list[dict]:
    """Fit the models of `pdf`, whose points are in order; sums are taken in blocks of `sum_points`."""
    keys = pdf["model_key"].to_numpy()
    x, n, s = inputs_of(pdf, features)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    by_units: dict[int, list] = {}
    for start, end in zip(starts, np.r_[starts[1:], len(keys)]):
        rows = int(n[start:end].sum())
        blocks = [slice(i, min(i + sum_points, end)) for i in range(start, end, sum_points)]
        by_units.setdefault(rule.units(rows), []).append((keys[start], rows, [(x[b], n[b], s[b]) for b in blocks]))
    return [row for models in by_units.values() for row in _descend(models, features, rule)]


def _fit_partition(
    batches: Iterator[pd.DataFrame], features: Sequence[str], rule: FitRule, sum_points: int = SUM_POINTS
) -> Iterator[pd.DataFrame]:
    """Fit sorted points block by block, each model whole."""

    def fit(pdf):
        pdf = pdf.sort_values(["model_key", *features], ignore_index=True)
        return pd.DataFrame(_fit_block(pdf, features, rule, sum_points), columns=S.FIT.fieldNames())

    waiting: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if batch.empty:
            continue
        waiting.append(batch)
        size += len(batch)
        last = batch["model_key"].iloc[-1]
        if size < BLOCK_POINTS or waiting[0]["model_key"].iloc[0] == last:
            continue
        block = pd.concat(waiting, ignore_index=True)
        # The last model may go on in the next batch.
        unfinished = block["model_key"] == last
        yield fit(block[~unfinished])
        waiting = [block[unfinished]]
        size = len(waiting[0])
    if waiting:
        yield fit(pd.concat(waiting, ignore_index=True))


def _fit_across(
    points: DataFrame, totals: dict[str, int], features: Sequence[str], rule: FitRule, sum_points: int = SUM_POINTS
) -> DataFrame:
    """Fit models too large for a task; only weights and summed measurements reach the driver."""
    spark = points.sparkSession
    descents = {key: Descent(key, rows, len(features), rule) for key, rows in totals.items()}
    order = [F.asc(name) for name in features]
    placed = with_running(points.withColumn("one", F.lit(1)), ["model_key"], order, {"place": "one"})
    block = F.floor((F.col("place") - 1) / sum_points).alias("block")
    blocks = materialise(
        placed.select("model_key", block, *features, "n", "s").repartition("model_key", "block")
        .sortWithinPartitions("model_key", "block", *features))
    while places := {key: (d.w, d.units) for key, d in descents.items() if d.running}:

        def shares(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            if key[0] not in places:
                return pd.DataFrame({"model_key": [], "block": [], "sums": []})
            pdf = pdf.sort_values(list(features), ignore_index=True)
            loss, gradient, curvature = measure(*places[key[0]], *inputs_of(pdf, features))
            sums = np.concatenate([[loss], gradient, curvature.ravel()])
            return pd.DataFrame({"model_key": [key[0]], "block": [key[1]], "sums": [sums.tolist()]})

        going = blocks.where(F.col("model_key").isin(*places))
        parts = going.groupBy("model_key", "block").applyInPandas(
            shares, "model_key string, block long, sums array<double>")
        terms = parts.select("model_key", "block", F.posexplode("sums").alias("i", "v")).groupBy("model_key", "i").agg(
            F.sort_array(F.collect_list(F.struct("block", "v"))).alias("terms"))
        summed = terms.select(
            "model_key", "i", F.aggregate("terms", F.lit(0.0), lambda total, term: total + term["v"]).alias("v"))
        measured: dict[str, dict[int, float]] = {}
        for key, i, v in summed.collect():
            measured.setdefault(key, {})[i] = v
        for key, values in measured.items():
            size = len(descents[key].w)
            flat = np.array([values[i] for i in range(1 + size + size * size)])
            descents[key].advance(flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, size))
    rows = [d.fit_row(features) for d in descents.values()]
    return spark.createDataFrame([tuple(row[f] for f in S.FIT.fieldNames()) for row in rows], S.FIT)


def fit_nets(
    points: DataFrame, features: Sequence[str], rule: FitRule, *,
    most_points: int | None = None, task_points: int = TASK_POINTS, sum_points: int = SUM_POINTS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row of weights per model key with enough pitches.

    `most_points` is the proven size of a model, if there is one; without it the
    points are counted first, and models beyond `task_points` fitted across tasks. `sizes` (model_key, n), if
    given, says how many pitches each model has at most: models are dealt to tasks by it.
    """

    def in_task(batches):
        return _fit_partition(batches, features, rule, sum_points)

    ship_package(points.sparkSession)
    bounded = most_points is not None and most_points <= task_points
    across = None
    if not bounded or rule.min_rows > 1:
        points = materialise(points)
        counted = points.groupBy("model_key").agg(F.count("*").alias("points"), F.sum("n").alias("rows"))
        enough = counted.where(F.col("rows") >= rule.min_rows)
        large = F.col("points") > task_points
        totals = {} if bounded else {row["model_key"]: row["rows"] for row in enough.where(large).collect()}
        if totals:
            wide = points.join(enough.where(large).select("model_key"), "model_key", "left_semi")
            across = _fit_across(wide, totals, features, rule, sum_points)
        points = points.join(enough.where(~large).select("model_key"), "model_key", "left_semi")
    if sizes is None:
        dealt = spread(points, "model_key")
    else:
        most = weights_of(len(features), rule.hidden_large or rule.hidden)
        slots, number = dealt_by_cost(sizes.select("model_key", (F.col("n") * most).alias("cost")))
        dealt = points.join(small_side(materialise(slots)), "model_key").repartitionById(number, F.col("slot")).drop("slot")
    fits = dealt.sortWithinPartitions("model_key").mapInPandas(in_task, S.FIT)
    return fits if across is None else fits.unionByName(across)


def with_fits(tasks: DataFrame, fits: DataFrame) -> DataFrame:
    """Model rows of all tasks; a task with too few pitches, or none, is marked and not lost."""
    rows = tasks.join(fits, "model_key", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("too_few_rows")))
    rows = rows.withColumn("n_train", F.coalesce("n_train", F.lit(0).cast("long")))
    return rows.select(*[f.name for f in S.MODELS.fields])
