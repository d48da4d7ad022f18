"""Exponential smoothing of every series: level, trend and season carried along its rows.

One step of the smoothing is an affine change of the state (level, trend, one value per phase), by the same
matrix for every row. A stretch of rows is therefore an affine map as well, and stretches follow each
other by composition. So a series is cut into chunks of rows and

* every chunk but a series' last is run from a zero state, which gives the constant of its map;
* the maps of a series are composed, one small header per chunk, to the state each chunk begins with;
* every chunk is run from that state, which gives errors, fitted values and the last state.

All smoothing weights are tried in the same runs; a series keeps those with the smallest squared error of
its one-step forecasts. No task holds more of a series than a chunk, or one header of each of its chunks, and
results do not depend on where the chunks are cut. Runs work on Arrow batches, many chunks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import missing_to_null, named
from panelcast.operators.lineage import cut
from panelcast.operators.ordered import over_rows

CHUNK_ROWS = 1 << 14
STATES = 1 << 21  # numbers of state that a task runs at once
MODES = ("additive", "multiplicative")
DOUBLES = T.ArrayType(T.DoubleType())


class Weights:
    """The grid of smoothing weights of level, trend and season, and the shape of the state.

    Trials are numbered from 1, the first list outermost. Without a trend or a season its weight is 0.
    """

    def __init__(
        self,
        alpha: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9),
        beta: Sequence[float] = (0.05, 0.2, 0.5),
        gamma: Sequence[float] = (0.05, 0.2, 0.5),
        m: int = 12,
        trend: bool = True,
    ) -> None:
        self.m = max(m, 1)
        self.trend = trend
        lists = (alpha, beta if trend else (0.0,), gamma if m > 1 else (0.0,))
        self.points = [tuple(map(float, p)) for p in product(*lists)]

    @property
    def least(self) -> int:
        """Rows a series needs for its first state: two seasons, or two rows with a trend."""
        return 2 * self.m if self.m > 1 else 2 if self.trend else 1

    def array(self) -> Column:
        return F.lit([w for p in self.points for w in p])


def step_matrix(points: np.ndarray, m: int) -> np.ndarray:
    """The change of the state (level, trend, phases with the next one first) by a row, without the row's
    value, for every set of weights in the last axis."""
    k = 2 + m
    move = np.zeros((k, k))
    move[0, 0] = move[0, 1] = move[1, 1] = move[1 + m, 2] = 1.0
    for i in range(m - 1):
        move[2 + i, 3 + i] = 1.0
    forecast = np.zeros(k)
    forecast[:3] = 1.0
    gain = np.zeros((*points.shape[:-1], k))
    gain[..., 0] = points[..., 0]
    gain[..., 1] = points[..., 0] * points[..., 1]
    gain[..., 1 + m] += points[..., 2]
    return move - gain[..., :, None] * forecast


def run_chunks(
    values: np.ndarray, sizes: np.ndarray, points: np.ndarray, start: np.ndarray, m: int, keep: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ends (chunk, trial, state), squared errors (chunk, trial) and, with ``keep``, (row, chunk, trial,
    4): forecast, level, trend and season of every row.

    Chunks come longest first, ``values`` (chunk, row) is padded, ``points`` is (chunk, trial, weight).
    """
    a, b, g = np.moveaxis(points, -1, 0)
    level, trend, season = start[..., 0].copy(), start[..., 1].copy(), start[..., 2:].copy()
    errors, rows = np.zeros(level.shape), []
    for t in range(values.shape[1]):
        on = int(np.searchsorted(-sizes, -t, side="left"))  # chunks that have this row
        p = t % m
        ahead = level[:on] + trend[:on]
        expected = ahead + season[:on, :, p]
        e = values[:on, t, None] - expected
        level[:on] = ahead + a[:on] * e
        trend[:on] += a[:on] * b[:on] * e
        season[:on, :, p] += g[:on] * e
        errors[:on] += e * e
        if keep:
            row = np.full((*level.shape, 4), np.nan)
            row[:on] = np.stack([expected, level[:on], trend[:on], season[:on, :, p]], axis=-1)
            rows.append(row)
    turn = (np.arange(m)[None, :] + sizes[:, None]) % m  # the next phase first
    season = np.take_along_axis(season, np.broadcast_to(turn[:, None, :], season.shape), axis=2)
    end = np.concatenate([level[..., None], trend[..., None], season], axis=2)
    return end, errors, np.stack(rows) if keep and rows else None


def _matrix(column: pa.Array, *shape: int) -> np.ndarray:
    """An array of lists of one length as numbers of the given shape."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def _lists(x: np.ndarray) -> pa.Array:
    """One list of numbers per first index."""
    flat = np.ascontiguousarray(x.reshape(len(x), -1))
    ends = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))


def _run(part: pa.RecordBatch, m: int, zero: bool, keep: bool = False):
    """Runs the chunks of a batch (__ys, __points, __start); results in the order of the batch."""
    ys = part.column("__ys")
    ends, flat = ys.offsets.to_numpy(), ys.values.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.diff(ends), kind="stable")
    sizes = np.diff(ends)[order]
    values = np.zeros((len(sizes), int(sizes.max(initial=0))))
    for i, j in enumerate(order):
        values[i, : sizes[i]] = flat[ends[j] : ends[j + 1]]
    points = _matrix(part.column("__points"), -1, 3)[order]
    start = np.zeros((len(sizes), points.shape[1], 2 + m))
    if not zero:
        given = part.column("__start")
        cuts, numbers = given.offsets.to_numpy(), given.values.to_numpy(zero_copy_only=False)
        for i, j in enumerate(order):  # a series' first chunk has one start for all trials
            start[i] = numbers[cuts[j] : cuts[j + 1]].reshape(-1, 2 + m)
    end, errors, rows = run_chunks(values, sizes, points, start, m, keep)
    back = np.argsort(order)
    return end[back], errors[back], None if rows is None else rows[:, back]


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose states fit in ``STATES``; ``width`` numbers per trial."""
    trials = batch.column("__points")[0].values if batch.num_rows else ()
    step = max(1, 3 * STATES // max(width * len(trials), 1))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def _chunks(
    panel: DataFrame, y: str, mode: str, by: Sequence[str], order: Sequence[str], chunk_rows: int
) -> DataFrame:
    """(by, __chunk, __total, __at, __ys): the rows of every series with a value, in chunks of ``chunk_rows``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    value = missing_to_null(named(y))
    if mode == "multiplicative":
        value = F.when(value > 0, F.ln(value))
    rows = panel.select(*[named(c) for c in [*by, *order]], value.alias("__y")).filter("__y is not null")
    placed = over_rows(
        rows, by, order, 0, lambda w, position, total: {"__pos": position, "__total": total}
    )
    item = F.struct("__pos", F.struct(*[named(c) for c in order]).alias("at"), "__y")
    number = F.expr(f"cast((__pos - 1) div {chunk_rows} as bigint)").alias("__chunk")
    gathered = placed.groupBy(*[named(c) for c in by], number).agg(
        F.max("__total").cast("bigint").alias("__total"), F.array_sort(F.collect_list(item)).alias("__rows")
    )
    return gathered.select(
        *[named(c) for c in by],
        "__chunk",
        "__total",
        F.transform("__rows", lambda r: r["at"]).alias("__at"),
        F.transform("__rows", lambda r: r["__y"]).alias("__ys"),
    )


def _first_states(chunks: DataFrame, weights: Weights, by: Sequence[str], chunk_rows: int) -> DataFrame:
    """(by, __first): the state before a series' first row, from its first two seasons."""
    m, need = weights.m, weights.least
    parts = F.array_sort(F.collect_list(F.struct("__chunk", F.slice("__ys", 1, need).alias("ys"))))
    early = chunks.filter(F.col("__chunk") <= (need - 1) // chunk_rows)
    head = early.groupBy(*[named(c) for c in by]).agg(
        F.slice(F.flatten(F.transform(parts, lambda p: p["ys"])), 1, need).alias("__head")
    )

    def mean(low: int) -> Column:
        total = F.aggregate(F.slice("__head", low, m), F.lit(0.0), lambda s, x: s + x)
        return total / F.lit(float(m))

    level = mean(1)
    trend = (mean(m + 1) - level) / F.lit(float(m)) if weights.trend else F.lit(0.0)
    season = F.transform(F.slice("__head", 1, m), lambda x: x - F.col("__level"))
    return (
        head.filter(F.size("__head") == need)
        .withColumn("__level", level)
        .withColumn("__first", F.concat(F.array("__level", trend), season))
        .select(*[named(c) for c in by], "__first")
    )


def _with_starts(
    chunks: DataFrame, known: DataFrame, m: int, by: Sequence[str], chunk_rows: int
) -> DataFrame:
    """The chunks of the series in ``known`` (by, __first, __points), with __points and __start."""
    keys = [named(c) for c in by]
    fields = [chunks.schema[c] for c in by]
    joined = chunks.join(known, list(by))
    last = F.expr(f"(__total - 1) div {chunk_rows}")

    def constants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 2 + m):
                end, _, _ = _run(part, m, zero=True)
                names = [*by, "__chunk"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], _lists(end)], names=[*names, "__constant"]
                )

    schema = T.StructType([*fields, T.StructField("__chunk", T.LongType()), T.StructField("__constant", DOUBLES)])
    # all chunks with a follower are full
    maps = joined.filter(F.col("__chunk") < last).select(*keys, "__chunk", "__ys", "__points")
    headers = maps.mapInArrow(constants, schema).groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__chunk", "__constant"))), lambda h: h["__constant"]
        ).alias("__maps")
    )

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                points = _matrix(row.column("__points"), -1, 3)[0]
                power = np.linalg.matrix_power(step_matrix(points, m), chunk_rows)
                state = np.broadcast_to(_matrix(row.column("__first"), 2 + m)[0], (len(points), 2 + m))
                starts = []
                for constant in row.column("__maps")[0].values:
                    given = constant.values.to_numpy().reshape(len(points), 2 + m)
                    state = np.einsum("pij,pj->pi", power, state) + given
                    starts.append(state)
                keys_of = [pa.array([row.column(c)[0].as_py()] * len(starts), row.column(c).type) for c in by]
                yield pa.RecordBatch.from_arrays(
                    [*keys_of, pa.array(np.arange(1, len(starts) + 1)), _lists(np.stack(starts))],
                    names=[*by, "__chunk", "__start"],
                )

    schema = T.StructType([*fields, T.StructField("__chunk", T.LongType()), T.StructField("__start", DOUBLES)])
    starts = headers.join(known, list(by)).select(*keys, "__maps", "__first", "__points").mapInArrow(compose, schema)
    return joined.join(starts, [*by, "__chunk"], "left").withColumn(
        "__start", F.coalesce("__start", "__first")
    )


def _trials(
    chunks: DataFrame, known: DataFrame, weights: Weights, by: Sequence[str], chunk_rows: int
) -> DataFrame:
    """(by, trial_id, alpha, beta, gamma, n, sse) of every set of weights."""
    m = weights.m
    tried = _with_starts(chunks, known.withColumn("__points", weights.array()), m, by, chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 2 + m):
                _, errors, _ = _run(part, m, zero=False)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in by], part.column("__n"), _lists(errors)], names=[*by, "__n", "__errors"]
                )

    schema = T.StructType(
        [*[chunks.schema[c] for c in by], T.StructField("__n", T.LongType()), T.StructField("__errors", DOUBLES)]
    )
    keys = [named(c) for c in by]
    source = tried.select(*keys, F.size("__ys").cast("bigint").alias("__n"), "__ys", "__points", "__start")
    errors = source.mapInArrow(run, schema).select(*keys, "__n", F.posexplode("__errors").alias("__p", "__e"))
    summed = errors.groupBy(*keys, (F.col("__p") + 1).alias("trial_id")).agg(
        F.sum("__n").alias("n"), F.sum("__e").alias("sse")
    )
    point = [F.get(F.lit([p[i] for p in weights.points]), F.col("trial_id") - 1) for i in range(3)]
    return summed.select(
        *keys, "trial_id", *[c.alias(n) for c, n in zip(point, ("alpha", "beta", "gamma"))], "n", "sse"
    )


def smoothing_trials(
    panel: DataFrame,
    weights: Weights | None = None,
    mode: str = "additive",
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(by, trial_id, alpha, beta, gamma, n, sse): the squared one-step errors of every set of weights."""
    weights = weights or Weights()
    chunks = cut(_chunks(panel, y, mode, by, order, chunk_rows))
    known = _first_states(chunks, weights, by, chunk_rows)
    return _trials(chunks, known, weights, by, chunk_rows)


def fit_smoothing(
    panel: DataFrame,
    weights: Weights | None = None,
    mode: str = "additive",
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per series: trial_id, alpha, beta, gamma, n, sse, the first and last state, reason.

    The weights with the smallest squared error win, on equal errors the earlier trial. States are
    arrays: level, trend, then the season with the next row's phase first. The first state comes from the
    first two seasons: their means give level and trend, what the first season differs from its mean the
    phases. Mode 'multiplicative' smooths the logarithm. Rows without a value (or, there, without a positive
    one) are left out. A series with too few rows has NULLs and the reason 'too short'.
    """
    weights = weights or Weights()
    m, keys = weights.m, [named(c) for c in by]
    chunks = cut(_chunks(panel, y, mode, by, order, chunk_rows))
    known = cut(_first_states(chunks, weights, by, chunk_rows))
    trials = _trials(chunks, known, weights, by, chunk_rows)
    best = trials.groupBy(*keys).agg(
        F.min(F.struct("sse", "trial_id", "alpha", "beta", "gamma", "n")).alias("__best")
    )
    chosen = cut(best.select(*keys, "__best.*").join(known, list(by)))
    own = chosen.select(*keys, "__first", F.array("alpha", "beta", "gamma").alias("__points"))
    started = _with_starts(chunks, own, m, by, chunk_rows)
    ending = started.filter(F.col("__chunk") == F.expr(f"(__total - 1) div {chunk_rows}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 2 + m):
                end, _, _ = _run(part, m, zero=False)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in by], _lists(end)], names=[*by, "last_state"]
                )

    schema = T.StructType([*[chunks.schema[c] for c in by], T.StructField("last_state", DOUBLES)])
    ends = ending.select(*keys, "__ys", "__points", "__start").mapInArrow(run, schema)
    everyone = panel.select(*keys).distinct()
    fitted = chosen.withColumnRenamed("__first", "first_state").join(ends, list(by))
    return everyone.join(fitted, list(by), "left").select(
        *keys,
        "trial_id", "alpha", "beta", "gamma", "n", "sse", "first_state", "last_state",
        F.when(F.col("last_state").isNull(), "too short").alias("reason"),
    )


def smoothed_rows(
    model: DataFrame,
    panel: DataFrame,
    m: int = 12,
    mode: str = "additive",
    y: str = "y",
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(by, order, fitted, level, trend, season) of every row a model was fitted on, in units of the data.

    ``fitted`` is the forecast one row ahead; the others are the state after the row. In mode
    'multiplicative' trend and season are factors. Rows of series without a model are left out.
    """
    keys = [named(c) for c in by]
    chunks = cut(_chunks(panel, y, mode, by, order, chunk_rows))
    known = model.filter("reason is null").select(
        *keys, F.col("first_state").alias("__first"), F.array("alpha", "beta", "gamma").alias("__points")
    )
    started = _with_starts(chunks, cut(known), m, by, chunk_rows)
    names = ("fitted", "level", "trend", "season")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 4 * chunk_rows):
                _, _, rows = _run(part, m, zero=False, keep=True)
                ends = part.column("__ys").offsets
                sizes = np.diff(ends.to_numpy())
                flat = np.concatenate([rows[:n, i, 0] for i, n in enumerate(sizes)]) if len(sizes) else np.empty((0, 4))
                base = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(base, pa.array(np.ascontiguousarray(c))) for c in flat.T]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in by], part.column("__at"), *lists], names=[*by, "__at", *names]
                )

    schema = T.StructType(
        [*[chunks.schema[c] for c in by], chunks.schema["__at"], *[T.StructField(n, DOUBLES) for n in names]]
    )
    runs = started.select(*keys, "__at", "__ys", "__points", "__start").mapInArrow(run, schema)
    rows = runs.select(*keys, F.explode(F.arrays_zip("__at", *names)).alias("__r"))
    unit = (lambda c: F.exp(c)) if mode == "multiplicative" else (lambda c: c)
    return rows.select(
        *keys,
        *[F.col("__r.__at").getField(c).alias(c) for c in order],
        *[unit(F.col(f"__r.{n}")).alias(n) for n in names],
    )


def forecast_smoothing(
    model: DataFrame,
    future: DataFrame,
    m: int = 12,
    mode: str = "additive",
    interval_width: float = 0.95,
    by: Sequence[str] = ("series_id",),
    order: Sequence[str] = ("ds",),
) -> DataFrame:
    """(by, order, yhat, yhat_lower, yhat_upper, reason) for every future row, straight from the last state.

    ``future`` must follow the rows of the fit directly. The interval is that of the additive model with
    normal errors, whose variance grows with the horizon in closed form; in mode 'multiplicative' it is that of
    the logarithm. A series without a model has NULLs with the reason.
    """
    keys = [named(c) for c in by]
    rows = future.select(*[named(c) for c in [*by, *order]])
    placed = over_rows(rows, by, order, 0, lambda w, position, total: {"__h": position})
    joined = placed.join(model, list(by), "left")
    h = F.col("__h").cast("double")
    state = F.col("last_state")
    phase = F.get(state, (F.lit(2) + (F.col("__h") - 1) % F.lit(m)).cast("int"))
    centre = F.get(state, F.lit(0)) + h * F.get(state, F.lit(1)) + phase
    # sum over j < h of (alpha + alpha beta j + gamma where j closes a season) squared
    a, ab, g, n = F.col("alpha"), F.col("alpha") * F.col("beta"), F.col("gamma"), h - 1
    seasons = F.floor(n / F.lit(float(m))) if m > 1 else F.lit(0.0)
    spread = (
        a * a * n
        + a * ab * n * (n + 1)
        + ab * ab * n * (n + 1) * (2 * n + 1) / 6.0
        + seasons * (g * g + 2 * g * a)
        + g * ab * m * seasons * (seasons + 1)
    )
    half = F.lit(NormalDist().inv_cdf(0.5 + interval_width / 2)) * F.sqrt(F.col("sse") / F.col("n") * (1 + spread))
    unit = F.exp if mode == "multiplicative" else (lambda c: c)
    missing = F.when(F.col("last_state").isNull(), F.coalesce("reason", F.lit("no model")))
    return joined.select(
        *keys,
        *[named(c) for c in order],
        unit(centre).alias("yhat"),
        unit(centre - half).alias("yhat_lower"),
        unit(centre + half).alias("yhat_upper"),
        missing.alias("reason"),
    )
