"""Implausible readings per series: impossible, frozen and spiking values, by a hidden Markov model with hard bounds.

A series' values are cut into blocks of time, each with a few values of its neighbours as context, so that no task holds a
whole series however long it is. The model has four states (normal, spike, stuck, out of range) and is fitted to every
series by Baum-Welch: blocks give expected counts, which are added up by series. Fitted are how far normal values stand out
from both their neighbours, how far spikes do, how often normal values repeat, and the moves between the states. Readings
beyond the hard bounds (the range, a run of ``stuck_run`` equal values) are certain. A reading is flagged if forward-backward
gives it to another state than normal with a probability of one half or more. What a series may be fitted to is bounded so
that a value that stands out by more than the limit is always flagged (see ``bounded``); an exact rule may then be asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quagmark.nulls import present

#: Values are compared as whole billionths, so that 1.3 - 0.3 is exactly 10 times 0.1.
UNIT = 1e9
#: Beyond this many units a value counts as whole billionths no more but keeps its order (values so large are out of any range).
LARGEST = float(1 << 61)
SPIKE_VALUES = 3

NORMAL, SPIKE, STUCK, OUT = range(4)
STATES = ["normal", "spike", "stuck", "out_of_range"]
START = np.array([0.94, 0.02, 0.02, 0.02])
MOVES = np.array([[0.965, 0.020, 0.005, 0.010], [0.600, 0.380, 0.010, 0.010], [0.050, 0.010, 0.930, 0.010], [0.500, 0.010, 0.010, 0.480]])

#: Parameters of a series: mean of the positive ``stands`` of normal values, log of the median of a spike's, share of normal values that repeat; the moves follow.
FIRST = np.concatenate([[0.05, 0.7, 0.05], MOVES.ravel()])
#: How many values' worth the first parameters count beside a series' own.
PRIOR = 50.0
#: Standing out by more than this many limits tells no more (it is infinite where the median step is 0).
FARTHEST = 1000.0
LOWEST, HIGHEST = np.array([0.005, -1.2, 0.001]), np.array([0.07, 3.4, 0.3])


def edges(blocks: DataFrame, series: list[str], block: str, array: str, n: int) -> DataFrame:
    """(series, block, prev, next): the last ``n`` elements of ``array`` before and the first ``n`` after each block of its series.

    The window runs over the blocks' ends only (at most 2n elements each), not over the blocks themselves. Every block must have an element.
    """
    ends = blocks.select(*series, block, F.slice(array, 1, n).alias("__head"), F.when(F.size(array) > n, F.slice(array, -n, n)).otherwise(F.col(array)).alias("__tail"))
    w = Window.partitionBy(*series).orderBy(block)
    before = F.flatten(F.collect_list("__tail").over(w.rowsBetween(-n, -1)))
    after = F.flatten(F.collect_list("__head").over(w.rowsBetween(1, n)))
    both = ends.select(*series, block, before.alias("__b"), F.slice(after, 1, n).alias("next"))
    return both.select(*series, block, F.when(F.size("__b") > n, F.slice("__b", -n, n)).otherwise(F.col("__b")).alias("prev"), "next")


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the length of each list."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(zero_copy_only=False), lengths


def weave(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lists joined row by row: the values, and of each part the places that its values take."""
    lengths = np.stack([n for _, n in parts])
    starts = np.concatenate([[0], np.cumsum(lengths.T.ravel())[:-1]]).reshape(-1, len(parts)).T if lengths.size else np.zeros((len(parts), 0), np.int64)
    out = np.empty(int(lengths.sum()), dtype=np.result_type(*(v.dtype for v, _ in parts)))
    places = []
    for (values, n), at in zip(parts, starts, strict=True):
        place = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(values))
        out[place] = values
        places.append(place)
    return out, places


def run_lengths(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each value the number of successive equal values in its row that it belongs to."""
    if not len(values):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
    ids = np.cumsum(new) - 1
    return np.bincount(ids)[ids]


def isolation(values: np.ndarray, row: np.ndarray, longest: int = SPIKE_VALUES) -> np.ndarray:
    """For each value the most by which a group of up to ``longest`` successive values with it lies above, or below, both the value before and the value after the group."""
    n = len(values)
    best = np.full(n, -np.inf)
    for size in range(1, longest + 1):
        starts = np.arange(1, n - size)
        if not len(starts):
            break
        starts = starts[row[starts - 1] == row[starts + size]]
        group = np.stack([values[starts + k] for k in range(size)])
        before, after = values[starts - 1], values[starts + size]
        stands = np.maximum(group.min(axis=0) - np.maximum(before, after), np.minimum(before, after) - group.max(axis=0))
        for k in range(size):
            np.maximum.at(best, starts + k, stands)
    return best


def bounded(p: np.ndarray) -> np.ndarray:
    """Parameters within their bounds, one row per series.

    At a value that stands out by the limit (1) the normal density is exp(-11.6) or less and that of spikes exp(-3.5) or more; by
    the floors of the moves neighbours speak against a spike by a factor of 0.02 * 0.3 at most, whatever their states. So the
    odds of a spike are above 1 there, and the model finds all that the exact rule finds.
    """
    out = p.copy()
    out[:, :3] = np.clip(p[:, :3], LOWEST, HIGHEST)
    moves = np.maximum(out[:, 3:].reshape(-1, 4, 4), 1e-4)
    moves[:, :, SPIKE] = np.maximum(moves[:, :, SPIKE], 0.025 * moves[:, :, NORMAL])
    moves[:, SPIKE] = np.maximum(moves[:, SPIKE], 0.4 * moves[:, NORMAL])
    out[:, 3:] = (moves / moves.sum(axis=2, keepdims=True)).reshape(-1, 16)
    return out


def refitted(sums: np.ndarray) -> np.ndarray:
    """Parameters from the expected counts of ``expected``, one row per series: the maximum a posteriori with ``PRIOR`` values of the first parameters."""
    kept = sums[:, 6:].reshape(-1, 4, 4)
    moves = kept + PRIOR * MOVES
    first = [(sums[:, 2 * k] + PRIOR * FIRST[k]) / (sums[:, 2 * k + 1] + PRIOR) for k in range(3)]
    return bounded(np.concatenate([np.stack(first, axis=1), (moves / moves.sum(axis=2, keepdims=True)).reshape(-1, 16)], axis=1))


def evidence(out: np.ndarray, run: np.ndarray, stands: np.ndarray, stuck_run: int, p: np.ndarray) -> np.ndarray:
    """Log-likelihoods of the states, one row per value; ``p``: the parameters of each value's series."""
    positive = np.flatnonzero(stands > 0)
    s = np.minimum(stands[positive], FARTHEST)
    spread, middle = p[positive, 0], p[positive, 1]
    normal, spike = np.zeros(len(out)), np.full(len(out), -20.0)
    normal[positive] = -np.log(spread) - s / spread
    spike[positive] = middle - 2 * np.log(np.exp(middle) + s)
    same = (run - 1) / run  # a run's equalities, dealt to its values
    repeats = np.log1p(-p[:, 2])
    again = np.flatnonzero(run > 1)
    repeats[again] = same[again] * np.log(p[again, 2]) + (1 - same[again]) * repeats[again]
    ll = np.empty((len(out), 4))
    ll[:, NORMAL] = normal + repeats
    ll[:, SPIKE] = spike + repeats
    ll[:, STUCK] = np.maximum(normal, -20.0) + same * np.log(0.98) + (1 - same) * np.log(0.02)
    ll[:, OUT] = -60.0
    ll = np.maximum(ll, ll.max(axis=1, keepdims=True) - 200.0)
    ll[run >= stuck_run] = [-200.0, -200.0, 0.0, -200.0]
    ll[out] = [-200.0, -200.0, -200.0, 0.0]
    return ll


def forward_backward(evidence: np.ndarray, lengths: np.ndarray, moves: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities, one row per value, of rows of values one after the other, and per row the expected moves.

    ``evidence``: log-likelihoods, one column per state; ``lengths`` and ``moves``: of each row (lengths above 0). Rows of like
    length are worked at together, so that memory goes with the number of values. Moves are zero unless ``counted``.
    """
    p, expected = np.empty_like(evidence), np.zeros((len(lengths), 4, 4))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(lengths, kind="stable")
    while len(order):
        rows = order[-max(1, 400_000 // int(lengths[order[-1]])) :]
        order = order[: len(order) - len(rows)]
        n, m = lengths[rows], np.ascontiguousarray(moves[rows].transpose(1, 2, 0))
        longest = int(n.max())
        row = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        place = np.repeat(starts[rows], n) + at
        own = evidence[place]
        e = np.ones((longest, 4, len(rows)))
        e[at, :, row] = np.exp(own - own.max(axis=1, keepdims=True))
        forward = np.empty_like(e)
        a = START[:, None] * e[0]
        forward[0] = a / a.sum(axis=0)
        for t in range(1, longest):
            a = (forward[t - 1][:, None] * m).sum(axis=0) * e[t]
            forward[t] = a / a.sum(axis=0)
        backward = np.ones_like(e[0])
        added = np.zeros_like(m)
        for t in range(longest - 1, -1, -1):
            ahead = m * (e[t] * backward)
            if counted and t:
                both = forward[t - 1][:, None] * ahead
                added += both * ((t < n) / both.sum(axis=(0, 1)))
            forward[t] *= backward
            backward = ahead.sum(axis=1)
            backward /= backward.sum(axis=0)
        forward /= forward.sum(axis=1, keepdims=True)
        expected[rows] = added.transpose(2, 0, 1)
        p[place] = forward[at, :, row]
    return p, expected


def expected(p: np.ndarray, moves: np.ndarray, lengths: np.ndarray, run: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Per row the sums that ``refitted`` takes: numerator and denominator of each of the three first parameters, and the moves."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    positive = np.flatnonzero(stands > 0)
    s = np.minimum(stands[positive], FARTHEST)
    add = lambda x, at: np.bincount(row[at], x, minlength=len(lengths))
    every = slice(None)
    normal, spike = p[positive, NORMAL], p[positive, SPIKE]
    first = [add(normal * s, positive), add(normal, positive), add(spike * np.log(s), positive), add(spike, positive), add(p[:, NORMAL] * (run - 1) / run, every), add(p[:, NORMAL], every)]
    return np.concatenate([np.stack(first, axis=1), moves.reshape(len(lengths), 16)], axis=1)


def _first_rules(bounds: tuple[float, float], stuck_run: int, key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = flat(b["v"])
            prev, after = flat(b["prev"]), flat(b["next"])
            values, (_, mine, _) = weave([prev, (own, n), after])
            row = np.repeat(np.arange(len(n)), n + prev[1] + after[1])
            run = run_lengths(values, row)[mine]
            unit = np.rint(np.clip(values * UNIT, -LARGEST, LARGEST)).astype(np.int64)
            step = np.abs(np.diff(unit, prepend=0))
            has_before = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
            out = (own < bounds[0]) | (own > bounds[1])
            clean = ~out & (run < stuck_run)
            of = np.repeat(np.arange(len(n)), n)
            lists = lambda x, keep: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(n)))]), pa.int32()), pa.array(x[keep]))  # noqa: B023, E731
            every = np.ones(len(own), bool)
            yield pa.RecordBatch.from_arrays(
                [*(b[k] for k in key), lists(flat(b["id"])[0], every), lists(out, every), lists(np.minimum(run, stuck_run).astype(np.int32), every), lists(unit[mine], clean), lists(step[mine], has_before[mine])],
                names=[*key, "id", "out", "run", "clean", "step"],
            )

    return work


def _features(stuck_run: int, times: float, key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per value, how far it stands out, the limit being 1, and whether that is above the limit exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = flat(b["id"])[1]
            out, run = flat(b["out"])[0].astype(bool), flat(b["run"])[0].astype(np.int64)
            own, prev, after = flat(b["clean"]), flat(b["prev"]), flat(b["next"])
            values, (_, mine, _) = weave([prev, own, after])
            row = np.repeat(np.arange(len(n)), own[1] + prev[1] + after[1])
            alone = isolation(values.astype(float), row)[mine]
            limit = times * b["median"].to_numpy(zero_copy_only=False).astype(float)
            limit = np.where(np.isnan(limit), np.inf, limit)[np.repeat(np.arange(len(n)), own[1])]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = np.where(alone <= 0, 0.0, np.where(limit == 0, np.inf, alone / limit))
            clean = ~out & (run < stuck_run)
            stands, rule = np.zeros(len(out), np.float32), out | (run >= stuck_run)
            stands[clean], rule[clean] = share, alone > limit
            at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (flat(b["id"])[0], out, run.astype(np.int32), stands, rule)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in key), *lists], names=[*key, "id", "out", "run", "stands", "rule"])

    return work


def _judged(b: pa.RecordBatch, stuck_run: int, counted: bool) -> tuple[np.ndarray, ...]:
    out, n = flat(b["out"])
    run, stands = flat(b["run"])[0].astype(np.int64), flat(b["stands"])[0].astype(float)
    params, width = flat(b["params"]) if "params" in b.schema.names else (np.tile(FIRST, len(n)), None)
    params = params.reshape(-1, len(FIRST))
    p, moves = forward_backward(evidence(out.astype(bool), run, stands, stuck_run, np.repeat(params, n, axis=0)), n, params[:, 3:].reshape(-1, 4, 4), counted)
    return p, moves, n, run, stands


def _expectations(stuck_run: int, key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per key and batch the expected counts, added up over the batch's blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                p, moves, n, run, stands = _judged(b, stuck_run, True)
                sums = expected(p, moves, n, run, stands)
                keys = pa.table([b[k] for k in key], names=key)
                groups = keys.append_column("__row", pa.array(np.arange(len(n)))).group_by(key).aggregate([("__row", "list")])
                which, size = flat(groups["__row_list"])
                added = np.add.reduceat(sums[which], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
                columns = pa.FixedSizeListArray.from_arrays(pa.array(added.ravel()), added.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(groups[k].combine_chunks() for k in key), columns], names=[*key, "sums"])

    return work


def _states(stuck_run: int, key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                p, _, n, _, _ = _judged(b, stuck_run, False)
                keep = np.flatnonzero(p[:, NORMAL] < 0.5)
                of = np.repeat(np.arange(len(n)), n)[keep]
                state = p[keep][:, 1:].argmax(axis=1) + 1
                columns = [flat(b["id"])[0][keep], np.array(STATES, object)[state], 1 - p[keep][:, NORMAL], flat(b["rule"])[0].astype(bool)[keep]]
                yield pa.RecordBatch.from_arrays([*(b[k].take(pa.array(of)) for k in key), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.bool_()), strict=True))], names=[*key, "rec_id", "state", "p", "rule"])

    return work


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _refit(sums: pd.Series) -> pd.Series:
    return pd.Series(list(refitted(np.stack(sums.to_list())))) if len(sums) else pd.Series([], dtype=object)


def value_blocks(df: DataFrame, series: list[str], time: str, rec_id: str, fields: list[str], days: int) -> DataFrame:
    """Per series, field and block of ``days`` days the arrays ``id`` and ``v`` of the values, without null and NaN, in order of time.

    Of several rows of a series and time the one with the smallest id counts; copies are combined before the shuffle. Rows
    with a null series, time or id are left out.
    """
    once = present(df, *series, time, rec_id).groupBy(*series, F.unix_micros(time).alias("__t")).agg(F.min(F.struct(F.col(rec_id).cast("long").alias("id"), *fields)).alias("__r"))
    width = days * 86_400_000_000
    placed = once.select(*series, F.expr(f"(__t - pmod(__t, {width}L)) div {width}L").alias("block"), F.struct("__t", "__r.*").alias("__p"))
    lists = placed.groupBy(*series, "block").agg(F.array_sort(F.collect_list("__p")).alias("__s"))

    def of(f: str):
        own = F.filter("__s", lambda x: x[f].isNotNull() & ~F.isnan(x[f].cast("double")))
        return F.struct(F.lit(f).alias("field"), F.transform(own, lambda x: x["id"]).alias("id"), F.transform(own, lambda x: x[f].cast("double")).alias("v"))

    split = lists.select(*series, "block", F.inline(F.array(*map(of, fields))))
    return split.select(*series, "field", "block", "id", "v").where(F.size("v") > 0)


def implausible(df: DataFrame, series: list[str], time: str, rec_id: str, fields: list[str], keep: Callable[[DataFrame], DataFrame], bounds: tuple[float, float] = (-100.0, 100.0), stuck_run: int = 12, times: float = 10.0, days: int = 8, fits: int = 1) -> DataFrame:
    """The flagged readings: (series, field, rec_id, state, p, rule), p being the probability that the value is not normal.

    The model is fitted to each series and field in ``fits`` steps of Baum-Welch from common first parameters. ``rule`` says
    whether the reading is a case by the exact rule too: outside ``bounds``; in a run of ``stuck_run`` or more equal values; in a
    group of one to three values that all lie above, or all below, both neighbours by more than ``times`` the series' median
    absolute step, where values of the first two kinds are passed over as neighbours. Every case of the rule is flagged (see
    ``bounded``). A series with fewer than two values has no median and no spikes. ``keep`` materialises intermediates that are
    used several times (a checkpoint). Ties in time: see ``value_blocks``; an empty table gives an empty result; further columns are ignored.
    """
    key = [*series, "field"]
    blocks = value_blocks(df, series, time, rec_id, fields, days)
    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*key, "block"])
    judged = blocks.join(edges(blocks, key, "block", "v", stuck_run - 1), [*key, "block"])
    judged = keep(judged.mapInArrow(_first_rules(bounds, stuck_run, [*key, "block"]), f"{schema}, id array<long>, out array<boolean>, run array<int>, clean array<long>, step array<long>"))
    counts = judged.select(*key, F.explode("step").alias("step")).groupBy(*key, "step").agg(F.count("*").alias("n"))
    medians = counts.groupBy(*key).agg(F.expr("percentile(step, 0.5, n)").alias("median"))
    around = edges(judged.where(F.size("clean") > 0), key, "block", "clean", SPIKE_VALUES + 1).join(medians, key, "left")
    ready = judged.drop("step").join(around, [*key, "block"], "left")
    ready = ready.select(*key, "id", "out", "run", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("clean", "prev", "next")), "median")
    shown = ", ".join(f"`{k}` {types[k]}" for k in key)
    features = keep(ready.mapInArrow(_features(stuck_run, times, key), f"{shown}, id array<long>, out array<boolean>, run array<int>, stands array<float>, rule array<boolean>"))
    seen, width = features, 6 + MOVES.size
    for _ in range(fits):
        sums = seen.mapInArrow(_expectations(stuck_run, key), f"{shown}, sums array<double>")
        added = sums.groupBy(*key).agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(width))).alias("sums"))
        seen = features.join(added.select(*key, _refit("sums").alias("params")), key)
    return seen.mapInArrow(_states(stuck_run, key), f"{shown}, rec_id long, state string, p double, rule boolean")
