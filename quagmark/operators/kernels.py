"""Linear algebra per group, on arrays: network inversion, phase linking, Bayesian smoothing, Gaussian processes.

Each group is one pixel or series, of a size that its acquisition network bounds; groups are independent, so the work spreads.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def per_group(df: DataFrame, on: list[str], kernel: Callable[[pd.DataFrame], dict], out: str) -> DataFrame:
    """``kernel`` on the rows of every key; it returns the columns of ``out`` (a schema without the key)."""
    names = [f.name for f in df.limit(0).select(*on).schema]
    keys = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        result = pd.DataFrame(kernel(pdf))
        for n, v in zip(names, key, strict=True):
            result[n] = v
        return result

    return df.groupBy(*on).applyInPandas(work, f"{out}, {keys}")


def _network(pdf: pd.DataFrame, t1: str, t2: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dates = np.unique(np.concatenate([pdf[t1].to_numpy(), pdf[t2].to_numpy()]))
    return dates, np.searchsorted(dates, pdf[t1].to_numpy()), np.searchsorted(dates, pdf[t2].to_numpy())


def invert_network(pairs: DataFrame, on: list[str], t1: str, t2: str, value: str, weight: str, min_pairs: int = 2, ridge: float = 0.0) -> DataFrame:
    """Per key the series (t, level, covered) whose increments fit the pairs by weighted least squares of minimum norm.

    t1 and t2 are whole numbers (days). Increments that no pair spans are not ``covered``, they count as 0 in the level; keys with
    fewer than ``min_pairs`` usable pairs (value and weight known, weight above 0) give nothing.
    """
    usable = pairs.where(F.col(value).isNotNull() & (F.col(weight) > 0) & (F.col(t2) > F.col(t1)))

    def kernel(pdf: pd.DataFrame) -> dict:
        if len(pdf) < min_pairs:
            return {"t": np.array([], int), "level": np.array([]), "covered": np.array([], bool)}
        dates, i, j = _network(pdf, t1, t2)
        k = np.arange(len(dates) - 1)
        a = ((k >= i[:, None]) & (k < j[:, None])).astype(float)
        w = np.sqrt(pdf[weight].to_numpy(float))
        x = np.linalg.lstsq(a * w[:, None], pdf[value].to_numpy(float) * w, rcond=None)[0]
        covered = a.any(axis=0)
        x[~covered] = 0
        return {"t": dates.astype(int), "level": np.concatenate([[0.0], np.cumsum(x)]), "covered": np.concatenate([[True], covered])}

    return per_group(usable.select(*on, t1, t2, value, weight), on, kernel, "t long, level double, covered boolean")


def link_phases(pairs: DataFrame, on: list[str], t1: str, t2: str, phase: str, coh: str, floor: float = 0.0) -> DataFrame:
    """Per key the phase history (t, phase) as the leading eigenvector of the coherence-weighted network, zero at the first date, and its temporal coherence."""
    usable = pairs.where(F.col(phase).isNotNull() & (F.col(coh) > floor))

    def kernel(pdf: pd.DataFrame) -> dict:
        dates, i, j = _network(pdf, t1, t2)
        c = np.eye(len(dates), dtype=complex)
        z = pdf[coh].to_numpy(float) * np.exp(1j * pdf[phase].to_numpy(float))
        c[j, i], c[i, j] = z, z.conj()
        v = np.linalg.eigh(c)[1][:, -1]
        history = np.angle(v * v[0].conj())
        fit = np.abs(np.mean(np.exp(1j * (pdf[phase].to_numpy(float) - (history[j] - history[i])))))
        return {"t": dates.astype(int), "phase": history, "tcoh": np.full(len(dates), fit)}

    return per_group(usable.select(*on, t1, t2, phase, coh), on, kernel, "t long, phase double, tcoh double")


def ou_smooth(pairs: DataFrame, on: list[str], t1: str, t2: str, y: str, sd: str, tau_days: float, sigma: float, cycle: float = 0.0, min_gain: float = 9.0) -> DataFrame:
    """Per key the posterior (t, mean, sd) of an Ornstein-Uhlenbeck level given differences over pairs; with a ``cycle``, whole cycles are taken off one pair after the other while that lowers minus twice the log-likelihood by ``min_gain``."""
    usable = pairs.where(F.col(y).isNotNull() & (F.col(sd) > 0))

    def kernel(pdf: pd.DataFrame) -> dict:
        dates, i, j = _network(pdf, t1, t2)
        n, t = len(dates), dates.astype(float)
        q = np.zeros((n, n))
        rho = np.exp(-np.diff(t) / tau_days)
        s2 = sigma * sigma
        q[0, 0] = 1 / s2
        for k, r in enumerate(rho):
            v = 1 / (s2 * (1 - r * r))
            q[k, k] += r * r * v
            q[k + 1, k + 1] += v
            q[k, k + 1] -= r * v
            q[k + 1, k] -= r * v
        d = np.zeros((len(pdf), n))
        rows = np.arange(len(pdf))
        d[rows, j], d[rows, i] = 1, -1
        w = 1 / pdf[sd].to_numpy(float) ** 2
        obs = pdf[y].to_numpy(float).copy()
        cov = np.linalg.inv(q + d.T @ (d * w[:, None]))
        # precision of the observations with the level integrated out: what an observation says against all others
        g = np.diag(w) - (w[:, None] * d) @ cov @ (d.T * w)
        while cycle:  # every round lowers a sum that is not below 0 by min_gain, so they end
            pull, own = g @ obs, np.diag(g)
            turns = np.rint(pull / (own * cycle))
            gain = 2 * cycle * turns * pull - (cycle * turns) ** 2 * own
            k = int(gain.argmax())
            if turns[k] == 0 or gain[k] < min_gain:
                break
            obs[k] -= turns[k] * cycle
        mean = cov @ (d.T @ (w * obs))
        return {"t": dates.astype(int), "mean": mean, "sd": np.sqrt(np.diag(cov))}

    return per_group(usable.select(*on, t1, t2, y, sd), on, kernel, "t long, mean double, sd double")


def gp_leave_one_out(df: DataFrame, on: list[str], rec_id: str, x: str, y: str, length: float, noise: float) -> DataFrame:
    """Per key leave-one-out predictions of a Gaussian process with a squared-exponential kernel (unit prior variance after standardising y)."""
    usable = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    kind = df.schema[rec_id].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> dict:
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        middle, scale = b.mean(), b.std() or 1.0
        k = np.exp(-0.5 * ((a[:, None] - a) / length) ** 2) + noise * np.eye(len(a))
        inverse = np.linalg.inv(k)
        z = (b - middle) / scale
        return {rec_id: pdf[rec_id].to_numpy(), "loo": middle + scale * (z - (inverse @ z) / np.diag(inverse)), "sd": scale / np.sqrt(np.diag(inverse))}

    return per_group(usable.select(*on, rec_id, x, y), on, kernel, f"`{rec_id}` {kind}, loo double, sd double")


def uncertain_sd(sd: Column, p_detect: Column, miss: float, floor: float = 0.05) -> Column:
    """Observation spread that grows towards ``miss``, the error scale of a missed cycle, as the chance of seeing the motion falls: the variance of a mixture."""
    p = F.least(F.greatest(p_detect, F.lit(floor)), F.lit(1.0))
    return F.sqrt(sd * sd + (1 - p) * miss * miss)


def increment_smooth(pairs: DataFrame, on: list[str], t1: str, t2: str, y: str, sd: str, p_detect: str, tau_days: float, sigma: float, miss: float) -> DataFrame:
    """Per key the posterior (t, mean, sd) of an Ornstein-Uhlenbeck level from its own increments only, each as sure as it is likely to be seen."""
    surer = pairs.withColumn(sd, uncertain_sd(F.col(sd), F.coalesce(F.col(p_detect), F.lit(0.0)), miss))
    return ou_smooth(surer, on, t1, t2, y, sd, tau_days, sigma)


def ou_bands(t: np.ndarray, tau: float, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the precision of a stationary Ornstein-Uhlenbeck process at increasing times."""
    rho = np.exp(-np.diff(t) / tau)
    v = 1 / (sigma * sigma * (1 - rho * rho))
    main = np.zeros(len(t))
    main[0] = 1 / (sigma * sigma)
    main[1:] += v
    main[:-1] += rho * rho * v
    return main, -rho * v


def space_time_smooth(pairs: DataFrame, on: list[str], row: str, col: str, t1: str, t2: str, factor: str, y: str, sd: str, tau_days: float, sigma: float, kappa: float, close: float = 1e-9, most_steps: int = 5000) -> DataFrame:
    """Per key (row, col, t, mean): the posterior mean of levels in space and time given differences of levels over pairs of dates.

    The prior couples time by an Ornstein-Uhlenbeck process and space by the Laplacian of the pixels' four neighbours, as
    (1 + kappa L) x Q. An observation is ``factor`` times the change of its pixel's level, with spread ``sd``. The system is never
    built: conjugate gradients apply it, scaled by its diagonal; an error is raised if they do not come ``close``. A key is one site, of a size that its network bounds.
    """
    usable = pairs.where(F.col(y).isNotNull() & (F.col(sd) > 0) & F.col(factor).isNotNull() & F.col(row).isNotNull() & F.col(col).isNotNull() & (F.col(t2) > F.col(t1)))

    def kernel(pdf: pd.DataFrame) -> dict:
        dates, i, j = _network(pdf, t1, t2)
        cells, px = np.unique(pdf[[row, col]].to_numpy(np.int64), axis=0, return_inverse=True)
        px = px.ravel()
        number = {tuple(c): k for k, c in enumerate(cells)}
        sides = [(k, number[r + dr, c + dc]) for k, (r, c) in enumerate(map(tuple, cells)) for dr, dc in ((0, 1), (1, 0)) if (r + dr, c + dc) in number]
        one, two = (np.array([e[x] for e in sides], int) for x in (0, 1))
        main, off = ou_bands(dates.astype(float), tau_days, sigma)
        f, w, obs = pdf[factor].to_numpy(float), pdf[sd].to_numpy(float) ** -2, pdf[y].to_numpy(float)
        shape = (len(cells), len(dates))

        def back(z: np.ndarray) -> np.ndarray:
            out = np.zeros(shape)
            np.add.at(out, (px, j), f * z)
            np.add.at(out, (px, i), -f * z)
            return out

        def apply(x: np.ndarray) -> np.ndarray:
            near = x.copy()
            step = kappa * (x[one] - x[two])
            np.add.at(near, one, step)
            np.add.at(near, two, -step)
            out = near * main
            out[:, 1:] += near[:, :-1] * off
            out[:, :-1] += near[:, 1:] * off
            return out + back(w * f * (x[px, j] - x[px, i]))

        degree = np.bincount(np.concatenate([one, two]), minlength=len(cells))
        diagonal = (1 + kappa * degree)[:, None] * main
        np.add.at(diagonal, (px, j), w * f * f)
        np.add.at(diagonal, (px, i), w * f * f)
        b = back(w * obs)
        x, r = np.zeros(shape), b
        z = r / diagonal
        p, rz = z, (r * z).sum()
        for _ in range(most_steps):
            if np.sqrt((r * r).sum()) <= close * np.sqrt((b * b).sum()):
                break
            ap = apply(p)
            alpha = rz / (p * ap).sum()
            x, r = x + alpha * p, r - alpha * ap
            z = r / diagonal
            before, rz = rz, (r * z).sum()
            p = z + rz / before * p
        else:
            raise ValueError(f"the smoother does not come close in {most_steps} steps")
        k, t = np.indices(shape)
        return {row: cells[k.ravel(), 0], col: cells[k.ravel(), 1], "t": dates.astype(np.int64)[t.ravel()], "mean": x.ravel()}

    return per_group(usable.select(*on, row, col, t1, t2, factor, y, sd), on, kernel, f"`{row}` long, `{col}` long, t long, mean double")


#: Length scales (in spreads of the features) and shares of noise that a Gaussian process may be fitted to.
GP_LENGTHS, GP_NOISES = (0.3, 0.5, 0.8, 1.3, 2.0, 3.5, 6.0, 10.0, 20.0), (0.001, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0)


class Transfer:
    """A Gaussian process with a squared-exponential kernel over standardised features, fitted by the likelihood on a grid."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.at, self.by = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        self.x, self.middle, self.scale = (x - self.at) / self.by, y.mean(), y.std() or 1.0
        z = (y - self.middle) / self.scale
        d2 = ((self.x[:, None] - self.x) ** 2).sum(axis=2)
        best = None
        for length in GP_LENGTHS:
            k = np.exp(-0.5 * d2 / length**2)
            for noise in GP_NOISES:
                cov = k + noise * np.eye(len(y))
                v = (z @ np.linalg.solve(cov, z)) / len(y)
                score = -0.5 * (len(y) * np.log(max(v, 1e-12)) + np.linalg.slogdet(cov)[1])
                if best is None or score > best[0]:
                    best = (score, length, noise, v, cov)
        _, self.length, self.noise, self.variance, cov = best
        self.inverse = np.linalg.inv(cov)
        self.weights = self.inverse @ z
        self.loo = self.middle + self.scale * (z - self.weights / np.diag(self.inverse))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (x - self.at) / self.by
        d2 = (u * u).sum(axis=1)[:, None] + (self.x * self.x).sum(axis=1) - 2 * u @ self.x.T
        k = np.exp(-0.5 * np.maximum(d2, 0) / self.length**2)
        left = 1 + self.noise - np.einsum("ij,jk,ik->i", k, self.inverse, k)
        return self.middle + self.scale * (k @ self.weights), self.scale * np.sqrt(self.variance * np.maximum(left, 0))


def gp_transfer(points: DataFrame, rec_id: str, vector: str, train: DataFrame, train_vector: str, y: str, most: int = 2000) -> tuple[DataFrame, dict[str, float]]:
    """(rec_id, mean, sd) of a trait for every point, learnt from plots where it is known, and the skill of leaving plots out against their mean.

    ``train`` is a table of plots, bounded by ``most`` (else an error); points are predicted where they lie.
    """
    rows = train.select(train_vector, y).dropna().orderBy(y).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} training points")
    x, known = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    model = Transfer(x, known)
    without = (known.sum() - known) / (len(known) - 1)
    rmse, plain = (float(np.sqrt(np.mean((p - known) ** 2))) for p in (model.loo, without))

    @F.pandas_udf("struct<mean:double,sd:double>")
    def predicted(v: pd.Series) -> pd.DataFrame:
        mean, sd = model.predict(np.stack(v.to_numpy()).astype(float))
        return pd.DataFrame({"mean": mean, "sd": sd})

    out = points.where(F.col(vector).isNotNull()).select(rec_id, predicted(vector).alias("p")).select(rec_id, "p.mean", "p.sd")
    return out, {"rmse_loo": rmse, "rmse_mean": plain, "skill": 1 - (rmse / plain) ** 2 if plain > 0 else float("nan")}


def bayes_line(df: DataFrame, on: list[str], columns: list[str], y: str, prior_sd: float = 10.0, close: float = 1e-9, most_rounds: int = 10_000) -> DataFrame:
    """Per key the posterior mean of regression coefficients with a normal prior and an estimated noise scale, from sums of products only.

    The scale is refitted until it changes by less than ``close`` of itself; an error is raised if ``most_rounds`` do not reach that.
    """
    from quagmark.operators.stats import normal_sums

    k = len(columns)
    known = df.dropna(subset=[*columns, y])
    s = known.groupBy(*on).agg(*normal_sums([F.col(c).cast("double") for c in columns], F.col(y)))
    packed = s.select(*on, F.col("__n").alias("n"), F.array(*(F.col(f"__a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)), *(F.col(f"__b{i}") for i in range(k)), F.col("__yy")).alias("__s"))

    @F.pandas_udf("array<double>")
    def posterior(sums: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for v, m in zip(sums, n, strict=True):
            v = np.asarray(v, float)
            a, b, yy = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-1]
            noise = max(yy / max(m, 1), 1e-12)
            for _ in range(most_rounds):
                beta = np.linalg.solve(a / noise + np.eye(k) / prior_sd**2, b / noise)
                before, noise = noise, max((yy - 2 * beta @ b + beta @ a @ beta) / max(m, 1), 1e-12)
                if abs(noise - before) <= close * before:
                    break
            else:
                raise ValueError(f"the noise scale does not settle in {most_rounds} rounds")
            out.append([*beta, np.sqrt(noise)])
        return pd.Series(out)

    return packed.select(*on, "n", posterior("__s", "n").alias("b"))


def coherence(pixels: DataFrame, on: list[str], re1: str, im1: str, re2: str, im2: str) -> DataFrame:
    """Sample coherence of two complex images over the rows of a key."""
    s = pixels.groupBy(*on).agg(
        F.sum(F.col(re1) * F.col(re2) + F.col(im1) * F.col(im2)).alias("__re"), F.sum(F.col(im1) * F.col(re2) - F.col(re1) * F.col(im2)).alias("__im"),
        F.sum(F.col(re1) ** 2 + F.col(im1) ** 2).alias("__p1"), F.sum(F.col(re2) ** 2 + F.col(im2) ** 2).alias("__p2"), F.count("*").alias("n"),
    )
    return s.select(*on, F.try_divide(F.hypot("__re", "__im"), F.sqrt(F.col("__p1") * F.col("__p2"))).alias("coherence"), F.atan2("__im", "__re").alias("phase"), "n")


def ks_statistic(df: DataFrame, on: list[str], value: str, first) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, by running shares."""
    from pyspark.sql import Window

    v = df.where(F.col(value).isNotNull()).withColumn("__f", first).groupBy(*on, value).agg(F.count_if("__f").alias("__a"), F.count_if(~F.col("__f")).alias("__b"))
    w, up = Window.partitionBy(*on), Window.partitionBy(*on).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("__d", F.abs(F.try_divide(F.sum("__a").over(up), F.sum("__a").over(w)) - F.try_divide(F.sum("__b").over(up), F.sum("__b").over(w))))
    return v.groupBy(*on).agg(F.max("__d").alias("ks"), F.sum("__a").alias("n1"), F.sum("__b").alias("n2"))


#: Fixed value: the Kolmogorov-Smirnov c of 5 %.
KS_C = 1.358


@F.pandas_udf(T.DoubleType())
def ks_of_arrays(a: pd.Series, b: pd.Series) -> pd.Series:
    """Kolmogorov-Smirnov distance of two arrays of numbers, ties included."""
    out = np.empty(len(a))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.sort(x), np.sort(y)
        every = np.concatenate([x, y])
        out[k] = np.abs(np.searchsorted(x, every, "right") / len(x) - np.searchsorted(y, every, "right") / len(y)).max()
    return pd.Series(out)


def homogeneous(pixels: DataFrame, on: list[str], row: str, col: str, amplitudes: str, half_r: int, half_c: int, c: float = KS_C) -> DataFrame:
    """(row, col, row2, col2, ks, alike): every pixel with each neighbour of its window, and whether their amplitudes have one distribution.

    Windows are clipped at the edge; neighbours meet by equality, one per offset. Pixels without amplitudes, or with an unknown one, meet none.
    """
    whole = (F.size(amplitudes) > 0) & ~F.exists(amplitudes, lambda x: x.isNull() | F.isnan(x))
    p = pixels.where(whole).select(*on, row, col, F.col(amplitudes).alias("__a"))
    offset = lambda h: F.explode(F.sequence(F.lit(-h), F.lit(h)))
    own = p.withColumn("__dr", offset(half_r)).withColumn("__dc", offset(half_c)).where("__dr <> 0 OR __dc <> 0")
    own = own.withColumns({f"{row}2": F.col(row) + F.col("__dr"), f"{col}2": F.col(col) + F.col("__dc")}).drop("__dr", "__dc")
    other = p.select(*on, F.col(row).alias(f"{row}2"), F.col(col).alias(f"{col}2"), F.col("__a").alias("__b"))
    n = own.join(other, [*on, f"{row}2", f"{col}2"]).withColumn("ks", ks_of_arrays(F.col("__a"), F.col("__b")))
    limit = c * F.sqrt(1.0 / F.size("__a") + 1.0 / F.size("__b"))
    return n.select(*on, row, col, f"{row}2", f"{col}2", "ks", (F.col("ks") < limit).alias("alike"))


def homogeneous_coherence(neighbours: DataFrame, images: DataFrame, on: list[str], row: str, col: str, re1: str, im1: str, re2: str, im2: str) -> DataFrame:
    """Coherence of two complex images per pixel over itself and the neighbours that are alike (see ``homogeneous``); pixels with an unknown part count as nothing."""
    own = images.select(*on, row, col).withColumns({f"{row}2": F.col(row), f"{col}2": F.col(col)})
    pairs = neighbours.where("alike").select(*on, row, col, f"{row}2", f"{col}2").unionByName(own)
    seen = images.dropna(subset=[re1, im1, re2, im2]).select(*on, F.col(row).alias(f"{row}2"), F.col(col).alias(f"{col}2"), re1, im1, re2, im2)
    return coherence(pairs.join(seen, [*on, f"{row}2", f"{col}2"]), [*on, row, col], re1, im1, re2, im2)


def dissimilarity(points: DataFrame, rec_id: str, vector: str, train: DataFrame, most: int = 2000) -> DataFrame:
    """Distance to the nearest training point over the training points' mean distance: (rec_id, di). The training set is a bounded table (at most ``most`` rows, else an error)."""
    rows = train.select(vector).where(F.col(vector).isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} training points")
    t = np.asarray([r[0] for r in rows], float)
    gaps = np.sqrt(((t[:, None, :] - t[None, :, :]) ** 2).sum(axis=2))
    mean = gaps[np.triu_indices(len(t), 1)].mean() if len(t) > 1 else np.nan

    @F.pandas_udf("double")
    def di(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        d2 = (x * x).sum(axis=1)[:, None] + (t * t).sum(axis=1) - 2 * x @ t.T
        return pd.Series(np.sqrt(np.maximum(d2.min(axis=1), 0)) / mean)

    return points.where(F.col(vector).isNotNull()).select(rec_id, di(vector).alias("di"))


def phase_shift(images: DataFrame, on: list[str], ref: str, moved: str, width: int) -> DataFrame:
    """Per key the whole-pixel shift (dr, dc) between two images, given as flat arrays of rows of ``width``, by phase correlation."""

    @F.pandas_udf("struct<dr:int,dc:int>")
    def shift(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(a, b, strict=True):
            p, q = np.asarray(p, float).reshape(-1, width), np.asarray(q, float).reshape(-1, width)
            x = np.fft.fft2(q) * np.conj(np.fft.fft2(p))
            peak = np.fft.ifft2(x / np.maximum(np.abs(x), 1e-12)).real
            r, c = np.unravel_index(int(peak.argmax()), peak.shape)
            out.append((r - p.shape[0] * (r > p.shape[0] // 2), c - width * (c > width // 2)))
        return pd.DataFrame(out, columns=["dr", "dc"])

    return images.select(*on, shift(ref, moved).alias("s")).select(*on, "s.dr", "s.dc")


def filtered_phase(re: np.ndarray, im: np.ndarray, alpha: float, window: int, step: int) -> np.ndarray:
    """A phase image, complex, whose spectrum is weighted in overlapping windows by its smoothed magnitude to the power of ``alpha``; unknown cells stay so (in columns: null)."""
    z = re + 1j * im
    known = np.isfinite(z)
    unit = np.where(known, np.where(known, z, 0) / np.maximum(np.abs(np.where(known, z, 1)), 1e-12), 0)
    half = window // 2
    padded = np.pad(unit, [(half, window + (-n) % step) for n in z.shape])
    taper = np.outer(np.hanning(window), np.hanning(window)) + 1e-6
    total, weight = np.zeros_like(padded), np.zeros(padded.shape)
    views = np.lib.stride_tricks.sliding_window_view(padded, (window, window))[::step, ::step]
    spectrum = np.fft.fft2(views)
    rim = np.pad(np.abs(spectrum), [(0, 0), (0, 0), (1, 1), (1, 1)], mode="symmetric")
    smooth = sum(rim[..., r : r + window, c : c + window] for r in range(3) for c in range(3)) / 9
    gain = (smooth / np.maximum(smooth.max(axis=(2, 3), keepdims=True), 1e-12)) ** alpha
    parts = np.fft.ifft2(spectrum * gain) * taper
    for r, c in np.ndindex(views.shape[:2]):
        at = (slice(r * step, r * step + window), slice(c * step, c * step + window))
        total[at] += parts[r, c]
        weight[at] += taper
    out = (total / np.maximum(weight, 1e-12))[half : half + z.shape[0], half : half + z.shape[1]]
    return np.where(known, out, np.nan)


def phase_filter(images: DataFrame, on: list[str], re: str, im: str, width: int, alpha: float = 0.5, window: int = 32, step: int = 8) -> DataFrame:
    """Per key the filtered image as arrays ``re`` and ``im``; images are flat arrays of rows of ``width`` (see ``filtered_phase``), tiles of a bounded size."""

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def work(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        done = [filtered_phase(np.asarray(p, float).reshape(-1, width), np.asarray(q, float).reshape(-1, width), alpha, window, step).ravel() for p, q in zip(a, b, strict=True)]
        return pd.DataFrame({"re": [z.real for z in done], "im": [z.imag for z in done]})

    return images.select(*on, work(re, im).alias("z")).select(*on, "z.re", "z.im")
