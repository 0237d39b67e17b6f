"""Stain analytics on pixels: optical density, stain estimation, normalisation, enhancement, sharpening."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tilewright.operators import ranks
from tilewright.session import stage

# The reference stains (rows: red, green, blue; columns: nuclear stain, counterstain) and their concentrations.
REFERENCE = ((0.650, 0.072), (0.704, 0.990), (0.286, 0.105))
REFERENCE_MOST = (1.9705, 1.0308)
# Limits of optical density, background, samples, scales and stability.
OD_LEAST, OD_MOST, BACKGROUND, TISSUE = 1e-6, 2.5, 240, 0.15
MIN_SAMPLES, MAX_SAMPLES, MIN_TILES, CHECK_EVERY, STABLE, STABLE_CHECKS = 5000, 15000, 8, 4, 0.25, 3
LEAST_SCALE, MOST_SCALE, LEAST_SIMILAR, LEAST_ANGLE = 0.33, 3.0, 0.7, 0.3


def od(value: Column) -> Column:
    """Optical density of a channel from 0 to 255."""
    return F.least(-F.log10(F.greatest(F.lit(OD_LEAST), value / F.lit(255.0))), F.lit(OD_MOST))


def from_od(density: Column) -> Column:
    """Channel from optical density, rounded and within 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.pow(F.lit(10.0), -density) * 255 + 0.5))).cast("int")


def is_background(r: Column, g: Column, b: Column) -> Column:
    """All channels are bright."""
    return (r > BACKGROUND) & (g > BACKGROUND) & (b > BACKGROUND)


def is_tissue(r: Column, g: Column, b: Column) -> Column:
    """No background, and enough density."""
    return ~is_background(r, g, b) & (F.sqrt(od(r) * od(r) + od(g) * od(g) + od(b) * od(b)) >= TISSUE)


def tissue_samples(pixels: DataFrame, tile: str, place: str, fraction: float, most: int = MAX_SAMPLES) -> DataFrame:
    """Densities of a tile's tissue pixels: every 1/fraction-th pixel, then tissue alone, then the first ``most``."""
    step = max(1, int(1 / fraction))
    kept = pixels.where((F.col(place) % step == 0) & is_tissue(F.col("r"), F.col("g"), F.col("b")))
    kept = ranks.numbered(kept, [tile], [place], "_nth", upto=most).drop("_nth")
    return kept.withColumns({f"od_{c}": od(F.col(c)) for c in "rgb"})


def column_stats(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation, 1e-6 at least, of each column."""
    return df.groupBy(key).agg(*[a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.greatest(F.lit(1e-6), F.stddev_pop(c)).alias(f"std_{c}"))])


#: Accuracy of the approximate percentiles that bound the exact one.
ACCURACY = 10_000


def floor_percentile(df: DataFrame, key: str, value: str, share: float, name: str, place: Callable[[Column], Column] = F.floor) -> DataFrame:
    """Element floor(n * share) of each key's sorted values, the last one at most (A7). Nulls are left out.

    ``place`` makes n * share a whole number; with ``F.rint`` it is the nearest one, of halves the even one, as where
    DuckDB casts a double: its ``//`` leaves a double's fraction.

    Exact, and no group is gathered: approximate percentiles a little below and above bound the element; values below
    the band are counted, those in it are counted by value, and the element is found among these counts. Keys whose
    counts say that it lies outside the band are looked through by ``ranks.numbered``.
    """
    from pyspark.sql import Window

    at = lambda d: min(1.0, max(0.0, share + d / ACCURACY))
    v = df.select(key, F.col(value).alias("_v")).where("_v is not null")
    ends = v.groupBy(key).agg(F.percentile_approx("_v", [at(-3), at(3)], ACCURACY).alias("_e"), F.count("*").alias("_n"))
    ends = ends.select(F.col(key).alias("_k"), F.col("_e")[0].alias("_low"), F.col("_e")[1].alias("_high"), F.least(place(F.col("_n") * F.lit(share)).cast("long"), F.col("_n") - 1).alias("_at"))
    ends = stage(ends, "percentile-ends")
    near = v.join(ends, v[key].eqNullSafe(ends["_k"])).where("_v <= _high or isnan(_v)")
    counts = near.groupBy(key, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.first("_at").alias("_at"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_first()))
    # Values below the band stand as one null; if they reach the place, the band is too high.
    seen = counts.withColumn("_upto", upto).withColumn("_below", F.max(F.when(F.col("_v").isNull(), F.col("_upto"))).over(Window.partitionBy(key)))
    found = stage(seen.where("_v is not null and _upto > _at and coalesce(_below, 0) <= _at").groupBy(key).agg(F.min("_v").alias(name)), "percentile-found")
    missed = ends.join(found, ends["_k"].eqNullSafe(found[key]), "left_anti").select("_k", "_at")
    if missed.isEmpty():
        return found
    rest = v.join(missed, v[key].eqNullSafe(missed["_k"])).select(key, "_v", "_at")
    return found.union(ranks.numbered(rest, [key], ["_v"], "_nth").where("_nth = _at + 1").select(key, F.col("_v").alias(name)))


def covariance(df: DataFrame, key: str, columns: Sequence[str] = ("od_r", "od_g", "od_b")) -> DataFrame:
    """The six population covariances of three columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.groupBy(key).agg(*[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs])


def pseudo_inverse(m: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """2 by 3 pseudo-inverse of a 3 by 2 matrix of columns; a fixed one where it is singular."""
    dot = lambda i, j: m[0][i] * m[0][j] + m[1][i] * m[1][j] + m[2][i] * m[2][j]
    p, q, s = dot(0, 0), dot(0, 1), dot(1, 1)
    det = p * s - q * q
    fixed = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
    pick = lambda i, j, value: F.when(F.abs(det) < 1e-10, F.lit(fixed[i][j])).otherwise(value / F.when(F.abs(det) < 1e-10, 1.0).otherwise(det))
    return [[pick(0, j, s * m[j][0] - q * m[j][1]) for j in range(3)], [pick(1, j, p * m[j][1] - q * m[j][0]) for j in range(3)]]


def _lit(m: Sequence[Sequence[float]]) -> list[list[Column]]:
    return [[F.lit(float(x)) for x in row] for row in m]


def concentrations(densities: Sequence[Column], matrix: Sequence[Sequence[Column]]) -> list[Column]:
    """Amounts of both stains, 0 at least."""
    return [F.greatest(F.lit(0.0), sum((p * d for p, d in zip(row, densities, strict=True)), F.lit(0.0))) for row in pseudo_inverse(matrix)]


def normalised(rgb: Sequence[Column], matrix: Sequence[Sequence[Column]], most: Sequence[Column]) -> list[Column]:
    """A pixel's channels as if stained like the reference (X12); background stays."""
    amounts = concentrations([od(c) for c in rgb], matrix)
    scale = [F.greatest(F.lit(LEAST_SCALE), F.least(F.lit(MOST_SCALE), F.when(m > 1e-6, F.lit(r) / F.when(m > 1e-6, m).otherwise(1.0)).otherwise(1.0))) for m, r in zip(most, REFERENCE_MOST, strict=True)]
    a, b = (c * s for c, s in zip(amounts, scale, strict=True))
    return [F.when(is_background(*rgb), c.cast("int")).otherwise(from_od(a * row[0] + b * row[1])) for c, row in zip(rgb, REFERENCE, strict=True)]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if one is nearly null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) < 1e-10) | (norm(b) < 1e-10), 0.0).otherwise(dot / (norm(a) * norm(b)))


# --- estimation, per slide, on a bounded number of samples -------------------------------------------------------------


def _unit(v):
    import numpy as np

    n = np.linalg.norm(v)
    return v / n if n > 1e-10 else v


def principal_pair(cov, rounds: int = 50):
    """Two leading eigenvectors by power iteration and deflation."""
    import numpy as np

    out = []
    for _ in range(2):
        v = np.full(3, 0.577)
        for _ in range(rounds):
            w = cov @ v
            if np.linalg.norm(w) < 1e-10:
                break
            v = _unit(w)
        out.append(v)
        cov = cov - (v @ cov @ v) * np.outer(v, v)
    return out


def macenko(x):
    """Stain matrix from densities (n by 3): extreme angles in the plane of most variance."""
    import numpy as np

    ref = np.array(REFERENCE)
    if len(x) < 10:
        return ref
    v1, v2 = principal_pair(np.cov(x.T, bias=True))
    angles = np.sort(np.arctan2(x @ v2, x @ v1))
    a, b = (_unit(np.cos(t) * v1 + np.sin(t) * v2) for t in (angles[int(len(angles) * 0.01)], angles[int(len(angles) * 0.99)]))
    like = lambda v, k: abs(v @ ref[:, k])
    h, e = (a, b) if like(a, 0) + like(b, 1) > like(a, 1) + like(b, 0) else (b, a)
    return np.abs(np.stack([h, e], 1))


def nmf(x, rounds: int = 50, seed: int = 0):
    """(stain matrix of unit columns, concentrations) by two-part non-negative factorisation with multiplicative updates
    and a fixed seed (X7)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, h = np.abs(np.array(REFERENCE)) + 0.1 * rng.random((3, 2)), 0.1 + rng.random((2, len(x)))
    for _ in range(rounds):
        h *= (w.T @ x.T) / (w.T @ w @ h + 1e-10)
        w *= (x.T @ h.T) / (w @ h @ h.T + 1e-10)
    size = np.maximum(np.linalg.norm(w, axis=0), 1e-10)
    return w / size, (h * size[:, None]).T


def amounts(x, matrix):
    """Concentrations, 0 at least, of densities (X6); by a fixed matrix where the stain matrix is singular."""
    import numpy as np

    gram = matrix.T @ matrix
    inverse = np.eye(2, 3) if abs(np.linalg.det(gram)) < 1e-10 else np.linalg.inv(gram) @ matrix.T
    return np.maximum(0, x @ inverse.T)


def checked(matrix):
    """The matrix, its columns swapped if they fit better so, or the reference if it can't be right."""
    import numpy as np

    ref = np.array(REFERENCE)
    cos = lambda a, b: 0.0 if min(np.linalg.norm(a), np.linalg.norm(b)) < 1e-10 else a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    h, e = matrix.T
    if np.arccos(min(1.0, abs(cos(h, e)))) < LEAST_ANGLE:
        return ref
    straight, swapped = min(cos(h, ref[:, 0]), cos(e, ref[:, 1])), min(cos(h, ref[:, 1]), cos(e, ref[:, 0]))
    if swapped > straight:
        return matrix[:, ::-1]
    return matrix if straight >= LEAST_SIMILAR else ref


def parameters(x, mode: str):
    """(3 by 2 matrix, 2 concentrations) of densities.

    The factorisation's own concentrations count, unless its matrix was swapped or replaced.
    """
    import numpy as np

    found, c = (macenko(x), None) if mode == "macenko" else nmf(x)
    m = checked(found)
    if c is None or not np.array_equal(m, found):
        c = amounts(x, m)
    most = np.sort(c, axis=0)[min(int(len(c) * 0.99), len(c) - 1)]
    return m, (most if (most >= 0.1).all() and np.isfinite(most).all() else np.array(REFERENCE_MOST))


PARAMETERS = "stain array<array<double>>, most array<double>, samples long"


def _per_slide(samples: DataFrame, key: str, least: int, most: int, columns: str, fit) -> DataFrame:
    """``fit`` of each slide's first ``most`` densities (n by 3) as one row; none under ``least``. So a group is bounded."""
    cut = ranks.numbered(samples, [key], ["nth"], "_nth", upto=most)
    kind = dict(samples.dtypes)[key]
    names = [c.split()[0] for c in columns.split(", ")]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("_nth")[["od_r", "od_g", "od_b"]].to_numpy(float)
        found = [[v] for v in fit(x)] if len(x) >= least else [[]] * len(names)
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(found[0])} | dict(zip(names, found, strict=True)))

    return cut.select(key, "_nth", "od_r", "od_g", "od_b").groupBy(key).applyInPandas(one, f"{key} {kind}, {columns}")


def estimated(samples: DataFrame, key: str, mode: str = "macenko", least: int = MIN_SAMPLES, most: int = MAX_SAMPLES) -> DataFrame:
    """Stain parameters of each slide (X5, X7, X9): none under ``least`` samples.

    ``samples``: key, od_r, od_g, od_b and an order column ``nth``, a number. Each slide's samples are cut to ``most`` first.
    """

    def fit(x):
        m, c = parameters(x, mode)
        return m.tolist(), c.tolist(), len(x)

    return _per_slide(samples, key, least, most, PARAMETERS, fit)


def extreme_stains(samples: DataFrame, key: str, least: int = MIN_SAMPLES, most: int = MAX_SAMPLES) -> DataFrame:
    """The two stains at the extreme angles of each slide's densities, before they are checked (X3, X5): stain, samples."""
    return _per_slide(samples, key, least, most, "stain array<array<double>>, samples long", lambda x: (macenko(x).tolist(), len(x)))


def is_stable(a: str, b: str) -> Column:
    """Two sets of parameters (structs stain, most) differ by a quarter at most."""
    near = lambda x, y, least: ((F.abs(x) + F.abs(y)) / 2 <= least) | (F.abs(x - y) / ((F.abs(x) + F.abs(y)) / 2) <= STABLE)
    most = F.forall(F.arrays_zip(F.col(f"{a}.most").alias("p"), F.col(f"{b}.most").alias("q")), lambda z: near(z["p"], z["q"], 0.0))
    flat = F.arrays_zip(F.flatten(F.col(f"{a}.stain")).alias("p"), F.flatten(F.col(f"{b}.stain")).alias("q"))
    return most & F.forall(flat, lambda z: near(z["p"], z["q"], 0.01))


# --- colour spaces and enhancement -------------------------------------------------------------------------------------


def to_hsl(df: DataFrame, rgb: Sequence[str], names: Sequence[str] = ("h", "s", "l")) -> DataFrame:
    """Adds hue 0 to 360, saturation and lightness 0 to 1 (X13). In two projections, so that nothing is worked out twice."""
    scaled = [F.col(c) / F.lit(255.0) for c in rgb]
    df = df.withColumns({"_high": F.greatest(*scaled), "_low": F.least(*scaled)})
    r, g, b = scaled
    high, low = F.col("_high"), F.col("_low")
    light, d = (high + low) / 2, high - low
    safe = F.when(d == 0, 1.0).otherwise(d)
    share = d / F.when(d == 0, 1.0).when(light > 0.5, 2 - high - low).otherwise(high + low)
    turn = F.when(high == r, (g - b) / safe + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    return df.withColumns(dict(zip(names, (turn * F.when(d == 0, 0.0).otherwise(60.0), share, light), strict=True))).drop("_high", "_low")


def from_hsl(df: DataFrame, hsl: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds channels 0 to 255, rounded half up."""
    h, s, l = map(F.col, hsl)  # noqa: E741
    df = df.withColumn("_q", F.when(l < 0.5, l * (1 + s)).otherwise(l + s - l * s))
    turns = {f"_t{k}": h / 360 + shift for k, shift in enumerate((1 / 3, 0.0, -1 / 3))}
    df = df.withColumns({k: t - F.floor(t) for k, t in turns.items()} | {"_p": 2 * l - F.col("_q")})
    p, q = F.col("_p"), F.col("_q")

    def channel(t: Column) -> Column:
        value = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)
        return F.floor(value * 255 + 0.5).cast("int")

    return df.withColumns({c: channel(F.col(t)) for c, t in zip(names, turns, strict=True)}).drop("_p", "_q", *turns)


# sRGB to XYZ and back, white point D65, and the constants of Lab.
RGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE, EPSILON, KAPPA = (0.95047, 1.0, 1.08883), 0.008856, 903.3


def to_lab(df: DataFrame, rgb: Sequence[str], names: Sequence[str] = ("light", "a", "b")) -> DataFrame:
    """Adds CIE Lab (X13), in three projections."""
    linear = [F.when(F.col(c) / 255 > 0.04045, F.pow((F.col(c) / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 255 / 12.92) for c in rgb]
    df = df.withColumns({f"_n{k}": v for k, v in enumerate(linear)})
    mixed = lambda row, white: sum((F.col(f"_n{k}") * m for k, m in enumerate(row)), F.lit(0.0)) / white
    df = df.withColumns({f"_v{k}": mixed(row, white) for k, (row, white) in enumerate(zip(RGB_XYZ, WHITE, strict=True))})
    bent = lambda v: F.when(v > EPSILON, F.pow(v, F.lit(1 / 3))).otherwise((v * KAPPA + 16) / 116)
    df = df.withColumns({f"_f{k}": bent(F.col(f"_v{k}")) for k in range(3)})
    f = [F.col(f"_f{k}") for k in range(3)]
    out = (f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200)
    return df.withColumns(dict(zip(names, out, strict=True))).drop(*[f"_{c}{k}" for c in "nvf" for k in range(3)])


def from_lab(df: DataFrame, lab: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds channels 0 to 255, rounded half up."""
    light, a, b = map(F.col, lab)
    df = df.withColumn("_fy", (light + 16) / 116)
    df = df.withColumns({"_fx": a / 500 + F.col("_fy"), "_fz": F.col("_fy") - b / 200})
    cube = lambda c: F.col(c) * F.col(c) * F.col(c)
    x, z = (F.when(cube(c) > EPSILON, cube(c)).otherwise((F.col(c) * 116 - 16) / KAPPA) for c in ("_fx", "_fz"))
    y = F.when(light > KAPPA * EPSILON, cube("_fy")).otherwise(light / KAPPA)
    df = df.withColumns({f"_v{k}": v * w for k, (v, w) in enumerate(zip((x, y, z), WHITE, strict=True))})
    mixed = lambda row: F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.col(f"_v{k}") * m for k, m in enumerate(row)), F.lit(0.0))))
    df = df.withColumns({f"_c{k}": mixed(row) for k, row in enumerate(XYZ_RGB)})
    shown = lambda c: F.floor(F.when(c > 0.0031308, F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(c * 12.92) * 255 + 0.5).cast("int")
    return df.withColumns({n: shown(F.col(f"_c{k}")) for k, n in enumerate(names)}).drop("_fx", "_fy", "_fz", *[f"_{c}{k}" for c in "vc" for k in range(3)])


def enhanced(df: DataFrame, rgb: Sequence[str], stain: str, names: Sequence[str], live_hues: bool = True) -> DataFrame:
    """Adds channels with a special stain brought out: gram, afb or gms (X14). ``live_hues`` picks the wider purple range (Q6)."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if stain == "gms":
        df = to_lab(df, rgb, ("_light", "_a", "_b"))
        dark = F.col("_light") < 50
        light = F.when(dark, F.pow(F.greatest("_light", F.lit(0.0)) / 50, F.lit(1.3)) * 50).otherwise(F.least(F.lit(100.0), F.col("_light") * 1.08 + 3))
        k = F.when(dark, 1.1).otherwise(0.6)
        df = df.withColumns({"_light": light, "_a": F.col("_a") * k, "_b": F.col("_b") * k})
        return from_lab(df, ("_light", "_a", "_b"), names).drop("_light", "_a", "_b")
    df = to_hsl(df, rgb, ("_h", "_s", "_l"))
    h, s, l = F.col("_h"), F.col("_s"), F.col("_l")  # noqa: E741
    if stain == "gram":
        purple, red = (240, 320) if live_hues else (260, 330)
        # Rules in order: condition, factor of saturation, factor of lightness, addend of lightness.
        rules = [
            (h.between(purple, 320) & (s > 0.15), 1.35, 0.9, 0.0),
            (((h >= red) | (h <= 30)) & (s > 0.2), 1.3, 0.95, 0.0),
            ((h.between(40, 180) & (s < 0.4)) | (s < 0.1), 0.6, 1.05, 0.02),
        ]
    elif stain == "afb":
        rules = [(((h >= 330) | (h <= 30)) & (s > 0.25), 1.5, 0.85, 0.0), (h.between(180, 260), 0.65, 1.05, 0.0)]
    else:
        raise ValueError(stain)
    new_s, new_l = s, l
    for test, ks, kl, add in reversed(rules):
        new_s, new_l = F.when(test, unit(s * ks)).otherwise(new_s), F.when(test, unit(l * kl + add)).otherwise(new_l)
    df = df.withColumns({"_s2": new_s, "_l2": new_l})
    return from_hsl(df, ("_h", "_s2", "_l2"), names).drop("_h", "_s", "_l", "_s2", "_l2")


def tone_table(contrast: float, gamma: float, brightness: float) -> list[int]:
    """256 values: contrast about the middle, then gamma, then brightness."""
    out = []
    for v in range(256):
        x = min(1.0, max(0.0, (v / 255 - 0.5) * contrast + 0.5))
        out.append(int(min(255, max(0, x ** (1 / gamma) * brightness * 255)) + 0.5))
    return out


def toned(channel: Column, contrast: float, gamma: float, brightness: float) -> Column:
    """A channel through the table."""
    return F.element_at(F.array(*map(F.lit, tone_table(contrast, gamma, brightness))), channel.cast("int") + 1)


# --- whole tiles ---------------------------------------------------------------------------------------------------------


def sharpen(pixels, amount: float, edges: str = "skip", most_scale: float | None = None):
    """RGBA (.., height, width, 4), one tile or many, sharpened by its luminance: ``edges`` skips or repeats what lies outside.

    Without ``most_scale`` the sharpened luminance is kept within 0 to 255, and channels are rounded (X15). With it the
    factor alone is kept within 0 and ``most_scale``, black pixels stay, and channels are cut down (X16).
    """
    import numpy as np

    p = pixels.astype(float)
    y = (p[..., :3] * np.array([0.299, 0.587, 0.114])).sum(-1)
    kernel = np.array([1.0, 2.0, 1.0])
    mode = "edge" if edges == "clamp" else "constant"
    height, width = y.shape[-2:]
    around = lambda a: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2, mode=mode)
    padded, ones = around(y), around(np.ones((height, width)))
    blur = lambda a: sum(kernel[i] * kernel[j] * a[..., i : i + height, j : j + width] for i in range(3) for j in range(3))
    sharp = y + amount * (y - blur(padded) / blur(ones))
    if most_scale:
        scale, whole = np.where(y > 0.255, np.clip(sharp / np.maximum(y, 0.255), 0, most_scale), 1.0), lambda v: np.floor(v + 1e-9)
    else:
        scale, whole = np.clip(sharp, 0, 255) / np.maximum(y, 0.001), np.rint
    out = pixels.copy()
    out[..., :3] = whole(np.clip(p[..., :3] * scale[..., None], 0, 255)).astype(np.uint8)
    return out


def resize(pixels, width: int, height: int):
    """RGBA (.., height, width, 4), one tile or many, resized with a Lanczos window of three lobes, one axis after the other."""
    import numpy as np

    def weights(n: int, m: int):
        scale = max(1.0, n / m)
        at = (np.arange(m)[:, None] + 0.5) * n / m - 0.5
        x = (np.arange(n)[None, :] - at) / scale
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return w / w.sum(1, keepdims=True)

    out = np.einsum("hi,...iwc->...hwc", weights(pixels.shape[-3], height), pixels.astype(float))
    out = np.einsum("wj,...hjc->...hwc", weights(pixels.shape[-2], width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


#: Pixels that a task works on at a time, of as many tiles as they make.
STEP_PIXELS = 1 << 19


def processed(tiles: DataFrame, width: int, height: int, sharpening: float = 0.0, swap: bool = False, to: tuple[int, int] | None = None, alternative: bool = False, name: str = "pixels") -> DataFrame:
    """Tiles (.., pixels: RGBA bytes) through one pass: channel order, resize, sharpen.

    ``alternative`` takes the second sharpening: edges repeated, a factor of 2 at most, amount 0.3. The result is put into
    column ``name``. Tiles are worked on together, ``STEP_PIXELS`` at a time.
    """

    @pandas_udf("binary")
    def one_pass(raw: pd.Series) -> pd.Series:
        import numpy as np

        def some(held):
            p = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), height, width, 4)
            p = p[..., [2, 1, 0, 3]] if swap else p
            p = resize(p, *to) if to else p
            if sharpening > 0:
                p = sharpen(p, 0.3 * sharpening / 100, "clamp", 2.0) if alternative else sharpen(p, 0.8 * sharpening / 100)
            whole = np.ascontiguousarray(p).tobytes()
            size = len(whole) // len(held)
            return [whole[k : k + size] for k in range(0, len(whole), size)]

        there = raw.notna()
        held = raw[there].tolist()
        bad = next((len(b) for b in held if len(b) != 4 * width * height), None)
        if bad is not None:
            raise ValueError(f"{bad} bytes are no tile of {width} by {height} pixels")
        step = max(1, STEP_PIXELS // (width * height))
        out = pd.Series([None] * len(raw), index=raw.index, dtype=object)
        out[there] = [b for k in range(0, len(held), step) for b in some(held[k : k + step])]
        return out

    return tiles.withColumn(name, one_pass("pixels"))


def finished_tiles(pixels: DataFrame, tile: str, place: str, matrix: Sequence[Sequence[Column]], most: Sequence[Column], kind: str, width: int, height: int, sharpening: float) -> DataFrame:
    """Tiles as they are shown: normalised, then a special stain brought out, then sharpened, in this order.

    ``pixels``: tile, place (row by row from 0), r, g, b. Returns tile and pixels, RGBA bytes. A tile's pixels are put
    together in one group; there are width times height of them.
    """
    like = normalised([F.col(c) for c in "rgb"], matrix, most)
    shown = enhanced(pixels.select(tile, place, *[v.alias(c) for c, v in zip("rgb", like, strict=True)]), "rgb", kind, ("_r", "_g", "_b"))
    rgba = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("_r", "_g", "_b")], F.lit("FF"))
    whole = shown.groupBy(tile).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), rgba.alias("rgba")))).alias("_p"))
    bytes_ = whole.select(tile, F.unhex(F.array_join(F.transform("_p", lambda p: p["rgba"]), "")).alias("pixels"))
    return processed(bytes_, width, height, sharpening=sharpening)


def normalised_tiles(tiles: DataFrame, parameters_: DataFrame, key: str) -> DataFrame:
    """Tiles of RGBA bytes normalised with their slide's parameters (X12, X18); without parameters they stay."""
    kind = tiles.schema

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        ref = np.array(REFERENCE)
        for rows in batches:
            out = []
            for raw, stain, most in zip(rows["pixels"], rows["stain"], rows["most"], strict=True):
                if raw is None or stain is None:
                    out.append(raw)
                    continue
                p = np.frombuffer(raw, np.uint8).reshape(-1, 4).copy()
                density = np.minimum(-np.log10(np.maximum(OD_LEAST, p[:, :3] / 255.0)), OD_MOST)
                c = amounts(density, np.array([list(r) for r in stain]))
                c = c * np.clip(np.where(np.array(most) > 1e-6, np.array(REFERENCE_MOST) / np.maximum(most, 1e-6), 1), LEAST_SCALE, MOST_SCALE)
                new = np.clip(np.floor(10 ** -(c @ ref.T) * 255 + 0.5), 0, 255).astype(np.uint8)
                tissue = ~(p[:, :3] > BACKGROUND).all(1)
                p[tissue, :3] = new[tissue]
                out.append(p.tobytes())
            yield rows.assign(pixels=out)[tiles.columns]

    return tiles.join(parameters_.select(key, "stain", "most"), key, "left").mapInPandas(apply, kind)
