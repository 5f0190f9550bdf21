"""Features of cycles and of high-rate vibration signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges of the frequency bands as shares of half the sampling rate.
BANDS = (0.0, 0.05, 0.15, 0.3, 0.6, 1.0)


def cycle_features(x: Column) -> Column:
    """mean, std, min, max, slope over the cycle, means of its first and last tenth, of an array."""
    n = F.size(x)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    t = lambda i: i / F.greatest(n - 1, F.lit(1)) - 0.5
    spread = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    top = total(F.transform(x, lambda v, i: (v - mean) * t(i)))
    low = total(F.transform(x, lambda v, i: t(i) * t(i)))
    tenth = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    part = lambda start: total(F.slice(x, start, tenth)) / tenth
    return F.when(n > 0, F.struct(mean.alias("mean"), F.sqrt(spread / n).alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), F.coalesce(F.try_divide(top, low), F.lit(0.0)).alias("slope"), part(F.lit(1)).alias("first"), part(n - tenth + 1).alias("last")))


def vibration_time_features(samples: DataFrame, recording: str, idx: str, value: str, window: int) -> DataFrame:
    """log_rms, log_crest, log_kurtosis, skew of each full window that doesn't overlap another."""
    x = F.col(value).cast("double")
    g = samples.groupBy(recording, F.floor(F.col(idx) / window).alias("window")).agg(F.count("*").alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), (F.kurtosis(x) + 3).alias("kurtosis"), F.skewness(x).alias("skew"))
    return g.filter(F.col("n") == window).select(recording, "window", F.ln("rms").alias("log_rms"), F.ln(F.try_divide(F.col("peak"), F.col("rms"))).alias("log_crest"), F.ln("kurtosis").alias("log_kurtosis"), "skew")


def windows_of(samples: DataFrame, recording: str, idx: str, value: str, window: int) -> DataFrame:
    """recording, window, signal: an array of each full window."""
    g = samples.groupBy(recording, F.floor(F.col(idx) / window).alias("window")).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return g.filter(F.size("_s") == window).select(recording, "window", F.transform("_s", lambda s: s["v"]).alias("signal"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def band_energy(signal: pd.Series) -> pd.Series:
    """Logarithm of the share of power in each band, of Hann-windowed signals."""

    def one(x) -> list[float]:
        x = np.asarray(x, float)
        power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
        edges = (np.array(BANDS) * len(power)).astype(int)
        total = power.sum() or 1.0
        return [float(np.log(power[a:b].sum() / total + 1e-12)) for a, b in zip(edges, edges[1:], strict=False)]

    return signal.map(one)


def envelope_peaks(windows: DataFrame, signal: str, rate: float, shaft_hz: float, orders: list[float], band: tuple[float, float]) -> DataFrame:
    """``peaks``: for each defect order, the log height of its first two envelope lines over the median floor.

    Band-pass and analytic signal in the frequency domain; a recording's windows are independent rows."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def peaks(x: pd.Series) -> pd.Series:
        def one(values) -> list[float]:
            v = np.asarray(values, float)
            n = len(v)
            freq = np.fft.fftfreq(n, 1 / rate)
            spec = np.fft.fft(v - v.mean()) * ((freq >= band[0]) & (freq <= band[1])) * 2
            env = np.abs(np.fft.ifft(spec))
            lines, f = np.abs(np.fft.rfft(env - env.mean())), np.fft.rfftfreq(n, 1 / rate)
            floor = np.median(lines[(f >= 10) & (f <= 500)]) if ((f >= 10) & (f <= 500)).any() else np.median(lines)
            out = []
            for o in orders:
                near = [lines[np.abs(f - k * o * shaft_hz) <= 2 * rate / n] for k in (1, 2)]
                out.append(float(np.log(max((a.max() for a in near if len(a)), default=0.0) / (floor + 1e-12) + 1e-12)))
            return out

        return x.map(one)

    return windows.withColumn("peaks", peaks(signal))
