"""The second stage: the time-frequency transform of every accepted period, one task per batch of periods."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tfr import analysis_window, msst_of_frames, msst_stft, source_places

SPECTRAL = "freq_idx int, time_idx int, frequency double, spectral_time double, stft_re double, stft_im double, msst_re double, msst_im double, target_idx int"


def centered(signal: Column) -> Column:
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / F.size(signal)
    return F.transform(signal, lambda x: x - mean)


def analyze_msst_periods(periods: DataFrame, *, sampling_frequency: float, iteration_count: int = 3, center: bool = True, series_cols: Sequence[str] = (), kernel=msst_stft, **options) -> DataFrame:
    """(``series_cols``, period_id, freq_idx, time_idx, frequency, spectral_time, stft and msst as parts, target_idx) of all periods.

    A period is transformed for itself from its array, so nothing is grouped or shuffled; its matrix leaves the worker as rows.
    ``options`` go to the kernel.
    """
    if "return_map" in options:
        raise ValueError("return_map is always given: see target_idx")
    hop = options.get("hop_length", 1)
    keys = [*series_cols, "period_id"]
    types = {f.name: f.dataType.simpleString() for f in periods.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                squeezed, spectrum, frequency, target = kernel(np.array(row["signal"]), sampling_frequency, iteration_count, return_map=True, **options)
                f, t = (x.ravel() for x in np.indices(spectrum.shape))
                out = {k: row[k] for k in keys} | {"freq_idx": f, "time_idx": t, "frequency": frequency[f].astype(float), "spectral_time": t * hop / sampling_frequency}
                out |= {"stft_re": spectrum.real.ravel().astype(float), "stft_im": spectrum.imag.ravel().astype(float), "msst_re": squeezed.real.ravel().astype(float), "msst_im": squeezed.imag.ravel().astype(float), "target_idx": target.ravel()}
                yield pd.DataFrame(out)

    signal = centered(F.col("signal")) if center else F.col("signal")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + SPECTRAL
    return periods.select(*keys, signal.alias("signal")).mapInPandas(run, schema)


#: Frames of a chunk of a whole signal.
CHUNK_FRAMES = 4096


def analyze_signal(samples: DataFrame, *, sampling_frequency: float, iteration_count: int = 3, center: bool = True, series_cols: Sequence[str] = (), window=None, n_fft: int = 512, window_length: int | None = None, hop_length: int = 1, padtype: str = "reflect", dtype: str = "float32", gamma: float | None = None) -> DataFrame:
    """The transform of whole signals of any length: (``series_cols``, freq_idx, time_idx, ...) as of a period, frames numbered
    along the signal.

    ``samples`` has ``series_cols``, pos (from 0, each once) and signal. A signal is cut into chunks of frames; a chunk gets its
    own samples and those a window's length beyond its ends, and each column depends on its own frame alone, so the columns are
    those of the whole signal at once, wherever it is cut. A frame with a missing sample gives no rows. ``center`` takes
    away the mean of the samples there are. A signal cannot be padded by its other end here.
    """
    if padtype not in ("reflect", "symmetric", "zero", "replicate"):
        raise ValueError(f"padtype {padtype!r} is not one of a signal in chunks")
    if hop_length < 1 or iteration_count < 1 or n_fft < 2 or not sampling_frequency > 0:
        raise ValueError("hop_length and iteration_count are 1 or more, n_fft is 2 or more, sampling_frequency is above 0")
    keys, stride = list(series_cols), CHUNK_FRAMES * hop_length
    shape = analysis_window(window, n_fft, window_length or n_fft)
    rows = samples.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("signal").cast("double").alias("signal"))
    own = F.floor(F.col("pos") / stride)
    ends = rows.groupBy(*keys, own.alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "signal"))).alias("_s"), F.max("pos").alias("_last"))
    heard = F.filter(F.col("_s.signal"), lambda x: x.isNotNull())
    ends = ends.select(*keys, "_chunk", "_last", F.aggregate(heard, F.lit(0.0), lambda a, x: a + x).alias("_sum"), F.size(heard).alias("_heard"))
    parts = F.sort_array(F.collect_list(F.struct("_chunk", "_sum")))["_sum"]
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    sizes = ends.groupBy(*keys).agg((F.max("_last") + 1).alias("_n"), (total / F.nullif(F.sum("_heard"), F.lit(0))).alias("_mean"))
    lowest, highest = F.floor((F.col("pos") - n_fft) / stride), F.floor((F.col("pos") + n_fft) / stride)
    dealt = rows.withColumn("_chunk", F.explode(F.sequence(F.greatest(lowest, F.lit(0)), highest)))
    chunks = dealt.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "signal"))).alias("_s"))
    chunks = chunks.join(sizes, keys) if keys else chunks.crossJoin(F.broadcast(sizes))  # one row
    chunks = chunks.filter(F.col("_chunk") * stride < F.col("_n")).select(*keys, "_chunk", "_n", "_mean", F.col("_s.pos").alias("pos"), F.col("_s.signal").alias("signal"))
    types = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    left = (n_fft - 1) // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n, first = int(row["_n"]), int(row["_chunk"]) * stride
                centres = np.arange(first, min(first + stride, n), hop_length)
                pos = np.asarray(row["pos"], np.int64)
                values = np.full(int(pos[-1] - pos[0]) + 1, np.nan)
                values[pos - pos[0]] = np.array(row["signal"], float) - (row["_mean"] if center else 0.0)
                places = source_places(centres[:, None] + np.arange(-left, n_fft - left), n, padtype)
                at = places - pos[0]
                frames = np.where(places < 0, 0.0, np.where((at >= 0) & (at < len(values)), values[np.clip(at, 0, len(values) - 1)], np.nan))
                whole = np.flatnonzero(~np.isnan(frames).any(axis=1))
                if not len(whole):
                    continue
                real = np.float32 if dtype == "float32" else np.float64
                squeezed, spectrum, frequency, target = msst_of_frames(frames[whole].astype(real), shape, sampling_frequency, iteration_count, dtype, gamma)
                f, t = (x.ravel() for x in np.indices(spectrum.shape))
                time = (centres // hop_length)[whole][t]
                out = {k: row[k] for k in keys} | {"freq_idx": f, "time_idx": time, "frequency": frequency[f].astype(float), "spectral_time": time * hop_length / sampling_frequency}
                out |= {"stft_re": spectrum.real.ravel().astype(float), "stft_im": spectrum.imag.ravel().astype(float), "msst_re": squeezed.real.ravel().astype(float), "msst_im": squeezed.imag.ravel().astype(float), "target_idx": target.ravel()}
                yield pd.DataFrame(out)

    return chunks.mapInPandas(run, ("".join(f"`{k}` {types[k]}, " for k in keys) + SPECTRAL).replace("time_idx int", "time_idx long"))


def magnitude(prefix: str) -> Column:
    return F.hypot(f"{prefix}_re", f"{prefix}_im")
