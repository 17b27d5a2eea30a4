"""Reconstruction error of window vectors by principal components, one model per stratum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ringwatch import catalog
from ringwatch.catalog import ModelConfig
from ringwatch.operators.windows import flat_weights

SALTS = 32
#: Rows of a moment matrix that travel together.
CHUNK = 64
PART_SCHEMA = "stratum string, chunk int, salt int, values array<double>"
MODEL_SCHEMA = "stratum string, rows double, mean array<double>, components array<double>"


def dense_vectors(pdf: pd.DataFrame, config: ModelConfig = ModelConfig()) -> tuple[np.ndarray, np.ndarray]:
    """Window vectors and masks (all features, feature-major) of a batch.

    Geology arrives as one value per feature and fills the measured positions; padded
    positions stay 0 and unmeasured.
    """
    size = config.window_points
    z = np.stack(pdf["z"].to_numpy()).astype(np.float64)
    mask = np.stack(pdf["mask"].to_numpy()).astype(bool)
    geo = np.stack(pdf["gz"].to_numpy()).astype(np.float64)
    real = np.arange(size)[None, :] >= pdf["pad"].to_numpy()[:, None]
    geo_mask = np.broadcast_to(real[:, None, :], (len(pdf), geo.shape[1], size))
    geo_cells = (geo[:, :, None] * geo_mask).reshape(len(pdf), -1)
    return np.hstack([z, geo_cells]), np.hstack([mask, geo_mask.reshape(len(pdf), -1)])


def fit_reconstruction(windows: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Mean and leading components per stratum from ``(stratum, z, mask, gz, pad, weight)``.

    Tasks add up second moments of their windows, as many tasks as there are cores, so that what they send
    does not grow with the windows; chunks of the moment matrices are summed in two steps and only one
    summed matrix per stratum reaches the eigenvector step. ``windows`` should be a written table.
    """
    dim = len(catalog.FEATURES) * config.window_points

    def moments(batches):
        totals = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x, _ = dense_vectors(pdf, config)
            x = np.hstack([x, np.ones((len(x), 1))])
            w = pdf["weight"].to_numpy(dtype=float)
            strata = pdf["stratum"].to_numpy()
            for stratum in set(strata):
                hit = strata == stratum
                part = (x[hit] * w[hit, None]).T @ x[hit]
                totals[stratum] = totals[stratum] + part if stratum in totals else part
        salt = TaskContext.get().partitionId() % SALTS
        for stratum, m in totals.items():
            chunks = range(-(-(dim + 1) // CHUNK))
            yield pd.DataFrame({"stratum": stratum, "chunk": chunks, "salt": salt, "values": [m[c * CHUNK : (c + 1) * CHUNK].ravel() for c in chunks]})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(pdf["values"].to_numpy()).sum(axis=0)
        return pd.DataFrame([{"stratum": pdf["stratum"].iloc[0], "chunk": pdf["chunk"].iloc[0], "salt": 0, "values": total}])

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.concatenate(pdf.sort_values("chunk")["values"].to_numpy()).reshape(dim + 1, dim + 1)
        n = m[dim, dim]
        mean = m[dim, :dim] / n
        covariance = m[:dim, :dim] / n - np.outer(mean, mean)
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        keep = [i for i in np.argsort(values)[::-1][: config.components] if values[i] > 1e-12]
        return pd.DataFrame(
            [{"stratum": pdf["stratum"].iloc[0], "rows": n, "mean": mean, "components": vectors[:, keep].T.ravel()}]
        )

    used = windows.select("stratum", "z", "mask", "gz", "pad", "weight")
    cores = max(1, windows.sparkSession.sparkContext.defaultParallelism)
    parts = used.coalesce(cores).mapInPandas(moments, PART_SCHEMA)
    halfway = parts.groupBy("stratum", "chunk", "salt").applyInPandas(add_up, PART_SCHEMA)
    summed = halfway.groupBy("stratum", "chunk").applyInPandas(add_up, PART_SCHEMA)
    return summed.groupBy("stratum").applyInPandas(decompose, MODEL_SCHEMA)


def pack_reconstruction(model: DataFrame, config: ModelConfig = ModelConfig()) -> dict:
    """Models as arrays for use inside tasks: at most 49 vectors of 768 numbers per stratum."""
    dim = len(catalog.FEATURES) * config.window_points
    return {
        r["stratum"]: {"mean": np.array(r["mean"]), "components": np.array(r["components"]).reshape(-1, dim)}
        for r in model.collect()
    }


def trend_matrix(z: np.ndarray, mask: np.ndarray, features: list[str], size: int) -> np.ndarray:
    """Slope, change, curvature (0) and spread of every feature of every window, side by side, times its weight.

    ``z`` and ``mask`` hold ``size`` positions per feature. All are 0 with fewer than three measured positions.
    """
    n = len(z)
    y, ok = z.reshape(n, -1, size), mask.reshape(n, -1, size).astype(float)
    count = ok.sum(axis=2)
    many = np.maximum(count, 1)
    at = np.arange(size, dtype=float)
    i = (at - (ok @ at / many)[..., None]) * ok
    off = (y - ((y * ok).sum(axis=2) / many)[..., None]) * ok
    xx = (i * i).sum(axis=2)
    slope = np.divide((i * off).sum(axis=2), xx, out=np.zeros_like(xx), where=xx > 1e-12)
    first, last = ok.argmax(axis=2), size - 1 - ok[:, :, ::-1].argmax(axis=2)
    pick = lambda place: np.take_along_axis(y, place[..., None], axis=2)[..., 0]
    out = np.stack([slope, pick(last) - pick(first), np.zeros_like(slope), np.sqrt((off * off).sum(axis=2) / many)], axis=2)
    weight = np.array([catalog.FEATURE_WEIGHTS.get(f, 1.0) for f in features])
    out *= weight[None, :, None] * (count >= 3)[..., None]
    return out.reshape(n, -1)


def window_errors(windows: DataFrame, models: dict, keys: list[str], config: ModelConfig = ModelConfig()) -> DataFrame:
    """Per window: weighted and plain sums of squared error over measured cells, their count, and ``trend``.

    ``trend`` is the flat vector of the machine features' trends (geology does not vary in a window).

    Error of a sequence is the sum over its steps, so windows shared by several sequences
    are reconstructed once.
    """
    shared = windows.sparkSession.sparkContext.broadcast((models, np.array(flat_weights(catalog.FEATURES, config))))
    ids = list(dict.fromkeys(["stratum", *keys]))
    base = windows.select(*ids, "z", "mask", "gz", "pad")
    schema = base.select(*ids).schema.add("weighted_error", "double").add("plain_error", "double").add("measured", "double").add("trend", ArrayType(DoubleType()))
    cells = len(catalog.TBM_FEATURES) * config.window_points

    def errors(batches):
        models_, weights = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x, mask = dense_vectors(pdf, config)
            out = np.full((len(pdf), 3), np.nan)
            trends = trend_matrix(x[:, :cells], mask[:, :cells], catalog.TBM_FEATURES, config.window_points)
            strata = pdf["stratum"].to_numpy()
            for stratum in set(strata):
                model = models_.get(stratum)
                if model is None:
                    continue
                hit = np.flatnonzero(strata == stratum)
                centred = x[hit] - model["mean"]
                rebuilt = (centred @ model["components"].T) @ model["components"]
                square = (centred - rebuilt) ** 2 * mask[hit]
                out[hit] = np.column_stack([square @ weights, square.sum(axis=1), mask[hit].sum(axis=1)])
            yield pdf[ids].assign(weighted_error=out[:, 0], plain_error=out[:, 1], measured=out[:, 2], trend=list(trends))

    null = F.lit(None).cast("double")
    scored = base.mapInPandas(errors, schema)
    return scored.withColumns({c: F.nanvl(c, null) for c in ("weighted_error", "plain_error", "measured")})
