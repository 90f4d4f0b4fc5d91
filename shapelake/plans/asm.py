"""Active shape models: intensity profiles along normals, trained per point and used to fit a shape to an image."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.storage import saved
from shapelake.plans.pdm import XYZ, ShapeModel

ImageFunction = Callable[[np.ndarray], np.ndarray]


def profile_features(image: ImageFunction, points: np.ndarray, normals: np.ndarray, offsets: np.ndarray, gradient: bool = True) -> np.ndarray:
    """(n, len(offsets)) features: differences along the normal, divided by their L1 norm unless it is 0; or intensities."""
    spacing = offsets[1] - offsets[0] if len(offsets) > 1 else 1.0
    at = lambda o: image((points[:, None, :] + normals[:, None, :] * o[None, :, None]).reshape(-1, points.shape[1])).reshape(len(points), -1)
    if not gradient:
        return at(offsets)
    f = (at(offsets + spacing / 2) - at(offsets - spacing / 2)) / spacing
    norm = np.abs(f).sum(axis=1, keepdims=True)
    return np.where(norm > 0, f / np.where(norm > 0, norm, 1), f)


def offsets_of(n: int, spacing: float) -> np.ndarray:
    return (np.arange(n) - (n - 1) / 2) * spacing


@dataclass(frozen=True)
class ActiveShapeModel:
    """profiles: (point_id, mean array, precision array): one normal distribution of features for each profile point."""

    shape: ShapeModel
    profiles: DataFrame
    n_features: int
    spacing: float

    def mean(self) -> DataFrame:
        return self.shape.mean()

    def sample(self, seed: int = 0) -> DataFrame:
        return self.shape.sample(seed)

    def sample_features(self, seed: int = 0) -> DataFrame:
        n = self.n_features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for p, m, k in zip(pdf.point_id, pdf["mean"], pdf.precision):
                    cov = np.linalg.inv(np.array(k).reshape(n, n))
                    out.append(np.random.default_rng([seed, int(p)]).multivariate_normal(np.array(m), cov))
                yield pd.DataFrame({"point_id": pdf.point_id, "features": out})

        return self.profiles.mapInPandas(run, "point_id long, features array<double>")


def train(shape: ShapeModel, samples: DataFrame, image_of: Callable[[int], ImageFunction], n_features: int, spacing: float, ridge: float = 1e-4) -> ActiveShapeModel:
    """samples: (item_id, point_id, x, y, z, nx, ny, nz) on training images; features where the rows lie, distributions by point."""
    offsets = offsets_of(n_features, spacing)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, own in pdf.groupby("item_id"):
                f = profile_features(image_of(int(item)), own[list(XYZ)].to_numpy(float), own[["nx", "ny", "nz"]].to_numpy(float), offsets)
                yield pd.DataFrame({"point_id": own.point_id, "features": list(f)})

    def distribution(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.stack(pdf.features.to_numpy())
        cov = np.cov(f.T).reshape(n_features, n_features) if len(f) > 1 else np.zeros((n_features, n_features))
        precision = np.linalg.inv(cov + ridge * np.eye(n_features))
        return pd.DataFrame({"point_id": [pdf.point_id.iloc[0]], "mean": [f.mean(axis=0)], "precision": [precision.ravel()]})

    rows = samples.mapInPandas(features, "point_id long, features array<double>")
    profiles = rows.groupBy("point_id").applyInPandas(distribution, "point_id long, mean array<double>, precision array<double>")
    return ActiveShapeModel(shape, profiles, n_features, spacing)


def best_candidates(model: ActiveShapeModel, current: DataFrame, image: ImageFunction, search: Sequence[float], most: float = 5.0) -> DataFrame:
    """point_id, x, y, z, distance: for each profile the candidate along its normal of least Mahalanobis distance, if at most `most`."""
    offsets, n, steps = offsets_of(model.n_features, model.spacing), model.n_features, np.array(search, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, normals = pdf[list(XYZ)].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float)
            mean, precision = np.stack(pdf["mean"].to_numpy()) if len(pdf) else np.zeros((0, n)), np.stack(pdf.precision.to_numpy()).reshape(-1, n, n) if len(pdf) else np.zeros((0, n, n))
            scores = []
            for s in steps:
                d = profile_features(image, p + s * normals, normals, offsets) - mean
                scores.append(np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", d, precision, d), 0)))
            scores = np.stack(scores, axis=1) if len(pdf) else np.zeros((0, len(steps)))
            k = scores.argmin(axis=1)
            found = p + steps[k][:, None] * normals
            out = pd.DataFrame(found, columns=list(XYZ))
            out.insert(0, "point_id", pdf.point_id.to_numpy())
            out["distance"] = scores[np.arange(len(k)), k]
            yield out[out.distance <= most]

    return current.join(model.profiles, "point_id").mapInPandas(run, "point_id long, x double, y double, z double, distance double")


def fit(model: ActiveShapeModel, image: ImageFunction, normals_of: Callable[[DataFrame], DataFrame], search: Sequence[float], iterations: int = 10, noise: float = 1.0, bound: float = 3.0) -> Iterator[tuple[np.ndarray, DataFrame]]:
    """(coefficients, points) after each iteration: candidates, regression in the model, coefficients cut to +-bound."""
    a = np.zeros(model.shape.rank)
    for _ in range(iterations):
        current = normals_of(model.shape.instance(a))
        found = best_candidates(model, current, image, search).select("point_id", *XYZ).transform(saved)
        if found.isEmpty():
            return
        a = np.clip(model.shape.coefficients(found, noise), -bound, bound)
        yield a, model.shape.instance(a)


def gradient_magnitude(smoothed: DataFrame, grid, axes: int) -> DataFrame:
    """Preprocessing: magnitude of the gradient of a smoothed image."""
    from shapelake.operators.grid import gradient

    total = None
    for axis in range(axes):
        g = gradient(smoothed, grid, axis).select("voxel_id", (F.col("value") * F.col("value")).alias(f"g{axis}"))
        total = g if total is None else total.join(g, "voxel_id")
    return total.select("voxel_id", F.sqrt(sum((F.col(f"g{k}") for k in range(axes)), F.lit(0.0))).alias("value"))
