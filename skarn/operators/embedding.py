"""Embedding images with an injected model; no weights are shipped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import decode, resize, tensor
from ..functions.vectors import row_l2, row_zscore

BATCH = 32
TOY_SIDE = 4


def block_colours(batch: np.ndarray) -> np.ndarray:
    """A toy embedder for tests: mean colours of 4 x 4 blocks.  It is no trained model."""
    out = []
    for data in batch:
        image = decode(bytes(data)) if data is not None else None
        out.append(np.full(3 * TOY_SIDE**2, np.nan) if image is None else resize(image, TOY_SIDE, TOY_SIDE).astype(np.float32).ravel() / 255)
    return np.stack(out).astype(np.float32)


def embedder(make: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A column function that runs the model which ``make`` loads once a worker, ``batch`` rows at a time."""
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)


def over_tensors(make: Callable[[], Callable[[np.ndarray], np.ndarray]], side: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """For ``embedder``: the model of ``make`` takes normalised channel-first tensors (n, 3, ``side``, ``side``) instead of encoded images.

    Images that can't be decoded get vectors of NaN, which ``encoded`` leaves out.
    """

    def load() -> Callable[[np.ndarray], np.ndarray]:
        model = make()

        def run(batch: np.ndarray) -> np.ndarray:
            images = [decode(bytes(data)) if data is not None else None for data in batch]
            blank = np.zeros((3, side, side), np.float32)
            out = np.array(model(np.stack([blank if x is None else tensor(resize(x, side, side)) for x in images])), np.float32)
            out[[x is None for x in images]] = np.nan
            return out

        return run

    return load


def encoded(rows: DataFrame, embed: Callable[[Column], Column], name: str = "resnet", only_standard: bool = False) -> DataFrame:
    """``rows`` (with ``content``) with ``<name>_vector`` and ``<name>_dim``: z-scored for ``resnet``, unit length for ``clip``; undecodable rows go."""
    rows = rows.where(~F.col("is_augmented")) if only_standard else rows
    raw = rows.withColumn("raw", embed(F.col("content"))).where("raw IS NOT NULL AND NOT exists(raw, x -> isnan(x))")
    vector = (row_zscore if name == "resnet" else row_l2)(F.col("raw")).cast("array<float>")
    return raw.withColumn(f"{name}_vector", vector).withColumn(f"{name}_dim", F.size("raw")).drop("raw", "content")
