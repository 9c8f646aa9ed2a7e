"""Means, cross-covariance and singular vectors of array columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefweave.functions.vectors import cosine, literal, norm
from prefweave.operators.order import first_rows
from prefweave.operators.tree import SHAPE, gathered, shipped


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null elements are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _width(df: DataFrame, column: str) -> int:
    """Elements of the vectors, which must be equally many."""
    a, b = df.where(F.col(column).isNotNull()).agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if a != b:
        raise ValueError(f"vectors of {a} and of {b} elements")
    return a or 0


def vector_sums(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """For each array column an array (2, d): of every element the sum and the number of values.

    Nulls don't count. Every task adds up its own vectors, and the sums meet in a tree.
    """
    own = df.select(*(F.col(c).cast("array<double>").alias(f"c{i}") for i, c in enumerate(columns)))
    widths = [_width(own, c) for c in own.columns]
    bound = np.cumsum([0, *(2 * w for w in widths)])
    if not bound[-1]:
        return [np.zeros((2, 0)) for _ in widths]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bound[-1])
        for batch in batches:
            for i, w in enumerate(widths):
                m = _matrix(batch.column(i).drop_null())
                if len(m):
                    at = bound[i]
                    total[at : at + w] += np.nansum(m, axis=0)
                    total[at + w : at + 2 * w] += (~np.isnan(m)).sum(axis=0)
        yield shipped(total)

    total = gathered(own.mapInArrow(add, SHAPE), bound[-1], np.float64)
    return [total[a:b].reshape(2, -1) for a, b in zip(bound, bound[1:], strict=False)]


def vector_mean(df: DataFrame, column: str) -> list[float]:
    """The element-wise mean of vectors of one length; null vectors and elements don't count. [] for no vectors."""
    total, n = vector_sums(df, [column])[0]
    return [float(t / c) if c else math.nan for t, c in zip(total, n, strict=True)]


def contrast_vector(df: DataFrame, a: str, b: str) -> list[float]:
    """Mean of a - b."""
    return vector_mean(df.select(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x - y).alias("_d")), "_d")


def group_contrast(df: DataFrame, column: str, first: Column) -> list[float]:
    """Mean of the vectors where ``first`` holds less the mean of the others."""
    own = df.select(F.when(first, F.col(column)).alias("a"), F.when(~first, F.col(column)).alias("b"))
    (a, na), (b, nb) = vector_sums(own, ["a", "b"])
    return [float(x) for x in a / na - b / nb]


def cross_covariance(df: DataFrame, left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """(sum of (left - mean) x right, mean of left), not divided by the count; rows with a null vector don't count.

    Each task adds up one d x d block; the blocks meet in a tree, a stretch of them in a task.
    """
    own = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("array<double>").alias("l"), F.col(right).cast("array<double>").alias("r"))
    mean = np.array(vector_mean(own, "l"))
    if not len(mean):
        raise ValueError("there are no vectors")
    width = _width(own, "r")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), width))
        for batch in batches:
            if len(batch):
                total += (_matrix(batch.column(0)) - mean).T @ _matrix(batch.column(1))
        yield shipped(total.ravel())

    return gathered(own.mapInArrow(block, SHAPE), len(mean) * width, np.float64).reshape(len(mean), width), mean


@dataclass(frozen=True)
class Svd:
    """Thin singular value decomposition; the largest entry of each left vector is positive."""

    u: np.ndarray
    s: np.ndarray
    vh: np.ndarray


def svd(matrix: np.ndarray, k: int | None = None) -> Svd:
    u, s, vh = np.linalg.svd(matrix, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    k = len(s) if k is None else min(k, len(s))
    return Svd((u * sign)[:, :k], s[:k], (vh.T * sign).T[:k])


def aligned(df: DataFrame, key: str, column: str, direction: np.ndarray, k: int = 10, center: np.ndarray | None = None) -> DataFrame:
    """(key, similarity) of the ``k`` rows with the greatest absolute cosine; near-zero vectors don't count."""
    v = F.col(column).cast("array<double>")
    if center is not None:
        v = F.zip_with(v, literal(list(center)), lambda x, y: x - y)
    own = df.select(key, v.alias("_v")).where(norm(F.col("_v")) > 1e-8)
    return own.select(key, cosine(F.col("_v"), literal(list(direction))).alias("similarity")).orderBy(F.abs("similarity").desc(), key).limit(k)


def alignment(df: DataFrame, key: str, prompts: str, diffs: str, components: int = 5, top: int = 3) -> DataFrame:
    """(component, singular_value, space, key, similarity): the samples most aligned with each component.

    Prompts are divided by their number before centring, which scales the values only. One
    pass scores all components in both spaces; every task keeps its own ``top`` rows of each. Rows with a null
    vector don't count, nor do near-zero vectors; ties go by key.
    """
    n = df.count()
    scaled = df.where(F.col(prompts).isNotNull() & F.col(diffs).isNotNull()).select(F.col(key).alias("key"), F.transform(F.col(prompts).cast("array<double>"), lambda x: x / n).alias("p"), F.col(diffs).cast("array<double>").alias("d"))
    matrix, mean = cross_covariance(scaled, "p", "d")
    parts = svd(matrix, components)
    kind = df.schema[key].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, at, directions, center in (("prompt", 1, parts.u, mean), ("response_diff", 2, parts.vh.T, 0.0)):
                m = _matrix(batch.column(at)) - center
                size = np.linalg.norm(m, axis=1)
                valid = np.flatnonzero(size > 1e-8)
                similar = (m[valid] @ directions) / (size[valid, None] * np.linalg.norm(directions, axis=0))
                keys = batch.column(0).take(pa.array(valid))
                by_key = np.argsort(np.argsort(np.array(keys.to_pylist(), object), kind="stable")) if len(valid) else valid
                for c in range(directions.shape[1]):
                    best = np.lexsort((by_key, -np.abs(similar[:, c])))[:top]
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), c), pa.int32()), pa.array(np.full(len(best), parts.s[c])), pa.array([space] * len(best)), keys.take(pa.array(best)), pa.array(similar[best, c])], ["component", "singular_value", "space", "key", "similarity"])

    found = scaled.mapInArrow(score, f"component int, singular_value double, space string, key {kind}, similarity double")
    kept = first_rows(found, ["component", "space"], [F.abs("similarity").desc(), F.col("key")], top)
    return kept.select("component", "singular_value", "space", F.col("key").alias(key), "similarity")
