"""Scoring heads: from feature vectors to two logits, in numpy on Arrow batches.

A head is a function ``(parameters, *inputs) -> logits [rows, 2]``. Parameters of all folds
are broadcast once; each batch is scored by every fold, so the data are read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.functions.vectors import normalise, to_lists, to_matrix
from strandline.sources.models import fold_groups, load_folds

CACHE_NUMBERS = 1 << 14  # numbers of a slice, so that its intermediate arrays stay inside the processor cache

# Normal distribution on a grid over [-9, 9]; beyond it the tail is below double precision.
_EDGE, _STEPS = 9, 128
_GRID = np.arange(-_EDGE * _STEPS, _EDGE * _STEPS + 1) / _STEPS
_CUMULATIVE = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])
_DENSITY = np.exp(-_GRID ** 2 / 2) / math.sqrt(2 * math.pi)


def gelu(x: np.ndarray) -> np.ndarray:
    """Exact GELU, ``x`` times the normal cumulative (error < 1e-10).

    Third-order Taylor step from the nearest grid point, as numpy has no error function.
    """
    inside = np.clip(x, -_EDGE, _EDGE)
    i = np.rint((inside + _EDGE) * _STEPS).astype(np.int32)
    near = _GRID[i]
    step = inside - near
    slope = 1 - step * (near / 2 - step * ((near * near - 1) / 6))
    return x * (_CUMULATIVE[i] + _DENSITY[i] * step * slope)


def dense(p: dict, name: str, x: np.ndarray) -> np.ndarray:
    """Dense layer."""
    return x @ p[f"{name}.weight"].T + p[f"{name}.bias"]


def norm(p: dict, name: str, x: np.ndarray) -> np.ndarray:
    """Layer normalisation with learned gain and shift."""
    return normalise(x, p[f"{name}.gain"], p[f"{name}.shift"])


def linear_head(p: dict, x: np.ndarray) -> np.ndarray:
    """One dense layer to two logits."""
    return dense(p, "head", x)


def pool_tokens(p: dict, tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Softmax-weighted sum of the tokens of each row.

    Masked tokens (mask 0) get no weight unless the whole row is masked; batch padding
    (mask -1) never does.
    """
    scores = np.where(mask > 0, np.tanh(dense(p, "pool", tokens)[..., 0]),
                      np.where(mask < 0, -np.inf, -1e9))
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    weights /= weights.sum(axis=1, keepdims=True)
    return np.einsum("rt,rth->rh", weights, tokens)


def prompted_head(p: dict, tokens: np.ndarray, mask: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Two logits from the pooled vector of tokens and prompt."""
    pooled = prompted_pool(p, tokens, mask, index)
    return dense(p, "out", gelu(norm(p, "hidden.norm", dense(p, "hidden", pooled))))


def prompted_pool(p: dict, tokens: np.ndarray, mask: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Category vector as prefix token, residual adapter, attention pooling."""
    prefix = gelu(norm(p, "prefix.norm", dense(p, "prefix", p["category"][index])))
    full = np.concatenate([prefix[:, None, :], tokens], axis=1)
    full_mask = np.concatenate([np.ones((len(mask), 1)), mask], axis=1)
    adapted = norm(p, "adapter.norm", dense(p, "up", gelu(dense(p, "down", full))) + full)
    return pool_tokens(p, adapted, full_mask)


def _padded(column: pa.Array) -> np.ndarray:
    """A list column as an array, padded to the longest row: vectors with 0, numbers with -1."""
    lengths = np.diff(column.offsets.to_numpy())
    inner = column.flatten()
    nested = pa.types.is_list(inner.type)
    values = to_matrix(inner) if nested else inner.to_numpy(zero_copy_only=False)
    shape = (len(column), lengths.max(initial=0), *values.shape[1:])
    out = np.full(shape, 0.0 if nested else -1.0)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _as_numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return _padded(column)
    return column.to_numpy(zero_copy_only=False)


def _slice_rows(columns: list[pa.Array]) -> int:
    """Rows per slice: all of a batch of plain vectors, or what the cache holds of token vectors."""
    tokens = [c for c in columns if pa.types.is_list(c.type) and pa.types.is_list(c.type.value_type)]
    numbers = sum(len(c.flatten().flatten()) for c in tokens)
    return max(1, len(columns[0]) * CACHE_NUMBERS // numbers) if numbers else max(1, len(columns[0]))


def head_logits(
    inputs: list[Column], models: DataFrame, forward: Callable[..., np.ndarray],
) -> Column:
    """``array<double>`` with two logits per fold, folds in order; null where an input is null."""
    parts = []
    for group in fold_groups(models, strict=True):
        folds = models.sparkSession.sparkContext.broadcast(
            load_folds(models.where(F.col("fold").isin(group))))
        parts.append(_batched(lambda b=folds: b.value, forward)(*inputs))
    return F.concat(*parts)


def row_head(p: dict, forward: Callable[..., np.ndarray], inputs: list[Column]) -> Column:
    """``array<double>`` from one set of small parameters, sent along with the task."""
    return _batched(lambda: [p], forward)(*inputs)


def _batched(parameters, forward):
    @F.arrow_udf("array<double>")
    def batch(*columns: pa.Array) -> pa.Array:
        valid = np.ones(len(columns[0]), dtype=bool)
        for c in columns:
            valid &= c.is_valid().to_numpy(zero_copy_only=False)
        if not valid.any():
            return pa.nulls(len(valid), pa.list_(pa.float64()))
        keep = pa.array(valid)
        kept = [c.filter(keep) for c in columns]
        scored = []
        rows = _slice_rows(kept)
        for start in range(0, len(kept[0]), rows):
            arrays = [_as_numpy(c.slice(start, rows)) for c in kept]
            scored.append(np.concatenate([forward(p, *arrays) for p in parameters()], axis=1))
        return to_lists(np.concatenate(scored), valid)
    return batch
