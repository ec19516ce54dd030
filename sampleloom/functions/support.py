"""Small helpers around runs: tolerances, seeds, scoped modes, parameter counts and worker sizing."""

from __future__ import annotations

import os
import random
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (relative, absolute) tolerances of comparisons by dtype.
TOLERANCES = {"float16": (1e-3, 1e-5), "float32": (1.3e-6, 1e-5), "float64": (1e-7, 1e-7)}


def tolerances(dtype) -> tuple[float, float]:
    """(rtol, atol) of a dtype; exact for whatever is no float."""
    return TOLERANCES.get(np.dtype(dtype).name, (0.0, 0.0))


def seed_everything(seed: int = 42) -> np.random.Generator:
    """Seeds the driver's global generators and returns one of its own. Random ops have a key of their own a row."""
    os.environ["PYTHONHASHSEED"] = str(seed)
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


@contextmanager
def evaluation(holder, name: str = "transform") -> Iterator[None]:
    """The pipeline in holder.<name> in eval mode inside the block; whatever happens there, the one before returns."""
    before = getattr(holder, name)
    setattr(holder, name, before.with_mode(False))
    try:
        yield
    finally:
        setattr(holder, name, before)


def parameter_count(parameters: DataFrame, *, trainable_only: bool = False) -> DataFrame:
    """One row (n) with the elements of all tensors of a table (shape array<int>, trainable boolean)."""
    kept = parameters.where("trainable") if trainable_only else parameters
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, v: a * v)
    return kept.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n"))


@dataclass(frozen=True, kw_only=True)
class Workers:
    """Worker processes and the bytes that each may use."""

    count: int
    bytes_each: int


def plan_workers(available_bytes: int, cpus: int, *, share: float = 0.8, most_bytes: int | None = None, most_workers: int | None = None) -> Workers:
    """A share of the memory, spread evenly over the cores, both within their caps."""
    memory = min(v for v in (int(available_bytes * share), most_bytes) if v is not None)
    count = min(v for v in (cpus, most_workers) if v is not None)
    return Workers(count=count, bytes_each=memory // count)
