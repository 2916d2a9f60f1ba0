"""Outcome of a registration run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome_class(registered: Column, images: Column, models: Column) -> Column:
    """``failed`` below 3 images, ``partial`` below half of them or in several models, else ``ok``."""
    share = F.try_divide(registered.cast("double"), images)
    return F.when(registered < 3, "failed").when((share < 0.5) | (models > 1), "partial").otherwise("ok")


def gate_pass(sizes: Column, images: Column, least: float = 0.5) -> Column:
    """Whether the largest model holds at least a share of the images."""
    largest = F.coalesce(F.array_max(sizes), F.lit(0)).cast("double")
    return F.try_divide(largest, images) >= least
