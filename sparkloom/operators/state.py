"""State that runs along a sequence: optimiser steps over an array of gradients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adam(gradients: Column, start: float, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-6, decay: float = 0.0, clip: float | None = None) -> Column:
    """(m, v, p) after all gradients, in order: moments without bias correction, decay apart from the gradient."""
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(float(start)).alias("p"))

    def step(s: Column, g: Column) -> Column:
        g = g if clip is None else g * F.least(F.lit(1.0), F.try_divide(F.lit(float(clip)), F.abs(g) + 1e-6))
        m, v = b1 * s["m"] + (1 - b1) * g, b2 * s["v"] + (1 - b2) * g * g
        p = s["p"] - rate * (m / (F.sqrt(v) + eps) + decay * s["p"])
        return F.struct(m.alias("m"), v.alias("v"), p.alias("p"))

    return F.aggregate(gradients, zero, step)
