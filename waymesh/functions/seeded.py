"""Random numbers that depend on a seed and the row's keys only, so that any plan and rerun draws the same."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(seed: int, name: str, *keys: Column | str) -> Column:
    """In [0, 1)."""
    # The keys are a text of their own, which all draws of a row share; a long is read faster than a double.
    of = F.concat_ws(":", *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:" if keys else f"{seed}:{name}"), of))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def between(low: float, high: float, u: Column) -> Column:
    return F.lit(low) + F.lit(high - low) * u


def normal(seed: int, name: str, *keys: Column | str) -> Column:
    """Standard normal, from two uniforms."""
    u, v = uniform(seed, f"{name}.r", *keys), uniform(seed, f"{name}.a", *keys)
    return F.sqrt(-2 * F.ln((u * 4294967296.0 + 1) / 4294967297.0)) * F.cos(2 * F.pi() * v)
