"""Small frames shared by the tests."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

T0 = datetime(2024, 1, 1)


def bars(spark, closes: dict[str, list[float]]):
    rows = [
        (s, T0 + timedelta(days=i), float(c), c + 1.0, c - 1.0, float(c), 10.0) for s, cs in closes.items() for i, c in enumerate(cs)
    ]
    from barloom.sources.schemas import BARS

    return spark.createDataFrame(rows, BARS)


def walk(seed: int, n: int, start: float = 100.0) -> list[float]:
    rng = random.Random(seed)
    out = [start]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rng.uniform(-0.03, 0.03)))
    return out


def table(df, key, value, order="ts"):
    """{key: [values in order]}"""
    out: dict = {}
    for r in sorted(df.select(key, order, value).collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r[2])
    return out


def ts(i: int) -> datetime:
    return T0 + timedelta(days=i)
