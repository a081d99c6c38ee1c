"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: str | Column) -> Column:
    """True for a present, non-NaN, non-infinite number (never null)."""
    c = col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that gives null, not an error, on a zero denominator."""
    d = col(den)
    return col(num) / F.when(d != 0, d)


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Ordered array with the text of every failing check."""
    items = [
        F.when(false_if_null(test), F.lit(text) if isinstance(text, str) else text)
        for test, text in pairs
    ]
    return F.filter(F.array(*items), lambda r: r.isNotNull())


def first_reason(*pairs: tuple[Column, str | Column]) -> Column:
    """Text of the first failing check, null when all pass."""
    return F.coalesce(
        *[
            F.when(false_if_null(test), F.lit(text) if isinstance(text, str) else text)
            for test, text in pairs
        ]
    )


def content_id(columns: Sequence[str], length: int = 16) -> Column:
    """Prefix of the SHA-256 of the canonical JSON of ``columns`` (sorted by name)."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, length)


def row_json(columns: Sequence[str]) -> Column:
    """Canonical JSON of ``columns`` in their order; nulls are written out, so a value that moves shows."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of a row that tells (null, x) from (x, null); Spark's own hash skips nulls."""
    return F.xxhash64(row_json(columns)) if columns else F.lit(0).cast("bigint")


def digest_parts(columns: Sequence[str]) -> list[Column]:
    """Order-free digest of rows as partial aggregates ``_d1.._d4``: four 60-bit parts of the SHA-256 of each row, summed
    as decimals, so that nothing wraps.  No task ever holds the rows of a group."""
    row = F.sha2(row_json(columns), 256)
    return [
        F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"_d{k + 1}") for k in range(4)
    ]


def digest_of(*extra: Column | str) -> Column:
    """SHA-256 of the aggregates of ``digest_parts`` and ``extra``."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(col(c).cast("string"), F.lit("-")) for c in (*extra, "_d1", "_d2", "_d3", "_d4")]), 256)


def draw(seed: int | Column, *parts: str | Column) -> Column:
    """Reproducible 32-bit draw: leading 8 hex digits of md5('seed:part:...')."""
    head = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws(":", head, *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def series(keys: Iterable[str], order: str = "ts") -> WindowSpec:
    """Rows of one series in time order."""
    return Window.partitionBy(*keys).orderBy(order)


def running(keys: Iterable[str], order: str = "ts") -> WindowSpec:
    return series(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(keys: Iterable[str], rows: int, order: str = "ts") -> WindowSpec:
    return series(keys, order).rowsBetween(-(rows - 1), Window.currentRow)


def whole(keys: Iterable[str]) -> WindowSpec:
    return Window.partitionBy(*keys)
