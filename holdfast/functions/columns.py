"""Column expressions shared by several operators; all native, none row-at-a-time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(col: str | Column) -> Column:
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed 24-hour periods between two instants in microseconds (not calendar dates)."""
    return F.floor((later - earlier) / F.lit(DAY_US))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def log1p_floor(col: Column) -> Column:
    return F.log1p(F.greatest(col.cast("double"), F.lit(0.0)))


def title_name(col: Column) -> Column:
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def month_label(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def segment_of(
    r: Column, f: Column, m: Column, age: Column | None = None
) -> Column:
    """Segment from the three quintile scores; young accounts are New whatever they score."""
    new = (age < 30) if age is not None else F.lit(False)
    return (
        F.when(new, "New")
        .when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyalists")
        .when(r >= 3, "Promising")
        .when(f >= 3, "At Risk")
        .when(m >= 3, "About to Sleep")
        .otherwise("Hibernating")
    )


def segment_of_total(total: Column, r: Column) -> Column:
    """Older rule on the score sum and the recency score only."""
    return (
        F.when((total >= 13) & (r >= 4), "Champions")
        .when((total >= 10) & (r >= 3), "Loyalists")
        .when((r <= 1) & (total <= 5), "Hibernating")
        .when((r <= 2) & (total >= 8), "At Risk")
        .when(total >= 7, "Promising")
        .when(total >= 4, "Needs Attention")
        .otherwise("Hibernating")
    )


def lookup_text(mapping: dict[str, str], key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], default)


def grouped(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(number, 0)


def fixed_digits(number: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", number.cast("double"))


def numeric_columns(df, skip: set[str] = frozenset()) -> list[str]:
    """Numeric fields of the schema, decided at plan time."""
    kinds = {"byte", "short", "integer", "long", "float", "double", "tinyint", "smallint", "int", "bigint"}
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.name not in skip]
