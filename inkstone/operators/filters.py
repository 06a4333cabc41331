"""Predicates over stored records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.text import u_trim

TEXT_FIELDS, FIELDS = ("exam_name", "region", "grade", "source_type"), ("exam_name", "region", "grade", "source_type", "year", "id")
DIFFICULTY = 3


def pruned(filters: dict | None) -> dict:
    """The filters without NULL and blank values."""
    return {k: v for k, v in (filters or {}).items() if v is not None and str(v).strip()}


def _text(x: Column) -> Column:
    return F.lower(u_trim(F.coalesce(x, F.lit(""))))


def meta_filter(filters: dict | None, meta: Column | None = None, id_: Column | None = None, permissive: bool = False) -> Column:
    """All filters at once: text fields by part of the text without case and outer white space, year and id by equality.

    No filter is true, blank ones are left out, a year that is no number is false. Unknown keys are an error, or are left
    out if permissive. Never NULL.
    """
    meta = F.col("source_meta") if meta is None else meta
    id_ = F.col("id") if id_ is None else id_
    if unknown := set(filters or {}) - set(FIELDS):
        if not permissive:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = F.lit(True)
    for key, value in pruned(filters).items():
        if key in TEXT_FIELDS:
            out = out & _text(meta[key]).contains(str(value).strip().lower())
        elif key == "year":
            # null-safe equality is never NULL and reaches the Parquet reader
            out = out & (meta["year"].eqNullSafe(int(value)) if str(value).strip().lstrip("+-").isdecimal() else F.lit(False))
        elif key == "id":
            out = out & id_.eqNullSafe(str(value))
    return out


def retrieval_filter(points: list[str] | None, difficulty: tuple[int, int] | None, strict_empty: bool = True) -> Column:
    """Records that share a knowledge point and lie in the range of difficulty (NULL counts as 3). points None is no
    condition; an empty list admits nothing, or everything if not strict_empty. For where(): NULL stands for false."""
    out = F.lit(True)
    if points is not None and (points or strict_empty):
        lit = F.array(*map(F.lit, points)).cast("array<string>") if points else F.array().cast("array<string>")
        out = out & (F.coalesce(F.size(F.array_intersect("knowledge_points", lit)), F.lit(0)) > 0)
    if difficulty is not None:
        level = F.col("difficulty").between(*difficulty)
        out = out & ((level | F.col("difficulty").isNull()) if difficulty[0] <= DIFFICULTY <= difficulty[1] else level)
    return out


def first_point_filter(points: list[str]) -> Column:
    """Only the first knowledge point counts, difficulty doesn't. An empty list is an error."""
    if not points:
        raise ValueError("no knowledge point")
    return F.coalesce(F.array_contains("knowledge_points", points[0]), F.lit(False))
