"""Search filters as one predicate, so that Catalyst pushes it into the scan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The media types of each kind.
KINDS = {"PDF": ("application/pdf",), "TEXT": ("text/plain", "text/markdown", "text/csv", "text/html"), "EBOOK": ("application/epub+zip",)}


@dataclass(frozen=True)
class SearchFilter:
    """None asks nothing; an empty list of folders or kinds holds for nothing."""

    folder_ids: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    date_from: str | None = None
    date_to: str | None = None
    has_receipt: bool | None = None

    def __post_init__(self):
        days = [d and calendar_day(d) for d in (self.date_from, self.date_to)]
        if all(days) and days[0] > days[1]:
            raise ValueError("the first day is after the last")
        for kind in self.kinds or ():
            if kind not in {*KINDS, "IMAGE"}:
                raise ValueError(f"no kind {kind}")


def calendar_day(text: str) -> dt.date:
    """A real day, written year-month-day, from the year 1000 on."""
    day = dt.date.fromisoformat(text)
    if len(text) != 10 or day.year < 1000:
        raise ValueError(f"{text} is not a day")
    return day


def kind_predicate(kinds: tuple[str, ...], mime: str = "mime_type") -> Column:
    """OR over kinds; images are any image type."""
    out = F.lit(False)
    for kind in kinds:
        out = out | (F.col(mime).startswith("image/") if kind == "IMAGE" else F.col(mime).isin(*KINDS[kind]))
    return out


def compile_filter(f: SearchFilter, *, folder: str = "folder_id", mime: str = "mime_type", date: str = "document_date", vendor: str = "vendor", total: str = "total") -> Column:
    """AND of all that is asked. Undated rows fail once a bound is set, by SQL's nulls."""
    out = F.lit(True)
    if f.folder_ids is not None:
        out = out & (F.col(folder).isin(*f.folder_ids) if f.folder_ids else F.lit(False))
    if f.kinds is not None:
        out = out & kind_predicate(f.kinds, mime)
    if f.date_from:
        out = out & (F.col(date) >= F.lit(f.date_from).cast("date"))
    if f.date_to:
        out = out & (F.col(date) <= F.lit(f.date_to).cast("date"))
    if f.has_receipt is not None:
        has = F.col(vendor).isNotNull() | F.col(total).isNotNull()
        out = out & (has if f.has_receipt else ~has)
    return out


def scoped(df: DataFrame, user_id, *, user: str = "user_id", deleted: str | None = "deleted_at", status: str | None = None) -> DataFrame:
    """The caller's rows outside the trash; with ``status``, without rows that are still being uploaded."""
    out = df.filter(F.col(user) == user_id)
    if deleted:
        out = out.filter(F.col(deleted).isNull())
    return out.filter(F.col(status) != "pending_upload") if status else out


def canonical_filter(f: SearchFilter, include_subfolders: bool = True) -> dict:
    """What a saved search keeps: fields that narrow nothing are left out."""
    out = {"folderId": f.folder_ids[0] if f.folder_ids else None, "kinds": list(f.kinds) if f.kinds else None, "dateFrom": f.date_from, "dateTo": f.date_to, "hasReceipt": f.has_receipt}
    if f.folder_ids and not include_subfolders:
        out["includeSubfolders"] = False
    return {k: v for k, v in out.items() if v is not None}


_OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "inArray": lambda c, v: c.isin(*v) if v else F.lit(False),
    "isNull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}


def table_query(df: DataFrame, where: dict | None = None, order_by: dict | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Generic list read: ``where`` {column: {operator: value}}, ``order_by`` {column: (direction, priority)}; higher priority sorts first."""
    for column, tests in (where or {}).items():
        for name, value in tests.items():
            df = df.filter(_OPERATORS[name](F.col(column), value))
    keys = sorted((order_by or {}).items(), key=lambda x: -x[1][1])
    if keys:
        df = df.orderBy(*[F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, (d, _) in keys])
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
