"""Logical → physical column mapping for the sales ledger.

Operators work on logical names (``date``, ``amount``, ...).  A ``ColumnMap``
names the physical columns of the caller's table; ``to_logical`` applies it
once, at the boundary, as a single projection, so Catalyst prunes every
column the operator does not use straight into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default physical column names of the sales ledger, which
# must equal the reference's defaults so that its files load unchanged.
DEFAULT_COLUMNS = {
    "date": "日期",
    "amount": "销售额",
    "qty": "销售数量",
    "category": "产品类别",
    "region": "地区",
    "customer": "客户 ID",
    "customer_tier": "客户等级",
    "order_id": "订单 ID",
    "product": "产品名称",
    "city": "城市",
    "unit_price": "单价",
    "discount": "折扣率",
}


@dataclass(frozen=True)
class ColumnMap:
    date: str = DEFAULT_COLUMNS["date"]
    amount: str = DEFAULT_COLUMNS["amount"]
    qty: str = DEFAULT_COLUMNS["qty"]
    category: str = DEFAULT_COLUMNS["category"]
    region: str = DEFAULT_COLUMNS["region"]
    customer: str = DEFAULT_COLUMNS["customer"]
    customer_tier: str = DEFAULT_COLUMNS["customer_tier"]
    order_id: str = DEFAULT_COLUMNS["order_id"]
    product: str = DEFAULT_COLUMNS["product"]
    city: str = DEFAULT_COLUMNS["city"]
    unit_price: str = DEFAULT_COLUMNS["unit_price"]
    discount: str = DEFAULT_COLUMNS["discount"]
    #: Decimal places of the ledger's amounts and quantities when they are DOUBLE;
    #: declared, their sums are exact and don't depend on partitioning.
    scale: int | None = None

    @classmethod
    def of(cls, mapping: "ColumnMap | dict | None") -> "ColumnMap":
        if mapping is None:
            return cls()
        if isinstance(mapping, ColumnMap):
            return mapping
        unknown = set(mapping) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown logical columns: {sorted(unknown)}")
        return replace(cls(), **mapping)

    @classmethod
    def identity(cls, scale: int | None = None) -> "ColumnMap":
        """Map every logical name to a physical column of the same name."""
        return cls(**{f.name: f.name for f in fields(cls) if f.name != "scale"}, scale=scale)

    def physical(self, logical: str) -> str:
        return getattr(self, logical)

    def has(self, df: DataFrame, *logical: str) -> bool:
        cols = set(df.columns)
        return all(self.physical(name) in cols for name in logical)


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    """pandas treats NaN as missing; Spark does not.  Map NaN to NULL once."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def nan_as_null(df: DataFrame) -> DataFrame:
    """The table with NULL for NaN in every floating-point column."""
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema.fields):
        return df
    return df.select(*[nan_to_null(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def to_logical(df: DataFrame, cols: ColumnMap | dict | None, wanted: list[str],
               required: list[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Project ``df`` onto the logical columns in ``wanted`` that exist, and the
    physical columns ``keep`` (group keys) as they are, which must exist.

    Missing ``required`` columns raise ``ValueError``; missing optional ones are
    simply absent from the result (operators test ``df.columns``, a plan-time
    check that costs no job).
    """
    cmap = ColumnMap.of(cols)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    missing = [name for name in (required or []) if cmap.physical(name) not in types]
    if missing:
        raise ValueError("missing required columns: "
                         + ", ".join(f"{m} ({cmap.physical(m)})" for m in missing))
    absent = [c for c in keep if c not in types]
    if absent:
        raise ValueError(f"missing group columns {absent}")
    out = [nan_to_null(F.col(f"`{c}`"), types[c]).alias(c) for c in keep]
    for name in wanted:
        phys = cmap.physical(name)
        if phys in types:
            out.append(nan_to_null(F.col(f"`{phys}`"), types[phys]).alias(name))
    return df.select(*out)


def as_timestamp(c: Column, strict: bool = True) -> Column:
    """Parse a date-like column.  ``strict`` raises on bad input (ANSI),
    otherwise bad values become NULL (pandas ``errors='coerce'``)."""
    return F.to_timestamp(c) if strict else F.try_to_timestamp(c.cast("string"))
