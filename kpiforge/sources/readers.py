"""Readers for the ledger and the three e-commerce tables (IO1-IO4).

CSV columns are bound by the names in the header: any order, any subset, further
columns as text.  Columns whose type is known are converted to it; a value that
doesn't fit becomes NULL, and a column that the file lacks is absent from the table.
Dates on the e-commerce path are parsed leniently (bad values become NULL), as the
reference does.  Parquet is read as it is: name it with ``fmt`` where the path
doesn't end in ``.parquet``.

What doesn't fit isn't lost in silence: :func:`rejects` gives a row for every field that
was given but could not be converted, and for every line with more or fewer fields than
the header.  It reads the same files on its own, so a caller can write it beside the
table, count it, or stop a load that has too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpiforge.operators.orders import prepare_orders

ORDERS_TYPES = ("order_id string, customer_id string, customer_name string, product_id string, "
                 "product_name string, category string, quantity long, unit_price double, "
                 "cost_price double, order_date string, region string, city string, "
                 "payment_method string, status string")
PRODUCTS_TYPES = ("product_id string, product_name string, category string, supplier string, "
                   "cost_price double, sell_price double, stock_quantity long, "
                   "reorder_level long, last_restock_date string")
CAMPAIGNS_TYPES = ("campaign_id string, campaign_name string, start_date string, "
                    "end_date string, channel string, budget double, orders long, "
                    "revenue double, impressions long, clicks long")

#: The known columns of each table, and those that are dates in text.
TABLES = {"orders": (ORDERS_TYPES, ("order_date",)), "products": (PRODUCTS_TYPES, ("last_restock_date",)),
          "campaigns": (CAMPAIGNS_TYPES, ("start_date", "end_date"))}

_BROKEN = "_broken_line"


def _read(spark: SparkSession, path: str, types: str | None = None, fmt: str | None = None, **options) -> DataFrame:
    """``types``: known columns as "name type, ..."; without it they are inferred."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=False, **options)
    if types is None:
        return reader.option("inferSchema", True).csv(path)
    known = {f.name: f.dataType for f in StructType.fromDDL(types).fields}
    table = reader.csv(path)  # every column as text, under its name in the header
    return table.select(*[F.col(f"`{c}`").try_cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in table.columns])


def rejects(spark: SparkSession, path: str, types: str, dates: tuple[str, ...] = (), **options) -> DataFrame:
    """What of the CSV files at ``path`` does not fit: file, column, value, reason, line (all
    its fields as JSON).

    One row per field with a value that :func:`load_orders` and the others turn into NULL
    (``not a <type>``, ``not a date``), and one per line whose number of fields isn't the
    header's (column NULL, the text of the line as value).  Empty fields are missing, not
    wrong.  The table of a file is read by ``load_*``; this reads it once more.
    """
    kind = {f.name: f.dataType for f in StructType.fromDDL(types).fields}
    reader = spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=False, columnNameOfCorruptRecord=_BROKEN,
                                columnPruning=False, **options)
    names = reader.csv(path).columns
    text = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, _BROKEN])
    table = reader.schema(text).csv(path).select("*", F.col("_metadata.file_name").alias("_file"))
    fields = {c: F.col(f"`{c}`") for c in names}

    def wrong(value: Column, parsed: Column, name: str, reason: str) -> Column:
        return F.when(value.isNotNull() & parsed.isNull(), F.struct(F.lit(name).alias("column"), value.alias("value"), F.lit(reason).alias("reason")))

    found = [wrong(v, v.try_cast(kind[c]), c, f"not a {kind[c].simpleString()}") for c, v in fields.items()
             if c in kind and kind[c].simpleString() != "string"]
    found += [wrong(v, F.try_to_timestamp(v), c, "not a date") for c, v in fields.items() if c in dates]
    broken = F.when(F.col(_BROKEN).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(_BROKEN).alias("value"),
                                                         F.lit("not as many fields as the header").alias("reason")))
    line = F.to_json(F.struct(*[v.alias(c) for c, v in fields.items()]))
    rows = table.select(F.col("_file").alias("file"), F.explode(F.filter(F.array(broken, *found), lambda x: x.isNotNull())).alias("_x"), line.alias("line"))
    return rows.select("file", "_x.column", "_x.value", "_x.reason", "line")


def load_ledger(spark: SparkSession, path: str, types: str | None = None, fmt: str | None = None, **options) -> DataFrame:
    """IO1 — a sales ledger (CSV with header, or parquet).  Without ``types`` the
    CSV columns are inferred (one extra pass); pass them in production."""
    return _read(spark, path, types, fmt, **options)


def _coerce_dates(df: DataFrame, *cols: str) -> DataFrame:
    present = {c: F.try_to_timestamp(F.col(c).cast("string")) for c in cols if c in df.columns}
    return df.withColumns(present) if present else df


def load_orders(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """IO2 — orders + revenue / cost / profit enrichment (P1)."""
    return prepare_orders(_read(spark, path, ORDERS_TYPES, fmt))


def load_products(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """IO3 — product catalogue; ``last_restock_date`` parsed leniently."""
    return _coerce_dates(_read(spark, path, PRODUCTS_TYPES, fmt), "last_restock_date")


def load_campaigns(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """IO4 — campaigns; ``start_date`` / ``end_date`` parsed leniently."""
    return _coerce_dates(_read(spark, path, CAMPAIGNS_TYPES, fmt), "start_date", "end_date")
