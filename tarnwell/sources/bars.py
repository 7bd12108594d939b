"""Daily price bars: scan, validation, sufficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import PRICE_COLUMNS, FetchError, InvalidHistoryError
from ..functions.scalar import finite

MINIMUM_ROWS = 200


def bars_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order priority and day: a series in the shape of a price history. One shuffle, combined map-side."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


def scan_history(spark: SparkSession, path: str, as_of: str | None = None, period: str = "max") -> DataFrame:
    """Parquet price history of a provider, cut to a period before ``as_of`` (the partition or row-group filter reaches the scan)."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        raise FetchError(f"no price history at {path}") from e
    if period != "max":
        last = F.to_date(F.lit(as_of)) if as_of else F.lit(df.agg(F.max("d")).first()[0])
        df = df.where(F.col("d") >= F.add_months(last, -12 * int(period.removesuffix("y"))))
    return df.where(F.col("d") <= F.to_date(F.lit(as_of))) if as_of else df


def keep_last(df: DataFrame, keys: tuple[str, ...] = ("series", "d"), order: str = "seq") -> DataFrame:
    """The latest ingested row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def checked(df: DataFrame) -> DataFrame:
    """Check columns and types; an error names what is missing."""
    kinds = dict(df.dtypes)
    missing = [c for c in ("d", *PRICE_COLUMNS) if c not in kinds]
    if missing:
        raise InvalidHistoryError(f"missing columns: {', '.join(missing)}")
    if kinds["d"] not in ("date", "timestamp", "timestamp_ntz"):
        raise InvalidHistoryError("the index is not a date")
    if df.isEmpty():
        raise FetchError("the history is empty")
    return df


def validated(df: DataFrame) -> DataFrame:
    """Rows that are not a possible bar keep their date and lose all five values; ``valid`` says which."""
    x = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in PRICE_COLUMNS})
    o, h, low, c, v = (F.col(n) for n in PRICE_COLUMNS)
    fine = (F.least(o, h, low, c) > 0) & (v >= 0) & (h >= F.greatest(o, low, c)) & (low <= F.least(o, h, c))
    for n in PRICE_COLUMNS:
        fine = fine & F.col(n).isNotNull()
    x = x.withColumn("valid", F.coalesce(fine, F.lit(False)))
    return x.withColumns({n: F.when(F.col("valid"), F.col(n)) for n in PRICE_COLUMNS})


def require_history(df: DataFrame, rows: int = MINIMUM_ROWS) -> DataFrame:
    """``df`` (validated), or an error if a series' latest ``rows`` rows are fewer or not all valid."""
    w = Window.partitionBy("series").orderBy(F.col("d").desc())
    last = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows)
    bad = last.groupBy("series").agg(F.count("*").alias("n"), F.bool_and("valid").alias("all")).where((F.col("n") < rows) | ~F.col("all"))
    if (one := bad.first()) is not None:
        raise InvalidHistoryError(f"series {one['series']}: the latest {rows} rows must be there and valid")
    return df
