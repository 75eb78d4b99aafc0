"""Exchange candles as CSV files or positional JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KLINE_SCHEMA = T.StructType(
    [
        T.StructField("open_time", T.LongType(), False),
        T.StructField("open", T.DoubleType(), False),
        T.StructField("high", T.DoubleType(), False),
        T.StructField("low", T.DoubleType(), False),
        T.StructField("close", T.DoubleType(), False),
        T.StructField("volume", T.DoubleType(), False),
        T.StructField("close_time", T.LongType(), False),
        T.StructField("quote_volume", T.DoubleType(), True),
        T.StructField("trades", T.LongType(), True),
        T.StructField("taker_buy_base", T.DoubleType(), True),
        T.StructField("taker_buy_quote", T.DoubleType(), True),
        T.StructField("ignore", T.StringType(), True),
    ]
)

# position in the JSON array -> column and type (fixed values); later positions are not used
JSON_FIELDS = (("open_time", "bigint"), ("open", "double"), ("high", "double"), ("low", "double"), ("close", "double"),
               ("volume", "double"), ("close_time", "bigint"), ("quote_volume", "double"), ("trades", "bigint"))

SYMBOL_DIR = r"symbol=([^/]+)/"


def with_path_symbol(df: DataFrame) -> DataFrame:
    """Symbol from the ``symbol=...`` directory of the file a row came from."""
    return df.withColumn("symbol", F.regexp_extract(F.col("_metadata.file_path"), SYMBOL_DIR, 1))


def scan_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less candle CSV files below ``path/symbol=.../`` with the fixed 12-column schema.

    ``recursiveFileLookup`` keeps the directory from being added as a partition column twice.
    """
    reader = spark.read.schema(KLINE_SCHEMA).option("header", False).option("recursiveFileLookup", True)
    return with_path_symbol(reader.csv(path))


def read_kline_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    reader = spark.readStream.schema(KLINE_SCHEMA).option("header", False).option("recursiveFileLookup", True)
    return with_path_symbol(reader.option("maxFilesPerTrigger", files_per_trigger).csv(path))


def decode_kline_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """One JSON array of candle arrays per line to typed columns; a bad number becomes NULL."""
    candles = F.explode(F.from_json(F.col(value), "array<array<string>>")).alias("_k")
    keep = [c for c in lines.columns if c != value]
    rows = lines.select(*keep, candles)
    return rows.select(
        *keep, *[F.get("_k", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(JSON_FIELDS)]
    )


def bars_to_klines(bars: DataFrame, seconds: int) -> DataFrame:
    """Bars back to the 12 raw candle columns plus symbol (milliseconds), for files in the exchange layout."""
    start = F.unix_millis("timestamp")
    return bars.select(
        "symbol",
        start.alias("open_time"),
        F.col("price_open").alias("open"),
        F.col("price_high").alias("high"),
        F.col("price_low").alias("low"),
        F.col("price_close").alias("close"),
        F.col("volume_base").alias("volume"),
        (start + (seconds * 1000 - 1)).alias("close_time"),
        F.col("volume_quote").alias("quote_volume"),
        F.col("num_trades").alias("trades"),
        F.lit(0.0).alias("taker_buy_base"),
        F.lit(0.0).alias("taker_buy_quote"),
        F.lit("0").alias("ignore"),
    )


def write_kline_csv(klines: DataFrame, path: str) -> None:
    """Header-less CSV in ``symbol=.../month=.../`` directories."""
    month = F.date_format(F.timestamp_millis("open_time"), "yyyy-MM")
    klines.withColumn("month", month).write.partitionBy("symbol", "month").csv(path)


def klines_to_json(klines: DataFrame) -> DataFrame:
    """Candles as lines of positional JSON, one array of one candle each."""
    text = F.concat_ws(
        ",", "open_time", *[F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("open", "high", "low", "close", "volume")],
        "close_time", F.concat(F.lit('"'), F.col("quote_volume").cast("string"), F.lit('"')), "trades",
    )
    return klines.select("symbol", F.concat(F.lit("[["), text, F.lit("]]")).alias("value"))
