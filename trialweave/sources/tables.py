"""Readers with fixed schemas, and the table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Default null tokens of a header CSV. Fixed values.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("imageName", T.StringType()),
        T.StructField("set", T.StringType()),
        T.StructField("Group", T.IntegerType()),
        T.StructField("ORR", T.DoubleType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("sex", T.IntegerType()),
        T.StructField("smoker", T.IntegerType()),
        T.StructField("cigarettes", T.DoubleType()),
        T.StructField("pdl1_number", T.StringType()),
        T.StructField("pdl1_expression", T.StringType()),
        T.StructField("diagnosis", T.StringType()),
        T.StructField("cycles", T.IntegerType()),
        T.StructField("stage_t", T.StringType()),
    ]
)


_LINE = "_bad_line"


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns as text, and the whole line where it has too few or too many fields. Columns are not pruned in the reader, which would not count the fields then."""
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(_LINE, T.StringType())])
    reader = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
    # The reader refuses queries that need nothing but the whole line, such as a count; this holds for every row and needs a field.
    return reader.option("columnPruning", False).csv(path).where(F.length(F.coalesce(F.col(schema.fields[0].name), F.lit(""))) >= 0)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, null_tokens: list[str] = NULL_TOKENS, bad_lines: str = "fail"
) -> DataFrame:
    """Header CSV under a fixed schema.

    The CSV reader knows one null token, so fields are read as text and every token is cleared before
    the cast. A value that is no token and does not parse raises, and so does a line with too few or too many fields, unless
    `bad_lines` is "drop": then it is left out, and bad_lines() reports it.
    """
    if bad_lines not in ("fail", "drop"):
        raise ValueError(f"bad_lines is fail or drop, not {bad_lines}")
    raw = _lines(spark, path, schema)
    whole = F.col(_LINE).isNull()
    if bad_lines == "fail":
        whole = whole | F.raise_error(F.concat(F.lit("not as many fields as the header: "), F.col(_LINE))).cast("boolean")
    return raw.where(whole).select(
        [
            F.when(~F.col(f.name).isin(null_tokens), F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line): the lines of a header CSV that have too few or too many fields."""
    return _lines(spark, path, schema).withColumn("file", F.input_file_name()).where(F.col(_LINE).isNotNull()).select("file", F.col(_LINE).alias("line"))


def read_registry(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Clinical registry; ids stay text so that a leading zero survives."""
    if file_format == "csv":
        return read_table(spark, path, REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Wide image-feature table; NaN becomes null, so that there is one kind of missing value."""
    df = spark.read.parquet(path)
    return df.select(
        [
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
