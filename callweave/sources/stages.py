"""Stage tables as files: JSON lines, flat CSV, reviews, vector indexes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The parsed value of a requirement, one struct for all classes.
VALUE = (
    "min_age int, max_age int, countries array<string>, nationality_or_residence boolean, broad_regions array<string>, types array<string>, enrolled boolean, "
    "graduated_within_years int, also_requires string, institutions array<string>, study_places array<string>, study_countries array<string>"
)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSONL stage with a fixed schema; blank lines are skipped, a missing path is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_stage(df: DataFrame, path: str, by_source: bool = False) -> None:
    """A JSONL stage, one folder a source if asked."""
    (df.write.partitionBy("source") if by_source else df.write).mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """One flat table: lists and structs as JSON, bulky columns left out."""
    flat = df.drop(*drop)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in flat.schema]
    flat.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType, keep_empty: tuple[str, ...] = ()) -> DataFrame:
    """The table that ``export_csv`` wrote, JSON cells parsed; empty cells are null, but for the text columns of ``keep_empty``."""
    nested = lambda f: isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    text = T.StructType([T.StructField(f.name, T.StringType() if nested(f) else f.dataType) for f in schema])
    raw = spark.read.schema(text).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    parsed = raw.select(*(F.from_json(f.name, f.dataType).alias(f.name) if nested(f) else F.nullif(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema))
    return parsed.fillna("", list(keep_empty)) if keep_empty else parsed


def typed_reviews(df: DataFrame, position: str) -> DataFrame:
    """Reviews keyed by (text, label): values parsed, the last row wins, a missing scope is APPLICANT."""
    from callweave.operators.ingest import last_per_key

    keyed = df.withColumn("__key", F.struct("text", "label"))
    return last_per_key(keyed, "__key", position).select("text", "label", "decision", "polarity", F.from_json("value", VALUE).alias("value"), F.coalesce("scope", F.lit("APPLICANT")).alias("scope"))


def in_call_order(df: DataFrame, key: str = "opportunity_id", index: str = "chunk_index") -> DataFrame:
    """All rows of a call together, in its order."""
    return df.repartition(key).sortWithinPartitions(key, index)


def save_index(df: DataFrame, path: str, model: str) -> None:
    """``id, text_hash, vector`` with the model's name."""
    df.select("id", "text_hash", F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("model")).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The rows of one model; the filter reaches the files."""
    return spark.read.parquet(path).where(F.col("model") == model)
