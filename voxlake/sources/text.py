"""Text inputs and outputs: designs, matrices, regressors, connectomes, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, comments: str) -> DataFrame:
    """(file, line, words) of lines with content, in file order."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    rows = rows.withColumn("text", F.trim("text")).filter("text <> ''")
    return rows.filter(~F.substring("text", 1, 1).isin(*comments)).select("file", "line", "text", F.split("text", r"[\s,]+").alias("words"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, onset, duration, height): comments begin with %, # or /; durations from 0 to .5 s become .5, heights default to 1."""
    n = lambda i: F.try_element_at("words", F.lit(i + 1)).cast("double")
    rows = _lines(spark, path, "%#/").select("file", "line", n(0).cast("int").alias("id"), n(1).alias("onset"), n(2).alias("duration"), F.coalesce(n(3), F.lit(1.0)).alias("height"))
    return rows.withColumn("duration", F.when((F.col("duration") >= 0) & (F.col("duration") < 0.5), 0.5).otherwise(F.col("duration"))).filter("id is not null").orderBy("file", "line").drop("line")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, x array<double>): rows of one length."""
    rows = _lines(spark, path, "%#/").select("line", F.transform("words", lambda w: w.cast("double")).alias("x"))
    got = rows.agg(F.countDistinct(F.size("x")).alias("k")).first()
    if got.k > 1:
        raise ValueError("rows have different lengths")
    from pyspark.sql import Window

    return rows.select((F.row_number().over(Window.orderBy("line")) - 1).alias("row"), "x")  # a design has one row an image


def read_column(spark: SparkSession, path: str, name: str = "y") -> DataFrame:
    """(subj, y): one number a line."""
    return read_matrix(spark, path).select(F.col("row").alias("subj"), F.col("x")[0].alias(name))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(row, grp): exchange groups, whole numbers from 0 to the number of rows."""
    g = read_matrix(spark, path).select("row", F.col("x")[0].cast("int").alias("grp"))
    if g.filter((F.col("grp") < 0) | (F.col("grp") > g.count())).count():
        raise ValueError("a group is out of range")
    return g


def read_connectomes(spark: SparkSession, path: str, components: int = 100) -> DataFrame:
    """(file, feats array<float>): the one line of n (n - 1) / 2 values that isn't a comment."""
    size = components * (components - 1) // 2
    rows = _lines(spark, path, "#%$").select("file", F.transform("words", lambda w: w.cast("float")).alias("feats"))
    bad = rows.filter(F.size("feats") != size).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file} has not {size} values")
    return rows


def write_table(df: DataFrame, path: str, header: bool = True, sep: str = " ") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def parse_attributes(column: str):
    """``name=value`` words of a column as a map."""
    return F.str_to_map(F.col(column), F.lit(" "), F.lit("="))
