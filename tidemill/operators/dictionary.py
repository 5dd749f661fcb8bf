"""Codes of strings: the different strings of some columns, numbered in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.single import positions


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(word, code) of every different string that isn't null; codes count from 0."""
    words = df.select(F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in columns]))).alias("word")).where("word is not null").distinct()
    return positions(words, ["word"], "code")


def encode(df: DataFrame, words: DataFrame, column: str, out: str) -> DataFrame:
    """df with the code of a column's strings, -1 for unknown and null ones."""
    return df.join(words.select(F.col("word").alias(column), F.col("code").alias(out)), column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def decode(df: DataFrame, words: DataFrame, column: str, out: str) -> DataFrame:
    """df with the string of a column's codes, null for unknown ones."""
    return df.join(words.select(F.col("code").alias(column), F.col("word").alias(out)), column, "left")


def decode_key(df: DataFrame, words: DataFrame, key: str, field: str, out: str) -> DataFrame:
    """df with the string of the code in one field of a compound key, null for unknown ones."""
    return decode(df.withColumn("_code", F.col(key)[field]), words, "_code", out).drop("_code")


def size(words: DataFrame) -> DataFrame:
    return words.agg(F.count("*").alias("n"))
