"""Shorthand for the input shapes most queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.bars import ticks_to_bars
from barline.sources import tables


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(tables.quotes(spark, sf_dir), "1h")


def four_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(tables.quotes(spark, sf_dir), "4h")


def rows_as(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)
