"""Structured Streaming forms of the grouped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens


def windowed_reduce(stream: DataFrame, time: str, width: str, key: str, late: str = "10 minutes", slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates per key and event-time window; rows later than ``late`` are dropped and state is freed behind it."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return (
        stream.withWatermark(time, late).groupBy(window.alias("window"), key)
        .agg(*[c.alias(n) for n, c in aggregates.items()])
    )


def stream_word_count(stream: DataFrame, text: str = "value") -> DataFrame:
    """Word count over a stream of text rows; run it in complete or update mode."""
    return stream.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
