"""Registration of the package's data sources in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tokenloom.sources.arrow_ipc import ArrowIpcSource
from tokenloom.sources.arrow_stream import StreamRangesSource
from tokenloom.sources.readers import ByteBlockSource, LogLineSource, TokenBinSource, TokenFileSource, TokenStatsSource
from tokenloom.sources.sinks import PositionedSink


def register_sources(spark: SparkSession) -> None:
    for source in (
        ArrowIpcSource, StreamRangesSource, ByteBlockSource, TokenBinSource, TokenFileSource, TokenStatsSource, LogLineSource, PositionedSink,
    ):
        spark.dataSource.register(source)
