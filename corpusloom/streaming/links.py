"""A crawl's seen-link set as a stream: links are new once within a watermark, so state doesn't grow for ever."""

from __future__ import annotations

from pyspark.sql import DataFrame


def new_links(stream: DataFrame, link: str = "url", time: str = "ts", within: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([link])
