"""Streaming forms: running frequencies and segments of chunk streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_frequencies(chunks: DataFrame) -> DataFrame:
    """(fp, cnt) in update or complete mode; state is one row per fingerprint."""
    return chunks.groupBy("fp").agg(F.count("*").alias("cnt"))


def running_segments(chunks: DataFrame, seg_min: int, seg_max: int) -> DataFrame:
    """stream, seq, fp, size, seg_id: the batch rule, with size and number of the open segment kept per stream.

    Chunks of a stream must come in order from batch to batch; within a batch they are sorted here.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, size, begun = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(parts)).sort_values("seq")
        ids = []
        for fp, n in zip(rows["fp"], rows["size"]):
            if begun and (size + n > seg_max or (size >= seg_min and fp[10:12] == "3f")):
                number, size = number + 1, 0
            size, begun = size + int(n), True
            ids.append(number)
        state.update((number, size, begun))
        yield rows.assign(seg_id=ids)[["stream", "seq", "fp", "size", "seg_id"]]

    return chunks.select("stream", "seq", "fp", "size").groupBy("stream").applyInPandasWithState(
        fold, "stream string, seq long, fp string, size long, seg_id long", "number long, size long, begun boolean", "append", GroupStateTimeout.NoTimeout
    )
