"""Structured Streaming forms of the sync kernels: latest event, quiet-period debounce, keyed edit folding."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """The last event of each key so far (update mode); every column of it."""
    others = [c for c in stream.columns if c != key]
    return stream.withWatermark(at, late).groupBy(key).agg(F.max_by(F.struct(*others), at).alias("last"))


def debounced(stream: DataFrame, key: str, at: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """One row per key and run of events without a pause of ``quiet``: its last event (append mode)."""
    others = [c for c in stream.columns if c != key]
    runs = stream.withWatermark(at, late).groupBy(key, F.session_window(at, quiet).alias("run"))
    return runs.agg(F.max_by(F.struct(*others), at).alias("last"), F.count("*").alias("n"))


def windowed(stream: DataFrame, key: str, at: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(key, window, n, first, last) of tumbling windows, or sliding ones; events later than the watermark are let go (append mode)."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(key, w.alias("window")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def once(stream: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """Events without those that repeat a key within the watermark; state is kept for that long only."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def folded_texts(stream: DataFrame, key: str) -> DataFrame:
    """(key, seq, text) after each micro-batch: edits (seq, start, end, text; null start: all) applied in order of seq, old ones dropped.

    State is one text and one number per key."""
    import pandas as pd

    def fold(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, text = state.get if state.exists else (-1, "")
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, start, end, new in rows[["seq", "start", "end", "text"]].itertuples(index=False):
            if seq <= last:
                continue
            text = new if pd.isna(start) else text[: int(start)] + new + text[int(end) :]
            last = int(seq)
        state.update((last, text))
        yield pd.DataFrame({key: [name[0]], "seq": [last], "text": [text]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, seq long, text string", "last long, text string", "update", "NoTimeout")
