"""Open documents as a stream: per document the last text, recounted with each change.

State is one row a document, kept by ``transformWithStateInPandas``'s predecessor
``applyInPandasWithState``; closing a document removes it and publishes empty counts, so that
what an editor shows is cleared.  Events of one document are applied in order of ``seq``
within a batch; an event older than the state is ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from plumbline.functions.classify import COUNTS, count_lines

EVENTS = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("kind", StringType()), StructField("text", StringType())])
STATE = StructType([StructField("seq", LongType()), StructField("text", StringType())])
RESULT = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("open", BooleanType()), *(StructField(c, LongType()) for c in COUNTS)])


def key_of(uri: str) -> str:
    """Classification key of a uri's last name."""
    name = uri.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return (ext if dot and stem else name.removeprefix(".")).lower()


def apply_events(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold a batch's events of one document into its state and recount it once."""
    (uri,) = key
    seq, text = state.get if state.exists else (-1, None)
    events = pd.concat(list(parts)).sort_values("seq", kind="stable")
    touched, is_open = False, text is not None
    for event in events.itertuples(index=False):
        if event.seq <= seq:
            continue
        seq, touched = int(event.seq), True
        is_open = event.kind != "close"
        text = (event.text or "") if is_open else None
    if not touched:
        return
    if is_open:
        state.update((seq, text))
        counts = count_lines(text.encode("utf-8", "replace"), key_of(uri))
    else:
        if state.exists:
            state.remove()
        counts = (0, 0, 0, 0, 0)
    yield pd.DataFrame([(uri, seq, is_open, *counts)], columns=RESULT.names)


def recounts(events: DataFrame) -> DataFrame:
    """Streaming: the counts of each document that a batch of ``events`` (uri, seq, kind, text) touches."""
    return events.groupBy("uri").applyInPandasWithState(apply_events, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def publish(recounted: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the query that hands each batch of recounts to ``sink``."""
    return recounted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
