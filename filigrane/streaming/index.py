"""A search index that follows a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from filigrane.operators.store import Store

#: Batches after which the index is folded together.
COMPACT_EVERY = 16


def index_stream(stream: DataFrame, store: Store, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep a store up to date with a stream of filings (source, section, content); runs until the input is read.

    A batch that is tried again, after a failure or a restart, writes the same rows under the same number.  A source
    that comes again replaces its earlier text; if it comes twice in one batch, both texts are kept.
    """

    def take(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.path)
        own.add(batch, number)
        if (number + 1) % compact_every == 0:
            own.compact()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
