"""Detection and masking of a stream of documents: a stateless projection, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textveil.operators.masking import deidentify


def mask_stream(docs: DataFrame, key: str, secret: str, masked_path: str, mapping_path: str, checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Two queries over the stream: masked texts go to one place, the mapping to another. Each reads what is there, then ends."""
    masked, mapping = deidentify(docs, key, secret)
    start = lambda df, name, path: df.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(path, format="parquet")
    return start(masked, "masked", masked_path), start(mapping, "mapping", mapping_path)
