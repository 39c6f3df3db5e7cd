"""Rewriting of a stream of documents: decisions need one document alone, so each
micro-batch goes through the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching


def rewrite_stream(docs: DataFrame, rules: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append (doc_id, rendered) of docs(doc_id, text) to path. A batch that is
    run again after a failure replaces what it had written."""

    def batch(df: DataFrame, n: int) -> None:
        matching.decisions(df, matching.substring_matches(df, rules)).select("doc_id", "rendered").write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
