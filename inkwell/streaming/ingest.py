"""Documents from a stream into an index store, a segment for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import IndexStore


def apply_batch(store: IndexStore, changes: DataFrame, batch: int, key: str = "document_id") -> None:
    """Index the documents of a batch; rows with deleted = true remove theirs.

    Where a batch has an id several times, the row of it whose JSON has the least
    hash is taken, a removal only if there is no other.  The batch's number is the
    segment's, so a batch that is run again replaces what it wrote by the same.
    """
    def one(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy(key).orderBy(F.xxhash64(F.to_json(F.struct(*rows.columns))))
        return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")

    if "deleted" in changes.columns:
        put = changes.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
        gone = changes.where("deleted").select(key).distinct()
    else:
        put, gone = changes, None
    if gone is not None:
        store.remove(gone, 2 * batch)
    store.index(one(put), 2 * batch + 1, key)


def ingest(changes: DataFrame, store: IndexStore, checkpoint: str, key: str = "document_id", **trigger) -> StreamingQuery:
    """Start a query that keeps the store up to date with a stream of documents."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: apply_batch(store, df, n, key))
    return (writer.trigger(**trigger) if trigger else writer).start()
