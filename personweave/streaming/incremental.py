"""Incremental fusion: a stream of extracted records, of which each batch fuses the touched entities anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import fuse

#: Folders by hash of entity_key that the records are kept in; a batch reads those of the entities it touches.
BUCKETS = 1024


def bucket_of(key: str = "entity_key", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def fuse_stream(records: DataFrame, store: str, output: str, checkpoint: str, as_of: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Adds each batch to `store` and writes to `output`/batch=<n> the entities that it touched.

    The store is partitioned by a hash of entity_key, then by batch, so a batch lists and reads the folders of its own
    entities' buckets and no others. A batch that is repeated after a failure replaces its own
    folders, and never reads those of a later batch. The newest batch of an entity is its current state.
    `buckets` stays as it is for a store once begun.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("__bucket", bucket_of(buckets=buckets)).withColumn("__batch", F.lit(n)).persist()
        try:
            # only the folders that this batch writes are replaced
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket", "__batch").parquet(store)
            touched = keyed.select("entity_key").distinct()
            paths = [f"{store}/__bucket={r['__bucket']}" for r in keyed.select("__bucket").distinct().collect()]  # at most `buckets`
            held = spark.read.schema(keyed.schema).option("basePath", store).parquet(*paths).where(F.col("__batch") <= n) if paths else keyed
            held = held.alias("h").join(touched.alias("t"), F.col("h.entity_key").eqNullSafe(F.col("t.entity_key")), "left_semi")
            fuse([held.drop("__bucket", "__batch")], as_of).write.mode("overwrite").parquet(f"{output}/batch={n}")
        finally:
            keyed.unpersist()

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
