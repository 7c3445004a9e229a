"""An index that grows with a folder of documents (an addition of ours: the surveyed engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexquarry.operators import content, index
from lexquarry.sources import text as source

DOCUMENTS = "doc_id bigint, text string"


def watch(spark: SparkSession, folder: str, index_path: str, checkpoint: str, schema: str = DOCUMENTS, once: bool = True) -> StreamingQuery:
    """Indexes Parquet files as they come: postings by batch under index_path/postings, hashes beside them.

    A batch that is run again overwrites its own part, so a restart leaves no double postings. Content seen
    in an earlier batch, or before in this one, is passed over.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("content_sha256", content.content_hash(F.coalesce("text", F.lit(""))))
        rows = content.first_of_each(rows, ["content_sha256"], ["doc_id"])
        jvm = session._jvm
        seen = jvm.org.apache.hadoop.fs.Path(f"{index_path}/seen")
        if seen.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(seen):
            before = session.read.parquet(f"{index_path}/seen").filter(F.col("batch") < number)
            rows = rows.join(before.select("content_sha256").distinct(), "content_sha256", "left_anti")
        rows = rows.persist()  # until the batch is written
        pages = source.as_recognised(source.classified(source.lines(rows)))
        index.postings(source.bare_words(pages)).write.mode("overwrite").parquet(f"{index_path}/postings/batch={number}")
        rows.select("content_sha256", "doc_id").write.mode("overwrite").parquet(f"{index_path}/seen/batch={number}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
