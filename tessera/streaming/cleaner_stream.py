"""The TTL cleaning job as a Structured Streaming query.

New TTL files landing in a folder are read line by line, so a large file is split across tasks and
no record holds a whole file; a micro-batch is cut into concept blocks and URIs are cleaned.  The first block of a URI stays: a block of an earlier micro-batch
before one of a later, inside a micro-batch the smallest (file, block number).
URIs of earlier batches are read back from the concepts already written, so no
setting of the session is touched and a restarted query knows them.  Each
micro-batch writes its concepts once with ``foreachBatch`` and reads them back for its cleaned labels
and label issues, so nothing is held in the executors' memory; the batch id names the output folder,
so a retried batch overwrites its own output instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import clean_label, clean_uri
from tessera.operators.cleaner import LABEL_PROPS, dedupe_concepts
from tessera.operators.rules import rule_label_quality, rule_s13, rule_s14
from tessera.session import tidy_shuffles
from tessera.sources.ttl import blocks_from_lines, concept_heads, content_lines, parse_literals


def line_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    """Streaming lines (file, split, value); a split arrives whole and in order in one partition of its micro-batch."""
    return (spark.readStream.format("text").load(source_dir)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"))


def first_blocks(lines: DataFrame, earlier: DataFrame | None, base: str | None = None) -> DataFrame:
    """(uri, raw_uri, file, k, block): one block per URI of a batch, without the URIs of ``earlier``.

    The first block is chosen by the start lines alone, so only the lines of blocks that stay are gathered.
    """
    heads = concept_heads(lines).withColumn("uri", clean_uri("raw_uri", base))
    kept = dedupe_concepts(heads)[0]
    if earlier is not None:
        kept = kept.join(earlier.select("uri").distinct(), "uri", "left_anti")
    return blocks_from_lines(lines, kept.select("uri", "raw_uri", "file", "k"))


def _write_batch(sink_dir: str, base: str | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        earlier = None
        if batch_id > 0:  # every batch before this one has written its folder, empty or not
            earlier = batch.sparkSession.read.parquet(*[f"{sink_dir}/concepts/batch={i}" for i in range(batch_id)])
        spark = batch.sparkSession

        def written(name: str, df: DataFrame) -> DataFrame:
            path = f"{sink_dir}/{name}/batch={batch_id}"
            with tidy_shuffles(spark):
                df.write.mode("overwrite").parquet(path, compression="zstd")
            return spark.read.schema(df.schema).parquet(path)

        b = written("concepts", first_blocks(content_lines(batch), earlier, base).select("uri", "raw_uri", "file", "k", "block"))
        lit = parse_literals(b.withColumn("pos", F.struct("file", "k")), uri_col="uri")
        labels = written("labels", lit.where(F.col("prop").isin(*LABEL_PROPS))
                         .withColumn("text", clean_label("text")).where(F.col("text").isNotNull()))
        written("issues", rule_s14(labels).unionByName(rule_s13(labels)).unionByName(rule_label_quality(labels)))
    return run


def clean_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_location: str,
                 base: str | None = None, available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    """Start the streaming cleaner; ``available_now`` processes what is there and stops."""
    w = (line_stream(spark, source_dir).writeStream
         .option("checkpointLocation", checkpoint_location)
         .foreachBatch(_write_batch(sink_dir, base)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
