"""Diarisation as one pipeline (E9): sliding chunks, embeddings, clusters, speaker segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import compress_segments, sliding_chunks
from .vectors import cluster_speakers


def diarize(segments: DataFrame, embed, dur_ms: int = 1500, step_ms: int = 750) -> DataFrame:
    """(job_id, seg, start_ms, end_ms, speaker) of voice segments (job_id, start_ms, end_ms). They are cut in sliding
    chunks (I3); ``embed`` adds an ``embedding`` to chunks (job_id, ord, start_ms, end_ms), behind the model seam; chunks
    are clustered (E8), and neighbours of one speaker joined (I4). A job without voice gives no rows."""
    from pyspark.sql import Window as W

    cut = sliding_chunks(segments, dur_ms, step_ms).select("job_id", F.col("sub_start").alias("start_ms"), F.col("sub_end").alias("end_ms"))
    chunks = cut.withColumn("ord", (F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "end_ms")) - 1).cast("long"))
    labels = cluster_speakers(embed(chunks).select("job_id", "ord", "embedding"))
    turns = chunks.join(labels, ["job_id", "ord"]).select("job_id", F.col("ord").alias("seg_ord"), "start_ms", "end_ms", F.col("cluster").cast("int").alias("speaker"))
    return compress_segments(turns)
