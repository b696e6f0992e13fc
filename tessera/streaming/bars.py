"""Bars from a stream of events: tumbling windows under a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.stores import scratch


def bars(events: DataFrame, seconds: int = 5, late: str = "10 seconds") -> DataFrame:
    """(asset, dt, open, high, low, close, n) by window of event time, for batch and stream alike; later events than the watermark allows are
    dropped by the stream."""
    e = events.filter("value > 0")
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.col("event_type").alias("asset"), F.window("ts", f"{seconds} seconds").alias("w"))
    out = g.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("n"))
    return out.select("asset", F.col("w.start").alias("dt"), "open", "high", "low", "close", "n")


def run_bars(spark: SparkSession, path: str, seconds: int = 5) -> DataFrame:
    """All bars of a finished source: the stream runs until it has read what is there. Each batch writes the bars that it changed, the watermark frees
    the state of those that can change no more, and the last version of a bar is read."""
    schema = spark.read.parquet(path).schema
    if dict(spark.read.parquet(path).dtypes)["ts"] == "timestamp_ntz":
        schema = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).schema
    name, out = f"bars_{uuid.uuid4().hex}", scratch(spark)
    folder, _, file = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/bars/batch={number}")

    q = bars(source, seconds).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(put).queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    made = bars(spark.createDataFrame([], schema), seconds).columns
    versions = spark.read.schema(bars(spark.createDataFrame([], schema), seconds).schema.add("batch", "long")).parquet(f"{out}/bars")
    return versions.groupBy("asset", "dt").agg(F.max_by(F.struct(*made[2:]), "batch").alias("b")).select("asset", "dt", "b.*")


def run_held(signals: DataFrame, loss: float = 0.07) -> DataFrame:
    """held_stream over the signals of a table, written as a source first."""
    spark, out = signals.sparkSession, scratch(signals.sparkSession)
    signals.write.parquet(f"{out}/in")
    source = spark.readStream.schema(signals.schema).parquet(f"{out}/in")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/held/batch={number}")

    held_stream(source, loss).writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("asset string, dt date, held int, entry double").parquet(f"{out}/held/*")


def held_stream(signals: DataFrame, loss: float = 0.07) -> DataFrame:
    """The hold state as a stream: (asset, dt, held, entry), with the state of each asset kept between batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        held, entry = state.get if state.exists else (0, None)
        rows = []
        for r in pd.concat(list(frames)).sort_values("dt").itertuples():  # a batch's rows of one asset come in several frames
            if (entry is not None and (entry - r.close) / entry >= loss - 1e-12) or r.signal < 0:
                held, entry = 0, None
            elif r.signal > 0 and entry is None:
                held, entry = 1, r.close
            rows.append((key[0], r.dt, held, entry))
        yield pd.DataFrame(rows, columns=["asset", "dt", "held", "entry"]).astype({"entry": object})
        state.update((held, entry))

    return signals.groupBy("asset").applyInPandasWithState(step, "asset string, dt date, held int, entry double", "held int, entry double", "append", GroupStateTimeout.NoTimeout)
