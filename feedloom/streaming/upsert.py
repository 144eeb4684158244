"""Structured Streaming: stateful upsert of feed items, and counters.

Items of a feed reach its state in order of ``seq``. A known guid keeps its index and takes the new content; a known
content hash under another guid is the same item; a new one gets the next index; a feed that has MOST items takes no
more. State is per feed; late items are never dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

MOST = 10_000
CHANGES = "feed string, guid string, idx long, hash string, seq long"


def upsert(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known: dict[str, list] = json.loads(state.get[0]) if state.exists else {}
    changed = {}
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for guid, content, seq in zip(rows["guid"], rows["hash"], rows["seq"], strict=True):
        if guid in known:
            if known[guid][1] == content:
                continue
            known[guid][1] = content
        elif len(known) < MOST:
            known[guid] = [len(known), content]
        else:
            continue
        changed[guid] = int(seq)
    state.update((json.dumps(known),))
    yield pd.DataFrame([(key[0], g, *known[g], s) for g, s in changed.items()], columns=["feed", "guid", "idx", "hash", "seq"])


def upserts(items: DataFrame) -> DataFrame:
    """items(feed, guid, hash, seq) as a stream of changed rows."""
    return items.groupBy("feed").applyInPandasWithState(upsert, CHANGES, "known string", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 8) -> DataFrame:
    """A Parquet folder, or one file, as a stream."""
    name = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(name + ("" if name.endswith("*") else "*"))


def _drain(spark: SparkSession, df: DataFrame, mode: str) -> str:
    from ..shared import new_path

    path, marks = new_path(spark, "stream"), new_path(spark, "stream-marks")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    df.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return path


def run_to_table(spark: SparkSession, items: DataFrame) -> DataFrame:
    """All that is there now, upserted: the last state of every item."""
    from pyspark.sql import functions as F

    changes = spark.read.parquet(_drain(spark, upserts(items), "append"))
    last = changes.groupBy("feed", "guid").agg(F.max_by(F.struct("idx", "hash"), F.struct("batch", "seq")).alias("s"))
    return last.select("feed", "guid", "s.idx", "s.hash")


def complete(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """A streaming aggregate over all that is there now."""
    from pyspark.sql import functions as F

    all_ = spark.read.parquet(_drain(spark, counts, "complete"))
    return all_.filter(F.col("batch") == all_.agg(F.max("batch")).first()[0]).drop("batch")
