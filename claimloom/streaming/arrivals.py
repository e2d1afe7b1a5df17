"""Incremental ingest and coding with Structured Streaming.

The study skips documents it already holds and codes claims in checkpointed portions.
Which ids and claims are known is keyed state of the stream: it is looked up by key for
the rows that arrive, survives restarts in the checkpoint, and no micro-batch reads the
store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimloom.operators.coding import Coder
from claimloom.operators.lexicon import Lexicon
from claimloom.operators.matching import claims
from claimloom.sources.corpus import CORPUS_SCHEMA
from claimloom.sources.tables import CLAIM_SCHEMA

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving_documents(spark: SparkSession, path: str, files_per_batch: int = 10000) -> DataFrame:
    """Corpus files as they appear in a folder."""
    return (
        spark.readStream.schema(CORPUS_SCHEMA)
        .option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
        .where(F.length("body_text") > 0)
    )


def _first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of a key that was never seen; nothing for a known key.

    Rows of one micro-batch come in the order of their ``_order``; marks of known keys have none.
    """
    known, best = state.exists, None
    for rows in frames:
        if known:
            continue
        if rows["_known"].any():
            known = True
            continue
        least = rows.sort_values("_order", kind="stable").head(1)
        if best is None or least["_order"].iloc[0] < best["_order"].iloc[0]:
            best = least
    if not state.exists:
        state.update((True,))
    if best is not None and not known:
        yield best.drop(columns=["_order", "_known"])


def first_arrivals(arriving: DataFrame, key: list[str], order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows of a stream whose key has not come before, the first of each key.

    ``known`` is a stream of the key columns that are held from the start.  The state is a flag
    per key in the state store of the checkpoint (RocksDB keeps it on disk: see
    ``STATE_STORE``); rows that tie in ``order`` are told apart by a hash.
    """
    columns = arriving.columns
    numbers = {f.name for f in arriving.schema if isinstance(f.dataType, T.IntegralType)}
    texts = [F.lpad(F.col(c).cast("string"), 20, "0") if c in numbers else F.col(c).cast("string") for c in order]
    place = F.concat_ws("\u0000", *[F.coalesce(t, F.lit("")) for t in texts], F.hex(F.xxhash64(*columns)))
    marked = arriving.withColumns({"_order": place, "_known": F.lit(False)})
    if known is not None:
        held = known.select(*key).withColumns(
            {**{c: F.lit(None).cast(arriving.schema[c].dataType) for c in columns if c not in key}, "_order": F.lit(""), "_known": F.lit(True)}
        )
        marked = marked.unionByName(held)
    return marked.groupBy(*key).applyInPandasWithState(_first, arriving.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def append_new_documents(
    documents: DataFrame, store: str, checkpoint: str, held: DataFrame | None = None
) -> StreamingQuery:
    """Append the documents whose id has not come before.

    ``held`` is a stream of ``id`` with the documents that the store holds when the stream
    first starts; its own additions it knows.
    """
    order = [c for c in ("file_name", "seq") if c in documents.columns] or ["url"]
    fresh = first_arrivals(documents, ["id"], order, held)
    return (
        fresh.writeStream.format("parquet")
        .option("path", store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_claims(documents: DataFrame, lexicon: Lexicon, store: str, checkpoint: str) -> StreamingQuery:
    """Claims of arriving documents; matching keeps no state between documents."""
    found = claims(documents, lexicon).drop("seen_at")
    return (
        found.writeStream.format("parquet")
        .option("path", store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def code_arriving_claims(
    spark: SparkSession,
    claims_path: str,
    coder: Coder,
    progress: str,
    checkpoint: str,
    files_per_batch: int = 25,
) -> StreamingQuery:
    """Code stored claims portion by portion, each portion saved at once."""
    arriving = (
        spark.readStream.schema(CLAIM_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(claims_path)
    )

    fresh = first_arrivals(arriving, ["claim_id"], ["claim_id"])

    def code(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure replaces what it wrote before.
        coder(batch).write.mode("overwrite").parquet(f"{progress}/portion={number}")

    return (
        fresh.writeStream.foreachBatch(code)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
