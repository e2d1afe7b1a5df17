"""Mixing sources to target weights: entropy balancing of document rates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm.common import Scratch

WEIGHTS = (5, 2, 1)
MOST = 3.0
_ROUNDS = 60
_NEAR = 1e-9
_DEALT = 4096  # documents of a source rounded together


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Target words of each source: `source`, `source_size`, `target`.

    Takes one row per source (`source`, `source_size`).  Weights repeat over the
    sources by code point, null last; shares sum to all words; a target stops at
    `most` times its source and the excess is shared by weight among the others.
    Only two sums come to the driver in each round.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    full, level = F.lit(False), 0.0
    while True:
        rest = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, 1))
        ).first()
        if not rest[2]:
            break
        before, level = level, (float(rest[0]) - float(rest[1] or 0)) / rest[2]
        if level == before:
            break
        full = F.col("weight") * F.lit(level) >= F.col("limit")
    return ranked.select("source", "source_size", F.least("limit", F.col("weight") * F.lit(level)).alias("target"))


def tilts(scratch: Scratch, counted: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """The dual of each source by Newton's method: `source`, `tilt`, `mean`.

    Rates are min(most, exp(tilt * size / mean)); they are the closest to 1 in
    entropy whose words meet the target.  `counted` has a row per source and size;
    each round sums over it in parallel, a step that leaves the bracket bisects it.
    """
    state = wanted.where("source_size > 0").select(
        "source", "target", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")
    )
    means = counted.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"))
    state = scratch.store(state.join(means, state["source"].eqNullSafe(means["source"])).select(state["*"], "mean"))
    for _ in range(_ROUNDS):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0))))
        words = F.col("docs") * F.col("size") * rate
        met = counted.alias("c").join(state.where("not done").alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        sums = met.groupBy(F.col("s.source").alias("at")).agg(
            # Decimal sums do not depend on the order of rows.
            F.sum(words.cast("decimal(28,6)")).cast("double").alias("words"),
            F.sum(F.when(rate < most, words * x).otherwise(0.0).cast("decimal(28,6)")).cast("double").alias("slope"),
        )
        off = F.col("words") - F.col("target")
        near = F.coalesce(F.abs(off) <= F.col("target") * _NEAR + 1e-6, F.lit(True))
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        middle = F.when(F.abs(low + high) < 1e5, (low + high) / 2).otherwise(F.col("tilt") * 2 + F.signum(low + high))
        joined = state.join(sums, state["source"].eqNullSafe(sums["at"]), "left")
        old = F.col("done") | near
        state = scratch.store(
            joined.select(
                "source", "target", "mean",
                F.when(old, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"),
                F.when(old, F.col("low")).otherwise(low).alias("low"),
                F.when(old, F.col("high")).otherwise(high).alias("high"),
                (old | (high - low < 1e-12)).alias("done"),
            )
        )
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "tilt", "mean")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Copies of each document that bring every source near its target words.

    Takes `doc_id`, `text`, `source`; gives a row per input row: doc_id, source,
    row (hash of the text), size (words), source_size, target, rate, copies, taken
    (size * copies).  Rates become copies over documents of falling size: what long
    documents leave too much or too little is made good by shorter ones, so that a
    group of some thousand documents of a source ends within a few of its shortest.

    Null or empty text: size 0 and no copies.  A null source is a source, the
    last.  Rows that repeat an id count each.  An empty table gives an empty one;
    other columns are ignored.  Reruns agree: nothing depends on row order.
    """
    scratch = Scratch(docs.sparkSession)
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("row"),
        count.cast("long").alias("size"),
    )
    docs = scratch.store(docs)
    counted = scratch.store(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")))
    sizes = scratch.store(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs")))
    wanted = scratch.store(targets(sizes.drop("docs"), weights, most).join(sizes.withColumnsRenamed({"source": "_s", "source_size": "_n"}), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_n"))
    solved = tilts(scratch, counted, wanted, most)
    facts = wanted.alias("w").join(solved.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source")), "left")
    facts = scratch.store(facts.select(F.col("w.source").alias("_source"), "source_size", "target", "docs", "tilt", "mean"))
    scratch.keep(docs, facts)
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))))
    # A tilt at the upper limit ends just below it; the difference is no fraction of a document.
    rate = F.when(F.lit(float(most)) - rate < 1e-6, F.lit(float(most))).otherwise(rate)
    rated = docs.join(facts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    group = F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.ceil(F.col("docs") / _DEALT))
    columns = ["doc_id", "source", "row", "size", "source_size", "target", "rate"]
    dealt = rated.select(*columns, group.alias("_group")).repartition("source", "_group")
    dealt = dealt.sortWithinPartitions("source", "_group", F.col("size").desc(), F.xxhash64("doc_id", "row"), "doc_id", "row")
    schema = T.StructType([*dealt.schema.fields, T.StructField("copies", T.LongType())])
    mixed = dealt.mapInArrow(_rounder(int(most)), schema)
    return mixed.select(*columns, "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _rounder(most: int):
    """Adds `copies`: each rate rounded down or up, whichever brings the group's words so far nearer to what its rates ask for."""

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, missing = None, 0.0
        for batch in batches:
            copies = []
            for source, own, size, rate in zip(*(batch.column(c).to_pylist() for c in ("source", "_group", "size", "rate")), strict=True):
                if group != (source, own):
                    group, missing = (source, own), 0.0
                n = 0
                if size:
                    missing += rate * size
                    n = min(max(math.floor(missing / size + 0.5), math.floor(rate)), math.ceil(rate), most)
                    missing -= n * size
                copies.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int64())], [*batch.schema.names, "copies"])

    return rounded


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """Documents repeated as often as the mix takes them, all columns as they came.

    Rows that agree in id, text and source share the copies of all of them: each has
    the whole part, and the first in order one of the rest.  Only groups with a rest
    are numbered.
    """
    scratch = Scratch(docs.sparkSession)
    marks = mix(docs, **settings).groupBy("doc_id", "row", F.col("source").alias("from")).agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows"))
    marks = scratch.store(marks.where("sum > 0"))
    row = F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))

    def taken(marks: DataFrame) -> DataFrame:
        same = docs["doc_id"].cast("long").eqNullSafe(marks["doc_id"]) & (row == marks["row"]) & docs["source"].eqNullSafe(marks["from"])
        return docs.join(marks, same)

    uneven = F.col("sum") % F.col("rows") != 0
    even, rest = marks.where(~uneven), marks.where(uneven)
    own = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    order = Window.partitionBy(rest["doc_id"], rest["row"], rest["from"]).orderBy(F.xxhash64(*[docs[c] for c in own]))
    more = F.when(F.row_number().over(order) <= rest["sum"] % rest["rows"], 1).otherwise(0)
    parts = []
    for both, times in ((taken(even), F.floor(even["sum"] / even["rows"])), (taken(rest), F.floor(rest["sum"] / rest["rows"]) + more)):
        parts.append(both.select(*[docs[c] for c in docs.columns], times.cast("int").alias("__copies")))
    repeated = parts[0].union(parts[1]).where("__copies > 0")
    return repeated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
