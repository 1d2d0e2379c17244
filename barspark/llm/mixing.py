"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target is its weighted share of all words, at most ``MOST_REPEATS`` times its size; what is above is shared again among
the others by weight. A document is taken floor(f) times for sure, f = target / source size, and once more with probability
f - floor(f). Which ones is chosen by the cube method: the vector of probabilities moves along the null space of the
constraints (number of documents and number of words of the source), to one of the two ends of its line by chance, so that
both totals stay what they are while more and more probabilities become 0 or 1. Each move is led by the largest open document and made up for by all the others,
so the large ones are decided first and small ones are left. Groups of a few thousand documents of a source fly apart from each other; the two documents at most that
each leaves open fly again in groups of such, until one group for each source is left. For its last ``LANDING`` documents the number of documents is let go: they move
with their words kept, and the last one open is taken by chance. So every document is taken floor(f) or floor(f) + 1 times with mean f, whatever the size of its source, and a
source's words miss the target by no more than one document's, mostly a small one's, unless one document outweighs what the others can make up for.

Defined results: a null or blank text has size 0 and is taken 0 words; null sources are one source, which comes last; a
source without words has target 0; rows that are equal in id and text are separate documents of equal chances; an empty table gives no rows. Other columns are
ignored. Equal tables and seeds give equal results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.shared import kept, number_copies

MOST_REPEATS, WEIGHTS = 3, (1, 2, 3)
GROUP, LANDING = 2048, 10


def _places(df: DataFrame, column: str) -> DataFrame:
    """df with _place, 0, 1, 2, ... in the order of a column, nulls last. Only a count for each partition comes to the driver."""
    order = F.col(column).asc_nulls_last()
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = pa.array(np.arange(n, n + batch.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), at], names=[*batch.schema.names, "_part", "_at"])
            n += batch.num_rows

    schema = T.StructType([*ranged.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    placed = kept(ranged.mapInArrow(number, schema), "places")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    starts = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return placed.join(F.broadcast(starts), "_part").withColumn("_place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, n_docs, target of each source of sized (source, size).

    Targets are least(most_repeats x size, weight x level), with the level at which they add up to all words. The level is raised step by step: what the sources
    above their caps leave is shared among the others by weight, until none is above. Each step is a sum over the sources, of which there may be many.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = _places(sizes, "source").withColumn("weight", F.get(cycle, F.col("_place") % len(weights))).withColumn("cap", F.col("source_size") * float(most_repeats))
    rows = kept(rows.drop("_place"), "sources")
    level = 0.0
    while True:
        open_ = F.col("cap") > F.col("weight") * level
        left = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(~open_, F.col("cap"))).alias("capped"), F.sum(F.when(open_, F.col("weight"))).alias("weights")).first()
        if not left["weights"]:
            break
        raised = ((left["all"] or 0) - (left["capped"] or 0.0)) / left["weights"]
        if raised <= level:
            break
        level = raised
    return rows.select("source", "source_size", "n_docs", F.least("cap", F.col("weight") * level).alias("target"))


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 1, documents: bool = True) -> np.ndarray:
    """Move probabilities along the null space of (1, size), or of size alone, until no more than ``leave`` are open or none can move (then two at most are). Each move is led by the largest document that can move; the others make up for it in proportion to p (1 - p)."""
    chance = chance.astype(float).copy()
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    scaled = size / max(1.0, float(size.max(initial=0)))
    while len(open_) > leave:
        p, x = chance[open_], scaled[open_]
        w = p * (1 - p)
        s0, s1, s2 = w.sum(), (w * x).sum(), (w * x * x).sum()
        det = s0 * s2 - s1 * s1
        alike = det <= 1e-10 * s0 * s2 or x[0] - x[-1] < 1e-12  # all of one size: one constraint
        for lead in range(min(len(open_), 3)):
            if alike:
                move = -w / s0
            elif not documents:
                move = -w * x[lead] / s1
            else:
                move = -w * ((s2 - s1 * x[lead]) + (s0 * x[lead] - s1) * x) / det
            move[lead] += 1
            if move[lead] > 1e-9:
                break
        else:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(move > 0, (1 - p) / move, np.where(move < 0, p / -move, np.inf)).min()
            down = np.where(move > 0, p / move, np.where(move < 0, (1 - p) / -move, np.inf)).min()
        p = p + (up if rng.random() * (up + down) < down else -down) * move
        p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
        chance[open_] = p
        still = (p > 0) & (p < 1)
        if still.all():  # rounding kept the end away: take the nearest one there
            i = int(np.minimum(p, 1 - p).argmin())
            chance[open_[i]] = float(round(p[i]))
            still[i] = False
        open_ = open_[still]
    return chance


def land(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what a flight has left open: the documents move with their words kept, whatever their number, and the last one is taken with its probability."""
    chance = flight(chance, size, rng, documents=False)
    for k in np.flatnonzero((chance > 0) & (chance < 1)):
        chance[k] = float(rng.random() < chance[k])
    return chance


def _fly(seed: int, last: bool):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc", "size"], kind="stable")
        key = [seed + 1_000_000 * last, int(pdf["source_hash"].iloc[0]) & 0xFFFFFFFF, int(pdf["grp"].iloc[0]), len(pdf)]
        size, start = pdf["size"].to_numpy(), pdf["chance"].to_numpy()
        rng = np.random.default_rng(key)
        flown = land(flight(start, size, rng, LANDING), size, rng) if last else flight(start, size, rng)
        return pdf.assign(chance=flown)[_COLUMNS]

    return fly


_COLUMNS = ["row", "source_hash", "n", "size", "order", "doc", "chance"]
_FLOWN = "row long, source_hash long, n long, size long, order long, doc long, chance double"


def choose(rows: DataFrame, seed: int = 0, group: int = GROUP) -> DataFrame:
    """row, order and chance (0 or 1) of rows (row, source_hash, n, size, order, doc, chance), balanced within each source_hash, which has n rows at most."""
    done, level = [], 0
    most = rows.agg(F.max("n")).first()[0] or 0
    while most > group:
        groups = F.ceil(F.col("n") / group)
        rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + level), "order", "doc"), groups).cast("int"))
        flown = kept(rows.groupBy("source_hash", "grp").applyInPandas(_fly(seed + level, False), _FLOWN), "flight")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(flown.filter(~open_).select("row", "order", "chance"))
        rows, level = flown.filter(open_).withColumn("n", 2 * groups), level + 1  # each group leaves two at most
        most = 2 * -(-most // group)
    last = rows.withColumn("grp", F.lit(0)).groupBy("source_hash").applyInPandas(_fly(seed + level, True), _FLOWN).select("row", "order", "chance")
    for part in done:
        last = last.unionByName(part)
    return last


def _numbered(df: DataFrame) -> DataFrame:
    """df (order, doc_id, source, ...) with a key of its own for each row; rows that are equal in the three are told apart by a count."""
    return number_copies(df, ["order", "doc_id", "source"], "_nth").withColumn("row", F.xxhash64("order", "doc_id", "source", "_nth")).drop("_nth")


def mix_sources(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """row and order (the key of the row), doc_id, source, size, source_size, target, repeats (how often the mix takes it) and taken (words) of every document."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words.alias("size"), F.xxhash64("text").alias("order"))
    sized = kept(_numbered(sized.withColumn("order", F.xxhash64("doc_id", "order"))), "sized")
    targets = source_targets(sized, weights, most_repeats)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.least(rate, F.lit(float(most_repeats)))).withColumn("sure", F.floor(F.col("rate") + 1e-12))
    rows = kept(rows, "rated")
    open_ = rows.select("row", F.xxhash64("source", F.lit(1)).alias("source_hash"), F.col("n_docs").alias("n"), "size", "order", F.coalesce("doc_id", F.lit(-1)).alias("doc"), (F.col("rate") - F.col("sure")).alias("chance"))
    picked = choose(open_.filter("chance > 1e-9 and size > 0"), seed)
    # Two hashes name a row, so that no two rows are taken for one.
    out = rows.join(picked, ["row", "order"], "left").withColumn("repeats", (F.col("sure") + F.coalesce("chance", F.lit(0.0))).cast("int"))
    return out.select("row", "order", "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def take_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    taken = mix_sources(docs, seed).filter("repeats > 0").select(F.col("row").alias("_row"), F.col("order").alias("_order"), F.col("repeats").alias("_repeats"))
    carried = docs.select(F.struct(*docs.columns).alias("whole"), F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("order"), F.col("doc_id").cast("long").alias("doc_id"), "source")
    rows = _numbered(carried).join(taken, (F.col("row") == F.col("_row")) & (F.col("order") == F.col("_order")))
    return rows.select("whole", F.explode(F.sequence(F.lit(1), "_repeats"))).select("whole.*")
