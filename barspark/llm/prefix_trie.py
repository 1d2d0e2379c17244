"""The prefix trie of conversations: a node for each distinct sequence of first turns, with totals of its subtree.

Turns are put in order over ranges of (conversation, order), so a conversation of any length is spread over tasks; counts
and prefix hashes are carried from range to range. A prefix is named by the exclusive or of two 64-bit hashes of each of
its turns and their places; conversations with equal names at a depth are the members of a node, which is then known by
its smallest member and its depth. Totals of subtrees come from ``contraction``.

Defined results: a null role or text is empty; null turns come first; turns with equal numbers are ordered by role, then
by a hash of role and text; rows without a conv_id belong to no conversation and are left out; other columns are
ignored; without conversations there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.contraction import subtree_totals
from barspark.llm.shared import join_frequent, kept

#: A conversation begins with turns of the first of its family of so many; how many is a hash modulo this.
FAMILY, SHARED_TURNS = 100, 6
#: Characters of a piece of a list of members.
PIECE_CHARS = 1 << 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, h1, h2 (hashes of role and text), chars of every turn of a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), half(1).alias("h1"), half(16).alias("h2"), F.char_length(text).cast("long").alias("chars"))


def scan(df: DataFrame, key: str, order: list[Column], mixed: tuple[str, ...] = ()) -> DataFrame:
    """df with nth (1, 2, ... within the key) and, in place of each column of mixed, the exclusive or of its values up to the row.

    Rows are sorted in ranges of key and order. A key that fills several ranges gets the counts and values of its earlier ranges added; there are no more such (key, range)
    pairs than ranges, so that table is broadcast.
    """
    ranged = kept(df, "unsorted").repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    kind = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("nth", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count, before = TaskContext.get().partitionId(), None, 0, {c: np.int64(0) for c in mixed}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch[key].to_numpy()
            first = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            goes_on = (start == 0) & ~first[0]
            nth = np.arange(n) - start + 1 + np.where(goes_on, count, 0)
            columns = {name: batch[name] for name in batch.schema.names}
            for c in mixed:
                running = np.bitwise_xor.accumulate(batch[c].to_numpy())
                ahead = np.append(np.int64(0), running[:-1])[start]
                value = running ^ ahead ^ np.where(goes_on, before[c], 0)
                columns[c], before[c] = pa.array(value), value[-1]
            last, count = keys[-1], nth[-1]
            yield pa.RecordBatch.from_pydict({**columns, "_range": pa.array(np.full(n, part, dtype=np.int32)), "nth": pa.array(nth)})

    rows = kept(ranged.mapInArrow(run, kind), "sorted")
    ends = rows.groupBy(key, "_range").agg(F.max("nth").alias("_n"), *(F.max_by(c, "nth").alias(f"_x_{c}") for c in mixed))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_range", F.sum("_n").over(earlier).alias("_n"), *(F.bit_xor(f"_x_{c}").over(earlier).alias(f"_x_{c}") for c in mixed)).filter("_n is not null")
    whole = rows.join(F.broadcast(carried), [key, "_range"], "left").withColumn("nth", F.col("nth") + F.coalesce("_n", F.lit(0)))
    return whole.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_x_{c}", F.lit(0))) for c in mixed}).drop("_range", "_n", *(f"_x_{c}" for c in mixed))


def shared_turns(conv_id: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return F.crc32(conv_id.cast("string")) % SHARED_TURNS


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, h1, h2, chars of every turn of the rebuilt conversations, conv_id of them all): the first turns of the family's first conversation, then the own turns after as many."""
    turns = kept(scan(turns_of(conversations), "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]).drop("turn", "role"), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.select("conv_id", family.alias("first"), shared_turns(F.col("conv_id")).alias("h"))
    # Any first conversation has less than 2 * FAMILY others.
    convs = convs.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first")), "first", "left")
    convs = kept(convs.withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0)))), "conversations")
    opening = turns.filter(F.col("nth") < SHARED_TURNS).withColumnRenamed("conv_id", "first")
    begun = opening.join(convs.select("first", "conv_id", "taken"), "first").filter(F.col("nth") <= F.col("taken"))
    own = turns.filter(F.col("nth") > shared_turns(F.col("conv_id")))
    own = join_frequent(own, convs.select("conv_id", "h", "taken"), ["conv_id"], sizes)
    columns = ["conv_id", "h1", "h2", "chars"]
    rows = begun.select(*columns, F.col("nth").alias("depth")).unionByName(own.select(*columns, (F.col("nth") - F.col("h") + F.col("taken")).alias("depth")))
    return rows, convs.select("conv_id")


def list_digests(ends: DataFrame, node: list[str]) -> DataFrame:
    """node and ends_sha256, the digest of the node's conv_ids in ascending order, joined by commas.

    The lists are made in pieces, over ranges of (node, conv_id); a digest then runs over a node's pieces in order, so a task reads a row for each range or PIECE_CHARS of a
    list and holds one. A digest cannot be made of parts, so the pieces of one node do run through one task.
    """
    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in node), T.StructField("conv_id", T.LongType()), T.StructField("ids", T.StringType())])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size, rows = None, None, [], 0, []
        for batch in batches:
            for *own, conv_id in zip(*(batch[c].to_pylist() for c in (*node, "conv_id"))):
                if ids and (own != key or size > PIECE_CHARS):
                    rows.append((*key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = own, conv_id
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=kind.names)
                rows = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, first, ",".join(ids))], names=kind.names)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running, rows = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch[c].to_pylist() for c in (*node, "ids"))):
                if own == key:
                    running.update(b"," + ids.encode())
                else:
                    if key is not None:
                        rows.append((*key, running.hexdigest()))
                    key, running = own, hashlib.sha256(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*node, "ends_sha256"])
                rows = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, running.hexdigest())], names=[*node, "ends_sha256"])

    order = [*node, "conv_id"]
    listed = kept(ends.select(*order), "ends").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, kind)
    dealt = listed.repartition(*node).sortWithinPartitions(*order)
    return dealt.mapInArrow(digest, T.StructType([*kind.fields[: len(node)], T.StructField("ends_sha256", T.StringType())]))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, depth (1, 2, ... without gaps), h1, h2, chars of every turn; convs: conv_id of all conversations, also those without turns.
    """
    mixed = rows.select("conv_id", "depth", "chars", F.xxhash64("depth", "h1", "h2").alias("x1"), F.xxhash64("h2", "depth", "h1").alias("x2"))
    own = mixed.withColumns({"p1": F.col("x1"), "p2": F.col("x2")})
    prefixes = scan(own, "conv_id", [F.col("depth")], ("x1", "x2")).drop("nth")
    # The prefix without its last turn.
    prefixes = kept(prefixes.withColumns({"p1": F.col("x1").bitwiseXOR(F.col("p1")), "p2": F.col("x2").bitwiseXOR(F.col("p2"))}), "prefixes")
    name = ["depth", "x1", "x2"]
    nodes = prefixes.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("chars"), none.alias("p1"), none.alias("p2"))
    nodes = kept(nodes.unionByName(root), "nodes")

    above = ["above", "p1", "p2"]
    children = kept(nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("above"), "p1", "p2").agg(F.count("*").alias("n")), "children")
    parents = nodes.select(F.col("depth").alias("above"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    known = join_frequent(nodes.withColumn("above", F.col("depth") - 1), parents, above, children).drop(*above)
    counted = known.join(children.select(F.col("above").alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("n").alias("n_children")), name, "left")
    counted = kept(counted.withColumn("n_children", F.coalesce("n_children", zero)), "tree")

    sums = counted.select(
        "conv_id", "depth", "parent_conv_id", F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("parent_depth"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    totals = subtree_totals(sums, ("conv_id", "depth"), ("parent_conv_id", "parent_depth"), ["n_leaves", "saved_tokens"])

    everyone = prefixes.select("conv_id", *name).unionByName(convs.select("conv_id", *(zero.alias(c) for c in name)))
    ends = everyone.groupBy("conv_id").agg(F.max_by(F.struct(*name), "depth").alias("end")).select("conv_id", "end.*")
    whole = counted.join(totals, ["conv_id", "depth"]).join(list_digests(ends, name), name, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuild(conversations))
