"""Totals of all subtrees of a forest by parallel tree contraction: joins in rounds, not a walk by levels.

Each round rakes all leaves (a leaf's sum goes to its parent) and compresses chains: a node with one child that draws a
higher number than its parent and its child is taken out; its sum goes to its parent, which gets the child. So a chain
of any length shrinks by about a third a round, and a forest of n nodes is gone in O(log n) rounds. What a round sends
from node to node is joined by adding it up by key, partially before the shuffle: a node with a third of all nodes as
children gets a row from each task, and no node's children are ever listed.

Taken-out nodes are then expanded: the total of one is its own sum and the total of the child that it had, which may have
been taken out in a later round; such pointers are followed in doubling steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barspark.llm.shared import kept, new_folder

#: What becomes of a node in a round.
RAKED, SPLICED, ALIVE = 0, 1, 2
#: A node's key is two whole numbers; _p, _q is its parent's (null: a root), _new_p, _new_q a new parent's, _kid_a, _kid_b its child's if it has one only.
_ROW = ["_a", "_b", "_p", "_q", "_new_p", "_new_q", "_kid_a", "_kid_b", "_own", "_raked", "_kids"]


def _row(values: list[str], **columns: str | int | Column) -> Column:
    """A row that is sent to the node _a, _b; what is not given is null, or 0 for counts and values."""
    zero = {c: F.lit(0) for c in ("_own", "_raked", "_kids", *values)}
    given = {k: F.col(v) if isinstance(v, str) else F.lit(v) for k, v in columns.items()}
    return F.struct(*((zero | given).get(c, F.lit(None)).cast("long").alias(c) for c in (*_ROW, *values)))


def _received(rows: DataFrame, sent: Column, values: list[str]) -> DataFrame:
    """What the nodes know after all rows of the array sent have arrived. Rows for nodes that are gone are dropped."""
    arrived = rows.select(F.explode(sent).alias("_m")).select("_m.*").groupBy("_a", "_b")
    highest = [F.max(c).alias(c) for c in ("_p", "_q", "_new_p", "_new_q", "_own", "_raked")]
    # One child's key is the exclusive or of the keys of all children and of those that went.
    only = [F.bit_xor(c).alias(c) for c in ("_kid_a", "_kid_b")]
    known = arrived.agg(*highest, *only, *(F.sum(c).alias(c) for c in ("_kids", *values))).filter("_own = 1")
    return known.withColumns({"_p": F.coalesce("_new_p", "_p"), "_q": F.coalesce("_new_q", "_q")})


def _round(rows: DataFrame, number: int, values: list[str]) -> DataFrame:
    """One rake and one compress; rows is the result of the round before."""
    mine = {v: v for v in values}
    own = _row(values, _a="_a", _b="_b", _p="_p", _q="_q", _own=1, **mine)
    to_parent = _row(values, _a="_p", _b="_q", _kids=1, _kid_a="_a", _kid_b="_b")
    # A node that is taken out hands its sum and its child to its parent, and its parent to its child.
    spliced = F.array(_row(values, _a="_p", _b="_q", _kids=1, _kid_a="_kid_a", _kid_b="_kid_b", **mine), _row(values, _a="_kid_a", _b="_kid_b", _new_p="_p", _new_q="_q"))
    counted = _received(rows, F.when(F.col("_state") == SPLICED, spliced).when(F.col("_p").isNull(), F.array(own)).otherwise(F.array(own, to_parent)), values)

    leaf = (F.col("_kids") == 0) & F.col("_p").isNotNull()
    stays = _row(values, _a="_a", _b="_b", _p="_p", _q="_q", _own=1, _kids="_kids", _kid_a="_kid_a", _kid_b="_kid_b", **mine)
    goes = _row(values, _a="_a", _b="_b", _p="_p", _q="_q", _own=1, _raked=1, **mine)
    given = _row(values, _a="_p", _b="_q", _kids=-1, _kid_a="_a", _kid_b="_b", **mine)
    left = _received(counted, F.when(leaf, F.array(goes, given)).otherwise(F.array(stays)), values)

    drawn = lambda a, b: F.xxhash64(F.lit(number), a, b)
    out = (F.col("_kids") == 1) & F.col("_p").isNotNull() & (drawn("_a", "_b") > drawn("_p", "_q")) & (drawn("_a", "_b") > drawn("_kid_a", "_kid_b"))
    state = F.when(F.col("_raked") == 1, RAKED).when(out, SPLICED).otherwise(ALIVE)
    kid = {c: F.when(out, F.col(c)) for c in ("_kid_a", "_kid_b")}
    return left.withColumns({"_state": state, **kid}).select("_a", "_b", "_p", "_q", "_kid_a", "_kid_b", "_state", *values)


def subtree_totals(forest: DataFrame, node: tuple[str, str], parent: tuple[str, str], values: list[str]) -> DataFrame:
    """The node's key and, for each value, its total over the node's subtree, the node included.

    Node and parent keys are pairs of whole numbers; a root's parent is null. Values are whole numbers, a null counts 0. Every parent has a row. An empty forest gives an
    empty table.
    """
    spark = forest.sparkSession
    keys = {"_a": node[0], "_b": node[1], "_p": parent[0], "_q": parent[1]}
    none = [F.lit(None).cast("long").alias(c) for c in ("_kid_a", "_kid_b")]
    start = [*(F.col(c).cast("long").alias(n) for n, c in keys.items()), *none, F.lit(ALIVE).alias("_state"), *(F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values)]
    rows, folder, number = forest.select(*start), new_folder(spark, "rounds"), 0
    while True:
        number += 1
        seen = Observation()
        found = _round(rows.filter(F.col("_state") != RAKED), number, values)
        moving = F.count_if((F.col("_state") != RAKED) & F.col("_p").isNotNull()).alias("left")
        found.observe(seen, moving).write.parquet(f"{folder}/round={number}")
        rows = spark.read.schema(found.schema).parquet(f"{folder}/round={number}")
        if not seen.get["left"]:
            break
    # The last round leaves the roots, whose sums are whole.
    gone = spark.read.schema(found.schema).parquet(*(f"{folder}/round={k}" for k in range(1, number + 1))).filter(F.col("_state") != ALIVE)
    ended = gone.unionByName(rows.filter(F.col("_state") == ALIVE))
    return _expanded(ended.select("_a", "_b", "_kid_a", "_kid_b", *values), values).select(F.col("_a").alias(node[0]), F.col("_b").alias(node[1]), *values)


def _expanded(sums: DataFrame, values: list[str]) -> DataFrame:
    """The totals: a node with a child adds that child's total, which may wait for another's. Each step doubles the length of the ways that are done."""
    while True:
        after = sums.select(F.col("_a").alias("_kid_a"), F.col("_b").alias("_kid_b"), F.col("_kid_a").alias("_next_a"), F.col("_kid_b").alias("_next_b"), *(F.col(v).alias(f"_more_{v}") for v in values))
        waiting, done = sums.filter("_kid_a is not null"), sums.filter("_kid_a is null")
        further = waiting.join(after, ["_kid_a", "_kid_b"]).select(
            "_a", "_b", F.col("_next_a").alias("_kid_a"), F.col("_next_b").alias("_kid_b"), *((F.col(v) + F.col(f"_more_{v}")).alias(v) for v in values)
        )
        sums = kept(done.unionByName(further), "totals")
        if sums.filter("_kid_a is not null").isEmpty():
            return sums
