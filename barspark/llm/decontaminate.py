"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Tokens are runs of letters and digits, lower-cased. A seed is the hash of the tokens that a fixed mask keeps; it ignores the
positions between. ``MASKS`` are such that every window of 13 tokens with at most two substituted ones holds a seed of one of
them, wherever the two are. Seeds of documents and items are joined, and around each hit the windows of 13 tokens that hold
the seed are compared: a leak is a window of 13 tokens inside both, of which at least 11 are the same.

What the windows around a place can come to depends on its seed and the few tokens beside it only (its context). Contexts
that a document or the benchmark has more than once are compared once, so a text of a million equal tokens, or of a short
phrase over and over, costs little more than its tokens. Long texts are cut into segments before contexts are taken.

Defined results: null texts have no tokens; items and documents of fewer than 13 tokens are never reported (too little to tell);
rows that are equal in id and text are reported once; a null doc_id is reported as null; empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.shared import kept, row_key

WINDOW, SAME = 13, 11
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
TOKEN = r"[\p{L}\p{N}]+"
#: A window that holds a seed of the shorter mask begins at most so many tokens before it.
BEFORE = WINDOW - min(m[-1] + 1 for m in MASKS)
CONTEXT = BEFORE + WINDOW
#: Tokens of a segment of a text.
SEGMENT = 4096
#: Contexts of the benchmark, of some 200 bytes each, that are broadcast (some 50 MB); more are joined by shuffle, each in SALTS copies, among which the documents' rows are dealt.
MOST_BROADCAST, SALTS = 250_000, 16


def token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def seeds_of(rows: DataFrame, *columns: str) -> DataFrame:
    """A row (columns, place, seed) for each mask and place of rows (columns, hashes)."""
    n = F.size("hashes")

    def places(mask: tuple[int, ...]) -> Column:
        last = n - mask[-1] - 1
        at = F.sequence(F.lit(0), last)
        return F.when(last >= 0, F.transform(at, lambda i: F.xxhash64(*(F.get("hashes", i + o) for o in mask), F.lit(mask[-1])))).otherwise(F.array().cast("array<long>"))

    lists = rows.filter(n >= WINDOW).select(*columns, *(places(m).alias(f"seeds_{k}") for k, m in enumerate(MASKS)))
    first = F.size("seeds_0")
    each = lists.select(*columns, first.alias("first"), F.posexplode(F.concat(*(f"seeds_{k}" for k in range(len(MASKS))))).alias("at", "seed"))
    return each.select(*columns, F.when(F.col("at") < F.col("first"), F.col("at")).otherwise(F.col("at") - F.col("first")).alias("place"), "seed")


def contexts_of(hits: DataFrame, *columns: str) -> DataFrame:
    """The distinct (columns, seed, context) of rows (columns, hashes, hits: array of place and seed). A context is the tokens from BEFORE places before the seed on; null outside of the text."""
    around = lambda hit: F.transform(F.sequence(F.lit(-BEFORE), F.lit(WINDOW - 1)), lambda o: F.get("hashes", hit["place"] + o))
    each = F.explode(F.transform("hits", lambda hit: F.struct(hit["seed"].alias("seed"), around(hit).alias("context"))))
    return hits.select(*columns, each.alias("hit")).select(*columns, "hit.seed", "hit.context").distinct()


def item_contexts(items: DataFrame) -> DataFrame:
    """The distinct (item_id, seed, item_context) of items (item_id, hashes)."""
    keyed = items.withColumn("item_key", F.xxhash64("item_id", "hashes"))
    hits = seeds_of(keyed, "item_key").groupBy("item_key").agg(F.collect_list(F.struct("place", "seed")).alias("hits"))
    return contexts_of(keyed.join(hits, "item_key"), "item_id").withColumnRenamed("context", "item_context")


def best_window(mine: Column, other: Column) -> Column:
    """The most equal tokens of a window of two contexts that lies inside both texts; less than 0 if none does."""
    same = [F.coalesce((F.get(mine, F.lit(i)) == F.get(other, F.lit(i))).cast("int"), F.lit(-WINDOW)) for i in range(CONTEXT)]
    return F.greatest(*(sum(same[s + 1 : s + WINDOW], same[s]) for s in range(BEFORE + 1)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_key, doc_id, item_id, same (tokens of the best window) of each document that holds a window of an item."""
    rows = docs.select("doc_id", "text", row_key().alias("row_key"))
    items = benchmark.select("item_id", token_hashes(F.col("text")).alias("hashes")).filter(F.size("hashes") >= WINDOW).dropDuplicates()
    contexts = kept(item_contexts(kept(items, "items")), "contexts")
    small = contexts.count() <= MOST_BROADCAST
    wanted = contexts.select("seed").distinct()
    found = seeds_of(rows.select("row_key", token_hashes(F.col("text")).alias("hashes")), "row_key")
    found = found.join(F.broadcast(wanted) if small else wanted, "seed", "left_semi")

    # The places of a document, in a list for each segment, go to its text. The lists grow with the corpus, so they are always joined by shuffle, and the plan is the same at every size.
    segment = F.floor(F.col("place") / SEGMENT)
    lists = found.groupBy("row_key", segment.alias("segment")).agg(F.collect_list(F.struct((F.col("place") % SEGMENT + BEFORE).cast("int").alias("place"), "seed")).alias("hits"))
    asked = kept(lists.groupBy("row_key").agg(F.collect_list(F.struct("segment", "hits")).alias("segments")), "asked")
    beside = rows.join(asked.hint("merge"), "row_key").select("row_key", "doc_id", "segments", token_hashes(F.col("text")).alias("hashes"))
    # BEFORE nulls stand before a text, so that a segment's tokens begin BEFORE places before its first one.
    padded = beside.withColumn("hashes", F.concat(F.array_repeat(F.lit(None).cast("long"), BEFORE), "hashes"))
    part = lambda s: F.slice("hashes", (s["segment"] * SEGMENT + 1).cast("int"), F.lit(SEGMENT + CONTEXT))
    cut = padded.select("row_key", "doc_id", F.explode(F.transform("segments", lambda s: F.struct(s["hits"].alias("hits"), part(s).alias("hashes")))).alias("segment"))
    mine = contexts_of(cut.select("row_key", "doc_id", "segment.hits", "segment.hashes"), "row_key", "doc_id")

    if small:
        pairs = mine.join(F.broadcast(contexts), "seed")
    else:
        salted = contexts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = mine.withColumn("_salt", F.pmod(F.xxhash64("row_key", "context"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "_salt"])
    scored = pairs.withColumn("same", best_window(F.col("context"), F.col("item_context"))).filter(F.col("same") >= SAME)
    return scored.groupBy("row_key", "doc_id", "item_id").agg(F.max("same").cast("long").alias("same"))


def remove_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    bad = find_leaks(docs, benchmark).select(F.col("row_key").alias("_leaked")).distinct()
    return docs.join(bad, row_key() == F.col("_leaked"), "left_anti")
