"""Removal of word windows that occur more than once in the corpus, by seed and extend.

Seeds are winnowed anchors: of the word grams inside a window of ``length`` words, the one with the least hash. Equal windows choose
the same gram, so a window can only repeat where its anchor repeats. Each occurrence of an anchor stands for the run of
windows that chose it. Occurrences are joined on their anchors; those whose anchor is alone are done. The match is then
extended both ways for all occurrences of an anchor at once instead of pair by pair: occurrences with the same whole
run of words match over its whole extent; of the others, one of each distinct run is opened into its windows, and equal
windows are counted. The union of the repeated windows of a document gives its maximal repeats. The work follows the words, not the pairs.

Windows are compared by 128 bits: the anchor's hash comes from one hash of each word, the window's from another that is independent of it.

Defined results: a null or blank text has no words and keeps the empty string; texts of fewer than ``length`` words keep all;
rows that are equal in id and text repeat each other; null ids are kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.arrays import U64, Words, chunks, covered, gram_hashes, gram_starts, mix, signed
from barspark.llm.shared import join_frequent, kept, row_key

LENGTH, ANCHOR = 35, 8
#: Of a 64-bit order, the low bits hold the place: of equal hashes the last one wins.
_PLACE = 28


def runs_of_anchors(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash, hash of all words of the run) for each anchor occurrence."""
    at = gram_starts(words, length)
    if not len(at):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty.astype(U64), empty.astype(U64)
    codes, others = words.hashes()
    n, width = len(words.start), length - anchor + 1
    grams = np.arange(n - anchor + 1)
    hashes, windows = gram_hashes(codes, anchor), gram_hashes(others, length)
    order = hashes >> U64(_PLACE) << U64(_PLACE) | (U64((1 << _PLACE) - 1) - (grams.astype(U64) & U64((1 << _PLACE) - 1)))
    least, reach = order, 1
    while reach * 2 <= width:  # the least of 1, 2, 4, ... grams
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: n - anchor + 1 - (width - 1)], least[width - reach :])
    chosen = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    opens = np.flatnonzero(new)
    size = np.diff(np.append(opens, len(at)))
    first = at[opens]
    base = first & ~((1 << _PLACE) - 1)
    place = (1 << _PLACE) - 1 - (chosen[opens] & U64((1 << _PLACE) - 1)).astype(np.int64) + base
    place = np.where(place < first, place + (1 << _PLACE), place)
    # The first and the last window of a run cover all its words, for there are not more windows in it than words in a window.
    return first, size, hashes[place], mix((windows[first] ^ size.astype(U64)) * U64(0xD6E8FEB86659FD93) + windows[first + size - 1])


def _occurrences(length: int, anchor: int):
    def find(batches):
        for batch in batches:
            keys = batch["row_key"].to_numpy()
            for lo, _, raw, at in chunks(batch["text"]):
                words = Words(raw, at)
                first, size, seeds, run = runs_of_anchors(words, length, anchor)
                text = np.searchsorted(words.first, first, side="right") - 1
                span = (first - words.first[text]) << 8 | size  # at most length - anchor + 1 windows
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + text]), pa.array(span), pa.array(signed(seeds)), pa.array(signed(run))], names=["row_key", "span", "anchor", "run"])

    return find


def _open_windows(length: int):
    """Of chosen runs of a document, a row for each window."""

    def find(batches):
        for batch in batches:
            lists = batch["runs"]
            for lo, hi, raw, at in chunks(batch["text"]):
                words = Words(raw, at)
                windows = gram_hashes(words.hashes()[1], length)
                part = lists.slice(lo, hi - lo)
                each = part.flatten()
                text = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                span, seeds, run = (each.field(c).to_numpy() for c in ("span", "anchor", "run"))
                first, size = words.first[text] + (span >> 8), span & 255
                which = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                window = windows[first[which] + place]
                yield pa.RecordBatch.from_arrays([pa.array(seeds[which]), pa.array(run[which]), pa.array(place.astype(np.int64)), pa.array(signed(window))], names=["anchor", "run", "place", "window"])

    return find


def repeated_runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """row_key, span (first window << 8 | number of windows) and mask (bit j: window j is repeated) wherever a document has a repeated window."""
    rows = docs.select("row_key", "text")
    found = kept(rows.mapInArrow(_occurrences(length, anchor), "row_key long, span long, anchor long, run long"), "anchors")
    seeds = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("least"), F.max("run").alias("most")).filter("n > 1")
    seeds = kept(seeds.select("anchor", "n", (F.col("least") == F.col("most")).alias("alike")), "seeds")
    shared = kept(join_frequent(found, seeds.select("anchor", "alike"), ["anchor"], seeds.select("anchor", "n"), "inner"), "shared-anchors")

    unlike = shared.filter(~F.col("alike"))
    runs = unlike.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.first("row_key").alias("row_key"), F.first("span").alias("span"))
    runs = kept(runs, "runs")
    opened = runs.groupBy("row_key").agg(F.collect_list(F.struct("span", "anchor", "run")).alias("runs"))
    windows = kept(opened.join(rows, "row_key").select("text", "runs").mapInArrow(_open_windows(length), "anchor long, run long, place long, window long").distinct(), "windows")
    twice = kept(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-windows")
    masks = join_frequent(windows, twice.drop("n"), ["anchor", "window"], twice, "inner").groupBy("anchor", "run").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))
    marks = masks.unionByName(runs.filter("n > 1").select("anchor", "run", F.lit(-1).cast("long").alias("mask")))
    marks = kept(marks.groupBy("anchor", "run").agg(F.bit_or("mask").alias("mask")), "marks")
    alike = shared.filter("alike").select("row_key", "span", F.lit(-1).cast("long").alias("mask"))
    return join_frequent(unlike, marks, ["anchor", "run"], runs.select("anchor", "run", "n"), "inner").select("row_key", "span", "mask").unionByName(alike)


def _cut(length: int):
    def cut(batches):
        for batch in batches:
            ids, lists = batch["doc_id"], batch["runs"]
            for lo, hi, raw, at in chunks(batch["text"]):
                words = Words(raw, at)
                part = lists.slice(lo, hi - lo)
                each = part.flatten()
                text = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths().fill_null(0)))
                span, mask = each.field("span").to_numpy(), each.field("mask").to_numpy()
                first, size = words.first[text] + (span >> 8), span & 255
                which = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                starts = (first[which] + place)[(mask[which] >> place & 1) == 1]
                gone = covered(starts, starts + length, len(words.start))
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[words.first[1:]] - sums[words.first[:-1]]
                data, out = raw.tobytes(), []
                for i in range(hi - lo):
                    own = data[at[i] : at[i + 1]].split()
                    if removed[i]:
                        own = compress(own, (~gone[words.first[i] : words.first[i + 1]]).tolist())
                    out.append(b" ".join(own).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words, joined by one space) of every row of docs (doc_id, text)."""
    if not 0 < anchor <= length or length - anchor + 1 > 62:
        raise ValueError("a window must hold its anchor, and at most 62 of them")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", row_key().alias("row_key"))
    runs = repeated_runs(keyed.select("row_key", "text"), length, anchor).distinct()
    runs = runs.groupBy("row_key").agg(F.collect_list(F.struct("span", "mask")).alias("runs"))
    return keyed.join(runs, "row_key", "left").select("doc_id", "text", "runs").mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept_docs: DataFrame) -> DataFrame:
    return kept_docs.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text, for tests on small fixtures."""
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out
