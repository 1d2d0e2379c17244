"""Near-duplicate documents: Jaccard join of word 5-gram sets by an LSH forest of MinHash signatures, with exact verification.

Equal texts are one class from the start. A signature has ``TREES`` sequences of labels, a byte of a minimum each. A tree of the forest is
the trie of its sequences, kept as their sorted order (a range partition of sorted rows): the texts under one node of the trie are a run of neighbours
in it that share a prefix, and two texts meet if such a run of some tree holds both.

Texts are spread over groups by their number of grams, each into its own and into the next one if a similar text can lie there, so that texts too
unlike in size never meet. A pair of similarity s meets at depth d with a chance of 1 - (1 - s**d)**TREES. The depth is the longest one, up to ``DEPTH``, at
which this is ``RECALL`` or more for a pair at the threshold, and so for every similar pair, whatever the data. Nothing is drawn or fitted.

Texts that meet, directly or by way of others, are a cluster. They are put in the order of cluster and first tree and cut into blocks of ``BLOCK`` texts or
``BLOCK_BYTES`` at most. Each text goes to its block once; there, all pairs of a cluster are verified. For a cluster of several blocks, the gram sets of each are
written to the shared folder, and pairs of blocks in which any texts met are verified from these files. What comes out is linear in the texts of a pair of blocks: how many links
each has, and enough links to join what they join. So no pair of texts is ever a row, no task holds more than two blocks, and no link is counted twice.

Limits: a cluster that is joined by chains of half-similar texts may be large; then its texts are compared with more texts than they met, but only in blocks that met.

A text of fewer than 5 words has one gram, all its words; one without words is similar to none, but equal ones are a class.

Defined results: null texts are empty; null ids are kept (a group's class_id is the least known id, or null); rows with
equal ids stay separate rows; an empty table gives no rows. Other columns are ignored. Texts are named by 64 bits of hash.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from barspark.llm.arrays import U64, Words, chunks, gram_hashes, mix, signed
from barspark.llm.frames import place
from barspark.llm.shared import kept, new_folder, row_key

GRAM, SIMILAR, TREES, DEPTH, RECALL, BLOCK = 5, 0.8, 40, 10, 0.9999, 512
#: A block of long texts holds fewer of them: about so many bytes.
BLOCK_BYTES = 1 << 24


def meeting(similar: float, trees: int, depth: int) -> float:
    """The chance that texts of a similarity share a prefix of the depth in some tree."""
    return 1 - (1 - similar**depth) ** trees


def least_depth(similar: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which even pairs at the threshold meet with the wanted chance."""
    while depth > 1 and meeting(similar, trees, depth) < recall:
        depth -= 1
    return depth


def gram_sets(raw: np.ndarray, at: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text (repeats included) and n + 1 bounds."""
    words = Words(raw, at)
    codes = words.hashes()[0]
    sizes = np.where(words.count >= n, words.count - n + 1, (words.count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = words.first[:-1][text] + np.arange(len(text)) - bounds[:-1][text]
    out = np.zeros(len(text), dtype=U64)
    for k in range(1, n + 1):
        own = words.count[text] == k if k < n else words.count[text] >= n
        if own.any():
            out[own] = gram_hashes(codes, k)[start[own]] ^ mix(np.full(1, k, dtype=U64))
    return out, bounds


def _sign(trees: int, depth: int, similar: float):
    """The labels of each text, its number of distinct grams, and the groups of sizes that it enters (small to large)."""
    k = trees * depth
    factors = (mix(np.arange(1, k + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (mix(np.arange(k + 1, 2 * k + 1, dtype=U64)) >> U64(32)).astype(np.uint32)

    def sign(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch["text"]):
                grams, bounds = gram_sets(raw, at)
                codes = (grams >> U64(32)).astype(np.uint32)
                full = np.flatnonzero(np.diff(bounds))
                labels = np.zeros((len(full), k), dtype=np.uint8)
                for j in range(k if len(full) else 0):
                    least = np.minimum.reduceat(codes * factors[j] + shifts[j], bounds[full])
                    least ^= least >> np.uint32(15)
                    labels[:, j] = least * np.uint32(0x2C1B3C6D) >> np.uint32(24)
                distinct = np.array([len(np.unique(grams[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.int64)
                size = np.maximum(distinct, 1)
                ends = np.concatenate([[0], np.cumsum(np.where(distinct > 0, k, 0))]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(labels)])
                small, large = (np.floor(np.log2(x)).astype(np.int32) for x in (size, size / similar * (1 + 1e-9)))
                columns = [batch[c].slice(lo, hi - lo) for c in ("doc_id", "row_key", "node", "size")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(small), pa.array(large), binary], names=["doc_id", "row_key", "node", "size", "small", "large", "labels"])

    return sign


_FOREST = "kind int, grp int, tree int, key binary, a long, b long, lo int, hi int, m long"
_EDGE, _DRAWN, _END = 0, 1, 2


def _shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.cumprod(a == b, axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)


def _runs(least: int, depth: int, share: float):
    """Walk along the sorted sequences of a partition.

    Rows out: for each text and each stretch lo..hi of depths with the same one, the first text of its run (_EDGE); for drawn texts a random other one of the run and how many
    there are (_DRAWN); and the first and last row of the partition (_END), from which runs go on elsewhere.
    """
    levels = range(least, depth + 1)

    def scan(batches):
        part, last, heads = TaskContext.get().partitionId(), None, None

        def rows(kind, grp, tree, key, a, b, lo, hi, m):
            n = len(a)
            full = [np.broadcast_to(np.asarray(x), n) for x in (lo, hi, m)]
            packed = np.ascontiguousarray(key).reshape(n, depth)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * depth).astype(np.int32)), pa.py_buffer(packed)])
            columns = [pa.array(np.full(n, kind), pa.int32()), pa.array(grp, pa.int32()), pa.array(tree, pa.int32()), binary, pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(full[0], pa.int32()), pa.array(full[1], pa.int32()), pa.array(full[2], pa.int64())], names=["kind", "grp", "tree", "key", "a", "b", "lo", "hi", "m"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            grp, tree, node = (batch[c].to_numpy() for c in ("grp", "tree", "node"))
            _, offsets, data = batch["key"].buffers()
            begin = int(np.frombuffer(offsets, dtype=np.int32)[batch["key"].offset])
            key = np.frombuffer(data, dtype=np.uint8)[begin : begin + n * depth].reshape(n, depth)
            met = np.zeros(n, dtype=np.int64)
            met[1:] = np.where((grp[1:] == grp[:-1]) & (tree[1:] == tree[:-1]), _shared_prefix(key[1:], key[:-1]), 0)
            if last is None:
                yield rows(_END, grp[:1], tree[:1], key[:1], node[:1], node[:1], part, 0, 0)
            elif last[0] == grp[0] and last[1] == tree[0]:
                met[0] = _shared_prefix(key[:1], last[2])[0]
            at, firsts = np.arange(n), []
            for k, d in enumerate(levels):
                begins = np.maximum.accumulate(np.where(met < d, at, -1))
                firsts.append(np.where(begins >= 0, node[np.maximum(begins, 0)], heads[k] if heads else 0))
                if d == least and share > 0:  # draw other texts of the runs of the shortest prefix
                    starts = np.maximum(begins, 0)
                    new = np.append(np.flatnonzero(starts[1:] != starts[:-1]) + 1, n)
                    ends = new[np.searchsorted(new, at, side="right")]
                    drawn = np.flatnonzero((mix(node.view(U64)) < U64(min(1.0, share) * (2.0**64 - 4096))) & (ends - starts > 1))
                    if len(drawn):
                        size = ends[drawn] - starts[drawn]
                        step = (mix(node[drawn].view(U64) + tree[drawn].astype(U64) * U64(0x9E3779B97F4A7C15)) % (size - 1).astype(U64)).astype(np.int64) + 1
                        other = starts[drawn] + (drawn - starts[drawn] + step) % size
                        yield rows(_DRAWN, grp[drawn], tree[drawn], key[drawn], node[drawn], node[other], 0, 0, size - 1)
            upto = np.full(n, depth)
            for k in range(len(firsts) - 1, -1, -1):
                ends_here = np.ones(n, dtype=bool) if k == 0 else firsts[k] != firsts[k - 1]
                own = np.flatnonzero(ends_here & (firsts[k] != node))
                if len(own):
                    yield rows(_EDGE, grp[own], tree[own], key[own], firsts[k][own], node[own], levels[k], upto[own], 0)
                upto = np.where(ends_here, levels[k] - 1, upto)
            heads = [int(x[-1]) for x in firsts]
            last = (grp[-1], tree[-1], key[-1:].copy(), node[-1:].copy(), grp[-1:].copy(), tree[-1:].copy())
        if last is not None:
            yield rows(_END, last[4], last[5], last[2], last[3], last[3], part, 1, 0)

    return scan


def _ends_met(forest: DataFrame, least: int) -> DataFrame:
    """Edges between the last row of a partition and the first of the next one. There are two rows for each partition."""
    ends = sorted(forest.filter(F.col("kind") == _END).collect(), key=lambda r: (r.lo, r.hi))
    rows = []
    for x, y in zip(ends[1::2], ends[2::2]):
        if (x.grp, x.tree) == (y.grp, y.tree):
            met = int(_shared_prefix(*(np.frombuffer(bytes(r.key), dtype=np.uint8)[None] for r in (x, y)))[0])
            if met >= least:
                rows.append((_EDGE, y.grp, y.tree, y.key, x.a, y.a, least, met, 0))
    return forest.sparkSession.createDataFrame(rows, _FOREST)


def _similarities(batches):
    for pdf in batches:
        found = []
        for pair in zip(pdf["text_a"], pdf["text_b"]):
            a, b = (np.unique(gram_sets(*_joined([t]))[0]) for t in pair)
            both = len(np.intersect1d(a, b, assume_unique=True))
            found.append(both / max(1, len(a) + len(b) - both))
        yield pd.DataFrame({"grp": pdf["grp"], "weight": pdf["weight"], "similarity": found})


def fit_depths(forest: DataFrame, texts: DataFrame, similar: float, trees: int, least: int, depth: int, recall: float) -> list[int]:
    """The depth of each group: of the longest prefixes at which the similar pairs of the sample meet with the wanted recall.

    For studies of a corpus only: ``near_duplicates`` takes ``least_depth``, which needs no sample.
    """
    drawn = forest.filter(F.col("kind") == _DRAWN)
    # One tree of each drawn text, by hash. Its weight makes up for the trees and texts that were not chosen.
    pairs = drawn.groupBy("grp", "a").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("a", "tree").alias("h"), "b", "m")).alias("x"))
    pairs = pairs.select("grp", "a", "x.b", (F.col("n") * F.col("x.m")).cast("double").alias("weight"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()  # at most two for each sampled text and group
    sample = kept(texts.join(F.broadcast(nodes), "node").dropDuplicates(["node"]), "sample")
    beside = pairs.join(sample.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(sample.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    exact = beside.mapInPandas(_similarities, "grp int, weight double, similarity double").filter(F.col("similarity") >= similar)
    # A pair of similarity s is drawn in proportion to the trees in which it meets.
    weight = F.col("weight") / (trees * F.pow("similarity", F.lit(least)))
    found = exact.groupBy("grp", F.floor(F.col("similarity") * 200).alias("bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n")).collect()
    depths = []
    for g in range(64):
        own = [r for r in found if r.grp == g]
        total, n = sum(r.weight for r in own) or 1.0, sum(r.n for r in own) or 1
        own = [(max(similar, r.bin / 200), r.weight) for r in own] + [(similar, total / n)]
        d = depth
        while d > least and sum(w * meeting(s, trees, d) for s, w in own) < recall * sum(w for _, w in own):
            d -= 1
        depths.append(d)
    return depths


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of the left has in common with each of the right."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = [np.concatenate(x) if x else np.zeros(0, dtype=U64) for x in (left, right)]
    if left is right:
        grams, times = np.unique(sides[0], return_counts=True)
        grams = grams[times > 1]
    else:
        grams = np.intersect1d(*sides)
    if not len(grams):
        return out
    placed = []
    for flat, sets in zip(sides, (left, right)):
        at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
        hit = grams[at] == flat
        code, owner = at[hit], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit]
        order = np.argsort(code, kind="stable")
        placed.append((code[order], owner[order], len(sets)))
    for lo in range(0, len(grams), 4096):
        parts = []
        for code, owner, n in placed:
            a, b = np.searchsorted(code, [lo, lo + 4096])
            part = np.zeros((n, 4096), dtype=np.float32)
            part[owner[a:b], code[a:b] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def _alike(left: list[np.ndarray], right: list[np.ndarray], similar: float) -> np.ndarray:
    both = shared_counts(left, right)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    return (both > 0) & (both >= similar * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6)


def _heads(linked: np.ndarray) -> np.ndarray:
    """For each row the first row of its group of links."""
    head = np.arange(len(linked))
    open_ = set(np.flatnonzero(linked.any(axis=1)).tolist())
    for first in sorted(open_):
        reached = [first] if first in open_ else []
        open_.discard(first)
        while reached:
            for to in np.flatnonzero(linked[reached.pop()]).tolist():
                if to in open_:
                    open_.discard(to)
                    head[to] = first
                    reached.append(to)
    return head


_LINKS = "cluster long, block long, a long, b long, n long, path string"


def _rows(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in _LINKS.split(", ")]
    return pd.DataFrame({c: pd.array([r[k] for r in rows], dtype="string" if c == "path" else "Int64") for k, c in enumerate(names)})


def _own_links(similar: float, folder: str):
    """The links inside a block; the gram sets of clusters that go on in other blocks are written to the folder."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for cluster, own in pdf.groupby("cluster"):
            own = own.drop_duplicates("node")
            nodes, block = own["node"].to_numpy(), int(own["block"].iat[0])
            grams, bounds = gram_sets(*_joined(own["text"].tolist()))
            sets = [np.unique(grams[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
            linked = _alike(sets, sets, similar)
            np.fill_diagonal(linked, False)
            head = _heads(linked)
            rows += [(cluster, block, int(n), None, int(k), None) for n, k in zip(nodes, linked.sum(axis=1)) if k]
            rows += [(cluster, block, int(nodes[x]), int(n), 0, None) for n, x in zip(nodes, head) if nodes[x] != n]
            if own["wide"].iat[0]:
                out = io.BytesIO()
                np.savez(out, nodes=nodes, heads=nodes[head], grams=np.concatenate(sets), sizes=np.array([len(x) for x in sets]))
                fs, path = place(folder)
                fs.create_dir(path, recursive=True)
                name = f"{block}-{uuid.uuid4().hex}.npz"
                with fs.open_output_stream(f"{path}/{name}") as f:
                    f.write(out.getbuffer())
                rows.append((cluster, block, None, None, 0, f"{folder}/{name}"))
        return _rows(rows)

    return links


def _load(uri: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    fs, path = place(uri)
    with fs.open_input_file(path) as f:
        data = np.load(io.BytesIO(f.read()))
    return data["nodes"], data["heads"], np.split(data["grams"], np.cumsum(data["sizes"])[:-1])


def _cross_links(similar: float):
    """The links between two blocks of a cluster, read from their files."""

    def links(batches):
        name, left = None, None
        for pdf in batches:
            for cluster, lo, hi in zip(pdf["cluster"], pdf["lo_path"], pdf["hi_path"]):
                if name != lo:
                    name, left = lo, _load(lo)
                right = _load(hi)
                linked = _alike(left[2], right[2], similar)
                rows = [(cluster, None, int(n), None, int(k), None) for nodes, count in ((left[0], linked.sum(axis=1)), (right[0], linked.sum(axis=0))) for n, k in zip(nodes, count) if k]
                x, y = np.nonzero(linked)
                rows += [(cluster, None, a, b, 0, None) for a, b in set(zip(left[1][x].tolist(), right[1][y].tolist()))]
                if rows:
                    yield _rows(rows)

    return links


def _counted(batches):
    """The texts and bytes before each row of a partition."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch["size"].to_numpy()
        before = size + np.cumsum(sizes) - sizes
        n = batch.num_rows
        columns = [*(batch[c] for c in ("cluster", "node", "row_key")), pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(rows, rows + n), pa.int64()), pa.array(before, pa.int64()), batch["size"]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "node", "row_key", "part", "row", "byte", "size"])
        rows, size = rows + n, size + int(sizes.sum())


def _seats(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """cluster, node, row_key, block: the texts in the order of cluster and first tree, cut wherever ``block`` texts or ``block_bytes`` are reached. Two sums for each range come to the driver."""
    order = ["cluster", "first", "node"]
    rows = members.repartitionByRange(*order).sortWithinPartitions(*order).select("cluster", "node", "row_key", "size")
    rows = kept(rows.mapInArrow(_counted, "cluster long, node long, row_key long, part int, row long, byte long, size long"), "seats")
    n = size = 0
    starts = []
    for r in sorted(rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect(), key=lambda r: r.part):
        starts.append((r.part, n, size))
        n, size = n + r.n, size + r["size"]
    starts = members.sparkSession.createDataFrame(starts, "part int, rows_before long, bytes_before long")
    number = F.floor((F.col("rows_before") + F.col("row")) / block) + F.floor((F.col("bytes_before") + F.col("byte")) / block_bytes)
    return rows.join(F.broadcast(starts), "part").select("cluster", "node", "row_key", number.cast("long").alias("block"))


def components(edges: DataFrame) -> DataFrame:
    """node, cluster (the least node of its component; no row for that one) by alternating large and small stars; every round is written to the shared folder."""
    edges, now = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before, own = None, Window.partitionBy("u")
    while now != before and now[0]:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sides.withColumn("m", F.least("u", F.min("v").over(own))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(own)).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before = now
        edges, now = _written(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("cluster"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells whether they changed: their number and the sum of their hashes, counted while they are written."""
    seen = Observation()
    table = kept(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")), "edges")
    found = seen.get
    return table, (found["n"], found["h"])


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """row_key, doc_id, group, class_id (least doc_id of its group), text_id (least doc_id of its text), n_links (other texts that its text is similar to)."""
    spark, depth = docs.sparkSession, least_depth(similar, trees, depth, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", row_key().alias("row_key"), F.xxhash64("text").alias("node"), F.octet_length("text").cast("long").alias("size"))
    placed = kept(rows.mapInArrow(_sign(trees, depth, similar), "doc_id long, row_key long, node long, size long, small int, large int, labels binary"), "signatures")
    classes = placed.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.min("row_key").alias("row_key"), F.max("size").alias("size"), F.max("small").alias("small"), F.max("large").alias("large"), F.max("labels").alias("labels"))
    classes = kept(classes, "classes")

    entered = classes.filter("length(labels) > 0").select("node", F.explode(F.sequence("small", "large")).alias("grp"), "labels")
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring("labels", t * depth + 1, F.lit(depth)))
    sequences = entered.select("grp", "node", F.posexplode(cut).alias("tree", "key"))
    order = ["grp", "tree", "key", "node"]
    forest = sequences.repartitionByRange(*order).sortWithinPartitions(*order)
    forest = kept(forest.mapInArrow(_runs(depth, depth, 0), _FOREST), "forest")
    edges = forest.filter(F.col("kind") == _EDGE).unionByName(_ends_met(forest, depth))

    clusters = components(edges.select("a", "b"))
    heads = clusters.select(F.col("cluster").alias("node"), "cluster").distinct()
    first = F.substring("labels", 1, depth).alias("first")
    members = kept(clusters.unionByName(heads).join(classes.select("node", "row_key", "size", first), "node"), "members")
    seats = _seats(members, block, BLOCK_BYTES)
    wide = kept(seats.groupBy("cluster").agg((F.min("block") != F.max("block")).alias("wide")).filter("wide"), "wide")
    seated = seats.join(wide.hint("merge"), "cluster", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))

    # The clusters grow with the corpus, so they are always joined by shuffle, and the plan is the same at every size.
    texts = rows.select("row_key", "text").join(seated.hint("merge"), "row_key")
    own = texts.select("cluster", "block", "node", "text", "wide").groupBy("block").applyInPandas(_own_links(similar, new_folder(spark, "gram-sets")), _LINKS)
    own = kept(own, "links")

    # Blocks of one cluster that hold texts of one run.
    seated = seated.filter("wide").select("cluster", "node", "block")
    in_run = edges.select("grp", "tree", F.col("key").alias("run"), F.explode(F.array("a", "b")).alias("node"))
    runs = in_run.join(seated, "node").select("grp", "tree", "run", "cluster", "block").distinct()
    runs = runs.groupBy("grp", "tree", "run", "cluster").agg(F.array_sort(F.collect_list("block")).alias("blocks")).filter(F.size("blocks") > 1)
    later = F.transform("blocks", lambda x: F.struct(x.alias("lo"), F.filter("blocks", lambda y: y > x).alias("his")))
    pairs = runs.select("cluster", F.explode(later).alias("p")).select("cluster", F.col("p.lo").alias("lo"), F.explode("p.his").alias("hi")).distinct()
    files = own.filter("path is not null").select("cluster", "block", "path")
    pairs = pairs.join(files.select("cluster", F.col("block").alias("lo"), F.col("path").alias("lo_path")), ["cluster", "lo"])
    pairs = kept(pairs.join(files.select("cluster", F.col("block").alias("hi"), F.col("path").alias("hi_path")), ["cluster", "hi"]), "block-pairs")
    tasks = min(10_000, max(1, pairs.count()))  # the rows are light and the work of each is not
    cross = kept(pairs.repartition(tasks, "lo_path", "hi_path").sortWithinPartitions("lo_path").mapInPandas(_cross_links(similar), _LINKS), "cross-links")

    found = own.unionByName(cross)
    counted = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = classes.join(components(found.filter("b is not null").select("a", "b")), "node", "left").join(counted, "node", "left")
    named = named.select("node", "text_id", F.coalesce("cluster", "node").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = named.groupBy("group").agg(F.min("text_id").alias("class_id"))
    named = named.join(first, "group")
    return placed.select("row_key", "doc_id", "node").join(named, "node").select("row_key", "doc_id", "group", "class_id", "text_id", "n_links")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (the least row key, where no id is known); of rows that repeat it, one."""
    found = near_duplicates(docs)
    keep = found.groupBy("group").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("class_id")), F.col("row_key"))).alias("_key")).select("_key")
    return docs.withColumn("_key", row_key()).join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
