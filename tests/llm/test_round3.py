"""Fill-in-the-middle, the prefix trie and byte-level BPE against plain loops and the library, and training and seeds on hard inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from barspark.llm import byte_bpe, contraction, decontaminate, fill_middle, language, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, place string, piece string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows_of(texts) -> list[tuple]:
    return [(i, t, "en", "s", None, "clash", k, "clash", "clash") for k, (i, t) in enumerate(texts)]


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb\nc\nd"), (7, "a\nb\nc\nd\n"), (8, "has <P> in it\n"), (9, "<S>"), (10, "x<M"), (11, "é\nß\n字\U0001f642\n" * 50), (None, "without id\nand lines\n"),
    (None, None), (12, "twice\nthe same\n"), (12, "twice\nthe same\n"), (12, "the same id\nwith another text"), (13, "y" * 200_000 + "\n" + "z" * 70_000), (14, "".join(f"line {i}\r\n" for i in range(30_000))), (-5, "negative\nid\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    x = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_fill_in_middle_by_hand(odd, empty):
    got = fill_middle.fill_in_middle(odd)
    assert key(got.collect()) == key(fim_by_hand(i, t)[0] for i, t in ODD)
    assert fill_middle.fill_in_middle(empty).columns == got.columns and fill_middle.fill_in_middle(empty).count() == 0


def test_fill_in_middle_texts_and_small_pieces(odd, monkeypatch):
    texts = fill_middle.output_texts(fill_middle.assemble(fill_middle.make_pieces(odd)))
    assert key(r.text for r in texts.collect()) == key(fim_by_hand(i, t)[1] for i, t in ODD)
    assert list(fill_middle._in_pieces(b"ab\ncd\n")) == [b"ab\ncd\n"]
    monkeypatch.setattr(fill_middle, "PIECE_BYTES", 4)
    assert list(fill_middle._in_pieces(b"ab\ncdefghi\nj")) == [b"ab\n", b"cdef", b"ghi\n", b"j"]


def test_fill_in_middle_sorts_again_without_a_shuffle(odd):
    plan = fill_middle.fill_in_middle(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort") == 2


def test_fill_in_middle_shares(spark):
    docs = spark.createDataFrame(rows_of((i, "a\nb\n") for i in range(400)), DOCS)
    forms = [r.form for r in fill_middle.fill_in_middle(docs, fim_percent=50, spm_percent=0).collect()]
    assert set(forms) == {"plain", "psm"} and 150 < forms.count("plain") < 250


# Byte-level BPE


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(rng, tokens, n):
    marks = ["a", "e", "th", "  ", "\n", "é", "日本", "1", "'s", "!", "<|endoftext|>", "\x85", "　", "🙂", "ab" * 20, " \n "]
    picked = marks + rng.sample(tokens, 300)
    words = ["".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).replace(" ", "") for _ in range(n)]
    return words + ["".join(rng.choice(picked) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library():
    encoder, reference, rng = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN), library(RANKS), random.Random(3)
    tokens = [t.decode("utf8", "ignore") for t in encoder.ranks.rank]
    texts = [*random_texts(rng, tokens, 5000), "", "a" * 100_000, "ab" * 20_000, "." * 30_000, "".join(rng.choice("aeint") for _ in range(50_000)), "x " * 600_000]
    got = encoder.encode([encoder.words(t) for t in texts])
    assert all(g.tolist() == reference.encode_ordinary(t) for t, g in zip(texts, got))


def test_bpe_where_a_merge_makes_a_pair_of_a_lower_rank(tmp_path):
    """Random ranks over three letters, in which such pairs are common, unlike in trained ones."""
    rng = random.Random(5)
    for trial in range(60):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 300:
            new = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6)))
            tokens += [] if new in tokens else [new]
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for r, t in enumerate(tokens)))
        encoder, reference = byte_bpe.Encoder(str(path), public_tokenizers.PATTERN), library(path)
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice((5, 30, 300)))) for _ in range(40)]
        assert all(g.tolist() == reference.encode_ordinary(t) for t, g in zip(texts, encoder.encode([encoder.words(t) for t in texts])))


@pytest.mark.parametrize("blocks", [None, (50, 3, 10)])
def test_bpe_of_documents(odd, empty, sf, spark, monkeypatch, blocks):
    """Also with tiny blocks, and workers that forget their words after each."""
    if blocks:
        for name, value in zip(("BLOCK_CHARS", "BLOCK_WORDS", "REMEMBERED"), blocks):
            monkeypatch.setattr(byte_bpe, name, value)
    reference = library(RANKS)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in [t or "" for _, t in ODD]:
        assert encoder.encode([encoder.words(text)])[0].tolist() == reference.encode_ordinary(text)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS))

    def by_hand(i, text):
        ids = reference.encode_ordinary(text or "")
        return (i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(text or ""))

    assert key(got.collect()) == key(by_hand(*r) for r in docs.collect())
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


# Prefix trie


def trie_by_hand(turns):
    own: dict = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:]
    members: dict = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    leaves, saved, kids = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + own_saved
        if node:
            up = node[:-1]
            leaves[up], saved[up], kids[up] = leaves.get(up, 0) + leaves[node], saved.get(up, 0) + saved[node], kids.get(up, 0) + 1
    ends = {node: sorted(c for c in cs if len(built[c]) == len(node)) for node, cs in members.items()}
    return key(
        (min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids.get(node, 0), leaves[node], saved[node], sha(",".join(map(str, ends[node]))))
        for node, cs in members.items()
    )


TURNS = "conv_id long, turn long, role string, text string, depth string, nth long, x1 string, _range int, n_convs string"


def turn_rows(turns):
    return [(*t, "clash", 7, "clash", 3, "clash") for t in turns]


def random_turns(rng, convs, longest):
    """Conversations of few texts, so that many share their beginnings; some turns are null, some rows lack an id."""
    turns = []
    for c in convs:
        n = rng.choice((1, 2, 3, 5, 8, longest))
        own = [(c, None if k == 0 and rng.random() < 0.2 else k, rng.choice(("user", None)) if k % 2 else "system", rng.choice(("", None, "hi", "é字", "go on")) if k % 3 else "same") for k in range(n)]
        turns += own
    turns += [(None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(turns)
    return turns


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_hand(spark, seed):
    rng = random.Random(seed)
    turns = random_turns(rng, [*range(60), 100, 101, 107, 199, 205, 399, -3, -250, 10**12], 30)
    got = prefix_trie.conversation_trie(spark.createDataFrame(turn_rows(turns), TURNS))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert key(got.collect()) == trie_by_hand(turns)


def test_trie_of_one_long_conversation_and_of_equal_ones(spark):
    """A conversation that fills several ranges, many conversations that are equal, and no conversation at all."""
    turns = [(3, k, "user", f"t{k % 7}") for k in range(3000)] + [(c, k, "user", "all the same") for c in range(100, 400) for k in range(6)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(turn_rows(turns), TURNS).repartition(5))
    assert key(got.collect()) == trie_by_hand(turns)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_scan_carries_over_ranges(spark):
    """With many ranges, keys of all sizes are cut by them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k % 3 if k < 900 else k, k, k * 7919 % 1009) for k in range(1000)]
        got = prefix_trie.scan(spark.createDataFrame(rows, "k long, o long, x long"), "k", [prefix_trie.F.col("o")], ("x",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, state = {}, {}
    for k, o, x in sorted(rows):
        n, y = state.get(k, (0, 0))
        state[k] = want[k, o] = (n + 1, y ^ x)
    assert {(r.k, r.o): (r.nth, r.x) for r in got} == want


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random", "forest", "empty"])
def test_contraction(spark, shape):
    rng = random.Random(11)
    n = 0 if shape == "empty" else 700
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0), "random": lambda i: rng.randrange(i), "forest": lambda i: rng.randrange(i) if i % 50 else None, "empty": None}[shape]
    parent = {i: None if i == 0 else up(i) for i in range(n)}
    value = {i: rng.randint(-5, 9) for i in range(n)}
    rows = [(i, i % 7, p, None if p is None else p % 7, value[i], None if i % 2 else 1) for i, p in parent.items()]
    rng.shuffle(rows)
    found = contraction.subtree_totals(spark.createDataFrame(rows, "a long, b long, p long, q long, v long, w long"), ("a", "b"), ("p", "q"), ["v", "w"]).collect()
    total, odd_ones = dict(value), {i: int(i % 2 == 0) for i in range(n)}
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
            odd_ones[parent[i]] += odd_ones[i]
    assert {(r.a, r.b): (r.v, r.w) for r in found} == {(i, i % 7): (total[i], odd_ones[i]) for i in range(n)} and len(found) == n


# Training texts and seeds


@pytest.mark.parametrize("doc_id", [7, 11])
def test_language_learns_all_languages_though_ids_repeat(spark, doc_id):
    """6,000 rows of one id, in one language, whatever the hash of the id; and 3,000 equal rows."""
    assert zlib.crc32(str(doc_id).encode()) % 5
    french = [(doc_id, f"le chat numéro {'a' * (i % 50)} dort sur la chaise près de la fenêtre", "fr") for i in range(6000)]
    english = [(1000 + i, f"the cat with number {'b' * (i % 50)} sleeps on the chair by the window", "en") for i in range(300)]
    german = [(doc_id, "die Katze schläft auf dem Stuhl am Fenster", "de")] * 3000
    docs = spark.createDataFrame(french + english + german, "doc_id long, text string, lang string")
    picked = {r.lang: (r.rows, r.texts) for r in language.training_texts(docs, 1500).groupBy("lang").agg(language.F.sum("copies").alias("rows"), language.F.count("*").alias("texts")).collect()}
    kept_english = sum(zlib.crc32(str(1000 + i).encode()) % 5 != 0 for i in range(300))
    assert picked["fr"][0] == 1500 and picked["de"] == (1500, 1) and picked["en"][0] == kept_english
    model = language.train(docs)
    assert model.langs == ["de", "en", "fr"]
    said = {r.text: r.lang_pred for r in language.predict_language(docs, model).withColumn("text", language.F.lit("")).limit(1).collect()}
    assert said
    asked = spark.createDataFrame([(5, "le chat dort sur la chaise"), (5, "the cat sleeps on the chair"), (5, "die Katze schläft auf dem Stuhl")], "doc_id long, text string")
    assert sorted(r.lang_pred for r in language.predict_language(asked, model).collect()) == ["de", "en", "fr"]


def test_leaks_in_texts_of_one_token_or_phrase(spark):
    """Texts of a million equal tokens, of short phrases over and over, and passages at the borders of segments."""
    passage = [f"w{i}" for i in range(30)]
    at_border = lambda n: " ".join([f"x{i}" for i in range(n)] + passage[5:20])
    docs = [(1, "0 " * 1_000_000), (2, "a b " * 5000), (3, "a b c " * 3000), (4, "0 " * 12), (5, at_border(4096 - 7)), (6, at_border(4096)), (7, at_border(8192 - 14)), (8, "0 " * 6 + "1 " * 6)]
    items = [(1, "0 " * 200), (2, "a b " * 40), (3, " ".join(passage)), (4, "0 " * 11 + "y z"), (5, "0 " * 7 + "1 " * 6), (6, "q " * 50)]
    found = {(r.doc_id, r.item_id): r.same for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def windows(text):
        w = text.split()
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {}
    for d, text in docs:
        for i, item in items:
            best = max((sum(x == y for x, y in zip(a, b)) for a in windows(text) for b in windows(item)), default=0) if len(windows(text)) * len(windows(item)) < 200_000 else 13 * bool(windows(text) & windows(item))
            if best >= 11:
                want[d, i] = best
    assert found == want


def test_leaks_by_shuffle(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    by_broadcast = key(decontaminate.find_leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert by_broadcast and key(decontaminate.find_leaks(docs, bench).collect()) == by_broadcast


def test_registered():
    assert {"op11_fill_in_middle", "op12_prefix_trie", "op13_byte_bpe_replay"} <= set(queries.queries())
