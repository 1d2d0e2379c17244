"""Each operator against a brute-force twin, on the small tables and on a fixture of nulls, ties, empty and odd texts."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from barspark.llm import arrays, decontaminate, jaccard, language, mixing, pii, quality, queries, sharding, substring, token_files, warc
from barspark.llm.shared import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, seed string, place int, size string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
BOUNDARY = " ".join(f"w{i}" for i in range(35))
NEAR = " ".join(f"near{i}" for i in range(120))


def odd_rows() -> list[tuple]:
    texts = [
        (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, PASSAGE), (6, "before " + PASSAGE + " after it"), (7, PASSAGE + "  " + PASSAGE), (8, BOUNDARY), (9, "x " + BOUNDARY),
        (10, " ".join(BOUNDARY.split()[:34])), (11, "na " * 400), (12, "é ü\x1c\x85 ß　字 " * 30), (13, "line one\nline one\n\n \nline two\nline one"), (14, NEAR), (15, NEAR.replace("near7 ", "other ")), (16, NEAR),
        (17, "a@b.co, x..y@z-1.example.com@c.d 1.2.3.4 300.1.1.1 1.2.3.4.5 4111 1111 1111 1111 4111-1111-1111-1112 +1 (168) 555-5254 +12"), (17, "the same id with another text"), (4, "one"), (None, "a row without id"), (None, None),
        (18, "x" * 50_000), (19, "1" * 20_000 + " +" + "(" * 5_000), (20, " ".join(f"t{i % 977}" for i in range(30_000))), (21, "tail  \n"), (22, "#*$%&|<> 12 !!"),
    ]
    return [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"s{k % 4}", None, "clash", k, "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(rows):
    return sorted([tuple(r) for r in rows], key=repr)


def words(text):
    return WORD.findall(text or "")


def test_sql_twins(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        want = con.sql(sql)
        assert key(got.select(*want.columns).collect()) == key(want.fetchall()), name
        assert got.count() > 0


def test_masks_are_lossless():
    for changed in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not {m + o for m in mask} & set(changed) for mask in decontaminate.MASKS for o in range(decontaminate.WINDOW - mask[-1]))


def test_leaks_with_substitutions(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (4, "Word0 WORD1, word2! x word4 word5 word6 word7 y word9 word10 word11 word12"), (5, "Word0 x word2 x word4 word5 word6 word7 y word9 word10 word11 word12")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.same for r in decontaminate.find_leaks(odd, bench).collect()}
    assert found == {(d, i): n for d in (5, 6, 7) for i, n in ((1, 13), (4, 11))}
    left = decontaminate.remove_leaked(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontaminate.remove_leaked(empty, bench).count() == decontaminate.find_leaks(empty, bench).count() == decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 60
    rows = [(5, "http://a b\r\n", same, 1), (2, "http://c", same, 1), (3, None, None, 1), (4, "u", "", 1), (6, "u", "short", 1), (7, "u", "short", 1), (None, "u", same, 1), (8, "u", "x" * 100, 1), (8, "u", "x" * 100, 1), (9, "u", "x" * 100, 1), (10, "u", "y\r\n\r\n" * 40_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, frame int")
    index = warc.write_bundles(warc.revisit_plan(pages), new_folder(spark, "warc"), frame_bytes=300)
    got = warc.read_records(index)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h, _ in rows if h == html and j is not None), default=None)
        again = len(raw) >= 100 and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert key(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == key(want)
    one = warc.read_records(index.filter("page_id = 10")).first()
    assert bytes(one.payload).decode() == rows[-1][2]
    assert warc.read_records(warc.write_bundles(warc.revisit_plan(pages.limit(0)), new_folder(spark, "warc"))).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_substrings(which, request, empty):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, substring.brute_force([r.text for r in rows]))]
    assert key(substring.digest(substring.remove_repeats(df)).collect()) == key(want)
    assert sum(w[2] for w in want) > 0
    assert substring.remove_repeats(empty).count() == 0


def test_substrings_random(spark):
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in rng.integers(0, 40, 400)]
    texts = []
    for _ in range(80):
        a, n = int(rng.integers(0, 340)), int(rng.integers(5, 160))
        own = base[a : a + n]
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, len(own)))] = f"u{rng.integers(0, 3)}"
        texts.append(" ".join([*(f"p{rng.integers(0, 9999)}" for _ in range(int(rng.integers(0, 30)))), *own]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = [(i, *x) for i, x in enumerate(substring.brute_force(texts))]
    assert key(substring.digest(substring.remove_repeats(df)).collect()) == key(want)


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mix(which, request, spark, empty):
    df = request.getfixturevalue(which)
    got = mixing.mix_sources(df).collect()
    assert key((r.doc_id, r.source, r.size) for r in got) == key((r.doc_id, r.source, len(words(r.text))) for r in df.collect())
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r.size
    want, taken = targets_by_hand(sizes), collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:  # within 2 %, or where a source has few documents, within half of its largest
        few = sum(r.source == s for r in got) < 20
        assert abs(taken[s] - want[s]) <= (max(r.size for r in got if r.source == s) / 2 if few else 0.02 * want[s]), s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert key(got) == key(mixing.mix_sources(df.repartition(3)).collect())
    assert mixing.mix_sources(empty).count() == mixing.take_mix(empty).count() == 0
    again = mixing.take_mix(df)
    assert again.columns == df.columns and again.count() == sum(r.repeats for r in got)


def test_flights_balance():
    rng = np.random.default_rng(1)
    size, chance = rng.integers(1, 3000, 5000), np.full(5000, 0.37)
    flown = mixing.flight(chance, size, np.random.default_rng(2))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(chance.sum(), abs=1e-3)
    assert (flown * size).sum() == pytest.approx((chance * size).sum(), rel=1e-6)
    often = np.mean([mixing.flight(np.full(30, 0.3), size[:30], np.random.default_rng(k)) for k in range(600)], axis=0)
    assert abs(often - 0.3).max() < 0.1
    flown = mixing.flight(chance, size, np.random.default_rng(2), mixing.LANDING)
    landed = mixing.land(flown, size, np.random.default_rng(3))
    assert set(landed) == {0.0, 1.0} and (landed * size).sum() == pytest.approx((chance * size).sum(), abs=float(size.min() * 20))


@pytest.mark.parametrize("sizes", [[5, 9, 20, 33, 70, 400], [1], [7, 7, 7], list(range(1, 41))])
def test_mixing_keeps_the_chances(sizes):
    """Over 3,000 seeds, each document is taken as often as its chance says, also in sources of few documents; four standard deviations are allowed."""
    size, chance = np.array(sizes, dtype=float), np.linspace(0.2, 0.7, len(sizes))
    taken = np.zeros(len(sizes))
    for seed in range(3000):
        rng = np.random.default_rng(seed)
        taken += mixing.land(mixing.flight(chance, size, rng, mixing.LANDING), size, rng)
    assert (np.abs(taken / 3000 - chance) < 4 * (chance * (1 - chance) / 3000) ** 0.5).all()


def test_many_tiny_sources(spark):
    """Sources of a few documents each: the targets hold over all of them together, as each is met by chance."""
    rows = [(i, "w " * (i * 7 % 23 + 1), f"s{i // 4}") for i in range(2400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 2400 and sum(r.taken for r in got) == pytest.approx(sum(r.size for r in got), rel=0.03)
    off = collections.Counter()
    for r in got:
        off[r.source] += r.taken - r.size * r.target / r.source_size
    assert all(abs(x) <= 23 for x in off.values())


def test_many_groups(spark):
    rows = [(i, "w " * (i % 90 + 1), f"s{int(i > 2400)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before, mixing.GROUP = mixing.choose.__defaults__, 64
    mixing.choose.__defaults__ = (0, 64)
    try:
        got = mixing.mix_sources(df).collect()
    finally:
        mixing.choose.__defaults__, mixing.GROUP = before, 4096
    for s in ("s0", "s1"):
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), abs=200)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_files(which, request, empty):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert key(token_files.encode_to_files(df, queries.tokenizer_path()).collect()) == key(want)
    assert token_files.encode_to_files(empty, queries.tokenizer_path()).count() == 0


def test_token_files_roll_over(docs, tmp_path):
    whole = token_files.write_token_files(docs, f"file://{tmp_path}/a", queries.tokenizer_path())
    small = token_files.write_token_files(docs, f"file://{tmp_path}/b", queries.tokenizer_path(), frame_bytes=500, file_bytes=3000)
    assert small.count() > 3 * whole.count()
    assert key(token_files.read_digests(small).collect()) == key(token_files.read_digests(whole).collect())


def test_token_files_give_single_documents(spark, docs):
    from tokenizers import Tokenizer

    manifest = token_files.write_token_files(docs, new_folder(spark, "tokens"), queries.tokenizer_path(), frame_bytes=4096)
    got = token_files.read_token_files(manifest, {3, 77}).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: tokenizer.decode(r.ids[:-1]) for r in got} == {3: texts[3], 77: texts[77]}
    path = manifest.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[40] ^= 0xFF
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        token_files.read_token_files(manifest).collect()


def test_pieces_match_the_tokenizer():
    encode, width = token_files.encoded(queries.tokenizer_path())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(3)
    parts = ["a", "Foo", ",", ".", "'s", "'", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "字", "12", " ", "\x1c", "\x85", "<|endoftext|>", "!!", "_", " ", "x.", "don't"]
    for _ in range(3000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(0, 14))))
        assert np.frombuffer(encode(text), dtype=width).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_words_of_many_texts_are_encoded_in_one_call(monkeypatch):
    from tokenizers import Tokenizer

    token_files._encoder.cache_clear()
    encode, width = token_files.encoded(queries.tokenizer_path())
    pieces = next(c.cell_contents for c in encode.all.__closure__ if isinstance(c.cell_contents, token_files.PieceIds))
    calls, plain = [], pieces.plain
    monkeypatch.setattr(pieces, "plain", type("Counted", (), {"encode_batch_fast": lambda _, x, **k: calls.append(x) or plain.encode_batch_fast(x, **k)})())
    texts = ["", "one", "Ein früher Tag, ça été; naïveté!\nStraße (hier) don't we're it's' they'", "zwölf\tRunden  weit\r\nhinaus \n", "mot??? dé-jà d'un œuvre… ªº ʼn ɏa Ω 字 a1b x_y ĠA\nàA. \u00a0b", "früher <|endoftext|> Tag", "a" * 300 + " " + "é," * 90]
    texts += [f"wort{chr(97 + k % 26)}{'ü' * (k % 7)} tag{'.' * (k % 4)}\nNeu{'#' * (k % 3)}" for k in range(200)]
    plain_call = Tokenizer.from_file(queries.tokenizer_path())
    want = [plain_call.encode(t, add_special_tokens=False).ids for t in texts]
    for known in (False, True):
        assert [np.frombuffer(b, dtype=width).tolist() for b in encode.all(texts)] == want
        assert len(calls) == 1
    monkeypatch.setattr(token_files, "REMEMBERED_AFTER", 5)
    encode.end_task()
    assert len(pieces) == 5 and all(p.isalpha() for p in pieces)  # words stay for the next task
    assert [np.frombuffer(encode(t), dtype=width).tolist() for t in texts] == want
    token_files._encoder.cache_clear()


def test_token_files_name_added_tokens_as_the_plain_call(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a text", "a<|endoftext|>b", "<|endoftext|>", "some words <|endoftext|>, more words\nand <|endoftext|><|endoftext|> end", "<|endoftext| >", "behind"]
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert want[2][2] == 2 and key(token_files.encode_to_files(df, queries.tokenizer_path()).collect()) == key(want)


def test_language(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = language.predict_language(df).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    texts = [r[1] for r in odd_rows()]
    got = language.predict_language(odd).collect()
    assert [r.lang_pred == "und" for r in got] == [not any(c.isalpha() for c in t or "") for t in texts]
    assert language.predict_language(empty).count() == 0
    assert language.keep_identified(empty).count() == 0
    assert language.keep_identified(odd).columns == odd.columns


def test_language_learns_from_the_bounded_sample(spark, docs):
    many = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 100_000)).filter("lang is not null and text is not null")
    rows = [(r.lang, r.text, r.doc_id) for r in many.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    own = {}
    for lang, text, i in rows:
        own.setdefault(lang, []).append((i, text))
    hashes = {r.doc_id: r.h for r in many.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    model = language.train(many, train_docs=5)
    assert model.langs == sorted(own)
    for lang, (key_, cost, context, escape) in zip(model.langs, model.levels[0][1]):
        picked = [t for _, t in sorted(own[lang], key=lambda x: hashes[x[0]])[:5]]
        raw, at = language._join([b for t in picked if (b := language.normal(t))])
        assert sorted(set(language.grams(raw, at[:-1], 3).tolist())) == key_.tolist()


def test_language_of_single_letters_and_numbers(spark):
    rows = [(k, f"{word} " * 5, lang) for k in range(40) for lang, word in (("aa", "xylo yes yak"), ("bb", "abba ada an"))]
    odd = ["½ ²", "Ⅷ", "12 ①", "a", "y", "A½", "\u0301", "字"]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)] + [(1000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id - 1000: r for r in language.predict_language(df).collect() if r.doc_id >= 1000}
    assert [got[k].lang_pred for k in range(7)] == ["und", "und", "und", "bb", "aa", "bb", "und"] and got[7].lang_pred != "und"
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert [language.normal(t) != b"" for t in odd] == [any(c.isalpha() for c in t) for t in odd]


def test_language_code_lengths_by_hand():
    texts = [b"\0\0\0 abracadabra ", b"\0\0\0 banana "]
    raw, at = language._join(texts)
    code, n = np.unique(language.grams(raw, at[:-1], 3), return_counts=True)
    model = language.Model(["x"], [(code, n.astype(float))])
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        for i in range(3, len(t)):
            for order in range(4):
                seen[t[i - order : i]][t[i]] += 1

    def bits(t, i):
        total = 0.0
        for order in range(3, -1, -1):
            c = seen.get(t[i - order : i])
            if c:
                whole = sum(c.values()) + len(c)
                if t[i] in c:
                    return total - np.log2(c[t[i]] / whole)
                total -= np.log2(len(c) / whole)
        return total + 8

    for t in (b" abra ", b" xyz ", b" ban", b" a"):
        t = b"\0\0\0" + t
        assert model.code_lengths([t])[0, 0] == pytest.approx(sum(bits(t, i) for i in range(3, len(t))))


def quality_by_hand(text):
    w = words(text)

    def inside(n):
        c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if c[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        return hit

    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, words(x)))
        seen.add(x)
    chars, rep = sum(map(len, w)), sum(inside(8))
    failed = len(w) < 20 or 100 * rep > 30 * len(w)
    shares = [sum(len(x) for x, h in zip(w, inside(n)) if h) / max(1, chars) for n in quality.LIMITS]
    good = all(s <= m for s, m in zip(shares, quality.LIMITS.values())) and dup_chars / max(1, chars) <= quality.LINE_LIMIT
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep, failed, not failed and good)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality(which, request, empty):
    df = request.getfixturevalue(which)
    got = quality.repetition_coverage(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert key(got) == key((r.doc_id, *quality_by_hand(r.text)) for r in df.collect())
    assert quality.repetition_coverage(empty).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_shards(which, request, spark, empty):
    df = request.getfixturevalue(which)
    got = sharding.shuffle_into_shards(df.select("doc_id", "text", "lang", df.source.alias("slot")), 8, ["doc_id", "text"]).collect()
    assert key((r.doc_id, r.text, r.lang) for r in got) == key(df.select("doc_id", "text", "lang").collect())
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(len(per[s]) for s in range(8)) <= 1
    assert sharding.shuffle_into_shards(empty.select("doc_id", "text"), 8, ["doc_id", "text"]).count() == 0


def test_shards_deal_equal_rows_apart(spark):
    rows = [(1, "same")] * 1000 + [(k, f"t{k}") for k in range(2, 7002)]
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8, ["doc_id", "text"]).collect()
    per, slots = collections.Counter(r.shard for r in got if r.doc_id == 1), sorted(r.slot for r in got if r.doc_id == 1)
    assert all(85 <= per[s] <= 165 for s in range(8)) and collections.Counter(r.shard for r in got) == {s: 1000 for s in range(8)}
    assert abs(np.mean(slots) - 500) < 40 and np.max(np.diff(slots)) < 30
    again = sharding.shuffle_into_shards(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), 8, ["doc_id", "text"]).collect()
    assert key(got) == key(again)


def test_numbers_of_copies(spark):
    from barspark.llm.shared import number_copies

    rows = [(None, "a")] * 7 + [(1, None)] * 5 + [(1, "a"), (2, "b")]
    got = number_copies(spark.createDataFrame(rows, "x long, y string").repartition(4), ["x", "y"], "n").collect()
    assert key(got) == key([(None, "a", i + 1) for i in range(7)] + [(1, None, i + 1) for i in range(5)] + [(1, "a", 1), (2, "b", 1)])


def test_matrix_of_billions():
    m = sharding.communication_matrix([3_000_000_000, 1_000_000_001], 4, 3)
    assert m.sum(axis=1).tolist() == [3_000_000_000, 1_000_000_001] and sorted(m.sum(axis=0).tolist()) == [1_000_000_000] * 3 + [1_000_000_001]
    assert abs(m[0] - 750_000_000).max() < 200_000


def test_shards_are_uniform(spark):
    m = sharding.communication_matrix([700, 0, 1300, 5], 3, 1)
    assert m.sum(axis=1).tolist() == [700, 0, 1300, 5] and sorted(m.sum(axis=0).tolist()) == [668, 668, 669]
    got = sharding.shuffle_into_shards(spark.range(20_000), 4, ["id"]).collect()
    ids = np.array([r.id for r in sorted(got, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(ids, np.arange(20_000))[0, 1]) < 0.03
    assert all(abs(ids[s * 5000 : (s + 1) * 5000].mean() - 10_000) < 350 for s in range(4))


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_by_hand(text):
    def good(kind, m):
        digits = re.sub(r"\D", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [[f"{k}:{m.start()}:{m.end()}" for m in p.finditer(text) if good(k, m[0])] for k, p in BASE.items()]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_personal_data(which, request, empty):
    df = request.getfixturevalue(which)
    rows = [r for r in df.collect() if len(r.text or "") < 15_000 or which == "docs"]
    got = pii.find_personal_data(df).collect()
    assert len(got) == df.count()
    short = [r for r in got if r.doc_id not in (18, 19, 20)] if which == "odd" else got
    want = []
    for r in rows:
        found = base_by_hand(r.text or "")
        want.append((r.doc_id, *map(len, found), hashlib.sha256(",".join(sum(found, [])).encode()).hexdigest()))
    assert key(tuple(r)[:6] for r in short) == key(want if which == "docs" else [w for w in want if w[0] not in (18, 19, 20)])
    assert pii.find_personal_data(empty).count() == 0


def test_personal_data_random_text():
    rng = np.random.default_rng(8)
    parts = ["a", "b.c", "@", ".", "-", "1", "23", "456", " ", "+", "(", ")", "x@y.z", "255", "4111111111111111", "\n", "é", "_", "%"]
    for _ in range(20_000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(0, 16))))
        found = pii.base_spans(text)
        assert [[f"{k}:{a}:{b}" for a, b in found[k]] for k in pii.BASE] == base_by_hand(text), repr(text)


def test_personal_data_adds_confirmed_spans():
    def kinds(text):
        return [k for k, *_ in pii.more_spans(text, [x for v in pii.base_spans(text).values() for x in v])]

    assert kinds("my IBAN is GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("GB82 WEST 1234 5698 7654 33") == []
    for iban in ("BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "be68539007547034", "NO93 8601 1117 947", "GB82WEST12345698765432"):
        for tail in ("", " BIC", " AND more", ".", " 12 x"):
            assert pii.ibans(f"to {iban}{tail}") == [(3, 3 + len(iban))], (iban, tail)
    assert pii.ibans("BE68 5390 0754 70345") == pii.ibans("xBE68 5390 0754 7034") == pii.ibans("ZZ68 5390 0754 7034") == []
    assert kinds("card: 378282246310005") == ["card_short"] and kinds("item 378282246310005") == []
    assert kinds("call me: 555-123-4567") == ["phone_local"] and kinds("on 555-123-4567") == []


def test_personal_data_finds_cards_of_single_digits(spark):
    texts = ["my card 3-7-8-2-8-2-2-4-6-3-1-0-0-0-5", "my card 3 7 8 2 8 2 2 4 6 3 1 0 0 0 5"]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == {0: "card_short:8:37", 1: "card_short:8:37"}


def test_personal_data_of_its_own_kinds_does_not_overlap():
    text = "call " + "555-123-4567 " * 3_000
    base = [x for v in pii.base_spans(text).values() for x in v]
    ends = 0
    found = pii.more_spans(text, base)
    for _, start, end, _ in found:
        assert start >= ends and all(end <= a or b <= start for a, b in base[:50])
        ends = end
    assert [k for k, *_ in pii.more_spans("GB82 WEST 1234 5698 7654 32, GB82WEST12345698765432", [(0, 4)])] == ["iban"]


def groups_by_hand(texts, similar=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (texts[i] or "") == (texts[j] or "") or (a and b and len(a & b) >= similar * len(a | b)):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, docs, odd, empty):
    rng = np.random.default_rng(11)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"q{i}" for i in range(300)]
    for k in range(60):  # a group of near copies, some close to the threshold
        own = list(base)
        for at in rng.choice(300, int(rng.integers(0, 16)), replace=False):
            own[at] = f"z{k}-{at}"
        rows.append((10_000 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    want = groups_by_hand([t for _, t in rows])
    ids = [i for i, _ in rows]
    least = {g: min(i for i, x in zip(ids, want) if x == g) for g in set(want)}
    assert {i: got[i].class_id for i in ids} == {i: least[g] for i, g in zip(ids, want)}
    texts = dict(rows)
    alone = collections.Counter(want)
    for i, g in zip(ids, want):
        mates = {texts[j] for j, x in zip(ids, want) if x == g}
        assert (got[i].n_links > 0) == (len(mates) > 1), (i, alone[g])
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t in rows[-60:]}
    for i, a in sets.items():
        assert got[i].n_links == len({texts[j] for j, b in sets.items() if texts[j] != texts[i] and len(a & b) >= 0.8 * len(a | b)})
    small = {r.doc_id: r for r in jaccard.near_duplicates(df, block=16).collect()}
    bytes_before, jaccard.BLOCK_BYTES = jaccard.BLOCK_BYTES, 10_000
    light = {r.doc_id: r for r in jaccard.near_duplicates(df).collect()}
    jaccard.BLOCK_BYTES = bytes_before
    assert light == got
    assert all((small[i].class_id, small[i].n_links) == (got[i].class_id, got[i].n_links) for i in ids)
    kept_rows = jaccard.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept_rows.collect()) == sorted(least.values())
    found = jaccard.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = collections.defaultdict(set)
    for r in found:
        by[r.group].add(r.doc_id)
    assert {14, 15, 16} in by.values() and {1, 2, None} in by.values() and {3} in by.values()
    one = jaccard.keep_one_of_each(odd)
    assert one.columns == odd.columns and one.count() == len(by)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("size", [1000, 400])  # of bytes in a block
def test_links_are_counted_once_over_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    texts = [" ".join(f"p{k}x{i}" for i in range(100)) for k in range(12)]
    rows = [(2 * k + one, t + " tail" * one) for k, t in enumerate(texts) for one in (0, 1)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, i - i % 2, 1) for i, _ in rows}


def test_links_of_blocks_add_up_to_those_of_all(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = [f"c{i}" for i in range(80)]
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(80, int(rng.integers(0, 5)), replace=False):
            own[at] = f"d{k}-{at}"
        texts.append(" ".join(own))
    texts = list(dict.fromkeys(texts))
    frame = pd.DataFrame({"cluster": 7, "node": range(len(texts)), "text": texts, "wide": True, "block": [k // 17 for k in range(len(texts))]})
    whole = jaccard._own_links(0.8, f"file://{tmp_path}")(frame.assign(wide=False))
    parts = [jaccard._own_links(0.8, f"file://{tmp_path}")(own) for _, own in frame.groupby("block")]
    paths = {int(r.block): r.path for p in parts for r in p.itertuples() if isinstance(r.path, str)}
    pairs = pd.DataFrame([(7, paths[x], paths[y]) for x, y in itertools.combinations(sorted(paths), 2)], columns=["cluster", "lo_path", "hi_path"])
    parts += list(jaccard._cross_links(0.8)([pairs]))

    def result(frames):
        rows = pd.concat(frames)
        counts = rows[rows["n"] > 0].groupby("a")["n"].sum().to_dict()
        root = {n: n for n in range(len(texts))}
        for _ in texts:
            for r in rows[rows["b"].notna()].itertuples():
                root[r.a] = root[r.b] = min(root[r.a], root[r.b])
        return counts, root

    assert len(paths) > 2 and result([whole]) == result(parts)


def test_depths_reach_the_recall(spark):
    least = jaccard.least_depth(0.8, jaccard.TREES, jaccard.DEPTH, jaccard.RECALL)
    assert jaccard.meeting(0.8, jaccard.TREES, least) >= jaccard.RECALL > jaccard.meeting(0.8, jaccard.TREES, least + 1)
    far, near = [[f"{k}a{i}" for i in range(400)] for k in range(2)]
    rows = [(k, " ".join([*far[: k % 45], *(f"n{k}-{i}" for i in range(4)), *far[k % 45 :]])) for k in range(60)]
    rows += [(100 + k, " ".join([*near[:40], f"m{k}"])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample, deeper in ((10_000, True), (0, False)):
        forest = docs.selectExpr("doc_id", "text", "doc_id as row_key", "xxhash64(text) as node", "1L as size")
        signed = forest.mapInArrow(jaccard._sign(jaccard.TREES, jaccard.DEPTH, 0.8), "doc_id long, row_key long, node long, size long, small int, large int, labels binary")
        rows_ = signed.selectExpr("node", "explode(sequence(small, large)) as grp", "labels").selectExpr("grp", "node", f"posexplode(transform(sequence(0, {jaccard.TREES - 1}), t -> substring(labels, t * {jaccard.DEPTH} + 1, {jaccard.DEPTH}))) as (tree, key)")
        order = ["grp", "tree", "key", "node"]
        runs = rows_.repartitionByRange(3, *order).sortWithinPartitions(*order).mapInArrow(jaccard._runs(least, jaccard.DEPTH, sample / 120), jaccard._FOREST)
        depths = jaccard.fit_depths(runs, forest.select("node", "text"), 0.8, jaccard.TREES, least, jaccard.DEPTH, jaccard.RECALL)
        assert min(depths) == least and (max(depths) > least) == deeper


def test_pairs_at_the_threshold_meet_beside_many_closer_ones(spark):
    """The depth holds for every pair: 79,800 pairs of similarity 44/46 do not cost links of 300 pairs of similarity 40/50."""
    rows = [(k, " ".join([*(f"c{i}" for i in range(48)), f"e{k}"])) for k in range(400)]
    for k in range(300):
        own = [f"p{k}x{i}" for i in range(49)]
        rows += [(1000 + 2 * k, " ".join(own)), (1001 + 2 * k, " ".join([*own[:24], "other", *own[25:]]))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, 0, 399) if i < 1000 else (i, i - i % 2, 1) for i, _ in rows}


def test_hashes_are_the_same_for_equal_slices():
    raw = np.frombuffer(b"abc abc xabc abc", dtype=np.uint8)
    w = arrays.Words(raw, np.array([0, 7, 16]))
    h = w.hashes()[0]
    assert w.count.tolist() == [2, 2] and h[0] == h[1] == h[3] != h[2]


def identified_by_hand(rows):
    """Ids of the rows that some learned language codes in few enough bits, by dictionaries of contexts."""
    seen = {}
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5:
            own = seen.setdefault(r.lang, collections.defaultdict(collections.Counter))
            t = language.normal(r.text)
            for i in range(3, len(t)):
                for order in range(4):
                    own[t[i - order : i]][t[i]] += 1

    def bits(own, t, i):
        total = 0.0
        for order in range(3, -1, -1):
            c = own.get(t[i - order : i])
            if c:
                whole = c.total() + len(c)
                if t[i] in c:
                    return total - np.log2(c[t[i]] / whole)
                total -= np.log2(len(c) / whole)
        return total + 8

    kept = set()
    for r in rows:
        t = language.normal(r.text or "")
        if t and min(sum(bits(own, t, i) for i in range(3, len(t))) for own in seen.values()) / (len(t) - 3) <= language.MOST_BITS:
            kept.add(r.doc_id)
    return kept


def leaked_by_hand(texts, items):
    token = re.compile(r"[^\W_]+")
    items = [token.findall((t or "").lower()) for t in items]
    out = set()
    for i, text in texts.items():
        d = token.findall((text or "").lower())
        for it in items:
            for shift in range(12 - len(it), len(d) - 12):
                lo, hi = max(0, -shift), min(len(it), len(d) - shift)
                if hi - lo >= 13:
                    same = np.array([d[k + shift] == it[k] for k in range(lo, hi)])
                    if same.sum() >= 11 and np.convolve(same, np.ones(13), "valid").max() >= 11:
                        out.add(i)
                        break
            if i in out:
                break
    return out


def test_pipeline_stages_by_hand(spark, sf):
    """Each stage's rows against plain loops over what the stage before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def run(name, docs):
        return corpus_pipeline.kept(stages[name](spark, docs, sf), name)

    rows = docs.collect()
    found = run("language", docs)
    assert {r.doc_id for r in found.collect()} == identified_by_hand(rows)

    rows = found.collect()
    groups = groups_by_hand([r.text for r in rows])
    least = {g: min(r.doc_id for r, x in zip(rows, groups) if x == g) for g in set(groups)}
    found = run("near_duplicates", found)
    assert sorted(r.doc_id for r in found.collect()) == sorted(least.values()) and len(least) < len(rows)

    rows = found.collect()
    bad = leaked_by_hand({r.doc_id: r.text for r in rows}, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    found = run("decontamination", found)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in rows} - bad and bad

    rows = found.collect()
    size, source = {r.doc_id: len(words(r.text)) for r in rows}, {r.doc_id: r.source for r in rows}
    total = collections.Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = targets_by_hand(total)
    found = run("mixing", found)
    times = collections.Counter(r.doc_id for r in found.collect())
    for i in size:
        rate = want[source[i]] / total[source[i]] if total[source[i]] else 0
        assert times[i] in (int(rate + 1e-9), int(rate + 1e-9) + 1) and times[i] <= 3
    taken = collections.Counter()
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    for s in want:
        assert abs(taken[s] - want[s]) <= max((n for i, n in size.items() if source[i] == s), default=0) / 2 + 1

    rows = sorted(found.collect(), key=lambda r: (r.doc_id, r.text or ""))
    tokenizer, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert key(stages["tokens"](spark, found, sf).collect()) == key(expected)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n.append(docs.count())
    assert n[0] >= n[1] > n[2] > n[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == n[4]
    assert key(out.collect()) == key(corpus_pipeline.run(spark, sf).collect())


def test_clean_up_deletes_the_session_folder(spark):
    from pathlib import Path

    from barspark.llm.shared import clean_up, kept, session_folder

    kept(spark.range(3), "some")
    folder = Path(session_folder(spark).removeprefix("file://").removeprefix("file:"))
    assert folder.is_dir()
    clean_up(spark)
    assert not folder.exists() and folder.parent.exists()
