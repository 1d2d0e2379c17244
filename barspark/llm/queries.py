"""The registered queries of the operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import byte_bpe, decontaminate, fill_middle, jaccard, language, mixing, pii, prefix_trie, quality, sharding, substring, token_files, warc
from barspark.llm.shared import new_folder

TOKENIZER_FILE, END_ID, SHARDS = "byte_bpe_50k.json", 0, 8
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "same")


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = warc.revisit_plan(table(spark, sf_dir, "pages"))
    records = warc.read_records(warc.write_bundles(plan, new_folder(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents"))


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_coverage(table(spark, sf_dir, "documents"))


def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    # The texts stay where they are: size, checksum and hash stand for them in the shuffle.
    dealt = sharding.shuffle_into_shards(docs, SHARDS, ["doc_id", "text_crc32", "text_hash"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("scores")


def op10_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "text_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_byte_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(RANKS_FILE)
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks))


OP1_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
dt AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM d),
it AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM dt),
iw AS (SELECT item_id, len(w) AS k, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM it),
m AS (SELECT doc_id, item_id, p - q AS shift, q, least(k, n - (p - q)) - 13 AS last_start, greatest(0, q - p) AS first_start,
        count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS c
      FROM dw JOIN iw USING (t) WHERE n >= 13 AND k >= 13),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead,
        count(*) FILTER (q >= last_start) OVER (PARTITION BY doc_id, item_id, shift) AS at_end
      FROM m WHERE c >= 11 AND last_start >= first_start)
SELECT doc_id, item_id, CAST(max(CASE WHEN q <= last_start THEN greatest(ahead, at_end) ELSE at_end END) AS BIGINT) AS same
FROM g GROUP BY doc_id, item_id HAVING same >= 11
"""

OP2_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(html) >= 100 AND page_id > min(page_id) OVER (PARTITION BY html) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 100 AND page_id > min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to
FROM pages
"""


SPLIT = r"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""

OP3_SQL = f"""
WITH {SPLIT},
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(i)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
seen AS (SELECT words.r, p, word, max(dup.i) OVER (PARTITION BY words.r ORDER BY p ROWS 34 PRECEDING) IS NOT NULL AS gone FROM words LEFT JOIN dup ON dup.r = words.r AND dup.i = words.p),
left_over AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM seen GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (r)
"""


def _covered_sql(n: int) -> str:
    """Words and characters of each text inside n-word windows that occur in it twice or more."""
    return f"""win_{n} AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')) AS h FROM d, unnest(range(1, len(w) - {n - 2})) t(i)),
dup_{n} AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win_{n}) WHERE c > 1),
in_{n} AS (SELECT r, count(*) AS words_{n}, sum(length(word)) AS chars_{n} FROM (SELECT words.r, word, max(dup_{n}.i) OVER (PARTITION BY words.r ORDER BY p ROWS {n - 1} PRECEDING) IS NOT NULL AS hit FROM words LEFT JOIN dup_{n} ON dup_{n}.r = words.r AND dup_{n}.i = words.p) WHERE hit GROUP BY r)"""


_N = [quality.BASE_WINDOW, *quality.LIMITS]
_SHARES = {n: f"coalesce(chars_{n}, 0) / greatest(word_chars, 1)" for n in quality.LIMITS}
_FAILED = f"n_words < {quality.LEAST_WORDS} OR 100 * coalesce(words_{quality.BASE_WINDOW}, 0) > {quality.MOST_REPEATED} * n_words"
OP7_SQL = rf"""
WITH {SPLIT}, words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
{", ".join(_covered_sql(n) for n in _N)},
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
later AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[ 	-
]+', '', 'g'))) AS line_chars FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth FROM lines WHERE regexp_matches(line, '[^ 	-
]')) WHERE nth > 1 GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words_{quality.BASE_WINDOW}, 0) AS n_repeat_words, {_FAILED} AS base_failed,
  {", ".join(f"{x} AS dup_{n}gram_share" for n, x in _SHARES.items())}, coalesce(line_chars, 0) / greatest(word_chars, 1) AS dup_line_share,
  NOT ({_FAILED}) AND coalesce(line_chars, 0) / greatest(word_chars, 1) <= {quality.LINE_LIMIT} AND {" AND ".join(f"{x} <= {quality.LIMITS[n]}" for n, x in _SHARES.items())} AS kept
FROM m {" ".join(f"LEFT JOIN in_{n} USING (r)" for n in _N)} LEFT JOIN later USING (r)
"""

#: All pairs of texts that share a gram, their exact similarity, and what is reached by links.
OP10_SQL = rf"""
WITH RECURSIVE {SPLIT},
texts AS (SELECT text, first(w) AS w, min(doc_id) AS text_id, row_number() OVER (ORDER BY text) AS n FROM d GROUP BY text),
grams AS (SELECT DISTINCT n, array_to_string(list_slice(w, i, i + {jaccard.GRAM - 1}), ' ') AS gram FROM texts, unnest(range(1, greatest(len(w) - {jaccard.GRAM - 2}, least(len(w), 1) + 1))) t(i)),
sizes AS (SELECT n, count(*) AS k FROM grams GROUP BY n),
pairs AS (SELECT a.n AS x, b.n AS y, count(*) AS common FROM grams a JOIN grams b USING (gram) WHERE a.n <> b.n GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.n = x JOIN sizes t ON t.n = y WHERE 5 * common >= 4 * (s.k + t.k - common)),
reached(n, m) AS (SELECT n, n FROM texts UNION SELECT y, m FROM reached JOIN links ON x = reached.n),
classes AS (SELECT reached.n, min(text_id) AS class_id FROM reached JOIN texts ON texts.n = m GROUP BY reached.n),
counts AS (SELECT x AS n, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, text_id FROM d JOIN texts USING (text) JOIN classes USING (n) LEFT JOIN counts USING (n)
"""

#: Units are lines; the parts follow from the first four groups of the hash.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || x[8 * i + 1 : 8 * i + 8] AS BIGINT) for i in range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, array_to_string(u[: a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle, array_to_string(u[b + 1 :], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s
"""

#: The unsigned crc32 of a text v of plain characters, bit by bit, as this SQL has no such function.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(v, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b:
  list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"""

#: A node is the list of hashes of its turns; its ancestors are the prefixes of its smallest member at lower depths.
OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), x) AS nth, x, n FROM
    (SELECT conv_id, turn, role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS v FROM t)),
r AS (SELECT c.conv_id, 0 AS part, nth, x, n FROM c JOIN t ON t.conv_id = first AND nth <= h UNION ALL SELECT conv_id, 1, nth, x, n FROM c JOIN t USING (conv_id) WHERE nth > h),
o AS (SELECT conv_id, x, n, row_number() OVER w AS depth, string_agg(x, '') OVER w AS seq FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)),
m AS (SELECT conv_id, depth, seq, n FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM c),
k AS (SELECT seq, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(n) AS n FROM m GROUP BY seq),
p AS (SELECT m.conv_id, m.depth, k.conv_id AS top FROM m JOIN k USING (seq)),
f AS (SELECT k.*, p.top AS parent_conv_id FROM k LEFT JOIN p ON p.conv_id = k.conv_id AND p.depth = k.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY ALL),
g AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM f LEFT JOIN kids USING (conv_id, depth)),
s AS (SELECT p.top AS conv_id, p.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.n) AS saved_tokens FROM g JOIN p ON p.conv_id = g.conv_id AND p.depth <= g.depth GROUP BY ALL),
e AS (SELECT seq, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(seq, depth) AS seq FROM m GROUP BY conv_id) GROUP BY seq)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN s USING (conv_id, depth) LEFT JOIN e USING (seq)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_spaced_seed_decontamination, op2_warc_bundles, op3_substring_dedup, op4_cube_mixing, op5_token_files, op6_language_ppm, op7_repetition_coverage, op8_hypergeometric_shards, op9_personal_data, op10_jaccard_forest, op11_fill_in_middle, op12_prefix_trie, op13_byte_bpe_replay)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_spaced_seed_decontamination": OP1_SQL, "op2_warc_bundles": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op7_repetition_coverage": OP7_SQL, "op10_jaccard_forest": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_prefix_trie": OP12_SQL}
