"""The queries opN_<name>: each operator, with production parameters, over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import bpe, chat, exact_dedup, jaccard_join, merkle, mixing, periodic, quality, rules, simhash, suffix_dedup, token_files, toxicity
from tracelens.llm.common import cut, let, remove, shared_dir, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents")).documents
    return found.select("doc_id", "size", "source_size", "target", "taken")


def toxic_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def exact_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)  # a batch into an empty index; the index goes with the query
    try:
        return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)
    finally:
        index.drop()


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard_join.join(table(spark, sf_dir, "documents"), width=3, threshold=90)
    return found.select("doc_id", "n_shingles", "component_id")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chats(chats.unionByName(own)))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    try:
        return cut(token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), tokenizer_path(), out=out)))
    finally:
        remove(spark, out)


def simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.audit(table(spark, sf_dir, "documents"), changed, {"n_chars": F.col("n_chars") + 1})


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hashed = F.crc32(F.col("doc_id").cast("string"))

    def planted(words: Column) -> Column:
        """The words, from a number a on repeated with a period p."""
        n, g = F.size(words).cast("long"), F.floor(hashed / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " "))

    text = F.coalesce("text", F.lit(""))
    text = F.when(F.coalesce(hashed % 10 == 0, F.lit(False)), let(rules.words_of(text), planted)).otherwise(text)
    return periodic.digests(periodic.find(docs, text_col=text))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier,
        "op2_bpe_trie": bpe_trie,
        "op3_source_mixing": source_mixing,
        "op4_toxic_kernel": toxic_kernel,
        "op5_exact_dedup_index": exact_dedup_index,
        "op6_suffix_array_dedup": suffix_array_dedup,
        "op7_ngram_jaccard": ngram_jaccard,
        "op8_chat_format": chat_format,
        "op9_quality_rules": quality_rules,
        "op10_token_id_files": token_id_files,
        "op11_simhash_tiles": simhash_tiles,
        "op12_merkle_manifest": merkle_manifest,
        "op13_periodic_runs": periodic_runs,
    }


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""

#: The mix takes each target's whole words, so its sums by source and bounds by document are fixed; which documents are taken twice
#: goes by a hash that DuckDB lacks, so op3 has no SQL and is tested against brute force.
OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS safe,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS first FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN first THEN length('<s>[INST]</s>') + length(role) ELSE length('[/INST]') END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


#: DuckDB has no crc32: eight steps for each digit of the id.
CRC32_SQL = r"""crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
)"""

def _leaf(n_chars: str) -> str:
    told = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    return f"sha256({' || '.join(told(c) for c in ('d.doc_id', 'source', 'lang', n_chars, 'text'))})"


#: Both trees level by level, and each leaf's way up them: a step is its node's slot and, after it, the sibling's digest.
OP12_SQL = rf"""
WITH RECURSIVE {CRC32_SQL}, told AS (
  SELECT d.doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN h % 7 = 0 THEN {_leaf('(n_chars + 1)')} END AS changed
  FROM documents d LEFT JOIN crc c ON d.doc_id = c.doc_id
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM told
), nodes AS (
  SELECT lang, 0 AS l, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, l, i // 2
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS l, i, n, h FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY l, i // 2
), own AS (
  SELECT lang, i, unnest(range(64)) AS l FROM leaves
), steps AS (
  SELECT o.lang, o.i, list(CAST((o.i >> o.l) % 2 AS VARCHAR) || coalesce(s.h, '') ORDER BY o.l) AS path
  FROM own o JOIN nodes x ON x.lang IS NOT DISTINCT FROM o.lang AND x.l = o.l AND x.i = o.i >> o.l AND x.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.l = o.l AND s.i = xor(o.i >> o.l, 1) GROUP BY o.lang, o.i
), top_steps AS (
  SELECT o.lang, list(CAST((o.i >> x.l) % 2 AS VARCHAR) || coalesce(s.h, '') ORDER BY x.l) AS path
  FROM subroots o JOIN tops x ON x.i = o.i >> x.l AND x.n > 1 LEFT JOIN tops s ON s.l = x.l AND s.i = xor(x.i, 1) GROUP BY o.lang
), whole AS (
  SELECT v.doc_id, v.leaf, coalesce(v.changed, v.leaf) AS now, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
    list_concat(coalesce(s.path, []), coalesce(t.path, [])) AS path
  FROM leaves v JOIN subroots r ON v.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN steps s ON v.lang IS NOT DISTINCT FROM s.lang AND v.i = s.i LEFT JOIN top_steps t ON v.lang IS NOT DISTINCT FROM t.lang
), folded AS (
  SELECT *, list_reduce(list_concat([now], path), lambda h, x: sha256(CASE WHEN x[1] = '1' THEN x[2:] || h ELSE h || x[2:] END)) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

#: Equal words of a text at each distance, islands of them, and the smallest distance of each stretch.
OP13_SQL = rf"""
WITH {CRC32_SQL}, split AS (
  SELECT d.doc_id, coalesce(c.h, 1) AS h, list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents d LEFT JOIN crc c ON d.doc_id = c.doc_id
), sized AS (
  SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), planned AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM planned
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i AS i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
), islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM equal GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)
), runs AS (
  SELECT doc_id, s, len, min(q) AS q FROM islands GROUP BY doc_id, s, len
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first(struct_pack(s := s, len := len, q := q) ORDER BY len DESC, s, q) AS top FROM runs GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.len AS BIGINT) AS length, CAST(top.q AS BIGINT) AS period,
  CAST(1000 * top.len // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN told ON t.doc_id = told.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup_index": OP5_SQL, "op8_chat_format": OP8_SQL, "op12_merkle_manifest": OP12_SQL, "op13_periodic_runs": OP13_SQL}
