"""The registered queries: every operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from episodica.llm import (
    collocations,
    decontamination,
    mixing,
    perplexity,
    pseudonyms,
    secret_scan,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_counts,
    warc,
)
from episodica.llm.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

#: A real run takes its key from a key store; this one makes the query repeatable.
DEMO_KEY = b"key of the registered query"

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), f AS (
  SELECT s, min(doc_id) AS m FROM g GROUP BY s
), r AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 13)) AS p FROM g JOIN f USING (s) WHERE f.m < g.doc_id)
), k AS (
  SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) x
  ANTI JOIN r ON x.doc_id = r.doc_id AND x.p = r.p
  GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.original > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.original > p.page_id THEN g.original END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS slot, i::BIGINT AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT slot, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc AS (
  SELECT list(c ORDER BY slot) AS tab FROM bits WHERE step = 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run
), digests AS (
  SELECT run, n, length(run) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key), 2),
           lambda i: ((instr('0123456789ABCDEF', key[i]) - 1) * 16 + instr('0123456789ABCDEF', key[i + 1]) - 1)::BIGINT)),
           lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS h
  FROM (SELECT run, n, hex(encode(concat(doc_id::VARCHAR, ':', run))) AS key FROM counted), crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(run[:h % size], run[h % size + 2:]) ELSE run END AS word, n FROM digests)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, concat(word[:i - 1], word[i + 1:]) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT less.word, words.word, words.n FROM less JOIN words ON less.rest = words.word
  UNION
  SELECT words.word, less.word, less.n FROM less JOIN words ON less.rest = words.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n,
         CASE WHEN b.form_n >= 2 * w.n THEN (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.other_n = b.form_n) END AS form
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word WHERE c.next IS NULL
"""


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lines AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) + 2 - size)) AS i FROM lines, (SELECT unnest([1, 2, 3, 4]) AS size))
), f AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lines GROUP BY lang
), inside AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, f, array_to_string(w[i:i + part - 1], ' ') AS phrase
        FROM (SELECT lang, f, w, part, unnest(range(1, size + 2 - part)) AS i FROM f, (SELECT unnest([2, 3]) AS part) WHERE part < size))
  GROUP BY lang, phrase
), cuts AS (
  SELECT f.lang, f.phrase, f.f AS a, f.w, unnest(range(1, f.size)) AS k
  FROM f LEFT JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase
  WHERE f.size > 1 AND (i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * f.f)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best
)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN totals t USING (lang) WHERE k.rank <= 2000
"""


@query("op1_de_bruijn_dedup", SUBSTRING_SQL)
def de_bruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"), keep_text=False)


@query("op2_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_md5")


@query("op3_perplexity_quality")
def perplexity_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(table(spark, sf_dir, "documents")).drop("text_md5")


@query("op4_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), keep_text=False)


@query("op5_minimax_sharding")
def minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


@query("op6_pfair_mixing")
def pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_warc_revisits", WARC_SQL)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_feistel_pseudonyms")
def feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY)


@query("op10_secret_ownership")
def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants", SPELLING_SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents"), least_chars=5, slip_every=97)
    return spelling.variant_groups(words.filter("n >= 3"))


@query("op12_phrase_collocations", COLLOCATION_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
