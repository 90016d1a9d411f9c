"""The queries of the training-data operators and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from marlstone.llm import byte_bpe, chat_format, decontaminate, exact_dedup, html_extract, lang_id, license_scan, near_dedup, quality, warc
from marlstone.llm.shared import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; of equal texts the row with the largest doc_id stays."""
    return exact_dedup.classify(table(spark, sf_dir, "documents"), keep="largest")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `conversations` and one conversation of control strings."""
    return chat_format.op2_chat_format(spark, table(spark, sf_dir, "conversations"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`, written as archives and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.captures(warc.assemble(warc.read_records(spark, path)))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`: components of links at a similarity of 0.85."""
    return near_dedup.op4_minhash_near_dedup(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; SQL has no such model."""
    return lang_id.op5_language_id(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`; SQL can't parse markup."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`."""
    return decontaminate.op7_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, encoded and decoded; SQL has no BPE."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, learning from `labels`; SQL has no such model."""
    return quality.op9_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` as files of a directory tree."""
    return license_scan.op10_license_scan(table(spark, sf_dir, "documents"))


SQL_OP1 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

SQL_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant'
                     ELSE role = 'user' END)
         AND last(role ORDER BY turn, role, text) IN ('user', 'assistant') AS valid
FROM s GROUP BY conv_id
"""


SQL_OP7 = r"""
WITH word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM word
), hit AS (
  SELECT doc_id, i, win.n, item_id
  FROM place JOIN win ON array_to_string(w[i:i + 9], ' ') = key AND win.n = 10
  UNION ALL
  SELECT doc_id, i, win.n, item_id
  FROM place JOIN (SELECT * FROM win WHERE n < 10) win ON array_to_string(w[i:i + win.n - 1], ' ') = key
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT word.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


SQL_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS page_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first.page_id IS NULL OR first.page_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first.page_id <> p.page_id THEN first.page_id END AS refers_to
FROM p LEFT JOIN first ON p.html = first.html
"""


#: Links by joining on shingles, components by spreading the smallest id; equal sets are one node. Quadratic in groups of copies.
SQL_OP4 = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM word WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM shingle GROUP BY doc_id
), class AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole, n) AS rep FROM size
), kept AS (
  SELECT shingle.doc_id, s, n FROM shingle JOIN class ON shingle.doc_id = class.doc_id AND class.rep = class.doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM kept a JOIN kept b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(id, low) AS (
  SELECT rep, rep FROM class UNION SELECT edge.b, reach.low FROM reach JOIN edge ON edge.a = reach.id AND reach.low < edge.b
)
SELECT word.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, word.doc_id) AS component_id, word.doc_id = coalesce(low, word.doc_id) AS kept
FROM word LEFT JOIN class ON word.doc_id = class.doc_id LEFT JOIN (SELECT id, min(low) AS low FROM reach GROUP BY id) r ON r.id = class.rep
"""


def sql_op10() -> str:
    """The licence scan in SQL, from the same templates."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(license_scan.TEMPLATES))
    anchor, name, token = (quoted(x) for x in (license_scan.ANCHOR, license_scan.LICENSE_FILE, license_scan.TOKEN))
    return f"""
    WITH template(place, name, said) AS (VALUES {templates}),
    ttf AS (SELECT place, name, lower(word) AS word, count(*) AS tf FROM (SELECT place, name, unnest(regexp_extract_all(said, {token})) AS word FROM template) GROUP BY ALL),
    vocab AS (SELECT DISTINCT word FROM ttf),
    n AS (SELECT count(*) AS n FROM documents),
    df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT rowid AS r, lower(unnest(regexp_extract_all(coalesce(text, ''), {token}))) AS word FROM (SELECT row_number() OVER () AS rowid, text FROM documents)) JOIN vocab USING (word) GROUP BY word),
    idf AS (SELECT vocab.word, ln((1.0 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (word), n),
    tw AS (SELECT place, name, word, tf * idf AS w FROM ttf JOIN idf USING (word)),
    tnorm AS (SELECT place, sqrt(sum(w * w)) AS norm FROM tw GROUP BY place),
    unit AS (SELECT tw.place, name, word, w / norm AS w FROM tw JOIN tnorm USING (place)),
    file AS (
      SELECT doc_id, text, CASE WHEN doc_id % 80 = 0 THEN coalesce(source, 'none') || '/LICENSE'
             WHEN doc_id % 40 = 0 THEN coalesce(source, 'none') || '/d' || (doc_id % 7) || '/LICENSE.txt'
             ELSE coalesce(source, 'none') || '/d' || (doc_id % 7) || '/e' || (doc_id % 5) || '/f' || doc_id || '.txt' END AS path FROM documents),
    line AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM file WHERE regexp_matches(text, {anchor}))),
    ltf AS (SELECT doc_id, line, lower(word) AS word, count(*) AS tf FROM (SELECT doc_id, line, unnest(regexp_extract_all(said, {token})) AS word FROM line WHERE regexp_matches(said, {anchor})) GROUP BY ALL),
    lw AS (SELECT doc_id, line, word, tf * coalesce(idf, ln(1.0 + n) + 1) AS w FROM ltf LEFT JOIN idf USING (word), n),
    lnorm AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
    sim AS (SELECT lw.doc_id, lw.line, place, name, round(sum(lw.w * unit.w) / any_value(norm), 9) AS score FROM lw JOIN unit USING (word) JOIN lnorm ON lw.doc_id = lnorm.doc_id AND lw.line = lnorm.line GROUP BY ALL),
    own AS (SELECT doc_id, name AS own_license, score AS own_score FROM sim WHERE score >= {license_scan.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, place) = 1),
    f AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score FROM file LEFT JOIN own USING (doc_id)),
    listed AS (SELECT dir, own_license FROM f WHERE own_license IS NOT NULL AND regexp_matches(regexp_extract(path, '[^/]*$'), {name}) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path, own_license) = 1),
    near AS (SELECT d.dir, l.dir AS license_dir, l.own_license AS dir_license FROM (SELECT DISTINCT dir FROM f) d JOIN listed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/') OR l.dir = '' QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(l.dir) DESC) = 1)
    SELECT doc_id, path, own_license, round(own_score, 4) AS own_score, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN license_dir END AS license_dir
    FROM f LEFT JOIN near ON f.dir = near.dir
    """


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all of `documents`."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """Name to a function of (spark, sf_dir)."""
    ops = (op1_exact_dedup, op2_chat_format, op3_warc, op4_minhash_near_dedup, op5_language_id, op6_html_extract, op7_decontaminate, op8_byte_bpe, op9_quality, op10_license_scan, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL over views named as the tables."""
    found = {"op1_exact_dedup": SQL_OP1, "op2_chat_format": SQL_OP2, "op3_warc": SQL_OP3, "op4_minhash_near_dedup": SQL_OP4, "op7_decontaminate": SQL_OP7, "op10_license_scan": sql_op10()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
