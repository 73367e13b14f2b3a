"""The registered queries of this subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.llm.decontaminate import benchmark_passages
from evalframe.llm.license_scan import license_scan
from evalframe.llm.line_dedup import dedup_lines
from evalframe.llm.ngram_join import ngram_join
from evalframe.llm.packing import pack_documents
from evalframe.llm.prefix_trie import prefix_trie
from evalframe.llm.quality import quality
from evalframe.llm.sharding import key_shard, row_size, shard_documents, SHARDS
from evalframe.llm.shared import table
from evalframe.llm.spelling import spelling_variants
from evalframe.llm.token_counts import token_counts
from evalframe.llm.tokenfile import token_files
from evalframe.llm.toxicity import toxicity
from evalframe.llm.vector_join import vector_join
from evalframe.plans.common import Registry

reg = Registry()


OP3_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM doc),
sizes AS (SELECT doc_id, len(g) AS n FROM grams),
flat AS (SELECT doc_id, unnest(g) AS gram FROM grams),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM flat x JOIN flat y USING (gram)
          WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
          WHERE 100 * k >= 80 * (s.n + t.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, s.n AS n_shingles, min(r.b) AS component_id, CASE WHEN s.n > 0 THEN any_value(c.m) END AS n_class
FROM sizes s JOIN reach r ON r.a = s.doc_id
JOIN (SELECT x.doc_id, count(*) OVER (PARTITION BY list_sort(x.g)) AS m FROM grams x) c ON c.doc_id = s.doc_id
GROUP BY s.doc_id, s.n
"""


@reg.add("op3_ngram_join", OP3_SQL)
def op3_ngram_join(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


@reg.add("op2_pack_documents")
def op2_pack_documents(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


@reg.add("op4_token_files")
def op4_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP9_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
sums AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS thru, thru - w AS before
  FROM (SELECT *, len(regexp_extract_all(line, '[^ 	-
]+')) AS w FROM line)),
runs AS (
  SELECT a.doc_id, a.pos, b.pos AS last, array_to_string(d.l[a.pos + 1:b.pos + 1], chr(10)) AS run
  FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos
  JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d ON d.doc_id = a.doc_id
  WHERE b.thru - a.before >= 50 AND (b.before - a.before < 50 OR b.thru - a.thru < 50)),
later AS (
  SELECT doc_id, pos, last FROM (
    SELECT *, row_number() OVER (PARTITION BY run, last - pos ORDER BY doc_id, pos) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, last)) AS pos FROM later),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@reg.add("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@reg.add("op7_quality")
def op7_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@reg.add("op8_sharding")
def op8_sharding(spark, sf_dir):
    text = F.col("row.text")
    read = shard_documents(table(spark, sf_dir, "documents"), F.col("row.doc_id").alias("doc_id"),
                           row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    return read.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                       key_shard(F.col("doc_id"), SHARDS + 1).alias("grown_shard"))


@reg.add("op5_benchmark_passages")
def op5_benchmark_passages(spark, sf_dir):
    return benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@reg.add("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


@reg.add("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


@reg.add("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# CRC-32 in SQL: a table of 256 remainders, then one step for each byte.
CRC_TABLE = """crc_table AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
  xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) FOR i IN range(0, 256)] AS t)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of SQL expression ``text``, over ``crc_table``."""
    code = f"hex(encode({text}))"
    return (f"xor(list_reduce([CAST('0x' || substr({code}, 2 * j + 1, 2) AS BIGINT) FOR j IN range(0, len({code}) // 2)], "
            "lambda c, b: xor(c >> 8, crc_table.t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)")


OP11_SQL = rf"""
WITH {CRC_TABLE},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                 sha256(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h
          FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), crc_table),
heads AS (SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h),
tails AS (SELECT c.conv_id, t.pos - c.h + coalesce(s.k, 0) AS depth, t.role, t.text
          FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
          LEFT JOIN (SELECT conv_id, count(*) AS k FROM heads GROUP BY conv_id) s ON s.conv_id = c.conv_id),
seqs AS (SELECT c.conv_id, coalesce(q.s, []) AS s FROM convs c LEFT JOIN (
           SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY depth) AS s
           FROM (SELECT * FROM heads UNION ALL SELECT * FROM tails) GROUP BY conv_id) q ON q.conv_id = c.conv_id),
steps AS (SELECT conv_id, unnest(generate_series(0, len(s))) AS depth, s FROM seqs),
members AS (SELECT conv_id, depth, len(s) AS total, s[1:depth] AS p, s[depth].x AS last FROM steps),
nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(len(regexp_extract_all(any_value(last), '[^ 	-]+')), 0) AS words,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
          FROM members GROUP BY p, depth),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth),
ups AS (SELECT p, depth, unnest(generate_series(0, depth)) AS d, n_children, n_convs, words FROM own),
sums AS (SELECT p[1:d] AS p, d AS depth, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
           CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM ups GROUP BY 1, 2)
SELECT o.conv_id, o.depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON s.p = o.p AND s.depth = o.depth
LEFT JOIN own q ON o.depth > 0 AND q.depth = o.depth - 1 AND q.p = o.p[1:o.depth - 1]
"""


@reg.add("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS k FROM embeddings),
fine AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT k, vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS u FROM fine),
links AS (SELECT a.k AS a, b.k AS b FROM unit a JOIN unit b ON a.k <> b.k AND len(a.u) = len(b.u)
          WHERE list_dot_product(a.u, b.u) >= 0.95),
reach AS (SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT r.a, min(w.vec_id) AS component_id FROM reach r JOIN v w ON w.k = r.b GROUP BY r.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.a = v.k LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.k
"""


@reg.add("op12_vector_join", OP12_SQL)
def op12_vector_join(spark, sf_dir):
    return vector_join(table(spark, sf_dir, "embeddings"))


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
marked AS (SELECT doc_id, w, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h
           FROM (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w), crc_table),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM marked)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS x
         FROM (SELECT word, unnest(generate_series(0, length(word) - 1)) AS i FROM vocab)),
near AS (SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
         UNION SELECT l.word, v.word FROM less l JOIN vocab v ON v.word = l.x
         UNION SELECT v.word, l.word FROM less l JOIN vocab v ON v.word = l.x),
best AS (SELECT p.word, count(*) AS n_near, max(v.n) AS top FROM near p JOIN vocab v ON v.word = p.near GROUP BY p.word),
forms AS (SELECT b.word, b.n_near, b.top, min(p.near) AS form FROM best b JOIN near p ON p.word = b.word
          JOIN vocab v ON v.word = p.near AND v.n = b.top GROUP BY b.word, b.n_near, b.top),
named AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.top >= 10 * v.n THEN f.form END AS form,
          CASE WHEN f.top >= 10 * v.n THEN f.top END AS form_n FROM vocab v LEFT JOIN forms f ON f.word = v.word),
walk AS (SELECT word, word AS here, 0 AS d FROM named UNION ALL
         SELECT w.word, n.form, w.d + 1 FROM walk w JOIN named n ON n.word = w.here WHERE n.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, d) AS root FROM walk GROUP BY word)
SELECT n.word, n.form, e.root, n.n, n.n_near, n.form_n FROM named n JOIN ends e ON e.word = n.word
"""


@reg.add("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries():
    return reg.queries


def oracle_sql():
    return reg.oracle
