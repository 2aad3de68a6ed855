"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import centroids, chat, embedding_dedup, infill, jaccard, lm, mixing, neighbours, packing, pii, quality, sharding, warc
from .common import prepare, pseudonym_key, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


@query("op5_shard_lookup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places every document on one of 64 shards by the permutation-filled table."""
    return sharding.place(read_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


@query("op8_config_lp_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 ids."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM rows),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM units GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src, sum(source_size) OVER ()::BIGINT AS budget FROM sizes),
weighed AS (SELECT *, CASE (src - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS here
  FROM weighed WINDOW o AS (ORDER BY cap / w, src)),
targets AS (SELECT source, src, source_size, budget, least(cap::DOUBLE, max(here) OVER () * w) AS target FROM levels),
queued AS (
  SELECT u.*, t.src, t.source_size, t.budget, t.target,
         md5('mix-1|' || coalesce(u.doc_id::VARCHAR, 'null') || '|' || u.size) AS h
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
upto AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS cum
         FROM queued WHERE size > 0),
passes AS (SELECT *, (cum + pass * source_size)::DOUBLE / target AS finish FROM upto, (SELECT unnest([0, 1, 2]) AS pass)),
totals AS (SELECT *, sum(size) OVER (ORDER BY finish, src, h, doc_id NULLS FIRST, size, pass, copy ROWS UNBOUNDED PRECEDING) AS total
           FROM passes),
taken AS (SELECT doc_id, source, size, copy, sum((total <= budget)::BIGINT) AS n FROM totals GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken
FROM queued q
LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.source IS NOT DISTINCT FROM t.source AND q.size = t.size AND q.copy = t.copy
"""


@query("op9_weighted_fair_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to the source targets; a row per document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    rows = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
measured AS (
  SELECT *, 23 + length(regexp_replace(role, '[\\<\[]', '..', 'g')) + length(regexp_replace(text, '[\\<\[]', '..', 'g')) AS chars,
         role = 'assistant' AS trained
  FROM turns),
numbered AS (
  SELECT *, sum(chars) OVER o AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM measured WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (trained), '')) AS loss_sha256,
       (sum(upto) FILTER (trained OR back = 1))::BIGINT AS formatted_chars,
       (count(*) FILTER (trained OR back = 1))::BIGINT AS n_examples
FROM numbered GROUP BY conv_id
"""


@query("op10_prefix_target_chat", CHAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one whose texts hold control strings, and reads them back."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)],
                                  "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.expand(turns), grouped=True)


WARC_SQL = r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (
  SELECT *, list_aggregate(list_transform(range(40), lambda i: substr(
      '0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(h, (i + 1)::INT, 1))::INT - 3, 4)),
      'string_agg', '') AS b
  FROM hashed),
named AS (
  SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * substr(b, (5 * i + 1)::INT, 1)::INT + 8 * substr(b, (5 * i + 2)::INT, 1)::INT + 4 * substr(b, (5 * i + 3)::INT, 1)::INT
        + 2 * substr(b, (5 * i + 4)::INT, 1)::INT + substr(b, (5 * i + 5)::INT, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
      min(page_id) OVER (PARTITION BY h) AS first
  FROM bits)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""


@query("op2_warc_merged_index", WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives, reads them back and merges their index. The table has no
    capture time; a page's is its id in seconds after 2024-01-01."""
    pages = read_table(spark, sf_dir, "pages")
    captured = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages.withColumn("captured", captured), path)
    index = warc.capture_index(spark, path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document by the quadratic discriminant."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op3_feistel_pseudonyms")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for the personal data in their texts."""
    return pii.mask(read_table(spark, sf_dir, "documents"), pseudonym_key(spark))


NEAREST_SQL = r"""
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
queries AS (SELECT vec_id, min(v) AS v FROM usable WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, u.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1),
           lambda i: (q.v[i] - u.v[i]) * (q.v[i] - u.v[i])), lambda a, b: a + b)) AS score
  FROM queries q JOIN usable u ON q.vec_id <> u.vec_id AND len(q.v) = len(u.v))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


@query("op4_vantage_point_search", NEAREST_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


DEDUP_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a
  JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS r FROM embeddings UNION SELECT l.x, reach.r FROM reach JOIN links l ON l.y = reach.x)
SELECT x AS vec_id, (SELECT count(*) FROM links l WHERE l.x = reach.x)::BIGINT AS n_links, min(r) AS component_id, min(r) = x AS kept
FROM reach GROUP BY x
"""


@query("op7_multi_index_dedup", DEDUP_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels, over all rows."""
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM shingles),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * ((SELECT len(s) FROM shingles z WHERE z.doc_id = a.doc_id) + (SELECT len(s) FROM shingles z WHERE z.doc_id = b.doc_id) - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT l.x, reach.r FROM reach JOIN both_ways l ON l.y = reach.x),
least AS (SELECT x, min(r) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM shingles JOIN least ON x = doc_id
"""


@query("op6_partition_jaccard_join", JACCARD_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets reach a Jaccard similarity of 0.85."""
    return jaccard.join(read_table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op11_attention_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and unigram scores of all documents."""
    return lm.score_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _cluster_sql(rounds: int) -> str:
    """The rounds one after another: assignment a<i> to centroids c<i>, then centroids c<i + 1>."""
    parts = [r"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
             """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < 8)"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, vec_id, k.v, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT, 'c': c.c}}) AS m
  FROM kept k, c{i} c GROUP BY rid, vec_id, k.v)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY m.c, i) GROUP BY c) n
  ON o.c = n.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.m.c = c.c
"""


@query("op12_mean_variance_clusters", _cluster_sql(10))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of integer k-means over all vectors of 64 components, 8 centroids."""
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


INFILL_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT *, array_to_string(u[1 : least(one, two)], '') AS p, array_to_string(u[least(one, two) + 1 : greatest(one, two)], '') AS m,
         array_to_string(u[greatest(one, two) + 1 : n], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query("op13_word_parallel_infill", INFILL_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle examples of all documents, and the texts read back from them."""
    made = infill.infill(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
