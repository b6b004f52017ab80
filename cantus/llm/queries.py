"""The operators' registered queries and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, clustering, collocations, exact_dedup, near_dedup, packing, sharding, suffix_dedup, token_counts, token_files, topk, toxicity


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; CANTUS_TOKENIZERS names another folder."""
    if folder := os.environ.get("CANTUS_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.maxscore_topk(items, items.filter("id % 100 = 0"), 10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(more)))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.balanced_tree(2, 2, 2))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ball_kmeans(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS copy FROM documents),
            g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AND d.copy = 1 AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g USING (t)""",
        "op5_topk": """
            WITH v AS (SELECT row_number() OVER () AS row, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
            s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
                  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 10""",
        "op10_chat": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
            f AS (SELECT *, len(text) + len(regexp_replace(text, '[^\\<>\[]', '', 'g')) AS escaped, len(role) + len(regexp_replace(role, '[^\\<>\[]', '', 'g')) AS named FROM c)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                   coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(CASE WHEN role = 'assistant' THEN escaped + 4 ELSE escaped + named + 17 END)::BIGINT AS formatted_chars
            FROM f GROUP BY conv_id""",
        "op11_sharding": """
            WITH crcs AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
            bytes AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
                      [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
            d AS (SELECT doc_id, key, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS crc FROM bytes, crcs),
            nodes AS (SELECT * FROM (VALUES (0, '', 'g0', 4), (0, '', 'g1', 4), (0, '', 'g8+', 1)) v(level, parent, node, weight)
                      UNION ALL SELECT 1, 'g' || g, 'g' || g || '/k' || k, 2 FROM range(2) a(g), range(2) b(k)
                      UNION ALL SELECT 2, 'g' || g || '/k' || k, 'g' || g || '/k' || k || '/' || (4 * g + 2 * k + s), 1 FROM range(2) a(g), range(2) b(k), range(2) c(s)),
            draws AS (SELECT key, level, parent, node, -ln((('0x' || substr(md5(node || ':' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496) / weight AS draw FROM (SELECT DISTINCT key FROM d), nodes),
            best AS (SELECT key, parent, arg_min(node, draw) FILTER (node <> 'g8+') AS node, arg_min(node, draw) = 'g8+' AS moved FROM draws GROUP BY key, parent),
            s AS (SELECT r.key, split_part(z.node, '/', 3)::INTEGER AS shard, r.moved FROM best r JOIN best k ON k.key = r.key AND r.parent = '' AND k.parent = r.node JOIN best z ON z.key = r.key AND z.parent = k.node)
            SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || ':' || crc), 1, 13), doc_id NULLS FIRST, crc, size) - 1 AS slot,
                   CASE WHEN moved THEN 8 ELSE shard END AS grown_shard
            FROM d JOIN s USING (key)""",
        "op12_collocations": r"""
            WITH pieces AS (SELECT row_number() OVER () AS piece, lang, piece AS t FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
            words AS (SELECT lang, [w FOR w IN regexp_split_to_array(t, '[\x20\x09]+') IF w <> ''] AS w FROM pieces),
            total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
            grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) r(m))),
            f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
            cuts AS (SELECT lang, m, phrase, f, k, string_split(phrase, ' ') AS w FROM f, range(1, 5) r(k) WHERE k < m),
            scored AS (SELECT c.lang, c.m, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, n, 1000 * c.f * n // (x.f * y.f) AS score
                       FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
            best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            inside AS (SELECT DISTINCT g.lang, array_to_string(g.w[i:i + s - 1], ' ') AS phrase, g.f FROM (SELECT lang, m, f, string_split(phrase, ' ') AS w FROM f WHERE m > 2) g, range(2, 5) a(s), range(1, 5) b(i) WHERE s < g.m AND i + s - 1 <= g.m),
            kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 100 * b.a)),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
            SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, k AS cut FROM ranked WHERE rank <= 2000""",
        "op13_clustering": """
            WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) > 2097152]) = 0),
            c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v)::INTEGER - 1 AS number, v FROM v QUALIFY number < 16),
            a1 AS MATERIALIZED (SELECT row, arg_min(c.number, 4096 * d + c.number) AS cluster, min(d) AS distance FROM (
                    SELECT v.row, c.number, list_sum([(v.v[i] - c.v[i]) * (v.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, c0 c) c GROUP BY row),
            c1 AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c0 c LEFT JOIN (
                    SELECT cluster, list(floor_ ORDER BY i) AS v FROM (SELECT a.cluster, u.i, (sum(v.v[u.i]) - ((sum(v.v[u.i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
                        FROM a1 a JOIN v USING (row), range(1, 65) u(i) GROUP BY a.cluster, u.i) GROUP BY cluster) m ON m.cluster = c.number),
            a2 AS MATERIALIZED (SELECT row, arg_min(c.number, 4096 * d + c.number) AS cluster, min(d) AS distance FROM (
                    SELECT v.row, c.number, list_sum([(v.v[i] - c.v[i]) * (v.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, c1 c) c GROUP BY row),
            c2 AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c1 c LEFT JOIN (
                    SELECT cluster, list(floor_ ORDER BY i) AS v FROM (SELECT a.cluster, u.i, (sum(v.v[u.i]) - ((sum(v.v[u.i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
                        FROM a2 a JOIN v USING (row), range(1, 65) u(i) GROUP BY a.cluster, u.i) GROUP BY cluster) m ON m.cluster = c.number),
            a3 AS MATERIALIZED (SELECT row, arg_min(c.number, 4096 * d + c.number) AS cluster, min(d) AS distance FROM (
                    SELECT v.row, c.number, list_sum([(v.v[i] - c.v[i]) * (v.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, c2 c) c GROUP BY row),
            c3 AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c2 c LEFT JOIN (
                    SELECT cluster, list(floor_ ORDER BY i) AS v FROM (SELECT a.cluster, u.i, (sum(v.v[u.i]) - ((sum(v.v[u.i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
                        FROM a3 a JOIN v USING (row), range(1, 65) u(i) GROUP BY a.cluster, u.i) GROUP BY cluster) m ON m.cluster = c.number),
            a4 AS MATERIALIZED (SELECT row, arg_min(c.number, 4096 * d + c.number) AS cluster, min(d) AS distance FROM (
                    SELECT v.row, c.number, list_sum([(v.v[i] - c.v[i]) * (v.v[i] - c.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v, c3 c) c GROUP BY row),
            sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a4 GROUP BY cluster)
            SELECT v.vec_id, a.cluster, a.distance, s.cluster_inertia, (SELECT sum(distance) FROM a4)::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
            FROM a4 a JOIN v USING (row) JOIN sums s USING (cluster) JOIN c3 c ON c.number = a.cluster""",
    }
