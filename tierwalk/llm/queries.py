"""The registered queries of this subpackage and, where SQL can say it, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.llm import chat, counts, decontam, divergence, interactions, minhash, ordinal, phrases, sampling, suffixes, tokenfile, topk, toxicity
from tierwalk.llm.ship import ship
from tierwalk.workspace import Workspace


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{Workspace(spark, 'tokens').path}/ids"
    tokenfile.write(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    tokens = tokenfile.read(spark, path)
    rows = tokenfile.with_start(tokenfile.digest(tokens), tokens)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_sentencepiece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    tokens = sampling.encode(table(spark, folder, "documents"), model, decoded="text")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.to_json("ids"), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of three grades: 0 toxic, 1 neither toxic nor good, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ordinal.fit(docs, graded(table(spark, folder, "labels")), n_grades=3)
    scored = ordinal.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "expected_grade", "p_ge_1", "p_ge_2", (F.col("p_ge_2") >= 0.5).alias("kept"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") == 0).alias("kept"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.to_json("hits").alias("items"),
    )


def op3_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = phrases.cut_repeats(docs, window=35)
    joined = F.trim(F.regexp_replace("kept_text", r"[ \t-\r]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = suffixes.drop_repeats(docs, window=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    messages = rows.unionByName(probe).withColumn("parts", F.array(chat.text_part(F.col("text"))))
    chats = chat.format_chats(messages)
    read = chats.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_masked(F.col("formatted"), F.col("mask")).alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(11 + length(role) + length(text) + length(regexp_replace(role || text, '[^][<\\\\]', '', 'g')))::BIGINT
    AS formatted_chars
FROM rows GROUP BY conv_id
"""

def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", 1024)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), "vec_id", 10)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


OP3_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
    ELSE array_to_string(words[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)
), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least c ON c.doc_id = d.doc_id
"""

OP8_SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM starts
  WHERE passage IN (SELECT passage FROM starts GROUP BY passage HAVING count(*) > 1)
), places AS (
  SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN removed r ON r.doc_id = w.doc_id
"""

OP10_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS MATERIALIZED (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS passage
  FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), first AS MATERIALIZED (SELECT passage, min(doc_id) AS doc_id FROM starts GROUP BY passage HAVING min(doc_id) < max(doc_id)),
gone AS MATERIALIZED (
  SELECT DISTINCT s.doc_id, unnest(range(i, i + 50)) AS i
  FROM starts s JOIN first f ON f.passage = s.passage AND f.doc_id < s.doc_id
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS n_spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id
), places AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM d)),
kept AS (
  SELECT doc_id, string_agg(b, '' ORDER BY i) AS h FROM places p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
  coalesce(r.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def op11_filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    counted = interactions.outcomes(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return interactions.audit(counted, "ABCDE")


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), texts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
rated AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN least < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN texts ON texts.t = d.t LEFT JOIN rated ON rated.doc_id = d.doc_id
), cells AS MATERIALIZED (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
), judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(fails, letter) AS mine, fails = letter AS lonely,
    length(translate(fails, before, '')) < length(fails) AS gone FROM cells, steps
), out AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mine AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mine AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (lonely), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mine AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mine AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM out
"""


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    found = divergence.audit(table(spark, folder, "documents"), part="lang", group="source")
    return found.select(
        F.col("part").alias("lang"), F.col("grp").alias("source"), F.col("kind").alias("part"), "item", "value", "rank"
    )


OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS MATERIALIZED (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS MATERIALIZED (
  SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10
), groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
counts AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.total
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c
    ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS MATERIALIZED (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)) // ((sum(n) OVER s) + 2 * count(*) OVER s)::HUGEINT AS p,
    1 + (1000000000 * (total + 2)) // ((sum(total) OVER s) + 2 * count(*) OVER s)::HUGEINT AS q
  FROM counts WINDOW s AS (PARTITION BY lang, source)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), both_kinds AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term' AS part, item, value FROM terms
)
SELECT *, (row_number() OVER k)::INTEGER AS rank FROM both_kinds
WINDOW k AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER k <= 10
"""


def held_out(key: str) -> Column:
    """Whether a row is in the fifth that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op6_exact_topk": op6_exact_topk,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_source_divergence": op12_source_divergence,
    "op13_toxicity": op13_toxicity,
}

ORACLE = {
    "op3_minhash_dedup": OP3_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op11_filter_interactions": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op6_exact_topk": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
}
