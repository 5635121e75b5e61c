"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, conversation_repair, decontamination, fingerprints, jaccard_join, lexical_search, licenses, packing, pii, pii_examples, quality, secrets, suffix_dedup, toxicity
from plumbline.llm.conversation_sql import op12_sql
from plumbline.llm.sampling import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer(), added=True)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES) + " AS t(template_id, text)")
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), templates)
    return found.select("doc_id", "n_matches", F.array_join(F.transform("licenses", lambda x: x["template_id"]), ",").alias("licenses"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT -7L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role)")
    planted = planted.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.render(chat.fold_events(chat.as_events(rows)))
    turns = chat.parse(F.col("formatted"))
    out = out.withColumn("turns", turns).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _scored(quality.score_quality(docs, model), 0.3)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(docs, model), 0.5)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secrets.scan(docs, secrets.train(docs)).select("doc_id", "spans")
    counts = {f"n_{k}": secrets.count(F.col("spans"), k) for k in secrets.KINDS[:3]}
    return spans.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(secrets.joined(F.col("spans"), secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.scan(docs, pii.train(pii_examples.labelled_table(spark))).select("doc_id", "spans")
    counts = {f"n_{k}": secrets.count(F.col("spans"), k) for k in pii.BASE}
    return spans.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(secrets.joined(F.col("spans"), pii.BASE), 256).alias("base_sha256"),
        secrets.joined(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(rows), every=rows)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH folded AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
pats AS (
  SELECT DISTINCT id AS item_id, size, array_to_string(w[i:i + size - 1], ' ') AS pat
  FROM (SELECT id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM folded WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM pats),
wins AS (
  SELECT id, i, size, array_to_string(w[i:i + size - 1], ' ') AS pat
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM folded, sizes WHERE side = 'd' AND len(w) >= size)),
occ AS (SELECT wins.id, i, wins.size, item_id FROM wins JOIN pats ON wins.size = pats.size AND wins.pat = pats.pat),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY id),
its AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY id)
SELECT f.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM folded f LEFT JOIN hit ON f.id = hit.id LEFT JOIN its ON f.id = its.id WHERE f.side = 'd'
"""

OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 1 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP2_SQL = (
    """
WITH t AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES)
    + """) AS t(template_id, text)),
f AS (SELECT template_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
ts AS (SELECT DISTINCT id AS template_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM f)),
tn AS (SELECT template_id, n, count(*) AS total FROM ts GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
h AS (SELECT DISTINCT doc_id, ts.template_id, ts.n, i, ts.s FROM ds JOIN ts USING (s)),
w AS (SELECT doc_id, template_id, n, s, i // n AS k FROM h UNION ALL SELECT doc_id, template_id, n, s, i // n - 1 FROM h WHERE i // n >= 1 AND i < (i // n - 1) * n + greatest(2 * n - 4, 1)),
c AS (SELECT doc_id, template_id, n, k, count(DISTINCT s) AS got FROM w GROUP BY ALL),
ok AS (SELECT DISTINCT doc_id, template_id FROM c JOIN tn USING (template_id, n) WHERE got >= 0.8 * total)
SELECT documents.doc_id, count(template_id) AS n_matches, coalesce(string_agg(template_id, ',' ORDER BY template_id), '') AS licenses
FROM documents LEFT JOIN ok USING (doc_id) GROUP BY documents.doc_id
"""
)

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scans": op2_license_scans,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_pii": op11_pii,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.a GROUP BY d.doc_id
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (
  SELECT r, term, count(*) AS tf FROM (
    SELECT r, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
  WHERE term <> '' GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY r),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_n FROM n),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM t, c WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_n)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (r), c GROUP BY item_id, r),
k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM s JOIN d USING (r) WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

_SQL = {
    "op5_ngram_jaccard_join": OP5_SQL,
    "op2_license_scans": OP2_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op12_conversation_repair": op12_sql(),
    "op13_lexical_search": OP13_SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
