"""The registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telvane.llm import (
    op1_skip_chain_pii,
    op2_schema_fingerprints,
    op3_language_filters,
    op4_simhash_windows,
    op5_adaptive_quality,
    op6_signature_trees,
    op7_two_stage_suffixes,
    op8_context_mixing,
    op9_temperature_mixing,
    op10_prefix_shards,
    op11_phrase_stripes,
    op12_line_runs,
    op13_exact_whitening,
)
from telvane.llm.common import documents
from telvane.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package()
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op3_language_filters_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_language_filters.identify_languages(documents(spark, sf_dir))


@query
def op4_simhash_windows_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4_simhash_windows.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op6_signature_trees_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_signature_trees.jaccard_components(documents(spark, sf_dir))


@query
def op9_temperature_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = op9_temperature_mixing.mix(documents(spark, sf_dir), repeats=2.0)
    return mixed.select("doc_id", "source", "mix_source_tokens", "mix_budget", "mix_copy", "mix_copies", "mix_group", "mix_block", "mix_rank")


@query
def op10_prefix_shards_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op10_prefix_shards.shard(op10_prefix_shards.sized(documents(spark, sf_dir)), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_schema_fingerprints_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return op2_schema_fingerprints.format_conversations(rows.unionByName(extra))


@query
def op5_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_adaptive_quality.judge(documents(spark, sf_dir))


@query
def op1_skip_chain_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_skip_chain_pii.find_personal_data(documents(spark, sf_dir))


@query
def op7_two_stage_suffixes_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_two_stage_suffixes.remove_repeats(documents(spark, sf_dir))


@query
def op8_context_mixing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_context_mixing.score(documents(spark, sf_dir))


@query
def op12_line_runs_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = op12_line_runs.drop_repeated_lines(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op12_line_runs_drop"] = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
repeated AS (SELECT key FROM keys WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM repeated)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE key NOT IN (SELECT key FROM repeated)), '')) AS kept_sha256
FROM keys GROUP BY rid
"""


@query
def op11_phrase_stripes_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrase_stripes.first_of_each(op11_phrase_stripes.mine_phrases(documents(spark, sf_dir)))


ORACLES["op11_phrase_stripes_mine"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
pieces AS (SELECT rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
numbered AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT pid, lang, unnest(w) AS w1, unnest(w[2:] || [NULL]) AS w2, unnest(w[3:] || [NULL, NULL]) AS w3 FROM numbered WHERE len(w) > 0),
f1 AS (SELECT lang, w1, count(*) AS f FROM words WHERE w1 IS NOT NULL GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM words WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM words WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (FROM f3 t WHERE t.lang = p.lang AND t.w1 = p.w1 AND t.w2 = p.w2 AND 100 * t.f >= 50 * p.f)
    AND NOT EXISTS (FROM f3 t WHERE t.lang = p.lang AND t.w2 = p.w1 AND t.w3 = p.w2 AND 100 * t.f >= 50 * p.f)
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3
),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN sizes USING (lang) QUALIFY rank <= 2000
"""


@query
def op13_exact_whitening_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_exact_whitening.whiten(documents(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


query(pipeline)
