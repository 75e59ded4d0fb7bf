"""The registered queries of the corpus operators: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import id_bucket, table
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.embed_dedup import similar_vectors
from graphloom.llm.line_dedup import drop_recurring_lines
from graphloom.llm.lm_score import score_texts
from graphloom.llm.packing import pack
from graphloom.llm.sharding import shard_by_bytes
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.suffix_dedup import remove_repeats
from graphloom.llm.token_counts import token_counts
from graphloom.llm.toxicity import score_toxicity, train_toxicity


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Fitted to the labelled rows that are not held out."""
    learn = F.col("doc_id").isNotNull() & (id_bucket("doc_id", 4) != 2)
    return train_toxicity(table(spark, sf_dir, "documents").where(learn), table(spark, sf_dir, "labels").where(learn))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    scored = score_toxicity(docs, toxicity_model(spark, sf_dir), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, with_kept=False)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram scores are those of Zipf's law over the ranks of a public vocabulary: tokenizers are not trained here."""
    return token_counts(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=64, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), length=1024, with_ids=False)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_bucket("doc_id", 10)
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", (fold != 0).alias("learn"), (fold == 0).alias("held_out")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontaminate": op3_decontaminate,
        "op4_token_counts": op4_token_counts,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_simhash": op6_simhash,
        "op7_histogram_shards": op7_histogram_shards,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixture_packing": op9_mixture_packing,
        "op10_lm_scores": op10_lm_scores,
    }


#: Cosine links within a label, and the least id reached over them.
_OP5 = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v
  where vec_id is not null and label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
pair as (select a.vec_id as u, b.vec_id as v from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.98),
reach as (select u, v from pair union select r.u, p.v from reach r join pair p on r.v = p.u),
links as (select u, count(*) as n from pair group by u), low as (select u, min(v) as c from reach group by u)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(c, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c, vec_id)) as kept
from embeddings left join links on links.u = vec_id left join low on low.u = vec_id
"""

#: The template tree with leaves and templates as text.
_OP8 = """
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from d),
k as (select doc_id, t, pos, string_split(regexp_replace(line, '[0-9]+', '#', 'g'), ' ') as w from l where regexp_matches(line, '[^ \\t\\r]')),
c as (select min(doc_id) as doc_id, t, pos, w, len(w) as n, len(w) || '|' || array_to_string(w[1:3], ' ') as leaf from k group by t, pos, w),
tok as (select leaf, t, pos, n, doc_id, unnest(w) as token, generate_subscripts(w, 1) as place from c where n >= 12),
f as (select leaf, place, token from tok where place > 3 group by leaf, place, token having count(*) >= 10),
tpl as (select leaf, t, pos, any_value(doc_id) as doc_id, any_value(n) as n, count(*) filter (where place <= 3 or f.token is not null) as fixed,
  string_agg(case when place <= 3 or f.token is not null then token else '*' end, ' ' order by place) as template
  from tok left join f using (leaf, place, token) group by leaf, t, pos),
keyed as (select doc_id, t, pos, 'w' || array_to_string(w, ' ') as key, case when n >= 50 then 2 else 10 end as enough from c where n < 12 or n >= 50
  union all select doc_id, t, pos, 't' || template, 10 from tpl where fixed >= n * 0.5),
r as (select key, arg_min(t, id) as first from (select key, t, min(doc_id) as id, any_value(enough) as enough from keyed group by key, t) group by key having count(*) >= any_value(enough)),
gone as (select distinct keyed.t, pos from keyed join r using (key) where t <> first),
kept as (select l.doc_id, count(*) as n_lines, count(g.pos) as n_dropped, coalesce(string_agg(line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
  from l left join gone g on g.t = l.t and g.pos = l.pos group by l.doc_id)
select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_dedup": _OP5, "op8_line_dedup": _OP8}
