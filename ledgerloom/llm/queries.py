"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.byte_bpe import token_digests
from ledgerloom.llm.content_dedup import exact_duplicates
from ledgerloom.llm.language import fit_language, predict_language
from ledgerloom.llm.line_dedup import line_digests
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.private_data import base_spans, find_private_data
from ledgerloom.llm.simhash import simhash_components
from ledgerloom.llm.token_tree import Edit, edited_token_counts
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity
from ledgerloom.llm.voronoi_knn import voronoi_top_k

_BLANKS = re.compile(r"[\x20\x09-\x0D]{2,}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cleaning_edits(text: str) -> list[Edit]:
    """Personal data to its kind in angle brackets, runs of white space to one line feed or space; first come, first served."""
    wanted = [(s, e, f"<{kind}>") for kind, s, e in base_spans(text)]
    wanted += [(m.start(), m.end(), "\n" if "\n" in m.group() else " ") for m in _BLANKS.finditer(text)]
    edits, end = [], 0
    for s, e, new in sorted(wanted):
        if s >= end:
            edits.append((s, e, new))
            end = e
    return edits


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return voronoi_top_k(table, F.col("vec_id") % 20 == 0, k=20)


def op2_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private_data(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op6_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_token_counts(documents(spark, sf_dir), cleaning_edits)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_language(docs, fit_language(docs))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_voronoi_knn, op2_content_dedup, op3_mix_sources, op4_private_data, op5_simhash, op6_edited_token_counts, op7_line_dedup, op8_toxicity, op9_language, op10_byte_bpe, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


ORACLES = {
    "op1_voronoi_knn": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as vec from embeddings
          where embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), pairs as (
          select q.vec_id as query_id, c.vec_id as vec_id,
            cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
        ), ranked as (
          select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from pairs
        )
        select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op2_content_dedup": r"""
        with n as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept,
          sha256(norm) as text_sha256
        from n window w as (partition by norm)""",
    "op7_line_dedup": r"""
        with lines as (
          select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
          from documents
        ), keyed as (
          select doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
        ), frequent as (
          select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10
        ), marked as (
          select doc_id, line, pos, k in (select k from frequent) as gone from keyed
        )
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
          sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from marked group by doc_id""",
}
