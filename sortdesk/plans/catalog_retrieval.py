"""Registered queries: passages, terms, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import guardrail as G
from ..operators import retrieval as H
from . import oracle_parts as O
from . import views
from .catalog_guardrail import GUARDED_CTES
from .registry import registry

QUERIES, ORACLE, register = registry()


def documents(spark, sf):
    return views.text_table(spark, sf, "documents", "doc_id").select("doc_id", "source", "text")


def passages(spark, sf):
    """Paragraphs of more than 40 characters."""
    return H.chunk_sections(documents(spark, sf), "doc_id", min_chars=V.LEXICAL_MIN_CHARS,
                            heading=r"\n+")


def questions(spark, sf):
    return views.text_table(spark, sf, "benchmark", "item_id").select(
        F.col("item_id").alias("query_id"), "text")


_PARTS = f"""parts as (select doc_id, source, list_transform(string_split_regex(text, '\\n+'),
  lambda p: {O.strip("p")}) as ps from documents)"""
_STOP = "[" + ", ".join(O.lit(w) for w in V.STOP_WORDS) + "]"


def _terms(text: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({text}), "
            f"'[a-zà-öø-ÿ]{{5,}}'), lambda w: not list_contains({_STOP}, w)))")


_CHUNKS = f"""chunks as materialized (select doc_id, source, i - 1 as chunk_pos, kept[i] as text from (
  select doc_id, source, kept, unnest(range(1, len(kept) + 1)) as i from (
    select doc_id, source, list_filter(ps, lambda p: length(p) > 40) as kept from parts)))"""


@register("sections", O.with_ctes(_PARTS, final=f"""
select doc_id || '-' || (i - 1) as chunk_id, md5(kept[i]) as text_md5,
  {O.strip("split_part(kept[i], chr(10), 1)")} as first_line from (
  select doc_id, kept, unnest(range(1, len(kept) + 1)) as i from (
    select doc_id, list_filter(ps, lambda p: p <> '') as kept from parts))"""))
def sections(spark, sf):
    df = H.chunk_sections(documents(spark, sf), "doc_id", heading=r"\n+")
    return df.select("chunk_id", F.md5("text").alias("text_md5"),
                     H.strip(F.split_part("text", F.lit("\n"), F.lit(1))).alias("first_line"))


@register("passages", O.with_ctes(_PARTS, _CHUNKS, final="""
select doc_id || '-' || chunk_pos as chunk_id, md5(text) as text_md5 from chunks"""))
def passages_query(spark, sf):
    return passages(spark, sf).select("chunk_id", F.md5("text").alias("text_md5"))


@register("document_terms", f"""
select doc_id, array_to_string(list_sort({_terms("text")}), ' ') as terms from documents""")
def document_terms(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(F.array_sort(H.terms("text")), " ").alias("terms"))


_FREQUENCY = f"""terms as materialized (select doc_id, chunk_pos, unnest({_terms("text")}) as term from chunks),
freq as materialized (select term, count(*) as df from terms group by term)"""


@register("document_frequency", O.with_ctes(
    _PARTS, _CHUNKS, _FREQUENCY, final="select term, df from freq"))
def document_frequency(spark, sf):
    return H.document_frequency(passages(spark, sf))


def _topk_sql(queries: str, k: int) -> str:
    return f"""asked as (select query_id, unnest({_terms("text")}) as term from ({queries})),
scored as (select query_id, doc_id, chunk_pos,
  round(sum(1.0 / (1.0 + cast(df as double) / (select count(*) from chunks))), 12) as score
  from asked join terms using (term) join freq using (term) group by all),
top as materialized (select * from (select *, row_number() over (partition by query_id
  order by score desc, doc_id, chunk_pos) as rank from scored) where rank <= {k})"""


_QUESTIONS = "select item_id as query_id, text from benchmark"


@register("lexical_topk", O.with_ctes(
    _PARTS, _CHUNKS, _FREQUENCY, _topk_sql(_QUESTIONS, 3), final="""
select query_id, doc_id, chunk_pos, round(score, 9) as score, rank from top"""))
def lexical_topk(spark, sf):
    return H.lexical_topk(questions(spark, sf), passages(spark, sf), 3).withColumn(
        "score", F.round("score", 9))


@register("vector_topk", """
select * from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from (
  select a.vec_id as query_id, b.vec_id, round(list_sum(list_transform(range(1, 65),
    lambda i: power(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2))), 9) as distance
  from embeddings a join embeddings b on a.vec_id <> b.vec_id)) where rank <= 3""")
def vector_topk(spark, sf):
    """Nearest neighbours of every vector."""
    vectors = views.text_table(spark, sf, "embeddings", "vec_id").select("vec_id", "embedding")
    asked = vectors.withColumnRenamed("vec_id", "query_id")
    return H.vector_topk(asked, vectors, 3, exclude_self=True).withColumn(
        "distance", F.round("distance", 9))


def _vectors_of_passages(spark, sf):
    """The first passage of a document carries the vector of the same number."""
    return views.table(spark, sf, "embeddings").select(
        "vec_id", "embedding", F.col("vec_id").alias("doc_id"),
        F.lit(0).cast("long").alias("chunk_pos"))


def _questions_with_vectors(spark, sf):
    """Two of three questions come with a vector, the others fall back to words."""
    near = views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf).join(
        near.where(F.col("query_id") % 3 != 0), "query_id", "left")


_RETRIEVED = (
    _PARTS, _CHUNKS, _FREQUENCY, _topk_sql(_QUESTIONS, 3),
    """by_vector as (select query_id, vec_id as doc_id, 0 as chunk_pos, rank from (
  select query_id, vec_id, row_number() over (partition by query_id order by distance, vec_id) as rank from (
    select q.item_id as query_id, b.vec_id, round(list_sum(list_transform(range(1, 65),
      lambda i: power(cast(a.embedding[i] as double) - cast(b.embedding[i] as double), 2))), 12) as distance
    from benchmark q join embeddings a on a.vec_id = q.item_id and q.item_id % 3 <> 0,
      embeddings b join chunks on chunks.doc_id = b.vec_id and chunk_pos = 0))
  where rank <= 3)""",
    """retrieved as (select query_id, doc_id, chunk_pos, rank from by_vector union all
  select query_id, doc_id, chunk_pos, rank from top
  where query_id not in (select query_id from by_vector))""",
)


@register("retrieved_contexts", O.with_ctes(*_RETRIEVED, final="""
select query_id, rank, '[' || source || '] ' || text as context
from retrieved join chunks using (doc_id, chunk_pos)"""))
def retrieved_contexts(spark, sf):
    return H.retrieve(_questions_with_vectors(spark, sf), passages(spark, sf),
                      _vectors_of_passages(spark, sf), 3)


@register("context_lists", O.with_ctes(*_RETRIEVED, final="""
select query_id, count(*) as n, md5(string_agg('[' || source || '] ' || text, chr(10) order by rank)) as contexts_md5
from retrieved join chunks using (doc_id, chunk_pos) group by query_id"""))
def context_lists(spark, sf):
    found = H.contexts(H.retrieve(
        _questions_with_vectors(spark, sf), passages(spark, sf),
        _vectors_of_passages(spark, sf), 3))
    return found.select("query_id", F.size("contexts").cast("long").alias("n"),
                        F.md5(F.array_join("contexts", "\n")).alias("contexts_md5"))


@register("kb_search", O.with_ctes(
    _PARTS, _CHUNKS, _FREQUENCY, _topk_sql(_QUESTIONS + " where length(text) >= 3", 10), final="""
select query_id, rank, '[' || source || '] ' || text as context
from top join chunks using (doc_id, chunk_pos)"""))
def kb_search(spark, sf):
    return H.kb_search(questions(spark, sf), passages(spark, sf), 10)


@register("query_texts", O.with_ctes(*GUARDED_CTES, final=f"""
select doc_id, {O.strip("subject_masked || ' ' || lang || ' ' || substr(body_masked, 1, 500)")} as query_text
from guarded"""))
def query_texts(spark, sf):
    df = G.mask_messages(views.messages(spark, sf))
    return df.select("doc_id", H.query_text("subject_masked", "lang", "body_masked")
                     .alias("query_text"))
