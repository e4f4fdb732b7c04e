"""Search over documents (chunk = document) with benchmark texts as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog import sqlparts as sp
from corpusflow.catalog.fixtures import chunks, dense_chunks, phrasings, questions, replies, variants, vectors
from corpusflow.catalog.registry import Tables, query
from corpusflow.functions.models import hashed_embedding
from corpusflow.operators import keyword as kw
from corpusflow.operators import ranking as rk
from corpusflow.operators.dense import ann_recall, dense_topk, dense_topk_ann
from corpusflow.operators.replies import clean_variants
from corpusflow.plans import search as se

CFG = se.Settings(top_k=5)


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query("chunk_scan", "SELECT doc_id AS chunk_id, source, lang, text FROM documents")
def chunk_scan(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "source", "lang", "text")


@query(
    "metadata_filter",
    "SELECT doc_id AS chunk_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'",
)
def metadata_filter(t: Tables) -> DataFrame:
    kept = se.metadata_filter(t.documents, source="src3", lang="en", text=None)
    return kept.select(F.col("doc_id").alias("chunk_id"), "source", "lang")


@query(
    "dense_topk",
    f"WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.dense(20, None)} "
    "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dn",
)
def dense(t: Tables) -> DataFrame:
    hits = dense_topk(vectors(t), questions(t), 20)
    return hits.select("query_id", "chunk_id", *r6("score"), "rank")


# Sketches of 512 signs; a pair is scored when at most 228 of them differ.
SKETCHED = f"""{sp.CHUNKS},{sp.QUESTIONS},
planes AS (SELECT j, list(CASE WHEN substr(md5(concat(i, ',', j)), 1, 1) >= '8' THEN 1.0 ELSE -1.0 END ORDER BY i) AS plane
           FROM range(64) a(i), range(512) b(j) GROUP BY j),
c_signs AS (SELECT chunk_id, list(list_inner_product(embedding, plane) > 0 ORDER BY j) AS signs
            FROM chunks, planes WHERE embedding IS NOT NULL GROUP BY chunk_id),
q_signs AS (SELECT query_id, list(list_inner_product(embedding, plane) > 0 ORDER BY j) AS signs
            FROM questions, planes WHERE embedding IS NOT NULL GROUP BY query_id),
near AS (SELECT query_id, chunk_id FROM q_signs q, c_signs c
         WHERE len(list_filter(list_zip(q.signs, c.signs), lambda s: s[1] <> s[2])) <= 228),
scored AS (SELECT query_id, chunk_id, list_cosine_similarity(q.embedding, c.embedding) AS score
           FROM near JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id)),
ann AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
        FROM scored QUALIFY rank <= 20)"""


@query("dense_topk_ann", f"WITH {SKETCHED} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ann")
def dense_ann(t: Tables) -> DataFrame:
    hits = dense_topk_ann(vectors(t), questions(t), 20)
    return hits.select("query_id", "chunk_id", *r6("score"), "rank")


@query(
    "dense_ann_recall",
    f"""WITH {SKETCHED},{sp.dense(20, None)},
seen AS (SELECT query_id, count(*) AS n_scored FROM near GROUP BY 1)
SELECT dn.query_id, count(*) AS n_true, count(ann.chunk_id) AS n_found, round(count(ann.chunk_id) / count(*), 6) AS recall,
       any_value(coalesce(n_scored, 0)) AS n_scored
FROM dn LEFT JOIN ann ON ann.query_id = dn.query_id AND ann.chunk_id = dn.chunk_id LEFT JOIN seen ON seen.query_id = dn.query_id
GROUP BY 1""",
)
def dense_ann_recall(t: Tables) -> DataFrame:
    found = ann_recall(vectors(t), questions(t).select("query_id", "embedding"), 20)
    return found.select("query_id", "n_true", "n_found", *r6("recall"), "n_scored")


@query(
    "similarity_floor",
    f"WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.dense(20, 0.2)} "
    "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dn",
)
def similarity_floor(t: Tables) -> DataFrame:
    hits = rk.similarity_floor(dense_topk(vectors(t), questions(t), 20))
    return hits.select("query_id", "chunk_id", *r6("score"), "rank")


@query(
    "corpus_stats",
    f"SELECT count(*) AS n_chunks, round(sum(len({sp.tok('text')})) / count(*), 6) AS avg_len FROM documents",
)
def corpus_stats(t: Tables) -> DataFrame:
    stats = kw.corpus_stats(kw.doc_lengths(chunks(t)))
    return stats.select("n_chunks", *r6("avg_len"))


TF = f"""SELECT chunk_id, term, count(*) AS tf
FROM (SELECT doc_id AS chunk_id, unnest({sp.tok('text')}) AS term FROM documents) GROUP BY 1, 2"""


@query("term_frequency", TF)
def term_frequency(t: Tables) -> DataFrame:
    return kw.term_frequency(chunks(t)).select("chunk_id", "term", "tf")


@query(
    "idf",
    f"""WITH tf AS ({TF}), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs""",
)
def idf(t: Tables) -> DataFrame:
    corpus = chunks(t)
    stats = kw.corpus_stats(kw.doc_lengths(corpus))
    table = kw.inverse_document_frequency(kw.term_frequency(corpus), stats)
    return table.select("term", "df", *r6("idf"))


@query(
    "query_term_postings",
    f"WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.keyword(None)} "
    "SELECT query_id, chunk_id, term, tf, qtf FROM qt JOIN tf USING (term)",
)
def query_term_postings(t: Tables) -> DataFrame:
    terms = kw.query_terms(questions(t))
    postings, _ = kw.query_postings(chunks(t), terms)
    return postings.join(terms, "term").select("query_id", "chunk_id", "term", "tf", "qtf")


@query(
    "bm25_topk",
    f"WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.keyword(20)} "
    "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM kw",
)
def bm25_topk(t: Tables) -> DataFrame:
    hits = kw.bm25_topk(chunks(t), questions(t), 20)
    return hits.select("query_id", "chunk_id", *r6("score"), "rank")


@query(
    "rank_topk",
    "SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, l_extendedprice::DOUBLE AS score, "
    "row_number() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice::DOUBLE, 9) DESC, l_orderkey * 10 + l_linenumber) AS rank "
    "FROM lineitem QUALIFY rank <= 5",
)
def rank_topk(t: Tables) -> DataFrame:
    scores = t.lineitem.select(
        F.col("l_suppkey").alias("query_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        F.col("l_extendedprice").cast("double").alias("score"),
    )
    return kw.rank_topk(scores, 5)


@query(
    "topk_overfetch",
    f"WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.keyword(20)}, f AS ({{}}) SELECT * FROM f".format(
        "SELECT query_id, chunk_id, rank, rank <= 5 AS in_final FROM kw"
    ),
)
def topk_overfetch(t: Tables) -> DataFrame:
    hits = kw.bm25_topk(chunks(t), questions(t), CFG.candidates)
    return hits.select("query_id", "chunk_id", "rank", (F.col("rank") <= CFG.top_k).alias("in_final"))


@query(
    "rankings_union",
    f"WITH {sp.CHUNKS},{sp.ALL_QUESTIONS},{sp.keyword(20)},{sp.dense(20)},{sp.LISTS} "
    "SELECT query_id, list_no, half || ':' || CASE WHEN variant_no = 0 THEN 'original' ELSE 'variant' || variant_no END "
    "AS list_name, chunk_id, rank FROM lists",
)
def rankings_union(t: Tables) -> DataFrame:
    lists = se.rankings(chunks(t), phrasings(t), CFG, vectors(t))
    return lists.select("query_id", "list_no", "list_name", "chunk_id", "rank")


@query(
    "rank_fusion",
    f"WITH {sp.hybrid(5)} SELECT query_id, chunk_id, round(score, 6) AS score, frank AS rank FROM fused",
)
def rank_fusion(t: Tables) -> DataFrame:
    fused = rk.fuse(se.rankings(chunks(t), questions(t), CFG, vectors(t)))
    return fused.select("query_id", "chunk_id", *r6("score"), "rank")


@query(
    "hybrid_merge",
    f"WITH {sp.hybrid(5, sp.ALL_QUESTIONS)} SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, "
    "round(keyword_score, 6) AS keyword_score, matched_by, found_by_variant FROM fused",
)
def hybrid_merge(t: Tables) -> DataFrame:
    fused = rk.fuse(se.rankings(chunks(t), phrasings(t), CFG, vectors(t)))
    return fused.select(
        "query_id", "chunk_id", *r6("dense_score", "keyword_score"), "matched_by", "found_by_variant"
    )


@query(
    "best_score_per_chunk",
    f"WITH {sp.CHUNKS},{sp.ALL_QUESTIONS},{sp.keyword(20)},{sp.dense(20)},{sp.LISTS} "
    "SELECT query_id, chunk_id, half, round(max(score), 6) AS best_score FROM lists GROUP BY 1, 2, 3",
)
def best_score_per_chunk(t: Tables) -> DataFrame:
    lists = se.rankings(chunks(t), phrasings(t), CFG, vectors(t))
    return (
        lists.groupBy("query_id", "chunk_id", "half")
        .agg(F.max("score").alias("best_score"))
        .select("query_id", "chunk_id", "half", *r6("best_score"))
    )


@query(
    "collapse_passages",
    f"WITH {sp.hybrid(5)} SELECT query_id, chunk_id, parent_id, rank FROM collapsed",
)
def collapse_passages(t: Tables) -> DataFrame:
    shortlist = se.fused(chunks(t), questions(t), CFG, vectors=vectors(t))
    return shortlist.select("query_id", "chunk_id", "parent_id", "rank")


HYBRID_OUT = (
    "query_id, chunk_id, rank, parent_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, "
    "round(keyword_score, 6) AS keyword_score, matched_by, found_by_variant"
)


def hybrid_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", "chunk_id", "rank", "parent_id", *r6("score", "dense_score", "keyword_score"),
        "matched_by", "found_by_variant",
    )


@query("hybrid_search", f"WITH {sp.hybrid(5)} SELECT {HYBRID_OUT} FROM collapsed WHERE rank <= 5")
def hybrid_search(t: Tables) -> DataFrame:
    return hybrid_columns(se.hybrid_search(chunks(t), questions(t), CFG, vectors=vectors(t)))


def one_list(half: str) -> str:
    source = sp.keyword(20) if half == "keyword" else sp.dense(20)
    lists = (
        "lists AS (SELECT query_id, variant_no, 0 AS list_no, "
        f"'{half}' AS half, chunk_id, rank, round(score, 9) AS score FROM {'kw' if half == 'keyword' else 'dn'})"
    )
    return f"WITH {sp.CHUNKS},{sp.QUESTIONS},{source},{sp.fused(lists)} SELECT {HYBRID_OUT} FROM collapsed WHERE rank <= 5"


@query("dense_search", one_list("dense"))
def dense_search(t: Tables) -> DataFrame:
    return hybrid_columns(se.single_list_search(chunks(t), questions(t), "dense", CFG, vectors=vectors(t)))


@query("keyword_search", one_list("keyword"))
def keyword_search(t: Tables) -> DataFrame:
    return hybrid_columns(se.single_list_search(chunks(t), questions(t), "keyword", CFG, vectors=vectors(t)))


@query(
    "filtered_search",
    f"""WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.dense(20, None, "c.section = 'en'")},
kept AS (SELECT d.*, c.parent_id FROM dn d JOIN chunks c USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, c.parent_id ORDER BY d.rank) = 1),
out AS (SELECT query_id, chunk_id, parent_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY kept.rank) AS rank FROM kept)
SELECT * FROM out WHERE rank <= 5""",
)
def filtered_search(t: Tables) -> DataFrame:
    hits = se.filtered_search(dense_chunks(t), questions(t), CFG, section="en", filename="")
    return hits.select("query_id", "chunk_id", "parent_id", *r6("score"), "rank")


@query(
    "multi_query_search",
    f"WITH {sp.hybrid(5, sp.ALL_QUESTIONS)} SELECT {HYBRID_OUT} FROM collapsed WHERE rank <= 5",
)
def multi_query_search(t: Tables) -> DataFrame:
    return hybrid_columns(se.hybrid_search(chunks(t), phrasings(t), CFG, vectors=vectors(t)))


RERANKED = f"WITH {sp.hybrid(5)},{sp.reranked(5)} "


@query(
    "reranked_search",
    RERANKED + "SELECT query_id, chunk_id, rank, round(rerank_score, 6) AS rerank_score FROM reranked",
)
def reranked_search(t: Tables) -> DataFrame:
    hits = se.reranked_search(chunks(t), questions(t), CFG, vectors=vectors(t))
    return hits.select("query_id", "chunk_id", "rank", *r6("rerank_score"))


@query(
    "rerank_order",
    RERANKED + "SELECT query_id, chunk_id, rank FROM reranked",
)
def rerank_order(t: Tables) -> DataFrame:
    return se.reranked_search(chunks(t), questions(t), CFG, vectors=vectors(t)).select("query_id", "chunk_id", "rank")


@query(
    "rerank_floor",
    RERANKED + "SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM scored WHERE rerank_score >= 0.3 "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, old_rank) <= 5",
)
def rerank_floor(t: Tables) -> DataFrame:
    hits = se.reranked_search(chunks(t), questions(t), se.Settings(top_k=5, rerank_min=0.3), vectors=vectors(t))
    return hits.select("query_id", "chunk_id", *r6("rerank_score"))


GRADES = """
graded AS (
  SELECT q.query_id, max(rerank_score) AS best_score,
    CASE WHEN max(rerank_score) >= 0.5 THEN 'correct'
         WHEN max(rerank_score) IS NULL OR max(rerank_score) < 0.001 THEN 'incorrect' ELSE 'ambiguous' END AS verdict
  FROM (SELECT item_id AS query_id FROM benchmark) q LEFT JOIN reranked r USING (query_id) GROUP BY 1)"""


@query(
    "grade_retrieval",
    RERANKED + f",{GRADES} SELECT query_id, verdict, round(best_score, 6) AS best_score FROM graded",
)
def grade_retrieval(t: Tables) -> DataFrame:
    asked = questions(t)
    graded = rk.grade(asked, se.reranked_search(chunks(t), asked, CFG, vectors=vectors(t)))
    return graded.select("query_id", "verdict", *r6("best_score"))


CORRECTIVE = se.Settings(top_k=5, accept=0.9, reject=0.2)


def corrective_sql() -> str:
    base = sp.hybrid(5) + "," + sp.reranked(5)
    wide = sp.hybrid(5, sp.ALL_QUESTIONS) + "," + sp.reranked(5)
    cols = "query_id, chunk_id, rank, rerank_score"
    return f"""
WITH base AS (WITH {base} SELECT {cols} FROM reranked),
retry_all AS (WITH {wide} SELECT {cols} FROM reranked),
best1 AS (SELECT query_id, max(rerank_score) AS b FROM base GROUP BY 1),
asked AS (SELECT item_id AS query_id, coalesce(b, -1) AS b1, b FROM benchmark LEFT JOIN best1 ON item_id = query_id),
retry AS (SELECT * FROM retry_all WHERE query_id IN (SELECT query_id FROM asked WHERE b IS NULL OR b < 0.9)),
best2 AS (SELECT query_id, max(rerank_score) AS b2 FROM retry GROUP BY 1),
choice AS (
  SELECT query_id, CASE WHEN coalesce(b2, -1) > b1 THEN 2 ELSE 1 END AS attempt, greatest(coalesce(b2, -1), b1) AS best
  FROM asked LEFT JOIN best2 USING (query_id))
SELECT a.query_id, chunk_id, rank, a.attempt, round(rerank_score, 6) AS rerank_score
FROM (SELECT *, 1 AS attempt FROM base UNION ALL SELECT *, 2 FROM retry) a JOIN choice c USING (query_id, attempt)
WHERE best >= 0.2"""


@query("corrective_search", corrective_sql())
def corrective_search(t: Tables) -> DataFrame:
    hits = se.corrective_search(chunks(t), questions(t), variants(t), CORRECTIVE, vectors=vectors(t))
    return hits.select("query_id", "chunk_id", "rank", "attempt", *r6("rerank_score"))


@query(
    "citation_projection",
    RERANKED + "SELECT query_id, rank, chunk_id, filename, page, section, round(score, 6) AS score, "
    "round(dense_score, 6) AS dense_score, round(keyword_score, 6) AS keyword_score, matched_by, found_by_variant "
    "FROM collapsed WHERE rank <= 5",
)
def citation_projection(t: Tables) -> DataFrame:
    hits = se.hybrid_search(chunks(t), questions(t), CFG, "filename", "page", "section", "text", vectors=vectors(t))
    cited = se.citations(hits)
    rounded = {n: F.round(F.col(n), 6) for n in ("score", "dense_score", "keyword_score")}
    return cited.withColumns(rounded)


CONTEXT = """
ctx AS (
  SELECT query_id, count(*) AS n_sources,
    string_agg('Document: ' || filename || chr(10) || 'Page: ' || page || chr(10) || 'Content: ' || text,
               chr(10) || chr(10) ORDER BY rank) AS context
  FROM collapsed WHERE rank <= 5 GROUP BY 1)"""


@query("context_render", f"WITH {sp.hybrid(5)},{CONTEXT} SELECT query_id, n_sources, context FROM ctx")
def context_render(t: Tables) -> DataFrame:
    hits = se.hybrid_search(chunks(t), questions(t), CFG, "filename", "page", "text", vectors=vectors(t))
    return se.rendered_context(hits)



@query(
    "answer_or_refuse_rows",
    f"""WITH {sp.CHUNKS},{sp.QUESTIONS},{sp.dense(20, 0.3)},
top AS (SELECT d.query_id, d.rank, c.* FROM dn d JOIN chunks c USING (chunk_id) WHERE d.rank <= 5),
ctx AS (
  SELECT query_id, count(*) AS n_sources,
    string_agg('Document: ' || filename || chr(10) || 'Page: ' || page || chr(10) || 'Content: ' || text,
               chr(10) || chr(10) ORDER BY rank) AS context
  FROM top GROUP BY 1)
SELECT q.query_id, context, coalesce(n_sources, 0) AS n_sources,
  CASE WHEN context IS NULL THEN '{sp.QUOTED_NO_ANSWER}' END AS answer
FROM questions q LEFT JOIN ctx USING (query_id)""",
)
def answer_or_refuse_rows(t: Tables) -> DataFrame:
    corpus, asked = chunks(t), questions(t)
    hits = rk.cut(rk.similarity_floor(dense_topk(vectors(t), asked, CFG.candidates), 0.3), 5)
    return se.answer_rows(asked, se.with_chunk_columns(hits, corpus, asked, CFG, "filename", "page", "text"))


@query(
    "text_dedup",
    "SELECT text, min(doc_id) AS first_id FROM documents GROUP BY 1",
)
def text_dedup(t: Tables) -> DataFrame:
    # Grouped on a digest, so long texts are not compared or kept as keys.
    firsts = t.documents.groupBy(F.sha2("text", 256).alias("key")).agg(
        F.min("doc_id").alias("first_id")
    )
    return firsts.join(t.documents, F.col("first_id") == F.col("doc_id")).select("text", "first_id")


@query("variant_dedup", f"WITH {sp.VARIANTS} SELECT query_id, variant_no, text FROM variants")
def variant_dedup(t: Tables) -> DataFrame:
    return clean_variants(replies(t), 2)


@query(
    "corpus_search_function",
    f"WITH {sp.hybrid(3)},{sp.reranked(3)} SELECT query_id, chunk_id, rank FROM reranked",
)
def corpus_search_function(t: Tables) -> DataFrame:
    found = se.search(chunks(t), questions(t), rerank=True, top_k=3, vectors=vectors(t))
    found.createOrReplaceTempView("corpus_search")
    return t.spark.sql("SELECT query_id, chunk_id, rank FROM corpus_search")




@query(
    "text_embedding",
    f"SELECT doc_id, CASE WHEN len({sp.tok('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS squared_norm, 256 AS dimensions FROM documents",
)
def text_embedding(t: Tables) -> DataFrame:
    embedded = hashed_embedding(t.documents)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return embedded.select("doc_id", F.round(squares, 4).alias("squared_norm"), F.size("embedding").alias("dimensions"))
