"""Pieces of SQL shared by the statements beside the named queries."""

from __future__ import annotations

from corpusflow.functions import text as tx
from corpusflow.plans.search import NO_ANSWER

STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
SPACE = tx.SPACE
QUOTED_NO_ANSWER = NO_ANSWER.replace("'", "''")


def tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN ({STOP}))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


CHUNKS = """
chunks AS (
  SELECT d.doc_id AS chunk_id, d.text, d.source AS parent_id, d.source || '.txt' AS filename,
         d.doc_id % 7 + 1 AS page, d.lang AS section, e.embedding::DOUBLE[] AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

# Phrasings of every question: the question itself and the cleaned reply lines.
VARIANTS = f"""
replies AS (
  SELECT item_id AS query_id, text AS question,
         '1. ' || left(text, 60) || chr(10) || '- ' || right(text, 60) || chr(10) || '* ' || upper(left(text, 60))
         || chr(10) || text || chr(10) || '2) ' || substr(text, 31, 60) AS reply
  FROM benchmark),
reply_lines AS (
  SELECT query_id, question, unnest(string_split(reply, chr(10))) AS line,
         generate_subscripts(string_split(reply, chr(10)), 1) AS line_no FROM replies),
reply_clean AS (
  SELECT query_id, line_no, lower(regexp_replace(question, 'x', 'x', 'g')) AS q,
    {strip(f"regexp_replace(regexp_replace({strip('line')}, '^[-*• ' || chr(9) || ']+', ''), '^[0-9]+[.):]', '')")} AS text,
    trim(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}} ]', '', 'g')) AS own_key FROM reply_lines),
reply_keyed AS (
  SELECT *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}} ]', '', 'g')) AS key
  FROM reply_clean WHERE text <> '' AND length(text) <= 300),
reply_first AS (
  SELECT query_id, key, min(line_no) AS line_no FROM reply_keyed WHERE key <> own_key GROUP BY 1, 2),
variants AS (
  SELECT f.query_id, k.text, row_number() OVER (PARTITION BY f.query_id ORDER BY f.line_no) AS variant_no
  FROM reply_first f JOIN reply_keyed k USING (query_id, key, line_no)
  QUALIFY variant_no <= 2)"""

QUESTIONS = """
questions AS (
  SELECT b.item_id AS query_id, 0 AS variant_no, b.text, e.embedding::DOUBLE[] AS embedding
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""

ALL_QUESTIONS = f"""{VARIANTS},
questions AS (
  SELECT b.item_id AS query_id, 0 AS variant_no, b.text, e.embedding::DOUBLE[] AS embedding
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
  UNION ALL
  SELECT v.query_id, v.variant_no, v.text, e.embedding::DOUBLE[]
  FROM variants v LEFT JOIN embeddings e ON e.vec_id = v.query_id + 40 * v.variant_no)"""


def keyword(k: int | None) -> str:
    cut = "" if k is None else f" AND rank <= {k}"
    return f"""
toks AS (SELECT chunk_id, {tok('text')} AS t FROM chunks),
stats AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM toks),
qt AS (
  SELECT query_id, variant_no, term, count(*) AS qtf
  FROM (SELECT query_id, variant_no, unnest({tok('text')}) AS term FROM questions) GROUP BY ALL),
tf AS (
  SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
kw_all AS (
  SELECT query_id, variant_no, chunk_id,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.2::DOUBLE
             / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM qt JOIN dfs USING (term) JOIN tf USING (term) CROSS JOIN stats GROUP BY ALL),
kw AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM kw_all WHERE score > 0 QUALIFY rank > 0{cut})"""


def dense(k: int, floor: float | None = 0.2, where: str = "true") -> str:
    keep = "true" if floor is None else f"score >= {floor}"
    return f"""
dn_all AS (
  SELECT q.query_id, q.variant_no, c.chunk_id, list_cosine_similarity(q.embedding, c.embedding) AS score
  FROM questions q CROSS JOIN chunks c
  WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL AND {where}),
dn_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM dn_all QUALIFY rank <= {k}),
dn AS (SELECT * FROM dn_top WHERE {keep})"""


LISTS = """
lists AS (
  SELECT query_id, variant_no, variant_no * 2 AS list_no, 'dense' AS half, chunk_id, rank, round(score, 9) AS score FROM dn
  UNION ALL
  SELECT query_id, variant_no, variant_no * 2 + 1, 'keyword', chunk_id, rank, score FROM kw)"""


def fused(lists: str = LISTS) -> str:
    return f"""{lists},
merged AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf,
         min(list_no * 1000000 + rank) AS first_seen, min(variant_no) AS found_by_variant,
         max(CASE WHEN half = 'dense' THEN score END) AS dense_score,
         max(CASE WHEN half = 'keyword' THEN score END) AS keyword_score,
         arg_min(score, list_no) AS own
  FROM lists GROUP BY 1, 2),
n_lists AS (SELECT query_id, count(DISTINCT list_no) AS n FROM lists GROUP BY 1),
fused AS (
  SELECT m.*, CASE WHEN n = 1 THEN own ELSE rrf END AS score,
         CASE WHEN dense_score IS NOT NULL AND keyword_score IS NOT NULL THEN 'both'
              WHEN keyword_score IS NOT NULL THEN 'keyword' ELSE 'dense' END AS matched_by,
         row_number() OVER (PARTITION BY query_id
           ORDER BY CASE WHEN n = 1 THEN 0 ELSE round(rrf, 12) END DESC, first_seen) AS frank
  FROM merged m JOIN n_lists USING (query_id)),
kept AS (
  SELECT f.*, c.parent_id, c.filename, c.page, c.section, c.text FROM fused f JOIN chunks c USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(nullif(c.parent_id, ''), 'c' || chunk_id) ORDER BY frank) = 1),
collapsed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY frank) AS rank FROM kept)"""


def reranked(top_k: int) -> str:
    q, p = tok("q.text"), tok("c.text")
    logit = (
        f"(len(list_intersect(list_distinct({q}), list_distinct({p})))::DOUBLE"
        f" / greatest(len(list_distinct({q})), 1) * 12.0 - 6.0)"
    )
    return f"""
scored AS (
  SELECT c.* EXCLUDE (rank), c.rank AS old_rank, 1.0::DOUBLE / (1.0::DOUBLE + exp(-{logit})) AS rerank_score
  FROM collapsed c JOIN (SELECT * FROM questions WHERE variant_no = 0) q USING (query_id)),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, old_rank) AS rank
  FROM scored QUALIFY rank <= {top_k})"""


def hybrid(top_k: int, questions: str = QUESTIONS) -> str:
    return ",".join([CHUNKS, questions, keyword(top_k * 4), dense(top_k * 4), fused()])
