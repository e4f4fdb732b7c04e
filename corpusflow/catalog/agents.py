"""Run logs and evaluation over events, conversations and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.catalog import sqlparts as sp
from corpusflow.catalog.fixtures import chunks, phrasings, questions, vectors
from corpusflow.catalog.registry import Tables, query
from corpusflow.operators import evals as ev
from corpusflow.operators import keyword as kw
from corpusflow.operators import ranking as rk
from corpusflow.operators import runs as ru
from corpusflow.operators.dense import dense_topk
from corpusflow.plans import search as se

CFG = se.Settings(top_k=5)


@query(
    "run_parentage",
    """WITH RECURSIVE walk AS (
  SELECT event_id AS run_id, event_id AS root_id, 0 AS depth FROM events WHERE event_id < 4
  UNION ALL SELECT e.event_id, w.root_id, w.depth + 1 FROM events e JOIN walk w ON e.event_id >= 4 AND e.event_id // 4 = w.run_id)
SELECT * FROM walk""",
)
def run_parentage(t: Tables) -> DataFrame:
    run = F.col("event_id")
    return ru.parentage(t.events.select(run.alias("run_id"), F.when(run >= 4, F.floor(run / 4)).alias("parent_id")))


STEPS = """
steps AS (
  SELECT user_id AS root_id, event_type AS agent, user_id || '/' || event_type AS run_id, event_id AS position, value AS seconds,
    'tool' || (json_extract_string(props, '$.k')::INT % 4) AS tool, json_extract_string(props, '$.k')::INT AS k FROM events)"""


def steps(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("user_id").alias("root_id"), F.col("event_type").alias("agent"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("run_id"),
        F.col("event_id").alias("position"), F.col("value").alias("seconds"),
        F.concat(F.lit("tool"), (k % 4).cast("string")).alias("tool"), k.alias("k"),
    )


@query(
    "budget_audit",
    f"""WITH {STEPS},
own AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY position) AS run_rank FROM steps),
pool AS (SELECT *, CASE WHEN run_rank <= 6 THEN row_number() OVER (PARTITION BY root_id, run_rank <= 6 ORDER BY position) END AS pool_rank FROM own)
SELECT run_id, position, run_rank, pool_rank, CASE WHEN pool_rank IS NULL THEN 'run ceiling' WHEN pool_rank > 14 THEN 'tree pool' ELSE 'taken' END AS status FROM pool""",
)
def budget_audit(t: Tables) -> DataFrame:
    return ru.budget_audit(steps(t)).select("run_id", "position", "run_rank", "pool_rank", "status")


LABELS = f"""{STEPS},
firsts AS (SELECT root_id, k, min(position) AS fp FROM steps GROUP BY 1, 2),
labels AS (SELECT *, 'E' || row_number() OVER (PARTITION BY root_id ORDER BY fp, k) AS label FROM firsts)"""


@query(
    "evidence_labels",
    f"WITH {LABELS} SELECT root_id, position, k AS chunk_id, label, position = fp AS is_new FROM steps JOIN labels USING (root_id, k)",
)
def evidence_labels(t: Tables) -> DataFrame:
    shown = steps(t).select("root_id", F.col("k").alias("chunk_id"), "position")
    return ru.evidence_labels(shown).select("root_id", "position", "chunk_id", "label", "is_new")


@query(
    "repeat_query_suppression",
    f"""WITH {STEPS}, s AS (SELECT run_id, position, 'about ' || tool || ' ' || k % 10 AS q FROM steps)
SELECT run_id, position, row_number() OVER (PARTITION BY run_id, q ORDER BY position) > 1 AS is_repeat FROM s""",
)
def repeat_query_suppression(t: Tables) -> DataFrame:
    text = F.concat(F.lit("  About "), "tool", F.lit(" \t"), (F.col("k") % 10).cast("string"))
    searches = steps(t).select("run_id", "position", text.alias("query"))
    return ru.repeated_queries(searches).select("run_id", "position", "is_repeat")


@query(
    "evidence_report",
    f"""WITH {LABELS},
b AS (
  SELECT s.root_id, s.position // 500 AS search_no, s.position, '[' || label || '] ' || d.source || '.txt p.' || (k % 7 + 1) || ' — ' || d.lang
    || CASE WHEN position = fp THEN chr(10) || CASE WHEN length({sp.strip('d.text')}) > 700 THEN regexp_replace(left({sp.strip('d.text')}, 700), '{sp.SPACE}+$', '') || ' […]' ELSE {sp.strip('d.text')} END
       ELSE ' (already shown above, not repeated)' END AS block
  FROM steps s JOIN labels USING (root_id, k) JOIN documents d ON d.doc_id = k)
SELECT root_id, search_no, count(*) || ' passage(s) for "search ' || search_no || '":' || chr(10) || chr(10)
  || string_agg(block, chr(10) || chr(10) ORDER BY position) AS report FROM b GROUP BY 1, 2""",
)
def evidence_report(t: Tables) -> DataFrame:
    shown = steps(t).select("root_id", F.col("k").cast("bigint").alias("chunk_id"), "position")
    return ru.evidence_reports(shown.withColumn("search_no", F.floor(F.col("position") / 500)), chunks(t))


@query(
    "run_rollup",
    f"""WITH {STEPS}
SELECT root_id, agent, count(*) AS steps, round(sum(seconds), 2) AS seconds, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools
FROM steps GROUP BY GROUPING SETS ((root_id), (root_id, agent))""",
)
def run_rollup(t: Tables) -> DataFrame:
    return ru.rollup(steps(t)).select("root_id", "agent", "steps", F.round("seconds", 2).alias("seconds"), "tools")


def short_runs(t: Tables) -> DataFrame:
    return steps(t).withColumn("run_id", F.floor(F.col("position") / 5))


@query(
    "call_sequences",
    f"""WITH {STEPS}, r AS (SELECT position // 5 AS run_id, string_agg(tool, ',' ORDER BY position) AS sequence FROM steps GROUP BY 1)
SELECT sequence, count(*) AS n_runs FROM r GROUP BY 1""",
)
def call_sequences(t: Tables) -> DataFrame:
    return ru.call_sequences(short_runs(t))


@query(
    "transcript_render",
    f"""WITH {STEPS}, n AS (SELECT *, position // 5 AS run_no, row_number() OVER (PARTITION BY position // 5 ORDER BY position) AS i FROM steps),
s AS (SELECT run_no AS run_id, string_agg('Step ' || i || chr(10) || 'Thought: use ' || tool || chr(10) || 'Action: {{"k": ' || k || '}}' || chr(10) || 'Observation: ' || agent,
  chr(10) || chr(10) ORDER BY i) AS transcript FROM n WHERE run_no % 3 <> 0 GROUP BY 1)
SELECT DISTINCT position // 5 AS run_id, coalesce(transcript, '{ru.NO_STEPS}') AS transcript FROM steps LEFT JOIN s ON s.run_id = position // 5""",
)
def transcript_render(t: Tables) -> DataFrame:
    rows = short_runs(t)
    done = rows.filter("run_id % 3 <> 0").select(
        "run_id", "position", F.concat(F.lit("use "), "tool").alias("thought"),
        F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit("}")).alias("action"), F.col("agent").alias("observation"),
    )
    return ru.with_empty_transcript(rows.select("run_id").distinct(), ru.transcript(done))


@query(
    "delegation_badge",
    f"""WITH {STEPS}, d AS (SELECT position // 2 AS run_id, CASE tool WHEN 'tool0' THEN 'read_image' WHEN 'tool1' THEN 'research_documents' WHEN 'tool2' THEN 'call_external_api' END AS b FROM steps)
SELECT run_id, CASE count(DISTINCT b) WHEN 0 THEN 'answer_directly' WHEN 1 THEN max(b) ELSE 'multiple_specialists' END AS badge FROM d GROUP BY 1""",
)
def delegation_badge(t: Tables) -> DataFrame:
    tool = F.when(F.col("tool") == "tool0", "read_image").when(F.col("tool") == "tool1", "research_documents").when(
        F.col("tool") == "tool2", "call_external_api"
    ).otherwise("finish")
    return ru.delegation_badge(steps(t).select(F.floor(F.col("position") / 2).alias("run_id"), tool.alias("tool")))


# Evaluation --------------------------------------------------------------------

RELEVANT = """
relevant AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def relevant(t: Tables) -> DataFrame:
    return ev.containing_documents(
        chunks(t).select("chunk_id", "text"), t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    )


@query("relevance_join", f"WITH {RELEVANT} SELECT query_id, chunk_id FROM relevant")
def relevance_join(t: Tables) -> DataFrame:
    return relevant(t)


CONFIGS = """
results AS (
  SELECT 'dense' AS config, query_id, chunk_id, rank FROM dn WHERE rank <= 5
  UNION ALL SELECT 'keyword', query_id, chunk_id, rank FROM kw WHERE rank <= 5
  UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM collapsed WHERE rank <= 5)"""


@query(
    "retrieval_metrics",
    f"""WITH {sp.hybrid(5)},{CONFIGS},{RELEVANT},
grid AS (SELECT DISTINCT config, query_id FROM results WHERE query_id IN (SELECT query_id FROM relevant)),
firsts AS (SELECT config, query_id, min(rank) AS r FROM results JOIN relevant USING (query_id, chunk_id) GROUP BY 1, 2)
SELECT config, count(*) AS n_questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1,
  round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
  round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM grid LEFT JOIN firsts USING (config, query_id) GROUP BY 1""",
)
def retrieval_metrics(t: Tables) -> DataFrame:
    corpus, asked = chunks(t), questions(t)

    def named(name: str, hits: DataFrame) -> DataFrame:
        return hits.select(F.lit(name).alias("config"), "query_id", "chunk_id", "rank")

    dense = rk.similarity_floor(dense_topk(vectors(t), asked, 5))
    results = (
        named("dense", dense)
        .unionByName(named("keyword", kw.bm25_topk(corpus, asked, 5)))
        .unionByName(named("hybrid", se.hybrid_search(corpus, asked, CFG, vectors=vectors(t))))
    )
    metrics = ev.retrieval_metrics(results, relevant(t))
    return metrics.select(
        "config", "n_questions", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "recall_at_3", "recall_at_5", "mrr")]
    )


@query(
    "refusal_sweep",
    f"""WITH {sp.hybrid(5)},{sp.reranked(5)},{RELEVANT},
best AS (SELECT item_id AS query_id, max(rerank_score) AS best_score, coalesce(bool_or(rank = 1 AND rel.chunk_id IS NOT NULL), false) AS hit1,
    item_id IN (SELECT query_id FROM relevant) AS answerable
  FROM benchmark LEFT JOIN reranked r ON r.query_id = item_id LEFT JOIN relevant rel ON rel.query_id = r.query_id AND rel.chunk_id = r.chunk_id GROUP BY item_id),
grid AS (SELECT *, unnest([0.001, 0.05, 0.2, 0.6]::DOUBLE[]) AS threshold FROM best),
o AS (SELECT *, best_score IS NULL OR best_score < threshold AS refused FROM grid)
SELECT threshold, round(avg(CASE WHEN answerable THEN (hit1 AND NOT refused)::INT END), 6) AS hit_at_1,
  round(avg(CASE WHEN answerable THEN refused::INT END), 6) AS false_refusals, round(avg(CASE WHEN NOT answerable THEN refused::INT END), 6) AS correct_refusals,
  round(avg(CASE WHEN answerable THEN (hit1 AND NOT refused)::INT ELSE refused::INT END), 6) AS overall FROM o GROUP BY 1""",
)
def refusal_sweep(t: Tables) -> DataFrame:
    asked, rel = questions(t), relevant(t)
    hits = se.reranked_search(chunks(t), asked, CFG, vectors=vectors(t)).select("query_id", "chunk_id", "rank", "rerank_score")
    marked = hits.join(rel.withColumn("rel", F.lit(True)), ["query_id", "chunk_id"], "left")
    per_query = marked.groupBy("query_id").agg(
        F.max("rerank_score").alias("best_score"),
        F.bool_or((F.col("rank") == 1) & F.col("rel").isNotNull()).alias("hit_at_1"),
    )
    answerable = rel.select("query_id").distinct().withColumn("answerable", F.lit(True))
    outcomes = (
        asked.select("query_id")
        .join(per_query, "query_id", "left")
        .join(answerable, "query_id", "left")
        .withColumns({n: F.coalesce(n, F.lit(False)) for n in ("hit_at_1", "answerable")})
    )
    sweep = ev.refusal_sweep(outcomes, [0.001, 0.05, 0.2, 0.6])
    return sweep.select("threshold", *[F.round(c, 6).alias(c) for c in sweep.columns if c != "threshold"])


@query(
    "multi_query_contribution",
    f"""WITH {sp.hybrid(5, sp.ALL_QUESTIONS)},{RELEVANT}
SELECT count(*) AS n_relevant, count(*) FILTER (found_by_variant > 0) AS n_by_variant
FROM collapsed JOIN relevant USING (query_id, chunk_id) WHERE rank <= 5""",
)
def multi_query_contribution(t: Tables) -> DataFrame:
    results = se.hybrid_search(chunks(t), phrasings(t), CFG, vectors=vectors(t))
    return ev.variant_contribution(results, relevant(t))


VAL = "[£$€]?\\d+(?:[.,:/\\-]\\d+)*"
ANSWERS = """
answers AS (
  SELECT conv_id * 100 + turn AS case_id,
    text || ' total $' || (conv_id * 37 + 100) || '.50 on 2024-01-' || (10 + turn) || ' [E12]. ' || CASE WHEN turn % 3 = 0 THEN 'No visible text' ELSE '' END AS answer,
    'paid ' || (conv_id * 37 + 100) || ',507 and 2024/01/' || (11 + turn % 2) AS source,
    [(conv_id * 37 + 100) || '.5', 'TOTAL', '99' || turn] AS expected FROM conversations)"""


def answers(t: Tables) -> DataFrame:
    amount = (F.col("conv_id") * 37 + 100).cast("string")
    turn = F.col("turn")
    return t.conversations.select(
        (F.col("conv_id") * 100 + turn).alias("case_id"),
        F.concat(
            "text", F.lit(" total $"), amount, F.lit(".50 on 2024-01-"), (turn + 10).cast("string"), F.lit(" [E12]. "),
            F.when(turn % 3 == 0, "No visible text").otherwise(""),
        ).alias("answer"),
        F.concat(F.lit("paid "), amount, F.lit(",507 and 2024/01/"), (turn % 2 + 11).cast("string")).alias("source"),
        F.array(F.concat(amount, F.lit(".5")), F.lit("TOTAL"), F.concat(F.lit("99"), turn.cast("string"))).alias("expected"),
    )


def _dg(x: str) -> str:
    return sp.digits(x)


@query(
    "value_verification",
    f"""WITH {ANSWERS},
seen AS (SELECT case_id, list_transform(regexp_extract_all(source, '{VAL}'), lambda v: {_dg('v')}) AS known,
   regexp_extract_all(regexp_replace(answer, '\\[E\\d+\\]', ' ', 'g'), '{VAL}') AS claimed FROM answers),
each AS (SELECT case_id, known, unnest(claimed) AS tok, generate_subscripts(claimed, 1) AS i FROM seen),
bad AS (SELECT case_id, tok, min(i) AS i FROM each WHERE length({_dg('tok')}) >= 2
   AND len(list_filter(known, lambda k: starts_with(k, {_dg('tok')}))) = 0 GROUP BY 1, 2)
SELECT a.case_id, coalesce(string_agg(tok, ', ' ORDER BY i), '') AS unverified FROM answers a LEFT JOIN bad USING (case_id) GROUP BY 1""",
)
def value_verification(t: Tables) -> DataFrame:
    return ev.graded_answers(answers(t)).select("case_id", "unverified")


HEDGE = (
    "(?i)no\\s+\\w*\\s*(text|content|writing|information|data|receipt|total|figures)|(does\\s?not|doesn''t|is\\s?not|isn''t|cannot|can''t|could\\s?not|couldn''t)"
    "\\s+(contain|show|say|include|read|appear|a\\s)|(unable|not\\s+able)\\s+to|(un|not\\s+)?(readable|legible)|blank|empty"
    "|nothing\\s+(at\\s+all|to\\s+read|visible|here)|photograph|photo\\b|illustration|abstract"
)


@query(
    "graded_answers",
    f"""WITH {ANSWERS}, a AS (
  SELECT case_id, CASE WHEN case_id % 2 = 0 THEN answer ELSE CASE WHEN case_id % 3 = 0 THEN 'No visible text' ELSE 'fine' END END AS answer, expected FROM answers),
n AS (SELECT *, list_transform(regexp_extract_all(answer, '\\d+(?:[.,:/\\-]\\d+)*'), lambda v: {_dg('v')}) AS nums FROM a)
SELECT case_id, len(list_filter(expected, lambda e: CASE WHEN {_dg('e')} = '' THEN contains(lower(answer), lower(e)) ELSE list_contains(nums, {_dg('e')}) END)) AS stated,
  len(expected) AS total, regexp_matches(answer, '{HEDGE}') AND len(list_filter(nums, lambda v: length(v) >= 2)) = 0 AS refused FROM n""",
)
def graded_answers(t: Tables) -> DataFrame:
    case = F.col("case_id")
    plain = F.when(case % 3 == 0, "No visible text").otherwise("fine")
    rows = answers(t).withColumn("answer", F.when(case % 2 == 0, F.col("answer")).otherwise(plain))
    return ev.graded_answers(rows).drop("unverified")


@query(
    "tool_choice",
    f"""WITH {STEPS}, u AS (SELECT position // 3 AS case_id, list(DISTINCT tool) AS used FROM steps GROUP BY 1),
m AS (SELECT case_id, list_sort(list_filter(['tool1', 'tool0'], lambda x: NOT list_contains(used, x) AND (case_id % 2 = 0 OR x = 'tool1'))) AS missing,
   list_sort(list_filter(['tool3', 'tool2'], lambda x: list_contains(used, x))) AS wrong FROM u)
SELECT case_id, len(missing) = 0 AND len(wrong) = 0 AS ok, CASE WHEN len(missing) > 0 THEN 'did not use ' || array_to_string(missing, ', ')
  WHEN len(wrong) > 0 THEN 'should not have used ' || array_to_string(wrong, ', ') ELSE 'ok' END AS reason FROM m""",
)
def tool_choice(t: Tables) -> DataFrame:
    used = steps(t).groupBy(F.floor(F.col("position") / 3).alias("case_id")).agg(F.collect_set("tool").alias("used"))
    required = F.when(F.col("case_id") % 2 == 0, F.array(F.lit("tool1"), F.lit("tool0"))).otherwise(F.array(F.lit("tool1")))
    cases = used.withColumns({"required": required, "forbidden": F.array(F.lit("tool3"), F.lit("tool2"))})
    return ev.tool_choice(cases)


@query(
    "eval_summary",
    f"""WITH {STEPS}, r AS (SELECT agent, value_ok AS passed, k AS steps, seconds, k % 7 = 0 AS unverified, CASE WHEN k % 5 = 0 THEN 'step_limit' ELSE 'finished' END AS stopped,
    CASE WHEN k % 4 <> 0 THEN k % 3 = 0 END AS base FROM (SELECT *, seconds > 5 AS value_ok FROM steps)),
o AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY agent) AS n FROM r)
SELECT agent, count(*) AS cases, count(*) FILTER (passed) AS passed, quantile_cont(steps, 0.5) AS median_steps,
  count(*) FILTER (unverified) AS runs_with_unverified_values, count(*) FILTER (stopped <> 'finished') AS runs_hitting_step_limit,
  count(*) FILTER (base IS NOT NULL) AS baseline_cases, count(*) FILTER (base) AS baseline_passed,
  min(seconds) FILTER (i = round_even(0.5 * (n - 1), 0)) AS latency_p50, min(seconds) FILTER (i = round_even(0.95 * (n - 1), 0)) AS latency_p95,
  round_even(count(*) FILTER (passed) / count(*), 3) AS pass_rate, round_even(count(*) FILTER (base) / count(*) FILTER (base IS NOT NULL), 3) AS baseline_pass_rate,
  round_even(count(*) FILTER (base IS NOT NULL AND passed) / count(*) FILTER (base IS NOT NULL), 3) AS agent_pass_rate_on_baseline
FROM o GROUP BY 1""",
)
def eval_summary(t: Tables) -> DataFrame:
    k = F.col("k")
    results = steps(t).select(
        "agent", (F.col("seconds") > 5).alias("passed"), k.alias("steps"), "seconds", (k % 7 == 0).alias("unverified"),
        F.when(k % 5 == 0, "step_limit").otherwise("finished").alias("stopped_because"),
        F.when(k % 4 != 0, k % 3 == 0).alias("baseline_passed"),
    )
    return ev.eval_summary(results)
