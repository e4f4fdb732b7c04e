"""Measuring retrieval and answers over tables of questions and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.functions.scalars import is_refusal, states_value, unverified_values
from corpusflow.operators.ordered import running_sum
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged

SHINGLE = 3


def containing_documents(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` where the document's text contains the passage.

    Every inner word of a contained passage stands whole in the document, so
    three inner words in a row serve as a join key; the text is then compared
    exactly. Only passages too short for such a key are compared row by row.
    ``documents``: ``chunk_id, text``; ``passages``: ``query_id, text``.
    """
    words = F.split(F.col("text"), f"{tx.SPACE}+")

    def shingle(parts: Column, start: Column) -> Column:
        return F.array_join(F.slice(parts, start, SHINGLE), " ")

    keyed = passages.withColumn("w", words).withColumn(
        "anchor",
        # Taken from the middle; the first and last word may be cut in the document.
        F.when(
            F.size("w") >= SHINGLE + 2,
            shingle(F.col("w"), F.floor((F.size("w") - SHINGLE) / 2).cast("int") + 1),
        ),
    )
    anchored = keyed.filter("anchor IS NOT NULL").select("query_id", F.col("text").alias("passage"), "anchor")
    parts = documents.select("chunk_id", words.alias("w"))
    spans = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - SHINGLE + 1, F.lit(1))), lambda i: shingle(F.col("w"), i)
    )
    shingles = parts.select("chunk_id", F.explode_outer(F.array_distinct(spans)).alias("anchor"))
    candidates = shingles.join(broadcast_if_small(anchored), "anchor").select("query_id", "chunk_id", "passage")
    # Staged to know its size: a short list is sent to the texts, so that the
    # texts are not shuffled.
    candidates = broadcast_if_small(staged(candidates), 100_000)
    found = (
        candidates.join(documents.select("chunk_id", "text"), "chunk_id")
        .filter(F.contains("text", "passage"))
        .select("query_id", "chunk_id")
    )
    short = keyed.filter("anchor IS NULL").select("query_id", F.col("text").alias("passage"))
    if short.isEmpty():
        return found
    direct = documents.join(broadcast_if_small(short), F.contains("text", "passage")).select("query_id", "chunk_id")
    return found.unionByName(direct)


def first_relevant_rank(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """``config, query_id, first_rank``: rank of the first relevant result, or NULL.

    ``results``: ``config, query_id, chunk_id, rank``. Questions without any
    relevant document are left out.
    """
    hits = results.join(relevant, ["query_id", "chunk_id"]).groupBy("config", "query_id").agg(
        F.min("rank").alias("first_rank")
    )
    asked = relevant.select("query_id").distinct()
    grid = results.select("config", "query_id").distinct().join(asked, "query_id", "left_semi")
    return grid.join(hits, ["config", "query_id"], "left")


def retrieval_metrics(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Hit@1, Recall@3, Recall@5 and mean reciprocal rank per configuration."""
    rank = F.col("first_rank")

    def share(k: int) -> Column:
        return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))

    return first_relevant_rank(results, relevant).groupBy("config").agg(
        F.count(F.lit(1)).alias("n_questions"),
        share(1).alias("hit_at_1"),
        share(3).alias("recall_at_3"),
        share(5).alias("recall_at_5"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"),
    )


def refusal_sweep(outcomes: DataFrame, thresholds: list[float]) -> DataFrame:
    """Effect of each reject threshold on refusals and hits.

    ``outcomes``: ``query_id, best_score, hit_at_1, answerable``; one row per
    question is repeated once per threshold.
    """
    grid = outcomes.withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    refused = F.col("best_score").isNull() | (F.col("best_score") < F.col("threshold"))
    hit = F.col("hit_at_1") & ~refused
    right = F.when(F.col("answerable"), hit).otherwise(refused)

    def share(what: Column, among: Column) -> Column:
        return F.avg(F.when(among, what.cast("double")))

    answerable = F.col("answerable")
    return grid.groupBy("threshold").agg(
        share(hit, answerable).alias("hit_at_1"),
        share(refused, answerable).alias("false_refusals"),
        share(refused, ~answerable).alias("correct_refusals"),
        F.avg(right.cast("double")).alias("overall"),
    )


def variant_contribution(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """How often a relevant chunk came from a rephrasing, not the question."""
    hits = results.join(relevant, ["query_id", "chunk_id"])
    return hits.agg(
        F.count(F.lit(1)).alias("n_relevant"), F.count_if(F.col("found_by_variant") > 0).alias("n_by_variant")
    )


def graded_answers(answers: DataFrame) -> DataFrame:
    """Stated facts, refusal flag and unverified numbers of every answer.

    ``answers``: ``case_id, answer, source, expected`` (array of strings).
    """
    stated = F.size(F.filter("expected", lambda e: states_value(F.col("answer"), e)))
    return answers.select(
        "case_id",
        stated.alias("stated"),
        F.size("expected").alias("total"),
        is_refusal(F.col("answer")).alias("refused"),
        F.array_join(unverified_values(F.col("answer"), F.col("source")), ", ").alias("unverified"),
    )


def tool_choice(cases: DataFrame) -> DataFrame:
    """``case_id, ok, reason`` from used, required and forbidden tool arrays."""
    missing = F.array_sort(F.array_except("required", "used"))
    wrong = F.array_sort(F.array_intersect("forbidden", "used"))
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("did not use "), F.array_join(missing, ", ")))
        .when(F.size(wrong) > 0, F.concat(F.lit("should not have used "), F.array_join(wrong, ", ")))
        .otherwise("ok")
    )
    return cases.select("case_id", ((F.size(missing) == 0) & (F.size(wrong) == 0)).alias("ok"), reason.alias("reason"))


def nearest_rank(values: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key, exact for keys of any size.

    Equal values are counted first; the counts are then summed along the value
    in buckets, so no task sees more than one bucket of distinct values.
    """
    counted = values.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    running = running_sum(counted, [key], [F.col(value)], F.floor(F.col(value)), F.col("n"), "upto")
    totals = counted.groupBy(key).agg(F.sum("n").alias("total"))
    joined = running.join(totals, key)
    picks = []
    for name, fraction in fractions.items():
        index = F.least(F.col("total") - 1, F.bround(F.lit(fraction) * (F.col("total") - 1), 0).cast("bigint"))
        picks.append(F.min(F.when(F.col("upto") > index, F.col(value))).alias(name))
    return joined.groupBy(key).agg(*picks)


def eval_summary(results: DataFrame) -> DataFrame:
    """Pass rates, latencies and step counts per agent.

    ``results``: ``agent, passed, steps, seconds, unverified, stopped_because,
    baseline_passed`` (NULL where the baseline gave no answer).
    """
    graded = F.col("baseline_passed").isNotNull()

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)), 3), F.lit(0.0))

    counts = results.groupBy("agent").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("passed").alias("passed"),
        F.percentile("steps", F.lit(0.5)).alias("median_steps"),
        F.count_if("unverified").alias("runs_with_unverified_values"),
        F.count_if(F.col("stopped_because") != "finished").alias("runs_hitting_step_limit"),
        F.count_if(graded).alias("baseline_cases"),
        F.count_if(graded & F.col("baseline_passed")).alias("baseline_passed"),
        F.count_if(graded & F.col("passed")).alias("agent_passed_on_baseline"),
    )
    latency = nearest_rank(results, "agent", "seconds", {"latency_p50": 0.5, "latency_p95": 0.95})
    return (
        counts.join(latency, "agent")
        .withColumn("pass_rate", rate(F.col("passed"), F.col("cases")))
        .withColumn("baseline_pass_rate", rate(F.col("baseline_passed"), F.col("baseline_cases")))
        .withColumn("agent_pass_rate_on_baseline", rate(F.col("agent_passed_on_baseline"), F.col("baseline_cases")))
        .drop("agent_passed_on_baseline")
    )


