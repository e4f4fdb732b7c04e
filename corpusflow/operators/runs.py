"""Agent-run logs: parentage, budgets, evidence labels, roll-ups.

A run tree may hold a large share of all rows, so nothing here gathers a tree:
positions come from ``ordered`` and everything else is an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.ordered import ranked
from corpusflow.operators.sizing import broadcast_if_small
from corpusflow.session import staged

# Fixed values ---------------------------------------------------------------
TREE_STEPS = 14
RUN_STEPS = 6
EVIDENCE_CHARS = 700
BADGE_TOOLS = ("read_image", "research_documents", "call_external_api")
NO_STEPS = "(nothing yet - this is your first step)"
# End of fixed values --------------------------------------------------------


def parentage(runs: DataFrame) -> DataFrame:
    """``run_id, root_id, depth`` of every run by pointer doubling.

    ``runs``: ``run_id, parent_id`` (NULL for a root). Each round replaces the
    known ancestor by that ancestor's own, so a tree of depth d takes log2(d)
    rounds; finished runs leave the join, and each round is staged. A run whose
    parent is not in the table is a root. Runs on a circle, or below one, have
    a NULL root and depth.
    """
    present = runs.select(F.col("run_id").alias("parent_id"), F.lit(True).alias("known"))
    linked = runs.join(present, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id")))
    start = linked.select(
        "run_id",
        F.coalesce("parent_id", "run_id").alias("ancestor"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"),
        F.col("parent_id").isNull().alias("at_root"),
    )
    state = staged(start)
    open_left, reach = state.filter(~F.col("at_root")).count(), 1
    total = None
    while open_left:
        above = state.select(
            F.col("run_id").alias("ancestor"),
            F.col("ancestor").alias("next"),
            F.col("depth").alias("more"),
            F.col("at_root").alias("top"),
        )
        moved = state.filter(~F.col("at_root")).join(above, "ancestor").select(
            "run_id", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"),
            F.col("top").alias("at_root"),
        )
        state = staged(state.filter("at_root").unionByName(moved))
        reach *= 2
        left = state.filter(~F.col("at_root")).count()
        # No path is longer than there are runs: what is open after that goes round in circles.
        if left == open_left:
            total = state.count() if total is None else total
            if reach > total:
                break
        open_left = left
    return state.select("run_id", F.when(F.col("at_root"), F.col("ancestor")).alias("root_id"), F.when(F.col("at_root"), F.col("depth")).alias("depth"))


def first_positions(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows with ``first_position`` of their key; aggregated before the join."""
    first = rows.groupBy(*keys).agg(F.min(position).alias("first_position"))
    return rows.join(first, keys)


def evidence_labels(shown: DataFrame, bucket_rows: int = 10_000) -> DataFrame:
    """Stable ``label`` by first appearance in a tree and ``is_new`` per showing.

    ``shown``: ``root_id, chunk_id, position``.
    """
    first = shown.groupBy("root_id", "chunk_id").agg(F.min("position").alias("first_position"))
    labelled = ranked(
        first, ["root_id"], [F.col("first_position"), F.col("chunk_id")],
        F.floor(F.col("first_position") / bucket_rows), "n",
    ).select("root_id", "chunk_id", "first_position", F.concat(F.lit("E"), F.col("n").cast("string")).alias("label"))
    return shown.join(labelled, ["root_id", "chunk_id"]).withColumn(
        "is_new", F.col("position") == F.col("first_position")
    ).drop("first_position")


def evidence_text(text: Column, limit: int = EVIDENCE_CHARS) -> Column:
    """What is shown of a passage's text."""
    return tx.clip(tx.strip(text), limit, " […]")


def evidence_block(label: Column, where: Column, shown: Column, is_new: Column) -> Column:
    """One passage as shown to an agent (``shown``: its ``evidence_text``); a repeat is a one-line pointer."""
    head = F.concat(F.lit("["), label, F.lit("] "), where)
    return F.when(is_new, F.concat(head, F.lit("\n"), shown)).otherwise(
        F.concat(head, F.lit(" (already shown above, not repeated)"))
    )


def evidence_reports(shown: DataFrame, chunks: DataFrame, few_chunks: int = 20_000) -> DataFrame:
    """``root_id, search_no, report``: what each search of a tree showed, in order of position.

    ``shown``: ``root_id, chunk_id, position, search_no``. Each chunk is cut to
    what is shown of it once, before it meets its showings, so their number
    costs nothing of the length of texts; of chunks that are shown nothing is
    moved but these. One search shows a bounded number of passages.
    """
    place = place_of(F.col("filename"), F.col("page"), F.col("section")).alias("place")
    asked = staged(shown.select("chunk_id").distinct())
    passages = chunks.select("chunk_id", place, evidence_text(F.col("text")).alias("passage"))
    passages = staged(passages.join(broadcast_if_small(asked), "chunk_id", "left_semi"))
    joined = evidence_labels(shown).join(broadcast_if_small(passages, few_chunks), "chunk_id").select(
        "root_id", "search_no", "position",
        evidence_block(F.col("label"), F.col("place"), F.col("passage"), F.col("is_new")).alias("block"),
    )
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda b: b["block"])
    head = F.concat(
        F.count(F.lit(1)).cast("string"), F.lit(' passage(s) for "search '), F.col("search_no").cast("string"), F.lit('":\n\n')
    )
    return joined.groupBy("root_id", "search_no").agg(F.concat(head, F.array_join(blocks, "\n\n")).alias("report"))


def place_of(filename: Column, page: Column, section: Column) -> Column:
    base = F.concat(filename, F.lit(" p."), page.cast("string"))
    return F.when(F.coalesce(section, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" — "), section))


def repeated_queries(searches: DataFrame) -> DataFrame:
    """Add ``is_repeat``: the folded query was already asked in this run.

    ``searches``: ``run_id, position, query``.
    """
    folded = searches.withColumn("folded", tx.fold(F.col("query")))
    located = first_positions(folded, ["run_id", "folded"], "position")
    return located.withColumn("is_repeat", F.col("position") > F.col("first_position")).drop(
        "folded", "first_position"
    )


def budget_audit(
    steps: DataFrame, tree_steps: int = TREE_STEPS, run_steps: int = RUN_STEPS, bucket_rows: int = 10_000
) -> DataFrame:
    """Which limit stops a step: the run's own ceiling or the tree's pool.

    ``steps``: ``root_id, run_id, position``. A step over its run's ceiling
    takes nothing from the pool.
    """
    bucket = F.floor(F.col("position") / bucket_rows)
    own = ranked(steps, ["root_id", "run_id"], [F.col("position")], bucket, "run_rank")
    within = own.filter(F.col("run_rank") <= run_steps)
    pooled = ranked(within, ["root_id"], [F.col("position")], bucket, "pool_rank")
    beyond = own.filter(F.col("run_rank") > run_steps).withColumn("pool_rank", F.lit(None).cast("bigint"))
    status = F.when(F.col("pool_rank").isNull(), "run ceiling").when(
        F.col("pool_rank") > tree_steps, "tree pool"
    ).otherwise("taken")
    return pooled.unionByName(beyond).withColumn("status", status)


def rollup(steps: DataFrame) -> DataFrame:
    """Steps, seconds and distinct tools per tree and agent (and per tree)."""
    return steps.groupingSets([["root_id"], ["root_id", "agent"]], "root_id", "agent").agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum("seconds").alias("seconds"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
    )


def call_sequences(steps: DataFrame) -> DataFrame:
    """Ordered tools of every run, and how many runs share the sequence.

    A run has a bounded number of steps (see ``budget_audit``).
    """
    tools = F.transform(F.array_sort(F.collect_list(F.struct("position", "tool"))), lambda s: s["tool"])
    runs = steps.groupBy("run_id").agg(F.array_join(tools, ",").alias("sequence"))
    return runs.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_runs"))


def transcript(steps: DataFrame) -> DataFrame:
    """``run_id, transcript``: the numbered steps of a run as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "thought", "action", "observation")))

    def block(step: Column, i: Column) -> Column:
        return F.concat(
            F.lit("Step "), (i + 1).cast("string"), F.lit("\nThought: "), step["thought"],
            F.lit("\nAction: "), step["action"], F.lit("\nObservation: "), step["observation"],
        )

    text = F.array_join(F.transform(ordered, block), "\n\n")
    return steps.groupBy("run_id").agg(text.alias("transcript"))


def with_empty_transcript(runs: DataFrame, transcripts: DataFrame) -> DataFrame:
    joined = runs.select("run_id").join(transcripts, "run_id", "left")
    return joined.withColumn("transcript", F.coalesce("transcript", F.lit(NO_STEPS)))


def delegation_badge(delegations: DataFrame) -> DataFrame:
    """``run_id, badge``: the one specialist used, several, or none."""
    used = F.collect_set(F.when(F.col("tool").isin(*BADGE_TOOLS), F.col("tool")))
    badge = F.when(F.size("used") == 0, "answer_directly").when(
        F.size("used") > 1, "multiple_specialists"
    ).otherwise(F.get("used", F.lit(0)))
    return delegations.groupBy("run_id").agg(used.alias("used")).select("run_id", badge.alias("badge"))
