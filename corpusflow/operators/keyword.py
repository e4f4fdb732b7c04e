"""Lexical index and BM25 ranking for whole batches of questions.

``chunks`` has ``chunk_id`` and ``text``; ``queries`` has ``query_id`` and
``text``. Postings are counted with a map-side partial aggregation, so what is
shuffled is one row per (chunk, term), never one per token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators.sizing import at_most, broadcast_if_small
from corpusflow.operators.topk import RANK_DIGITS, Best, id_array, result_schema
from corpusflow.session import staged, with_small_batches

K1 = 1.2
B = 0.75
BROADCAST_TERMS = 200_000
# Scores, and hits times queries, that a task holds at once.
SCORED_CELLS = 500_000
# Postings that a task orders by term at once.
POSTING_RUN = 500_000


def require_positive(**values: int) -> None:
    """Driver-side check of counts such as ``top_k``."""
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be a positive integer.")


def term_frequency(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, term, tf, doc_len)`` for every term of every chunk."""
    return _counted(_occurrences(chunks).filter(F.col("term").isNotNull()))


def _occurrences(chunks: DataFrame) -> DataFrame:
    """One row per token, plus one row with a NULL term for the chunk itself."""
    words = chunks.select("chunk_id", tx.tokens(F.col("text")).alias("tokens"))
    with_self = F.concat(F.col("tokens"), F.array(F.lit(None).cast("string")))
    # The outer form keeps the optimizer from adding a second tokenization as
    # a "not empty" filter at the scan.
    return words.select(
        "chunk_id", F.size("tokens").alias("doc_len"), F.explode_outer(with_self).alias("term")
    )


def _counted(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len")
    )


def query_postings(chunks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the query terms and the corpus statistics in one text pass.

    The counted rows are staged: the text is read and tokenized once, however
    many later steps use the counts.
    """
    vocabulary = broadcast_if_small(terms.select("term").distinct()).withColumn("known", F.lit(True))
    occurrences = _occurrences(chunks).join(vocabulary, "term", "left")
    counted = staged(_counted(occurrences.filter(F.col("term").isNull() | F.col("known"))))
    own = counted.filter(F.col("term").isNull())
    return counted.filter(F.col("term").isNotNull()), corpus_stats(own)


def chunk_postings(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One staged row per chunk: ``chunk_id, doc_len, hits`` (term number, tf).

    ``vocabulary``: ``term, term_no``. A chunk without a hit keeps its row,
    because its length counts in the average.
    """
    word = F.col("word")
    # A stop word becomes NULL and is not counted, but keeps its chunk.
    occurrences = chunks.select("chunk_id", F.explode_outer(tx.words(F.col("text"))).alias("word")).select(
        "chunk_id", F.when(~word.isin(tx.STOP_WORDS), word).alias("term")
    )
    counted = (
        occurrences.join(F.broadcast(vocabulary), "term", "left")
        .groupBy("chunk_id", "term_no")
        .agg(F.count("term").cast("int").alias("tf"))
    )
    hit = F.when(F.col("term_no").isNotNull(), F.struct("term_no", "tf"))
    return staged(
        counted.groupBy("chunk_id").agg(F.sum("tf").alias("doc_len"), F.collect_list(hit).alias("hits"))
    )


def doc_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tx.tokens(F.col("text"))).cast("bigint").alias("doc_len"))


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``term_frequency`` with ``doc_id``, counted inside the row of each chunk, so that nothing is shuffled.

    Rows come in runs of bounded size, each in order of terms.
    """
    order = ["chunk_id", "doc_id", "doc_len", "term", "tf"]
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in order[:2]) + ", doc_len int, term string, tf bigint"
    limit = POSTING_RUN

    def run(ids: list[list[pa.Array]], counts: list[Counter]) -> pa.RecordBatch:
        chunk = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
        place = np.empty(len(terms.dictionary), dtype=np.int64)
        place[pc.array_sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
        code = terms.indices.to_numpy()
        first = np.argsort(place[code], kind="stable")
        tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(chunk))
        length = np.array([c.total() for c in counts], dtype=np.int32)
        of = chunk[first]
        columns = [pa.concat_arrays(part).take(pa.array(of)) for part in zip(*ids)]
        columns += [pa.array(length[of]), terms.dictionary.cast(pa.string()).take(pa.array(code[first])), pa.array(tf[first])]
        return pa.RecordBatch.from_arrays(columns, order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, held = [], [], 0
        for batch in batches:
            start = 0
            for n, words in enumerate(_ascii_words(batch.column("text"))):
                counts.append(Counter(words))
                for word in STOP_BYTES:
                    counts[-1].pop(word, None)
                held += len(counts[-1])
                if held >= limit:
                    ids.append([batch.column(c).slice(start, n + 1 - start) for c in order[:2]])
                    yield run(ids, counts)
                    ids, counts, held, start = [], [], 0, n + 1
            ids.append([batch.column(c).slice(start) for c in order[:2]])
        if held:
            yield run(ids, counts)

    with_small_batches(chunks.sparkSession)
    return chunks.select("chunk_id", "doc_id", F.lower("text").alias("text")).mapInArrow(count, schema)


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """``doc_lengths`` with ``doc_id``, by the words that ``chunk_terms`` counts."""
    order = ["chunk_id", "doc_id"]
    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in order) + ", doc_len bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _ascii_words(batch.column("text"))
            lengths = pa.array([len(w) - sum(map(STOP_BYTES.__contains__, w)) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), lengths], [*order, "doc_len"])

    with_small_batches(chunks.sparkSession)
    return chunks.select(*order, F.lower("text").alias("text")).mapInArrow(count, schema)


# ``tx.words`` of lower-cased UTF-8: every byte that is no [a-z0-9] parts words.
WORD_BYTES = bytes(n if chr(n) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for n in range(256))
STOP_BYTES = frozenset(w.encode() for w in tx.STOP_WORDS)


def _ascii_words(lowered: pa.Array) -> Iterator[list[bytes]]:
    for text in lowered.cast(pa.binary()):
        yield (text.as_py() or b"").translate(WORD_BYTES).split()


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and average length, empty chunks included."""
    return lengths.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        (F.sum("doc_len") / F.count(F.lit(1))).alias("avg_len"),
    )


def idf_value(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def inverse_document_frequency(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``(term, df, idf)``; the one-row statistics arrive as a scalar subquery."""
    n_chunks = stats.select("n_chunks").scalar()
    return (
        postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", idf_value(n_chunks, F.col("df")))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, qtf)``."""
    return (
        queries.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(
    postings: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = K1, b: float = B
) -> DataFrame:
    """``(query_id, chunk_id, score)`` for chunks sharing a term with a query."""
    weights = inverse_document_frequency(postings, stats)
    wanted = terms.join(weights, "term").select(
        "query_id", "term", (F.col("idf") * F.col("qtf")).alias("weight")
    )
    # One row per (query, term): never larger than ``terms``, which is checked.
    if at_most(terms, BROADCAST_TERMS):
        wanted = F.broadcast(wanted)
    average = stats.select("avg_len").scalar()
    norm = 1 - b + b * (F.col("doc_len") / average)
    part = F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)
    return (
        postings.join(wanted, "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(part).alias("score"))
        .filter("score > 0")
        .withColumn("score", rounded("score"))
    )


def rounded(score: str) -> Column:
    """A score at the digits it is ranked by, rounded as the in-task lists round."""
    return F.rint(F.col(score) * 10.0**RANK_DIGITS) / 10.0**RANK_DIGITS


def rank_topk(
    scores: DataFrame, k: int | None, score: str = "score", keys: tuple[str, ...] = ("query_id",)
) -> DataFrame:
    """Best-first ``rank`` per query, cut at ``k`` before the shuffle and after it."""
    order = Window.partitionBy(*keys).orderBy(
        F.round(F.col(score), RANK_DIGITS).desc(), F.col("chunk_id").asc()
    )
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def bm25_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    k1: float = K1,
    b: float = B,
    max_shipped: int = BROADCAST_TERMS,
) -> DataFrame:
    """Top ``k`` chunks per query straight from text, without a stored index.

    While the (query, term) rows are few they are shipped to the tasks, which
    score their chunks and keep only their best ``k`` per query. A larger batch
    of questions is joined with the postings instead.
    """
    require_positive(top_k=k)
    terms = query_terms(queries)
    few = terms.limit(max_shipped + 1).collect()  # bounded
    if len(few) <= max_shipped:
        return rank_topk(_scored_in_tasks(chunks, few, k, k1, b), k)
    postings, stats = query_postings(chunks, terms)
    return rank_topk(bm25_scores(postings, stats, terms, k1, b), k)


def shares(batch: pa.RecordBatch, first: np.ndarray, n_queries: int, cells: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` (``chunk_id, doc_len, hits``) in slices of bounded work: at most ``cells`` scores and as many hits
    times the queries of their terms (a row that has more goes alone); ``first`` holds where each term's queries begin."""
    cells = SCORED_CELLS if cells is None else cells
    hits = batch.column("hits")
    fan = np.concatenate(([0], np.cumsum(np.diff(first)[hits.flatten().field(0).to_numpy(zero_copy_only=False)])))
    offsets = hits.offsets.to_numpy()
    upto = fan[offsets - offsets[0]]
    start, step = 0, max(1, cells // max(1, n_queries))
    while start < batch.num_rows:
        stop = int(np.searchsorted(upto, upto[start] + cells, "right")) - 1
        stop = min(max(stop, start + 1), start + step, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _scored_in_tasks(chunks: DataFrame, rows: list[Row], k: int, k1: float, b: float) -> DataFrame:
    numbers = _term_numbers(rows)
    vocabulary = chunks.sparkSession.createDataFrame(list(numbers.items()), VOCABULARY)
    table = chunk_postings(chunks, vocabulary)
    return _best_in_tasks(table, corpus_stats(table), rows, numbers, k, k1, b)


VOCABULARY = "term string, term_no int"


def _term_numbers(rows: list[Row]) -> dict[str, int]:
    return {term: n for n, term in enumerate(sorted({r["term"] for r in rows}))}


def stored_topk(
    postings: DataFrame, stats: DataFrame, terms: DataFrame, k: int, k1: float = K1, b: float = B,
    max_shipped: int = BROADCAST_TERMS,
) -> DataFrame:
    """Top ``k`` chunks per query (``terms``) from postings that are counted already.

    As in ``bm25_topk``, few (query, term) rows are shipped to the tasks: what
    is shuffled is one row per hit, never one per hit and query.
    """
    few = terms.limit(max_shipped + 1).collect()  # bounded
    if len(few) > max_shipped:
        postings = staged(postings.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi"))
        return rank_topk(bm25_scores(postings, stats, terms, k1, b), k)
    numbers = _term_numbers(few)
    vocabulary = postings.sparkSession.createDataFrame(list(numbers.items()), VOCABULARY)
    # Postings lie in order of terms: gathering a chunk's hits before they are dealt would only sort them twice.
    hits = postings.join(F.broadcast(vocabulary), "term").repartition("chunk_id")
    table = staged(hits.groupBy("chunk_id").agg(
        F.first("doc_len").alias("doc_len"), F.collect_list(F.struct("term_no", F.col("tf").cast("int").alias("tf"))).alias("hits")
    ))
    return rank_topk(_best_in_tasks(table, stats, few, numbers, k, k1, b), k)


def _best_in_tasks(
    table: DataFrame, stats: DataFrame, rows: list[Row], numbers: dict[str, int], k: int, k1: float, b: float
) -> DataFrame:
    """Scores of a staged ``table`` (``chunk_id, doc_len, hits``), the best ``k`` per query and task."""
    spark = table.sparkSession
    # One row for the corpus and one per query term.
    n_chunks, average = stats.first()
    found = table.select(F.explode("hits").alias("h")).groupBy("h.term_no").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(numbers))
    for term_no, count in found.collect():
        df[term_no] = count
    idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
    # Queries of each term, as one slice of two flat arrays.
    query_ids = np.array(sorted({r["query_id"] for r in rows}), dtype=np.int64)
    place = {q: n for n, q in enumerate(query_ids.tolist())}
    pairs = sorted((numbers[r["term"]], place[r["query_id"]], r["qtf"]) for r in rows)
    term_of = np.array([p[0] for p in pairs], dtype=np.int64)
    query_of = np.array([p[1] for p in pairs], dtype=np.int64)
    weight_of = idf[term_of] * np.array([p[2] for p in pairs], dtype=np.float64) if pairs else np.zeros(0)
    first = np.searchsorted(term_of, np.arange(len(numbers) + 1))
    payload = spark.sparkContext.broadcast((query_ids, query_of, weight_of, first))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, queries_of, weights, slices = payload.value
        best = Best(len(ids_q), k)
        for whole in batches:
            for batch in shares(whole, slices, len(ids_q)):
                hits = batch.column("hits")
                flat = hits.flatten()
                if len(flat) == 0:
                    continue
                term_no, tf = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                sizes = np.diff(hits.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                length = batch.column("doc_len").to_numpy()[row]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
                # Every hit meets all queries of its term.
                fan = slices[term_no + 1] - slices[term_no]
                begin = np.repeat(slices[term_no] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan)
                at = begin + np.arange(fan.sum())
                cell = queries_of[at] * batch.num_rows + np.repeat(row, fan)
                total = np.bincount(
                    cell, weights=weights[at] * np.repeat(part, fan), minlength=len(ids_q) * batch.num_rows
                ).reshape(len(ids_q), batch.num_rows)
                best.add(np.where(total > 0, total, -np.inf), id_array(batch.column("chunk_id")))
        kept = best.batch(ids_q)
        if kept is not None:
            yield kept

    hit_rows = table.filter(F.size("hits") > 0)
    return hit_rows.mapInArrow(score, result_schema(table))


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("term_bucket")


def write_index(chunks: DataFrame, folder: str, buckets: int = 64) -> None:
    """Store postings, hashed by term, and the statistics as parquet."""
    spark = chunks.sparkSession
    # A salt inside the term bucket keeps the posting list of a term that
    # occurs in a third of all chunks from becoming one file.
    postings = term_frequency(chunks).select("*", _term_bucket(buckets))
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, math.isqrt(buckets))))
    (
        postings.repartition("term_bucket", salt)
        .sortWithinPartitions("term_bucket", "term")
        .write.mode("overwrite")
        .partitionBy("term_bucket")
        .parquet(f"{folder}/postings")
    )
    corpus_stats(doc_lengths(chunks)).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    spark.catalog.refreshByPath(folder)


def search_index(spark, folder: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over a stored index, which holds counted and sorted postings."""
    require_positive(top_k=k)
    stored = spark.read.parquet(f"{folder}/postings")
    stats = spark.read.parquet(f"{folder}/stats")
    buckets = stats.first()["buckets"]
    terms = staged(query_terms(queries))
    vocabulary = terms.select("term", _term_bucket(buckets)).distinct()
    # At most ``buckets`` numbers: the scan opens only the folders of the questions' terms.
    wanted = [r["term_bucket"] for r in vocabulary.select("term_bucket").distinct().collect()]
    hit = stored.filter(F.col("term_bucket").isin(wanted)).join(vocabulary, ["term_bucket", "term"], "left_semi")
    postings = hit.select("chunk_id", "term", "tf", "doc_len")
    return rank_topk(bm25_scores(postings, stats, terms), k)
