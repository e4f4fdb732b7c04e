import pickle
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators import memory as me
from corpusflow.operators import ordered as od
from corpusflow.operators import runs as ru
from corpusflow.sources import store as st
from corpusflow.streaming import frames as fr
from corpusflow.streaming import rules
from corpusflow.streaming.ingest import compaction_stream
from corpusflow.streaming.sinks import read_file_stream, run_counting_late


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; values are sparse."""
    rng = np.random.default_rng(1)
    rows = [(0 if i % 10 else int(i % 7), i, int(rng.integers(0, 5)) if i % 3 else None) for i in range(900)]
    return spark.createDataFrame(rows, "k int, n bigint, v int").cache()


def test_ordered_scans_equal_plain_windows(hot):
    w = Window.partitionBy("k").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    args = (["k"], [F.col("n")], F.floor(F.col("n") / 50))
    got = od.ranked(hot, *args, "rank")
    got = od.running_sum(got, *args, F.coalesce("v", F.lit(0)), "total")
    got = od.last_known(got, *args, F.col("v"), "known")
    got = od.previous(got, *args, F.col("v"), "before")
    got = od.preceding(got, *args, F.col("n"), 4, "held", block=16)
    want = hot.select(
        "*", F.row_number().over(w).alias("rank"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("total"),
        F.last("v", ignorenulls=True).over(upto).alias("known"), F.lag("v").over(w).alias("before"),
        F.collect_list("n").over(w.rowsBetween(-4, -1)).alias("held"),
    )
    columns = ["k", "n", "rank", "total", "known", "before", "held"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def greedy(times, interval):
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= interval:
            kept.append(i)
            last = t
    return kept


@pytest.mark.parametrize("block_intervals", [2, 5, 4096])
def test_interval_sample_against_brute_force(spark, block_intervals):
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for session in range(6):
        gaps = rng.exponential(0.4 if session % 2 else 2.0, 150).round(1)
        times = np.cumsum(gaps).round(1).tolist()
        rows += [(session, session * 1000 + i, float(t)) for i, t in enumerate(times)]
        want |= {(session, session * 1000 + i) for i in greedy(times, 2.0)}
    df = spark.createDataFrame(rows, "session_id bigint, frame_id bigint, t double")
    got = fr.interval_sample(df, 2.0, block_intervals).collect()
    assert {(r["session_id"], r["frame_id"]) for r in got} == want and len(got) == len(want)


def frames_table(spark, rows):
    df = spark.createDataFrame(rows, "session_id bigint, frame_id bigint, t double, summary string, valid boolean, is_end boolean")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def streamed(spark, df, processor, folder, delay="10 minutes", parts=1):
    """The stream's rows and its late rows; the frames come in ``parts`` files, then two heartbeats."""
    rows = df.collect()
    for n in range(parts):
        spark.createDataFrame(rows[n::parts], df.schema).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):
        beat = frames_table(spark, [(0, 0, 1e6, "", False, False)])
        beat.write.mode("append").parquet(folder)
    source = read_file_stream(spark, folder, "*.parquet", df.schema, 1)
    return run_counting_late(fr.frame_stream(source, processor, delay))


def test_stream_sessions(spark, tmp_path):
    rows = [
        (1, 1, 0.0, "a", True, False), (1, 2, 1.0, "b", True, False), (1, 3, 2.0, "c", True, False),
        (1, 4, 2.5, "bad", False, False), (1, 5, 4.0, "d", True, False),
        (1, 6, 400.0, "after pause", True, False), (1, 7, 401.0, "", True, True), (1, 8, 401.5, "e", True, False),
        (2, 9, 0.5, "z", True, False),
    ]
    rows = [(s, f, t + 1000.0, *rest) for s, f, t, *rest in rows]  # after the first watermark
    out, late = streamed(spark, frames_table(spark, rows), fr.FrameSessions("interval", 2.0, size=1), str(tmp_path / "in"))
    got = {r["frame_id"]: r["context"] for r in out.filter("sampled").collect()}
    assert got == {1: "", 3: "Frame 1: a", 5: "Frame 1: c", 6: "", 8: "", 9: ""}
    assert out.count() == 7 and late == 0


def test_stream_does_not_depend_on_order_of_arrival(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for session in range(4):
        times = 5000.0 + np.cumsum(rng.choice([0.0, 0.5, 3.0, 40.0], 40, p=[0.1, 0.5, 0.3, 0.1]))
        rows += [
            (session, session * 100 + i, float(t), f"s{i}" if i % 5 else None, i % 7 != 3, i % 11 == 10)
            for i, t in enumerate(times)
        ]

    def processor():
        return fr.FrameSessions("interval", 2.0, size=2, ttl=30.0)

    def walk(session):
        state = (None, 0, None, [])
        ordered = sorted(r[2:3] + r[1:2] + (r[3], r[5]) for r in rows if r[0] == session and r[4])
        return processor()._apply(session, state, ordered)[1]

    want = sorted(str(r) for session in range(4) for r in walk(session))
    rng.shuffle(rows)
    rows = [(int(s), int(f), float(t), x, bool(v), bool(e)) for s, f, t, x, v, e in rows]
    out, late = streamed(spark, frames_table(spark, rows), processor(), str(tmp_path / "in"), "1 hour", parts=3)
    assert sorted(str(tuple(r)) for r in out.collect()) == want and late == 0


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    times = [5000.0, 5001.0, 5002.0, 1000.0]
    rows = [(1, i, t, "x", True, False) for i, t in enumerate(times)]
    out, late = streamed(spark, frames_table(spark, rows), fr.FrameSessions("frame_count", every=1), str(tmp_path / "in"), "1 minute", 4)
    assert sorted(r["frame_id"] for r in out.collect()) == [0, 1, 2] and late == 1


def test_evidence_is_cut_once_a_chunk(spark):
    shown = spark.createDataFrame(
        [(1, 7, 0, 0), (1, 8, 1, 0), (1, 7, 2, 0), (1, 9, 3, 0), (2, 7, 600, 1)], "root_id bigint, chunk_id bigint, position bigint, search_no bigint"
    )
    chunks = spark.createDataFrame(
        [(7, "  " + "x" * 710, "f", 1, "en"), (8, "short ", "g", 2, ""), (10, "never", "h", 3, "")],
        "chunk_id bigint, text string, filename string, page bigint, section string",
    )
    got = ru.evidence_reports(shown, chunks)
    long = "x" * 700 + " […]"
    assert {r["root_id"]: r["report"] for r in got.collect()} == {
        1: f'3 passage(s) for "search 0":\n\n[E1] f p.1 — en\n{long}\n\n[E2] g p.2\nshort\n\n[E1] f p.1 — en (already shown above, not repeated)',
        2: f'1 passage(s) for "search 1":\n\n[E1] f p.1 — en\n{long}',
    }
    # Texts were trimmed and cut before they met the showings: none of it is left to do for each of these.
    assert "trim(" not in got._jdf.queryExecution().optimizedPlan().toString()


class Kept:
    """A state handle in memory that counts the bytes read from it."""

    def __init__(self):
        self.values, self.timers, self.bytes_read = {}, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(
            get=lambda: self._read(name), update=lambda v: self.values.__setitem__(name, v), clear=lambda: self.values.pop(name, None)
        )

    def getMapState(self, name, key, schema):
        return SimpleNamespace(
            getValue=lambda k: self._read(k), updateValue=self.values.__setitem__, removeKey=lambda k: self.values.pop(k, None)
        )

    def _read(self, name):
        value = self.values.get(name)
        self.bytes_read += sum(len(v) for v in value or () if isinstance(v, bytes))
        return value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


@pytest.mark.parametrize("moves", [4, 256])
def test_waiting_rows_are_not_read_at_every_move_of_the_watermark(moves):
    rng = np.random.default_rng(moves)
    n = 40_000
    times = rng.permutation(n).astype(float)
    frames = pd.DataFrame({"t": times, "frame_id": np.arange(n), "summary": "s", "is_end": False, "valid": True})
    handle, out = Kept(), []
    processor = fr.FrameSessions("frame_count", every=1, ttl=None)
    processor.init(handle)
    for part in np.array_split(np.arange(n), 4):
        assert list(processor.handleInputRows((7,), iter([frames.iloc[part]]), None)) == []
    for watermark in np.linspace(0, n, moves + 1)[1:]:
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: int(watermark * 1000))
        for at in sorted(at for at in handle.timers if at <= watermark * 1000):
            for rows in processor.handleExpiredTimer((7,), now, None):
                out += rows["frame_id"].tolist()
            handle.timers.discard(at)
    assert out == np.argsort(times).tolist()
    # Before, all that waited was read at every move: half of it 256 times.
    assert handle.bytes_read < 12 * len(pickle.dumps(list(zip(times.tolist(), range(n), ["s"] * n, [False] * n))))


def test_session_rules(spark):
    rows = [(1, i, t) for i, t in enumerate([0.0, 300.0, 600.5, 601.0])]
    df = spark.createDataFrame(rows, "session_id bigint, frame_id bigint, t double")
    got = {r["frame_id"]: r["session_no"] for r in fr.sessions_by_gap(df, 300.0).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        fr.frame_count_sample(df, 0)
    with pytest.raises(ValueError):
        fr.FrameSessions("sometimes")


def test_observations(spark):
    rows = [
        ('```json\n{"objects": [" cup ", 3, ""], "warnings": "none"}\n```',), ("plain words",), ("{}",), ("[1]",), ("",),
    ]
    got = rules.observations(spark.createDataFrame(rows, "reply string")).collect()
    assert [r["summary"] for r in got] == ["cup; 3", "plain words", "{}", "[1]", "(no notable observations)"]
    assert got[0]["objects"] == ["cup", "3"] and got[0]["warnings"] == []


def test_sizes_in_reasons_round_ties_to_even(one):
    frame = lambda n: one(lambda a, b, c: rules.frame_reason(a, b, c), "s", "image/png", n)
    audio = lambda n: one(lambda a, b, c: rules.audio_reason(a, b, c), "a.mp3", "", n)
    for n in (163_840_000, 491_520_000, 5_505_024, 6_029_312, 5_347_738):
        assert f"is {n / 1048576:.1f}MB," in frame(n), n
    assert "is 156.2MB," in audio(163_840_000)


def test_frame_and_audio_reasons(one):
    reason = lambda s, m, n: one(lambda a, b, c: rules.frame_reason(a, b, c), s, m, n)
    assert reason(" ", "image/png", 1) == "sessionId must not be empty."
    assert reason("s", "image/gif", 1).startswith("Unsupported frame type 'image/gif'")
    assert reason("s", "image/png", 0) == "frame must not be empty."
    assert reason("s", "image/png", 6 * 1024 * 1024) == "Frame is 6.0MB, which exceeds the 5MB limit for a single sampled frame."
    assert reason("s", "image/png", 10) is None
    audio = lambda f, m, n: one(lambda a, b, c: rules.audio_reason(a, b, c), f, m, n)
    assert audio("x.MP3", "text/plain", 5) is None
    assert audio("x.txt", "audio/wav", 5) is None
    assert audio("x.txt", "", 5) == "Unsupported audio file 'x.txt' (type 'unknown'). Supported formats: mp3, wav, m4a, webm."


def talk(spark, n, conv=1):
    rows = [(conv, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "conv_id bigint, msg_id bigint, role string, content string")


def no_marks(spark):
    return spark.createDataFrame([], "conv_id bigint, covered_through_id bigint")


def test_compaction_waits_for_a_full_window_and_the_trigger(spark):
    assert me.compaction_slice(talk(spark, 3), no_marks(spark), 4, 2).count() == 0
    assert me.compaction_slice(talk(spark, 5), no_marks(spark), 4, 2).count() == 0
    got = me.compaction_slice(talk(spark, 7), no_marks(spark), 4, 2).orderBy("msg_id").collect()
    assert [r["msg_id"] for r in got] == [1, 2, 3] and got[0]["new_mark"] == 3
    marks = spark.createDataFrame([(1, 2)], "conv_id bigint, covered_through_id bigint")
    assert me.compaction_slice(talk(spark, 7), marks, 4, 2).count() == 0


def test_no_message_is_summarised_and_in_the_window(spark):
    rows = talk(spark, 9)
    covered = {r["msg_id"] for r in me.compaction_slice(rows, no_marks(spark), 4, 2).collect()}
    window = {r["msg_id"] for r in me.history_window(rows, 4).collect()}
    assert covered | window == set(range(1, 10)) and not covered & window


def test_compaction_stream_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = talk(spark, 9)
    rows.filter("msg_id <= 5").coalesce(1).write.parquet(source)
    rows.filter("msg_id > 5").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = read_file_stream(spark, source, "*.parquet", rows.schema, 1)
        compaction_stream(stream, str(tmp_path / "out"), 4, 2)
        marks = st.read_store(spark, str(tmp_path / "out/marks"), "conv_id")
        assert [tuple(r) for r in marks.collect()] == [(1, 5)]


def test_search_and_titles(spark):
    rows = talk(spark, 3).withColumn("created_order", F.col("msg_id"))
    assert [r["msg_id"] for r in me.message_search(rows, "M").collect()] == []
    assert [r["msg_id"] for r in me.message_search(rows, "M2").collect()] == [2]
    assert me.chat_titles(talk(spark, 2)).first()["title"] == "m1"


def test_store_layers_upsert_and_fingerprint(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert st.read_store(spark, folder) is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, text string")
    st.publish(first, folder)
    st.append(spark.createDataFrame([(2, "old"), (3, "c")], first.schema), folder)
    st.append(spark.createDataFrame([(2, "new")], first.schema), folder)
    now = st.read_store(spark, folder)
    rows = {tuple(r) for r in now.collect()}
    assert rows == {(1, "a"), (2, "new"), (3, "c")}
    token = lambda df: st.fingerprint(df, "chunk_id", "text").first()["token"]
    assert token(now) == token(now.repartition(3)) != token(first)
    # A layer without its success mark was never finished.
    (tmp_path / "store" / "d9").mkdir()
    assert {tuple(r) for r in st.read_store(spark, folder).collect()} == rows
    for i in range(20):  # no write folds the store; compacting it is a job of its own
        st.append(spark.createDataFrame([(4, f"d{i}")], first.schema), folder)
    assert len(st._layers(spark, folder)[1]) >= 20
    st.append(spark.createDataFrame([(5, "e", "x")], "chunk_id int, text string, section string"), folder)
    after = {(r["chunk_id"], r["text"], r["section"]) for r in st.read_store(spark, folder).collect()}
    assert after == {(*r, None) for r in rows | {(4, "d19")}} | {(5, "e", "x")}
    st.compact(spark, folder)
    assert st._layers(spark, folder)[1] == []
    assert {(r["chunk_id"], r["text"], r["section"]) for r in st.read_store(spark, folder).collect()} == after
    twice = spark.createDataFrame([(1, "a"), (1, "a")], first.schema)
    assert token(twice) != token(first.limit(0))


def test_two_writers_never_share_a_layer(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert len({st._claim(spark, folder) for _ in range(5)}) == 5


def test_attachments(spark):
    rows = [(bytearray(b"x"), "IMAGE/JPG "), (bytearray(b"x"), "image/jpeg"), (bytearray(b""), "image/png"), (bytearray(b"y"), "text/html")]
    refs = st.attachment_refs(spark.createDataFrame(rows, "content binary, mime string"))
    assert [r["canonical_mime"] for r in refs.collect()] == ["image/jpeg", "image/jpeg", None, None]
    assert st.stored_once(refs).count() == 1


def test_run_parentage_of_a_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(40)] + [(100, None)]
    got = {r["run_id"]: (r["root_id"], r["depth"]) for r in ru.parentage(spark.createDataFrame(rows, "run_id bigint, parent_id bigint")).collect()}
    assert got == {**{i: (0, i) for i in range(40)}, 100: (100, 0)}


def test_run_parentage_of_orphans_and_circles(spark):
    rows = [(1, None), (2, 1), (5, 99), (6, 5), (10, 11), (11, 12), (12, 10), (13, 12)] + [(1000 + i, 999 + i if i else None) for i in range(1500)]
    got = {r["run_id"]: (r["root_id"], r["depth"]) for r in ru.parentage(spark.createDataFrame(rows, "run_id bigint, parent_id bigint")).collect()}
    assert len(got) == len(rows) and got[2] == (1, 1) and got[5] == (5, 0) and got[6] == (5, 1)
    assert all(got[i] == (None, None) for i in (10, 11, 12, 13)) and got[2499] == (1000, 1499)


def test_budget_audit_against_a_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(r), f"{r}/{rng.integers(0, 4)}", i) for i, r in enumerate(rng.integers(0, 2, 80))]
    want, taken, own = {}, {}, {}
    for root, run, i in rows:
        own[run] = own.get(run, 0) + 1
        if own[run] > 6:
            want[i] = "run ceiling"
        else:
            taken[root] = taken.get(root, 0) + 1
            want[i] = "taken" if taken[root] <= 14 else "tree pool"
    df = spark.createDataFrame(rows, "root_id bigint, run_id string, position bigint")
    assert {r["position"]: r["status"] for r in ru.budget_audit(df, bucket_rows=10).collect()} == want


def test_media_turns(spark):
    schema = "exchange_id int, conv_id int, question string, transcript string, analysis string, ref string"
    rows = [(1, 1, None, "hello there", "fine", "r"), (2, 1, "what?", "", "ignored", None)]
    got = {(r["exchange_id"], r["role"]): r["content"] for r in me.media_turns(spark.createDataFrame(rows, schema), 5).collect()}
    assert got[(1, "user")] == "Summarise this audio.\n\n[Transcript of the attached audio: hello... (transcript truncated; 11 characters in full)]"
    assert got[(1, "assistant")] == "fine"
    assert got[(2, "user")] == "what?" and got[(2, "assistant")].startswith("No speech")


