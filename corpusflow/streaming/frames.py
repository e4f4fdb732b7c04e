"""Sampling, context and expiry of frame sessions, in batch and as a stream.

Frames: ``session_id, frame_id, t`` (event time in seconds, ties by frame id).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators.ordered import last_known, preceding, previous, ranked, running_sum

# Fixed values ---------------------------------------------------------------
INTERVAL_SECONDS = 2.0
SAMPLE_EVERY = 10
CONTEXT_FRAMES = 10
SESSION_TTL = 300.0
# End of fixed values --------------------------------------------------------

DAY = 86_400


def _order() -> list[Column]:
    return [F.col("t"), F.col("frame_id")]


def _day() -> Column:
    return F.floor(F.col("t") / DAY)


# Batch ---------------------------------------------------------------------------


def frame_count_sample(frames: DataFrame, every: int = SAMPLE_EVERY, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Keep the 1st, (N+1)th, (2N+1)th, ... frame of every session."""
    if every <= 0:
        raise ValueError("every must be a positive integer.")
    numbered = ranked(frames, list(keys), _order(), _day(), "n")
    return numbered.filter((F.col("n") - 1) % every == 0).drop("n")


def _next_kept(t: np.ndarray, interval: float) -> np.ndarray:
    """Index of the frame kept after each frame; ``len(t)`` when none is left."""
    after = np.searchsorted(t, t + interval, side="left")
    # The rule is a difference of times; the sum above may round the other way.
    while (early := (after > 0) & (t[after - 1] - t >= interval)).any():
        after = after - early
    padded = np.append(t, np.inf)
    while (late := (after < len(t)) & (padded[after] - t < interval)).any():
        after = after + late
    return after


def interval_sample(frames: DataFrame, interval: float = INTERVAL_SECONDS, block_intervals: int = 4096) -> DataFrame:
    """First frame, then each frame at least ``interval`` after the last kept.

    A pause of at least ``interval`` always ends in a kept frame, so sessions
    fall apart into islands that do not depend on each other. Most islands are
    settled by their first frame. A long island without any pause is cut into
    blocks of time: each block says for each of its few possible first frames
    where the choice leaves off in the next block, those pointers are followed
    per island, and then all blocks are walked at once.
    """
    if interval <= 0:
        raise ValueError("interval must be positive.")
    width = interval * max(2, block_intervals)
    stepped = previous(frames, ["session_id"], _order(), _day(), F.col("t"), "before")
    opens = F.col("before").isNull() | (F.col("t") - F.col("before") >= interval)
    flagged = stepped.withColumn("opens", opens).drop("before")
    placed = last_known(
        flagged, ["session_id"], _order(), _day(), F.when(F.col("opens"), F.col("t")), "island"
    )
    extra = [c for c in frames.columns if c not in ("session_id", "frame_id", "t")]
    long_islands = (
        placed.groupBy("session_id", "island")
        .agg(F.max("t").alias("last"))
        .filter(F.col("last") - F.col("island") >= interval)
        .select("session_id", "island", (F.col("last") - F.col("island") >= width).alias("many"))
    )
    slim = placed.join(long_islands, ["session_id", "island"]).select("session_id", "island", "frame_id", "t", "many")
    offset = F.col("t") - F.col("island")
    own = F.floor(offset / width)
    at_start = (own > 0) & (offset - own * width < 2 * interval)
    blocks = slim.withColumn("own", own).withColumn(
        "block", F.explode(F.when(at_start, F.array(own - 1, own)).otherwise(F.array(own)))
    )
    group = ["session_id", "island", "block"]

    def transitions(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "frame_id"])
        t, ids = pdf["t"].to_numpy(), pdf["frame_id"].to_numpy()
        block, island = pdf["block"].iloc[0], pdf["island"].iloc[0]
        inside = (pdf["own"] == block).to_numpy()
        follow = _next_kept(t, interval)
        limit = 2 * interval if block > 0 else 0
        start = np.flatnonzero(inside & (t - island - block * width <= limit))
        if block == 0:
            start = start[:1]
        cur = start.copy()
        while True:
            moving = cur < len(t)
            moving[moving] = inside[cur[moving]]
            if not moving.any():
                break
            cur[moving] = follow[cur[moving]]
        ended = cur >= len(t)
        onward = np.where(ended, -1, ids[np.minimum(cur, len(t) - 1)])
        return pd.DataFrame(
            {"session_id": pdf["session_id"].iloc[0], "island": island, "block": block, "entry": ids[start], "onward": onward}
        )

    def follow_pointers(pdf: pd.DataFrame) -> pd.DataFrame:
        pointers = {(b, e): o for b, e, o in zip(pdf["block"], pdf["entry"], pdf["onward"])}
        block, entry = 0, pdf.loc[pdf["block"] == 0, "entry"].iloc[0]
        found = []
        while entry >= 0 and (block, entry) in pointers:
            found.append((block, entry))
            block, entry = block + 1, pointers[(block, entry)]
        out = pd.DataFrame(found, columns=["block", "entry"])
        return out.assign(session_id=pdf["session_id"].iloc[0], island=pdf["island"].iloc[0])[
            ["session_id", "island", "block", "entry"]
        ]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group and time; only the last kept time is held."""
        key, last, started = None, None, False
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            columns = (pdf[c].tolist() for c in ("session_id", "island", "block", "frame_id", "t", "entry"))
            for i, (session, island, block, frame_id, t, entry) in enumerate(zip(*columns)):
                if (session, island, block) != key:
                    key, last, started = (session, island, block), None, block == 0
                started = started or entry == frame_id
                if started and (last is None or t - last >= interval):
                    keep[i], last = True, t
            yield pdf.loc[keep, ["session_id", "frame_id"]]

    key_type = frames.schema["session_id"].dataType.simpleString()
    head = f"session_id {key_type}, island double, block bigint, entry bigint"
    many = blocks.filter("many")
    pointers = many.groupBy(*group).applyInPandas(transitions, head + ", onward bigint")
    entries = pointers.groupBy("session_id", "island").applyInPandas(follow_pointers, head)
    inside = blocks.filter(F.col("own") == F.col("block"))
    short = inside.filter(~F.col("many")).withColumn("entry", F.lit(None).cast("bigint"))
    rows = inside.filter("many").join(entries, group, "left").unionByName(short)
    kept = (
        rows.select(*group, "frame_id", "t", F.coalesce("entry", F.lit(-1)).alias("entry"))
        .repartition(*group)
        .sortWithinPartitions(*group, "t", "frame_id")
        .mapInPandas(walk, f"session_id {key_type}, frame_id bigint")
    )
    firsts = placed.filter("opens").select("session_id", "frame_id")
    chosen = firsts.unionByName(kept)
    return frames.join(chosen, ["session_id", "frame_id"], "left_semi").select("session_id", "frame_id", "t", *extra)


def sessions_by_gap(frames: DataFrame, ttl: float = SESSION_TTL) -> DataFrame:
    """Add ``session_no``: a pause longer than ``ttl`` starts a new session."""
    stepped = previous(frames, ["session_id"], _order(), _day(), F.col("t"), "before")
    opens = F.when(F.col("t") - F.col("before") > ttl, 1).otherwise(0)
    return running_sum(stepped, ["session_id"], _order(), _day(), opens, "session_no").drop("before")


def sessions_by_end(events: DataFrame) -> DataFrame:
    """Add ``epoch``: how often the session was ended before this event.

    ``events`` has a boolean ``is_end``.
    """
    ended = F.col("is_end").cast("int")
    counted = running_sum(events, ["session_id"], _order(), _day(), ended, "epoch")
    return counted.withColumn("epoch", F.col("epoch") - ended)


def recent_context(
    frames: DataFrame, summary: str = "summary", size: int = CONTEXT_FRAMES, keys: tuple[str, ...] = ("session_id",)
) -> DataFrame:
    """Add ``context``: the previous summaries, oldest first, as Frame 1..n."""
    held = preceding(frames, list(keys), _order(), _day(), F.col(summary), size, "_held")
    lines = F.transform(
        "_held", lambda s, i: F.concat(F.lit("Frame "), (i + 1).cast("string"), F.lit(": "), s)
    )
    return held.withColumn("context", F.array_join(lines, "\n")).drop("_held")


# Stream ---------------------------------------------------------------------------

STATE = "last_kept double, seen bigint, last_active double, held array<string>, due bigint, waiting binary"
PIECE = "rows binary"
OUTPUT = "session_id bigint, frame_id bigint, sampled boolean, context string"
# Waiting rows of a session that lie in its own state; more of them lie in pieces beside it.
NEAR = 512


def _micros(t: float) -> int:
    return round(t * 1e6)


class FrameSessions(StatefulProcessor):
    """Sampler, context buffer and expiry of one session, in order of event time.

    Input: ``session_id, frame_id, t, summary, valid, is_end, ts``, ``t`` being
    the event time in seconds. Rows wait in the session's state until the
    watermark has passed them and are then applied by time and frame id,
    whatever order they came in; what is waiting of a session never spans more
    than the delay of the watermark. One timer a session stands at its first
    waiting row, or at the end of its lifetime. An invalid frame touches
    nothing; an end event, or a pause longer than ``ttl``, clears the session,
    so the next frame is sampled at once.

    Up to ``NEAR`` of the next rows lie in the state's one value, others in
    pieces by time, each twice as large as the one before. A piece is read when
    the watermark reaches its first row, so a row is read again only in a piece
    of half the size, however often the watermark moves.
    """

    def __init__(
        self, strategy: str = "interval", interval: float = INTERVAL_SECONDS, every: int = SAMPLE_EVERY,
        size: int = CONTEXT_FRAMES, ttl: float | None = SESSION_TTL,
    ) -> None:
        if strategy not in ("interval", "frame_count"):
            raise ValueError(f"unknown sampling strategy {strategy!r}")
        self.strategy, self.interval, self.every = strategy, interval, every
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)
        self.pieces = handle.getMapState("pieces", "piece bigint", PIECE)

    def _load(self) -> tuple:
        """Session, its timer, the rows at hand, and (first time, number) of its pieces."""
        stored = self.state.get()
        if stored is None:
            return (None, 0, None, []), None, [], []
        last_kept, seen, last_active, held, due, waiting = stored
        near, far = pickle.loads(waiting)
        return (last_kept, seen, last_active, list(held or [])), due, near, far

    def _store(self, session: tuple, due: int | None, near: list[tuple], far: list[tuple]) -> None:
        self.state.update((*session, due, pickle.dumps((near, far))))

    def _put_piece(self, far: list[tuple], rows: list[tuple]) -> None:
        number = 1 + max((n for _, n in far), default=0)
        self.pieces.updateValue((number,), (pickle.dumps(rows),))
        far.append((min(r[0] for r in rows), number))

    def _take_pieces(self, far: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple]]:
        """Rows of the pieces whose first row the watermark has passed, and the pieces left."""
        rows, left = [], []
        for first, number in far:
            if _micros(first) <= watermark * 1000:
                rows += pickle.loads(self.pieces.getValue((number,))[0])
                self.pieces.removeKey((number,))
            else:
                left.append((first, number))
        return rows, left

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, due, near, far = self._load()
        first = None
        for frames in rows:
            columns = (frames[c].to_numpy().tolist() for c in ("t", "frame_id", "summary", "is_end", "valid"))
            some = [(t, int(n), x if isinstance(x, str) else None, bool(e)) for t, n, x, e, valid in zip(*columns) if valid]
            if not some:
                continue
            first = min([t for t, *_ in some] if first is None else [first, *(t for t, *_ in some)])
            near += some
            if len(near) > NEAR:
                self._put_piece(far, near)
                near = []
        if first is not None:
            at = _micros(first) // 1000
            # A timer that stands earlier finds these rows as well.
            if due is None or due > at:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(at)
                due = at
            self._store(session, due, near, far)
        # An empty table a session would cost as much as its rows.
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Apply what the watermark has passed; drop a session that stayed idle past its lifetime."""
        watermark = timerValues.getCurrentWatermarkInMs()
        session, _, near, far = self._load()
        taken, far = self._take_pieces(far, watermark)
        ready, later = [], []
        for row in near + taken:
            (ready if _micros(row[0]) <= watermark * 1000 else later).append(row)
        session, out = self._apply(key[0], session, sorted(ready, key=lambda row: row[:2]))
        last_active = session[2]
        if len(later) > NEAR:
            later.sort(key=lambda row: row[0])
            later, rest, size = later[: NEAR // 2], later[NEAR // 2 :], NEAR
            while rest:
                self._put_piece(far, rest[:size])
                rest, size = rest[size:], 2 * size
        waits = [row[0] for row in later] + [first for first, _ in far]
        if waits:
            # A row at the watermark's own millisecond waits for its next move.
            at = max(_micros(min(waits)) // 1000, watermark + 1)
        else:
            at = None if last_active is None or self.ttl is None else _micros(last_active + self.ttl) // 1000 + 1
        idle = last_active is None or (self.ttl is not None and _micros(last_active + self.ttl) <= watermark * 1000)
        if idle and not waits:
            self.state.clear()
        else:
            if at is not None:
                self.handle.registerTimer(at)
            self._store((None, 0, None, []) if idle else session, at, later, far)
        return iter([self._rows(out)] if out else ())

    def _apply(self, session_id: int, session: list, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        last_kept, seen, last_active, held = session
        out = []
        for t, frame_id, summary, is_end in rows:
            expired = self.ttl is not None and last_active is not None and t - last_active > self.ttl
            if expired or is_end:
                last_kept, seen, last_active, held = None, 0, None, []
            if is_end:
                continue
            last_active, seen = t, seen + 1
            if self.strategy == "interval":
                sampled = last_kept is None or t - last_kept >= self.interval
            else:
                sampled = (seen - 1) % self.every == 0
            context = "\n".join(f"Frame {i}: {s}" for i, s in enumerate(held, 1)) if sampled else ""
            if sampled:
                last_kept, held = t, [*held, summary][-self.size :]
            out.append((session_id, frame_id, sampled, context))
        return (last_kept, seen, last_active, held), out

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("session_id", "frame_id", "sampled", "context"), map(list, zip(*out)))))

    def close(self) -> None:
        pass


def frame_stream(frames: DataFrame, processor: FrameSessions, delay: str = "10 minutes") -> DataFrame:
    """Stateful output per valid frame; ``frames`` has a timestamp ``ts``.

    A frame comes out once the watermark has passed it, so the result does not
    depend on the order of arrival as long as no row is more than ``delay``
    behind. Rows further behind are dropped and counted by the stream's
    progress (``streaming.sinks.run_counting_late``).
    """
    timed = frames.withWatermark("ts", delay).select("session_id", "frame_id", F.col("t").cast("double"), "summary", "valid", "is_end", "ts")
    return timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def session_stats_stream(frames: DataFrame, gap: str = "300 seconds", delay: str = "10 minutes") -> DataFrame:
    """Frames per session and outcome; activity is refreshed by valid frames only."""
    # Invalid frames move the watermark too: a filter that names its column stays above it.
    valid = F.coalesce(F.col("valid"), F.col("ts").isNull())
    return (
        frames.withWatermark("ts", delay)
        .filter(valid)
        .groupBy("session_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_frames"), F.count_if("sampled").alias("n_sampled"))
    )
