"""Streams: the playback clock, latest frame, histories, the circuit breaker and matcher state over event streams.

State is bounded per key; windows have watermarks. The window operators extend the data model to event time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matching import own_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Groups of pictures in event time: counts and means of tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, every: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", every, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Lifetimes: runs of a key's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each key; ids only grow, so a late one doesn't win."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


def distinct_frames(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Repeats of an event within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


@dataclass(frozen=True)
class Breaker:
    """Opens after so many failures in a row, tries again after ``reset`` seconds, closes after so many successes."""

    failures: int = 3
    successes: int = 2
    reset: float = 60.0

    def step(self, state: tuple[str, int, int, float], failed: bool, t: float) -> tuple[tuple[str, int, int, float], str]:
        """The state after an event, and the state that the event met. state: name, failures, successes, time of the last failure."""
        name, bad, good, last = state
        if name == "open" and t - last >= self.reset:
            name, good = "half_open", 0
        met = name
        if failed:
            last = t
            if name == "half_open":
                name = "open"
            elif name == "closed":
                bad += 1
                name = "open" if bad >= self.failures else name
        elif name == "half_open":
            good += 1
            if good >= self.successes:
                name, bad = "closed", 0
        elif name == "closed":
            bad = 0
        return (name, bad, good, last), met


START = ("closed", 0, 0, 0.0)
BREAKER = "user_id bigint, event_id bigint, met string, state string"


def _fold(breaker: Breaker, state: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    out = []
    for r in pdf.sort_values(["ts", "event_id"]).itertuples():
        state, met = breaker.step(state, r.event_type == "error", r.ts.timestamp())
        out.append((r.user_id, r.event_id, met, state[0]))
    return state, pd.DataFrame(out, columns=["user_id", "event_id", "met", "state"])


def breaker_batch(events: DataFrame, breaker: Breaker = Breaker()) -> DataFrame:
    """The breaker of each key over a whole table: keys are folded in the order of time."""
    return events.groupBy("user_id").applyInPandas(lambda pdf: _fold(breaker, START, pdf)[1], BREAKER)


def breaker_stream(events: DataFrame, breaker: Breaker = Breaker()) -> DataFrame:
    """The same as a stream: four values of state a key. Events of a key must come in order of time between batches."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        now, out = _fold(breaker, tuple(now), pd.concat(list(parts)))
        state.update(now)
        yield out

    return events.groupBy("user_id").applyInPandasWithState(run, BREAKER, "name string, failures long, successes long, last double", "append", GroupStateTimeout.NoTimeout)


def nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of b nearest to each row of a, of several the first, and the squared distance. Rows are looked up outwards along the first axis, until that axis alone is farther than the best."""
    order = np.argsort(b[:, 0], kind="stable")
    along, m = b[order, 0], len(b)
    right = np.searchsorted(along, a[:, 0])
    left = right - 1
    best, who, left_over = np.full(len(a), np.inf), np.full(len(a), m), np.arange(len(a))
    while len(left_over):
        going = np.zeros(len(left_over), bool)
        for side in (left, right):
            i = side[left_over]
            gap = along[np.clip(i, 0, m - 1)] - a[left_over, 0]
            near = (i >= 0) & (i < m) & (gap * gap <= best[left_over])
            rows, found = left_over[near], order[i[near]]
            d2 = ((a[rows] - b[found]) ** 2).sum(axis=1)
            better = (d2 < best[rows]) | (d2 == best[rows]) & (found < who[rows])
            best[rows[better]], who[rows[better]] = d2[better], found[better]
            going |= near
        left[left_over] -= 1
        right[left_over] += 1
        left_over = left_over[going]
    return who, best


def claimed(current: np.ndarray, slots: np.ndarray, passes: int = 10) -> np.ndarray:
    """Slot of each row, or -1: in each pass rows without a slot claim the nearest free one, of which the nearest claim wins, then the first."""
    out = np.full(len(current), -1)
    free = np.arange(len(slots))
    for _ in range(passes):
        left = np.flatnonzero(out < 0)
        if not len(left) or not len(free):
            break
        who, d2 = nearest(current[left], slots[free])
        order = np.lexsort((left, d2, who))
        won = order[np.unique(who[order], return_index=True)[1]]
        out[left[won]] = free[who[won]]
        free = np.delete(free, who[won])
    return out


def conformed(current: np.ndarray, slots: np.ndarray, active: np.ndarray, passes: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each row of a frame, and slots and active marks after it. Rows match active slots first, then vacant ones, then take what is free in order;
    rows beyond that get new slots. Slots that no row has keep their place and become inactive."""
    chosen = np.full(len(current), -1)
    for part in (np.flatnonzero(active), np.flatnonzero(~active)):
        left = np.flatnonzero(chosen < 0)
        got = claimed(current[left], slots[part], passes)
        chosen[left[got >= 0]] = part[got[got >= 0]]
    left = np.flatnonzero(chosen < 0)
    free = np.setdiff1d(np.arange(len(slots)), chosen)
    more = max(0, len(left) - len(free))
    chosen[left] = np.concatenate((free, np.arange(len(slots), len(slots) + more)))[: len(left)]
    slots = np.concatenate((slots, np.zeros((more, 3))))
    active = np.zeros(len(slots), bool)
    slots[chosen], active[chosen] = current, True
    return chosen, slots, active


def matcher_stream(frames: DataFrame) -> DataFrame:
    """(scene, frame, gid, slot): splats of a frame take the slots of the frame before by nearness in space; a new chunk starts anew.

    ``frames`` is a stream of (scene, frame, chunk_id, gid, x, y, z), whose frames come whole and in order. The state of a scene is its slots, bounded by the splats of a chunk.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, flat, marks = state.get if state.exists else (-1, [], [])
        slots, active = np.array(flat, float).reshape(-1, 3), np.array(marks, bool)
        out = []
        for (frame, c), pdf in pd.concat(list(parts)).sort_values(["frame", "gid"]).groupby(["frame", "chunk_id"]):
            if c != chunk:
                chunk, slots, active = int(c), np.zeros((0, 3)), np.zeros(0, bool)
            chosen, slots, active = conformed(pdf[["x", "y", "z"]].to_numpy(float), slots, active)
            out.append(pd.DataFrame({"scene": key[0], "frame": np.int32(frame), "gid": pdf["gid"].to_numpy(), "slot": chosen}))
        state.update((chunk, slots.ravel().tolist(), active.tolist()))
        yield pd.concat(out)

    return frames.groupBy("scene").applyInPandasWithState(run, "scene bigint, frame int, gid bigint, slot bigint", "chunk long, slots array<double>, active array<boolean>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All rows of a bounded stream, run to its end. Batches are written as Parquet in the shared folder: of ``complete`` mode
    the last one counts, of ``append`` mode all."""
    spark = stream.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or own_folder(spark)
    path = f"{shared}/stream-{uuid.uuid4().hex}"
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        seen.append(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    used = seen[-1:] if mode == "complete" else sorted(set(seen))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/out/batch={n}" for n in used])
