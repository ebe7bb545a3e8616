"""Sources in time, orders by name, discovery of plugins, and checks that a source keeps its word."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from pathlib import Path
from time import perf_counter
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spaces as v
from ..operators import sequences, timeline
from .registry import Registry

GROUP = "splatspark.plugins"


@runtime_checkable
class DiscreteSource(Protocol):
    """Numbered frames."""

    @property
    def domain(self) -> timeline.TimeDomain: ...

    def frame(self, number: int) -> DataFrame: ...


@runtime_checkable
class InterpolatableSource(Protocol):
    """Key frames at times of their own; ``method`` is "nearest" or "linear"."""

    @property
    def method(self) -> str: ...

    def key_times(self) -> DataFrame: ...

    def key_frame(self, number: int) -> DataFrame: ...


@runtime_checkable
class ContinuousSource(Protocol):
    """Splats at any time. A batch of times, a table (t), is one plan whose rows carry t."""

    def evaluate(self, t: float) -> DataFrame: ...

    def evaluate_batch(self, times: DataFrame) -> DataFrame: ...


@dataclass
class TableSource:
    """Splats with a frame column as all three kinds of source: frames are key frames at their numbers. Splats have to be in both key frames."""

    splats: DataFrame
    frames: int
    method: str = "linear"

    @property
    def domain(self) -> timeline.TimeDomain:
        return timeline.TimeDomain(0.0, self.frames - 1.0)

    def frame(self, number: int) -> DataFrame:
        low, _ = timeline.clamped_range(number, number, self.frames)
        return self.splats.where(F.col("frame") == low)

    key_frame = frame

    def key_times(self) -> DataFrame:
        return self.splats.sparkSession.range(self.frames).select(F.col("id").alias("key"), F.col("id").cast("double").alias("kt"))

    def evaluate(self, t: float) -> DataFrame:
        t = self.domain.clamp(t)
        before = min(int(t), self.frames - 1)
        return timeline.interpolated(self.splats, before, min(before + 1, self.frames - 1), t - before, method=self.method)

    def evaluate_batch(self, times: DataFrame) -> DataFrame:
        """Positions and colours at many times: (t, gid, x y z, c0 c1 c2). Times are joined to the two key frames that they need by frame number, so each
        frame is read once."""
        spots = timeline.integer_keyframes(times.select(F.greatest(F.least(F.col("t"), F.lit(self.domain.high)), F.lit(0.0)).alias("t"), F.col("t").alias("_asked")))
        needed = spots.select("_asked", "share", F.explode(F.array(F.struct(F.col("frame_before").alias("frame"), F.lit(0).alias("side")), F.struct(F.col("frame_after").alias("frame"), F.lit(1).alias("side")))).alias("k")).select("_asked", "share", "k.frame", "k.side")
        columns = ("x", "y", "z", "c0", "c1", "c2")
        both = self.splats.select("frame", "gid", *columns).join(needed, "frame")
        at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
        share = F.when(F.first("share") < 0.5, 0.0).otherwise(1.0) if self.method == "nearest" else F.first("share")
        return both.groupBy(F.col("_asked").alias("t"), "gid").agg(*[v.lerp(at(0, c), at(1, c), share).alias(c) for c in columns])


# Orders of a frame's splats, by name: functions from rows with frame, gid, x y z to rows with rank.

Order = Callable[[DataFrame], DataFrame]
ORDERS: dict[str, Order] = {}


def order(name: str) -> Callable[[Order], Order]:
    def add(f: Order) -> Order:
        if name in ORDERS:
            raise ValueError(f"order {name} is there already")
        ORDERS[name] = f
        return f

    return add


@order("none")
def _by_id(rows: DataFrame) -> DataFrame:
    return sequences.ranked(rows, ["frame"], ["gid"])


@order("morton")
def _by_code(rows: DataFrame) -> DataFrame:
    return sequences.ranked(sequences.morton_codes(rows), ["frame"], ["code", "gid"]).drop("code")


@order("hash")
def _by_hash(rows: DataFrame) -> DataFrame:
    """No order in space: a baseline for measuring the others."""
    return sequences.ranked(rows.withColumn("_h", F.xxhash64("gid")), ["frame"], ["_h", "gid"]).drop("_h")


def ordered(rows: DataFrame, name: str) -> DataFrame:
    if name not in ORDERS:
        raise LookupError(f"no order {name}; there are {sorted(ORDERS)}")
    return ORDERS[name](rows)


# Discovery: a plugin is a function register(registry).


def discover(registry: Registry, folder: str | None = None, group: str = GROUP) -> dict[str, str]:
    """Lets installed plugins and the modules of a folder register; what each added, or "error: ..." for one that failed, as one bad plugin mustn't take the others along."""
    found: dict[str, str] = {}
    for e in entry_points(group=group):
        found[e.name] = _registered(lambda e=e: e.load(), registry)
    for path in sorted(Path(folder).glob("*.py")) if folder else []:
        if not path.name.startswith("_"):
            found[path.stem] = _registered(lambda path=path: _loaded(path), registry)
    return found


def _loaded(path: Path) -> Callable[[Registry], None]:
    spec = importlib.util.spec_from_file_location(f"splatspark_plugin_{path.stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.register


def _registered(load: Callable, registry: Registry) -> str:
    before = set(registry.formats)
    try:
        load()(registry)
    except Exception as e:  # a plugin may fail in any way
        return f"error: {type(e).__name__}: {e}"
    return ",".join(sorted(set(registry.formats) - before))


# Conformance


def conformance(source: object) -> dict[str, str]:
    """Checks of a source by the protocols that it claims: "pass", or what is wrong. Runs small queries."""
    out: dict[str, str] = {}

    def check(name: str, test: Callable[[], bool]) -> None:
        try:
            out[name] = "pass" if test() else "fail"
        except Exception as e:  # the harness reports, whatever a source raises
            out[name] = f"{type(e).__name__}: {e}"

    kinds = [k for k in (DiscreteSource, InterpolatableSource, ContinuousSource) if isinstance(source, k)]
    out["protocol"] = "pass" if kinds else "no protocol is kept"
    if DiscreteSource in kinds:
        last = source.domain.frames - 1
        check("domain", lambda: source.domain.low <= source.domain.high and last >= 0)
        check("columns", lambda: {"gid", "x", "y", "z"} <= set(source.frame(0).columns))
        check("frames", lambda: not source.frame(0).isEmpty() and not source.frame(last).isEmpty())
        check("distinct ids", lambda: source.frame(0).groupBy("gid").count().where("count > 1").isEmpty())
        check("schema stays", lambda: source.frame(0).schema == source.frame(last).schema)
    if InterpolatableSource in kinds:
        check("method", lambda: source.method in ("nearest", "linear"))
        check("key times ascend", lambda: source.key_times().groupBy("kt").count().where("count > 1").isEmpty())
    if ContinuousSource in kinds:
        check("evaluate", lambda: {"gid", "x", "y", "z"} <= set(source.evaluate(0.0).columns))
        check("evaluate again", lambda: source.evaluate(0.0).select("gid", "x").exceptAll(source.evaluate(0.0).select("gid", "x")).isEmpty())
    return out


@dataclass
class Timings:
    """Milliseconds of named stages, summed over repeats, and of all since the start. Spark's actions count, plans that are only made don't."""

    stages: dict[str, float] = field(default_factory=dict)
    began: float = field(default_factory=perf_counter)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        start = perf_counter()
        try:
            yield
        finally:
            self.record(name, (perf_counter() - start) * 1000)

    def record(self, name: str, ms: float) -> None:
        self.stages[name] = self.stages.get(name, 0.0) + ms

    def stop(self) -> tuple[dict[str, float], float]:
        return dict(self.stages), (perf_counter() - self.began) * 1000
