"""Sources and sinks by name and by extension, with validated options."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, SparkSession

from . import container, documents, ply


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    read: Callable[..., DataFrame] | None = None
    write: Callable[..., None] | None = None
    options: dict[str, type] = field(default_factory=dict)


class Registry:
    def __init__(self) -> None:
        self.formats: dict[str, Format] = {}

    def add(self, f: Format) -> Format:
        if f.name in self.formats:
            raise ValueError(f"format {f.name} is there already")
        self.formats[f.name] = f
        return f

    def find(self, path: str) -> Format:
        """By the longest extension that fits."""
        fit = [(len(e), f) for f in self.formats.values() for e in f.extensions if path.lower().endswith(e)]
        if not fit:
            raise LookupError(f"no format for {path}")
        return max(fit, key=lambda x: x[0])[1]

    def read(self, spark: SparkSession, path: str, name: str | None = None, **options: Any) -> DataFrame:
        f = self.formats[name] if name else self.find(path)
        if f.read is None:
            raise LookupError(f"{f.name} can't be read")
        unknown = set(options) - set(f.options)
        if unknown:
            raise ValueError(f"options {sorted(unknown)}")
        return f.read(spark, path, **{k: coerced(v, f.options[k]) for k, v in options.items()})

    def write(self, splats: DataFrame, path: str, name: str | None = None, **options: Any) -> None:
        f = self.formats[name] if name else self.find(path)
        if f.write is None:
            raise LookupError(f"{f.name} can't be written")
        f.write(splats, path, **{k: coerced(v, f.options[k]) for k, v in options.items()})


def coerced(value: Any, kind: Any) -> Any:
    """A value as the declared type: text to paths, numbers and lists, one member of a union; raises where it doesn't fit."""
    choices = get_args(kind)
    if get_origin(kind) in (list, tuple):
        return get_origin(kind)(coerced(v, choices[0]) for v in (value.split(",") if isinstance(value, str) else value))
    if choices:
        for k in choices:
            if k is type(None):
                if value is None:
                    return None
                continue
            try:
                return coerced(value, k)
            except (TypeError, ValueError):
                pass
        raise ValueError(f"{value!r} is none of {kind}")
    if kind is bool:
        if str(value).lower() in ("true", "false", "1", "0"):
            return str(value).lower() in ("true", "1")
        raise ValueError(f"{value!r} is no bool")
    if kind is int and (isinstance(value, bool) or isinstance(value, float) and value != int(value)):
        raise ValueError(f"{value!r} is no int")
    return kind(value) if kind in (int, float, str, Path) else value


def configured(cls: type, options: dict[str, Any]) -> Any:
    """A dataclass from a flat dict; unknown names raise."""
    hints = get_type_hints(cls)
    unknown = set(options) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"options {sorted(unknown)}")
    return cls(**{k: coerced(v, hints[k]) for k, v in options.items()})


def retry_delay(attempt: int, base: float = 0.5, most: float = 30.0, jitter: float = 0.25, rng: random.Random | None = None) -> float:
    """Seconds before the next try: doubled each time up to a bound, with jitter on both sides."""
    return min(base * 2**attempt, most) * (1 + (rng or random).uniform(-jitter, jitter))


REGISTRY = Registry()
REGISTRY.add(Format("ply", (".ply",), ply.read, ply.write, {"pattern": str, "name": str}))
REGISTRY.add(Format("container", (".gsav",), container.read))
REGISTRY.add(Format("chunk_metadata", (".json",), documents.read_chunk_metadata))
