"""Byte payloads of frames and chunks, and randomised orders: work on a whole frame, in Arrow.

A frame's rows meet in one task; their number is bounded by the format (5 million splats a frame).
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

LEVEL = 13


def _zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def low_payloads(rows: DataFrame) -> DataFrame:
    """(frame, n, layout, payload) from (frame, rank, lx, ly, lz) bytes: packed by base where three digits fit a byte, else by columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        low = pdf[["lx", "ly", "lz"]].to_numpy(np.uint8)
        values = np.unique(low)
        if len(values) ** 3 <= 256:
            digits = np.searchsorted(values, low).astype(np.int64)
            packed = (digits[:, 0] * len(values) + digits[:, 1]) * len(values) + digits[:, 2]
            layout, raw = "base", bytes([len(values)]) + values.tobytes() + packed.astype(np.uint8).tobytes()
        else:
            layout, raw = "columns", low.T.tobytes()
        return pd.DataFrame({"frame": [int(pdf.frame.iloc[0])], "n": [len(pdf)], "layout": [layout], "payload": [_zstd(raw)]})

    return rows.groupBy("frame").applyInPandas(run, "frame int, n bigint, layout string, payload binary")


def low_bytes(payloads: DataFrame) -> DataFrame:
    """Undoes low_payloads()."""

    def run(parts):
        for pdf in parts:
            for frame, n, layout, payload in pdf.itertuples(index=False):
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
                if layout == "base":
                    base, values, packed = int(raw[0]), raw[1 : 1 + int(raw[0])], raw[1 + int(raw[0]) :].astype(np.int64)
                    low = values[np.stack([packed // base**2, packed // base % base, packed % base], axis=1)]
                else:
                    low = raw.reshape(3, n).T
                yield pd.DataFrame({"frame": np.int32(frame), "rank": np.arange(n), "lx": low[:, 0].astype(np.int32), "ly": low[:, 1].astype(np.int32), "lz": low[:, 2].astype(np.int32)})

    return payloads.select("frame", "n", "layout", "payload").mapInPandas(run, "frame int, rank bigint, lx int, ly int, lz int")


def label_payloads(rows: DataFrame) -> DataFrame:
    """(chunk_id, frame, payload) from (chunk_id, frame, rank, label): the first frame of a chunk plain, the others as XOR with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, first = [], None
        for frame, part in pdf.sort_values(["frame", "rank"]).groupby("frame"):
            labels = part["label"].to_numpy(np.uint16)
            out.append((int(pdf.chunk_id.iloc[0]), int(frame), _zstd((labels if first is None else labels ^ first).tobytes())))
            first = labels if first is None else first
        return pd.DataFrame(out, columns=["chunk_id", "frame", "payload"])

    return rows.groupBy("chunk_id").applyInPandas(run, "chunk_id int, frame int, payload binary")


def labels(payload_rows: DataFrame) -> DataFrame:
    """Undoes label_payloads(): (chunk_id, frame, rank, label)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, first = [], None
        for r in pdf.sort_values("frame").itertuples():
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.payload), np.uint16)
            first, got = (got, got) if first is None else (first, got ^ first)
            out.append(pd.DataFrame({"chunk_id": np.int32(r.chunk_id), "frame": np.int32(r.frame), "rank": np.arange(len(got)), "label": got.astype(np.int32)}))
        return pd.concat(out)

    return payload_rows.groupBy("chunk_id").applyInPandas(run, "chunk_id int, frame int, rank bigint, label int")


def compressed_sizes(rows: DataFrame, column: str) -> DataFrame:
    """Bytes of a frame's column of bytes under several coders: plain, delta, and split into bit planes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("rank")[column].to_numpy(np.uint8)
        delta = np.diff(v, prepend=v[:1] * 0).astype(np.uint8)
        planes = np.packbits(np.unpackbits(v[:, None], axis=1).T, axis=1)
        rows_ = [(int(pdf.frame.iloc[0]), n, c, len(f(x.tobytes()))) for n, x in (("plain", v), ("delta", delta), ("planes", planes)) for c, f in (("zstd", _zstd), ("deflate", lambda b: zlib.compress(b, 9)))]
        return pd.DataFrame(rows_, columns=["frame", "strategy", "coder", "bytes"])

    return rows.groupBy("frame").applyInPandas(run, "frame int, strategy string, coder string, bytes bigint")


#: All orders of four cells.
_FOURS = np.array(list(itertools.permutations(range(4))))


def _blurred(x: np.ndarray, radius: int) -> np.ndarray:
    """Means over squares of side 2 * radius + 1, edges repeated."""
    for axis in (0, 1):
        pad = [(radius + 1, radius) if a == axis else (0, 0) for a in range(3)]
        total = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        x = (np.take(total, np.arange(2 * radius + 1, 2 * radius + 1 + n), axis) - np.take(total, np.arange(n), axis)) / (2 * radius + 1)
    return x


def _grid_cost(x: np.ndarray) -> float:
    return float(((x[1:] - x[:-1]) ** 2).sum() + ((x[:, 1:] - x[:, :-1]) ** 2).sum())


def grid_sorted(rows: DataFrame, rounds: int = 4, seed: int = 0) -> DataFrame:
    """(frame, gid, cell, before, after): a perfect square of each frame's splats on a grid where neighbours are alike, and the squared differences of neighbours before and after.

    The grid is blurred with a radius that halves from a quarter of its side; each time cells, at random in fours, take the order of their four splats that is nearest to the
    blurred grid. The best grid is kept. Rows beyond the largest square keep their place behind it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid").reset_index(drop=True)
        side = int(np.sqrt(len(pdf)))
        rng = np.random.default_rng(seed)
        x = pdf[["x", "y", "z"]].to_numpy(float)[: side * side]
        span = np.ptp(x, axis=0) if len(x) else np.ones(3)
        x = (x - x.min(axis=0)) / np.where(span > 0, span, 1.0) if len(x) else x
        grid = lambda o: x[o].reshape(side, side, 3)
        start = np.arange(side * side)
        before = best = _grid_cost(grid(start)) if side > 1 else 0.0
        strips = np.lexsort((x[:, 1], np.argsort(np.argsort(x[:, 0], kind="stable")) // max(side, 1)))
        now = strips if side > 1 and _grid_cost(grid(strips)) < best else start
        kept, best = now, min(best, _grid_cost(grid(now))) if side > 1 else 0.0
        radius = side // 4
        while radius >= 1 and side > 1:
            for _ in range(rounds):
                goal = _blurred(grid(now), radius).reshape(-1, 3)
                fours = rng.permutation(side * side)[: side * side // 4 * 4].reshape(-1, 4)
                # Distances of each four's splats to each of its cells' goals.
                d = ((x[now[fours]][:, :, None, :] - goal[fours][:, None, :, :]) ** 2).sum(axis=3)
                total = sum(d[:, _FOURS[:, cell], cell] for cell in range(4))
                pick = _FOURS[total.argmin(axis=1)]
                now = now.copy()
                now[fours] = np.take_along_axis(now[fours], pick, axis=1)
                cost = _grid_cost(grid(now))
                if cost < best:
                    kept, best = now, cost
            radius //= 2
        cells = np.empty(len(pdf), np.int64)
        cells[kept] = np.arange(side * side)
        cells[side * side :] = np.arange(side * side, len(pdf))
        return pd.DataFrame({"frame": pdf.frame.astype(np.int32), "gid": pdf.gid, "cell": cells, "before": before, "after": best})

    return rows.groupBy("frame").applyInPandas(run, "frame int, gid bigint, cell bigint, before double, after double")


def swapped(rows: DataFrame, passes: int = 20, seed: int = 0) -> DataFrame:
    """(chunk_id, gid, rank, before, after): an order of a chunk's splats refined by random local swaps that lower the sum of differences of neighbours' values.

    ``rows`` has chunk_id, gid, rank and value.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        v = pdf["value"].to_numpy(float).copy()
        order, rng = np.arange(len(v)), np.random.default_rng(seed)
        total = lambda: float(np.abs(np.diff(v)).sum())
        before = total()
        for _ in range(passes):
            for i in range(int(rng.integers(1, 3)), len(v) - 2, 3):
                a, b, c, d = v[i - 1], v[i], v[i + 1], v[i + 2]
                if abs(a - c) + abs(b - d) < abs(a - b) + abs(c - d):
                    v[i], v[i + 1] = c, b
                    order[i], order[i + 1] = order[i + 1], order[i]
        rank = np.empty(len(v), np.int64)
        rank[order] = np.arange(len(v))
        return pd.DataFrame({"chunk_id": pdf.chunk_id.astype(np.int32), "gid": pdf.gid, "rank": rank, "before": before, "after": total()})

    return rows.groupBy("chunk_id").applyInPandas(run, "chunk_id int, gid bigint, rank bigint, before double, after double")
