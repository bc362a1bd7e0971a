"""What changed between full snapshots of a table.

Method: every key has an ordinal within its chunk (keys are spread over chunks by hash) that it keeps for good: known keys
keep theirs, new ones go behind them. A snapshot is one compressed bitmap a chunk (:class:`Bitmap`: containers of 65,536
ordinals as sorted positions, runs or bits, whichever is smallest) and one vector of value digests along the ordinals. Snapshots
are taken one after the other: a chunk's state (its keys in order, its bitmap, its vector) meets the rows of the next snapshot;
additions are ``now AND NOT before``, removals ``before AND NOT now``, changes the positions of ``now AND before`` whose digests
differ; then the chunk's state is the one after that snapshot. So each snapshot is read once, a task never holds more of a chunk
than its keys and two snapshots, and a state can be kept and advanced by a snapshot that comes later (:func:`advance`).

Defined results: repeated rows of a key count once; where one snapshot gives a key several values the largest holds;
null keys are dropped; a snapshot number with no rows at all is an empty snapshot between its neighbours. Values are compared
by 64-bit digests.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut

#: Keys a chunk should hold.
CHUNK_KEYS = 16_384
#: Ordinals of a container.
SPAN = 1 << 16

STATE = "entity string, chunk int, names binary, bits binary, digests binary"
_OUT = f"{STATE}, snap int, item_key string, change_kind string"


def chunks_for(rows: int, chunk_keys: int = CHUNK_KEYS) -> int:
    return max(1, math.ceil(rows / chunk_keys))


class Bitmap:
    """A set of ordinals as compressed containers: 0 sorted positions, 1 runs (first, last), 2 bits."""

    __slots__ = ("containers",)

    def __init__(self, containers: dict[int, tuple[int, np.ndarray]] | None = None) -> None:
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """``ordinals``: different ones in any order."""
        ordinals = np.sort(np.asarray(ordinals, dtype=np.int64))
        high = ordinals // SPAN
        return cls({int(h): cls._packed(ordinals[np.searchsorted(high, h) : np.searchsorted(high, h, "right")] % SPAN) for h in np.unique(high)})

    @staticmethod
    def _packed(low: np.ndarray) -> tuple[int, np.ndarray]:
        """The smallest container of sorted positions."""
        ends = np.flatnonzero(np.diff(low) != 1)
        runs = len(ends) + 1
        if 4 * runs <= min(2 * len(low), SPAN // 8):
            return 1, np.stack([low[np.append(0, ends + 1)], low[np.append(ends, len(low) - 1)]], axis=1).astype(np.uint16).ravel()
        if 2 * len(low) <= SPAN // 8:
            return 0, low.astype(np.uint16)
        bits = np.zeros(SPAN, dtype=bool)
        bits[low] = True
        return 2, np.packbits(bits)

    @staticmethod
    def _low(container: tuple[int, np.ndarray]) -> np.ndarray:
        kind, data = container
        if kind == 0:
            return data.astype(np.int64)
        if kind == 2:
            return np.flatnonzero(np.unpackbits(data))
        first, last = data[0::2].astype(np.int64), data[1::2].astype(np.int64)
        n = last - first + 1
        return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def _with(self, other: Bitmap, both: bool) -> Bitmap:
        out = {}
        for h, c in self.containers.items():
            d = other.containers.get(h)
            if d is None:
                if not both:
                    out[h] = c
                continue
            if c[0] == 2 and d[0] == 2:  # bits meet bits
                low = np.flatnonzero(np.unpackbits(c[1] & (d[1] if both else ~d[1])))
            elif c[0] == d[0] and np.array_equal(c[1], d[1]):  # containers that are the same
                low = self._low(c) if both else np.zeros(0, dtype=np.int64)
            else:
                a, b = self._low(c), self._low(d)
                low = a[np.isin(a, b, assume_unique=True, invert=not both)]
            if len(low):
                out[h] = self._packed(low)
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._with(other, False)

    def intersect(self, other: Bitmap) -> Bitmap:
        return self._with(other, True)

    def ordinals(self) -> np.ndarray:
        return np.concatenate([h * SPAN + self._low(c) for h, c in sorted(self.containers.items())] or [np.zeros(0, dtype=np.int64)])

    def to_bytes(self) -> bytes:
        """Each container as its number, kind and length, then its data."""
        return b"".join(np.array([h, k, d.nbytes], dtype="<u4").tobytes() + d.tobytes() for h, (k, d) in sorted(self.containers.items()))

    @classmethod
    def from_bytes(cls, data: bytes) -> Bitmap:
        out, at = {}, 0
        while at < len(data):
            h, kind, size = (int(x) for x in np.frombuffer(data, "<u4", 3, at))
            out[h] = (kind, np.frombuffer(data, np.uint8 if kind == 2 else np.uint16, size if kind == 2 else size // 2, at + 12))
            at += 12 + size
        return cls(out)


class Chunk:
    """Keys of a chunk by ordinal, and its last snapshot."""

    def __init__(self, names: bytes | None = None, bits: bytes = b"", digests: bytes = b"") -> None:
        self.names: list[str] = json.loads(zlib.decompress(names)) if names else []
        self.bits = Bitmap.from_bytes(bits)
        self.digests = np.zeros(len(self.names), dtype=np.int64)
        self.digests[self.bits.ordinals()] = np.frombuffer(digests, "<i8")

    def ordinals(self, keys: list[str]) -> np.ndarray:
        """Ordinals of ``keys``; new ones are given in key order."""
        known = {k: n for n, k in enumerate(self.names)}
        new = sorted(k for k in keys if k not in known)
        known.update((k, len(self.names) + n) for n, k in enumerate(new))
        self.names += new
        self.digests = np.append(self.digests, np.zeros(len(new), dtype=np.int64))
        return np.array([known[k] for k in keys], dtype=np.int64)

    def advance(self, keys: list[str], digests: np.ndarray) -> list[tuple[str, np.ndarray]]:
        """Takes a snapshot: (change, ordinals) against the last one."""
        at = self.ordinals(keys)
        now, before = Bitmap.of(at), self.bits
        values = np.zeros(len(self.names), dtype=np.int64)
        values[at] = digests
        both = now.intersect(before).ordinals()
        out = [("added", now.and_not(before).ordinals()), ("removed", before.and_not(now).ordinals()), ("changed", both[values[both] != self.digests[both]])]
        self.bits, self.digests = now, values
        return out

    def state(self) -> tuple[bytes, bytes, bytes]:
        return zlib.compress(json.dumps(self.names).encode(), 1), self.bits.to_bytes(), self.digests[self.bits.ordinals()].astype("<i8").tobytes()


def advance(state: DataFrame | None, snapshot: DataFrame, chunks: int, snap: int, report: bool = True) -> DataFrame:
    """One step: rows of STATE are the state after ``snapshot`` (entity, item_key, value), rows with a change_kind what it changed.

    Repeats of a key are combined on the mappers, so a key that holds a third of all rows costs a row a mapper."""
    one = snapshot.dropna(subset=["entity", "item_key"]).groupBy("entity", "item_key").agg(F.max("value").alias("value"))
    one = one.select("entity", F.pmod(F.xxhash64("item_key"), F.lit(chunks)).cast("int").alias("chunk"), "item_key", F.xxhash64("value").alias("digest"))
    if state is None:
        state = one.sparkSession.createDataFrame([], STATE)

    def step(rows: pd.DataFrame, saved: pd.DataFrame) -> pd.DataFrame:
        first = (saved if len(saved) else rows).iloc[0]
        entity, number = first["entity"], int(first["chunk"])
        chunk = Chunk(*saved.iloc[0][["names", "bits", "digests"]]) if len(saved) else Chunk()
        found = chunk.advance(rows["item_key"].tolist(), rows["digest"].to_numpy(dtype=np.int64)) if report or len(rows) else []
        out = [pd.DataFrame({"snap": np.int32(snap), "item_key": [chunk.names[k] for k in at], "change_kind": kind}) for kind, at in found if report and len(at)]
        names, bits, digests = chunk.state()
        out.append(pd.DataFrame({"names": [names], "bits": [bits], "digests": [digests]}))
        return pd.concat(out, ignore_index=True).reindex(columns=[c.split()[0] for c in _OUT.split(", ")]).assign(entity=entity, chunk=np.int32(number)).astype({"snap": "Int32"}).astype(object).where(lambda d: d.notna(), None)

    return one.groupBy("entity", "chunk").cogroup(state.groupBy("entity", "chunk")).applyInPandas(step, _OUT)


def changes(items: DataFrame, snaps: list[int], chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """``items``: snap int, entity, item_key, value. Out: snap, entity, item_key, change_kind for each of ``snaps`` but the first."""
    chunks = chunks_for(items.count() // max(1, len(snaps)), chunk_keys)
    state, out = None, []
    for n, s in enumerate(snaps):
        done = cut(advance(state, items.filter(F.col("snap") == s), chunks, s, n > 0))
        state = done.filter("change_kind is null").select("entity", "chunk", "names", "bits", "digests")
        if n:
            out.append(done.filter("change_kind is not null").select("snap", "entity", "item_key", "change_kind"))
    found = out[0] if out else items.limit(0).select("snap", "entity", "item_key", F.lit("").alias("change_kind"))
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def graph_items(node_snapshots: DataFrame, edge_snapshots: DataFrame) -> DataFrame:
    """Symbols by qualified name with their signature without white space; links by source, target and kind, without value."""
    n = node_snapshots.select(
        "snap", F.lit("node").alias("entity"), F.col("qualified_name").alias("item_key"), F.regexp_replace(F.coalesce("signature", F.lit("")), r"(?U)\s+", "").alias("value")
    )
    key = F.concat(F.col("source_name"), F.lit(">"), F.col("target_name"), F.lit(">"), F.lower(F.btrim("kind")))
    e = edge_snapshots.select("snap", F.lit("edge").alias("entity"), key.alias("item_key"), F.lit("").alias("value"))
    return n.unionByName(e)


def snap_numbers(*tables: DataFrame) -> list[int]:
    """All snapshot numbers from the first to the last; one row a table comes to the driver."""
    ends = [t.agg(F.min("snap"), F.max("snap")).first() for t in tables]
    low, high = [e[0] for e in ends if e[0] is not None], [e[1] for e in ends if e[1] is not None]
    return list(range(min(low), max(high) + 1)) if low else []
