"""Similar code: MinHash signatures, banding, and an exact set-similarity join.

The exact join is a prefix-filtered one: items are numbered by rarity, two sets of similarity t can only match if they share one of
the rarest ``n - ceil(t n) + 1`` items of the larger and one of the rarest ``n - ceil(2t / (1 + t) n) + 1`` of the smaller, and only if
their sizes are within t of each other. Sets that share such an item meet in one task, as packed item numbers; there pairs are
compared by 64-bit parity sketches (of the items that only one of two sets has, each flips one bit, so that more odd bits than a
match may differ in exclude it) and what is left by exact counts, in the group of the rarest item they share, so once. No candidate leaves its task; for
classes and numbers of links no pair does either, only sums and spanning forests. Groups of equal sets are one representative."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.cluster import cut, freeing, small
from graphloom.functions import code

# Fixed values of the signatures: permutations, seed, and the Mersenne prime they work under.
PERMUTATIONS, SEED, PRIME = 128, 42, (1 << 61) - 1
BANDS, ROWS = 16, 8
#: Words of a shingle and least similarity of a match.
SHINGLE, THRESHOLD = 5, 0.8
#: Sets that share an item and meet in one task (more are split, each part against all), links one task may merge, pairs compared or kept at once.
GROUP_ROWS, TASK_LINKS, PAIRS = 50_000, 4_000_000, 500_000


def _coefficients() -> list[tuple[int, int]]:
    def draw(what: str) -> int:
        return int.from_bytes(hashlib.sha256(what.encode()).digest()[:8], "big") % PRIME

    return [(draw(f"{SEED}:{i}:a") or 1, draw(f"{SEED}:{i}:b")) for i in range(PERMUTATIONS)]


def signature(items: set[str]) -> list[int]:
    """Least value of each permutation over the items; of no items PRIME throughout."""
    hashes = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in items]
    return [min((a * h + b) % PRIME for h in hashes) if hashes else PRIME for a, b in _coefficients()]


def signatures(sets: DataFrame) -> DataFrame:
    """id, sig from id, items (array of strings). Products exceed 64 bits, so they are taken in Python, each distinct item once a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coefficients = _coefficients()
        kept: dict[str, np.ndarray] = {}
        for f in frames:
            out = []
            for items in f["items"]:
                cols = []
                for x in set(items) if items is not None else ():
                    v = kept.get(x)
                    if v is None:
                        if len(kept) > 50_000:
                            kept.clear()
                        h = int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big")
                        v = kept[x] = np.array([(a * h + b) % PRIME for a, b in coefficients], dtype=np.int64)
                    cols.append(v)
                out.append(np.min(cols, axis=0) if cols else np.full(PERMUTATIONS, PRIME, dtype=np.int64))
            yield pd.DataFrame({"id": f["id"], "sig": out})

    return sets.select("id", "items").mapInPandas(run, "id string, sig array<long>")


def bands(sigs: DataFrame) -> DataFrame:
    """id, band, bucket: the slice itself is the bucket, so only equal slices meet."""
    return sigs.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sig", b * ROWS + 1, F.lit(ROWS))))).alias("band", "bucket"))


def band_links(sigs: DataFrame) -> DataFrame:
    """a, b, shared: for every bucket of every band its smallest id (a) with each other one, and the bands the two share.

    A bucket is a star around its smallest id, so a hot one costs a row a member and no pairs; copies should have been joined before.
    No bucket is left out: whoever meets anybody is linked, by way of the smallest id at the most."""
    per = bands(sigs)
    low = per.groupBy("band", "bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    met = per.join(low, ["band", "bucket"]).filter("id <> a")
    return met.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))


def estimated_links(sigs: DataFrame) -> DataFrame:
    """a, b, similarity: the share of equal values in the signatures of linked ids."""
    one = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    two = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    return band_links(sigs).join(one, "a").join(two, "b").select("a", "b", F.round(code.matching_share(F.col("x"), F.col("y")), 6).alias("similarity"))


def shingles(tokens: Column) -> Column:
    """Runs of SHINGLE tokens as one string each, distinct; a shorter text is one shingle."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, F.lit(SHINGLE))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def _numbered(sets: DataFrame) -> tuple[DataFrame, int, int]:
    """id, n, packed of each id of ``sets`` (id, items): how many items, and their numbers in ascending order, several in a long.
    Numbers rise with the rows that have an item. Also the first number of an item that several rows have, and the bits of a number."""
    items = sets.select(F.explode_outer("items").alias("item")).filter("item is not null")  # explode would get a filter that computes the items again
    items = items.groupBy("item").agg(F.count("*").alias("df"))
    ranked = cut(items.orderBy("df", "item").withColumn("at", F.monotonically_increasing_id()))
    per = ranked.groupBy(F.shiftright("at", 33).cast("int").alias("p")).agg(F.count("*").alias("k"), F.count_if(F.col("df") == 1).alias("single")).collect()
    starts, total = [0] * (max([r.p for r in per], default=0) + 1), 0
    for r in sorted(per):
        starts[r.p], total = total, total + r.k
    bits = max(1, (total - 1).bit_length())
    number = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.shiftright("at", 33).cast("int") + 1) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    every = sets.select("id", F.explode_outer("items").alias("item")).join(small(ranked.select("item", number.alias("code"))), "item", "left")
    codes = every.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes")).select("id", F.size("codes").alias("n"), "codes")
    each = 63 // bits

    def long_of(k: Column) -> Column:
        parts = [F.shiftleft(F.coalesce(F.get("codes", k * each + r), F.lit(0).cast("long")), r * bits) for r in range(each)]
        return sum(parts[1:], parts[0])

    packed = F.when(F.col("n") == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / each).cast("int") - 1, F.lit(0))), long_of))
    return cut(codes.select("id", "n", packed.alias("packed"))), sum(r.single for r in per), bits


def _unpack(packed: pa.ListArray, n: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of all sets, one set after the other."""
    each = 63 // bits
    flat = (packed.flatten().to_numpy()[:, None] >> (np.arange(each, dtype=np.int64) * bits)) & ((1 << bits) - 1)
    room = -(-n // each) * each
    return flat.ravel()[np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) < np.repeat(n, room)]


def _near(n: np.ndarray, sketch: np.ndarray, index: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs that sizes and sketches leave open, i of ``index`` before j. Sizes ascend."""
    reach = np.searchsorted(n, np.floor(n[index] / threshold + 1e-6), "right")
    may = np.minimum(np.floor((n[index] + n[index] / threshold) * (1 - threshold) / (1 + threshold) + 1e-6), 64).astype(np.uint8)
    at = 0
    while at < len(index):
        low = index[at] + 1
        wide = reach[at : at + PAIRS // max(1, reach[at] - low) + 1] - low  # the widest row counts for all of a block
        end = at + max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), PAIRS, "right")))
        rows = index[at:end]
        i, j = np.nonzero(np.bitwise_count(sketch[rows][:, None] ^ sketch[None, low : reach[end - 1]]) <= may[at:end, None])
        i, j = rows[i], j + low
        later = j > i
        yield i[later], j[later]
        at = end


def _exact(i: np.ndarray, j: np.ndarray, codes: np.ndarray, first: np.ndarray, n: np.ndarray, item: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) of sets that share ``item`` those that match and share no lower item, with their similarity."""
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    left, right, size = where[: len(i)], where[len(i) :], n[used]
    own = codes[np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    values, col, times = np.unique(own, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what one set only has is never shared
    row, col = np.repeat(np.arange(len(used)), size)[times[col] > 1], place[col[times[col] > 1]]
    words = (place[-1] >> 6) + 1
    has = np.zeros(len(used) * words, dtype=np.uint64)
    np.add.at(has, row * words + (col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    has = has.reshape(len(used), words)
    word, bit = divmod(int(place[np.searchsorted(values, item)]), 64)
    below = np.full(word + 1, ~np.uint64(0))
    below[word] = np.uint64((1 << bit) - 1)
    found = []
    step = max(1, PAIRS // words)
    for at in range(0, len(i), step):
        a, b = left[at : at + step], right[at : at + step]
        new = np.flatnonzero(~(has[a, : word + 1] & has[b, : word + 1] & below).any(axis=1))
        shared = np.bitwise_count(has[a[new]] & has[b[new]]).sum(axis=1, dtype=np.int64)
        alike = shared / (size[a[new]] + size[b[new]] - shared)
        good = alike >= threshold - 1e-9
        found.append((new[good] + at, alike[good]))
    at, alike = (np.concatenate(x) for x in zip(*found))
    return i[at], j[at], alike


def _matches(batches: Iterator[pa.RecordBatch], threshold: float, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a, b, similarity of the pairs that match; rows come sorted by code, part, n, num. Memory is bounded by a batch and a group."""

    def groups(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        code, part, num, n, indexed = (rows[c].to_numpy() for c in ("code", "part", "num", "n", "indexed"))
        n = n.astype(np.int64)
        packed = rows["packed"].combine_chunks()
        codes = _unpack(packed, n, bits)
        first = np.cumsum(n) - n
        sketch = np.bitwise_xor.reduceat(np.uint64(1) << ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)), first)
        edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(part) != 0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(n)]):
            index = np.flatnonzero(indexed[s:e])
            if e - s < 2 or not len(index):
                continue
            for i, j in _near(n[s:e], sketch[s:e], index, threshold):
                if len(i):
                    i, j, alike = _exact(i, j, codes, first[s:e], n[s:e], code[s], threshold)
                    yield num[s + i], num[s + j], alike

    held: list[pa.RecordBatch] = []
    for batch in batches:
        code, part = batch.column("code").to_numpy(), batch.column("part").to_numpy()
        if not len(code):
            continue
        last = int(np.flatnonzero((code != code[-1]) | (part != part[-1]))[-1]) + 1 if (code[0], part[0]) != (code[-1], part[-1]) else 0
        if held and not last and (held[-1].column("code")[-1].as_py(), held[-1].column("part")[-1].as_py()) == (code[-1], part[-1]):
            held.append(batch)  # the group goes on
            continue
        done = [*held, batch.slice(0, last)]
        if sum(len(x) for x in done):
            yield from groups(pa.Table.from_batches(done))
        held = [batch.slice(last)]
    if held:
        yield from groups(pa.Table.from_batches(held))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is connected to over links (a, b)."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up = up[up]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that connect what (a, b) connect, at most one a node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(ids), at[: len(a)], at[len(a) :])
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _tally(matches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """a, b, links: of a task's pairs the number of each set's (b null), and a forest that connects what they connect (links 0)."""
    none = np.empty(0, dtype=np.int64)
    ids, links, tree, open_ = none, none, (none, none), []

    def merge() -> None:
        nonlocal ids, links, tree
        a, b = (np.concatenate(x) for x in zip(*open_))
        new, at = np.unique(np.concatenate([ids, a, b]), return_inverse=True)
        ids, links = new, np.bincount(at, weights=np.concatenate([links, np.ones(2 * len(a))]), minlength=len(new)).astype(np.int64)
        tree = _forest(np.concatenate([tree[0], a]), np.concatenate([tree[1], b]))
        open_.clear()

    kept = 0
    for a, b, _ in matches:
        open_.append((a, b))
        kept += len(a)
        if kept > PAIRS:
            merge()
            kept = 0
    if open_:
        merge()
    for a, b, k in ((ids, pa.nulls(len(ids), pa.int64()), links), (*tree, np.zeros(len(tree[0]), dtype=np.int64))):
        for at in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000], pa.int64()) if isinstance(x, np.ndarray) else x[at : at + 50_000] for x in (a, b, k)], ["a", "b", "links"])


def _met(group: DataFrame, single: int, bits: int, threshold: float, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` makes of the sets (num, n, packed) that share an item of their prefixes, all sets of such an item in one task."""
    n, each = F.col("n"), 63 // bits
    length = n - F.ceil(F.lit(threshold) * n - 1e-6) + 1
    rows = group.select("num", "n", "packed", F.explode(F.sequence(F.lit(0), length.cast("int") - 1)).alias("pos"))
    word = F.get("packed", F.floor(F.col("pos") / each).cast("int"))
    rows = rows.withColumn("code", F.call_function("shiftright", word, (F.col("pos") % each * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))).filter(F.col("code") >= single)
    hot = rows.groupBy("code").count().filter(F.col("count") > GROUP_ROWS).select("code", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts"))
    rows = rows.join(small(hot), "code", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    indexed = (F.col("pos") < n - F.ceil(F.lit(2 * threshold / (1 + threshold)) * n - 1e-6) + 1) & (F.pmod(F.xxhash64("num"), F.col("parts").cast("long")) == F.col("part"))
    rows = rows.select("code", "part", "num", "n", indexed.alias("indexed"), "packed")
    parts = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "code", "part").sortWithinPartitions("code", "part", "n", "num").mapInArrow(run, schema)


def similarity_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of all pairs of distinct sets (id, items) at or above the threshold, a < b. Ids of equal sets must have been joined before."""
    coded, single, bits = _numbered(sets.filter("id is not null"))
    group = cut(coded.filter("n > 0").withColumn("num", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, alike in _matches(batches, threshold, bits):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike)], ["x", "y", "similarity"])

    met = _met(group, single, bits, threshold, run, "x long, y long, similarity double")
    one, two = (group.select(F.col("num").alias(c), F.col("id").alias(f"_{c}")) for c in "xy")
    return met.join(one, "x").join(two, "y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


def _classes(ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, class of what has links (a, b): the smallest number it is connected to. Forests are merged in fewer and fewer tasks; where they stay too large for one, labels spread by joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [b for b in batches if b.num_rows]
        if every:
            t = pa.Table.from_batches(every)
            a, b = _forest(t["a"].to_numpy(), t["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = links.count()
    while n > TASK_LINKS:
        links = cut(links.repartition(math.ceil(n / TASK_LINKS), "a", "b").mapInArrow(run, "a long, b long"))
        was, n = n, links.count()
        if n > TASK_LINKS and n > 0.8 * was:
            return components(ids, links)
    return links.repartition(1).mapInArrow(run, "a long, b long").select(F.col("a").alias("id"), F.col("b").alias("class"))


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, class: the smallest id each id is connected to over ``links`` (a, b); labels spread along links and along labels, so long chains take few rounds."""
    hop = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(ids.select("id", F.col("id").alias("class")).distinct())
    while True:
        seen = hop.join(label.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("got"))
        new = label.join(seen, "id", "left").select("id", F.col("class").alias("was"), F.least("class", F.coalesce("got", "class")).alias("class"))
        up = new.select(F.col("id").alias("class"), F.col("class").alias("top"))
        new = cut(new.join(up, "class", "left").select("id", "was", F.least("class", F.coalesce("top", "class")).alias("class")))
        label = new.select("id", "class")
        if new.filter("class <> was").isEmpty():
            return label


def clones(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, class, copies, links: each symbol (id, items) with its class, the symbols whose set equals its own, and how many other
    different sets are similar to it. Symbols of empty or null sets stand alone, those without id are dropped, a repeated row counts once.
    ``sets`` is computed twice: for the numbers of the items, then for the sets of numbers; all else is done on these."""
    with freeing(sets.sparkSession):
        coded, single, bits = _numbered(sets.filter("id is not null"))
        group = coded.filter("n > 0").groupBy("packed").agg(F.first("n").alias("n"), F.min("id").alias("rep"), F.count("*").alias("copies"))
        group = cut(group.withColumn("num", F.monotonically_increasing_id()))
        told = cut(_met(group, single, bits, threshold, lambda batches: _tally(_matches(batches, threshold, bits)), "a long, b long, links long"))
        degree = told.filter("b is null").groupBy(F.col("a").alias("num")).agg(F.sum("links").alias("links"))
        label = cut(_classes(group.select(F.col("num").alias("id")), told.filter("b is not null").select("a", "b"))).select(F.col("id").alias("num"), F.col("class").alias("top"))
        per = group.join(label, "num", "left").join(degree, "num", "left").select("packed", "rep", "copies", F.coalesce("top", "num").alias("top"), F.coalesce("links", F.lit(0)).alias("links"))
        lowest = per.groupBy("top").agg(F.min("rep").alias("class"))
        per = cut(per.join(lowest, "top").select("packed", "class", "copies", "links"))
    found = coded.filter("n > 0").join(per, "packed").select("id", "class", "copies", "links")
    alone = coded.filter("n = 0").select("id", F.col("id").alias("class"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return found.unionByName(alone)
