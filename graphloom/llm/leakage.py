"""Evaluation texts leaking into training texts.

Method: a prefix-filtered set join over word shingles. A shingle is two neighbouring words, the longest unit that survives
an odd word after every other one. Its rarity is the number of documents of the whole corpus that hold it, counted in
the one pass that reads the texts. A document that holds ``min_words`` words of an item holds at least ``min_words / 2`` of
the item's shingles, so it must hold one of all but that many of them: this prefix, the rarest first, is all that is joined.
Length bounds it further (both texts must have covered enough words), positions decide: hits on one diagonal are runs,
runs are chained in the order of both texts, and what a stretch of the item's size holds is verified exactly.

What a stretch is: a chain of runs of two words or more, each in both texts word by word, worth one for each word less GAP_COST
for each word skipped between runs on either side; it counts from STRETCH_WORDS words and a worth of STRETCH_WORTH. So an
inserted word after every two words is bridged, while the frame that two questions of one kind share is not a stretch.

Instructions: an opening of OPENING words or more with which MANY items begin that go on differently. It is cut from its
items. Copies and near-copies of an item share their openings too, but go on alike: going on differently is measured by the
distinct five-word shingles of what follows. A passage that items share elsewhere stands for each of them, however many.

One pass reads the texts and keeps (document, position, shingle) of shingles that pass a bitmap of the items' shingles, whose
size is bounded; all else works on that table. Up to HELD_WORDS item words the prefix index is sent to the executors and no
document row is shuffled; beyond it documents and prefix meet in a shuffle join. Both give the same rows.

Defined results: null and blank texts hold nothing; an item with fewer words than the threshold, apart from its
instruction, is never found; repeated items and documents are judged alike, each under its own id; a document's rows do not
depend on other documents, nor on items that do not share its items' openings.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.cluster import cut

#: Words of an item a document must hold. TESTDATA says 20; one may be lost to an odd word at the edge.
MIN_WORDS = 19
#: Words a stretch must have, what it must be worth, and what a word skipped between two runs costs, in either text.
STRETCH_WORDS, STRETCH_WORTH, GAP_COST = 6, 6.0, 0.75
#: Words of the shortest instruction, and items that must go on differently behind it.
OPENING, MANY = 5, 6
#: Item words up to which the prefix index is sent to the executors.
HELD_WORDS = 2_000_000
#: Bits of the largest bitmap of item shingles (32 MiB).
BITMAP = 28

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>|<!--.*?-->", re.S)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")


def words(text: str) -> list[str]:
    """Words in comparable form: without case, markup, invisible characters and breaks within words."""
    if "<" in text:
        text = _TAG.sub("", text) if _TAG.search(text) else text
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if not text.isascii():
        if _INVISIBLE.search(text):
            text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if _CONTROL.search(text):
        text = _CONTROL.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "-\n" in text or "‐\n" in text or "- \n" in text or "-\r" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.lower())


# --- shingles ------------------------------------------------------------------------------------------------------


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it grows large, which changes nothing."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _shingles(h: np.ndarray, n: int = 2) -> np.ndarray:
    """Hashes of all ``n`` neighbouring words, as signed numbers."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingles(text_words: list[str], n: int = 2) -> np.ndarray:
    return _shingles(np.array([xxhash.xxh3_64_intdigest(w) for w in text_words], dtype=np.uint64), n)


# --- verification --------------------------------------------------------------------------------------------------


def _runs(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, and starts in it, of hits that go on in both texts; words of each run, and its number by hit. Hits are (doc, item) positions of equal shingles."""
    order = np.lexsort((doc, doc - item))
    d, diagonal = doc[order], (doc - item)[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (d[1:] != d[:-1] + 1)
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(d))) + 1, np.cumsum(new) - 1


def held(doc: np.ndarray, item: np.ndarray, least: int = MIN_WORDS) -> int:
    """Words of the item that stand in the document, in order, over all stretches; 0 if fewer than ``least``."""
    order, starts, size, _ = _runs(doc, item)
    if size.sum() < least:
        return 0
    runs = sorted(zip(doc[order][starts].tolist(), item[order][starts].tolist(), size.tolist()))
    worth, words_, back, own = [], [], [], []
    near: list[int] = []  # runs that a later one may still be chained to
    for i, (p, a, n) in enumerate(runs):
        best, total, last, gained = float(n), n, -1, n
        kept = []
        for j in near:
            q, c, m = runs[j]
            dp, da = p - q - m, a - c - m
            if dp * GAP_COST >= worth[j]:
                continue
            kept.append(j)
            if p <= q or a <= c:
                continue
            over = max(0, -dp, -da)
            gain = n - over
            if gain < 1:
                continue
            value = worth[j] + gain - GAP_COST * (dp + da + 2 * over)
            if value > best:
                best, total, last, gained = value, words_[j] + gain, j, gain
        near = [*kept, i]
        worth.append(best)
        words_.append(total)
        back.append(last)
        own.append(gained)
    used = [False] * len(runs)
    stretches = []
    for i in sorted(range(len(runs)), key=lambda i: -worth[i]):
        k, first, total = i, i, 0
        while k >= 0 and not used[k]:
            used[k] = True
            total += own[k]
            first, k = k, back[k]
        if first == i and used[i] and not total:
            continue
        value = worth[i] - (worth[first] - runs[first][2] if k >= 0 else 0)
        total += runs[first][2] - own[first] if k >= 0 else 0
        if total >= STRETCH_WORDS and value >= STRETCH_WORTH:
            stretches.append((runs[first][0], runs[first][1], runs[i][0] + runs[i][2], runs[i][1] + runs[i][2], total))
    most = _in_order(stretches)
    return most if most >= least else 0


def _in_order(stretches: list[tuple[int, int, int, int, int]]) -> int:
    """The most words over stretches (starts in both texts, ends in both, words) that follow one another in both texts."""
    if len(stretches) < 2:
        return stretches[0][4] if stretches else 0
    ends = sorted({s[3] for s in stretches})
    tree = [0] * (len(ends) + 1)  # prefix maxima by end in the item
    at = {e: k + 1 for k, e in enumerate(ends)}
    value = [0] * len(stretches)
    events = sorted([(s[0], 1, n) for n, s in enumerate(stretches)] + [(s[2], 0, n) for n, s in enumerate(stretches)])
    for _, starts, n in events:
        s = stretches[n]
        if starts:
            low, high = 0, len(ends)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if ends[mid] <= s[1] else (low, mid)
            best = 0
            while low:
                best = max(best, tree[low])
                low -= low & -low
            value[n] = best + s[4]
        else:
            k = at[s[3]]
            while k < len(tree):
                tree[k] = max(tree[k], value[n])
                k += k & -k
    return max(value)


# --- items ---------------------------------------------------------------------------------------------------------


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words(t.as_py())) for t in batch.column(1)], pa.string())], names=["item_id", "key"])


def _shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each item its shingles of two and of five words, and the hash of each opening."""
    for f in frames:
        h = [np.array([xxhash.xxh3_64_intdigest(w) for w in t.split(" ")], dtype=np.uint64) for t in f["key"]]
        openings = []
        for t in f["key"]:
            x, out = xxhash.xxh3_64(), []
            for k, w in enumerate(t.split(" ")):
                x.update(w + " ")
                if k + 1 >= OPENING:
                    out.append(x.intdigest() - 2**63)
            openings.append(out)
        yield pd.DataFrame({"item": f["item"], "item_ids": f["item_ids"], "shingles": [_shingles(x) for x in h], "fives": [np.unique(_shingles(x, 5)) for x in h], "openings": openings})


def prepared(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """item (number of a text), item_ids, shingles: each different text once, without its instruction, if long enough."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    # copies of a text, however spelled, are one
    one = items.mapInArrow(_keyed, "item_id long, key string").filter("key <> ''").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    one = one.select(F.xxhash64("key").alias("item"), "item_ids", "key").mapInPandas(_shingled, "item long, item_ids array<long>, shingles array<long>, fives array<long>, openings array<long>")
    one = cut(one)
    opening = one.select("item", F.posexplode("openings").alias("k", "opening")).withColumn("k", F.col("k") + OPENING)
    many = opening.groupBy("k", "opening").agg(F.count("*").alias("n")).filter(F.col("n") >= MANY)
    longest = opening.join(many, ["k", "opening"]).groupBy("item", "n").agg(F.max_by("opening", "k").alias("opening"), F.max("k").alias("k"))
    behind = longest.join(one.select("item", F.explode("fives").alias("five")), "item").groupBy("k", "opening", "n").agg(F.countDistinct("five").alias("different"), F.count("*").alias("all"))
    same = F.col("k") - 4  # five-word shingles of the opening itself
    spread = (F.col("different") - same) / (F.col("all") / F.col("n") - same)
    real = behind.filter((F.col("all") / F.col("n") - same >= 1) & (spread >= MANY)).select("k", "opening")
    cuts = longest.join(real, ["k", "opening"]).groupBy("item").agg(F.max("k").alias("k"))
    out = one.join(cuts, "item", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    out = out.select("item", "item_ids", F.slice("shingles", F.col("k") + 1, F.greatest(F.size("shingles") - F.col("k"), F.lit(0))).alias("shingles"))
    return out.filter(F.size("shingles") >= min_words - 1)


# --- operator ------------------------------------------------------------------------------------------------------


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the lowest ``bits`` bits of the shingles; at most 2 ** (bits - 6) rows come to the driver."""
    low = F.col("shingle").bitwiseAND(2**bits - 1)
    rows = keys.select(F.shiftright(low, 6).alias("at"), F.expr("shiftleft(1L, cast(shingle & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(2 ** (bits - 6), dtype=np.uint64)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bit"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def hits(documents: DataFrame, bitmap: np.ndarray, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, at, shingle (arrays) of documents of enough words: the shingles that items may hold, and where they stand."""
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = sent.value, _Hashes()
        mask = np.int64(len(known) * 64 - 1)
        for batch in batches:
            ids, flat, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(t.as_py())
                if len(w) >= min_words:
                    ids.append(i)
                    flat += [hashes[x] for x in w]
                    ends.append(len(flat))
            keys = _shingles(np.array(flat, dtype=np.uint64))
            low = keys & mask
            hit = (known[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) != 0
            if len(ends):
                hit[np.array(ends[:-1], dtype=np.int64) - 1] = False  # not across documents
            where = np.flatnonzero(hit)
            n = np.searchsorted(where, ends)
            starts = np.array([0, *ends[:-1]], dtype=np.int64)
            at = where - np.repeat(starts, np.diff(np.append(0, n))) if len(ends) else where
            offsets = pa.array(np.append(0, n).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(keys[where]))], names=["doc_id", "at", "shingle"]
            )

    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, at array<int>, shingle array<long>").filter("size(at) > 0")


class Index:
    """Shingles of all items with their places, and which of them belong to an item's prefix."""

    def __init__(self, rows: pd.DataFrame) -> None:
        """``rows``: item (0, 1, ...), at, shingle, prefix."""
        rows = rows.sort_values(["shingle", "item", "at"], ignore_index=True)
        self.keys, self.starts = np.unique(rows["shingle"].to_numpy(), return_index=True)
        self.ends = np.append(self.starts[1:], len(rows))
        self.item, self.at, self.prefix = rows["item"].to_numpy(dtype=np.int32), rows["at"].to_numpy(dtype=np.int32), rows["prefix"].to_numpy(dtype=bool)

    def found(self, at: np.ndarray, shingle: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(item, words) of the items a document holds."""
        if not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, shingle), len(self.keys) - 1)
        ok = self.keys[k] == shingle
        if 2 * ok.sum() < least:
            return []
        k, at = k[ok], at[ok]
        n = self.ends[k] - self.starts[k]
        where = np.repeat(self.starts[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item, a, d = self.item[where], self.at[where], np.repeat(at, n)
        # the prefix proposes; then enough shingles, at different places of both texts
        proposed = np.bincount(item, self.prefix[where]) > 0
        proposed &= 2 * np.bincount(item) >= least
        keep = proposed[item]
        item, a, d = item[keep].astype(np.int64), a[keep].astype(np.int64), d[keep].astype(np.int64)
        out = []
        for side in (d, a):
            wide = np.int64(side.max(initial=0) + 2)
            covered = np.bincount(np.unique(np.concatenate([item * wide + side, item * wide + side + 1])) // wide, minlength=len(proposed))
            proposed &= covered >= least
        order = np.argsort(item, kind="stable")
        item, a, d = item[order], a[order], d[order]
        for i in np.flatnonzero(proposed):
            lo, hi = np.searchsorted(item, i), np.searchsorted(item, i, "right")
            n = held(d[lo:hi], a[lo:hi], least)
            if n:
                out.append((int(i), n))
        return out


_OUT = "doc_id long, item_id long, words int"


def _rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32())], names=["doc_id", "item_id", "words"])


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, held_words: int = HELD_WORDS) -> DataFrame:
    """doc_id, item_id, words: documents with at least ``min_words`` words of an item."""
    spark = documents.sparkSession
    asked = cut(prepared(items, min_words))
    places = asked.select("item", F.size("shingles").alias("n"), F.posexplode("shingles").alias("at", "shingle"))
    size = asked.agg(F.sum(F.size("shingles"))).first()[0] or 0
    found = cut(hits(documents, _bitmap(places, min(BITMAP, max(12, math.ceil(math.log2(max(1, 16 * size)))))), min_words))
    rarity = found.select(F.explode(F.array_distinct("shingle")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("documents"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("documents", F.lit(0)), "shingle", "at"))
    places = places.join(rarity, "shingle", "left").select("item", "at", "shingle", (rank <= F.col("n") - math.ceil(min_words / 2) + 1).alias("prefix"))
    enough = found.filter(F.size("at") >= math.ceil(min_words / 2))
    if size <= held_words:
        ids = asked.select("item", "item_ids").toPandas()
        number = {x: k for k, x in enumerate(ids["item"])}
        rows = places.toPandas()
        rows["item"] = [number[x] for x in rows["item"]]
        sent = spark.sparkContext.broadcast((Index(rows), [[int(x) for x in copies] for copies in ids["item_ids"]]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, copies = sent.value
            for batch in batches:
                out = []
                for i, at, shingle in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    out += [(i, c, n) for k, n in index.found(at.values.to_numpy(), shingle.values.to_numpy(), min_words) for c in copies[k]]
                yield _rows(out)

        return enough.mapInArrow(run, _OUT)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, at, shingle, copies, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                index = _of_one(wanted.values.to_numpy())
                out += [(i, c, n) for _, n in index.found(at.values.to_numpy(), shingle.values.to_numpy(), min_words) for c in copies]
            yield _rows(out)

    pairs = enough.select("doc_id", F.explode(F.array_distinct("shingle")).alias("shingle")).join(places.filter("prefix").select("item", "shingle"), "shingle").select("doc_id", "item").distinct()
    pairs = pairs.join(enough, "doc_id").join(asked, "item").select("doc_id", "at", "shingle", "item_ids", "shingles")
    return pairs.mapInArrow(verify, _OUT)


def _of_one(wanted: np.ndarray) -> Index:
    return Index(pd.DataFrame({"item": 0, "at": np.arange(len(wanted)), "shingle": wanted, "prefix": True}))
