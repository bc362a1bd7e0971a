"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: the merges are compiled into a finite-state transducer over bytes that is determinised lazily. A nondeterministic
configuration is a pair (node of the token trie, token before it): the token being read, and the one it must be able to
stand behind. A token may stand behind another if encoding their joint bytes gives back just these two; since an encoding
is the one segmentation whose neighbours all may stand so, exactly one token ends at each position. Sets of
configurations become states of the deterministic machine when a text first leads to them, and their transitions are kept.
A token is put out as soon as all configurations agree on it, at the latest after as many bytes as the longest token has.
The output of whole pieces of the split pattern is kept too: it is the transducer's answer on a path from start to end.

Decoding streams: bytes of tokens go through an incremental UTF-8 state machine, which holds back an unfinished character.

Defined results: null, empty: an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of the vocabulary, as its publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries a worker keeps of each memory before it starts it anew; results do not depend on it.
KEPT = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    ROOT = 0

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for b in word:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = rank
        self._behind: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((self.ROOT, -1),)
        self._state_no = {start: 0}
        self._states = [start]
        self._moves: list[dict[int, tuple[int, int, int]]] = [{}]

    def merge(self, word: bytes) -> list[int]:
        """The encoding of a few bytes by merging the pair of lowest rank again and again; defines which tokens may be neighbours."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, before: int, token: int) -> bool:
        key = (before, token)
        known = self._behind.get(key)
        if known is None:
            if len(self._behind) > 4 * KEPT:
                self._behind.clear()
            joint = (self.bytes_of[before] if before >= 0 else b"") + self.bytes_of[token]
            known = self._behind[key] = self.merge(joint) == ([before, token] if before >= 0 else [token])
        return known

    def _move(self, state: int, byte: int) -> tuple[int, int, int]:
        """(next state, token that ends with this byte or -1, starts that stay open)."""
        held, ends = [], -1
        for node, before in self._states[state]:
            nxt = self.child[node].get(byte)
            if nxt is None:
                continue
            t = self.token[nxt]
            if t >= 0 and ends < 0 and self.may_follow(before, t):
                ends = t
            if self.child[nxt]:
                held.append((nxt, before))
        if ends >= 0:
            held.append((self.ROOT, ends))
        key = tuple(held)
        no = self._state_no.get(key)
        if no is None:
            no = self._state_no[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        out = self._moves[state][byte] = (no, ends, len(held))
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split pattern, of any length, in time proportional to it."""
        if len(self._states) > KEPT:
            self._reset()
        state, moves = 0, self._moves
        out: list[int] = []
        last: list[int] = []  # the token that ends at each position since the last output
        for b in piece:
            m = moves[state].get(b) or self._move(state, b)
            state, ends, held = m
            last.append(ends)
            if held == 1 and ends >= 0:  # all configurations agree on what lies behind
                self._emit(last, out)
                last = []
        if last:
            self._emit(last, out)
        return out

    def _emit(self, last: list[int], out: list[int]) -> None:
        at, back = len(last), []
        while at > 0:
            t = last[at - 1]
            back.append(t)
            at -= len(self.bytes_of[t])
        out.extend(reversed(back))


class Encoder(dict):
    """piece -> ids, filled by the transducer as pieces appear."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.machine = Transducer(load_ranks(path))
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> list[int]:
        ids = self.machine.encode_piece(piece.encode("utf-8", "replace"))
        if len(piece) <= 64:
            if len(self) > KEPT:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


class Utf8Stream:
    """Incremental UTF-8 decoder: state is the number of bytes a character still needs; faults become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # where an unfinished character may begin
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                if self._need(lead) > back:
                    cut = len(data) - back
                break
        if final:
            cut = len(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


def decode(machine: Transducer, ids: Iterable[int]) -> Iterator[str]:
    stream = Utf8Stream()
    for i in ids:
        s = stream.feed(machine.bytes_of[i])
        if s:
            yield s
    rest = stream.feed(b"", final=True)
    if rest:
        yield rest


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = RANKS, folder: str = TOKENIZERS) -> str:
    """The vocabulary file: in ``folder``, else where the package of public vocabularies has it."""
    path = os.path.join(folder, name)
    if os.path.exists(path):
        return path
    return importlib.import_module("public_tokenizers").path(name)


def _ship(df: DataFrame, path: str) -> str:
    """Send the vocabulary file to the executors, which need not share the driver's folders; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` and the ids of ``text``, each row on its own: no shuffle, one pass, memory of one Arrow batch."""
    name = _ship(df, path or vocabulary())
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        get, split = enc.__getitem__, enc.split
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat: list[int] = []
            ends = np.zeros(len(texts) + 1, dtype=np.int32)
            parts, total = [], 0
            for i, t in enumerate(texts):
                if t:
                    flat.extend(chain.from_iterable(map(get, split(t))))
                if len(flat) > 1_000_000:
                    parts.append(np.array(flat, dtype=np.int32))
                    total += len(flat)
                    flat = []
                ends[i + 1] = total + len(flat)
            parts.append(np.array(flat, dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", out])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type.simpleString()}, {out} array<int>").withColumnRenamed("key", key)


def round_trip(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key``, tokens, same: whether streaming decode gives back the text."""
    name = _ship(df, path or vocabulary())

    def run(frames):
        enc = encoder(SparkFiles.get(name))
        for pdf in frames:
            ids = [enc.encode(t) for t in pdf["text"]]
            same = ["".join(decode(enc.machine, i)) == (t or "") for i, t in zip(ids, pdf["text"])]
            yield pdf[["key"]].assign(tokens=[len(i) for i in ids], same=same)

    key_type = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {key_type}, tokens long, same boolean").withColumnRenamed("key", key)
