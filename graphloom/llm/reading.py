"""Reading level of each English document.

Method: each word of the graded texts gets an acquisition grade, the band at which readers meet it: its smoothed rate in
each band gives a distribution over the bands, the grade is that distribution's mean. A passage is placed by quantiles of
the grades of its known words; the quantile levels are combined by weights and cut at thresholds calibrated on the
graded texts, each text judged with the grades of the others. A document's band is the one most of its prose words
stand in, passage by passage; code, tables, links and headings are no prose.

Whether a passage is English is told by its letters, not by lists of words: the graded texts give the chances of each letter
after the two before it, and a passage whose words are far less likely than those of held-out graded passages (by FAR standard
deviations) is in another language, whichever it is.

Defined results: null, blank, mainly non-English texts and those with fewer than 40 words of prose give no row; an empty
graded table gives no rows; ties between bands go to the lower one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Graded texts the model is fitted on, the first by sample_id; a documented bound of the fit, not of what is judged.
FIT_TEXTS = 5_000
#: Prose words a document must have.
MIN_WORDS = 40
#: Quantiles of a passage's known-word grades.
QUANTILES = (0.25, 0.5, 0.75, 0.9)
#: Known words below which a passage is too short to be placed by itself and joins the next.
PASSAGE = 25
#: Standard deviations of held-out passages below their mean at which a passage is no longer taken for English, and at which it surely
#: is another language; the least a deviation is taken for.
FAR, SPREAD = (5.0, 9.0), 0.2

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]*`|!?\[[^\[\]\n]*\]\([^()\n]*\)|<?\bhttps?://\S+|\bwww\.\S+|</?[A-Za-z][^<>\n]*>")
_SETEXT = re.compile(r"^[^\n]+\n[ \t]*(?:=+|-{2,})[ \t]*$", re.M)
_SKIP_LINE = re.compile(r"^(?:[ \t]*(?:#{1,6}[ \t]|\||[+|][-+=|]{2,}|[-=*_~]{3,}\s*$|\$ |>>> )|\t| {4,}(?![-*+\d]))")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:def|function|func|class|import|package|const|let|var|return|public|private|export|for|if|while|try|except|@\w+)\b.*[(){}=:;]|^\s*[\w.]+\s*(?::=|=)\s*\S|^\s*[}\])]|^\s*//|^\s*/?\*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")

def prose(text: str) -> list[str]:
    """Passages of prose: fenced and indented code, tables, headings, links and code-like lines are left out."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "\n==" in text or "\n--" in text:
        text = _SETEXT.sub("", text)
    if "`" in text or "](" in text or "<" in text or "://" in text or "www." in text:
        text = _INLINE.sub(" ", text)
    out, now = [], []
    for line in text.split("\n"):
        if not line or line.isspace():
            if now:
                out.append(" ".join(now))
                now = []
        elif _SKIP_LINE.match(line) or _CODE_LINE.search(line):
            continue
        else:
            now.append(line)
    if now:
        out.append(" ".join(now))
    return out


class Letters(dict):
    """Mean log chance of the letters of a word, each after the two before it; words are kept as they are met."""

    def __init__(self, texts: list[list[str]]) -> None:
        super().__init__()
        self.three: Counter[str] = Counter()
        self.two: Counter[str] = Counter()
        for w, n in Counter(x for t in texts for x in t).items():
            s = f"^{w}$"
            for i in range(len(s) - 2):
                self.three[s[i : i + 3]] += n
                self.two[s[i : i + 2]] += n
        self.three, self.two = dict(self.three), dict(self.two)

    def __missing__(self, w: str) -> float:
        if len(self) > 200_000:
            self.clear()
        s = f"^{w}$"
        three, two = self.three.get, self.two.get
        # a tenth of a sight for each of some sixty letters
        p = self[w] = sum(math.log((three(s[i : i + 3], 0) + 0.1) / (two(s[i : i + 2], 0) + 6)) for i in range(len(s) - 2)) / (len(s) - 2)
        return p

    def __reduce__(self) -> tuple:
        return _letters, (self.three, self.two)

    def mean(self, words: list[str]) -> float:
        return sum([self[w] for w in words]) / len(words) if words else -math.inf


def _letters(three: dict[str, int], two: dict[str, int]) -> Letters:
    out = Letters([])
    out.three, out.two = three, two
    return out


@dataclass(frozen=True)
class Model:
    grades: dict[str, float]
    weights: tuple[float, ...]
    cuts: tuple[float, ...]
    bands: tuple[int, ...]
    letters: Letters
    least: float  # mean log chance below which a passage is not taken for English
    surely: float  # and below which it surely is another language

    def foreign(self, words: list[str]) -> float:
        """How far a passage counts as another language: 0, 1, or a half where its letters leave it open, as invented names do."""
        mean = self.letters.mean(words)
        return 0.0 if mean >= self.least else 0.5 if mean >= self.surely else 1.0

    def level(self, grades: list[float]) -> float:
        grades = sorted(grades)
        n = len(grades) - 1
        return sum(w * grades[int(q * n)] for w, q in zip(self.weights, QUANTILES))

    def band(self, grades: list[float]) -> int:
        x = self.level(grades)
        return self.bands[sum(x > c for c in self.cuts)]


def acquisition(texts: list[tuple[list[str], int]]) -> dict[str, float]:
    """word -> mean band of its distribution: rate in each band, smoothed by half an occurrence, words met in one text only left out."""
    counts: dict[int, Counter[str]] = defaultdict(Counter)
    spread: Counter[str] = Counter()
    for w, b in texts:
        counts[b].update(w)
        spread.update(set(w))
    bands = sorted(counts)
    totals = {b: sum(counts[b].values()) for b in bands}
    out = {}
    for w, n in spread.items():
        if n >= 2:
            rates = [(counts[b][w] + 0.5) / (totals[b] + 0.5 * len(spread)) for b in bands]
            out[w] = sum(b * r for b, r in zip(bands, rates)) / sum(rates)
    return out


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """Grades from all texts; weights and thresholds from each text's quantiles under the grades of the other folds' texts."""
    texts = [([w.lower() for p in prose(t) for w in _WORD.findall(p)], b) for t, b in rows if t and b is not None]
    texts = [(w, b) for w, b in texts if w]
    bands = sorted({b for _, b in texts})
    if not texts:
        return None
    grades = acquisition(texts)
    letters = Letters([w for w, _ in texts])
    x, y, chances = [], [], []
    folds = min(5, len(texts))
    for f in range(folds):
        rest = [t for k, t in enumerate(texts) if k % folds != f] if folds > 1 else texts
        held, seen = acquisition(rest), Letters([w for w, _ in rest])
        for k in range(f, len(texts), folds):
            w, b = texts[k]
            # the texts are longer than passages: they are judged as passages of their usual length are
            for at in range(0, max(1, len(w) - PASSAGE), 2 * PASSAGE):
                chances.append(seen.mean(w[at : at + 2 * PASSAGE]))
                g = sorted(held[v] for v in w[at : at + 2 * PASSAGE] if v in held)
                if len(g) >= 8:
                    x.append([g[int(q * (len(g) - 1))] for q in QUANTILES])
                    y.append(b)
    least, surely = (float(np.mean(chances) - far * max(np.std(chances), SPREAD)) for far in FAR)
    if not x or len(bands) == 1:
        return Model(grades, tuple([1 / len(QUANTILES)] * len(QUANTILES)), tuple(), (bands[0],) if len(bands) == 1 else tuple(bands), letters, least, surely)
    a, t = np.array(x), np.array(y, dtype=float)
    centred = a - a.mean(0)
    weights = np.linalg.solve(centred.T @ centred + 0.1 * len(t) / 10 * np.eye(a.shape[1]), centred.T @ (t - t.mean()))
    score = a @ weights
    means = [score[t == b].mean() for b in bands]
    spread = [score[t == b].std() + 1e-6 for b in bands]
    cuts = [(m1 * s2 + m2 * s1) / (s1 + s2) for m1, m2, s1, s2 in zip(means, means[1:], spread, spread[1:])]
    return Model(grades, tuple(map(float, weights)), tuple(map(float, cuts)), tuple(bands), letters, least, surely)


def judge(text: str | None, model: Model) -> int | None:
    """Band of the prevailing English prose, None where the text is not mainly English or has too little of it."""
    if not text:
        return None
    grade = model.grades.get
    english = other = 0
    by_band: Counter[int] = Counter()
    held: list[float] = []
    size = 0
    for p in prose(text):
        words = _WORD.findall(p.lower())
        n = len(words)
        if not p.isascii():
            cjk = len(_CJK.findall(p))
            if cjk > 2 * n:
                other += cjk // 2
                continue
        grades = [g for g in map(grade, words) if g is not None]
        foreign = model.foreign(words)
        if foreign:
            if n >= 6:
                other += foreign * n
            continue
        english += n
        held += grades
        size += n
        if len(held) >= PASSAGE:
            by_band[model.band(held)] += size
            held, size = [], 0
    if held and (len(held) >= 8 or not by_band):
        by_band[model.band(held)] += size
    if english < MIN_WORDS or english <= other or not by_band:
        return None
    return min(by_band, key=lambda b: (-by_band[b], b))


def levels(documents: DataFrame, graded: DataFrame, fit_texts: int = FIT_TEXTS) -> DataFrame:
    """doc_id, band: one pass over the texts with a model fitted on a bounded number of graded texts; no shuffle."""
    rows = graded.filter("text is not null and band is not null").orderBy("sample_id", "text").limit(fit_texts).select("text", "band").collect()
    model = fit([(r[0], r[1]) for r in rows])
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [(i, judge(t.as_py(), m)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))] if m else []
            found = [x for x in found if x[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32())], names=["doc_id", "band"])

    return docs.mapInArrow(run, "doc_id long, band int")
