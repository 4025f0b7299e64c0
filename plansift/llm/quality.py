"""Quality scores from document statistics by histogram gradient-boosted trees.

Every document is reduced to a few dozen numbers: lengths, shares of kinds of
characters, repetition of words and lines, and the same for its worst lines.
Trees are fitted on a bounded sample of labelled rows and flattened into
arrays; scoring goes down all trees at once for a batch of documents.

Defined cases: null counts as the empty text, which is scored like any other;
without labels of both classes every score is the class's share; rows that
repeat an id are scored each; an empty table gives no rows; extra columns are
never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.boosting import Trees, calibrated, fit_trees, isotonic, out_of_fold
from plansift.llm.labelled import SAMPLE, held_out, training_rows
from plansift.llm.rows import identified, map_columns

KEEP_FROM = 0.7

#: Kinds of ASCII characters; bytes of others count as letters' bytes.
_KIND = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = (
        0 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch in " \t\x0b\x0c\r"
        else 5 if _ch == "\n" else 6 if _ch in ".,;:'\"()-" else 7 if _ch in "!?" else 8 if _ch == "|" else 9
    )
STATISTICS = (
    "log_bytes", "log_words", "other", "lower", "upper", "digit", "space", "newline", "plain_mark", "loud_mark", "bar", "symbol", "word_bytes",
    "long_words", "distinct", "top_word", "top_ten", "same_as_last", "same_pair", "log_lines", "distinct_lines", "line_bytes", "short_lines",
    "ends_plain", "worst_upper", "worst_symbol", "worst_repeat", "bad_lines", "bad_bytes", "packs", "first_upper", "words_once", "marked_words",
    "one_letter", "sentences", "half_again", "line_repeats",
)


def _share(counts: np.ndarray) -> np.ndarray:
    return counts / max(1, counts.sum())


def _line_faults(line: bytes) -> tuple[float, float, float]:
    """Upper-case, symbol and repeated-word shares of a line."""
    k = np.bincount(_KIND[np.frombuffer(line, dtype=np.uint8)], minlength=10)
    words = line.split()
    letters = max(1, k[0] + k[1] + k[2])
    # bytes of other letters come in both cases: only ASCII letters tell
    return float(k[2] / max(1, k[1] + k[2])) * float(k[1] + k[2] > 8), float((k[8] + k[9] + k[7]) / max(1, letters)), 1 - len(set(words)) / max(1, len(words))


def statistics(text: str) -> list[float]:
    """The numbers of a whole text, in the order of :data:`STATISTICS`."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=10) if raw else np.zeros(10, dtype=np.int64)
    share = _share(kinds)
    words = raw.split()
    n = len(words)
    many = max(1, n)
    counts = Counter(words)
    top = counts.most_common(10)
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    faults = [_line_faults(x) for x in lines]
    # short lines say little about themselves
    worst = [max((f[i] for f, x in zip(faults, lines, strict=True) if len(x) >= 40), default=0.0) for i in range(3)]
    bad = [f[0] > 0.6 or f[1] > 0.12 or f[2] > 0.75 for f in faults]
    sizes = [len(x) for x in lines]
    line_counts = Counter(lines)
    packed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    half = words[: n // 2]
    return [
        np.log1p(len(raw)), np.log1p(n), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        sum(map(len, words)) / many, sum(len(w) > 15 for w in words) / many, len(counts) / many, (top[0][1] if top else 0) / many,
        sum(c for _, c in top) / many, same / many, 1 - pairs / max(1, n - 1), np.log1p(len(lines)), len(line_counts) / max(1, len(lines)),
        len(raw) / max(1, len(lines)), sum(s < 40 for s in sizes) / max(1, len(lines)), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        *worst, sum(bad) / max(1, len(lines)), sum(s for s, b in zip(sizes, bad, strict=True) if b) / max(1, sum(sizes)), packed,
        sum(w[:1].isupper() for w in words) / many, sum(c == 1 for c in counts.values()) / many, sum(w[-1:] in b"*#%&$!|+=~^" for w in words) / many,
        sum(len(w) == 1 for w in words) / many, kinds[6] / many, float(half == words[n // 2 : 2 * (n // 2)]) if n > 3 else 0.0,
        sum(c - 1 for c in line_counts.values()) / max(1, len(lines)),
    ]


def table_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[Trees, tuple[np.ndarray, np.ndarray]]:
    """Trees and calibration from labelled rows outside the held-out part.

    Tasks send statistics, not texts: about ``sample`` rows of a few dozen numbers.
    """

    def make():
        def work(ids: list, texts: list, ys: list) -> tuple:
            return ids, ys, table_of(texts).tolist()

        return work

    rows = map_columns(training_rows(docs, labels, label, sample, id_col, text_col), make, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(STATISTICS))
    y = rows["y"].to_numpy()
    return fit_trees(x, y), isotonic(out_of_fold(x, y), y)


def score_quality(docs: DataFrame, model: tuple[Trees, tuple[np.ndarray, np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    trees, knots = model

    def make():
        def work(ids: list, texts: list) -> tuple:
            return ids, calibrated(trees.margin(table_of(texts)), knots)

        return work

    return map_columns(identified(docs, id_col, text_col), make, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, **params) -> DataFrame:
    """Fit on the labels and score: ``doc_id, held_out, score, predicted``."""
    return score_quality(docs, fit_quality(docs, labels, **params)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without what scores below the threshold, all columns as they were.

    The score is computed beside the row, so nothing is shuffled or joined: null
    texts are scored as empty ones, rows that repeat an id each, an empty table
    stays empty and columns of any name pass through.
    """
    trees, knots = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **params)

    @F.pandas_udf("double")
    def score(texts):  # a series of texts gives a series of scores
        return _series(calibrated(trees.margin(table_of([t or "" for t in texts])), knots))

    return docs.filter(score(F.col(text_col)) >= threshold)


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)
