"""Toxicity scores by gradient-boosted trees over dense features.

The features are densities of words of a lexicon, how near they stand to words
of the second person, shares of capitals and punctuation and of obfuscated
words. The lexicon has a small fixed part; the larger part is learnt: words and
word beginnings that stand in toxic training documents far more often than in
others, counted over the same labelled training documents as the trees are
fitted on, a bounded sample (:data:`plansift.llm.labelled.SAMPLE`). Scores are
calibrated by isotonic regression on margins out of fold; the lexicon is chosen
once, on all folds. Two hundredths of a score are the raw probability.

A training document's own counts are taken from the evidence of its words
before its features are made, so that the trees learn to trust the lexicon as
far as it carries over to other documents.

Defined cases: null counts as the empty text, which is scored like any other;
without labels of both classes every score is the class's share; rows that
repeat an id are scored each; an empty table gives no rows; extra columns are
never read.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.boosting import Trees, calibrated, fit_trees, isotonic, out_of_fold
from plansift.llm.labelled import SAMPLE, held_out, training_rows
from plansift.llm.rows import identified, map_columns
from plansift.session import settle

TOXIC_FROM = 0.3
#: Entries of the learnt lexicon at most; those with most evidence stay.
LEXICON = 4096
#: Lengths of word beginnings that count beside whole words.
STEMS = (4, 5, 6)

# Words of insult and words of the second person.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass fool loser losers pathetic worthless scum trash garbage filth filthy "
    "disgusting clown ugly pig vermin parasite coward bastard bitch asshole jerk freak retard retarded hate kill die scumbag "
    "idiota estupido imbecil basura asco tonto inutil idiot dumm dummkopf arschloch abschaum widerlich wertlos ekelhaft "
    "imbecile stupide ordure dechet minable degoutant nul crétin".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti toi ton ta tes vous votre vos usted ustedes tuyo vosotros".split())
#: Characters that stand for letters in obfuscated words.
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"(?<![\w@$!])(?=[^\s]{0,40}[0-9@$!])(?=[^\s]{0,40}[A-Za-z])[A-Za-z0-9@$!]{3,40}(?![\w@$!])")
SPACED = re.compile(r"(?<!\S)(?:[A-Za-z][ .*_-]){3,40}[A-Za-z](?!\S)")
FEATURES = (
    "log_words", "insult_density", "insults", "best", "second", "third", "evidence_sum", "evidence_density", "strong_density", "strong", "strong_kinds",
    "near_second", "second_density", "upper", "upper_words", "loud", "marks", "masked", "spaced", "unmasked_insults", "stars", "mean_word",
)


def _weight(p: float, q: float, share: float) -> float:
    """Evidence of an entry seen in p toxic and q other documents: log-odds against the share, with the doubt of few."""
    return log((p + 0.3) / (q + 0.3)) - share if p > 0 else 0.0


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> tuple[dict[str, tuple[int, int]], float]:
    """Counts of toxic and other documents by word and beginning, for the entries with most evidence; and the log-odds of toxic.

    Documents are counted once per entry, on the executors; only the entries
    that stay come to the driver.
    """

    def make():
        def work(ids: list, texts: list, ys: list) -> tuple:
            words, label = [], []
            for t, y in zip(texts, ys, strict=True):
                own = {e for w in set(WORD.findall(t.lower())) for e in entries(w)}
                words += own
                label += [y] * len(own)
            return words, label

        return work

    counted = map_columns(rows.select("doc_id", "text", "y"), make, "word string, y int").groupBy("word").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")
    )
    total = rows.agg(F.sum("y"), F.count(F.lit(1))).first()
    pos, neg = int(total[0] or 0), int((total[1] or 0) - (total[0] or 0))
    share = log((pos + 1) / (neg + 1))
    odds = F.log((F.col("p") + 0.3) / (F.col("q") + 0.3)) - share
    top = (
        counted.filter("p >= 2").withColumn("odds", odds).filter("odds > 2.0")
        .orderBy((F.col("odds") * F.sqrt("p")).desc(), "word").limit(size).collect()
    )
    return {r["word"]: (int(r["p"]), int(r["q"])) for r in top}, share


def entries(word: str) -> tuple[str, ...]:
    """What a word is looked up as: itself and its beginnings, marked with a dash."""
    n = len(word)
    return (word, *[word[:k] + "-" for k in STEMS if n > k])


def features(text: str, lexicon: dict[str, tuple[int, int]], share: float, own: int | None = None) -> list[float]:
    """The features of a whole text; ``own`` is its label if its counts are within the lexicon's."""
    raw = WORD.findall(text)
    words = [w.lower() for w in raw]
    n = max(1, len(words))
    weight: dict[str, float] = {}
    for w in set(words):
        best = 0.0
        for e in entries(w):
            hit = lexicon.get(e)
            if hit:
                p, q = hit
                if own is not None:
                    p, q = (p - 1, q) if own else (p, q - 1)
                best = max(best, _weight(p, max(q, 0), share))
        if best > 0:
            weight[w] = best
    insult = [k for k, w in enumerate(words) if w in INSULTS]
    hits = [k for k, w in enumerate(words) if w in weight] if weight else []
    total = sum(weight[words[k]] for k in hits)
    strong = [k for k in hits if weight[words[k]] > 3.0]
    top = (sorted(weight.values(), reverse=True) + [0.0, 0.0, 0.0])[:3]
    second = [k for k, w in enumerate(words) if w in SECOND]
    near = 0
    if second:
        at = np.array(second)
        for k in {*insult, *strong}:
            near += int(np.abs(at - k).min() <= 5)
    # capitals and marks: of the text itself
    letters = max(1, sum(map(len, raw)))
    upper = sum(len(w) for w in raw if w.isupper() and len(w) > 1)
    masked = MASKED.findall(text) if any(c in text for c in "013457@$!") else []
    plain = sum(w.lower().translate(UNMASK) in INSULTS for w in masked)
    size = max(1, len(text))
    return [
        log(n + 1), len(insult) / n, len(insult), *top, total, total / n, len(strong) / n, len(strong), len({words[k] for k in strong}),
        near, len(second) / n, upper / letters, sum(w.isupper() and len(w) > 1 for w in raw) / n, (text.count("!") + text.count("?")) / size,
        (text.count(".") + text.count(",")) / size, len(masked) / n, len(SPACED.findall(text)) / n, plain, text.count("*") / size, letters / n,
    ]


Model = tuple[Trees, tuple[np.ndarray, np.ndarray], dict[str, tuple[int, int]], float]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon, trees and calibration from labelled rows outside the held-out part."""
    # read three times below; a bounded number of rows, so one pass over the documents is enough
    rows = settle(training_rows(docs, labels, label, sample, id_col, text_col), "labelled")
    lexicon, share = learn_lexicon(rows)

    def make():
        def work(ids: list, texts: list, ys: list) -> tuple:
            return ids, ys, [features(t, lexicon, share, y) for t, y in zip(texts, ys, strict=True)]

        return work

    got = map_columns(rows, make, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    y = got["y"].to_numpy()
    return fit_trees(x, y), isotonic(out_of_fold(x, y), y), lexicon, share


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    trees, knots, lexicon, share = model

    def make():
        def work(ids: list, texts: list) -> tuple:
            x = np.array([features(t, lexicon, share) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            return ids, calibrated(trees.margin(x), knots)

        return work

    return map_columns(identified(docs, id_col, text_col), make, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC_FROM, **params) -> DataFrame:
    """Fit on the labels and score: ``doc_id, held_out, score, predicted``."""
    return score_toxicity(docs, fit_toxicity(docs, labels, **params)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
