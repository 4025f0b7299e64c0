"""The three entry points: build the index, train, and infer for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.functions.vectors import mean_pool
from plansift.operators.evaluate import overlap, vote
from plansift.operators.features import WORDS, Config, fit_idf, term_counts, weigh
from plansift.operators.models import LabelSetModel, train_labels
from plansift.operators.retrieval import knn, postings_similarity, rank_within, union_of_encoders
from plansift.operators.splits import by_rarest_label
from plansift.sources.readers import write_index


@dataclass
class Database:
    """Pooled vectors by encoder, sparse text rows with their fit, and one split for retrieval and training."""

    split: DataFrame
    texts: DataFrame
    idf: DataFrame
    weights: DataFrame
    encoders: dict[str, DataFrame] = field(default_factory=dict)
    config: Config = WORDS


def make_database(
    texts: DataFrame, labels: DataFrame, views: dict[str, DataFrame], path: str, rebuild: bool = False, config: Config = WORDS, fit_on: str = "train"
) -> Database:
    """Build what inference reads and write it under ``path``; parts that are there are read unless ``rebuild``.

    ``texts`` has ``stem, text``; ``labels`` has ``stem, label``; ``views`` has
    by encoder ``stem, vector``. Inverse document frequencies see the training
    part only, or everything with ``fit_on="all"``.
    """
    split = write_index(by_rarest_label(texts.select("stem").join(labels, "stem", "left"), "stem", "label"), f"{path}/split", rebuild)
    seen = texts if fit_on == "all" else texts.join(split.filter("split = 'train'"), "stem", "left_semi")
    idf = write_index(fit_idf(term_counts(seen, "stem", "text", config), seen.count(), config), f"{path}/idf", rebuild)
    weights = write_index(weigh(term_counts(texts, "stem", "text", config), idf), f"{path}/weights", rebuild)
    encoders = {n: write_index(mean_pool(v, "stem", "vector"), f"{path}/vectors-{n}", rebuild) for n, v in views.items()}
    return Database(split, texts, idf, weights, encoders, config)


def train(database: Database, labels: DataFrame, scope: str = "eval", least: int = 20) -> LabelSetModel:
    """The label-set classifier: on the training part (``eval``) or on everything (``deploy``)."""
    docs = database.texts if scope == "deploy" else database.texts.join(database.split.filter("split = 'train'"), "stem", "left_semi")
    return train_labels(docs, labels, "stem", "text", "label", database.config, least)


@dataclass
class Result:
    """What inference says of each query, in long tables by ``query``."""

    visual: DataFrame
    text: DataFrame
    components: DataFrame
    phases: DataFrame | None
    scores: DataFrame | None


def infer(
    database: Database, queries: DataFrame, components: DataFrame, model: LabelSetModel | None = None, k: int = 5, votes: int = 1, pool: str = "train", truth: bool = True
) -> Result:
    """Neighbours, component candidates and phases for ``queries (stem, text)`` and, if known, their vectors.

    Text drives the proposals and vectors the similar drawings. Candidates come
    from the pool only and a query is never its own neighbour. Queries without
    vectors simply have no visual rows.
    """
    inside = database.split.select("stem") if pool == "all" else database.split.filter(F.col("split") == pool).select("stem")
    lists = []
    for name, vectors in database.encoders.items():
        own = vectors.join(queries.select("stem"), "stem", "left_semi")
        lists.append((name, knn(own, vectors, k, "stem", "vector", allowed=inside)))
    if len(lists) == 2:
        visual = union_of_encoders(lists[0][1], lists[1][1], (lists[0][0], lists[1][0]))
    else:
        visual = lists[0][1] if lists else queries.sparkSession.createDataFrame([], "query string, candidate string, sim double, rank int")
    asked = weigh(term_counts(queries, "stem", "text", database.config), database.idf)
    allowed = database.weights.join(inside.withColumnRenamed("stem", "id"), "id", "left_semi")
    text = rank_within(postings_similarity(asked, allowed).filter("query <> candidate and sim > 0"), "query", "sim", "candidate", k)
    found = vote(text, components, votes, key="stem", value="component")
    phases = model.predict(queries, "stem", "text") if model is not None else None
    scores = overlap(components.join(queries.select("stem"), "stem", "left_semi").select(F.col("stem").alias("query"), F.col("component").alias("value")), found) if truth else None
    return Result(visual, text, found, phases, scores)
