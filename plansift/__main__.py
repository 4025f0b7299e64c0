"""Command line: build a database, train on it, and infer for a table of queries.

All inputs and outputs are Parquet tables: texts ``stem, text``; labels
``stem, label``; components ``stem, component``; views ``stem, vector``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plansift.plans.pipeline import infer, make_database, train


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="plansift", description=__doc__)
    p.add_argument("action", choices=["make-database", "train", "infer"])
    p.add_argument("--path", required=True, help="where the database is or will be")
    p.add_argument("--texts", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("--view", action="append", default=[], metavar="NAME=PATH", help="vectors of an encoder; may be given twice")
    p.add_argument("--components")
    p.add_argument("--queries", help="texts to infer for; the database's own where it is missing")
    p.add_argument("--out")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--scope", choices=["eval", "deploy"], default="eval")
    p.add_argument("--pool", choices=["train", "all"], default="train")
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--votes", type=int, default=1)
    p.add_argument("--least-label", type=int, default=20)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("plansift").getOrCreate()
    read = spark.read.parquet
    labels = read(a.labels)
    views = {name: read(path) for name, path in (v.split("=", 1) for v in a.view)}
    database = make_database(read(a.texts), labels, views, a.path, a.rebuild)
    if a.action == "make-database":
        print(f"{database.split.count()} documents, {database.idf.count()} terms, encoders: {', '.join(database.encoders) or 'none'}")
        return
    model = train(database, labels, a.scope, a.least_label)
    model.save(f"{a.path}/model-{a.scope}")
    if a.action == "train":
        print(f"{len(model.models)} labels learnt")
        return
    if not a.components or not a.out:
        p.error("infer needs --components and --out")
    result = infer(database, read(a.queries or a.texts), read(a.components), model, a.k, a.votes, a.pool)
    for name in ("visual", "text", "components", "phases", "scores"):
        getattr(result, name).write.mode("overwrite").parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
