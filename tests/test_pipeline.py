from __future__ import annotations

from pyspark.sql import functions as F

from plansift.operators.features import Config
from plansift.plans.pipeline import infer, make_database, train


def test_build_train_infer(spark, small, tmp_path):
    d = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    texts = d.select(F.col("doc_id").cast("string").alias("stem"), "text")
    labels = d.select(F.col("doc_id").cast("string").alias("stem"), F.col("lang").alias("label"))
    v = spark.read.parquet(f"{small}/embeddings.parquet").limit(100)
    views = v.select((F.col("vec_id") % 40).cast("string").alias("stem"), F.col("embedding").alias("vector"))
    half = views.withColumn("vector", F.slice("vector", 1, 32))
    db = make_database(texts, labels, {"mean": views, "half": half}, str(tmp_path / "db"), config=Config(high=1))
    model = train(db, labels, least=10)
    parts = d.select(F.col("doc_id").cast("string").alias("stem"), F.col("source").alias("component"))
    r = infer(db, texts.filter("stem in ('1', '2', 'none')"), parts, model, k=3)
    assert r.text.filter("query = candidate").count() == 0
    held = {x["stem"] for x in db.split.filter("split = 'train'").collect()}
    assert {x["candidate"] for x in r.text.collect()} | {x["candidate"] for x in r.visual.collect()} <= held
    assert r.visual.groupBy("query").count().agg(F.max("count")).first()[0] <= 6
    assert r.phases.filter("probability <= 0.5").count() == 0
    assert r.components.count() > 0 and r.scores.count() == 2
    again = make_database(texts.limit(1), labels, {"mean": views}, str(tmp_path / "db"), config=Config(high=1))
    assert again.split.count() == 120


def test_command_line(spark, small, tmp_path):
    from plansift.__main__ import main

    d = spark.read.parquet(f"{small}/documents.parquet").limit(100)
    stem = F.col("doc_id").cast("string").alias("stem")
    d.select(stem, "text").write.parquet(str(tmp_path / "texts"))
    d.select(stem, F.col("lang").alias("label")).write.parquet(str(tmp_path / "labels"))
    d.select(stem, F.col("source").alias("component")).write.parquet(str(tmp_path / "components"))
    common = ["--path", str(tmp_path / "db"), "--texts", str(tmp_path / "texts"), "--labels", str(tmp_path / "labels"), "--least-label", "10"]
    main(["make-database", *common])
    main(["infer", *common, "--components", str(tmp_path / "components"), "--out", str(tmp_path / "out"), "--k", "2"])
    assert spark.read.parquet(str(tmp_path / "out/text")).groupBy("query").count().agg(F.max("count")).first()[0] <= 2
    assert spark.read.parquet(str(tmp_path / "out/components")).count() > 0
