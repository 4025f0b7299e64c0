"""Readers with explicit schemas for the engine's inputs, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansift.session import settle

# Columns of the business tables as they are exported.
ITEMS = ("Item", "Item description", "Product family description", "Net weight")
EDGES = ("Parent part", "Component", "Parent part description", "Component description")
PHASES = ("Item", "Work phase description", "Work center no", "Machine setup time", "Machine work time", "Labor setup time", "Labor work time")
CENTERS = ("Work Center No", "Production Line")

_BOX = T.ArrayType(T.DoubleType())
_CELL = T.StructType().add("text", "string").add("bbox_pt", _BOX).add("page", "integer").add("is_bom", "boolean").add("is_zone", "boolean")
_BLOCK = T.StructType().add("text", "string").add("bbox", _BOX).add("words", T.ArrayType(T.StringType())).add("page", "integer")
_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("pos", "qty", "description", "specification", "width", "length", "item_no", "drawing_no", "weight_kg")])
_PAGE = (
    T.StructType().add("page_idx", "integer").add("route", "string").add("wc", "integer").add("cells", T.ArrayType(_CELL)).add("bom_rows", T.ArrayType(_ROW))
    .add("bom_head", T.ArrayType(T.StringType())).add("body_blocks", T.ArrayType(_BLOCK))
)
RAW_PAGES = T.StructType().add("stem", "string").add("vendor", "string").add("n_pages", "integer").add("pages", T.ArrayType(_PAGE)).add("_corrupt_record", "string")


def business_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A table separated by semicolons in Latin-1, all strings, trimmed; columns it lacks are null."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1", inferSchema=False)
    held = {c.strip(): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{held[c]}`")) if c in held else F.lit(None).cast("string")).alias(c) for c in columns])


def decimal_comma(column):
    """A number written with a decimal comma; null if it is none."""
    return F.replace(F.trim(column), F.lit(","), F.lit(".")).try_cast("double")


def net_weights(items: DataFrame) -> DataFrame:
    """``item, weight`` where the weight is above 0."""
    return items.select(F.col("Item").alias("item"), decimal_comma(F.col("Net weight")).alias("weight")).filter("weight > 0")


def with_row_numbers(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Row numbers from 1 by an order of the data's own, dealt within ranges: no task sorts all rows."""
    from pyspark.sql import Window

    # written, so that both uses below see the same ranges
    ranged = settle(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id()), "ranges")
    ranged = ranged.withColumn("__no", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__no") + F.col("__before")).drop("__part", "__no", "__before")


def nested_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row per document file; broken files are left out. The stem is the folder's name where the file has none."""
    df = spark.read.schema(RAW_PAGES).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    out = df.select("*", folder.alias("__folder")).filter(F.col("_corrupt_record").isNull())
    out = out.withColumn("stem", F.coalesce("stem", F.url_decode("__folder"))).drop("__folder", "_corrupt_record")
    return out if limit is None else out.orderBy("stem").limit(limit)


def broken_pages(spark: SparkSession, path: str) -> DataFrame:
    """The files that could not be read, for a quarantine."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = F.from_json("value", RAW_PAGES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"), parsed.alias("p")).filter("p._corrupt_record is not null").select("file", "content")


def cells(pages: DataFrame) -> DataFrame:
    """Cells of nested pages in long form."""
    p = pages.select("stem", F.explode("pages").alias("p"))
    c = p.select("stem", F.col("p.page_idx").alias("page"), F.posexplode("p.cells").alias("no", "c"))
    return c.select("stem", "page", "no", "c.text", "c.is_bom", "c.is_zone", *[F.get("c.bbox_pt", k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def blocks(pages: DataFrame) -> DataFrame:
    """Body blocks of nested pages in long form."""
    p = pages.select("stem", F.explode("pages").alias("p"))
    return p.select("stem", F.col("p.page_idx").alias("page"), F.posexplode("p.body_blocks").alias("no", "b")).select("stem", "page", "no", "b.text")


def route(pages: DataFrame, counts: DataFrame, most: int = 50) -> DataFrame:
    """Documents by their cached word count, or by counting now where the cache lacks them: ``ocr`` up to ``most`` words."""
    words = F.aggregate(F.flatten(F.transform("pages", lambda p: p["body_blocks"])), F.lit(0), lambda s, b: s + F.coalesce(F.size(b["words"]), F.lit(0)))
    joined = pages.join(counts.select("stem", F.col("words").try_cast("int").alias("cached")), "stem", "left")
    n = F.coalesce("cached", words)
    return joined.select("stem", n.alias("words"), F.when(n <= most, "ocr").otherwise("vector").alias("route"))


def judgments(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """``query, letter`` of a file of hit letters; queries get the prefix of their folder."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    letters = F.regexp_extract_all(F.upper(F.coalesce("hit_letters", F.lit(""))), F.lit("[A-Z]"), 0)
    return raw.select(F.concat(F.lit(prefix + ":"), F.trim("query_id")).alias("query"), F.explode(F.array_distinct(letters)).alias("letter"))


def separated(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table separated by tabs with a header."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def write_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_index(df: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """Write an index unless it is there; read it."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if rebuild or not there:
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """Documents as JSON, one to a line, in folders by a column if one is named."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """``stem, text, page_sizes`` of folders that hold a text, its metadata and maybe blocks; folders without metadata are left out."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
    text = spark.read.option("pathGlobFilter", "text.txt").option("recursiveFileLookup", True).text(path, wholetext=True).select(folder.alias("folder"), F.col("value").alias("text"))
    meta = (
        spark.read.schema("stem string, page_sizes array<array<double>>").option("multiLine", True).option("pathGlobFilter", "meta.json").option("recursiveFileLookup", True).json(path)
        .select(folder.alias("folder"), "stem", "page_sizes")
    )
    return text.join(meta.filter("stem is not null"), "folder").select("stem", "text", "page_sizes")


def cache_key(name):
    """The name under which the text of a file is kept: the first half of its SHA-1."""
    return F.substring(F.sha1(name), 1, 16)


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """``query, candidate, rank, sim`` of ranked runs: objects of a query and its candidates in order, one to a line, with their scores."""
    raw = spark.read.schema("query string, candidates array<string>, scores array<double>").json(path)
    each = raw.select("query", "scores", F.posexplode("candidates").alias("pos", "candidate"))
    return each.select("query", "candidate", (F.col("pos") + 1).alias("rank"), F.get("scores", F.col("pos")).alias("sim"))


def judgment_key(spark: SparkSession, path: str) -> DataFrame:
    """``query, letter, stem`` of the key of a judged set: for each query the files behind its letters."""
    raw = spark.read.schema("query string, letters map<string,string>").json(path)
    return raw.select("query", F.explode("letters").alias("letter", "stem"))


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """``stem, part`` of a split kept as lists of stems under ``train``, ``val`` and ``test``."""
    raw = spark.read.schema("train array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    lists = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("stems")) for p in ("train", "val", "test")])
    return raw.select(F.inline(lists)).select(F.explode("stems").alias("stem"), "part")


def vector_index(spark: SparkSession, path: str) -> DataFrame:
    """``stem, view, vector`` of an index kept as vectors and a manifest by row; vectors are brought to length 1."""
    vectors, manifest = spark.read.parquet(f"{path}/vectors"), spark.read.schema("row long, stem string, view int").json(f"{path}/manifest")
    v = F.transform("vector", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return manifest.join(vectors, "row").select("stem", "view", F.transform(v, lambda x: x / F.greatest(length, F.lit(1e-12))).alias("vector"))
