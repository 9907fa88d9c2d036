"""Queries on readers and writers: tables are written to the shared folder in a file shape and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.runtime import shared_dir, table
from listwright.sources import readers

L = "phase2_before_after"


def _place(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/files/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _numbered(spark, sf_dir) -> DataFrame:
    """Listings in the shape of an exported catalogue: a row number first, then text."""
    return table(spark, sf_dir, L).select(F.col("row_id").cast("string").alias("index"), "id", "product_name", "brand", F.col("price").cast("string").alias("sale_price"))


def csv_folder(spark, sf_dir):
    path = _place(spark, "folder")
    readers.write_table(table(spark, sf_dir, "nation").coalesce(1), path, "csv")  # 25 rows; the reader takes one file
    return readers.read_csv_folder(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def catalogue_csv(spark, sf_dir):
    path = _place(spark, "catalogue")
    readers.write_table(_numbered(spark, sf_dir), path, "csv")
    return readers.read_catalogue_csv(spark, path, "index")


def second_catalogue_csv(spark, sf_dir):
    path = _place(spark, "second")
    readers.write_table(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), "p_name", F.format_string('["Goods >> %s"]', "p_type").alias("product_category_tree")), path, "csv")
    return readers.read_catalogue_csv(spark, path)


def food_names(spark, sf_dir):
    path = _place(spark, "food")
    said = lambda lang, text: F.struct(F.lit(lang).alias("lang"), text.alias("text"))
    names = F.when(F.col("p_partkey") % 3 == 0, F.array(said("fr", F.upper("p_name")), said("en", F.col("p_name")))).when(F.col("p_partkey") % 3 == 1, F.array(said("de", F.upper("p_name")), said("main", F.col("p_brand")))).otherwise(F.array(said("de", F.upper("p_name"))))
    readers.write_table(table(spark, sf_dir, "part").select("p_partkey", names.alias("product_name")), path)
    return readers.read_food_parquet(spark, path)


def food_tsv(spark, sf_dir):
    path = _place(spark, "tsv")
    rows = table(spark, sf_dir, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name")).alias("value"))
    broken = spark.createDataFrame([("code\tproduct_name",), ("1\ttoo\tmany",)], "value string")
    broken.coalesce(1).union(rows).write.text(path)
    read = readers.read_tsv(spark, path, "code string, product_name string")
    return read.where("code <> 'code'").select("code", "product_name")


def benchmark_files(spark, sf_dir):
    path = _place(spark, "benchmark")
    part = table(spark, sf_dir, "part")
    left = part.select("p_partkey", F.concat("p_name", F.lit(" crème")).alias("title"))
    right = part.select((F.col("p_partkey") + 1000000).alias("rid"), F.col("p_brand").alias("maker"))
    gold = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("idLeft"), (F.col("p_partkey") + 1000000).alias("idRight"))
    for name, df in (("left", left), ("right", right), ("gold", gold)):
        df.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/{name}")
    a, b, g = readers.read_benchmark(spark, f"{path}/left", f"{path}/right", f"{path}/gold")
    return g.join(a.withColumnRenamed("p_partkey", "l"), "l").join(b.withColumnRenamed("rid", "r"), "r").select("l", "r", "title", "maker")


def offer_files(spark, sf_dir):
    path = _place(spark, "offers")
    pairs = table(spark, sf_dir, "phase5_pairs").select(F.col("i").alias("id_left"), F.col("j").alias("id_right"), F.col("label").cast("int").alias("label"), "is_val")
    pairs.where("not is_val").drop("is_val").write.option("compression", "gzip").json(f"{path}/{readers.offer_file('offers', 80, 'train', 'medium', 0)}.json.gz")
    pairs.where("is_val").drop("is_val").write.option("compression", "gzip").json(f"{path}/{readers.offer_file('offers', 80, 'gs', '', 50)}.json.gz")
    schema = "id_left bigint, id_right bigint, label int"
    read = lambda **k: readers.read_offers(spark, path, schema, **k).withColumn("split", F.lit(k["split"]))
    return read(split="train", size="medium").union(read(split="gs", unseen=50))


def attribute_gold(spark, sf_dir):
    path = _place(spark, "gold")
    pid = lambda k: F.struct(F.array(F.lit(k)).alias("pid"))
    scores = F.create_map(F.lit("Brand"), F.create_map(F.col("p_brand"), pid(0)), F.lit("Type"), F.create_map(F.col("p_type"), pid(1), F.lit("n/a"), pid(0)))
    table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("part").alias("category"), F.col("p_name").alias("input_title"), scores.alias("target_scores")).write.json(path)
    from listwright.operators.extract import attribute_pairs

    return attribute_pairs(readers.read_attribute_gold(spark, path), "id", "target_scores").select("id", "attribute", "value", F.element_at("places", 1).alias("place"))


def word_pairs(spark, sf_dir):
    path = _place(spark, "words")
    table(spark, sf_dir, L).where("brand is not null").select(F.upper("brand").alias("native word"), F.col("brand").alias("english word"), F.lit("test").alias("source")).write.json(path)
    return readers.read_word_pairs(spark, path).groupBy("native", "roman").agg(F.count("*").alias("n"))


def taxonomy(spark, sf_dir):
    path = _place(spark, "taxonomy")
    lines = table(spark, sf_dir, "part").select(F.concat_ws(" > ", F.lit("Goods"), "p_type", "p_name").alias("value")).union(spark.createDataFrame([("# a comment",), ("",), ("Goods",)], "value string"))
    lines.write.text(path)
    return readers.read_taxonomy(spark, path)


def upload(spark, sf_dir):
    path = _place(spark, "upload")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_upload(spark, path)


def filtered_parquet(spark, sf_dir):
    path, out = _place(spark, "countries"), _place(spark, "filtered")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.concat(F.lit("en:"), F.lower("c_mktsegment")).alias("countries"), F.lit("x").alias("rest")).write.option("header", True).option("sep", "\t").csv(path)
    readers.filter_to_parquet(spark, path, out, ["code", "countries"], "countries", "en:build")
    return spark.read.parquet(out)


def sinks(spark, sf_dir):
    df, out = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), None
    for kind in ("parquet", "csv", "json"):
        path = _place(spark, kind)
        readers.write_table(df, path, kind, ["p_brand"])
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True) if kind == "csv" else spark.read.json(path)
        part = back.groupBy("p_brand").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.max(F.col("p_partkey").cast("bigint")).alias("last"), F.min("p_name").alias("first_name"))
        out = part if out is None else out.union(part)
    return out.select("kind", "p_brand", "n", "last", "first_name")


_LIST = "csv_folder catalogue_csv second_catalogue_csv food_names food_tsv benchmark_files offer_files attribute_gold word_pairs taxonomy upload filtered_parquet sinks"
QUERIES = {n: globals()[n] for n in _LIST.split()}
ORACLES = {
    "csv_folder": "SELECT n_nationkey, n_name FROM nation",
    "catalogue_csv": f"SELECT id, product_name, brand, price::VARCHAR AS sale_price FROM {L}",
    "second_catalogue_csv": """SELECT p_partkey::VARCHAR AS pid, p_name, '["Goods >> ' || p_type || '"]' AS product_category_tree FROM part""",
    "food_names": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE upper(p_name) END AS product_name FROM part",
    "food_tsv": """SELECT p_partkey::VARCHAR AS code, '"' || p_name AS product_name FROM part""",
    "benchmark_files": "SELECT p_partkey::VARCHAR AS l, (p_partkey + 1000000)::VARCHAR AS r, p_name || ' crème' AS title, p_brand AS maker FROM part WHERE p_partkey % 2 = 0",
    "offer_files": "SELECT i AS id_left, j AS id_right, label::INT AS label, CASE WHEN is_val THEN 'gs' ELSE 'train' END AS split FROM phase5_pairs WHERE is_val IS NOT NULL",
    "attribute_gold": "SELECT p_partkey::VARCHAR AS id, 'Brand' AS attribute, p_brand AS value, 0 AS place FROM part UNION ALL SELECT p_partkey::VARCHAR, 'Type', p_type, 1 FROM part",
    "word_pairs": f"SELECT upper(brand) AS native, brand AS roman, count(*) AS n FROM {L} WHERE brand IS NOT NULL GROUP BY brand",
    "taxonomy": "SELECT 'Goods > ' || p_type || ' > ' || p_name AS path, 'Goods' AS top_level, 3 AS depth FROM part UNION ALL SELECT 'Goods', 'Goods', 1",
    "upload": "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part",
    "filtered_parquet": "SELECT c_custkey::VARCHAR AS code, 'en:' || lower(c_mktsegment) AS countries FROM customer WHERE lower(c_mktsegment) LIKE 'build%'",
    "sinks": "SELECT kind, p_brand, count(*) AS n, max(p_partkey) AS last, min(p_name) AS first_name FROM part, (VALUES ('parquet'), ('csv'), ('json')) k(kind) GROUP BY kind, p_brand",
}
