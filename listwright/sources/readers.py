"""Readers and writers of the file shapes that product tables come in."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_SCORES = "map<string,map<string,struct<pid:array<int>>>>"


def _exists(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(f.getPath()) for f in found or [])


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The first CSV file of a folder in name order, all columns text; FileNotFoundError without one."""
    files = _exists(spark, f"{folder}/*.csv")
    if not files:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return spark.read.csv(files[0], header=True, multiLine=True, escape='"')


def read_catalogue_csv(spark: SparkSession, path: str, index_column: str | None = None) -> DataFrame:
    """A CSV with a header, all columns text, optionally without a column of row numbers."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.drop(index_column) if index_column else df


def pick_name(names, languages: tuple[str, ...] = ("en", "main")):
    """Of an ``array<struct<lang,text>>`` the text in the first listed language that is there, else the first text."""
    def speaks(lang: str):
        return lambda x: x["lang"] == F.lit(lang)

    by = [F.get(F.filter(names, speaks(lang)), F.lit(0))["text"] for lang in languages]
    return F.coalesce(*by, F.get(names, F.lit(0))["text"])


def read_food_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose ``product_name`` may be a list of names by language; the name becomes plain text."""
    df = spark.read.parquet(path)
    kind = df.schema["product_name"].dataType.simpleString()
    return df.withColumn("product_name", pick_name(F.col("product_name"))) if kind.startswith("array") else df


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated file without quoting; malformed lines are dropped. With a schema files have no header."""
    read = spark.read.option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED")
    return read.schema(schema).csv(path) if schema else read.option("header", True).csv(path)


def read_benchmark(spark: SparkSession, left: str, right: str, gold: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables and their gold pairs ``l, r`` (the first two columns) from CSV files."""
    read = lambda p: spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(p)
    pairs = read(gold)
    return read(left), read(right), pairs.select(F.col(pairs.columns[0]).alias("l"), F.col(pairs.columns[1]).alias("r"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, gzipped or not; with a schema no inference pass is needed."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def offer_file(prefix: str, corner_cases: int, split: str, size: str, unseen: int) -> str:
    """The name of one file of an offer benchmark; ``corner_cases`` and ``unseen`` are percentages, the test split has no size."""
    stem = f"{prefix}{corner_cases}cc{100 - corner_cases}rnd{unseen:03d}un_{split}"
    return stem if split == "gs" else f"{stem}_{size}"


def read_offers(spark: SparkSession, folder: str, schema: str | None = None, kind: str = "pair", corner_cases: int = 80, split: str = "gs", size: str = "large", unseen: int = 0, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Gzipped JSON lines of an offer benchmark, chosen by kind (pair or multi), corner cases, split (train, valid or gs),
    size and share of unseen products. ``prefixes`` are the file names of the kinds, ``offers`` and ``offersmulti`` unless
    given. FileNotFoundError without such a file.
    """
    prefix = (prefixes or {"pair": "offers", "multi": "offersmulti"})[kind]
    files = _exists(spark, f"{folder}/{offer_file(prefix, corner_cases, split, size, unseen)}.json*")
    if not files:
        raise FileNotFoundError(f"no such choice of offers in {folder}")
    return (spark.read.schema(schema) if schema else spark.read).json(files)


def read_word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``native, roman`` of JSON lines with a word in its own script and in Latin letters; incomplete lines are dropped."""
    lines = read_json_lines(spark, path, "`native word` string, `english word` string")
    return lines.select(F.col("native word").alias("native"), F.col("english word").alias("roman")).where("native is not null and roman is not null")


def read_attribute_gold(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with nested gold attribute values."""
    return read_json_lines(spark, path, f"id string, category string, input_title string, target_scores {TARGET_SCORES}")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``path, top_level, depth`` of a text file with one `` > `` path a line; comments and blank lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> '' and not startswith(path, '#')")
    parts = F.split("path", " > ")
    return lines.select("path", F.get(parts, F.lit(0)).alias("top_level"), F.size(parts).alias("depth"))


def sniff_separator(sample: str) -> str:
    """The separator of a CSV sample: comma, semicolon, tab or pipe; comma where it can't be told."""
    try:
        return csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        return ","


def read_upload(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV of unknown separator, malformed lines dropped; the row limit is the feature of a preview."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    df = spark.read.option("header", True).option("sep", sniff_separator(head)).option("mode", "DROPMALFORMED").csv(path)
    return df.limit(rows) if rows else df


def filter_to_parquet(spark: SparkSession, tsv: str, out: str, columns: list[str], where: str, contains: str) -> None:
    """A filtered projection of a large tab-separated file, written as parquet in one pass."""
    read_tsv(spark, tsv).select(*columns).where(F.contains(F.col(where), F.lit(contains))).write.mode("overwrite").parquet(out)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partitions: list[str] | None = None) -> None:
    """Parquet, CSV with a header, or JSON lines."""
    out = df.write.mode("overwrite")
    out = out.partitionBy(*partitions) if partitions else out
    exact = out.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    {"parquet": out.parquet, "json": out.json, "csv": exact.csv}[kind](path)
