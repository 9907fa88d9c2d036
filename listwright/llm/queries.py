"""Queries of the text and record problems over the whole test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from listwright.llm.bpe import token_ids
from listwright.llm.components import connected_components, member_edges
from listwright.llm.glyphs import canonical_sql, look_alike_pairs
from listwright.llm.leakage import leaked_items
from listwright.llm.linkage import product_groups, product_pairs
from listwright.llm.sentences import sentences
from listwright.llm.survivors import clear_fields
from listwright.operators.graph import link_edges
from listwright.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two listings whose names print alike but differ character by character."""
    return look_alike_pairs(table(spark, sf_dir, "phase2_before_after"), "row_id", "product_name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two listings of one product."""
    return product_pairs(product_groups(table(spark, sf_dir, "phase2_before_after"), "row_id"), "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every listing that an accepted pair or a common cluster links to another one."""
    pairs = table(spark, sf_dir, "phase5_pairs").where("label")
    clusters = table(spark, sf_dir, "phase6_canonical_names")
    edges = link_edges(pairs, "i", "j").union(member_edges(clusters, "member_ids"))
    return connected_components(edges).withColumnRenamed("id", "row_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clear surviving values of every cluster, field by field."""
    return clear_fields(*(table(spark, sf_dir, t) for t in ("phase6_canonical_names", "phase2_before_after", "catalogue_sources")))


#: Folder of the public vocabulary files, and the pre-token pattern that byte_bpe_50k is used with.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", f"{VOCABULARIES}/byte_bpe_50k.json", PRE_TOKENS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the evaluation items that it holds a passage of."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items")
    return leaked_items(documents, items, "doc_id", "text", "item_id", "text", "lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
_FORMS = canonical_sql().replace("SELECT trim(", "SELECT i, trim(")

ORACLES: dict[str, str] = {
    "p1_found": f"""
WITH batch AS (SELECT row_number() OVER () AS i, row_id, product_name AS name FROM (SELECT DISTINCT row_id, product_name FROM phase2_before_after WHERE row_id IS NOT NULL AND product_name IS NOT NULL)),
forms AS ({_FORMS}), named AS (SELECT row_id, name, form FROM batch JOIN forms USING (i))
SELECT DISTINCT x.row_id AS row_id_a, y.row_id AS row_id_b FROM named x JOIN named y ON x.form = y.form AND x.row_id < y.row_id AND x.name <> y.name""",
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT i AS a, j AS b FROM phase5_pairs WHERE label AND i IS NOT NULL AND j IS NOT NULL AND i <> j
  UNION SELECT DISTINCT x.m, y.m FROM (SELECT member_ids[1] AS h, unnest(member_ids) AS m, cluster_id FROM phase6_canonical_names) x
  JOIN (SELECT unnest(member_ids) AS m, cluster_id FROM phase6_canonical_names) y ON x.cluster_id = y.cluster_id AND x.m <> y.m),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, low) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.id WHERE r.low < s.b)
SELECT id AS row_id, min(low) AS group_id FROM r GROUP BY id""",
}
