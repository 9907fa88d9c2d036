"""Comparison of matcher configurations on labelled pairs, their errors, retrieval with rewritten queries, and stage costs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.mapping import prf_columns
from listwright.operators.matching import PENALTIES, WEIGHTS, hybrid_score, threshold_curve
from listwright.operators.vectors import Encoder, encoded, known_ranks, retrieval_shares, with_encoded
from listwright.runtime import stored

#: Configurations of the hybrid matcher: (weights of the dense cosine, brand penalties, code penalties, vetoes).
CONFIGURATIONS = {
    "char only": ((0.0,), (0.0,), (0.0,), False),
    "dense only": ((1.0,), (0.0,), (0.0,), False),
    "hybrid": (WEIGHTS, (0.0,), (0.0,), False),
    "hybrid with rules, no codes": (WEIGHTS, PENALTIES, (0.0,), True),
    "hybrid with all rules": (WEIGHTS, PENALTIES, PENALTIES, True),
}
CONFLICTS = ["qty_conflict", "pack_conflict", "brand_conflict", "code_conflict"]


def cells_of(configurations: dict = CONFIGURATIONS) -> list[tuple[str, float, float, float, bool]]:
    """Every (configuration, weight, brand penalty, code penalty, vetoes) of a set of grids."""
    return [(name, w, b, c, vetoes) for name, (ws, bs, cs, vetoes) in configurations.items() for w in ws for b in bs for c in cs]


def configuration_report(pairs: DataFrame, configurations: dict = CONFIGURATIONS) -> DataFrame:
    """One row per configuration: the cell and threshold tuned on the rows of ``is_val``, and the quality on the other rows.

    ``pairs`` holds the cosines, conflicts, ``label`` and ``is_val``; rows without either are left out. All grids run in
    one pass, reduced to distinct scores map-side; of equal F1 the first cell and the larger threshold win.
    """
    cell = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("config", "w", "brand_penalty", "code_penalty", "vetoes"), c, strict=True)]) for c in cells_of(configurations)])
    known = pairs.where("label is not null and is_val is not null").select("sbert", "char_cos", *CONFLICTS, "label", "is_val", F.explode(cell).alias("g")).select("*", "g.*")
    score = lambda vetoes: hybrid_score(F.col("w"), F.col("brand_penalty"), F.col("code_penalty"), vetoes)
    by = ["config", "w", "brand_penalty", "code_penalty"]
    scored = known.select(*by, F.when(F.col("vetoes"), score(True)).otherwise(score(False)).alias("score"), "label", "is_val")
    curve = threshold_curve(scored.where("is_val"), by)
    best = curve.groupBy("config").agg(F.min(F.struct(-F.col("f1"), "w", "brand_penalty", "code_penalty", -F.col("score"))).alias("b"))
    tuned = best.select("config", F.col("b.w").alias("w"), F.col("b.brand_penalty").alias("brand_penalty"), F.col("b.code_penalty").alias("code_penalty"), (-F.col("b.col5")).alias("threshold"), (-F.col("b.col1")).alias("val_f1"))
    hit = F.col("score") >= F.col("threshold")
    judged = scored.where("not is_val").join(F.broadcast(tuned), by)  # a row per configuration
    counts = judged.groupBy(*tuned.columns).agg(F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & F.col("label")).alias("fn"))
    return prf_columns(counts)


def error_pool(scored: DataFrame, dataset: str, threshold: float, most: int = 40) -> DataFrame:
    """``dataset, i, j, gold, predicted, score, rules``: per data set the ``most`` wrong decisions furthest from the threshold, ties by ids."""
    wrong = scored.where("label is not null").withColumn("predicted", F.col("score") >= threshold).where("predicted <> label")
    rules = F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in CONFLICTS])
    w = Window.partitionBy(dataset).orderBy(F.desc(F.round(F.abs(F.col("score") - threshold), 6)), "i", "j")
    kept = wrong.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.select(dataset, "i", "j", F.col("label").alias("gold"), "predicted", "score", rules.alias("rules"))


def rewritten_retrieval(corpus: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10) -> DataFrame:
    """``form, queries, recall_1, recall_5, mrr``: how well rewritten names find their original.

    ``corpus(id, text)``; ``queries(form, id, text)`` with the id of the original, a stated set of queries per form.
    Null texts find nothing and count as missed.
    """
    distinct = queries.select("id", "text").where("text is not null").distinct().join(corpus.select("id", F.col("text").alias("known")), "id")
    asked = stored(with_encoded(with_encoded(distinct, "text", encoder, "embedding"), "known", encoder, "known_embedding"), "asked")
    same = asked.groupBy("id", "embedding", "known_embedding").agg(F.xxhash64("id", F.min("text")).alias("query"), F.collect_list("text").alias("texts"))  # forms often say the same
    same = stored(same, "same")
    base = encoded(corpus, "id", "text", encoder, "embedding")
    ranks = known_ranks(same.select("query", "id", "embedding", "known_embedding"), base, "id", "embedding", "known_embedding", k)
    found = ranks.join(same.select("query", "id", F.explode("texts").alias("text")), "query").select("id", "text", "rank")
    hit = queries.join(found, ["id", "text"], "left").groupBy("form", "id").agg(F.min("rank").alias("first"))
    return hit.groupBy("form").agg(*retrieval_shares(F.col("first")))


def spelling_variant(text: Column, table: Column, seed: int = 42) -> Column:
    """Each token replaced by one of its spellings in a ``map<string,array<string>>``, chosen by a hash of token and text; others stay."""
    pick = lambda t, vs: F.element_at(vs, (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), t, F.lit("|"), text)), 1, 8), 16, 10).cast("bigint") % F.size(vs) + 1).cast("int"))
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.when(F.size(F.try_element_at(table, t)) > 0, pick(t, F.try_element_at(table, t))).otherwise(t)), " ")


def stage_costs(stages: dict[str, Callable[[], DataFrame]]) -> list[dict]:
    """Wall-clock seconds and rows a second of named stages, each computed once in full."""
    out = []
    for name, stage in stages.items():
        begun = time.perf_counter()
        rows = stage().count()
        took = time.perf_counter() - begun
        out.append({"stage": name, "rows": rows, "seconds": round(took, 3), "rows_per_second": round(rows / took, 1)})
    return out
