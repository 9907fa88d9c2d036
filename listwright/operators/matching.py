"""Blocking, pair features, rule-aware scores, tuning on labelled pairs and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.operators.mapping import prf_columns
from listwright.operators.vectors import dot

# Tolerances of conflicts and the grid of the tuner.
QUANTITY_TOLERANCE = 0.02
MRP_TOLERANCE = 0.05
WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
PENALTIES = (0.0, 0.1, 0.2)
BANDS = ((0.95, 1.01), (0.85, 0.95), (0.75, 0.85), (0.65, 0.75), (0.0, 0.65))


def block(forward: DataFrame, backward: DataFrame | None = None, brands: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Distinct candidate pairs ``i, j`` of two tables: nearest in either direction and of equal brand.

    ``forward`` and ``backward`` are ``(query, id)`` of left to right and right to left; ``brands`` are ``(id, brand)`` of
    either side, null brands meet nobody. Use brands only where no brand holds a large share of the rows.
    """
    out = forward.select(F.col("query").alias("i"), F.col("id").alias("j"))
    if backward is not None:
        out = out.union(backward.select(F.col("id"), F.col("query")))
    if brands is not None:
        a, b = brands
        out = out.union(a.select(F.col("id").alias("i"), "brand").join(b.select(F.col("id").alias("j"), "brand"), "brand").select("i", "j"))
    return out.distinct()


def self_block(ranked: DataFrame) -> DataFrame:
    """Distinct unordered pairs ``i < j`` of nearest neighbours within one table."""
    return ranked.select(F.least("query", "id").alias("i"), F.greatest("query", "id").alias("j")).where("i < j").distinct()


def blocking_quality(candidates: DataFrame, gold: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``candidates, reduction, completeness``: share of pairs saved, and of ``gold(i, j)`` pairs kept."""
    kept = gold.select("i", "j").distinct().join(candidates.select("i", "j").distinct().withColumn("kept", F.lit(1)), ["i", "j"], "left").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("completeness"))
    sizes = candidates.agg(F.count("*").alias("candidates")).crossJoin(left.agg(F.count("*").alias("a"))).crossJoin(right.agg(F.count("*").alias("b"))).crossJoin(kept)  # single rows
    whole = F.nullif(F.col("a") * F.col("b"), F.lit(0))
    return sizes.select("candidates", F.round(1 - F.col("candidates") / whole, 4).alias("reduction"), F.round("completeness", 4).alias("completeness"))


def codes_conflict(a: Column, b: Column) -> Column:
    """Both sides have model codes and no code of one starts with a code of the other; false where either is null."""
    akin = F.exists(a, lambda x: F.exists(b, lambda y: x.startswith(y) | y.startswith(x)))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & ~akin, F.lit(False))


def pair_features(pairs: DataFrame, records: DataFrame, mrp: bool = True, codes: bool = True) -> DataFrame:
    """``i, j`` and, for each pair, the dense cosine and the conflicts of quantity, pack, brand, code and MRP.

    ``records`` holds ``id, embedding, brand, qty_value, qty_unit, pack_count, codes, mrp``. A missing value conflicts with
    nothing; the quantity difference is relative to the left value, that of MRP to the larger one.
    """
    cols = ["embedding", "brand", "qty_value", "qty_unit", "pack_count", *(["codes"] if codes else []), *(["mrp"] if mrp else [])]
    side = lambda key, p: records.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    met = pairs.select("i", "j").join(side("i", "a"), "i").join(side("j", "b"), "j")
    no = lambda c: F.coalesce(c, F.lit(False))
    qty = (F.col("a_qty_unit") == F.col("b_qty_unit")) & (F.abs(F.col("a_qty_value") - F.col("b_qty_value")) > QUANTITY_TOLERANCE * F.col("a_qty_value"))
    top = F.when(F.col("a_mrp").isNotNull() & F.col("b_mrp").isNotNull(), F.greatest("a_mrp", "b_mrp")) if mrp else None
    return met.select(
        "i",
        "j",
        F.round(dot(F.col("a_embedding"), F.col("b_embedding")), 6).alias("sbert"),
        no(qty).alias("qty_conflict"),
        no(F.col("a_pack_count") != F.col("b_pack_count")).alias("pack_conflict"),
        no(F.lower(F.trim("a_brand")) != F.lower(F.trim("b_brand"))).alias("brand_conflict"),
        (codes_conflict(F.col("a_codes"), F.col("b_codes")) if codes else F.lit(False)).alias("code_conflict"),
        (no(F.abs(F.col("a_mrp") - F.col("b_mrp")) / F.nullif(top, F.lit(0.0)) > MRP_TOLERANCE) if mrp else F.lit(False)).alias("mrp_conflict"),
    )


def hybrid_score(weight: Column, brand_penalty: Column, code_penalty: Column, vetoes: bool = True) -> Column:
    """Weighted cosines less penalties, then 0 where quantity or pack conflict. Missing cosines count as 0."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    s = weight * c("sbert") + (1 - weight) * c("char_cos") - F.when(flag("brand_conflict"), brand_penalty).otherwise(0.0) - F.when(flag("code_conflict"), code_penalty).otherwise(0.0)
    return F.round(F.when(flag("qty_conflict") | flag("pack_conflict"), 0.0).otherwise(s) if vetoes else s, 6)


def catalogue_score(weight: float, rules: bool = True, mrp: bool = True) -> Column:
    """Weighted cosines, 0 where quantity, pack, brand or (optionally) MRP conflict."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    s = weight * c("sbert") + (1 - weight) * c("char_cos")
    veto = flag("qty_conflict") | flag("pack_conflict") | flag("brand_conflict") | (flag("mrp_conflict") if mrp else F.lit(False))
    return F.round(F.when(veto, 0.0).otherwise(s) if rules else s, 6)


def threshold_curve(scored: DataFrame, group: list[str], positives: DataFrame | None = None) -> DataFrame:
    """``group, score, tp, predicted, f1`` at every distinct score as threshold (inclusive), from ``score, label`` rows.

    Equal scores are counted together first, so the running sums go over distinct scores only. False negatives are
    counted from ``positives(n)`` where blocking lost some, else from the labels.
    """
    cuts = scored.groupBy(*group, "score").agg(F.count_if("label").alias("t"), F.count("*").alias("c"))
    w = Window.partitionBy(*group).orderBy(F.desc("score"))
    run = cuts.select(*group, "score", F.sum("t").over(w).alias("tp"), F.sum("c").over(w).alias("predicted"))
    if positives is None:
        total = scored.groupBy(*group).agg(F.count_if("label").alias("n"))
        run = run.join(total, group) if group else run.crossJoin(total)
    else:
        run = run.crossJoin(positives.select("n"))  # one row
    return run.select(*group, "score", "tp", "predicted", F.round(F.coalesce(2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("f1"))


def tune(features: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """The best cell ``w, brand_penalty, code_penalty, threshold, f1`` of the grid; the first in grid order wins ties.

    The grid's 45 cells are exploded per pair and reduced to distinct scores map-side.
    """
    cells = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(b).alias("brand_penalty"), F.lit(m).alias("code_penalty")) for w in WEIGHTS for b in PENALTIES for m in PENALTIES])
    grid = features.select("sbert", "char_cos", "qty_conflict", "pack_conflict", "brand_conflict", "code_conflict", "label", F.explode(cells).alias("g")).select("*", "g.*")
    scored = grid.select("w", "brand_penalty", "code_penalty", hybrid_score(F.col("w"), F.col("brand_penalty"), F.col("code_penalty")).alias("score"), "label")
    curve = threshold_curve(scored, ["w", "brand_penalty", "code_penalty"], positives)
    best = F.min(F.struct(-F.col("f1"), F.col("w"), F.col("brand_penalty"), F.col("code_penalty"), -F.col("score")))
    return curve.agg(best.alias("b")).select(F.col("b.w").alias("w"), F.col("b.brand_penalty").alias("brand_penalty"), F.col("b.code_penalty").alias("code_penalty"), (-F.col("b.col5")).alias("threshold"), (-F.col("b.col1")).alias("f1"))


def best_threshold(scored: DataFrame, group: list[str]) -> DataFrame:
    """``group, threshold, f1``: the threshold of the best F1 per group, the largest of equals."""
    curve = threshold_curve(scored, group)
    return curve.groupBy(*group).agg(F.min(F.struct(-F.col("f1"), -F.col("score"))).alias("b")).select(*group, (-F.col("b.col2")).alias("threshold"), (-F.col("b.col1")).alias("f1"))


def pair_prf(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of predicted against gold key sets; gold that blocking lost counts as missed."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(True)), gold.select(*keys).distinct().withColumn("g", F.lit(True))
    both = p.join(g, keys, "full")
    return prf_columns(both.agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & F.col("g").isNull()).alias("fp"), F.count_if(F.col("g") & F.col("p").isNull()).alias("fn")))


def split_ids(df: DataFrame, key: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """``key, is_val``: a seeded split by a hash of the key; a key always falls on the same side, and no sort is needed."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.select(key).where(F.col(key).isNotNull()).distinct().select(key, (h < int(share * 2**32)).alias("is_val"))


def stratified_pairs(scored: DataFrame, per_band: int = 60, seed: int = 42) -> DataFrame:
    """Up to ``per_band`` pairs of each half-open score band, chosen by a seeded hash: ``i, j, score, band``."""
    band = F.coalesce(*[F.when((F.col("score") >= low) & (F.col("score") < high), k) for k, (low, high) in enumerate(BANDS)])
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string")))
    w = Window.partitionBy("band").orderBy(order, "i", "j")
    picked = scored.withColumn("band", band).where("band is not null").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_band)
    return picked.select("i", "j", "score", "band")


def ablation(scored: DataFrame, config: str, dataset: str, thresholds: DataFrame) -> DataFrame:
    """F1 of every configuration (rows) on every data set (columns) at its own threshold."""
    met = scored.join(thresholds.select(config, "threshold"), config)
    hit = F.col("score") >= F.col("threshold")
    counts = met.groupBy(config, dataset).agg(F.count_if(hit & F.col("label")).alias("tp"), F.count_if(hit & ~F.col("label")).alias("fp"), F.count_if(~hit & F.col("label")).alias("fn"))
    return prf_columns(counts).groupBy(config).pivot(dataset).agg(F.first("f1"))


def grey_zone(scored: DataFrame, threshold: float, low: float = 0.1, high: float = 0.1) -> DataFrame:
    """Pairs whose score lies within [threshold - low, threshold + high)."""
    s = F.round("score", 6)
    return scored.where((s >= round(threshold - low, 6)) & (s < round(threshold + high, 6)))


def grey_zone_budget(scored: DataFrame, threshold: float, n: int) -> DataFrame:
    """The n pairs closest to the threshold, ties by ids."""
    return scored.orderBy(F.round(F.abs(F.col("score") - threshold), 6), "i", "j").limit(n)


def adjudicated(scored: DataFrame, threshold: float, answers: DataFrame) -> DataFrame:
    """``i, j, decision``: a valid answer ``(i, j, same)`` replaces the decision by threshold."""
    a = answers.where("same is not null").groupBy("i", "j").agg(F.bool_and("same").alias("same"))
    return scored.join(a, ["i", "j"], "left").select("i", "j", F.coalesce("same", F.col("score") >= threshold).alias("decision"))


def classification_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``n, accuracy, macro_f1, invalid``; a null prediction counts as its own wrong class."""
    d = df.where(F.col(gold).isNotNull()).select(F.col(gold).cast("string").alias("g"), F.coalesce(F.col(pred).cast("string"), F.lit("INVALID")).alias("p"))
    cell = d.groupBy("g", "p").count()
    sides = cell.select(F.explode(F.array(F.struct(F.col("g").alias("c"), F.lit("g").alias("s"), F.col("count").alias("n")), F.struct(F.col("p").alias("c"), F.lit("p").alias("s"), F.col("count").alias("n")))).alias("x"), (F.col("g") == F.col("p")).alias("ok")).select("x.*", "ok")
    per = sides.groupBy("c").agg(F.sum(F.when(F.col("ok") & (F.col("s") == "g"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    whole = cell.agg(F.sum("count").alias("n"), F.round(F.sum(F.when(F.col("g") == F.col("p"), F.col("count")).otherwise(0)) / F.sum("count"), 4).alias("accuracy"), F.sum(F.when(F.col("p") == "INVALID", F.col("count")).otherwise(0)).alias("invalid"))
    return whole.crossJoin(per.agg(F.round(F.avg(2 * F.col("tp") / F.col("both")), 4).alias("macro_f1"))).select("n", "accuracy", "macro_f1", "invalid")  # single rows


def per_class_sample(df: DataFrame, group: str, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """Up to n rows of each class by a seeded hash of the key: ``group, key``."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.select(group, key).where(F.col(group).isNotNull()).distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(group, key)
