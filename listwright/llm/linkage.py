"""Problem 2: listings of one product under different wording, grouped by probabilistic record linkage.

1. Attributes are parsed from each listing: brand, kind, variant, amount in a canonical unit, pack count and the added
   article of a bundle. Words that no lexicon explains get their part (brand, product line or term) from the catalogue.
2. Listings with equal attributes form one signature, so that copies never meet each other pair by pair.
3. Signatures are compared within blocks that leave one field free at a time, each field in levels.
4. How often a field agrees, agrees in part or differs among matches and among the other pairs of a line, and the share of
   matches, are fitted by expectation-maximisation to the counts of comparison patterns, whose number doesn't grow with the data.
5. Pairs above a posterior threshold are links; groups are their connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.quantity import amounts, packs, spellings
from listwright.llm import attributes
from listwright.llm.components import connected_components
from listwright.llm.vocabulary import with_words
from listwright.runtime import spread, stored

#: Relative difference up to which two amounts count as equal.
TOLERANCE = 0.02
FIELDS = ["line", "brand", "kind", "variant", "terms", "amount", "pack", "article"]
#: Levels of a comparison; null carries no evidence.
DIFFERENT, PARTLY, EQUAL = 0, 1, 2
#: Largest share of matches that differ in a field that was read on both sides.
SLIP = 0.001
_KEY = ["line", "brand", "kind", "variant", "terms", "base", "amount", "pack", "article"]
_FREE = {"amount": ["base", "amount"], "kind": ["kind"], "variant": ["variant"], "terms": ["terms"], "pack": ["pack"], "article": ["article"], "line": ["line"], "brand": ["brand"]}
_PARSED = [("brand", T.StringType()), ("kind", T.StringType()), ("variant", T.StringType()), ("base", T.StringType()), ("amount", T.DoubleType()), ("pack", T.IntegerType()), ("article", T.StringType()), ("over", T.StringType())]
#: What is held of the agreement of unlike pairs beforehand, and as how many pairs it counts.
PRIOR_AGREE, PRIOR_PAIRS = 0.2, 100
#: Fields that give evidence only where both sides have them.
BOTH_SIDES = ["line", "brand", "kind"]
Pattern = tuple[int | None, ...]
Chance = dict[tuple[str, str], tuple[float, float, float]]


def parsed_listings(df: DataFrame, key: str, name: str = "product_name", brand: str = "brand", quantity: str = "quantity", value: str = "qty_value", unit: str = "qty_unit", known: bool = True) -> DataFrame:
    """``key`` and the parsed attributes. ``over`` holds the words of the name that no lexicon explains; without ``known``
    none is used.

    What the name leaves out comes from the other columns; a listing without any pack count counts as a pack of one.
    """
    slim = df.select(F.col(key), *[F.col(c).alias(a) for c, a in ((name, "n"), (brand, "b"), (quantity, "q"), (unit, "u"))], F.col(value).cast("double").alias("v"))
    schema = T.StructType([slim.schema[0], *(T.StructField(n, t) for n, t in _PARSED)])

    def one(n: str | None, b: str | None, q: str | None, u: str | None, v: float | None, names: dict[str, str]) -> tuple:
        kind, variant, part, count, added, over = attributes.read(n, known)
        if part is None:
            parts = amounts(q, title=False)
            if not parts and u and v is not None and 0 < v < math.inf:
                spelled = u.strip().lower().replace(" ", "").removesuffix(".")
                spelled = "inch" if spelled == "in" else names.get(spelled)
                parts = [(v, spelled)] if spelled else []
            part = attributes.total(parts)
        count = count or packs(q) or [1]
        base, amount = part or (None, None)
        return attributes.brand_words(b), kind, variant or None, base, amount and float(f"{amount:.9g}"), min(count[0], 1 << 30), added or None, over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = spellings()
        for part in batches:
            rows = [one(*r, names) for r in zip(*(part.column(k).to_pylist() for k in range(1, 6)), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_PARSED)
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names)

    return spread(slim).mapInArrow(run, schema)


def _within(x: Column, y: Column) -> Column:
    """Does one of two word lists, apart by blanks, hold all words of the other?"""
    a, b = F.split(x, " "), F.split(y, " ")
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def comparisons() -> list[Column]:
    """One level per field of a pair ``x, y`` of signatures: 2 equal, 1 partly equal, 0 different, null without evidence.

    Words agree in part where one side has all of the other's or, for lines and brands, one letter differs; amounts, where
    only one side states one. A line, brand or kind that is missing carries no evidence; a variant, term or article that
    only one side has is a difference.
    """
    x, y = lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")
    low, high = F.least("x.amount", "y.amount"), F.greatest("x.amount", "y.amount")
    none = lambda c: x(c).isNull() & y(c).isNull()
    level = lambda equal, partly=F.lit(False): F.when(equal, EQUAL).when(partly, PARTLY).otherwise(DIFFERENT)
    near = lambda c: (F.levenshtein(x(c), y(c), 1) >= 0) | _within(x(c), y(c))
    own = {
        "line": F.when(x("line").isNotNull() & y("line").isNotNull(), level(x("line") == y("line"), near("line"))),
        "brand": F.when(x("brand").isNotNull() & y("brand").isNotNull(), level(x("brand") == y("brand"), near("brand"))),
        "kind": F.when(x("kind").isNotNull() & y("kind").isNotNull(), level(x("kind") == y("kind"))),
        "amount": F.when(~none("amount"), level(F.coalesce((x("base") == y("base")) & (high - low <= TOLERANCE * low), F.lit(False)), x("amount").isNull() | y("amount").isNull())),
        "pack": level(x("pack") == y("pack")),
        **{c: F.when(~none(c), level(x(c).eqNullSafe(y(c)), F.coalesce(_within(x(c), y(c)), F.lit(False)))) for c in ("variant", "terms")},
        "article": F.when(~none("article"), level(x("article").eqNullSafe(y("article")))),
    }
    return [own[f].cast("int").alias(f) for f in FIELDS]


def _place() -> Column:
    """Where a listing is looked for: its line or, without one, its brand."""
    return F.coalesce(F.concat(F.lit("l"), F.col("line")), F.concat(F.lit("b"), F.col("brand")))


def block_pairs(signatures: DataFrame) -> DataFrame:
    """``u, v, n`` with their comparison levels: pairs of signatures that agree in all but one field.

    The brand is only in the block that leaves the line free; listings without a line use their brand in its place. The
    size of a block is the number of distinct values of its free field, not of listings. Signatures with neither line nor
    brand are in no block. Blocks shuffle an id and a hash; the attributes join the pairs, which makes hash collisions fall out.
    """
    passes = ["amount", "kind", "variant", "terms", "pack", "article", "line"]
    of = lambda g: [F.col("brand") if g == "line" else _place(), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for f in passes if f not in (g, "line") for c in _FREE[f]]]
    bare = F.col("kind").isNull() & F.col("terms").isNull()  # nothing but a brand to go by
    keys = [F.when(_place().isNotNull() if g != "line" else F.col("brand").isNotNull() & ~bare, F.xxhash64(F.lit(k), *of(g))) for k, g in enumerate(passes)]
    blocked = signatures.select("id", F.explode(F.filter(F.array(*keys), lambda h: h.isNotNull())).alias("h"))
    x, y = blocked.select(F.col("id").alias("u"), "h"), blocked.select(F.col("id").alias("v"), "h")
    met = x.join(y, "h").where("u < v").select("u", "v").distinct()
    side = signatures.select("id", "n", _place().alias("place"), *_KEY)
    full = met.join(side.alias("x"), F.col("u") == F.col("x.id")).join(side.alias("y"), F.col("v") == F.col("y.id"))
    same = lambda *cs: reduce(and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in cs])
    apart = reduce(lambda a, b: a + b, [F.when(same(*(["place"] if f == "line" else _FREE[f])), 0).otherwise(1) for f in passes])
    kept = full.where((apart <= 1) & (same("place") | (F.col("x.brand") == F.col("y.brand"))))
    return kept.select("u", "v", (F.col("x.n") * F.col("y.n")).alias("n"), *comparisons())


def chance_counts(signatures: DataFrame) -> Chance:
    """For pairs of listings of one line and of one brand, and for each field: (pairs, those with evidence, equal ones).

    They follow from the counts of values, so no pair is formed. Amounts are counted in steps of the tolerance.
    """
    value = {f: F.xxhash64(f) for f in FIELDS} | {"amount": F.xxhash64("base", F.floor(F.log("amount") / math.log1p(TOLERANCE)))}
    filled = lambda f: F.when(F.col(f).isNotNull(), value[f])
    place = {"line": _place(), "brand": F.col("brand")}
    cells = F.array(*[F.struct(F.lit(s).alias("s"), F.when(g.isNotNull(), F.xxhash64(g)).alias("g"), F.lit(f).alias("f"), filled(f).alias("v")) for s, g in place.items() for f in FIELDS if f != "line" and (s, f) != ("brand", "brand")])
    counts = signatures.select("n", F.explode(cells).alias("x")).where("x.g is not null").groupBy("x.s", "x.f", "x.g", "x.v").agg(F.sum("n").cast("double").alias("c"))
    two = lambda c: c * (c - 1) / 2
    each = counts.groupBy("s", "f", "g").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0.0)).alias("filled"), F.sum(F.when(F.col("v").isNotNull(), two(F.col("c"))).otherwise(0.0)).alias("equal"))
    both = F.col("f").isin(*BOTH_SIDES)
    evidence = F.when(both, two(F.col("filled"))).otherwise(two(F.col("n")) - two(F.col("n") - F.col("filled")))
    rows = each.groupBy("s", "f").agg(F.sum(two(F.col("n"))).alias("pairs"), F.sum(evidence).alias("evidence"), F.sum("equal").alias("equal")).collect()  # two rows a field
    return {(r.s, r.f): (r.pairs, r.evidence, r.equal) for r in rows}


def fit_weights(patterns: list[tuple[Pattern, float]], chance: Chance, slip: float = SLIP, rounds: int = 500) -> dict[Pattern, float]:
    """Posterior probability of a match for every comparison pattern, by expectation-maximisation.

    ``patterns`` are (level per field, count of pairs). They are judged against all pairs of one line or, where the line
    differs, of one brand, of which blocks hold a selection; ``chance`` gives the numbers of these and of the ones that
    agree in each field. Fitted are the share of matches among them, the frequencies of levels among matches, and those
    among the other pairs, which are what the fitted matches leave of ``chance``. Fields are taken as independent given
    the class; null levels carry no evidence. Fields are read well: at most ``slip`` of the matches differ in one, which
    tells the classes apart, since sister products agree in all fields but one more often than independent fields would.
    Deterministic; no patterns give an empty result.
    """
    stratum = {p: "brand" if p[0] in (DIFFERENT, PARTLY) else "line" for p, _ in patterns}
    first = [slip, 0.08, 0.92 - slip]
    m = [first for _ in FIELDS]
    matched = {(s, k): [0.0, 0.0, 0.0] for s in ("line", "brand") for k in range(len(FIELDS))}
    share, post = dict.fromkeys(("line", "brand"), 0.1), {}

    def whole(s: str, f: str) -> tuple[float, float, float]:
        inner = chance.get(("line", f), (0.0, 0.0, 0.0))  # no field: no evidence
        if s == "line":
            return inner
        return tuple(max(0.0, x - y) for x, y in zip(chance.get(("brand", f), (0.0, 0.0, 0.0)), inner, strict=True))

    def others(s: str, k: int) -> list[float]:
        """Frequencies of levels among the pairs of a stratum that aren't matches."""
        _, evidence, equal = whole(s, FIELDS[k])
        hit = matched[s, k]
        same = 0.0 if FIELDS[k] == "line" else (max(0.0, equal - hit[EQUAL]) + PRIOR_AGREE * PRIOR_PAIRS) / (max(0.0, evidence - sum(hit)) + PRIOR_PAIRS)
        left = [sum(n * (1 - post.get(p, 0.5)) for p, n in patterns if p[k] == x and stratum[p] == s) + 1 for x in (DIFFERENT, PARTLY)]
        same = min(same, 0.99)
        return [(1 - same) * left[0] / sum(left), (1 - same) * left[1] / sum(left), same]

    for _ in range(rounds):
        u = {sk: others(*sk) for sk in matched}
        before, post = post, {}
        for p, _ in patterns:
            s = stratum[p]
            odds = math.log(share[s]) - math.log(1 - share[s])
            for k, x in enumerate(p):
                if x is not None and not (s == "line" and FIELDS[k] == "line"):
                    odds += math.log(m[k][x]) - math.log(u[s, k][x])
            post[p] = 1 / (1 + math.exp(-min(700.0, max(-700.0, odds))))
        for s in share:
            found = sum(n * post[p] for p, n in patterns if stratum[p] == s)
            share[s] = min(max((found + 0.1) / (max(found, whole(s, "pack")[0]) + 1), 1e-12), 0.5)
        for k, f in enumerate(FIELDS):
            for s in share:
                matched[s, k] = [sum(n * post[p] for p, n in patterns if p[k] == x and stratum[p] == s) for x in (DIFFERENT, PARTLY, EQUAL)]
            seen = [first[x] + sum(matched[s, k][x] for s in share if f != "line" or s == "brand") for x in (DIFFERENT, PARTLY, EQUAL)]
            m[k] = [x / sum(seen) for x in seen]
            if m[k][DIFFERENT] > slip:
                rest = (1 - slip) / (m[k][PARTLY] + m[k][EQUAL])
                m[k] = [slip, m[k][PARTLY] * rest, m[k][EQUAL] * rest]
        if before and max(abs(post[p] - before[p]) for p in post) < 1e-9:
            break
    return post


def pattern_counts(pairs: DataFrame, signatures: DataFrame) -> list[tuple[Pattern, float]]:
    """(level per field, pairs of listings) over block pairs and over the pairs inside signatures, which agree in all they have."""
    counts = pairs.groupBy(*FIELDS).agg(F.sum("n").cast("double").alias("count"))
    inside = [F.when(F.col(f).isNotNull(), EQUAL).alias(f) for f in FIELDS]
    alike = signatures.groupBy(*inside).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("count")).where("count > 0")
    merged: dict[Pattern, float] = {}
    for row in [*counts.collect(), *alike.collect()]:  # at most 4 ** len(FIELDS) rows, whatever the data
        merged[tuple(row[:-1])] = merged.get(tuple(row[:-1]), 0.0) + float(row[-1])
    return sorted(merged.items(), key=lambda x: [(v is None, v) for v in x[0]])


def product_groups(df: DataFrame, key: str, threshold: float = 0.5, known: bool = True, weights=fit_weights) -> DataFrame:
    """``key, group_id``: every listing and the smallest key of its product.

    ``known`` uses the lexicon of synonyms besides what the catalogue teaches; ``weights`` turns pattern counts into
    posteriors. A listing that has neither a line nor a brand with any other word is a group of its own. Null keys are left out,
    repeated rows of a key weigh in the statistics and give one result row.
    """
    spark = df.sparkSession
    parsed = stored(parsed_listings(df.where(F.col(key).isNotNull()), key, known=known), "parsed")
    hashes = [F.xxhash64(*([F.lit(k)] if k else []), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in _KEY]).alias(f"h{k + 1}") for k in range(2)]
    lined = stored(with_words(parsed).select(key, *_KEY, *hashes), "lined")  # 128 bits name a signature
    placed = lined.where("line is not null or brand is not null and (kind is not null or terms is not null)")
    signatures = stored(placed.groupBy("h1", "h2", *_KEY).agg(F.min(key).alias("id"), F.count("*").alias("n")), "signatures")
    pairs = stored(block_pairs(signatures), "pairs")
    post = weights(pattern_counts(pairs, signatures), chance_counts(signatures))
    good = [p for p, w in post.items() if w >= threshold]
    linked = spark.createDataFrame(good, T.StructType([T.StructField(f, T.IntegerType()) for f in FIELDS]))
    agree = [pairs[f].eqNullSafe(linked[f]) for f in FIELDS]
    links = pairs.join(F.broadcast(linked), agree, "left_semi").select("u", "v")  # a row per pattern, at most 4 ** len(FIELDS)
    groups = connected_components(links).withColumnRenamed("group_id", "g")
    grouped = signatures.select("id", "h1", "h2").join(groups, "id", "left").select("h1", "h2", F.coalesce("g", "id").alias("group_id"))
    return lined.select(key, "h1", "h2").join(grouped, ["h1", "h2"], "left").select(key, F.coalesce("group_id", key).alias("group_id")).distinct()


def product_pairs(groups: DataFrame, key: str) -> DataFrame:
    """``<key>_a, <key>_b``: every two listings of a group, the smaller key first."""
    a, b = groups.select("group_id", F.col(key).alias(f"{key}_a")), groups.select("group_id", F.col(key).alias(f"{key}_b"))
    return a.join(b, "group_id").where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
