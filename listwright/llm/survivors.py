"""Problem 5: the best representative of each group of duplicate records, field by field.

Records are compared on completeness, recency and trust. A record that no other one beats in all three lies in the first
dominance layer, the skyline; the next layer is the skyline of the rest, and so on. A lexicographic policy picks within
a layer. A field that the pick lacks is filled from the records that have it, again layer by layer and by the policy
within a layer, so that a record without the field hides none that has it.

Groups are reduced before they are gathered: of the records of one trust rank that have the same fields filled only the
latest can ever supply a value, so a group shrinks to at most ranks x 2 ** fields records, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.quantity import amounts_in, packs_in, plain, spellings
from listwright.llm import attributes
from listwright.llm.lexicon import FILLERS
from listwright.llm.linkage import TOLERANCE, parsed_listings
from listwright.runtime import broadcast_if_small, stored

#: Rank of a record whose source is not ranked: behind all others.
NO_RANK = 2**31 - 1
#: What decides within a layer, in this order.
POLICY = ("trust", "recency", "completeness")


def usable(column: str | Column) -> Column:
    """Not null, not blank and not a filler that stands for no value."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.lower(F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")).isin(*FILLERS)


def layers(records: list[tuple]) -> list[int]:
    """Dominance layer of each record, all coordinates the larger the better; equal records share a layer."""
    left, out, depth = list(range(len(records))), [0] * len(records), 0
    while left:
        beats = lambda a, b: a != b and all(x >= y for x, y in zip(a, b, strict=True))
        front = [i for i in left if not any(beats(records[j], records[i]) for j in left)]
        for i in front:
            out[i] = depth
        depth += 1
        left = [i for i in left if i not in front]
    return out


def survivors(df: DataFrame, group: str, fields: list[str], recency: str, rank: str, policy: tuple[str, ...] = POLICY) -> DataFrame:
    """One surviving record per group, in long form: ``group, field_name, field_value, layer, clear, varied``.

    ``rank`` is 1 for the most trusted source; null ranks and null times come last. ``layer`` is the dominance layer that
    supplied the value, null with a null value where no record has a usable one. ``clear`` says nothing of the choice, only
    of the case: among the records that have the field, the latest is also the most trusted, and no other of that time
    and trust holds another value. ``varied``: the records do not all hold the same value (null counts
    as a value). Ties are settled by the greater value; repeated rows change nothing.
    """
    n = len(fields)
    mask = sum((F.when(usable(f), F.lit(1 << k)).otherwise(0) for k, f in enumerate(fields)), F.lit(0))
    shown = [F.when(usable(f), F.col(f)).alias(f"f{k}") for k, f in enumerate(fields)]
    slim = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.coalesce(F.col(rank).cast("int"), F.lit(NO_RANK)).alias("r"), mask.alias("m"), F.coalesce(F.unix_micros(F.col(recency).cast("timestamp")), F.lit(-(2**62))).alias("t"), *shown, *[F.col(f).alias(f"o{k}") for k, f in enumerate(fields)])
    spread = [F.min(f"o{k}").alias(f"a{k}") for k in range(n)] + [F.max(f"o{k}").alias(f"b{k}") for k in range(n)] + [F.count(f"o{k}").alias(f"c{k}") for k in range(n)]
    # records of the same time that hold different values: their extremes differ
    tied = [(F.max(F.struct("t", f"f{k}"))[f"f{k}"] != F.min(F.struct((-F.col("t")).alias("t"), f"f{k}"))[f"f{k}"]).alias(f"d{k}") for k in range(n)]
    part = slim.groupBy("g", "r", "m").agg(F.max(F.struct("t", *[f"f{k}" for k in range(n)])).alias("best"), F.count("*").alias("n"), *spread, *tied)
    varied = [((F.min(f"a{k}") != F.max(f"b{k}")) | ((F.sum(f"c{k}") > 0) & (F.sum(f"c{k}") < F.sum("n")))) for k in range(n)]
    whole = part.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("r", "m", F.col("best.t").alias("t"), F.array(*[F.col(f"best.f{k}") for k in range(n)]).alias("v"), F.array(*[F.coalesce(f"d{k}", F.lit(False)) for k in range(n)]).alias("d")))).alias("records"), F.array(*[F.coalesce(v, F.lit(False)) for v in varied]).alias("varied"))
    kind = slim.schema["g"].dataType
    schema = T.StructType([T.StructField("g", kind), T.StructField("field_name", T.StringType()), T.StructField("field_value", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("clear", T.BooleanType()), T.StructField("varied", T.BooleanType())])

    def pick(records: list[dict]) -> Iterator[tuple[str | None, int | None, bool]]:
        points = [(r["m"].bit_count(), r["t"], -r["r"]) for r in records]
        at = {"completeness": 0, "recency": 1, "trust": 2}
        level = layers(points)
        rank = lambda i: (*(-points[i][at[p]] for p in policy), [x or "" for x in records[i]["v"]])
        pick = min(range(len(records)), key=lambda i: (level[i], rank(i)))
        for k in range(n):
            have = [i for i in range(len(records)) if records[i]["v"][k] is not None]
            if not have:
                yield None, None, False
                continue
            best = pick
            if records[pick]["v"][k] is None:
                below = dict(zip(have, layers([points[i] for i in have]), strict=True))
                best = min(have, key=lambda i: (below[i], rank(i)))
            tops = [i for i, depth in zip(have, layers([points[i][1:] for i in have]), strict=True) if not depth]
            clear = len({points[i][1:] for i in tops}) == 1 and len({records[i]["v"][k] for i in tops}) == 1 and not any(records[i]["d"][k] for i in tops)
            yield records[best]["v"][k], level[best], clear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (records, spread_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for name, found, differs in zip(fields, pick(records), spread_, strict=True):
                    rows.append(i)
                    out.append((name, *found, differs))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return whole.mapInArrow(run, schema).withColumnRenamed("g", group)


_CUT = re.compile(r"(?:…|\.\.\.|[-–—,/&|+(\[])\s*$")


def cut_off(name: str, others: list[str]) -> bool:
    """Ends with a mark of omission, a joiner or an open bracket, in the middle of a word that the others spell out, or
    before the kind or variant that the others name.
    """
    text = plain(name)
    if _CUT.search(text) or text.count("(") > text.count(")") or text.count("[") > text.count("]"):
        return True
    last = re.search(r"[^\W\d_]+$", text)
    if last and last[0] not in spellings() and not attributes.known_word(last[0]):
        words = {w for o in others for w in re.findall(r"[^\W\d_]+", plain(o))}
        if last[0] not in words and any(w.startswith(last[0]) for w in words):
            return True
    kind, variant = attributes.read(name)[:2]
    return not (kind and variant) and any(k and v or k and not kind for k, v in (attributes.read(o)[:2] for o in others))


def shown_parts(name: str | None, other: str | None, members: list[str], brand: str, base: str | None, amount: float | None, pack: int) -> list[bool]:
    """What a candidate name shows of its members: (it is whole, brand, amount, pack count). A missing name shows nothing."""
    if attributes.usable(name) is None:
        return [False] * 4
    text = plain(name)
    words = set(re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", attributes.bare(text)))
    main = text.partition(" + ")[0]
    stated = attributes.total(amounts_in(main)) if amount is not None else None
    right = amount is None or stated is not None and stated[0] == base and abs(stated[1] - amount) <= TOLERANCE * amount
    counts = {n for n in packs_in(main) if n > 1}
    return [not cut_off(name, [*members, *([other] if other else [])]), set(brand.split()) <= words, right, counts == ({pack} if pack > 1 else set())]


def member_facts(members: DataFrame, listings: DataFrame, group: str, key: str) -> DataFrame:
    """``group, brand, base, amount, pack``: what the members of a group agree on. Groups whose members disagree are left out.

    A brand that no member records is read from the words of their names that occur as a brand elsewhere. Everything is
    aggregated by minima and maxima, so a group of any size costs one row per task.
    """
    facts = stored(parsed_listings(listings, key).select(key, "brand", "base", "amount", "pack", "over"), "facts")
    words = facts.select(F.explode(F.split("brand", " ")).alias("w")).distinct()
    met = members.join(facts, key)
    ends = [f(c).alias(n) for c in ("brand", "base", "amount", "pack") for f, n in ((F.min, f"{c}_a"), (F.max, f"{c}_b"))]
    facts_of = met.groupBy(group).agg(*ends)
    agreed = facts_of.where("(brand_a is null or brand_a = brand_b) and (base_a is null or base_a = base_b) and pack_a = pack_b").where(F.col("amount_a").isNull() | (F.col("amount_b") <= F.col("amount_a") * (1 + TOLERANCE)))
    bare = met.join(agreed.where("brand_a is null").select(group), group, "left_semi")
    named = bare.select(group, F.explode(F.split("over", " ")).alias("w")).distinct().join(words, "w").groupBy(group).agg(F.array_join(F.array_sort(F.collect_set("w")), " ").alias("named"))
    return agreed.join(named, group, "left").select(group, F.coalesce("brand_a", "named").alias("brand"), F.col("base_a").alias("base"), F.col("amount_a").alias("amount"), F.col("pack_a").alias("pack")).where("brand is not null")


#: What a name can show of its members, besides being there.
PARTS = ["whole", "brand", "amount", "pack"]


def name_candidates(groups: DataFrame, facts: DataFrame, group: str, names: list[str], members: str) -> DataFrame:
    """One record per group and candidate name: ``group, candidate, name`` and a column for each of PARTS, null where it isn't shown.

    The parts count as fields, so a name that shows more of its members is a more complete record. ``name`` is null where
    it stands for no value.
    """
    slim = groups.select(group, *names, members).join(facts, group)
    schema = T.StructType([slim.schema[0], *[T.StructField(c, T.StringType()) for c in ("candidate", "name", *PARTS)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, r in enumerate(batch.to_pylist()):
                for name in names:
                    others = [r[o] for o in names if o != name and r[o]]
                    parts = shown_parts(r[name], others[0] if others else None, [m for m in r[members] or [] if m], r["brand"], r["base"], r["amount"], r["pack"])
                    rows.append(i)
                    out.append((name, r[name] if attributes.usable(r[name]) else None, *("shown" if p else None for p in parts)))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * (2 + len(PARTS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)

    return slim.mapInArrow(run, schema)


def clear_fields(clusters: DataFrame, listings: DataFrame, sources: DataFrame, group: str = "cluster_id", key: str = "row_id", policy: tuple[str, ...] = POLICY) -> DataFrame:
    """``group, field_name, field_value``: the surviving name, brand and category of every cluster where the case is beyond doubt.

    :func:`survivors` makes the choice; a case is kept if exactly one candidate name shows all it should, or if the members
    differ and the latest usable value is also from the most trusted source.

    A cluster that is delivered twice counts once; members without a listing, repeated members and null members are
    passed over; a listing from an unknown source ranks behind all others. Empty clusters give no rows.
    """
    clusters = clusters.where(F.col(group).isNotNull())
    members = clusters.select(group, F.explode("member_ids").alias(key)).where(F.col(key).isNotNull()).distinct()
    ranks = broadcast_if_small(sources.groupBy("source").agg(F.min("trust_rank").alias("rank")))
    own = listings.select(key, "brand", "category", "source", "crawl_timestamp").join(ranks, "source", "left")
    records = members.join(own, key).select(group, F.col("brand").alias("brand"), "category", "crawl_timestamp", "rank")
    chosen = survivors(records, group, ["brand", "category"], "crawl_timestamp", "rank", policy)
    facts = member_facts(members, listings.join(members.select(key).distinct(), key, "left_semi"), group, key)
    once = clusters.select(group, "medoid_name", "llm_name", "members").distinct()
    names = stored(name_candidates(once, facts, group, ["medoid_name", "llm_name"], "members"), "names")
    named = survivors(names.withColumn("at", F.lit(None).cast("timestamp")).withColumn("rank", F.lit(1)), group, ["name", *PARTS], "at", "rank", policy).where("field_name = 'name'")
    sound = reduce(and_, [F.col(p).isNotNull() for p in ("name", *PARTS)])
    one = names.groupBy(group).agg(F.count_distinct(F.when(sound, F.col("candidate"))).alias("n")).where("n = 1").select(group)
    beyond_doubt = chosen.where("clear and varied").union(named.join(one, group, "left_semi"))
    return beyond_doubt.select(group, "field_name", "field_value").distinct()
