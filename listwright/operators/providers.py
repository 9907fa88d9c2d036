"""Language-model calls as an operator: distinct prompts, a cache table, validated replies, bounded retries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A provider answers one prompt with text; any exception counts as a failed attempt.
Provider = Callable[[str], str]
#: A validator raises or returns false for a reply that isn't acceptable.
Validator = Callable[[dict], bool]

CACHE = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "model", "prompt", "response")])


#: Settings of a call: deterministic, with a bounded context and reply.
OPTIONS = {"temperature": 0, "seed": 42, "num_ctx": 2048, "num_predict": 300}


def laddered(chat: Callable[[str, dict], str], options: dict | None = None, tries: int = 3) -> Provider:
    """A provider that calls ``chat(prompt, options)`` and, where memory runs out, tries again with smaller settings.

    An error that names the graphics device first leaves 12 layers on it, then none; any other lack of memory shrinks the
    context. Other errors are raised as they are, and a RuntimeError after ``tries`` calls. Every prompt starts anew.
    """

    def provider(prompt: str) -> str:
        own = dict(options or OPTIONS)
        for _ in range(tries):
            try:
                return chat(prompt, dict(own))
            except Exception as error:  # noqa: BLE001 - the kind of error depends on the provider
                said = str(error).lower()
                if "out of memory" not in said:
                    raise
                if "cuda" in said or "gpu" in said:
                    own["num_gpu"] = 12 if "num_gpu" not in own else 0
                else:
                    own["num_ctx"] = 1024
        raise RuntimeError(f"out of memory {tries} times")

    return provider


def prompt_key(model: str, prompt: Column, system: str = "") -> Column:
    """The cache key of a prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(system), prompt), 256)


def ask(df: DataFrame, prompt: str, provider: Provider, valid: Validator, model: str = "stub", cache: DataFrame | None = None, retries: int = 2, out: str = "response", system: str = "") -> tuple[DataFrame, DataFrame]:
    """(``df`` with the JSON reply to its prompt column, or null; the new cache rows).

    Equal prompts are asked once. Cached replies aren't asked again; a reply that fails validation is asked up to
    ``retries`` more times and then given up, uncached, so that a later run asks again. Null prompts give null.
    """
    keyed = df.withColumn("_key", prompt_key(model, F.col(prompt), system))
    wanted = keyed.where(F.col(prompt).isNotNull()).select(F.col("_key").alias("key"), F.col(prompt).alias("prompt")).groupBy("key").agg(F.min("prompt").alias("prompt"))
    known = cache.select("key", "response").dropDuplicates(["key"]) if cache is not None else None
    if known is not None:
        wanted = wanted.join(known, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = []
            for text in batch.column(1).to_pylist():
                reply = None
                for _ in range(retries + 1):
                    try:
                        raw = provider(text)
                        if valid(json.loads(raw)):
                            reply = raw
                            break
                    except Exception:  # noqa: BLE001, S112 - whatever a provider raises is a failed attempt
                        continue
                replies.append(reply)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model] * len(replies)), batch.column(1), pa.array(replies, pa.string())], names=CACHE.names)

    fresh = wanted.mapInArrow(run, CACHE).where("response is not null")
    answers = fresh.select("key", "response")
    answers = answers.union(known) if known is not None else answers
    met = keyed.join(answers.select(F.col("key").alias("_key"), F.col("response").alias(out)), "_key", "left").drop("_key")
    return met, fresh


def json_field(reply: Column, name: str, kind: str = "string") -> Column:
    """One field of a JSON reply; null where the reply or the field is missing."""
    return F.from_json(reply, f"{name} {kind}")[name]


def batches_of(df: DataFrame, key: str, text: str, size: int = 10) -> DataFrame:
    """``batch, keys, texts``: rows in the order of their key, ``size`` to a batch.

    Keys are whole numbers. Ranks come from counts per bucket of keys and per range of buckets plus windows inside each, so
    no task sorts the whole table; what is summed in one task is a row for every 2 ** 24 keys.
    """
    bucketed = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.floor(F.col(key) / 4096).alias("b"))
    counts = bucketed.groupBy("b").count().withColumn("r", F.floor(F.col("b") / 4096))
    run = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("r").agg(F.sum("count").alias("count")).select("r", run(Window.partitionBy(F.lit(0)).orderBy("r")).alias("base"))
    offsets = counts.select("r", "b", run(Window.partitionBy("r").orderBy("b")).alias("inner")).join(ranges, "r").select("b", (F.col("base") + F.col("inner")).alias("offset"))
    ranked = bucketed.join(offsets, "b").withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("k")) + F.col("offset") - 1)
    part = ranked.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("x"))
    return part.select("batch", F.col("x.k").alias("keys"), F.col("x.t").alias("texts"))


def batch_labels(answered: DataFrame, allowed: list[str]) -> DataFrame:
    """``key, label`` from ``keys`` and a JSON ``response`` with ``labels``; a reply of the wrong length or with an unknown label voids its batch."""
    labels = json_field(F.col("response"), "labels", "array<string>")
    good = (F.size(labels) == F.size("keys")) & F.forall(labels, lambda x: x.isin(*allowed))
    return answered.withColumn("labels", F.when(good, labels)).select(F.explode(F.arrays_zip("keys", F.coalesce("labels", F.transform("keys", lambda _: F.lit(None).cast("string"))))).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.1").alias("label"))


def canonical_names(clusters: DataFrame, provider: Provider, most: int = 10, longest: int = 120) -> DataFrame:
    """``cluster_id, name``: a name chosen from up to ten members by a provider, else the medoid's name."""
    prompt = F.concat(F.lit("One name for: "), F.array_join(F.slice("members", 1, most), " | "))
    met, _ = ask(clusters.withColumn("prompt", prompt), "prompt", provider, lambda r: isinstance(r.get("name"), str) and 0 < len(r["name"]) <= longest)
    return met.select("cluster_id", F.coalesce(json_field(F.col("response"), "name"), F.col("medoid_name")).alias("name"))


def adjudicate(pairs: DataFrame, left: str, right: str, provider: Provider, **how) -> DataFrame:
    """``pairs`` with ``same`` and ``reason`` from a provider; null where no valid reply came (a boolean and at most 200 characters)."""
    prompt = F.concat(F.lit("Same product? A: "), F.col(left), F.lit(" B: "), F.col(right))
    valid = lambda r: isinstance(r.get("same"), bool) and len(str(r.get("reason", ""))) <= 200
    met, _ = ask(pairs.withColumn("_prompt", prompt), "_prompt", provider, valid, out="_reply", **how)
    return met.withColumns({"same": json_field(F.col("_reply"), "same", "boolean"), "reason": json_field(F.col("_reply"), "reason")}).drop("_prompt", "_reply")


def header_fields(headers: DataFrame, samples: DataFrame, provider: Provider, fields: list[str], **how) -> DataFrame:
    """``header, field``: a provider's choice among fields for each header with its ``samples(header, value)``; invalid choices are null."""
    shown = samples.groupBy("header").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"))
    asked = headers.select("header").distinct().join(shown, "header", "left").withColumn("prompt", F.concat_ws(" ", F.lit("Field of column"), "header", F.lit("with values"), "values"))
    met, _ = ask(asked, "prompt", provider, lambda r: r.get("field") in fields, **how)
    return met.select("header", json_field(F.col("response"), "field").alias("field"))


def rewrites(df: DataFrame, key: str, name: str, pattern: str, provider: Provider, **how) -> DataFrame:
    """``key, rewritten``: a provider's rewriting of the names that match a pattern; null where no valid reply came."""
    asked = df.where(F.col(name).rlike(pattern)).select(key, F.concat(F.lit("Rewrite: "), F.col(name)).alias("prompt"))
    met, _ = ask(asked, "prompt", provider, lambda r: bool(str(r.get("text") or "").strip()), **how)
    return met.select(key, json_field(F.col("response"), "text").alias("rewritten"))
