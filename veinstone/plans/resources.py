"""The resource stage: model and resource entries of archives, their records, counts and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, rules, text
from ..operators import aggregates, scoring, taxonomy
from ..sources import archives as src

PER_ARCHIVE, MODEL_BYTES, RESOURCE_BYTES = 800, 128_000_000, 500_000
UNIT_LIMIT = 2000


def candidates(entries: DataFrame) -> DataFrame:
    """(archive, path, entry_size, kind, hits, score) of model and resource entries, from their paths alone."""
    rows = entries.where("path is not null and not is_dir").withColumn("hits", taxonomy.classify(F.col("path")))
    low = F.lower("path")
    kind = F.when(rules.is_model(low), "model").when(rules.is_resource(low, F.size("hits") > 0), "resource_candidate")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    return rows.withColumn("score", scoring.resource_score(F.col("kind") == "model", F.col("hits"))).select("archive", "path", "entry_size", "kind", "hits", "score")


def selected(rows: DataFrame, limit: int = PER_ARCHIVE) -> DataFrame:
    """All models and the best resources of each archive."""
    out = aggregates.models_and_top(rows.withColumn("__model", F.col("kind") == "model"), ["archive"], "__model", [F.desc("score"), F.col("path")], limit)
    return out.drop("__model")


def records(archives: DataFrame, limit: int = PER_ARCHIVE) -> DataFrame:
    """Records of the selected entries: paths are ranked first, then only archives are read again for bytes."""
    chosen = selected(candidates(src.entries(archives)), limit)
    read = src.entries(archives, prefix_bytes=MODEL_BYTES).select("archive", "path", "sha256", "bytes")
    rows = chosen.join(read, ["archive", "path"])
    model = F.col("kind") == "model"
    data = F.when(model, F.col("bytes")).otherwise(F.substring("bytes", 1, RESOURCE_BYTES))
    rows = rows.withColumn("data", data).withColumn("content_truncated", F.col("entry_size") > F.octet_length("data"))
    shown = F.when(~model, F.make_valid_utf8(F.col("data").cast("string")))
    rows = rows.withColumn("text", shown)
    rows = rows.withColumn("text_hits", F.when(~model, taxonomy.classify(F.substring("text", 1, 100_000))))
    rows = rows.withColumn("entropy", hashing.byte_entropy(F.when(model, F.col("data"))))
    rows = rows.withColumn("model", F.when(model, model_metadata(F.col("path"), F.col("data"), F.col("entropy"))))
    union = F.concat(taxonomy.names(F.col("hits")), F.coalesce(taxonomy.names(F.col("text_hits")), _none()), F.coalesce(F.col("model.capabilities"), _none()))
    return rows.withColumn("capabilities", taxonomy.in_taxonomy_order(union)).withColumn("text_sample", F.substring("text", 1, 2000)).drop("bytes", "data", "text", "entropy")


def _none() -> Column:
    return F.array().cast("array<string>")


def model_metadata(path: Column, data: Column, entropy: Column) -> Column:
    """Facts of a model file's bytes: format, magic, entropy (as byte_entropy gives it), strings, operator hints, capabilities."""
    strings = F.slice(text.printable_strings(data), 1, 800)
    magic = text.magic_offsets(data, "TFL3")

    def facts(x: Column) -> Column:
        s, m = x["s"], x["m"]
        early = F.exists(m, lambda o: o <= 124)
        return F.struct(
            rules.model_format(path).alias("format"), early.alias("tflite_magic_present"), m.alias("tflite_magic_offsets"), (F.size(m) > 0).alias("embedded_tflite_magic_present"),
            F.lower(F.hex(F.substring(data, 1, 32))).alias("header_hex"), entropy.alias("entropy_first_mb"), ((rules.model_format(path) == "tflite") & ~early).alias("likely_wrapped_or_encrypted"),
            F.size(s).alias("string_count"), text.operator_hints(s, rules.OPERATOR_HINTS).alias("operator_hints"), taxonomy.names(taxonomy.classify(F.array_join(F.slice(s, 1, 300), " "))).alias("capabilities"),
            F.slice(s, 1, 120).alias("strings_sample"),
        )

    return text.let(F.struct(strings.alias("s"), magic.alias("m")), facts)


def summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Per archive: selected and discovered numbers, and excluded resources."""
    n = found.groupBy("archive").agg(F.count_if(F.col("kind") == "model").alias("models_discovered"), F.count_if(F.col("kind") != "model").alias("resources_discovered"))
    k = rows.groupBy("archive").agg(F.count_if(F.col("kind") == "model").alias("models"), F.count_if(F.col("kind") != "model").alias("resources"))
    return n.join(k, "archive", "left").withColumn("resources_excluded", F.col("resources_discovered") - F.coalesce("resources", F.lit(0)))


def capability_counts(rows: DataFrame) -> DataFrame:
    """(archive, capability, n): each capability once a source (path, model, text) of a record."""
    each = F.concat(taxonomy.names(F.col("hits")), F.coalesce(taxonomy.names(F.col("text_hits")), _none()), F.coalesce(F.col("model.capabilities"), _none()))
    return rows.select("archive", F.explode(each).alias("capability")).groupBy("archive", "capability").agg(F.count("*").alias("n"))


def units(rows: DataFrame) -> DataFrame:
    """Evidence units of models, and of at most UNIT_LIMIT resources by confidence."""
    base = lambda kind: [hashing.unit_id(F.lit(kind), F.col("archive"), F.col("path"), F.col("sha256")).alias("unit_id"), F.lit("resources").alias("phase"), F.lit(kind).alias("kind"), "archive", "path", "sha256", "capabilities"]
    m = rows.where("kind = 'model'")
    body = F.concat_ws("\n", "path", "model.format", F.array_join("model.operator_hints", " "), F.array_join(F.slice("model.strings_sample", 1, 100), " "))
    models = m.select(*base("model"), F.col("model.format").alias("format"), hashing.token_fingerprint(body).alias("token_fingerprint"), rules.confidence(F.size("capabilities"), F.size("model.operator_hints") + F.size("model.strings_sample")).alias("confidence"))
    r = rows.where("kind <> 'model'")
    body = F.concat_ws("\n", "path", F.array_join("capabilities", " "), F.substring(F.coalesce("text_sample", F.lit("")), 1, 5000))
    has = (F.coalesce("text_sample", F.lit("")) != "").cast("int")
    rest = r.select(*base("resource"), "text_sample", hashing.token_fingerprint(body).alias("token_fingerprint"), rules.confidence(F.size("capabilities"), has).alias("confidence"))
    return models.unionByName(rest.orderBy(F.desc("confidence"), "path").limit(UNIT_LIMIT), allowMissingColumns=True)
