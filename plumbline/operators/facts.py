"""Fact records and model outputs: normalisation, scoping, evaluability, coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import node_id, round2, tokens


def normalise_fields(fields: DataFrame, *keys: str) -> DataFrame:
    """One row per field name (keys, class, name, type, pos): the first typed declaration, else the first."""
    order = Window.partitionBy(*keys, "class", "name").orderBy(F.col("type").isNull(), "pos", "type")
    return fields.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def cap_calls(refs: Column, most: int = 96) -> tuple[Column, Column]:
    """The first references of a callable, and their names sorted without repeats."""
    kept = F.slice(refs, 1, most)
    return kept, F.array_sort(F.array_distinct(kept))


def scope(files: DataFrame, impact: DataFrame, *keys: str) -> DataFrame:
    """Facts of the files that impact node ids (kind::path::name) lie in."""
    touched = impact.select(*keys, F.get(F.split("node", "::"), F.lit(1)).alias("file_path")).distinct()
    return files.join(touched, [*keys, "file_path"], "left_semi")


def evaluability(snapshots: DataFrame) -> DataFrame:
    """Issues of snapshots(design_elements, code_classes, parse_errors, unsupported), and the score only where there are none."""
    checks = (
        (F.col("design_elements") == 0, "no design"),
        (F.col("code_classes") == 0, "no classes in code"),
        (F.col("parse_errors") > 0, "parse errors"),
        (F.col("unsupported") > 0, "unsupported languages"),
    )
    issues = F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in checks)))
    return snapshots.withColumn("issues", F.array_join(issues, ",")).withColumn("score", F.when(F.size(issues) == 0, F.col("score")))


def coerce_outputs(raw: DataFrame) -> DataFrame:
    """Raw model responses as typed rows: what stands outside the outermost braces is dropped, a score is rounded and kept in
    0..100, a scalar gap is a list of one; what cannot be read gives NULLs and is marked."""
    body = F.regexp_extract("response", r"(?s)(\{.*\})", 1)
    score = F.get_json_object(body, "$.score").try_cast("double")
    gaps = F.get_json_object(body, "$.gaps")
    listed = F.when(F.startswith(gaps, F.lit("[")), F.from_json(gaps, "array<string>")).when(gaps.isNotNull(), F.array(gaps)).otherwise(F.array().cast("array<string>"))
    return raw.withColumns(
        {"score": F.greatest(F.lit(0), F.least(F.lit(100), F.round(score))).cast("bigint"), "gaps": F.array_join(listed, ","), "readable": F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull()}
    ).withColumn("score", F.when(F.get_json_object(body, "$.score").isNotNull(), F.col("score")))


def file_nodes(files: DataFrame, *keys: str) -> DataFrame:
    return files.select(*keys, node_id("module", F.col("file_path")).alias("node"))


def _json_chars(n: Column, chars: Column) -> Column:
    """Characters of {"files":[...]} around n records of so many characters together."""
    return F.lit(12) + F.coalesce(chars, F.lit(0)) + F.greatest(n - 1, F.lit(0))


def payload_tokens(decisions: DataFrame, records: DataFrame, impact: DataFrame, *keys: str) -> DataFrame:
    """decisions plus scoped and tokens: the estimated size of what an analysis would have been sent.

    decisions(keys, previous, fired); records(keys, file_path, record) are fact records; impact(keys, node) are ids
    kind::path::name. With a version before and an impact set, only records of files in the set are sent, all of them otherwise
    (a content change that reaches no element has no impact). Nothing is sent on reuse. Sizes are summed, no payload is built.
    """
    sized = records.select(*keys, "file_path", F.length(F.to_json("record")).alias("chars"))
    touched = impact.select(*keys, F.get(F.split("node", "::"), F.lit(1)).alias("file_path")).distinct().withColumn("hit", F.lit(True))
    some = impact.select(*keys).distinct().withColumn("reached", F.lit(True))
    hit = F.col("hit").isNotNull()
    sizes = sized.join(touched, [*keys, "file_path"], "left").groupBy(*keys).agg(
        _json_chars(F.count("*"), F.sum("chars")).alias("whole"), _json_chars(F.count_if(hit), F.sum(F.when(hit, F.col("chars")))).alias("part")
    )
    out = decisions.join(sizes, list(keys), "left").join(some, list(keys), "left")
    scoped = F.col("previous").isNotNull() & F.col("reached").isNotNull()
    chars = F.coalesce(F.when(scoped, F.col("part")).otherwise(F.col("whole")), F.lit(12))
    sent = F.when(F.col("fired"), tokens(chars)).otherwise(F.lit(0)).cast("bigint")
    return out.select(*decisions.columns, (F.col("fired") & scoped).alias("scoped"), sent.alias("tokens"))


def representation_saving(sources: DataFrame, records: DataFrame, *keys: str) -> DataFrame:
    """(keys, files, raw_tokens, fact_tokens, saving) of sources(keys, chars), one row a file, and their records(keys, record).

    The texts count as joined by line breaks, the records as one document; saving is in percent to two places, and
    negative where the records are longer than the texts.
    """
    raw = sources.groupBy(*keys).agg(tokens(F.sum(F.coalesce("chars", F.lit(0))) + F.count("*") - 1).alias("raw_tokens"))
    said = records.groupBy(*keys).agg(F.count("*").alias("files"), tokens(_json_chars(F.count("*"), F.sum(F.length(F.to_json("record"))))).alias("fact_tokens"))
    out = raw.join(said, list(keys), "left").withColumns({"files": F.coalesce("files", F.lit(0).cast("bigint")), "fact_tokens": F.coalesce("fact_tokens", F.lit(3).cast("bigint"))})
    return out.select(*keys, "files", "raw_tokens", "fact_tokens", round2((1 - F.col("fact_tokens") / F.col("raw_tokens")) * 100).alias("saving"))
