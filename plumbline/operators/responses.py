"""Raw model responses as tables: scores, texts, tests, and the graph they describe, whatever shape each came in.

Responses are VARIANT values; every list is exploded by its position, and what is one value where a list was asked for counts as a list of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for an absent type, relation, file or framework.
UNKNOWN, INFERRED, DEPENDS = "unknown", "inferred", "depends_on"


def read(raw: DataFrame, response: str = "response") -> DataFrame:
    """raw plus ``payload`` (VARIANT) and ``readable``: fences and what stands around the outermost braces are dropped; what is no object is not readable."""
    raw = raw.repartition(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # parsing is far more work than a file's bytes tell
    text = F.trim(F.col(response), F.lit(" \t\r\n"))
    fenced = F.when(F.startswith(text, F.lit("```")), F.get(F.split(text, "```"), F.lit(1)))
    inner = F.regexp_replace(F.coalesce(fenced, text), r"^\s*(?i:json)", "")
    inner = F.when(fenced.isNotNull(), inner).otherwise(text)
    braces = F.nullif(F.regexp_extract(inner, r"(?s)(\{.*\})", 1), F.lit(""))
    payload = F.coalesce(F.try_parse_json(inner), F.try_parse_json(braces))
    payload = F.when(F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")), payload)
    return raw.withColumn("payload", payload).withColumn("readable", F.col("payload").isNotNull())


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _listed(value: Column) -> Column:
    """A VARIANT as an array of VARIANT: absent and null are empty, anything but a list is a list of one."""
    whole = F.try_variant_get(value, "$", "array<variant>")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")).when(F.startswith(_kind(value), F.lit("ARRAY")), whole).otherwise(F.array(value))


def _text(value: Column, path: str = "$") -> Column:
    """A value as text: strings as they are, all else as JSON; null where there is none."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(found.isNull() | F.is_variant_null(found), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_variant_get(found, "$", "string"), F.to_json(found)))


def _filled(text: Column) -> Column:
    """Text that counts as given: not null, empty, zero or false."""
    return F.when(~text.isin("", "0", "false", "0.0"), text)


def _each(responses: DataFrame, key: str, path: str, within: str = "$") -> DataFrame:
    """(key, place, item) of a list in readable responses."""
    inside = F.try_variant_get(F.col("payload"), within, "variant")
    return responses.where("readable").select(key, F.posexplode(_listed(F.try_variant_get(inside, path, "variant"))).alias("place", "item"))


def scores(responses: DataFrame, key: str, path: str = "$.similarity_score") -> DataFrame:
    """(key, readable, score): rounded half to even and kept in 0..100; 0 where a readable response has no number."""
    number = F.coalesce(F.try_variant_get(F.col("payload"), path, "double"), F.try_variant_get(F.col("payload"), path, "string").try_cast("double"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0)))))
    return responses.select(key, "readable", F.when(F.col("readable"), score).cast("bigint").alias("score"))


def texts(responses: DataFrame, key: str, field: str) -> DataFrame:
    """(key, place, text) of ``gaps`` or ``recommendations``."""
    return _each(responses, key, f"$.{field}").select(key, "place", F.coalesce(_text(F.col("item")), F.lit("None")).alias("text"))


def tests(responses: DataFrame, key: str) -> DataFrame:
    """(key, place, target_file, framework, code) of tests that have code."""
    item = F.col("item")
    out = _each(responses, key, "$.unit_tests").withColumn("code", _filled(_text(item, "$.code"))).where("code IS NOT NULL")
    return out.select(key, "place", *(F.coalesce(_text(item, f"$.{c}"), F.lit(UNKNOWN)).alias(c) for c in ("target_file", "framework")), "code")


def edges(responses: DataFrame, key: str) -> DataFrame:
    """(key, place, source, target, relation) of edges with both ends."""
    item = F.col("item")
    out = _each(responses, key, "$.edges", "$.semantic_graph")
    out = out.select(key, "place", *(_filled(_text(item, f"$.{c}")).alias(c) for c in ("source", "target")), F.coalesce(_text(item, "$.relation"), F.lit(DEPENDS)).alias("relation"))
    return out.where("source IS NOT NULL AND target IS NOT NULL")


def nodes(responses: DataFrame, key: str) -> DataFrame:
    """(key, id, type): nodes as listed (a plain string is an id), then ends of edges that no listed node has, as inferred. Repeated ids stay, as listed."""
    item = F.col("item")
    said = F.try_variant_get(item, "$", "string")
    plain = F.startswith(_kind(item), F.lit("STRING"))
    listed = _each(responses, key, "$.nodes", "$.semantic_graph")
    listed = listed.select(key, "place", F.when(plain, said).otherwise(_filled(_text(item, "$.id"))).alias("id"), F.when(plain, F.lit(UNKNOWN)).otherwise(F.coalesce(_text(item, "$.type"), F.lit(UNKNOWN))).alias("type"))
    listed = listed.where("id IS NOT NULL")
    ends = edges(responses, key)
    ends = ends.select(key, F.col("source").alias("id")).unionByName(ends.select(key, F.col("target").alias("id"))).distinct()
    inferred = ends.join(listed, [key, "id"], "left_anti").withColumn("type", F.lit(INFERRED))
    return listed.select(key, "id", "type").unionByName(inferred.select(key, "id", "type"))

