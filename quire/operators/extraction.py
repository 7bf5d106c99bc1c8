"""Schema fields from blocks: candidates, values, validators, confidence, citations, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, text
from .sizes import broadcast_if_small

FIELD = "struct<type:string,pattern:string,aliases:array<string>,title:string,description:string,minimum:double,maximum:double>"


def schema_fields(schemas: DataFrame) -> DataFrame:
    """(schema_id, field_name, type, pattern, aliases, ...) from JSON schemas (schema_id, json_schema)."""
    parsed = F.from_json("json_schema", f"properties map<string,{FIELD}>, required array<string>")
    rows = schemas.withColumn("s", parsed).select("schema_id", F.col("s.required").alias("req"), F.explode("s.properties").alias("field_name", "f"))
    required = F.coalesce(F.array_contains("req", F.col("field_name")), F.lit(False))
    rows = rows.select("schema_id", "field_name", "f.*", required.alias("required"))
    return rows.withColumn("aliases", alias_list(F.col("field_name"), F.col("aliases"), F.col("title"), F.col("description")))


def alias_list(name: Column, aliases: Column, title: Column, description: Column) -> Column:
    """Name, name with spaces, aliases, title and description: trimmed, not blank, distinct in order."""
    every = F.concat(
        F.array(name, F.replace(name, F.lit("_"), F.lit(" "))), F.coalesce(aliases, F.array().cast("array<string>")), F.array(title, description)
    )
    return F.array_distinct(F.filter(F.transform(F.array_compact(every), text.stripped), lambda a: a != ""))


def _found(pattern: Column, value: Column) -> Column:
    """If a pattern that may be null is found, whatever the case."""
    return F.when(pattern.isNotNull(), F.call_function("regexp_like", value, F.concat(F.lit("(?iu)"), pattern))).otherwise(F.lit(False))


def candidates(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """Best block for each (run, field): alias overlap or pattern, first block on ties or without a hit.

    Each block's tokens are made once; fields join on schema_id, and the best row is a max_by, so
    partial results are combined before the shuffle. Blocks need schema_id, page, ord, block_id, text.
    """
    b = blocks.select("parse_run_id", "schema_id", "page", "ord", "block_id", "text", "bbox", "confidence", text.token_set(F.coalesce("text", F.lit(""))).alias("tokens"))
    pair = b.join(broadcast_if_small(fields), "schema_id")
    overlap = F.coalesce(F.array_max(F.transform("aliases", lambda a: text.token_overlap(a, F.col("tokens")))), F.lit(0.0))
    score = F.greatest(overlap, F.when(_found(F.col("pattern"), F.col("text")), 1.0).otherwise(0.0))
    first = F.struct((-F.col("page")).alias("p"), (-F.col("ord")).alias("o"))
    pick = F.struct("block_id", "page", "text", "bbox", "confidence", score.alias("score"))
    best = F.max_by(pick, F.struct(score.alias("score"), first.alias("first")))
    keep = [c for c in fields.columns if c not in ("field_name", "schema_id")]
    return pair.groupBy("parse_run_id", "field_name").agg(best.alias("block"), *[F.any_value(c).alias(c) for c in keep])


# A group in a pattern, and what follows an alias up to the next label or end.
_GROUP = r"(?<!\\)\((?!\?)"
_AFTER_ALIAS = r"\s*[:#-]?\s*(.+?)(?=\s+[A-Z][A-Za-z ]{1,30}\s*[:#-]|\n|;|\||$)"


def value_text(raw: Column, aliases: Column, pattern: Column) -> Column:
    """Pattern's first group or match; else what follows an alias; else the whole text."""
    folded = F.concat(F.lit("(?iu)"), pattern)
    grouped = pattern.rlike(_GROUP)
    by_pattern = F.when(_found(pattern, raw), F.call_function("regexp_extract", raw, folded, F.when(grouped, 1).otherwise(0)))
    escaped = lambda a: F.regexp_replace(F.regexp_replace(a, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1"), " ", r"\\s+")
    rule = lambda a: F.concat(F.lit("(?iu)"), escaped(a), F.lit(_AFTER_ALIAS))
    got = F.transform(aliases, lambda a: F.when(F.call_function("regexp_like", raw, rule(a)), F.call_function("regexp_extract", raw, rule(a), F.lit(1))))
    by_alias = text.trimmed_label(text.stripped(F.get(F.array_compact(got), F.lit(0))))
    return F.coalesce(by_pattern, by_alias, text.stripped(raw), F.lit(""))


def coerced(value: Column, kind: Column) -> Column:
    """Struct of typed values; only the one of ``kind`` is set. Numbers default to 0."""
    number = F.coalesce(text.number_in(value), F.lit(0.0))
    items = F.filter(F.transform(F.split(value, "[,;|]"), text.stripped), lambda x: x != "")
    truth = F.lower(text.stripped(value)).isin("true", "yes", "1", "y")
    typed = kind.isin("number", "integer", "boolean", "array")
    return F.struct(
        F.when(kind == "number", number).alias("number"), F.when(kind == "integer", number.cast("long")).alias("integer"),
        F.when(kind == "boolean", truth).alias("boolean"), F.when(kind == "array", items).alias("array"),
        F.when(~F.coalesce(typed, F.lit(False)), value).alias("string"),
    )


def validators(field: Column, value: Column, typed: Column, pattern: Column, minimum: Column, maximum: Column, required: Column) -> Column:
    """Array of name and status: required, regex, minimum, maximum; else that the field is present (or warn)."""
    number = F.coalesce(typed.number, typed.integer.cast("double"))
    row = lambda name, ok, bad="fail": F.struct(name.alias("name"), F.when(ok, "pass").otherwise(bad).alias("status"))
    listed = F.array_compact(
        F.array(
            F.when(required, row(F.lit("required"), value != "")),
            F.when(pattern.isNotNull(), row(F.lit("regex"), _found(pattern, value))),
            F.when(minimum.isNotNull() & number.isNotNull(), row(F.lit("minimum"), number >= minimum)),
            F.when(maximum.isNotNull() & number.isNotNull(), row(F.lit("maximum"), number <= maximum)),
        )
    )
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(row(F.concat(field, F.lit("_present")), value != "", "warn")))


def raw_confidence(fit: Column, grounding: Column, parser: Column, agreement: Column, contradiction: Column) -> Column:
    z = 0.25 * fit + 0.30 * grounding + 0.20 * parser + 0.15 * agreement - 0.10 * contradiction
    return 1 / (1 + F.exp(-z))


def extract(blocks: DataFrame, fields: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run and field: value, typed value, validators, raw confidence and citation.

    With ``runs`` (parse_run_id, schema_id) the runs among them that have no blocks have rows too: the
    empty value of the field's type, a failed ``required``, no confidence and no citation.
    """
    rows = candidates(blocks, fields)
    rows = rows.withColumn("raw_text", F.coalesce("block.text", F.lit("")))
    rows = rows.withColumn("value", value_text(F.col("raw_text"), F.col("aliases"), F.col("pattern")))
    rows = rows.withColumn("typed", coerced(F.col("value"), F.col("type")))
    checks = validators(*map(F.col, ("field_name", "value", "typed", "pattern", "minimum", "maximum", "required")))
    rows = rows.withColumn("validators", checks)
    fit = F.when(F.forall("validators", lambda v: v.status == "pass"), 1.0).otherwise(0.4)
    ground = F.when(text.is_blank(F.col("raw_text")), 0.2).otherwise(1.0)
    parser = F.coalesce("block.confidence.calibrated", F.lit(0.65))
    raw = raw_confidence(fit, ground, parser, F.lit(0.75), F.when(F.col("value") != "", 0.0).otherwise(0.25))
    cited = F.struct(F.col("block.page").alias("page"), F.col("raw_text").alias("matching_text"), F.array(F.coalesce("block.bbox", boxes.FULL_PAGE())).alias("bboxes"))
    found = rows.select(
        "parse_run_id", "field_name", "value", "typed", "validators", raw.alias("raw_confidence"), F.array(cited).alias("citations"), F.col("block.block_id").alias("block_id")
    )
    if runs is None:
        return found
    bare = runs.select("parse_run_id", "schema_id").join(blocks.select("parse_run_id").distinct(), "parse_run_id", "left_anti")
    bare = bare.join(broadcast_if_small(fields), "schema_id").withColumn("value", F.lit(""))
    missed = F.array(F.struct(F.lit("required").alias("name"), F.lit("fail").alias("status")))
    empty = bare.select(
        "parse_run_id", "field_name", "value", coerced(F.col("value"), F.col("type")).alias("typed"), missed.alias("validators"), F.lit(0.0).alias("raw_confidence"),
        F.array().cast(found.schema["citations"].dataType).alias("citations"), F.lit(None).cast("string").alias("block_id"),
    )
    return found.unionByName(empty)


def without_citations(metadata: DataFrame) -> DataFrame:
    """Fields that must be rejected: not private (``_``) and without a citation."""
    return metadata.filter(~F.startswith("field_name", F.lit("_")) & (F.coalesce(F.size("citations"), F.lit(0)) <= 0))


def overlaid(fields: DataFrame, model_values: DataFrame) -> DataFrame:
    """Values with the model's on top: an absent key keeps the rule's value, a present null stays null."""
    m = model_values.filter("present").select("parse_run_id", "field_name", F.col("value").alias("model_value"), F.lit(True).alias("given"))
    rows = fields.join(m, ["parse_run_id", "field_name"], "left")
    given = F.coalesce("given", F.lit(False))
    return rows.withColumn("value", F.when(given, F.col("model_value")).otherwise(F.col("value"))).withColumn(
        "warnings", F.when(given, F.array(F.lit("value from model"))).otherwise(F.array().cast("array<string>"))
    ).drop("model_value", "given")


def document_context(blocks: DataFrame, most: int = 60) -> DataFrame:
    """``[Page p, type]: text`` lines of a run's first blocks by rank."""
    order = Window.partitionBy("parse_run_id").orderBy("reading_order_rank")
    rows = blocks.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= most)
    line = F.concat(F.lit("[Page "), F.col("page"), F.lit(", "), F.col("type"), F.lit("]: "), F.col("text"))
    return rows.groupBy("parse_run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x.l), "\n").alias("context"))


def structured_prompt(blocks: DataFrame, schema_line: str) -> DataFrame:
    """The schema and every block by rank with its box."""
    b = F.col("bbox")
    line = F.format_string("Block page=%d bbox=[%.6f,%.6f,%.6f,%.6f]: %s", F.col("page"), b.x, b.y, b.w, b.h, F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("reading_order_rank", line.alias("l")))), lambda x: x.l)
    return blocks.groupBy("parse_run_id").agg(F.concat_ws("\n", F.lit(f"Extract fields matching this JSON schema: {schema_line}"), F.array_join(lines, "\n")).alias("prompt"))


# What the two region prompts say around the anchors.
_REGION = "Native PDF text in this region:\n"
_COPY = "Transcribe the complete content of this document region accurately. Preserve table structure, mathematical notation, and reading order."
_STRUCTURE = "Extract the complete structured content. For tables, output valid HTML table. For formulas, output LaTeX. Preserve all values exactly."


def region_prompts(regions: DataFrame) -> DataFrame:
    """Batch prompts of the regions that go to a model: anchors of their spans and an instruction by route."""
    lines = F.array_join(F.transform(F.filter("spans", lambda s: ~text.is_blank(s.text)), lambda s: text.anchor(s.text, s.bbox)), "\n")
    head = F.concat(F.lit(_REGION), lines, F.lit("\n\n"))
    structure = F.concat(head, F.lit("Region type: "), F.col("type"), F.lit("\n" + _STRUCTURE))
    prompt = F.when(F.col("route") == "mineru", structure).otherwise(F.concat(F.lit("<image>\n"), head, F.lit(_COPY)))
    return regions.filter("route <> 'paddleocr'").select("parse_run_id", "page", "block_id", "route", prompt.alias("prompt"))


def public_view(runs: DataFrame) -> DataFrame:
    """Extraction runs as callers see them: private metadata hidden, data only when complete."""
    status = F.when(F.col("status") == "succeeded", "complete").when(F.col("status").isin("queued", "running"), F.col("status")).otherwise("failed")
    rows = runs.withColumn("public_status", status)
    return rows.select(
        "run_id", F.col("public_status").alias("status"), F.when(F.col("public_status") == "complete", F.col("data")).alias("data"),
        F.map_filter("metadata", lambda k, _: ~F.startswith(k, F.lit("_"))).alias("metadata"), F.try_element_at("metadata", F.lit("_error")).alias("error"),
    )
