"""From raw model text to typed tags, and tags made consistent per video."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmill.functions.columns import first_truthy, named, once, round_even, truthy
from reelmill.schemas import (
    CORE_TAG_FIELDS,
    DEFAULT_TOPIC,
    PARSE_ERROR_CHARS,
    PROMPT_OCR_SILENT_CHARS,
    PROMPT_OCR_VOICE_CHARS,
    PROMPT_TEXT_CHARS,
    RULE_GRADE,
    RULE_SUBJECT,
    RULE_SUMMARY,
    RULE_WORD,
    TAG_STRING_FIELDS,
)

KEY = "video_no"
TEXTS = "array<string>"
STORED_FLAGS = ("_parse_error", "_recovered", "_retried", "confidence_defaulted", "scenes", "objects", "captions")
# A JSON number, text in quotes or a JSON literal counts as a value; single quotes are not JSON.
STRICT_JSON = {"allowSingleQuotes": "false"}


def json_body(raw: Column) -> Column:
    """Text from the first ``{`` on, without code fences; NULL when there is none."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"^\s*```(?:json)?|```\s*$", "")
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*)", 1), F.lit(""))


def _strict(candidate: Column) -> Column:
    """One JSON object and nothing else as a map of its values, else NULL.

    Wrapped in brackets, trailing text or a second object is a syntax error or a second element. The text is parsed once.
    """
    rows = F.from_json(F.concat(F.lit("["), candidate, F.lit("]")), "array<map<string,string>>", STRICT_JSON)
    return named(rows, lambda r: F.when(F.size(r) == 1, _last_of_each(F.get(r, F.lit(0)))))


def _last_of_each(fields: Column) -> Column:
    """The map with the last value of a repeated key."""
    keys, values = F.map_keys(fields), F.map_values(fields)
    last = F.filter(F.sequence(F.lit(1), F.size(keys)), lambda i: ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.get(keys, i - 1)))
    pairs = F.transform(last, lambda i: F.struct(F.get(keys, i - 1), F.get(values, i - 1)))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(pairs)).otherwise(fields)


def strict_fields(body: Column) -> Column:
    """Fields of the first way to close the text that is valid: as is, ``}``, ``"}``, ``"}}``, or cut at the last ``}``.

    A failed parse is costly, so ways that cannot be valid are left out first: an object ends in a brace, and its
    unescaped quotes come in pairs.
    """
    unescaped = F.replace(F.replace(body, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    open_quote = (F.length(unescaped) - F.length(F.replace(unescaped, F.lit('"'), F.lit("")))) % 2 == 1
    closed = F.regexp_like(body, F.lit(r"\}\s*$"))
    # a text that is cut inside a string can only be closed where the string is the value of a key
    in_value = open_quote & F.regexp_like(body, F.lit(r':\s*"(?:[^"\\]++|\\.)*+$'))
    cut = F.regexp_extract(body, r"(?s)^(.*\})", 1)
    return F.coalesce(
        F.when(closed & ~open_quote, _strict(body)),
        F.when(~open_quote, _strict(F.concat(body, F.lit("}")))),
        F.when(in_value, _strict(F.concat(body, F.lit('"}')))),
        F.when(in_value, _strict(F.concat(body, F.lit('"}}')))),
        F.when(~closed & (cut != ""), _strict(cut)),
    )


def _grab_text(body: Column, key: str, pattern: str) -> Column:
    found = rf'"{key}"\s*:\s*{pattern}'
    return F.when(F.regexp_like(body, F.lit(found)), F.regexp_extract(body, found, 1))


def _grab_list(body: Column, key: str) -> Column:
    items = F.transform(
        F.split(_grab_text(body, key, r"\[((?s:.*?))\]"), ","),
        lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), '^"+|"+$', ""),
    )
    return F.filter(items, lambda x: x != "")


def recovered_fields(body: Column) -> Column:
    """Completed fields of a truncated object, found one by one; missing ones are absent."""
    found = {k: _grab_text(body, k, '"([^"]*)"') for k in TAG_STRING_FIELDS}
    found["confidence"] = _grab_text(body, "confidence", r"([0-9]*\.?[0-9]+)")
    found["has_visual_content"] = _grab_text(body, "has_visual_content", "(true|false)")
    pairs = F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def parse_model_json(raw: Column, body: Column, strict: Column, rec: Column) -> Column:
    """Parsed answer: ``status`` (strict / recovered / error), ``fields``, ``tags``, ``subtopics``, ``error``."""
    usable = truthy(rec["topic"]).isNotNull() | truthy(rec["summary"]).isNotNull()
    none = F.lit(None)

    def row(status: str, error: Column, fields: Column, tags: Column, subtopics: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            error.cast("string").alias("error"),
            fields.cast("map<string,string>").alias("fields"),
            tags.cast(TEXTS).alias("tags"),
            subtopics.cast(TEXTS).alias("subtopics"),
        )

    return (
        F.when(
            strict.isNotNull(),
            row("strict", none, strict, F.from_json(strict["tags"], TEXTS), F.from_json(strict["subtopics"], TEXTS)),
        )
        .when(
            body.isNotNull() & usable,
            row("recovered", none, rec, _grab_list(body, "tags"), _grab_list(body, "subtopics")),
        )
        .otherwise(row("error", F.substring(raw, 1, PARSE_ERROR_CHARS), none, none, none))
    )


def with_parsed(answers: DataFrame, raw: str, out: str) -> DataFrame:
    """Add the parsed struct of column ``raw``; every text is parsed once."""
    col = F.col(raw)

    def read(body: Column) -> Column:
        return named(strict_fields(body), lambda strict: with_fallback(body, strict))

    def with_fallback(body: Column, strict: Column) -> Column:
        # the fallback runs only where the strict parse failed
        failed = body.isNotNull() & strict.isNull()
        return named(F.when(failed, recovered_fields(body)), lambda rec: parse_model_json(col, body, strict, rec))

    return once(answers, out, named(json_body(col), read))


def finalize_tags(parsed: Column, is_silent: Column) -> Column:
    """Typed tag fields with defaults; an error keeps only its text."""
    ok = parsed["status"] != "error"
    text_given = parsed["fields"]["confidence"]
    # a bare true or false is a number too
    given = F.when(text_given == "true", 1.0).when(text_given == "false", 0.0).otherwise(text_given.try_cast("double"))
    default = F.when(is_silent, 0.5).otherwise(0.7)
    conf = F.coalesce(round_even(given, 2), default)
    fields = parsed["fields"]
    empty = F.array().cast(TEXTS)

    def text(k: str) -> Column:
        return fields[k].alias(k)

    return F.struct(
        parsed["status"].alias("status"),
        parsed["error"].alias("error"),
        *[text(k) for k in TAG_STRING_FIELDS],
        F.when(ok, F.coalesce(parsed["tags"], empty)).alias("tags"),
        F.when(ok, F.coalesce(parsed["subtopics"], empty)).alias("subtopics"),
        F.when(ok, F.when(is_silent, F.least(conf, F.lit(0.6))).otherwise(conf)).alias("confidence"),
        F.when(ok, given.isNull()).alias("confidence_defaulted"),
        F.map_filter(fields, lambda k, _: ~k.isin(*CORE_TAG_FIELDS)).alias("extra"),
    )


def retry_merge(first: Column, second: Column) -> Column:
    """The second attempt counts only when the first failed and it parsed; otherwise the first stands."""
    retried = (first["status"] == "error") & F.coalesce(second["status"] != "error", F.lit(False))
    return F.struct(F.when(retried, second).otherwise(first).alias("tags"), retried.alias("retried"))


def tag_answers(answers: DataFrame) -> DataFrame:
    """Raw answers (``raw_1``, ``raw_2``, ``is_silent``) to typed rows, one per segment."""
    parsed = with_parsed(answers, "raw_1", "p1")
    # only a failed first attempt can be replaced, so only its second answer is parsed
    parsed = parsed.withColumn("raw_2", F.when(F.col("p1.status") == "error", F.col("raw_2")))
    parsed = with_parsed(parsed, "raw_2", "p2")
    second = F.when(F.col("raw_2").isNotNull(), F.col("p2"))
    merged = retry_merge(F.col("p1"), second)
    typed = once(parsed.withColumn("retried", merged["retried"]), "t", finalize_tags(merged["tags"], F.col("is_silent")))
    return typed.select(KEY, "seg_index", "is_silent", "t.*", "retried")


def parse_status_report(tagged: DataFrame) -> DataFrame:
    """How many answers parsed strictly, were recovered, retried, failed, or had their confidence defaulted."""
    return tagged.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("retried").alias("retried"),
        F.count_if(F.coalesce("confidence_defaulted", F.lit(False))).alias("defaulted"),
    )


def recover_failed_rows(stored: DataFrame) -> DataFrame:
    """Second chance for stored parse errors (``parse_error`` text): whatever fields can still be read, empties dropped."""
    keys = ["topic", "subject", "grade_level", "difficulty", "content_type", "summary"]
    failed = once(stored.where(F.col("parse_error").isNotNull()), "_body", json_body(F.col("parse_error")))
    failed = once(failed, "_strict", strict_fields(F.col("_body")))
    failed = once(failed, "_rec", F.when(F.col("_strict").isNull(), recovered_fields(F.col("_body"))))
    rec = F.col("_rec")
    is_strict = F.col("_strict").isNotNull()
    return failed.select(
        *[c for c in stored.columns if c != "parse_error"],
        *[F.when(is_strict, F.col("_strict")[k]).otherwise(truthy(rec[k])).alias(k) for k in keys],
        F.coalesce(
            F.when(is_strict, F.from_json(F.col("_strict")["tags"], TEXTS)).otherwise(_grab_list(F.col("_body"), "tags")),
            F.array().cast(TEXTS),
        ).alias("tags"),
    )


def stored_extra(tagged: DataFrame) -> Column:
    """What isn't a core column, as one map: other fields of the answer, how it was read, and the visual evidence as JSON."""

    def flag(name: str, holds: Column, text: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("key"), F.when(holds, F.lit("true") if text is None else text).alias("value"))

    have = set(tagged.columns)
    kept = F.coalesce(F.map_filter("extra", lambda k, _: ~k.isin(*STORED_FLAGS)), F.create_map().cast("map<string,string>"))
    evidence = [
        flag(c, F.lit(True), F.to_json(F.coalesce(F.col(c), F.array().cast(TEXTS))) if c in have else F.lit("[]"))
        for c in ("scenes", "objects", "captions")
    ]
    flags = F.array(
        flag("_parse_error", F.col("status") == "error", F.coalesce("error", F.lit(""))),
        flag("_recovered", F.col("status") == "recovered"),
        flag("_retried", F.col("retried") if "retried" in have else F.lit(False)),
        flag("confidence_defaulted", F.col("confidence_defaulted")),
        *evidence,
    )
    return F.map_concat(kept, F.map_from_entries(F.filter(flags, lambda x: x["value"].isNotNull())))


def project_typed_columns(tagged: DataFrame, dim: int) -> DataFrame:
    """Stored segment row: nine core columns, everything else in ``llm_extra``; a missing vector becomes zeros.

    Failed answers are stored too, with empty fields and their text in ``llm_extra``, where :func:`recover_failed_rows` finds it.
    """
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    vector = F.coalesce(F.col("embedding"), zero) if "embedding" in tagged.columns else zero
    empty = F.array().cast(TEXTS)
    return tagged.select(
        KEY,
        "seg_index",
        *[c for c in CORE_TAG_FIELDS if c not in ("tags", "subtopics")],
        F.coalesce("tags", empty).alias("tags"),
        F.coalesce("subtopics", empty).alias("subtopics"),
        stored_extra(tagged).alias("llm_extra"),
        vector.alias("embedding"),
    )


def dominant_value(segments: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Per video and field: the most common value; when the top count is shared, the value of the most confident segment.

    On a shared count the most confident segment is taken among all valued segments, earliest first. Result: one
    column per field. Every step combines map-side, so a video arrives at the shuffle as its distinct values.
    """
    fields = fields or {"subject": "subject", "grade": "grade_level"}
    facets = [
        F.when(truthy(F.col(col)).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(col).alias("value")))
        for name, col in fields.items()
    ]
    confidence, seg = F.coalesce("confidence", F.lit(0.0)), F.col("seg_index")
    values = (
        segments.select(KEY, seg, confidence.alias("confidence"), F.inline(F.array_compact(F.array(*facets))))
        .groupBy(KEY, "facet", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("confidence", (-seg).alias("at"))).alias("best"))
    )
    by_count = values.groupBy(KEY, "facet", "n").agg(
        F.count(F.lit(1)).alias("sharing"), F.max("value").alias("value"), F.max(F.struct("best", "value")).alias("best")
    )
    # with an unshared top count, "value" is the only value of that count
    tops = by_count.groupBy(KEY, "facet").agg(F.max(F.struct("n", "sharing", "value")).alias("top"), F.max("best").alias("best"))
    value = F.when(F.col("top.sharing") > 1, F.col("best.value")).otherwise(F.col("top.value"))
    return tops.groupBy(KEY).agg(
        *[F.max(F.when(F.col("facet") == name, value)).alias(f"dominant_{name}") for name in fields]
    )


def consistency_pass(segments: DataFrame) -> DataFrame:
    """Replace divergent subjects and grades by the video's dominant ones, keeping the originals in ``*_raw``."""
    for c in ("subject_raw", "grade_level_raw"):
        if c not in segments.columns:
            segments = segments.withColumn(c, F.lit(None).cast("string"))
    joined = segments.join(dominant_value(segments), KEY, "left")

    def differs(col: str, dom: str) -> Column:
        return truthy(F.col(dom)).isNotNull() & truthy(F.col(col)).isNotNull() & (F.col(col) != F.col(dom))

    s, g = differs("subject", "dominant_subject"), differs("grade_level", "dominant_grade")
    return joined.withColumns(
        {
            "subject_raw": F.when(s, F.col("subject")).otherwise(F.col("subject_raw")),
            "subject": F.when(s, F.col("dominant_subject")).otherwise(F.col("subject")),
            "grade_level_raw": F.when(g, F.coalesce("grade_level_raw", "grade_level")).otherwise(F.col("grade_level_raw")),
            "grade_level": F.when(g, F.col("dominant_grade")).otherwise(F.col("grade_level")),
        }
    ).drop("dominant_subject", "dominant_grade")


def prompt_inputs(segments: DataFrame) -> DataFrame:
    """Evidence text handed to a tagging model: the transcript first, or the visual evidence of a silent segment."""
    hints = F.concat(
        F.lit("scenes: "), F.array_join("scenes", ", "), F.lit("; objects: "), F.array_join("objects", ", ")
    )
    voice = F.concat(
        F.lit("transcript: "), F.substring("text", 1, PROMPT_TEXT_CHARS), F.lit("\nscreen text: "), F.substring("ocr", 1, PROMPT_OCR_VOICE_CHARS),
        F.lit("\nweak hints: "), hints,
    )
    silent = F.concat(
        F.lit("screen text: "), F.substring("ocr", 1, PROMPT_OCR_SILENT_CHARS), F.lit("\ncaptions: "), F.array_join("captions", ", "),
        F.lit("\n"), hints,
    )
    return segments.select(KEY, "seg_index", F.when(F.col("is_silent"), silent).otherwise(voice).alias("evidence"))


def _title(word: Column) -> Column:
    """Capital after every non-letter, as in "Don'T" and "Well-Known"."""
    spaced = F.regexp_replace(word, "(['-])", "$1 ")
    return F.regexp_replace(F.initcap(spaced), "(['-]) ", "$1")


def rule_tagger(segments: DataFrame) -> DataFrame:
    """Deterministic tags from the first words of the transcript (or the first line of screen text when silent)."""
    line = F.regexp_extract(F.substring("ocr", 1, PROMPT_OCR_SILENT_CHARS), r"^\s*([^\n]*)", 1)
    source = F.when(F.col("is_silent"), line).otherwise(F.substring("text", 1, PROMPT_TEXT_CHARS))
    found = F.slice(F.regexp_extract_all(source, F.lit(RULE_WORD), F.lit(0)), 1, 6)
    tagged = segments.select(KEY, "seg_index", "is_silent", found.alias("w"))
    topic = first_truthy(F.array_join(F.transform(F.slice("w", 1, 4), _title), " "), F.lit(DEFAULT_TOPIC))
    lower = F.transform("w", F.lower)
    silent = F.col("is_silent")
    return tagged.select(
        KEY,
        "seg_index",
        topic.alias("topic"),
        F.slice(lower, 1, 3).alias("subtopics"),
        F.when(silent, "animation").otherwise("lecture").alias("content_type"),
        F.lit("beginner").alias("difficulty"),
        F.lit(RULE_GRADE).alias("grade_level"),
        F.lit(RULE_SUBJECT).alias("subject"),
        F.concat(F.lit(RULE_SUMMARY), topic, F.lit(".")).alias("summary"),
        F.slice(lower, 1, 5).alias("tags"),
        F.when(silent, "narrator").otherwise("teacher").alias("speaker_role"),
        F.lit("en").alias("language"),
        F.lit(True).alias("has_visual_content"),
        F.when(silent, 0.5).otherwise(0.7).alias("confidence"),
    )


def apply_model(
    rows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str
) -> DataFrame:
    """Run a caller-supplied tagging or embedding model over Arrow batches.

    ``model`` gets the iterator of a whole partition, so it loads its weights once and then streams batches.
    """
    return rows.mapInPandas(model, schema)
