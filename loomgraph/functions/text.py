"""Text functions as Column expressions; Python helpers only where no expression has the semantics."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, CJK stop characters, range of CJK characters and least lengths.
STOP_WORDS = """the is are was were be been being have has had do does did will would could should may might must shall
can need dare ought used to of in for on with at by from as into through during before after above below up down out off
over under again further then once and or but if while an no nor so yet either neither not only also too very just about
between there here when where why how all each every few more most other some such than this that these those it its they
them their we us our you your he him his she her my me what which who whom""".split()
STOP_CHARACTERS = list("的了是在和与或也都就还又把被让使给为对于从向由按这那其之而以及等但如若则")
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def normalize_entity(name: Column) -> Column:
    """Runs of Unicode white space become one space; trimmed and in lower case."""
    return F.lower(collapse_spaces(name))


def collapse_spaces(text: Column) -> Column:
    """Runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def relative_path(path: Column, root: str) -> Column:
    """Path below root, or the path itself when it is not below it."""
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/") + "/"), "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def confidence(raw: Column) -> Column:
    """One of the three labels; anything else is EXTRACTED."""
    label = F.upper(F.trim(raw))
    return F.when(label.isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), label).otherwise("EXTRACTED")


def description(raw: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(raw), F.lit("")), name)


def confidence_weight(label: Column) -> Column:
    return F.when(label == "INFERRED", 0.6).when(label == "AMBIGUOUS", 0.3).otherwise(1.0)


def confidence_rank(label: Column) -> Column:
    return F.when(label == "EXTRACTED", 0).when(label == "INFERRED", 1).otherwise(2)


def keyword_tokens(text: Column) -> Column:
    """Distinct ASCII words but for stop words, digit runs of three or more, and single CJK characters."""
    text = F.coalesce(text, F.lit(""))
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_]+"), F.lit(0)), F.lower)
    digits = F.regexp_extract_all(text, F.lit(r"(?U)\d{3,}"), F.lit(0))
    cjk = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    kept = F.concat(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), digits, F.array_except(cjk, F.array(*map(F.lit, STOP_CHARACTERS))))
    return F.array_distinct(kept)


def node_keywords(name: Column, about: Column) -> Column:
    """The whole name unless it is a stop word, and the tokens of name and description."""
    whole = F.lower(F.trim(name))
    own = F.when((whole != "") & ~whole.isin(STOP_WORDS), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, keyword_tokens(name), keyword_tokens(about)))


def sentences(text: Column) -> Column:
    """Cut after sentence ends and line ends; trimmed, without empty ones."""
    parts = F.split(text, r"(?<=[。.!！?？;；\n])\s*")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\^\[([^\]]+)\]"), F.lit(1))


def community_summary(members: Column, size: Column) -> Column:
    head = F.array_join(F.slice(members, 1, 10), ", ")
    return F.concat(F.lit("Community of: "), head, F.when(size > 10, F.concat(F.lit(" 等 "), size.cast("string"), F.lit(" 个节点"))).otherwise(""))


def schema_number(version: Column) -> Column:
    return F.coalesce(version.try_cast("int"), F.lit(0))


def render_hit(triple: Column, concept: Column, summary: Column) -> Column:
    """One line of context; empty for a hit without content."""
    edge = F.concat(F.lit("["), triple["head"], F.lit("]--"), triple["relation"], F.lit("-->["), triple["tail"], F.lit("] (来源:"), triple["source_file"], F.lit(")"))
    node = F.concat(F.lit("["), concept["name"], F.lit("] "), F.coalesce(concept["description"], F.lit("")), F.lit(" (来源:"), concept["source_file"], F.lit(")"))
    bare = F.concat(F.lit("[社区摘要] "), summary)
    return F.when(triple.isNotNull(), edge).when(concept.isNotNull(), node).when(summary.isNotNull(), bare).otherwise("")


def review_fields(body: Column) -> Column:
    """question, reason, entities and time of a review line; the question may hold the separator."""
    part = lambda i: F.regexp_extract(body, r"^- \[ \] (.*) \| (.*?) \| (.*?) \| ([^|]*)$", i)
    return F.struct(part(1).alias("question"), part(2).alias("reason"), part(3).alias("entities"), F.trim(part(4)).alias("ts"))


def length_band(size: Column, cutoff: float) -> tuple[Column, Column]:
    """Lengths that a similar name can have: 2 * M / (a + b) >= cutoff with M <= min(a, b)."""
    low = F.greatest(F.lit(1), F.ceil(size * cutoff / (2 - cutoff) - 1e-9))
    return low.cast("int"), F.floor(size * (2 - cutoff) / cutoff + 1e-9).cast("int")


def elapsed(seconds: float | None) -> str:
    """45s, 2m 15s or 1h 3m; 未知 when unknown."""
    if seconds is None or math.isnan(seconds):
        return "未知"
    whole = max(0, int(seconds))
    if whole < 60:
        return f"{whole}s"
    return f"{whole // 60}m {whole % 60}s" if whole < 3600 else f"{whole // 3600}h {whole % 3600 // 60}m"


def elapsed_label(seconds: Column) -> Column:
    """`elapsed` as a native expression."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    part = lambda x, unit: F.concat(x.cast("long").cast("string"), F.lit(unit))
    minutes, hours = F.floor(whole / 60), F.floor(whole / 3600)
    return (
        F.when(seconds.isNull() | F.isnan(seconds.cast("double")), "未知").when(whole < 60, part(whole, "s"))
        .when(whole < 3600, F.concat_ws(" ", part(minutes, "m"), part(whole % 60, "s"))).otherwise(F.concat_ws(" ", part(hours, "h"), part(minutes % 60, "m")))
    )


def parse_json_loose(raw: str | None) -> dict | None:
    """The text as a JSON object, else the object that starts at its first brace; None if neither is one."""
    if not raw:
        return None
    try:
        found = json.loads(raw)
    except ValueError:
        try:
            found, _ = json.JSONDecoder().raw_decode(raw, raw.index("{"))
        except ValueError:
            return None
    return found if isinstance(found, dict) else None
