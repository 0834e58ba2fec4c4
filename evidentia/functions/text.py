"""Text functions over columns; all but html_unescape stay in the JVM."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that carry no search intent.
STOP_WORDS = ("a", "an", "and", "at", "by", "find", "in", "is", "it", "of", "on", "scene", "the", "to", "when", "where", "with")
#: Words that ask for something to be seen.
VISUAL_CUES = ("appearance", "butterfly", "color", "flowers", "forest", "hide", "look", "scene", "see", "tree", "visual", "wear")
TOKEN = r"[a-z0-9']+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Words without stop words, in order, repeats kept."""
    return F.filter(words(text), lambda t: ~t.isin(*STOP_WORDS))


def normalized(text: Column) -> Column:
    return F.array_join(words(text), " ")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def stripped(text: Column) -> Column:
    """Tags out, music notes out, white space collapsed; entities must be unescaped before."""
    return collapsed(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), "♪", ""))


def cleaned(text: Column) -> Column:
    return stripped(html_unescape(text))


def meaningful(text: Column) -> Column:
    """Four words or more, and not wholly in parentheses."""
    return (F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z']+"), F.lit(0))) >= 4) & ~(F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")))


def contains_all(text: Column, query: Column) -> Column:
    """Every space-separated term of the query is in the text, whatever the case; false for a query without terms."""
    terms = F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")
    low = F.lower(text)
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(low, t))


def route(query: Column, has_dialogue: Column) -> Column:
    """struct(use_text, use_image, top_k, inspect_budget, context_radius) of a query."""
    seen = F.arrays_overlap(F.split(F.translate(F.lower(query), "?.", ""), r"\s+"), F.array(*map(F.lit, VISUAL_CUES)))
    visual = seen | ~has_dialogue
    return F.struct(
        has_dialogue.alias("use_text"), F.lit(True).alias("use_image"), F.when(visual, 6).otherwise(5).alias("top_k"),
        F.when(visual, 3).otherwise(2).alias("inspect_budget"), F.lit(1).alias("context_radius"),
    )


def padded_id(prefix: str, number: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}_%0{width}d", number)


def tool_call(text: Column) -> Column:
    """JSON of a tool call in free text (from the first brace to the last), null unless it has a tool and an object of arguments."""
    raw = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = F.get_json_object(raw, "$.tool").isNotNull() & F.startswith(F.ltrim(F.coalesce(F.get_json_object(raw, "$.arguments"), F.lit(""))), F.lit("{"))
    return F.when(ok, raw)


def leaks_labels(text: Column, names: tuple[str, ...] = ("target_segments", "saliency_scores", "reward_parts", "evidence")) -> Column:
    """Whether a serialized prompt names a label field."""
    out = F.lit(False)
    for n in names:
        out = out | F.contains(text, F.lit(f'"{n}"'))
    return out
