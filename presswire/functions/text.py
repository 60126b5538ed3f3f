"""Text clean-up, HTML text, slugs and embedding text, as Column expressions."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import constants as C

SPACES = r"(?U)[\s\x1c-\x1f]+"
_EDGE_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Letters whose full case folding gives ASCII letters that plain lower-casing
# does not (fixed values of the Unicode case-folding rules).
_FOLDS = [
    ("ß", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
    ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("ẖ", "ẖ"), ("ẗ", "ẗ"),
    ("ẘ", "ẘ"), ("ẙ", "ẙ"), ("ẚ", "aʾ"), ("ς", "σ"),
]


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(text, _EDGE_SPACES, "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def excerpt(text: Column, chars: int = C.BODY_EXCERPT_CHARS) -> Column:
    return F.substring(collapse(text), 1, chars)


def casefold(text: Column) -> Column:
    folded = F.lower(F.replace(text, F.lit("ẞ"), F.lit("ss")))
    for letter, ascii_form in _FOLDS:
        folded = F.replace(folded, F.lit(letter), F.lit(ascii_form))
    return folded


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """Decode HTML entities. Only text holding ``&`` is sent to Python."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")


def strip_html(text: Column) -> Column:
    return unescape(drop_tags(text))


@F.pandas_udf(ArrayType(StringType()))
def _unescape_each(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else [html.unescape(t) for t in b])


def main_text(page: Column) -> Column:
    """Paragraph text of a page: scripts and styles out, tags stripped, joined."""
    body = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    blocks = F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    # nearly every page holds an entity, so all are sent and matched once
    plain = _unescape_each(F.transform(blocks, lambda b: F.regexp_replace(b, r"<[^>]+>", " ")))
    paragraphs = F.filter(F.transform(F.coalesce(plain, F.array().cast("array<string>")), collapse), lambda p: p != "")
    return F.array_join(paragraphs, " ")


def slugify(title: Column) -> Column:
    base = F.regexp_replace(
        F.regexp_replace(casefold(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""
    )
    cut = F.substring(base, 1, C.SLUG_MAX_CHARS)
    short = F.regexp_replace(F.regexp_replace(cut, r"-[^-]*$", ""), r"^-+|-+$", "")
    slug = F.when(F.length(base) <= C.SLUG_MAX_CHARS, base).otherwise(short)
    return F.when(slug == "", F.lit("story")).otherwise(slug)


def topic_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def with_body(title: Column, body: Column) -> Column:
    """Title, newline, body; the title alone when there is no body."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(title, F.lit("\n"), body)).otherwise(title)


def embed_text(title: Column, body_excerpt: Column, chars: int = C.EMBED_CHARS) -> Column:
    return with_body(title, strip(F.substring(body_excerpt, 1, chars)))


def match_text(headline: Column, summary: Column) -> Column:
    return with_body(headline, strip(F.coalesce(summary, F.lit(""))))


def normalize_email(value: Column) -> Column:
    """Trimmed, lower-case address, or NULL when it cannot be delivered to."""
    email = F.lower(strip(value))
    local = F.regexp_extract(email, r"^([^@]*)@", 1)
    domain = F.regexp_extract(email, r"^[^@]*@([^@]*)$", 1)
    low, high = C.EMAIL_CHARS
    ok = (
        F.length(email).between(low, high)
        & ~email.rlike(r"(?U)\s")
        & email.rlike(r"^[^@]*@[^@]*$")
        & F.length(local).between(1, C.EMAIL_LOCAL_CHARS)
        & F.contains(domain, F.lit("."))
        & ~domain.startswith(".")
        & ~domain.endswith(".")
        & ~F.contains(domain, F.lit(".."))
    )
    return F.when(ok, email)
