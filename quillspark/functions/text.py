"""Text as columns: lexemes, normalised content, screens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def lexemes(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order and with repeats; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def or_tokens(text: Column) -> Column:
    """Distinct runs of letters, digits, hyphens and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}_-]+)"), F.lit(1)))


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, with runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; blank text has the empty hash."""
    return F.transform(F.array(normalised(text)), lambda t: F.when(t == "", "").otherwise(F.sha2(t, 256)))[0]  # the lambda's value is made once


def token_estimate(text: Column) -> Column:
    """A quarter of the characters: the stand-in where no vocabulary is at hand."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def plain_html(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, headers and footers; white space collapsed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer|header|noscript)\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of anchors, quoted or not, in order; empty ones and fragments skipped."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    bare = F.transform(found, lambda x: F.trim(F.replace(F.regexp_replace(x, r"""(?s)^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))))
    return F.filter(bare, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an absolute http(s) address, without fragment, seen from a page's address; null for others."""
    base, target = F.regexp_replace(base, "[#].*$", ""), F.regexp_replace(target, "[#].*$", "")
    scheme, origin = F.regexp_extract(base, "^(https?):", 1), F.regexp_extract(base, "^(https?://[^/?]*)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?]*([^?]*)", 1)
    own = F.regexp_extract(target, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", 0)
    folder = F.regexp_replace(path, "[^/]*$", "")
    full = (
        F.when(F.lower(own).isin("http:", "https:") & F.contains(target, F.lit("//")), target)
        .when((own != "") | (origin == ""), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )
    return _without_dots(full)


def _without_dots(url: Column) -> Column:
    """An address whose path has no . and .. steps."""
    origin, query = F.regexp_extract(url, r"^([a-zA-Z]+://[^/?]*)", 1), F.regexp_extract(url, r"(\?.*)$", 1)
    steps = F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?]*/?([^?]*)", 1), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    plain = F.concat(origin, F.when(url.rlike(r"^[a-zA-Z]+://[^/?]*/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(""), query)
    return F.when(url.rlike(r"/\.{1,2}(/|$|\?)"), plain).otherwise(url)
