"""Text, label and symbol expressions."""

from __future__ import annotations

import html as html_entities

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from marketloom.functions import params as P
from marketloom.functions.numeric import col

SPACES = r"(?U)\s+"


def normalise_title(title: str | Column) -> Column:
    """Trim, lower-case, collapse whitespace."""
    return F.lower(F.trim(F.regexp_replace(col(title), SPACES, " ")))


def news_hash(ticker: str | Column, published_at: str | Column, title: str | Column,
              url: str | Column) -> Column:
    """Content hash of a headline."""
    iso = F.date_format(col(published_at), "yyyy-MM-dd'T'HH:mm:ssxxx")
    parts = [col(ticker), iso, normalise_title(title), F.trim(F.coalesce(col(url), F.lit("")))]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def trusted(publisher: str | Column, needles: list[str] | None = None) -> Column:
    """Publisher filter; an empty list switches it off."""
    needles = P.TRUSTED_PUBLISHERS if needles is None else needles
    return contains_any(F.lower(F.coalesce(col(publisher), F.lit(""))), needles) if needles else F.lit(True)


def credibility(publisher: str | Column) -> Column:
    """0..10 score, first matching rule wins."""
    name = F.lower(col(publisher))
    out = None
    for score, needles in P.CREDIBILITY_RULES:
        hit = contains_any(name, needles)
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(P.CREDIBILITY_DEFAULT)


def reclassify(name: str | Column, rules=None, default: int = P.RECLASSIFY_DEFAULT) -> Column:
    """Ordered ILIKE rules, first match wins."""
    out = None
    for pattern, value in rules or P.RECLASSIFY_RULES:
        hit = col(name).ilike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def label_from_compound(score: str | Column) -> Column:
    c = col(score)
    return F.when(c >= 0.05, "pos").when(c <= -0.05, "neg").otherwise("neu")


def label_from_probabilities(pos: str | Column, neg: str | Column, neu: str | Column) -> Column:
    """Strict maximum wins, otherwise neutral."""
    pos, neg, neu = col(pos), col(neg), col(neu)
    return (F.when((pos > neg) & (pos > neu), "pos")
            .when((neg > pos) & (neg > neu), "neg").otherwise("neu"))


def asset_class(symbol: str | Column) -> Column:
    s = F.upper(col(symbol))
    return (F.when(s.isin(P.CRYPTO_SYMBOLS), "Crypto")
            .when(s.isin(P.FUTURES_SYMBOLS), "Futures")
            .when(s.contains("=X") | s.isin(P.FOREX_SYMBOLS), "Forex")
            .when(s.isin(P.FUND_SYMBOLS), "Funds")
            .when(s.contains("^"), "Indices").otherwise("Stocks"))


def lookup(key: Column, table: dict) -> Column:
    """CASE over a small fixed map; NULL when the key is not in it."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def provider_symbol(symbol: str | Column) -> Column:
    """Daily-file provider: dotted symbols pass, known ones map, the rest get .US."""
    s = F.upper(F.trim(col(symbol)))
    return F.when(s.contains("."), s).otherwise(
        F.coalesce(lookup(s, P.PROVIDER_SYMBOLS), F.concat(s, F.lit(".US"))))


def gap_provider_symbol(symbol: str | Column) -> Column:
    """Gap-fill provider: lower-case symbols; NULL where it has no series."""
    s = F.upper(col(symbol))
    known = {k: v for k, v in P.GAP_PROVIDER_SYMBOLS.items() if v}
    return (F.when(s.isin(list(P.GAP_PROVIDER_SYMBOLS)), lookup(s, known))
            .when(s.contains("=X"), None).otherwise(F.concat(F.lower(s), F.lit(".us"))))


def display_name(symbol: str | Column) -> Column:
    return F.coalesce(lookup(col(symbol), P.DISPLAY_NAMES), col(symbol))


def search_term(symbol: str | Column, overrides: dict[str, str] | None = None) -> Column:
    return F.coalesce(lookup(col(symbol), {**P.SEARCH_TERMS, **(overrides or {})}), col(symbol))


def search_url(term: str | Column) -> Column:
    """Feed search URL with the whole query percent-encoded."""
    # url_encode leaves '*' and writes a blank as '+'; percent-quoting keeps '/' and '~'.
    q = F.url_encode(F.concat(col(term), F.lit(" market")))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return F.concat(F.lit("https://news.google.com/rss/search?q="), q,
                    F.lit("&hl=en-US&gl=US&ceid=US:en"))


def signed_pct(x: str | Column) -> Column:
    """'+1.25%', 'N/A' for NULL."""
    x = col(x)
    return F.coalesce(F.when(x.isNotNull(), F.format_string("%+.2f%%", x)), F.lit("N/A"))


def day_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "EEE MMM dd")


def clock_text(ts: str | Column) -> Column:
    return F.lower(F.date_format(col(ts), "hh:mma"))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html_entities.unescape, na_action="ignore")


# Fixed value: elements whose content is code, not text.
CODE_ELEMENTS = r"(?is)<(script|style)\b.*?</\1>"


def markup_to_text(raw: str | Column) -> Column:
    """Markup to one line of text: script/style bodies dropped, tags to blanks,
    entities decoded, no-break spaces and runs of whitespace to one blank."""
    no_code = F.regexp_replace(col(raw), CODE_ELEMENTS, " ")
    no_tags = F.regexp_replace(no_code, r"<[^>]+>", " ")
    plain = F.replace(_unescape(no_tags), F.lit("\u00a0"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def let(value: Column, use) -> Column:
    """Bind `value` once for an expression that uses it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# One character, then everything up to the next period before whitespace. The
# possessive loops keep long texts linear.
SENTENCE = r".[^.]*+(?:\.(?!\s)[^.]*+)*+(?:\.\s|$)"


def sentences(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(SENTENCE), 0)


def paragraphs(text: str | Column, per: int = 4) -> Column:
    """Sentences regrouped `per` at a time; nothing added, removed or reordered."""
    def group(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(per))
        grouped = F.transform(starts, lambda i: F.trim(F.array_join(F.slice(s, i + 1, per), "")))
        return F.when(F.size(s) > 0, grouped).otherwise(F.array().cast("array<string>"))
    return let(sentences(text), group)


def longest_section(text: str | Column, start: str, end: str, min_chars: int,
                    max_chars: int) -> Column:
    """The longest span from a start heading to the first end heading after it;
    NULL when there is none or its length lies outside the bounds. The two
    headings must not be able to share characters.

    Cutting the text at the end headings leaves pieces that each run up to one
    end; the longest span of a piece starts at its first start heading.
    """
    def longest(pieces: Column) -> Column:
        closed = F.slice(pieces, 1, F.size(pieces) - 1)
        spans = F.transform(closed, lambda p: F.regexp_extract(p, f"(?is){start}.*", 0))
        return F.trim(F.aggregate(spans, F.lit(""), lambda best, s: F.when(
            F.length(s) > F.length(best), s).otherwise(best)))

    def bounded(section: Column) -> Column:
        return F.when(F.length(section).between(max(min_chars, 1), max_chars), section)

    return let(let(F.split(col(text), f"(?i){end}", -1), longest), bounded)


# Headings of the business part of an annual report and its length bounds.
BUSINESS_START = r"Item\s*1\.?\s*[—–-]?\s*Business"
BUSINESS_END = r"Item\s*1A\.?\s*[—–-]?\s*Risk\s*Factors"
BUSINESS_CHARS = (3_000, 150_000)


def business_section(text: str | Column) -> Column:
    return longest_section(text, BUSINESS_START, BUSINESS_END, *BUSINESS_CHARS)
