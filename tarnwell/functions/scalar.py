"""Column functions used across operators. All stay inside the JVM."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of tickers, secrets and fenced answers.
TICKER = r"^[A-Z0-9.^=_-]{1,24}$"
TOKEN_PATTERN = r"(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{8,}"
BEARER_PATTERN = r"(?i)Bearer\s+[A-Za-z0-9._-]+"
SECRET_KEY = r"(?i)key|token|secret|password|authorization"
FENCE = r"(?is)^```(?:json)?\s*\n?(.*?)\n?```$"


def finite(x: Column, positive: bool = False) -> Column:
    """x, or null where it is missing, NaN, infinite or (if asked) not above 0."""
    x = x.cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(fine & (x > 0) if positive else fine, x)


def r6(x: Column) -> Column:
    """Six decimals and no negative zero, so that results compare across engines."""
    return F.round(x, 6) + F.lit(0.0)


def ticker(x: Column) -> Column:
    """Trimmed upper-case ticker, or null where it has another shape."""
    t = F.upper(F.trim(x))
    return F.when(t.rlike(TICKER), t)


def normalized(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, joined by one space."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_]++", " "))


def title_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w != ""))


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """``text`` without token shapes and without the given secret values (see ``secret_values``)."""
    for value in secrets:
        text = F.replace(text, F.lit(value), F.lit("[REDACTED]"))
    return F.regexp_replace(F.regexp_replace(text, TOKEN_PATTERN, "[REDACTED]"), BEARER_PATTERN, "Bearer [REDACTED]")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def unfenced(text: Column) -> Column:
    """The body of an answer that is wholly one code fence, else the trimmed text."""
    t = F.trim(text)
    return F.when(t.rlike(FENCE), F.trim(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def error_category(status: Column, provider: str = "research") -> Column:
    """Category of a provider's HTTP status; null status is a connection failure. ``generation`` tells servers and access apart."""
    x = F.when(status.isNull(), "connection").when(status == 429, "rate_limit")
    if provider == "generation":
        x = x.when(status >= 500, "server").when(status.isin(401, 403), "authentication")
    else:
        x = x.when(status.isin(408, 409, 498) | (status >= 500), "connection")
    return x.otherwise("invalid_request")


def parsed_output(text: Column) -> Column:
    """Body of an answer, plain or in one whole fence, if it is a JSON object; NaN and infinities are no JSON."""
    body = unfenced(text)
    return F.when(F.try_parse_json(body).isNotNull() & F.ltrim(body).startswith("{"), body)


def redacted_values(values: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A map without secrets: whole values under secret-like keys, tokens and given secrets elsewhere."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("[REDACTED]")).otherwise(redacted(v, secrets)))


def redacted_json(text: Column, secrets: tuple[str, ...] = (), depth: int = 8) -> Column:
    """A JSON text without secrets at any depth: values under secret-like keys whole, tokens and given secrets within texts.

    The text is taken apart as VARIANT, object by object and list by list, and put together again. Lists and objects nested more than
    ``depth`` deep go whole. Keys come out in order. Text that is no JSON is redacted as a text and becomes a JSON string.
    """
    gone = "parse_json('\"[REDACTED]\"')"

    def level(v: Column, left: int) -> Column:
        kind = F.schema_of_variant(v)
        words = F.parse_json(F.to_json(redacted(F.try_variant_get(v, "$", "string"), secrets).cast("variant")))
        if not left:
            return F.when(kind == "STRING", words).when(kind.rlike("^(OBJECT|ARRAY)"), F.expr(gone)).otherwise(v)
        keyed = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(F.lit(None).cast("string").alias("k"), e.alias("v")))
        parts = F.when(kind.startswith("OBJECT"), keyed).otherwise(listed)
        done = F.transform(parts, lambda e: F.struct(e["k"].alias("k"), F.when(e["k"].rlike(SECRET_KEY), F.expr(gone)).otherwise(level(e["v"], left - 1)).alias("v")))
        put = F.transform(F.array(done), lambda x: F.when(kind.startswith("OBJECT"), F.to_variant_object(F.map_from_entries(x)).cast("variant")).otherwise(F.to_variant_object(F.transform(x, lambda e: e["v"])).cast("variant")))[0]
        return F.when(kind == "STRING", words).when(kind.rlike("^(OBJECT|ARRAY)"), put).otherwise(v)

    v = F.coalesce(F.try_parse_json(text), text.cast("variant"))
    return F.to_json(level(v, depth))


def secret_values() -> tuple[str, ...]:
    """Values of this process's environment variables that have secret-like names, longest first."""
    return tuple(sorted({v for k, v in os.environ.items() if v and re.search(SECRET_KEY, k)}, key=lambda v: (-len(v), v)))
