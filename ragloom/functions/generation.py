"""Expressions of the answer stage: citations, costs, failure classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cited_ids(answer: Column) -> Column:
    """Source ids (S and digits) inside square brackets, each once, in order of first appearance."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"S(\d+)"), F.lit(0)))))


def cost_usd(input_tokens: Column, output_tokens: Column, input_price: float = 0.75, output_price: float = 3.75) -> Column:
    """Price of a call; prices are per million tokens."""
    return input_tokens / 1e6 * input_price + output_tokens / 1e6 * output_price


def failure_class(kind: Column, message: Column, authentication: Column) -> Column:
    """Class reported for a failed call of kind validation, rate-limit, transient or permanent."""
    return (
        F.when(kind == "validation", "internal")
        .when(kind == "rate-limit", "quota")
        .when((kind == "transient") & message.rlike("(?i)timed out"), "timeout")
        .when(kind == "transient", "provider")
        .when((kind == "permanent") & authentication, "authentication")
        .otherwise("internal")
    )


def provider_error_kind(status: Column, message: Column) -> Column:
    """Kind of a provider's error from its HTTP status and message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 429) | text.rlike("quota|rate limit|resource exhausted"), "rate-limit")
        .when(status.isin(401, 403) | text.rlike("api key|unauthorized|permission"), "permanent")
        .when((status >= 500) | text.rlike("network|timed out|timeout|econnreset|socket|fetch failed"), "transient")
        .otherwise("permanent")
    )


def retry_after_ms(header: Column) -> Column:
    """Delay of a Retry-After header in seconds; null for dates, negative and unreadable values."""
    value = header.try_cast("double")
    return F.when((value >= 0) & ~F.isnan(value), value * 1000)
