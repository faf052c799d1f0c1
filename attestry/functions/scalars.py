"""Small scalar functions: rounding, cursors, hashes, ages, formats, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(col: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(col + 0.5)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def truthy(col: Column, default) -> Column:
    """``col`` unless it is null or zero."""
    return F.coalesce(F.nullif(col, F.lit(0).cast("double")), F.lit(default))


def encode_cursor(col: Column) -> Column:
    return F.base64(col.cast("string").cast("binary"))


def decode_cursor(col: Column) -> Column:
    """The number in a cursor; null if it is none."""
    valid = F.rlike(col, F.lit("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    return F.when(valid, F.decode(F.unbase64(col), "UTF-8").try_cast("long"))


def short_hash(col: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(col, 256), 1, digits)


def verdict_key(name: Column) -> Column:
    return F.concat(F.lit("v1:verdict:"), short_hash(name))


def idempotency_key(name: Column, day: Column) -> Column:
    return F.concat_ws(":", name, F.date_format(day, "yyyy-MM-dd"))


def blob_key(digest: Column, as_of: Column) -> Column:
    """Where a large text is kept: by year and month, then by digest."""
    return F.concat(F.lit("evidence/"), F.date_format(as_of, "yyyy/MM"), F.lit("/"), digest)


def age_days(observed: Column, as_of: Column) -> Column:
    """Days between two timestamps, as a fraction; unknown observations count as fresh."""
    millis = F.unix_millis(as_of) - F.unix_millis(F.coalesce(observed, as_of))
    return millis / F.lit(86_400_000.0)


def decay(age: Column, half_life: Column) -> Column:
    return F.exp(-age / half_life)


def is_stale(updated: Column, as_of: Column, days: int = 7) -> Column:
    return age_days(updated, as_of) > days


def next_check(as_of: Column, days: Column) -> Column:
    return as_of + F.make_dt_interval(days.cast("int"))


def relative_age(then: Column, as_of: Column) -> Column:
    """"3w ago", "in 5h": the largest whole unit of weeks, days, hours, minutes."""
    seconds = F.abs(F.unix_seconds(as_of) - F.unix_seconds(then))
    unit = lambda size, mark: F.concat(F.floor(seconds / size).cast("string"), F.lit(mark))
    amount = F.when(seconds >= 604800, unit(604800, "w")).when(seconds >= 86400, unit(86400, "d")).when(seconds >= 3600, unit(3600, "h")).when(seconds >= 60, unit(60, "m")).otherwise("0m")
    return F.when(then > as_of, F.concat(F.lit("in "), amount)).otherwise(F.concat(amount, F.lit(" ago")))


def retry_after_seconds(header: Column, as_of: Column) -> Column:
    """Seconds to wait from a header that holds seconds or an HTTP date; null if neither."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(header.try_cast("long"), F.when(date.isNotNull(), F.greatest(F.unix_seconds(date) - F.unix_seconds(as_of), F.lit(0))))


def backoff_ms(attempt: Column, base: int = 1000) -> Column:
    return (F.pow(F.lit(2.0), attempt) * base).cast("long")


def llm_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """US dollars at 0.075 and 0.30 a million tokens."""
    return tokens_in / 1_000_000 * 0.075 + tokens_out / 1_000_000 * 0.30


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 3.5)


def format_percent(col: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", col * 100), F.lit("%"))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000)).otherwise(F.format_string("%.1fm", ms / 60_000))


def redact_secrets(col: Column) -> Column:
    """Mask values behind names of credentials in log lines."""
    return F.regexp_replace(col, r"(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1[REDACTED]")


def strip_html(col: Column) -> Column:
    """Tags out, six entities decoded, spaces collapsed."""
    text = F.regexp_replace(col, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_text(col: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, back to the last space if that lies in the last fifth, with an ellipsis."""
    cut = F.substring(col, 1, limit)
    space = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.when(space > limit * 0.8, F.substring(cut, F.lit(1), space)).otherwise(cut), F.lit("…")))


def robots_disallowed(text: Column) -> Column:
    """Paths that a robots file disallows for all agents."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*disallow:[ \t]*(/\S*)"), F.lit(1))


def knowledge_id(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def status_of_errors(errors: Column) -> Column:
    return F.when(errors == 0, "ok").when(errors < 3, "degraded").otherwise("unhealthy")
