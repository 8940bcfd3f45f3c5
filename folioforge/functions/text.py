"""Column expressions on text, portable between regex engines (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode text handling (what str.strip removes).
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Line ends of Unicode text handling.
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: Words: runs of letters, digits and underscores with inner apostrophes and hyphens.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
PAGE_MARKER = r"<!--\s*page:\s*(\d+)\s*-->"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def slugify(c: Column) -> Column:
    """Lower-case ASCII words joined by underscores; ``source`` if nothing is left."""
    core = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(core, F.lit("")), F.lit("source"))


def iso_utc(c: Column) -> Column:
    """ISO 8601 with microseconds if there are any, always with +00:00 (session time zone UTC)."""
    micros = F.pmod(F.unix_micros(c), F.lit(1_000_000))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == 0, "").otherwise(F.format_string(".%06d", micros)), F.lit("+00:00"))


def source_id(title: Column, created_at: Column) -> Column:
    """slug_year_hash of a title and its time."""
    digest = F.substring(F.sha1(F.concat(title, F.lit(":"), iso_utc(created_at))), 1, 6)
    return F.concat_ws("_", slugify(title), F.year(created_at).cast("string"), digest)


def valid_source_id(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,199}\z")


def safe_filename(c: Column) -> Column:
    """Base name of ASCII letters, digits, dot, dash and underscore, at most 120 long; ``upload`` if empty."""
    base = F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1)
    core = F.btrim(F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.substring(core, 1, 120), F.lit("")), F.lit("upload"))


def chapter_filename(c: Column) -> Column:
    """chapter_<name>.md; a number gets two digits, an existing prefix stays."""
    core = F.translate(strip(c), " /", "__")
    core = F.when(core.rlike("^[0-9]+$"), F.format_string("%02d", F.expr("0") + core.try_cast("bigint"))).otherwise(core)
    return F.concat(F.when(F.lower(core).startswith("chapter_"), core).otherwise(F.concat(F.lit("chapter_"), core)), F.lit(".md"))


def normalize_tags(c: Column) -> Column:
    """Tags of an array whose elements may hold several with commas between; trimmed, empty ones gone, null as []."""
    parts = F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.split(t, ",")))
    return F.filter(F.transform(parts, strip), lambda t: t != "")


def tags_of_text(c: Column) -> Column:
    """Tags written with commas between."""
    return normalize_tags(F.when(c.isNotNull(), F.array(c)))


def normalize_url(c: Column) -> Column:
    """One form of http and https addresses; null for anything else or with user information.

    Scheme and host in lower case, default ports, fragments and final slashes of the path dropped, the query kept.
    """
    url = strip(c)
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    scheme, authority = F.lower(F.regexp_extract(url, shape, 1)), F.regexp_extract(url, shape, 2)
    host = F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$", 1))
    port = F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$", 2)
    plain = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.regexp_replace(F.regexp_extract(url, shape, 3), "/+$", "")
    query = F.regexp_extract(url, shape, 4)
    built = F.concat(scheme, F.lit("://"), host, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    good = url.rlike(shape) & scheme.isin("http", "https") & (host != "") & ~authority.contains("@")
    return F.when(good, built)


def page_markdown(text: Column, number: Column) -> Column:
    """A page's text with unified line ends and blank lines, under its marker and heading, ending in one line feed."""
    body = F.regexp_replace(strip(F.regexp_replace(text, r"\r\n?", "\n")), r"\n{3,}", "\n\n")
    marker = F.concat(F.lit("<!-- page: "), number.cast("string"), F.lit(" -->"))
    headed = F.concat(marker, F.lit("\n\n## Page "), number.cast("string"), F.lit("\n\n"), body)
    return F.concat(F.regexp_replace(F.when(body.startswith(marker), body).otherwise(headed), f"(?<!{SPACE}){SPACE}+$", ""), F.lit("\n"))


def page_label(first: Column, last: Column, zero_is_missing: bool = False) -> Column:
    """``unknown``, one number, or first and last with an en dash."""
    one = last.isNull() | (last == first)
    if zero_is_missing:
        one = one | (last == 0)
    return F.when(first.isNull(), "unknown").when(one, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def clean_heading(c: Column) -> Column:
    """Heading text without tags and decoration, inner white space single."""
    plain = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "[`*_]+", "")
    return strip(F.regexp_replace(plain, f"{SPACE}+", " "))


#: Parts of error messages that name a passing outage.
TRANSIENT = (
    "StatusCode.UNAVAILABLE", "StatusCode.DEADLINE_EXCEEDED", "Connection refused", "connection lost", "connection reset",
    "failed to connect", "service unavailable", "transport is closing",
)
#: Kinds of error that are a passing outage, as messages name them: of the transport, of the index service.
TRANSIENT_TYPES = (
    "TransportError", "WeaviateConnectionError", "WeaviateRetryError", "WeaviateTimeoutError", "WeaviateBatchFailedToReestablishStreamError",
    "WeaviateGRPCUnavailableError", "WeaviateStartUpError",
)
#: Kinds of transport error of an HTTP client, and the kind that stands for a passing outage itself.
TRANSPORT_KINDS = ("ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "ConnectError", "ReadError", "WriteError", "CloseError", "ProxyError", "RemoteProtocolError", "DependencyUnavailableError")
#: HTTP status codes below 500 after which a request may be sent again.
TRANSIENT_CODES = (408, 425, 429)


def retryable(message: Column, status: Column | None = None, kind: Column | None = None) -> Column:
    """Whether an error is a passing outage: by its message, by the HTTP ``status`` (5xx and a few others) or by the name of its ``kind``; nulls do not tell."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for part in (*TRANSIENT, *TRANSIENT_TYPES):
        out = out | low.contains(part.lower())
    if status is not None:
        out = out | F.coalesce((status >= 500) | status.isin(*TRANSIENT_CODES), F.lit(False))
    if kind is not None:
        out = out | F.coalesce(kind.isin(*TRANSIENT_TYPES, *TRANSPORT_KINDS), F.lit(False))
    return out
