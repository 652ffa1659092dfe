"""Scalar string functions as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space that a Unicode trim takes.
SPACE = r"[\x09-\x0D\x20\x85\xA0  -     　]"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def sanitize_pattern(c: Column) -> Column:
    return trim_space(F.regexp_replace(trim_space(c), r"[\p{Cc}\p{Cf}]", ""))


def sanitize_category(c: Column, default: str = "") -> Column:
    kept = F.regexp_replace(sanitize_pattern(c), r"[^A-Za-z0-9_\- ]", "")
    clean = F.regexp_replace(F.regexp_replace(kept, r"[_\- ]+", "_"), r"^_+|_+\z", "")
    return F.coalesce(F.nullif(F.upper(clean), F.lit("")), F.lit(default))


def sanitize_language(c: Column) -> Column:
    low = F.lower(trim_space(c))
    return F.when(low == "auto", low).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\-_ ]", ""), r"[-_ ]+", "-"), r"^-+|-+\z", ""))


def cache_key(url: Column) -> Column:
    low = F.regexp_replace(F.regexp_replace(F.lower(trim_space(url)), r"[^a-z0-9_-]+", "_"), r"^[_-]+|[_-]+\z", "")
    return F.coalesce(F.nullif(F.substring(low, 1, 64), F.lit("")), F.concat(F.lit("url_"), F.sha2(url.cast("binary"), 256)))


def file_base(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(trim_space(c)), r"[^a-z0-9_\-. ]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, r"[_\-. ]+", "_"), r"^_+|_+\z", ""), 1, 48)


def raw_url(url: Column) -> Column:
    """A code host's page of a file as the file itself."""
    return F.regexp_replace(url, r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3/$4")


def valid_url(url: Column, allow_http: bool = False) -> Column:
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.coalesce((host != "") & scheme.isin("https", *(["http"] if allow_http else [])), F.lit(False))


def canonical_host(c: Column) -> Column:
    c = F.lower(trim_space(c))
    return F.when(c.startswith("["), F.regexp_extract(c, r"^\[([^\]]*)\]", 1)).when(c.rlike(r"^[^:]*:[0-9]*$"), F.regexp_extract(c, r"^([^:]*)", 1)).otherwise(c)


def intercept_mode(c: Column) -> Column:
    low = F.lower(trim_space(c))
    return F.when(low.isin("global", "targets"), low).otherwise("global")


def truncate(c: Column, most: int) -> Column:
    if most <= 0:
        return F.lit("")
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def preview(c: Column, head: int = 2, tail: int = 2) -> Column:
    n = F.length(c)
    return F.when((n <= 4) | (n <= head + tail), F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail))))


# Header names that are masked whole; segments that mask a name.
SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-goog-api-key", "openai-api-key", "x-openai-api-key", "anthropic-api-key", "x-anthropic-api-key")
SENSITIVE_SEGMENTS = ("token", "tokens", "secret", "secrets")


def canonical_header(name: Column) -> Column:
    """Each hyphenated part with a capital."""
    return F.array_join(F.transform(F.split(F.lower(F.trim(name)), "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "-")


def mask_headers(headers: Column) -> Column:
    """MAP<STRING, ARRAY<STRING>> with canonical names (values of names alike joined) and sensitive values hidden."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(canonical_header(e["key"]).alias("k"), e["value"].alias("v")))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["k"])))

    def hidden(value: Column) -> Column:
        value = trim_space(value)
        scheme = F.substring_index(value, " ", 1)
        named = (F.length(scheme) < F.length(value)) & (F.octet_length(scheme) > 0) & (F.octet_length(scheme) <= 16)
        return F.when(value == "", value).when(named, F.concat(scheme, F.lit(" ***"))).otherwise("***")

    def merged(name: Column) -> Column:
        values = F.flatten(F.transform(F.filter(entries, lambda e: e["k"] == name), lambda e: e["v"]))
        low = F.lower(name)
        secret = low.isin(*SENSITIVE_HEADERS) | F.arrays_overlap(F.transform(F.split(low, "-"), trim_space), F.array(*map(F.lit, SENSITIVE_SEGMENTS)))
        return F.when(secret, F.transform(values, hidden)).otherwise(values)

    return F.map_from_arrays(names, F.transform(names, merged))


def clip_body(body: Column, most: int) -> tuple[Column, Column, Column]:
    """The first bytes, all bytes' number, and whether some are missing."""
    n = F.octet_length(body)
    if most <= 0:
        return body, n, F.lit(False)
    return F.when(n > most, F.substring(body, 1, most)).otherwise(body), n, n > most


def contains_fold(text: Column, part: Column) -> Column:
    """ASCII letters alike in either case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(text, upper, lower), F.translate(part, upper, lower))


def open_sealed(value: Column, key: bytes) -> Column:
    """A sealed configuration value opened; one without the mark as it is; null if it can't be opened."""
    mark = "__VG_ENC_V1__:"  # fixed value
    body = F.unbase64(F.substring(value, len(mark) + 1, 1 << 30))
    return F.when(value.startswith(mark), F.try_aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string")).otherwise(value)


def seal(value: Column, key: bytes) -> Column:
    return F.concat(F.lit("__VG_ENC_V1__:"), F.rtrim(F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"))), F.lit("=")))


# Units of a duration in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(c: Column, default: float) -> Column:
    """parse_duration() of a column."""
    text = F.trim(c)
    unit = F.create_map(*[x for u, n in UNITS.items() for x in (F.lit(u), F.lit(n))])
    one = lambda p: F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * F.element_at(unit, F.regexp_extract(p, r"[a-zµ]+$", 0))
    parts = F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h)"), F.lit(0))
    total = F.aggregate(F.transform(parts, one), F.lit(0.0), lambda a, x: a + x)
    days = F.regexp_extract(text, r"^(\d+)d$", 1)
    whole = text.rlike(r"^-?(?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h))+$")
    return F.when(days != "", F.nullif(days, F.lit("")).cast("double") * 86400).when(whole, F.when(text.startswith("-"), -total).otherwise(total)).otherwise(F.lit(float(default)))


def parse_duration(text: str, default: float) -> float:
    """Seconds of "1h30m", "250ms" or "7d"; default for anything else."""
    import re

    text = text.strip()
    if re.fullmatch(r"\d+d", text):
        return int(text[:-1]) * 86400.0
    if not re.fullmatch(r"-?(?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h))+", text):
        return default
    total = sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h)", text))
    return -total if text.startswith("-") else total
