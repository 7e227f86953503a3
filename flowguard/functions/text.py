"""Analyst notes and indicator values."""

from pyspark.sql import Column, functions as F

from flowguard import constants as K
from flowguard.functions.network import compress_ipv6, IPV4


def nfc(c: Column) -> Column:
    """Unicode composition (NFC), by the ICU library that Spark brings along.

    Only texts with a character from U+0300 on can change; others are passed on as they are.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x{0}-\x{2FF}]"), composed).otherwise(c)


BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def sanitize_note(c: Column) -> Column:
    """struct(body, error): composed, free of control characters, bounded, masked."""
    clean = strip(F.regexp_replace(nfc(c), r"[\p{C}&&[^\t\n]]", ""))
    masked = F.regexp_replace(
        F.regexp_replace(clean, K.IPV4_IN_TEXT, r"\[redacted-endpoint\]"),
        K.IPV6_IN_TEXT, r"\[redacted-endpoint\]")
    error = (F.when(c.isNull() | (clean == ""), "note_empty")
             .when(F.octet_length(clean) > K.NOTE_MAX_BYTES, "note_too_large"))
    return F.struct(F.when(error.isNull(), masked).alias("body"), error.alias("error"))


def normalize_indicator(kind: Column, raw: Column) -> Column:
    """Normal form of an indicator value, or null when it does not fit its type."""
    value = strip(raw)
    bounded = F.length(value).between(1, 2048)
    domain = F.regexp_replace(F.lower(value), r"\.+$", "")
    domain_ok = (domain != "") & ~domain.rlike(r"[\s\p{Z}]") & ~domain.contains("/")
    url = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#@\[\]]*)(?::[^/?#]*)?([^?#]*)"
    scheme = F.lower(F.regexp_extract(value, url, 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(value, url, 2)), r"[\[\]]", "")
    digest = F.lower(value)
    v6 = compress_ipv6(F.when(kind == "ipv6", value))
    return F.when(
        bounded,
        F.when(kind == "ipv4", F.when(value.rlike(IPV4), value))
        .when(kind == "ipv6", v6)
        .when(kind == "domain", F.when(domain_ok, domain))
        .when(kind == "url", F.when(
            scheme.isin("http", "https") & (host != ""),
            F.concat(scheme, F.lit("://"), host, F.regexp_extract(value, url, 3))))
        .when(kind == "sha256", F.when(digest.rlike("^[0-9a-f]{64}$"), digest)))


def indicator_hash(kind: Column, raw: Column) -> Column:
    """Hash of type and normal form; the raw value itself is never stored."""
    return F.sha2(F.concat(kind, F.lit(":"), normalize_indicator(kind, raw)), 256)
