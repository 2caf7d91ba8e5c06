"""Column expressions over URLs, hosts and labels (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL in text: scheme, then characters other than whitespace, quotes, angle,
# square and curly brackets, pipe, backslash, caret and backtick.
URL_IN_TEXT_RE = r"(?i)https?://[^\s<>\"{}|\\^`\[\]]+"
URL_TRAIL_RE = r"[.,;)]+$"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
NETLOC_RE = _SCHEME + r"([^/?#]*)"
PATH_RE = _SCHEME + r"[^/?#]*([^?#]*)"
QUERY_RE = r"^[^?#]*[?]([^#]*)"
HOST_OF_URL_RE = r"^https?://(?:[^/?#]*@)?([^:/?#]*)"
OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PREFIX_RE = r"^https?://" + r"[.]".join([OCTET] * 4) + r"([^0-9]|$)"
IPV4_FULL_RE = "^" + r"[.]".join([OCTET] * 4) + "$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_host(c) -> Column:
    """Host of a URL, a bare domain or an e-mail address."""
    s = F.lower(F.trim(col(c)))
    as_url = F.when(s.startswith("http://") | s.startswith("https://"), s) \
        .otherwise(F.concat(F.lit("http://"), s))
    host = F.trim(F.regexp_extract(as_url, HOST_OF_URL_RE, 1))
    return (F.when(col(c).isNull() | (s == ""), F.lit(""))
            .when(s.contains("@") & ~s.contains("/"), F.trim(F.substring_index(s, "@", -1)))
            .otherwise(host))


def address_host(c) -> Column:
    """Domain part of an e-mail address, lower-cased ('' without '@')."""
    s = F.trim(col(c))
    return F.when(s.contains("@"), F.lower(F.trim(F.substring_index(s, "@", -1)))) \
        .otherwise(F.lit(""))


def url_netloc(c) -> Column:
    return F.regexp_extract(col(c), NETLOC_RE, 1)


def url_path(c) -> Column:
    return F.regexp_extract(col(c), PATH_RE, 1)


def url_query(c) -> Column:
    return F.regexp_extract(col(c), QUERY_RE, 1)


def query_param_names(c) -> Column:
    """Names of query parameters that carry a non-empty value, lower-cased."""
    pairs = F.filter(F.split(url_query(c), "&"),
                     lambda p: p.contains("=")
                     & (F.length(F.regexp_extract(p, "^[^=]*=(.*)$", 1)) > 0)
                     & (F.length(F.substring_index(p, "=", 1)) > 0))
    return F.transform(pairs, lambda p: F.lower(F.substring_index(p, "=", 1)))


def has_ip_host(url) -> Column:
    """dotted quad right after the scheme (prefix match), or an IPv4 host."""
    return col(url).rlike(IPV4_PREFIX_RE) | normalize_host(url).rlike(IPV4_FULL_RE)


def leet_normalize(label) -> Column:
    """Part before the first '-' or '_', leet characters mapped."""
    primary = F.regexp_extract(col(label), r"^([^_-]*)", 1)
    return F.translate(primary, "01345678@!", "oleasgtbai")


def primary_part(label) -> Column:
    return F.regexp_extract(col(label), r"^([^_-]*)", 1)


def shannon_entropy(c) -> Column:
    """Shannon entropy in bits of the characters of a string (unrounded)."""
    s = col(c)
    n = F.length(s).cast("double")
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda x: F.length(x) > 0))

    def step(acc, ch):
        p = (n - F.length(F.replace(s, ch, F.lit("")))) / n
        return acc + p * F.log2(p)

    total = F.aggregate(chars, F.lit(0.0).cast("double"), step)
    return F.when(s.isNull() | (F.length(s) == 0), F.lit(0.0)).otherwise(-total)


def count_contained(text: Column, phrases: list) -> Column:
    """Number of distinct dictionary phrases contained in ``text``.

    A sum of ``contains`` over the literal list stays inside whole-stage
    codegen; suited to lists of a few hundred entries.
    """
    uniq = list(dict.fromkeys(phrases))
    if not uniq:
        return F.lit(0)
    terms = [F.when(text.contains(F.lit(p)), 1).otherwise(0) for p in uniq]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def any_contained(text: Column, phrases: list) -> Column:
    uniq = list(dict.fromkeys(phrases))
    if not uniq:
        return F.lit(False)
    out = text.contains(F.lit(uniq[0]))
    for p in uniq[1:]:
        out = out | text.contains(F.lit(p))
    return out


def any_regex(text: Column, patterns: list) -> Column:
    """One alternation for the whole list (a single regex pass)."""
    if not patterns:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def bool_int(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))
