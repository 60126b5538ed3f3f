"""URL clean-up and item identity, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

# 1 scheme, 2 user, 3 password, 4 host, 5 port, 6 path, 7 query; the fragment is
# matched and left out, and a port that is not a number matches nothing
_URL = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(?://(?:([^:/?#]*)(?::([^/?#]*))?@)?(\[[^\]/?#]*\]|[^:/?#@\[]*)(?::([0-9]*))?(?=[/?#]|$))?"
    r"((?!(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)[^?#]*)(?:\?([^#]*))?(?:#.*)?$"
)
_PADDING = r"(?U)^[\s\x00-\x20]+|[\s\x00-\x20]+$|[\t\r\n]"


def _decode(piece: Column) -> Column:
    """Form-decode one query piece; a stray percent sign stands for itself."""
    return F.url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(piece: Column) -> Column:
    """Form-encode with ``A-Za-z0-9_.-~`` left bare and a space as ``+``."""
    return F.replace(F.replace(F.url_encode(piece), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _is_tracking(key: Column) -> Column:
    low = F.lower(key)
    return low.startswith(C.TRACKING_PREFIX) | low.isin(C.TRACKING_PARAMS)


def clean_query(query: Column) -> Column:
    """Drop tracking parameters, keep blank values, order and duplicates."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda kv: ~_is_tracking(kv["k"]))
    return F.array_join(
        F.transform(kept, lambda kv: F.concat(_encode(kv["k"]), F.lit("="), _encode(kv["v"]))), "&"
    )


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty when it has none."""
    return F.lower(F.translate(F.regexp_extract(url, _URL, 4), "[]", ""))


def _bind(value: Column, use) -> Column:
    """Evaluate a value once and use it many times within one expression."""
    return F.transform(F.array(value), use)[0]


def clean_url(url: Column) -> Column:
    """Canonical form of a URL without any network access.

    NULL where the port is not a number, which callers treat as a bad row. The
    URL is matched once; its seven parts come out of that match as an array.
    """
    mark = "\n"  # the padding pattern has taken every line feed out
    matched = F.regexp_replace(F.regexp_replace(url, _PADDING, ""), _URL, mark.join(f"${i}" for i in range(1, 8)))
    return _bind(F.split(matched, mark), _join_parts)


def _join_parts(parts: Column) -> Column:
    scheme, user, password, host, port, path, query = [F.get(parts, F.lit(i)) for i in range(7)]

    def part(text: Column, before: str = "", after: str = "") -> Column:
        return F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")

    number = F.regexp_replace(port, "^0+", "")
    netloc = F.concat(
        F.when(user != "", F.concat(user, part(password, ":"), F.lit("@"))).otherwise(""),
        F.lower(F.translate(host, "[]", "")),
        part(number, ":"),
    )
    short = F.regexp_replace(path, r"(?s)/$", "")

    def joined(p: Column) -> Column:
        return F.concat(
            F.lower(part(scheme, after=":")),
            part(p["netloc"], "//"),
            F.when((p["netloc"] != "") & (p["path"] != "") & ~p["path"].startswith("/"), "/").otherwise(""),
            p["path"],
            part(p["query"], "?"),
        )

    whole = _bind(F.struct(netloc.alias("netloc"), short.alias("path"), clean_query(query).alias("query")), joined)
    bad_port = (port != "") & ((F.length(number) > 5) | (F.coalesce(number.try_cast("int"), F.lit(0)) > 65535))
    return F.when((F.size(parts) == 7) & ~bad_port, whole)


def make_item_id(canonical_url: Column, published_at: Column) -> Column:
    """First 32 hex digits of the hash of the URL and the UTC second stamp."""
    stamp = F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.substring(F.sha2(F.concat(canonical_url, stamp), 256), 1, C.ID_CHARS)


def cluster_id(seed_item_id: Column) -> Column:
    return F.substring(F.sha2(seed_item_id, 256), 1, C.ID_CHARS)
