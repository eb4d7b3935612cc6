"""Text, date and URL expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the ASCII letter each decomposes to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(x: Column) -> Column:
    """Lower-case ASCII words: accents folded, everything else a single space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeeze(x: Column) -> Column:
    """White space collapsed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(x, "\\s+", " ")), F.lit(""))


def canonical_url(x: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters, sorted query, no trailing slash."""
    bare = F.regexp_replace(x, "#.*$", "")
    head = F.lower(F.regexp_extract(bare, "^([A-Za-z]+://[^/?]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]+([^?]*)", 1), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|gclid|mc_[^=]*|email_[^=]*|ref)(=|$)")))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def uuid5_like(namespace_hex: str, name: Column) -> Column:
    """Name-based version 5 UUID from SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
