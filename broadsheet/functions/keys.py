"""The four URL keys. They differ on purpose and must not be unified."""

from pyspark.sql import Column, functions as F

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def store_key(url) -> Column:
    """Lowercased; a trailing slash is significant."""
    return F.lower(_col(url))


def exclusion_key(url) -> Column:
    """Lowercased, every trailing slash removed."""
    return F.rtrim(F.lower(_col(url)), F.lit("/"))


def removal_key(value) -> Column:
    """Lowercased, cut at the first '#', trailing slashes removed."""
    return F.rtrim(F.substring_index(F.lower(_col(value)), "#", 1), F.lit("/"))


def host_of(url) -> Column:
    """Lowercased host name, null where the text has none."""
    return F.nullif(F.lower(F.regexp_extract(_col(url), HOST_PATTERN, 1)), F.lit(""))
