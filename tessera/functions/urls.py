"""URLs as Column expressions, and the few steps on them that need a parser."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import as_column, strip


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(as_column(url), F.lit("HOST")))


def normalize_url(url: Column | str) -> Column:
    """Lower-case host, no default port, sorted query, no fragment, no single slash at the end; null for what is no URL."""
    url = strip(as_column(url))
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    scheme, place, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).when(scheme == "https", F.regexp_replace(place, ":443$", "")).otherwise(place)
    path = F.when(path == "", F.lit("/")).when(path != "/", F.regexp_replace(path, "/$", "")).otherwise(path)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    out = F.concat(scheme, F.lit("://"), place, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), ordered)))
    return F.when(scheme != "", out)


def octets(address: Column) -> Column:
    return F.transform(F.split(address, r"\."), lambda x: x.try_cast("int"))


def may_crawl(url: Column | str) -> Column:
    """Whether a URL is of the web and of no local, private or reserved address."""
    url = as_column(url)
    place = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    o = octets(place)
    first, second = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    four = place.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    reserved = (
        first.isin(0, 10, 127)
        | (first >= 224)
        | ((first == 100) & second.between(64, 127))
        | ((first == 169) & (second == 254))
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 198) & second.between(18, 19))
    )
    local = (place == "localhost") | place.endswith(".localhost") | place.rlike(r"^\[(::1?|::ffff:.*|f[cd].*|fe[89ab].*)\]$")
    return F.coalesce((place != "") & ~local & ~(four & reserved), F.lit(False))


def resolve_one(link: str | None, base: str | None) -> str | None:
    link = (link or "").strip()
    if not link or link.startswith("#") or link.lower().startswith(("javascript:", "mailto:", "tel:", "data:", "blob:")):
        return None
    try:
        found = urljoin(base or "", link)
        split = urlsplit(found)
    except ValueError:
        return None
    return split._replace(fragment="").geturl() if split.scheme in ("http", "https") and split.netloc else None


@F.pandas_udf(StringType())
def resolve_url(links: pd.Series, bases: pd.Series) -> pd.Series:
    """Links against their pages' URLs: of the web only, without fragments; null for others."""
    return pd.Series([resolve_one(x, b) for x, b in zip(links, bases, strict=True)], index=links.index)
