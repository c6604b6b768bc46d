"""Link handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(url: Column) -> Column:
    """Cut at the last ``?`` and then at the last ``#``."""
    return F.regexp_replace(F.regexp_replace(url, r"\?[^?]*$", ""), r"#[^#]*$", "")


def scheme(url: Column) -> Column:
    return F.parse_url(url, F.lit("PROTOCOL"))


def host(url: Column) -> Column:
    """Host with its port, the way the site is named in folders."""
    return F.parse_url(url, F.lit("AUTHORITY"))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def entry_key(url: Column) -> Column:
    """Stable name of an entry: path with dashes, outer dashes trimmed, ``.txt``."""
    root = F.concat(site_root(url), F.lit("/"))
    path = F.replace(url, root, F.lit(""))
    return F.concat(F.regexp_replace(F.translate(path, "/", "-"), "^-+|-+$", ""), F.lit(".txt"))


def absolutise(page_url: Column, img: Column) -> Column:
    """Absolute image address; ``data:`` and empty become null."""
    return (
        F.when(img.isNull() | (img == "") | img.startswith("data:"), F.lit(None).cast("string"))
        .when(img.startswith("//"), F.concat(F.lit("https:"), img))
        .when(img.startswith("/"), F.concat(site_root(page_url), img))
        .otherwise(img)
    )
