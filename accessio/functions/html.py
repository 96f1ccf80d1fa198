"""HTML functions: tags, entities, view-source pages, links. Column to Column where patterns suffice."""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from accessio.functions.text import text

#: Entities replaced in the JVM; others need unescape(). The ampersand goes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
LINE_CELL = r"""(?is)<td\s+class=["']line-content["'][^>]*>(.*?)</td>\s*</tr>"""


def unescape_common(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape(c: Column) -> Column:
    """All entities, by an Arrow UDF: Spark has no function for it."""

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(html.unescape, na_action="ignore")

    return of(c)


def without_tags(c: Column | str) -> Column:
    """<br> becomes a blank, other tags nothing; entities stay."""
    return F.regexp_replace(F.regexp_replace(text(c), r"(?iu)<\s*br\s*/?\s*>", " "), "<[^>]+>", "")


def page_source(c: Column | str) -> Column:
    """The page that a saved view-source page shows; other pages as they are. Needs unescape() on lines, so common entities only."""
    cells = F.regexp_extract_all(text(c), F.lit(LINE_CELL), F.lit(1))
    lines = F.array_join(F.transform(cells, lambda x: unescape_common(without_tags(x))), "\n")
    return F.when(F.size(cells) == 0, text(c)).otherwise(lines)


def absolute(c: Column, base: str) -> Column:
    """A link made absolute against a base address whose path is /."""
    root = base.rstrip("/")
    scheme = base.split(":")[0]
    return (
        F.when(c == "", F.lit(base))
        .when(c.rlike("(?i)^[a-z][a-z0-9+.-]*:"), c)
        .when(c.startswith("//"), F.concat(F.lit(scheme + ":"), c))
        .when(c.startswith("/"), F.concat(F.lit(root), c))
        .otherwise(F.concat(F.lit(root + "/"), F.regexp_replace(c, r"^(\./)+", "")))
    )


def links(c: Column | str) -> Column:
    """Links of a fragment: array of (href, label), labels without tags."""
    pattern = r"""(?is)<a\b[^>]*?href\s*=\s*["']?([^"'\s>]*)[^>]*>(.*?)</a>"""
    hrefs = F.regexp_extract_all(text(c), F.lit(pattern), F.lit(1))
    labels = F.regexp_extract_all(text(c), F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("href"), labels.alias("label")), lambda x: F.struct(unescape_common(x["href"]).alias("href"), unescape_common(without_tags(x["label"])).alias("label")))


def joined_url(base: str, href: str) -> str:
    return urljoin(base, href)
