"""Links, titles and text of HTML columns, by regular expressions on simple markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK, TITLE, HIDDEN, TAG = r'<a href="([^"]*)"[^>]*>([^<]*)</a>', "<title>([^<]*)</title>", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "<[^>]*>"


def links(html: Column) -> Column:
    """array of struct(href, title), in order; icon-only links have no title and are skipped."""
    return F.filter(F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("title")), lambda x: F.trim(x["title"]) != "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, TITLE, 1)


def visible(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " "), r"[ \t\r\n]+", " "))
