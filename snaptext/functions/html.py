"""Web page markup to plain lines, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is dropped, what breaks a line, which entities are decoded.
DROPPED = r"(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>|<!--[\s\S]*?-->|<head[\s\S]*?</head>"
LINE_BREAKS = r"(?i)</?(p|br|li|ul|h[1-6]|div|nav|footer|article)[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
TITLE = r"(?i)<h1[^>]*>([\s\S]*?)</h1>"


def plain(markup: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, DROPPED, ""), LINE_BREAKS, "\n"), TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text
