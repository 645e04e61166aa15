"""Registry pages and records: lines of a page, numbered sections, classes, and image signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class words in the registry's own order, places in the country, and file signatures.
CLASSES = {
    "malt": r"(?i)MALT BEVERAGE|\bBEER\b|\bALE\b|\bSTOUT\b|\bLAGER\b|\bPORTER\b|CEREAL BEVERAGE|NEAR BEER",
    "spirits": r"(?i)WHISK|VODKA|\bGIN\b|\bRUM\b|TEQUILA|MEZCAL|AGAVE|BRANDY|LIQUEUR|COCKTAIL|SPIRIT|PROOF|SPECIALT|CORDIAL|ABSINTHE|SCHNAPPS|PISCO|GRAPPA|BITTERS|AQUAVIT|SOJU|BAIJIU|CACHACA",
    "wine": r"(?i)\bWINE\b|CIDER|\bMEAD\b|SAKE|VERMOUTH|CHAMPAGNE|PERRY|SANGRIA",
}
MORE_PLACES = ["GUAM", "VIRGIN ISLANDS", "UNITED STATES", "USA", "AMERICAN"]
SIGNATURES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "tiff": "49492A00", "bmp": "424D"}
SECTION = r"^(\d{1,2}[a-z]?\.\s|PART\s+[IVX]+\b|FOR TTB USE)"


def registry_class(c: Column) -> Column:
    out = None
    for kind, pattern in CLASSES.items():
        out = F.when(c.rlike(pattern), kind) if out is None else out.when(c.rlike(pattern), kind)
    return out.otherwise("spirits")


def is_domestic(c: Column) -> Column:
    from ..functions.text import STATES

    return F.upper(F.trim(c)).isin([n.upper() for n in STATES.values()] + MORE_PLACES)


def page_lines(html: Column) -> Column:
    """Array of the page's text lines; scripts, styles and tags are out, the common entities resolved."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>", ""), "<[^>]+>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), lambda x: x != "")


def section(lines: Column, header: str) -> Column:
    """Lines of a numbered item: after its header and a hint in brackets within four lines, up to the next item."""
    n = F.size(lines)
    at = F.array_position(F.transform(lines, lambda x: x.startswith(header)), True)
    behind = F.slice(lines, F.greatest(at, F.lit(0)).cast("int") + 1, n)
    hint = F.array_position(F.transform(F.slice(behind, 1, 4), lambda x: x.startswith("(")), True)
    own = F.slice(behind, hint.cast("int") + 1, n)
    stop = F.array_position(F.transform(own, lambda x: x.rlike(SECTION)), True)
    return F.when(at > 0, F.when(stop > 0, F.slice(own, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(own)).otherwise(F.array().cast("array<string>"))


def image_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("4D4D002A"), "tiff")
    for kind, sign in SIGNATURES.items():
        out = out.when(head.startswith(sign), kind)
    return out


def image_quality(lines: DataFrame) -> DataFrame:
    """(item_id, image_index, line_count, mean_confidence, readable, retry, read_score)."""
    per = lines.groupBy("item_id", "image_index").agg(F.count("text").alias("line_count"), F.avg("confidence").alias("mean_confidence"), F.sum(F.when(F.col("confidence") >= 0.5, F.col("confidence")).otherwise(0.0)).alias("read_score"))
    return per.withColumns({"readable": (F.col("line_count") > 0) & (F.col("mean_confidence") >= 0.6), "retry": (F.col("mean_confidence") < 0.8) | (F.col("line_count") < 3)})
