"""The whole comparison of applications with the lines read from their labels, part by part."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_alcohol
from ..operators import checks as C
from ..operators.spans import reading_order, spans
from ..operators.stored import discard, stored
from ..operators.warning import warnings


class Comparison:
    """Tables ``checks``, ``warning`` and ``verdicts``, each computed and stored when it is first asked for."""

    def __init__(self, apps: DataFrame, lines: DataFrame, images: DataFrame | None) -> None:
        self.apps, self.images, self._stored = apps, images, []
        self.ordered = self._kept(reading_order(lines.where("text is not null")))
        # the table that is stored has the lines already, but for those without a text
        self.lines = self.ordered.select(lines.columns).unionByName(lines.where("text is null"))

    def _kept(self, df: DataFrame) -> DataFrame:
        self._stored.append(stored(df))
        return self._stored[-1]

    @cached_property
    def checks(self) -> DataFrame:
        apps, lines, ordered = self.apps, self.lines, self.ordered
        parts = [C.text_checks(apps, spans(ordered)), C.alcohol_checks(apps, lines), C.net_checks(apps, lines), C.bottler_checks(apps, lines, ordered, keep=self._kept), C.origin_checks(apps, lines, ordered, keep=self._kept)]
        return reduce(DataFrame.unionByName, map(self._kept, parts))

    @cached_property
    def warning(self) -> DataFrame:
        stated = parse_alcohol(F.col("alcohol_content"), allow_bare=True)["percent"]
        weak = self.apps.select("item_id", F.coalesce(stated < 0.5, F.lit(False)).alias("weak"))
        found = self._kept(warnings(self.apps, self.ordered))
        return found.join(weak.hint("merge"), "item_id").select("item_id", F.when(F.col("weak"), F.col("warning").withField("assessment", F.lit("not_required"))).otherwise(F.col("warning")).alias("warning"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return C.verdicts(self.apps, self.checks, self.warning, self.images)

    def discard(self) -> None:
        """Removes what is stored, when nothing reads it any more."""
        discard(*self._stored)


def compare(apps: DataFrame, lines: DataFrame, images: DataFrame | None = None) -> Comparison:
    """Applications (item_id and the nine fields) against lines (item_id, image_index, line_seq, text, box, ...).

    ``line_seq`` numbers an item's lines in the order they were read. An item without lines still gets all its checks.
    Below 0.5 % alcohol no warning is required.
    """
    return Comparison(apps, lines, images)


def extract(lines: DataFrame) -> DataFrame:
    """What labels say without an application: percent, proof, volumes, whether a warning heads a line, up to five
    origin and bottler lines, and the tallest line."""
    from ..functions.geometry import with_extents
    from ..functions.numbers import parse_volumes
    from ..functions.text import fold

    f = fold(F.col("text"))
    own = with_extents(lines.where("text is not null")).withColumn("f", f)
    five = lambda when: F.slice(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_seq", "text")))), lambda x: x["text"]), 1, 5)
    per = own.groupBy("item_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_seq", "text"))), lambda x: x["text"]), " ").alias("all_text"), F.max_by("text", F.struct("h", -F.col("line_seq"))).alias("largest_text"),
        five(F.col("f").rlike(r"\b(?:product of|produce of|made in|imported from|country of origin|imported by)\b")).alias("origin_lines"), five(F.col("f").rlike(r"\b(?:bottled|distilled|brewed|produced|vinted|cellared|imported) (?:and \w+ )?(?:by|for)\b")).alias("bottler_lines"), F.bool_or(F.col("f").rlike("government ?warning")).alias("warning_present"))
    a = parse_alcohol(F.col("all_text"))
    return per.select("item_id", a["percent"].alias("alcohol_percent"), a["proof"].alias("proof"), F.array_sort(F.array_distinct(F.transform(parse_volumes(F.col("all_text")), lambda v: v["ml"]))).alias("net_contents_ml"), "warning_present", "origin_lines", "bottler_lines", "largest_text")
