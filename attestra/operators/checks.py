"""Field checks: one row an item and check (item_id, check_id, status, expected, found, score, note, evidence)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.countries import country_named
from ..functions.text import company_forms, fold, fold_company, has_responsibility_prefix
from .party import registered_party
from .spans import MISMATCH_AT, REVIEW_AT, best_spans, spans, status_of
from .stored import stored

#: Stores a table that several parts of a check read.
Keep = Callable[[DataFrame], DataFrame]
COLUMNS = ["item_id", "check_id", "status", "expected", "found", "score", "note", "evidence"]
# Fixed value: phrases before a country of origin.
ORIGIN_PREFIX = r"(?i)^\s*(?:product of|produce of|made in|produced in|distilled in|bottled in|imported from|country of origin:?)\s+"
EVIDENCE = "array<struct<image_index:int,line_seq:int,text:string>>"
_NEAR = (2, 3)


def _evidence(lines: Column) -> Column:
    one = lambda x: F.struct(x["image_index"].cast("int").alias("image_index"), x["line_seq"].cast("int").alias("line_seq"), x["text"].alias("text"))
    return F.coalesce(F.transform(lines, one), F.array().cast(EVIDENCE))


def _no_evidence() -> Column:
    return F.array().cast(EVIDENCE)


def _row(check_id: str, status: Column, expected: Column, found: Column, score: Column, note: Column, evidence: Column) -> list[Column]:
    return [F.col("item_id"), F.lit(check_id).alias("check_id"), status.alias("status"), expected.alias("expected"), found.alias("found"), score.cast("double").alias("score"), note.alias("note"), evidence.alias("evidence")]


def text_checks(apps: DataFrame, candidates: DataFrame, review_at: int = REVIEW_AT, mismatch_at: int = MISMATCH_AT) -> DataFrame:
    """Brand and class. A class that differs is a question, never an issue, and shows nothing if nothing is alike."""
    wanted = apps.select("item_id", F.explode(F.create_map(F.lit("brand_name"), F.col("brand_name"), F.lit("class_type"), F.col("class_type"))).alias("check_id", "expected")).select("item_id", "check_id", F.lit(0).alias("ord"), "expected")
    best = best_spans(wanted, candidates)
    status, note = status_of(review_at, mismatch_at)
    out = best.withColumn("raw", status).withColumn("note", note)
    of_class = F.col("check_id") == "class_type"
    hide = of_class & (F.col("raw") == "not_found")
    status = F.when(of_class & F.col("raw").isin("mismatch", "not_found"), "needs_review").otherwise(F.col("raw"))
    return out.select("item_id", "check_id", status.alias("status"), "expected", F.when(~hide, F.col("found")).alias("found"), F.when(~hide, F.col("score").cast("double")).alias("score"), "note", F.when(hide, _no_evidence()).otherwise(_evidence(F.col("lines"))).alias("evidence"))


def _line_struct() -> Column:
    return F.struct("image_index", "line_seq", "text")


def alcohol_checks(apps: DataFrame, lines: DataFrame) -> DataFrame:
    """The stated alcohol of an application against all statements on its label, which may not contradict itself."""
    read = lines.withColumn("a", N.parse_alcohol(F.col("text"))).where("a is not null")
    own = apps.select("item_id", "beverage_type", "class_type", "alcohol_content", N.parse_alcohol(F.col("alcohol_content"), allow_bare=True).alias("want"))
    fits = N.alcohol_matches(F.col("want.percent"), F.col("a.percent"))
    per = read.join(own.select("item_id", "want").hint("merge"), "item_id").groupBy("item_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("a.percent").isNotNull() & ~F.col("a.derived"), F.bround("a.percent", 1)))).alias("distinct"), F.array_sort(F.collect_set("a.proof")).alias("proofs"),
        F.min_by(F.struct("a", "text"), F.struct(F.col("a.derived").alias("d"), (~fits).alias("m"), "line_seq")).alias("first"), F.array_sort(F.collect_list(F.struct("line_seq", _line_struct().alias("ln")))).alias("seen"))
    whole = lines.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_seq", "text"))), lambda x: x["text"]), " ").alias("all_text"))
    out = own.join(per.hint("merge"), "item_id", "left").join(whole.hint("merge"), "item_id", "left")
    split = F.when(F.col("first").isNull(), N.parse_alcohol(F.col("all_text")))  # a statement that wraps in mid-phrase
    out = out.withColumn("split", split)
    percent = F.coalesce(F.col("first.a.percent"), F.col("split.percent"))
    proof = F.coalesce(F.col("first.a.proof"), F.try_element_at("proofs", F.lit(1)), F.col("split.proof"))
    out = out.withColumns({"percent": percent, "proof": proof, "required": N.alcohol_required(F.col("beverage_type"), F.col("class_type"))})
    found = F.coalesce(F.trim(F.col("first.text")), F.when(F.col("percent").isNotNull(), F.concat(F.col("percent").cast("string"), F.lit("%"))))
    unread = (F.trim("alcohol_content") != "") & F.col("want").isNull()
    many = lambda c: F.coalesce(F.size(c), F.lit(0)) > 1
    none, nothing = F.col("want").isNull(), F.col("first").isNull() & F.col("split").isNull()
    same = N.alcohol_matches(F.col("want.percent"), F.col("percent"))
    cases = [
        (F.coalesce(unread, F.lit(False)), "needs_review", None, "application not understood"), (none & many("distinct"), "needs_review", None, "label contradicts itself"), (none & nothing & F.col("required"), "needs_review", None, "required, none given or read"),
        (none & nothing, "info", None, "none given or read"), (none & F.col("required"), "needs_review", None, "required, none given"), (none, "info", None, "none given"), (nothing, "needs_review", None, "none read"),
        (many("distinct"), "mismatch", 0.0, "label contradicts itself"), (many("proofs"), "mismatch", 0.0, "label's proofs differ"), (~same, "mismatch", 0.0, "percentages differ"),
        (F.coalesce(F.abs(F.col("want.proof") - F.col("proof")) > 0.2, F.lit(False)), "mismatch", 0.0, "proofs differ"), (F.coalesce(F.abs(F.col("proof") - 2 * F.col("percent")) > 0.2, F.lit(False)), "needs_review", 100.0, "label's proof is not twice its percentage"),
    ]

    def chosen(i: int, last: Column) -> Column:
        out_ = None
        for c in cases:
            value = F.lit(c[i]).cast("double") if i == 2 else F.lit(c[i])
            out_ = F.when(c[0], value) if out_ is None else out_.when(c[0], value)
        return out_.otherwise(last)

    seen = F.coalesce(F.transform("seen", lambda x: x["ln"]), F.array().cast("array<struct<image_index:int,line_seq:int,text:string>>"))
    return out.select(*_row("alcohol_content", chosen(1, F.lit("match")), F.col("alcohol_content"), found, chosen(2, F.lit(100.0)), chosen(3, F.lit("same percentage")), _evidence(seen)))


def net_checks(apps: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Net contents, and the authorised size of what the application states (check ``standard_of_fill``)."""
    own = apps.select("item_id", "beverage_type", F.nullif("net_contents", F.lit("")).alias("net_contents")).withColumn("want", F.get(N.parse_volumes(F.col("net_contents")), F.lit(0)))
    read = lines.select("item_id", "line_seq", _line_struct().alias("ln"), F.posexplode(N.parse_volumes(F.col("text"))).alias("k", "v"))
    fits = F.coalesce(N.volumes_match(F.col("want.ml"), F.col("v.ml"), tolerance), F.lit(False))
    first = read.join(own.select("item_id", "want").hint("merge"), "item_id").groupBy("item_id").agg(F.min_by(F.struct("v", "ln", fits.alias("fits")), F.struct((~fits).alias("m"), "line_seq", "k")).alias("r"))
    out = own.join(first.hint("merge"), "item_id", "left")
    read_ = F.col("r.v.raw")
    given, known, got = F.col("net_contents").isNotNull(), F.col("want").isNotNull(), F.col("r").isNotNull()
    status = F.when(~given | ~known | ~got, "needs_review").when(F.col("r.fits"), "match").otherwise("mismatch")
    note = F.when(~given & ~got, "none given or read").when(~given, "none given").when(~known, "application not understood").when(~got, "none read").when(F.col("r.fits"), "same volume").otherwise("volumes differ")
    show = ~given | known
    score = F.when(given & known & got, F.when(F.col("r.fits"), 100.0).otherwise(0.0))
    net = out.select(*_row("net_contents", status, F.col("net_contents"), F.when(show, read_), score, note, F.when(got & show, _evidence(F.array("r.ln"))).otherwise(_no_evidence())))
    odd = out.where(known & (N.is_standard_fill(F.col("beverage_type"), F.col("want.ml")) == F.lit(False)))
    none = F.lit(None).cast("string")
    return net.unionByName(odd.select(*_row("standard_of_fill", F.lit("needs_review"), F.col("net_contents"), none, F.lit(None), F.lit("no authorised size"), _no_evidence())))


def origin_checks(apps: DataFrame, lines: DataFrame, ordered: DataFrame, review_at: int = REVIEW_AT, mismatch_at: int = MISMATCH_AT, keep: Keep = stored) -> DataFrame:
    """Country of origin. An issue needs a line that names another country; what cannot be told is a question."""
    asked = apps.where(F.col("country_of_origin") != "")
    bare = spans(ordered.join(asked.select("item_id").hint("merge"), "item_id", "left_semi").withColumn("text", F.regexp_replace("text", ORIGIN_PREFIX, "")))
    wanted = asked.select("item_id", F.lit("country_of_origin").alias("check_id"), F.lit(0).alias("ord"), F.col("country_of_origin").alias("expected"))
    status, note = status_of(review_at, mismatch_at)
    best = keep(best_spans(wanted, bare).withColumn("raw", status).withColumn("note", note).withColumn("want", country_named(F.col("expected"))))
    stated = lines.where(F.col("text").rlike(ORIGIN_PREFIX)).withColumn("place", F.regexp_replace("text", ORIGIN_PREFIX, ""))
    stated = stated.withColumn("named", country_named(F.col("place"))).withColumn("strict", country_named(F.col("place"), states=False)).withColumn("ln", _line_struct())
    first = lambda when: F.min_by(F.when(when, F.struct("ln", "strict")), F.when(when, F.col("line_seq")))
    per = stated.join(best.select("item_id", "want").hint("merge"), "item_id").groupBy("item_id").agg(first(F.col("named") == F.col("want")).alias("same"), first(F.col("strict").isNotNull() & F.coalesce(F.col("strict") != F.col("want"), F.lit(True))).alias("other"), F.min_by("ln", "line_seq").alias("any"))
    out = best.join(per.hint("merge"), "item_id", "left")
    weak = F.col("raw").isin("mismatch", "not_found")
    georgia = (F.col("want") == "United States") & (F.col("other.strict") == "Georgia")
    kind = F.when(~weak, "text").when(F.col("same").isNotNull(), "same").when(F.col("other").isNotNull() & F.coalesce(georgia, F.lit(False)), "georgia").when(F.col("other").isNotNull() & F.col("want").isNotNull(), "other").when(F.col("any").isNotNull(), "unknown").otherwise("none")
    out = out.withColumn("kind", kind)
    line = F.when(F.col("kind") == "same", F.col("same.ln")).when(F.col("kind").isin("georgia", "other"), F.col("other.ln")).when(F.col("kind") == "unknown", F.col("any"))
    by_kind = F.create_map(*[F.lit(x) for x in ("same", "match", "georgia", "needs_review", "other", "mismatch", "unknown", "needs_review", "none", "needs_review")])
    # the span's lines as printed, prefix and all
    keyed = out.withColumn("line", line).withColumn("seqs", F.transform("lines", lambda x: x["line_seq"]))
    printed = keyed.select("item_id", F.posexplode("seqs").alias("p", "line_seq")).join(lines.select("item_id", "line_seq", _line_struct().alias("ln")).hint("merge"), ["item_id", "line_seq"]).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ln"))), lambda x: x["ln"]).alias("printed"))
    done = keyed.join(printed.hint("merge"), "item_id", "left")
    found = F.coalesce(F.col("line.text"), F.array_join(F.transform("printed", lambda x: x["text"]), " "))
    score = F.when(F.col("kind") == "same", 100.0).otherwise(F.col("score").cast("double"))
    checked = done.select(*_row("country_of_origin", F.coalesce(F.try_element_at(by_kind, "kind"), F.col("raw")), F.col("expected"), F.when(found != "", found), score, F.when(F.col("kind") == "text", F.col("note")).otherwise(F.concat(F.lit("origin line: "), "kind")), F.when(F.col("line").isNotNull(), _evidence(F.array("line"))).otherwise(_evidence(F.col("printed")))))
    none = F.lit(None).cast("string")
    open_ = apps.where(F.coalesce(F.col("country_of_origin") == "", F.lit(True)))
    status = F.when(F.col("imported"), "needs_review").otherwise("not_checked")
    return checked.unionByName(open_.select(*_row("country_of_origin", status, none, none, F.lit(None), F.when(F.col("imported"), "imported, no country given").otherwise("not given"), _no_evidence())))


def bottler_checks(apps: DataFrame, lines: DataFrame, ordered: DataFrame, review_at: int = REVIEW_AT, mismatch_at: int = MISMATCH_AT, keep: Keep = stored) -> DataFrame:
    """Bottler as registered against as printed: whole line and each name are tried without responsibility phrase and
    corporate forms, the best read wins, and city and state must stand near it."""
    asked = apps.where(F.col("bottler") != "").select("item_id", "bottler", registered_party("bottler").alias("party"))
    names = F.concat(F.array("bottler"), F.col("party.names"))
    wanted = asked.select("item_id", F.posexplode(names).alias("ord", "name")).select("item_id", F.lit("bottler").alias("check_id"), "ord", fold_company(F.col("name")).alias("expected"))
    folded = spans(ordered.withColumn("text", fold_company(F.col("text"))))
    status, note = status_of(review_at, mismatch_at)
    best = best_spans(wanted, folded).withColumn("raw", status).withColumn("note", note)
    inside = (F.col("expected") != "") & F.contains(F.concat(F.lit(" "), fold_company(F.col("found")), F.lit(" ")), F.concat(F.lit(" "), F.col("expected"), F.lit(" ")))
    status = F.when((F.col("raw") == "needs_review") & inside, "match").otherwise(F.col("raw"))
    best = best.withColumn("status", status)
    rank = F.when(F.col("status") == "match", 0).when(F.col("status") == "needs_review", 1).when(F.col("status") == "mismatch", 2).otherwise(3)
    one = best.groupBy("item_id").agg(F.min_by(F.struct("status", "score", "lines", "note"), F.struct(rank.alias("r"), (-F.coalesce("score", F.lit(0))).alias("s"), "ord")).alias("b"))
    own = keep(asked.join(one.hint("merge"), "item_id", "left").select("item_id", "bottler", "party", "b.*"))
    numbered = lines.withColumn("idx", F.row_number().over(Window.partitionBy("item_id").orderBy("line_seq")))
    hit = own.select("item_id", F.posexplode(F.transform("lines", lambda x: x["line_seq"])).alias("p", "line_seq")).join(numbered.hint("merge"), ["item_id", "line_seq"])
    printed = keep(hit.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", _line_struct().alias("ln")))), lambda x: x["ln"]).alias("printed"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.collect_set("image_index").alias("images")))
    address = own.select("item_id", fold(F.col("party.city")).alias("city"), F.col("party.state_forms").alias("forms")).where("city is not null and size(forms) > 0").join(printed.hint("merge"), "item_id", "left").join(numbered.select("item_id", "idx", "image_index", fold(F.col("text")).alias("t")).hint("merge"), "item_id")
    has_city = F.contains("t", "city")
    has_state = F.exists("forms", lambda f: F.regexp_like(F.col("t"), F.concat(F.lit(r"\b\Q"), f, F.lit(r"\E\b"))))
    near = F.coalesce(F.col("idx").between(F.col("lo") - _NEAR[0], F.col("hi") + _NEAR[1]) & F.array_contains("images", F.col("image_index")), F.lit(False))
    seen = address.groupBy("item_id").agg((F.bool_or(has_city & has_state) | (F.bool_or(has_city & near) & F.bool_or(has_state & near))).alias("address"))
    first = lines.where(has_responsibility_prefix(F.col("text"))).groupBy("item_id").agg(F.min_by(_line_struct(), "line_seq").alias("deed"))
    out = own.join(printed.hint("merge"), "item_id", "left").join(seen.hint("merge"), "item_id", "left").join(first.hint("merge"), "item_id", "left")
    found = F.array_join(F.transform("printed", lambda x: x["text"]), " ")
    want, got = company_forms(F.col("bottler")), company_forms(found)
    inside_of = lambda a, b: F.size(F.array_except(a, b)) == 0
    forms_differ = (F.size(want) > 0) & (F.size(got) > 0) & ~inside_of(want, got) & ~inside_of(got, want)
    no_address = F.col("party.city").isNotNull() & F.col("party.state").isNotNull() & ~F.coalesce("address", F.lit(False))
    raw = F.coalesce("status", F.lit("not_found"))
    matched, weak = (raw == "match") & F.col("printed").isNotNull(), raw.isin("mismatch", "not_found")
    status = F.when(matched & (forms_differ | no_address), "needs_review").when(weak, "needs_review").otherwise(raw)
    note = F.when(matched & forms_differ, "corporate form differs").when(matched & no_address, "address not read").when(weak & F.col("deed").isNotNull(), "another name on the bottler line").when(weak, "name not read").otherwise(F.col("note"))
    line = F.when(weak, F.col("deed"))
    checked = out.select(*_row("bottler", status, F.col("bottler"), F.coalesce(line["text"], F.nullif(found, F.lit(""))), F.col("score"), note, F.when(line.isNotNull(), _evidence(F.array(line))).otherwise(_evidence(F.col("printed")))))
    none = F.lit(None).cast("string")
    return checked.unionByName(apps.where(F.coalesce(F.col("bottler") == "", F.lit(True))).select(*_row("bottler", F.lit("not_checked"), none, none, F.lit(None), F.lit("not given"), _no_evidence())))


def verdicts(items: DataFrame, checks: DataFrame, warning: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(item_id, verdict, issues, reviews): the checks of an item and its warning rolled up.

    ``images`` (item_id, readable) makes an item unreadable if it has images and none can be read.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "country_of_origin", "standard_of_fill")]), F.col("check_id"))
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("o"), "check_id")))), lambda x: x["check_id"])
    done = F.col("status").isin("match", "info") | ((F.col("status") == "not_checked") & F.col("check_id").isin("bottler", "country_of_origin")) | (F.col("check_id") == "standard_of_fill")
    per = checks.groupBy("item_id").agg(listed(F.col("status").isin("mismatch", "not_found")).alias("issues"), listed(F.col("status") == "needs_review").alias("reviews"), F.bool_and(done).alias("complete"))
    out = items.select("item_id").join(per.hint("merge"), "item_id", "left").join(warning.hint("merge"), "item_id", "left")
    kind = F.coalesce(F.col("warning.assessment"), F.lit("absent"))
    bad = kind.isin("absent", "wording")
    ask = ~bad & (kind != "not_required") & ((kind == "noise") | (F.col("warning.caps") == "needs_review") | (F.col("warning.bold") == "needs_review"))
    with_warning = lambda c, when: F.when(when, F.concat(F.col(c), F.array(F.lit("warning")))).otherwise(F.col(c))
    out = out.withColumn("issues", with_warning("issues", bad)).withColumn("reviews", with_warning("reviews", ask))
    readable = F.lit(False)
    if images is not None:
        out = out.join(images.groupBy("item_id").agg(F.bool_or("readable").alias("any_readable")).hint("merge"), "item_id", "left")
        readable = F.coalesce(~F.col("any_readable"), F.lit(False))
    ready = F.col("complete") & ((kind == "not_required") | F.coalesce("warning.exact", F.lit(False)))
    verdict = F.when(readable, "unreadable").when(F.size("issues") > 0, "issues_found").when(F.size("reviews") > 0, "needs_review").when(ready, "ready_for_approval").otherwise("needs_review")
    return out.select("item_id", verdict.alias("verdict"), "issues", "reviews")
