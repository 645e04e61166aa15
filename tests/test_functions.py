import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import text as T
from attestra.functions.countries import country_named
from attestra.functions.fuzzy import lcs, partial_ratio, partial_ratios, ratio, ratios, score
from attestra.operators.party import registered_party
from attestra.sources import csv_intake
from attestra.operators.warning import STATEMENT, difference, slip, word_diff


def each(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_text_forms(spark):
    texts = ["  Stone’s  Throw ", "CAFÉ “Noir”", "Straße", "a`b", None, ""]
    assert each(spark, texts, T.fold) == ["stone's throw", 'cafe "noir"', "strasse", "a'b", None, ""]
    assert each(spark, texts, T.key) == ["stones throw", "cafe noir", "strasse", "ab", None, ""]


def test_fold_digits(spark):
    assert each(spark, ["7S0 mL", "(9O PROOF)", "OLD", "l2 FL OZ", None], T.fold_digits) == ["750 mL", "(90 PROOF)", "OLD", "12 FL OZ", None]


def test_lists_are_trimmed_whatever_the_place(spark):
    assert each(spark, ["0a.png; 1b.png |c.png;;", None], csv_intake.image_list) == [["0a.png", "1b.png", "c.png"], []]
    lines = spark.createDataFrame([(["0 women sho-", " uld not", "1-", "2"],)], "x array<string>")
    assert lines.select(T.join_hyphenated(F.col("x"))).first()[0] == "0 women should not 1- 2"


@pytest.mark.parametrize(("text", "ml"), [("NET 1.125 ml", [1.12]), ("750\u00a0mL", [750.0]), ("0.001 ml", [0.0]), ("61 L", [])])
def test_volumes_round_half_to_even_and_know_all_blanks(spark, text, ml):
    assert [v["ml"] for v in each(spark, [text], N.parse_volumes)[0]] == ml


def test_alcohol_with_a_no_break_space(spark):
    assert each(spark, ["45\u00a0% ABV"], N.parse_alcohol)[0]["percent"] == 45.0


def test_companies(spark):
    assert each(spark, ["Brewed by GREEN CHEEK BEER CO.", "Green Cheek Beer Company", "Vinted & bottled by: X, LLC"], T.fold_company) == ["green cheek beer"] * 2 + ["x"]
    assert each(spark, ["A Co., Inc.", "Nothing"], T.company_forms) == [["Company", "Inc."], []]
    assert each(spark, ["kentucky", "OR", "Atlantis"], T.state_code) == ["KY", "OR", None]


@pytest.mark.parametrize("bare", [False])
def test_alcohol(spark, bare):
    cases = {"45% Alc./Vol. (90 Proof)": (45.0, 90.0, False), "ALC 13,5% BY VOL": (13.5, None, False), "90 PROOF": (45.0, 90.0, True), "1045% alc/vol": None, "0.0% abv": (0.0, None, False), "45": None, "no number": None}
    got = each(spark, list(cases), lambda c: N.parse_alcohol(c, bare))
    assert [g and (g["percent"], g["proof"], g["derived"]) for g in got] == list(cases.values())
    assert each(spark, ["45"], lambda c: N.parse_alcohol(c, True))[0]["percent"] == 45.0


def test_volumes(spark):
    cases = {"12 FL OZ (355 mL)": [354.88, 355.0], "1,75 L": [1750.0], "17500 mL": [], "7S0 ml": [750.0], "1 PINT 0.9 FL. OZ.": [473.18, 26.62], "": []}
    assert [[v["ml"] for v in vs] for vs in each(spark, list(cases), N.parse_volumes)] == list(cases.values())


def test_fills(spark):
    rows = spark.createDataFrame([("spirits", 750.0), ("wine", 1750.0), ("wine", 5000.0), ("malt", 1.0)], "b string, ml double").select(N.is_standard_fill(F.col("b"), F.col("ml")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, True, None]


def test_countries(spark):
    cases = {"Product of USA": "United States", "Atlanta, Georgia": "United States", "Product of Georgia": "Georgia", "Papua New Guinea": "Papua New Guinea", "Napa, CA 94558": "United States", "Dominican Republic": "Dominican Republic", "Côte d'Ivoire": "Ivory Coast", "somewhere": None, "": None,
             "French and German oak": "France", "Mexique, Italian style": "Mexico", "Dutch or Korea": "South Korea", "new zealand2": "New Zealand", "new 2zealand": None, "x-usa-y": "United States", "usable": None, "Washington wine": "United States", "guineas": None}
    assert each(spark, list(cases), country_named) == list(cases.values())
    assert each(spark, ["Napa, CA"], lambda c: country_named(c, states=False)) == [None]


def test_similarity():
    assert lcs("abcbdab", "bdcaba") == 4
    assert ratio("abcd", "abxd") == 75.0
    assert partial_ratio("tom", "old tom distillery") == 100.0
    assert score("", "x") == 0 and score("old tom", "old tom aged 4 years") == 97


def test_lanes_give_what_single_pairs_give():
    rng = random.Random(7)
    some = lambda: "".join(rng.choices("abcé ", k=rng.choice([0, 1, 2, 7, 20, 63, 64, 65, 80])))
    a, b = [some() for _ in range(400)], [some() for _ in range(400)]

    def table(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = [0, *_next(row, c, y)]
        return row[-1]

    def _next(row, c, y):
        out, left = [], 0
        for j, d in enumerate(y):
            left = row[j] + 1 if c == d else max(left, row[j + 1])
            out.append(left)
        return out

    def best(x, y):
        x, y = sorted((x, y), key=len)
        if not x:
            return 0.0 if y else 100.0
        sides = [(x, y), (y, x)] if len(x) == len(y) else [(x, y)]
        cuts = [(s, t[max(i, 0) : i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t))]
        return max(200 * table(s, w) / (len(s) + len(w)) for s, w in cuts)

    for x, y, whole, part in zip(a[:120], b, ratios(a[:120], b[:120]), partial_ratios(a[:120], b[:120])):
        assert whole == pytest.approx(200 * table(x, y) / (len(x) + len(y)) if x or y else 100.0)
        assert part == pytest.approx(best(x, y))


def test_slip(spark):
    pairs = [("surgeon", "suregon", True), ("women", "woman", True), ("women", "men", False), ("abcd", "abcde", True), ("abcd", "badc", False), ("same", "same", True)]
    assert [slip(a, b) for a, b, _ in pairs] == [x for *_, x in pairs]
    rows = spark.createDataFrame(pairs, "a string, b string, x boolean").select(T.one_slip(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r["v"] for r in rows] == [x for *_, x in pairs]


def test_party(spark):
    lines = ["Trade Name, Legal Name, Inc., 2957 RANDOLPH ST, Costa Mesa, CA, 92626, BRAND (Used on label)", "Bottled by Old Tom Distillery, Bardstown, Kentucky", "Château Élan, LLC, One Winery Road, Braselton, GA", "A Co., A Company, CA", "Name, Québec", "", None]
    a, b, c, d, e, empty, none = each(spark, lines, registered_party)
    assert a["names"] == ["BRAND", "Trade Name", "Legal Name, Inc."] and (a["city"], a["state"], a["zip_code"]) == ("Costa Mesa", "CA", "92626")
    assert b["names"] == ["Bottled by Old Tom Distillery"] and (b["city"], b["state"], b["state_forms"]) == ("Bardstown", "KY", ["ky", "kentucky"])
    assert c["names"] == ["Château Élan, LLC"] and (c["city"], c["state"], c["zip_code"]) == ("Braselton", "GA", None)
    assert d["names"] == ["A Co."] and (d["city"], d["state"]) == ("A Company", "CA")
    assert e["names"] == ["Name", "Québec"] and e["state"] is None and e["state_forms"] == []
    assert empty["names"] == [] and none is None


def test_differences():
    assert difference(STATEMENT, STATEMENT) == "exact"
    assert difference(STATEMENT, STATEMENT.replace("Surgeon", "Suregon").replace(":", "")) == "noise"
    assert difference(STATEMENT, STATEMENT.replace(" not", "")) == "wording"
    assert difference(STATEMENT, STATEMENT.replace("(2) ", "")) == "wording"
    assert difference(STATEMENT, STATEMENT.replace("or operate", 'or88 186"223932 operate')) == "noise"
    assert word_diff("may cause", "can cause") == "-may | +can"
