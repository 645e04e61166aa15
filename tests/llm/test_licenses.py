"""Licence expressions of any size, and the base columns of every text against brute force."""

import random
import time

from attestra.llm import license
from brute import words


def test_with_takes_one_licence_and_one_exception():
    one = license.evaluate("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT")
    assert one == (frozenset({"gpl-2.0-only-with-classpath-exception-2.0", "mit"}), True)
    for text, want in {
        "(mit or isc) with x": {"mit", "isc"}, "mit with (a or b)": {"mit"}, "mit with a with b": {"mit-with-a"}, "mit with": {"mit"}, "mit with and isc": {"mit"},
        "(mit with a) and isc": {"mit-with-a", "isc"}, "((mit": None, "with a": None, "(mit with a": None, ")": None, "": None, "mit)": {"mit"}, "mit isc": {"mit"},
    }.items():
        got = license.evaluate(text)
        assert (got and set(got[0])) == want, text


def test_long_lines_take_linear_time():
    n = 5000
    for text in (" with ".join(["(a or b)"] * n), " or ".join(f"x{i}" for i in range(n)), " and ".join(f"x{i} with e{i}" for i in range(n)), "(" * n + "mit" + ")" * n, "(" * n, " or (".join(f"x{i}" for i in range(n)) + ")" * (n - 1), "mit with " * n):
        at = time.process_time()
        license.evaluate(text)
        assert time.process_time() - at < 1


def test_base_columns_of_every_text(spark):
    rng = random.Random(8)
    phrases = [p.split() for p in ("under the mit license", "apache license version 2", "cc by nc")]
    label = dict(zip(("under the mit license", "apache license version 2", "cc by nc"), ("mit", "apache-2", "cc-by-nc"), strict=True))
    vocabulary = sorted({w for p in phrases for w in p}) + ["x", "É", "2024"]
    texts = []
    for _ in range(300):
        own = []
        for _ in range(rng.randint(0, 12)):
            own += rng.choice(phrases) if rng.random() < 0.35 else [rng.choice(vocabulary)]
        texts.append(rng.choice([" ", "-", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in own))
    texts += [None, "", "cc by nc cc by nc", "cc by by nc"]
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, " ".join(p)) for p in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None)), t
        assert r["base_labels"] == ",".join(sorted({label[p] for _, p in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
