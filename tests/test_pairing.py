"""Pairing in rounds against a walk over the rows."""

import random

import pytest

from attestra.operators import pairing

ROWS = "row_number long, application_id string, images array<string>"


def walked(rows, files):
    free, pairs, missing = list(dict.fromkeys(files)), [], []
    slash = lambda s: s.lower().replace("\\", "/")
    name = lambda s: slash(s).rsplit("/", 1)[-1]
    for number, ref, images in sorted(rows):
        own = []
        for k, listed in enumerate(images):
            exact = [f for f in free if slash(f) == slash(listed) or slash(f).endswith("/" + slash(listed))]
            hits = exact or [f for f in free if name(f) == name(listed)]
            if len(hits) == 1:
                own.append(hits[0])
            else:
                missing.append((number, k, "ambiguous" if hits else "not found"))
        if not images and ref:
            stems = {f: name(f).rsplit(".", 1)[0] for f in free}
            own = sorted(f for f in free if stems[f] == ref.lower() or stems[f].startswith(tuple(ref.lower() + c for c in "_- ")))
        pairs += [(number, i, f) for i, f in enumerate(own)]
        free = [f for f in free if f not in own]
    return sorted(pairs), sorted(free), sorted(missing)


def _compare(spark, rows, files):
    found = pairing.pair(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame([(f,) for f in files], "path string"))
    got = sorted(map(tuple, found.pairs.collect())), sorted(r["path"] for r in found.unpaired.collect()), sorted((r["row_number"], r["ord"], r["why"]) for r in found.missing.collect())
    assert got == walked(rows, files)


def test_rows_that_compete(spark):
    """Sixty worlds of base names of their own, each with few folders and names, so that rows meet all the time."""
    rng = random.Random(11)
    rows, files, number = [], [], 0
    for w in range(60):
        names = [f"w{w}_{x}.png" for x in ("front", "back")][: rng.randint(1, 2)]
        folders = ["", "a/", "b/", "x/a/", "Top\\x/b/"]
        files += [f + n for f in folders for n in names if rng.random() < 0.6]
        for _ in range(rng.randint(1, 9)):
            number += 1
            images = [rng.choice(folders[:4]) + rng.choice(names).upper() for _ in range(rng.randint(0, 3))]
            rows.append((number, rng.choice([f"W{w}", f"w{w}_front", None, ""]), images))
    rng.shuffle(rows)
    order = list(range(1, len(rows) + 1))
    rng.shuffle(order)
    _compare(spark, [(order[n - 1], ref, images) for n, ref, images in rows], files)


@pytest.mark.parametrize("bare", [0, 2, 3])
def test_a_name_that_every_row_lists(spark, monkeypatch, bare):
    """Each row lists its own folder's front.png, every other one (or none) the bare name, which all files have."""
    rounds = []
    real = pairing._round
    monkeypatch.setattr(pairing, "_round", lambda *a: rounds.append(1) or real(*a))
    rows = [(i, None, ["front.png"] if bare and i % bare == 0 else [f"f{i}/front.png"]) for i in range(120)]
    _compare(spark, rows, [f"in/f{i}/front.png" for i in range(120) if bare < 3 or i % 5])  # with 3, some folders are not there
    assert len(rounds) <= 4


def test_edges(spark):
    _compare(spark, [], ["a.png"])
    _compare(spark, [(1, "a", []), (2, "A", []), (3, None, []), (4, "", [])], [])
    _compare(spark, [(1, None, ["a.png", "a.png"]), (2, None, ["a.png"]), (3, "a", [])], ["d/a.png", "e/a_1.png", "a.PNG.jpg"])
    _compare(spark, [(1, "a", []), (2, "a", []), (5, None, ["q/a_1.png", ""])], ["a_1.png", "a-2.png", "ab.png", "a 3.png"])
