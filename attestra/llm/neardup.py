"""Near-duplicate groups by MinHash with tensored banding.

Instead of hashing every table's key anew, a small collection of half-keys is computed (14 of three minhashes each, 42
minhash functions in all) and the tables' keys are formed by combining them in pairs: 91 tables of six minhashes from
the work of seven. Two sets of similarity 0.8 share at least one key unless at most one of fourteen half-keys agrees
(probability 0.0007); at 0.9 it is 0.0000001.

1. An Arrow stage turns each text into its set of word shingles (64-bit), the set's 128-bit digest and half-keys.
2. Documents with equal sets are one node from here on; a group of copies costs one row however large it is.
3. A key can be shared only where both of its half-keys are, so half-keys that occur once go before keys are formed:
   14 rows a node are shuffled instead of 91. Buckets of the same members count once.
4. Buckets of at most SMALL nodes are verified pair by pair. In a larger one every node is verified against the
   bucket's hub, the node whose half-keys are the most common.
5. Large buckets that still hold several components are merged into families around common hubs and refined with a
   pivot C: the shingles that most of a few members have. C may be any set, it only decides how much is pruned. For
   two members x and y that the similarity asks to share at least T shingles,
   |x & y| <= min(|x & C|, |y & C|) + |(x - C) & (y - C)|. So two members either both have T shingles of C, which is
   rare across components once all are verified against the member closest to C, and are verified directly; or
   they share one of the necessary prefix of their shingles outside C, rarest first. Members that share one are a
   bucket again, small or large, and large ones that stay open are the next round's families. A family's members
   that share a shingle outside C are never all of it, so rounds end.

So no link between two texts that share a key is lost. Members of one component need no test.

Scale: texts are hashed in one pass and joined once to the nodes that share a key, whose shingle sets are written;
after that only sets and numbers move. Every bucket yields at most SMALL / 2 pairs a member. Hot half-keys, groups and
components appear in grouped aggregates (pre-aggregated) and in sort-merge joins that adaptive execution splits;
nothing is collected but counts. Joins whose two sides grow with the corpus ask for sort-merge, so that a small input
runs the plan of a large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, stored, unused
from .graph import components, joined_components

HALVES, ROWS = 14, 3
SHINGLE, PERCENT = 5, 80
#: Buckets of at most so many nodes are verified pair by pair; larger ones through their hub and, if open, a pivot.
SMALL = 24
#: So many members of a family vote on its pivot.
VOTERS = 31
#: Set sizes are classed in steps of this ratio where members rich in the pivot meet.
STEP = 1.05


class _Hashes(dict):
    """Token to 64-bit hash, with a bounded cache."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mixed(np.arange(1, 2 * HALVES * ROWS + 65, dtype=np.uint64))
_A, _B, _PLACE = _SEEDS[: HALVES * ROWS] | np.uint64(1), _SEEDS[HALVES * ROWS : 2 * HALVES * ROWS], _SEEDS[2 * HALVES * ROWS :] | np.uint64(1)


def shingle_set(text: bytes | None, k: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-token shingles; a shorter text is one shingle, an empty one has none.

    Lower-casing and splitting bytes touches A-Z and the six ASCII blanks only.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _PLACE[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """HALVES 64-bit keys, each of ROWS minhashes."""
    least = np.full(HALVES * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _A + _B).min(axis=0))
    out = np.zeros(HALVES, np.uint64)
    for r in range(ROWS):
        out = _mixed(out * _PLACE[1] + least.reshape(HALVES, ROWS)[:, r])
    return out


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            digests, sizes, halves = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text, k, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                halves.append(half_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in halves])]).astype(np.int32)
            values = np.concatenate([*halves, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "h", "node", "n", "halves"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(t, k, hashes).view(np.int64) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], ["node", "n", "tokens"])

    return run


class _Links:
    """Verifies pairs on full sets and keeps the roots of the components that their links make."""

    def __init__(self, sets: DataFrame, percent: int) -> None:
        self.sets, self.percent, self.roots = sets, percent, None

    def test(self, pairs: DataFrame) -> None:
        """Verifies the pairs (a, b) that do not lie within one component."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.roots is not None:
            side = lambda c: self.roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            placed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
            pairs = placed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
        of = lambda c: self.sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}")).hint("merge")
        both = F.size(F.array_intersect("t_a", "t_b"))
        met = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", both)
        found = stored(met.where(100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v")))
        before, self.roots = self.roots, components(found) if self.roots is None else joined_components(self.roots, found)
        discard(found, before)

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _node_keys(nodes: DataFrame) -> DataFrame:
    """(node, n, fame, key): the keys of each node both of whose half-keys another node has too; fame is how common
    the node's half-keys are."""
    halves = nodes.select("node", "n", F.posexplode("halves").alias("i", "half")).select("node", "n", F.xxhash64("i", "half").alias("half"))
    common = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    shared = halves.join(common.hint("merge"), "half").groupBy("node", "n").agg(F.sort_array(F.collect_list("half")).alias("halves"), F.sum("c").alias("fame"))
    after = lambda x, i: F.transform(F.slice("halves", i + 2, F.size("halves")), lambda y: F.xxhash64(x, y))
    return shared.where("size(halves) > 1").select("node", "n", "fame", F.explode(F.flatten(F.transform("halves", after))).alias("key"))


def _buckets(rows: DataFrame, rank: list[str]) -> DataFrame:
    """One row a set of several nodes that share a key: key, members, hub (of the highest ``rank``), hub_n, hub_rank."""
    each = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.max(F.struct(*rank, "n", "node")).alias("hub"))
    once = each.where("members > 1").groupBy("members", "sign").agg(F.min(F.struct("key", "hub")).alias("k"))
    return once.select("k.key", "members", F.col("k.hub.node").alias("hub"), F.col("k.hub.n").alias("hub_n"), F.col(f"k.hub.{rank[0]}").alias("hub_rank"))


def _to_verify(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of buckets (key, node, n, members, hub, hub_n): all of a small one, each with the hub of a large one."""
    left = members.where(F.col("members") <= SMALL).select("key", F.col("node").alias("a"), "n")
    right = left.select("key", F.col("a").alias("b"), F.col("n").alias("m"))
    pairs = left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & _close("n", "m", percent)).select("a", "b")
    stars = members.where((F.col("members") > SMALL) & (F.col("node") != F.col("hub")) & _close("n", "hub_n", percent))
    return pairs.unionByName(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _open(members: DataFrame, links: _Links) -> DataFrame:
    """The members of large buckets that lie in several components."""
    large = links.placed(members.where(F.col("members") > SMALL))
    several = large.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key")
    return large.join(several, "key", "left_semi")


def _families(large: DataFrame) -> DataFrame:
    """Large buckets merged into (key, node, n): each goes to the most popular hub that its own hub shares a bucket
    with, twice over. Members of one bucket stay together."""
    best = large.groupBy("node").agg(F.max(F.struct("hub_rank", "hub_n", "hub")).alias("to")).select(F.col("node").alias("at"), F.col("to.hub").alias("to"))
    step = lambda rows: rows.join(best, "at").select("hub", F.col("to").alias("at"))
    placed = step(step(large.select("hub", F.col("hub").alias("at")).distinct()))
    return large.join(placed, "hub").select(F.xxhash64("at").alias("key"), "node", "n").distinct()


def _with_pivot(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, n, overlap, rest): each member's overlap with its family's pivot and its shingles outside it."""
    turn = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
    voters = families.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= VOTERS).select("key", "node")
    votes = voters.join(sets, "node").select("key", F.explode("tokens").alias("token")).groupBy("key", "token").agg(F.count("*").alias("f"))
    of = voters.groupBy("key").agg(F.count("*").alias("voters"))
    pivot = votes.join(of, "key").where(2 * F.col("f") > F.col("voters")).groupBy("key").agg(F.collect_list("token").alias("pivot"))
    met = families.join(sets.select("node", "tokens"), "node").join(pivot, "key", "left").withColumn("pivot", F.coalesce("pivot", F.array().cast("array<long>")))
    return met.select("key", "node", "n", F.size(F.array_intersect("tokens", "pivot")).alias("overlap"), F.array_except("tokens", "pivot").alias("rest"))


def _rich(own: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of which both have enough of the pivot (key, node, n, overlap, root) to be similar."""
    size_class = lambda c: F.floor(F.log(c) / F.lit(float(np.log(STEP)))).cast("int")
    least, most = F.ceil(F.col("n") * percent / 100), F.least(F.floor(F.col("overlap") * (100 + percent) / percent - F.col("n")), F.floor(F.col("n") * 100 / percent))
    able = own.withColumn("least", least).withColumn("most", most).where("most >= least")
    main = own.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("main")).select("key", F.col("main.root").alias("main"))
    left = able.join(main, "key").where("root != main").select("key", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("root").alias("r1"), "least", "most", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("class"))
    right = able.select("key", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("root").alias("r2"), F.col("most").alias("most2"), size_class(F.col("n")).alias("class"))
    return left.join(right, ["key", "class"]).where("r1 != r2 and n2 between least and most and n1 <= most2").select("a", "b")


def _sharing(own: DataFrame, percent: int) -> DataFrame:
    """Buckets of members across components that share a shingle outside the pivot, of those that one of them must."""
    rest = own.select("key", "node", "n", "overlap", "root", F.size("rest").alias("rest_n"), F.explode("rest").alias("token"))
    often = rest.groupBy("key", "token").agg(F.count("*").alias("f")).where("f > 1")
    short = F.greatest(F.ceil(F.col("n") * percent / 100) - F.col("overlap"), F.lit(1))
    # shingles of one member only come first in the order, and need no row
    ordered = rest.join(often, ["key", "token"]).groupBy("key", "node", "n", "overlap", "root", "rest_n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("t"))
    take = (F.size("t") - short + 1).cast("int")  # rest_n - short + 1, less the rest_n - size(t) in front
    rows = ordered.withColumn("take", take).where("take > 0").select("key", "node", "n", "overlap", "root", F.explode(F.slice("t", F.lit(1), F.col("take"))).alias("t"))
    rows = rows.select(F.xxhash64("key", "t.token").alias("key"), "node", "n", "overlap", "root")
    several = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("key")
    rows = rows.join(several, "key", "left_semi")
    return rows.join(_buckets(rows, ["overlap"]), "key").select("key", "node", "n", "members", "hub", "hub_n", "hub_rank")


def _refine(families: DataFrame, links: _Links, first: bool) -> DataFrame:
    """One round over families (key, node, n): verifies what the pivot leaves open and returns the next round's."""
    percent = links.percent
    own = stored(_with_pivot(families, links.sets))
    if first:
        centre = own.groupBy("key").agg(F.max(F.struct(2 * F.col("overlap") - F.col("n"), "n", "node")).alias("c")).select("key", F.col("c.node").alias("b"), F.col("c.n").alias("m"))
        links.test(own.join(centre, "key").where((F.col("node") != F.col("b")) & _close("n", "m", percent)).select(F.col("node").alias("a"), "b"))
    placed = links.placed(own)
    members = stored(_sharing(placed, percent))
    links.test(_to_verify(members, percent).unionByName(_rich(placed, percent)))
    following = stored(_open(members, links).select("key", "node", "n"))
    discard(own, members)
    return following


def _close(n: str, m: str, percent: int):
    """Set sizes that leave the similarity possible."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, and set_digest.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``shingle``-word shingles;
    component_id is the smallest id reachable. Texts without words, and null, have no set, are linked with nothing
    and are their own component. Fewer words than ``shingle`` make one shingle. Rows with equal sets are linked,
    repeated rows included. A null id is never a component_id unless nothing else is reachable; ``kept`` compares
    null-safely. No documents, no rows. Other columns are ignored, whatever their names.
    """
    out = _grouped(documents, doc_id, text, shingle, percent)
    component = F.coalesce("first.id", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), F.col("node").alias("set_digest"))


def _grouped(documents: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """One row per document row: id, h (hash of the text), n, node, and ``first``, the (id, h) of its component's row
    of the smallest id, null ids last; null for texts without words."""
    own = documents.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    signed = stored(own.mapInArrow(_signatures(shingle), f"id {id_type}, h long, node binary, n long, halves array<long>"))
    nodes = signed.where("node is not null").groupBy("node", "n", "halves").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("row"))
    # from here on a node is a number, fixed once it is written
    nodes = stored(nodes.withColumnRenamed("node", "digest").withColumn("node", F.monotonically_increasing_id()))

    keys = _node_keys(nodes)
    members = stored(keys.join(_buckets(keys, ["fame"]).hint("merge"), "key").select("key", "node", "n", "members", "hub", "hub_n", "hub_rank"))
    release(documents.sparkSession)
    asked = nodes.join(members.select("node").distinct(), "node").select("node", "n", F.col("row.id").alias("r_id"), F.col("row.h").alias("r_h"))
    texts = own.join(asked, (own["h"] == asked["r_h"]) & own["id"].eqNullSafe(asked["r_id"])).select("node", "n", "text").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(_sets(shingle), "node long, n long, tokens array<long>"))
    links = _Links(sets, percent)
    links.test(_to_verify(members, percent))
    large = stored(_open(members, links))
    families, first = stored(_families(large)), True
    discard(members, large)
    while not families.isEmpty():
        following = _refine(families, links, first)
        discard(families)
        families, first = following, False
    discard(families, sets)

    named = nodes.join(links.roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "row")
    least = named.groupBy("root").agg(F.min("row").alias("first"))
    of_node = named.join(least, "root").select(F.col("digest").alias("node"), "first")
    return signed.join(of_node, "node", "left").select("id", "h", "n", "node", "first")


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they were, with one of each group left (the smallest id, a null one last; of
    repeated rows, one).

    What is decided holds for rows of one id and text, so different texts of one id, or without id, are judged apart.
    Documents without words belong to no group and all stay.
    """
    found = _grouped(documents, doc_id, text, shingle, percent).where("node is not null")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    own, h = unused(documents, "_id"), unused(documents, "_h")
    pick = lambda rows: rows.select(F.col("id").alias(own), F.col("h").alias(h))
    at = documents[doc_id].eqNullSafe(F.col(own)) & (F.xxhash64(documents[text]) == F.col(h))
    left = documents.join(pick(found.where(~first)).distinct(), at, "left_anti")
    again = found.where(first).groupBy("id", "h").agg(F.count("*").alias("c")).where("c > 1")
    if again.isEmpty():
        return left
    again = pick(again)
    twice = left.join(again, at, "left_semi").withColumn(h, F.xxhash64(text)).dropDuplicates([doc_id, h]).drop(h)
    return left.join(again, at, "left_anti").unionByName(twice)
