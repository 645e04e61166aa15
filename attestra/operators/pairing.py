"""Pairing of files with rows: exclusive, in the order of the rows, and in rounds of grouped minima.

A row takes a listed file if exactly one free file has its path, or else, if none has, its base name; a row without a
list takes all free files named after its reference. What a row takes is gone for later rows, which changes what these
find. Walking the rows one by one would be one task; here each round decides every request that no earlier row can change:

* a *taker* is a request that finds its one file now. Up to the first row with a taker among the requests for one base
  name, nothing changes, so these rows are decided as they stand.
* a request is *secure* if it finds its one file and no earlier open row asks for that file. Rows before the first open
  request that is not secure take what they find: they do not meet.
* of files that share a path's end, two that only later rows could take by other ends stay free that long; so all
  requests for that end before then are ambiguous, however many rows make them; so with the base name itself.

Counts by path's end and by base name stand for the files behind them. No request is expanded to the files of a name, so a
name that every row lists and every folder has makes no square. A round works on what the last one left open.

Both sides of each join grow with rows or files, and Spark takes an exploded side for as small as what it came from: the
hints keep it from sending such a side through the driver to every task.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, stem
from .stored import shared_folder

NEVER, SPREAD = (1 << 62), 64


class Pairing(NamedTuple):
    pairs: DataFrame  # row_number, position, path
    unpaired: DataFrame  # path
    missing: DataFrame  # row_number, ord, listed, why


def _kept(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def path_ends(path: Column) -> Column:
    """A path in small letters with forward slashes, and what is left of it from each folder on."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.transform(F.array(parts), lambda p: F.transform(p, lambda _, i: F.array_join(F.slice(p, i + 1, F.size(p)), "/")))[0]


def requests(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(row_number, ord, listed, name, want, path): a row a listed file, with the path's end it asks for; and a row for
    each file that a row without a list is named for, with its path. Of rows with one reference the first gets all."""
    listed = rows.select("row_number", F.posexplode("images").alias("ord", "listed"))
    listed = listed.select("row_number", "ord", "listed", basename(F.col("listed")).alias("name"), F.lower(F.translate("listed", "\\", "/")).alias("want"), F.lit(None).cast("string").alias("path"))
    own = files.select("path", "name", stem(F.col("path")).alias("stem"))
    cuts = F.filter(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring("stem", i + 1, F.lit(1)).isin("_", "-", " ", ""))
    prefixes = own.where("stem <> ''").select("path", "name", F.explode(F.transform(cuts, lambda i: F.substring("stem", F.lit(1), i))).alias("id"))
    loose = rows.where((F.size("images") == 0) & (F.col("application_id") != "")).groupBy(F.lower("application_id").alias("id")).agg(F.min("row_number").alias("row_number"))
    none = F.lit(None).cast("string")
    return listed.unionByName(loose.join(prefixes.hint("merge"), "id").select("row_number", F.lit(0).alias("ord"), none.alias("listed"), "name", none.alias("want"), "path"))


def _claims(free: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each free file that is asked for by its path: ``first``, the first open row that does; of each path's end that is
    asked for: how many free files have it (``n``), one of them (``one``), and the row (``safe``) before which two of
    them are left alone by all other ends."""
    bare = free.select(F.col("name").alias("want"), F.lit(NEVER).alias("row")).distinct()  # counted for every name
    asked = open_.where("want is not null").select("want", F.col("row_number").alias("row")).unionByName(bare).groupBy("want").agg(F.min("row").alias("row"))
    ends = free.select("path", F.explode(F.array_distinct("ends")).alias("want")).join(asked.hint("merge"), "want")
    named = open_.where("want is null").groupBy("path").agg(F.min("row_number").alias("row"))
    claim = ends.select("path", "want", "row").unionByName(named.join(free.select("path").hint("merge"), "path", "left_semi").select("path", F.lit(None).cast("string").alias("want"), "row"))
    # a file has as many claims here as its path has folders, and one more
    claims = claim.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "want"))).alias("all"))
    first = claims.select("path", F.col("all")[0]["row"].alias("first"))
    each = claims.select("path", "all", F.explode("all").alias("c")).select("path", F.col("c.want").alias("want"), F.coalesce(F.array_min(F.transform(F.filter("all", lambda x: ~x["want"].eqNullSafe(F.col("c.want"))), lambda x: x["row"])), F.lit(NEVER)).alias("other")).where("want is not null")
    spread = each.groupBy("want", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).alias("s")).agg(F.count("*").alias("n"), F.min("path").alias("one"), F.max("other").alias("other"))
    two = F.get(F.sort_array(F.collect_list("other"), asc=False), F.lit(1))  # of at most SPREAD values, hence at most the true second
    return first, spread.groupBy("want").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.coalesce(two, F.lit(-1)).alias("safe"))


def _round(open_: DataFrame, free: DataFrame) -> DataFrame:
    """The open requests with ``file``, what each finds now, ``why`` it finds none, and whether this is ``decided``."""
    first, ends = _claims(free, open_)
    names = ends.select(F.col("want").alias("name"), F.col("n").alias("all"), F.col("one").alias("only"), F.col("safe").alias("safe_name"))
    listed = open_.where("want is not null").join(ends.hint("merge"), "want", "left").join(names.hint("merge"), "name", "left")
    n, of_name = F.coalesce("n", F.lit(0)), F.coalesce("all", F.lit(0))
    listed = listed.withColumn("file", F.when(n == 1, F.col("one")).when((n == 0) & (of_name == 1), F.col("only"))).withColumn("why", F.when(F.col("file").isNull(), F.when((n > 1) | (of_name > 1), "ambiguous").otherwise("not found")))
    listed = listed.withColumn("sure", ((n > 1) & (F.col("row_number") < F.col("safe"))) | ((n == 0) & (of_name > 1) & (F.col("row_number") < F.col("safe_name")))).withColumn("by_path", n == 1)
    named = open_.where("want is null").join(free.select("path").hint("merge"), "path", "left_semi").withColumns({"file": F.col("path"), "why": F.lit(None).cast("string"), "sure": F.lit(False), "by_path": F.lit(True)})
    columns = [*open_.columns, "file", "why", "sure", "by_path"]
    found = listed.select(columns).unionByName(named.select(columns)).join(first.withColumnRenamed("path", "file").hint("merge"), "file", "left")
    found = _kept(found.withColumn("secure", F.coalesce(F.col("by_path") & (F.col("first") == F.col("row_number")), F.lit(False))).drop("first", "by_path"))
    row = F.col("row_number")
    bounds = found.groupBy("name").agg(F.min(F.when(F.col("file").isNotNull(), row)).alias("taker"), F.min(F.when(F.col("want").isNotNull() & ~F.col("secure") & ~F.col("sure"), row)).alias("unsure"))
    before = F.col("secure") & (row < F.coalesce("unsure", F.lit(NEVER)))
    return found.join(bounds.hint("merge"), "name").withColumn("decided", F.col("sure") | before | (row <= F.coalesce("taker", F.lit(NEVER)))).drop("taker", "unsure", "sure", "secure")


def pair(rows: DataFrame, files: DataFrame) -> Pairing:
    """Pairs of (row_number, application_id, images) and (path), files of no row, and listed files that were not taken
    (``why``: not found, or ambiguous).

    Row numbers are distinct and a path counts once. A file that a row lists twice is paired twice. ``position`` counts
    a row's files from 0, in the order of its list, else by path.
    """
    free = _kept(files.select("path").where("path is not null").distinct().select("path", basename(F.col("path")).alias("name"), path_ends(F.col("path")).alias("ends")))
    open_, done = _kept(requests(rows, free)), []
    while not open_.isEmpty():
        seen = _kept(_round(open_, free))
        done.append(seen.where("decided").select("row_number", "ord", "listed", "file", "why"))
        open_ = seen.where("not decided").select(open_.columns)
        free = _kept(free.join(done[-1].where("file is not null").select(F.col("file").alias("path")).hint("merge"), "path", "left_anti"))
    if not done:
        done = [open_.select("row_number", "ord", "listed", F.col("path").alias("file"), F.col("path").alias("why"))]
    all_ = reduce(DataFrame.unionByName, done)
    taken = all_.where("file is not null").groupBy("row_number").agg(F.array_sort(F.collect_list(F.struct("ord", "file"))).alias("own"))
    pairs = taken.select("row_number", F.posexplode("own").alias("position", "f")).select("row_number", "position", F.col("f.file").alias("path"))
    return Pairing(pairs, free.select("path"), all_.where("file is null and listed is not null").select("row_number", "ord", "listed", "why"))
