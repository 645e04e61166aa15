"""Chat formatting: tool-call linking, in DataFrame operations only.

Calls and results are reduced to one row an identifier (the first by turn; the others are counted) and hash-joined on
(conversation, identifier), so neither side of the join has a hot key. Calls are put in topological order: chains and
trees of calls with one dependency each by pointer doubling, calls with several by peeling (in each round the calls
whose dependencies are all placed are placed, until nothing moves); what is left lies on or behind a cycle. Arguments
are parsed to a variant, exploded by name and joined to the schema's parameters for validation. Each linked call is
serialised as canonical JSON: sorted keys, no blanks; fields of the message that are null are left out, nulls within
the arguments stay.

Scale: everything is an equi-join or a pre-aggregated grouping by (conversation, identifier); no conversation is ever
gathered in one task. A chain of n calls takes log2(n) rounds. Calls with several dependencies take a round for each
step of the longest chain of such calls. Every round is a written table, and the one before it is removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored

CALLS = "conv_id, call_id, turn, name, arguments, after"
SCHEMA = "name string, param string, type string, required boolean"
#: The schema of the calls that plain conversations are read as.
REPLY = "values ('reply', 'text', 'STRING', true), ('reply', 'turn', 'BIGINT', true) as t(name, param, type, required)"


def calls_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Reads plain conversations as tool calls and results.

    A user's turn t is a call ``t<t>`` of ``reply`` with arguments {text, turn}, made after the call two turns
    earlier; an assistant's turn t is the result of call ``t<t-1>``. Other roles, and rows without conversation or
    turn, are neither; ``rest_of`` has them.
    """
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv_id is not null and turn is not null")
    named = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct("text", "turn"))
    calls = own.where("role = 'user'").select("conv_id", named(0).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(named(2)).alias("after"))
    results = own.where("role = 'assistant'").select("conv_id", named(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def rest_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows that ``calls_of`` reads as neither: (conv_id, turn, role, content)."""
    own = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return own.where("conv_id is null or turn is null or role is null or role not in ('user', 'assistant')")


def _quoted(c: str) -> Column:
    return F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":|\}$", "")


def _object(*parts: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def every_row(calls: DataFrame, results: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One row a row of calls, results and ``others`` (see ``rest_of``): conv_id, turn, call_id, status, message.

    status: ``call`` and ``result`` for the rows that ``link_tool_calls`` takes, ``further call`` and ``further
    result`` for those of the same identifier that it counts only, ``orphan`` for all results without a call,
    ``without key`` for rows without conversation or identifier (of others: or turn), ``other role`` for the rest.
    message is canonical JSON of the row itself; arguments that are no JSON are kept as a string.
    """
    key = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def placed(rows: DataFrame, own: list[str]) -> DataFrame:
        # equal rows are one until the end, so that no key is hot in a window
        first = rows.where(keyed).groupBy(*key).agg(F.min(F.struct(*own)).alias("first"))
        met = rows.groupBy(*key, *own).agg(F.count("*").alias("copies")).join(first, key, "left")
        met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return met.withColumn("is_first", (F.col("copy") == 1) & F.col("first").eqNullSafe(F.struct(*own)))

    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), _quoted("arguments"))
    message = _object(_named("arguments", F.when(F.col("arguments").isNotNull(), arguments)), _named("id", F.when(F.col("call_id").isNotNull(), _quoted("call_id"))), F.when(F.col("name").isNotNull(), _named("name", _quoted("name"))))
    status = F.when(~keyed, "without key").when(F.col("is_first"), "call").otherwise("further call")
    out = placed(calls, ["turn", "name", "arguments", "after"]).select("conv_id", "turn", "call_id", status.alias("status"), message.alias("message"))

    known = calls.where(keyed).select(*key).distinct().withColumn("known", F.lit(True))
    message = _object(_named("id", F.when(F.col("call_id").isNotNull(), _quoted("call_id"))), F.when(F.col("content").isNotNull(), _named("result", _quoted("content"))))
    status = F.when(~keyed, "without key").when(F.col("known").isNull(), "orphan").when(F.col("is_first"), "result").otherwise("further result")
    out = out.unionByName(placed(results, ["turn", "content"]).join(known, key, "left").select("conv_id", "turn", "call_id", status.alias("status"), message.alias("message")))
    if others is None:
        return out
    message = _object(F.when(F.col("content").isNotNull(), _named("content", _quoted("content"))), F.when(F.col("role").isNotNull(), _named("role", _quoted("role"))))
    status = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), "without key").otherwise("other role")
    return out.unionByName(others.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), status.alias("status"), message.alias("message")))


def topological_levels(edges: DataFrame) -> DataFrame:
    """From (conv_id, call_id, dep): a row (conv_id, call_id, level) for each call with dependencies; level is the
    longest chain below it, null on or behind a cycle. Dependencies without edges of their own are level 0.

    Calls with one dependency form chains and trees, which pointer doubling walks down: each round, a call's pointer
    takes over where its target points. Only calls with several dependencies, joined by their chains' ends, are
    peeled.
    """
    key = ["conv_id", "call_id"]
    edges = stored(edges.select(*key, "dep").distinct())
    degree = stored(edges.groupBy(*key).agg(F.count("*").alias("deps"), F.min("dep").alias("dep")))
    chains = _chain_ends(degree.where("deps = 1").select(*key, "dep"))
    several = degree.where("deps > 1").select(*key)
    placed = _peeled(edges.join(several, key, "left_semi"), chains, several)
    end = chains.join(placed.select("conv_id", F.col("call_id").alias("end"), "level", F.lit(True).alias("several")), ["conv_id", "end"], "left")
    level = F.when(~F.col("moving"), F.when(F.col("several"), F.col("level")).otherwise(0) + F.col("steps"))
    out = stored(end.select(*key, level.alias("level")).unionByName(placed.select(*key, "level")))
    discard(edges, degree, chains, placed)
    return out


def _chain_ends(pointers: DataFrame) -> DataFrame:
    """(conv_id, call_id, end, steps, moving) from one pointer (conv_id, call_id, dep) a call: the first call down the
    chain that has no pointer, and how far it is. As many rounds as the longest chain has binary digits: every round
    settles some call of every chain that is still open, so if none was settled, what still moves leads into a cycle."""
    now, moving = stored(pointers.select("conv_id", "call_id", F.col("dep").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moving"))), None
    while True:
        target = now.select("conv_id", F.col("call_id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        met = now.join(target, ["conv_id", "end"], "left")
        step = stored(met.select("conv_id", "call_id", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moving")))
        discard(now)
        now, before, moving = step, moving, step.where("moving").count()
        if moving in (0, before):
            return now


def _peeled(edges: DataFrame, chains: DataFrame, several: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls with ``several`` dependencies, a round for each step of the longest
    chain of such calls. Where a dependency is the top of a chain, the edge goes to the chain's end."""
    key = ["conv_id", "call_id"]
    todo = stored(several.withColumn("level", F.lit(None).cast("long")))
    if todo.isEmpty():
        return todo
    down = chains.select("conv_id", F.col("call_id").alias("dep"), "end", "steps", "moving")
    down = edges.join(down, ["conv_id", "dep"], "left").select(*key, F.coalesce("end", "dep").alias("dep"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("moving", F.lit(False)).alias("moving"))
    down = stored(down.groupBy(*key, "dep", "moving").agg(F.max("steps").alias("steps")))
    waits = down.join(several.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi").unionByName(down.where("moving")).distinct()
    waits = stored(waits.select(*key, "dep", "steps"))
    floors = stored(down.join(waits.select(*key, "dep").distinct(), [*key, "dep"], "left_anti").select(*key, "steps"))
    placed = []
    while not todo.isEmpty():
        ready = stored(todo.join(waits.select(*key).distinct(), key, "left_anti").join(floors, key).groupBy(*key).agg(F.max("steps").alias("level")))
        if ready.isEmpty():
            break
        placed.append(ready)
        of = ready.select("conv_id", F.col("call_id").alias("dep"), "level")
        more = waits.join(of, ["conv_id", "dep"]).select(*key, (F.col("level") + F.col("steps")).alias("steps"))
        following = [stored(todo.join(ready, key, "left_anti")), stored(waits.join(of, ["conv_id", "dep"], "left_anti").select(*key, "dep", "steps")), stored(floors.join(ready, key, "left_anti").unionByName(more))]
        discard(todo, waits, floors)
        todo, waits, floors = following
        if len(placed) == 8:  # keep the union short
            merged = stored(_union(placed))
            discard(*placed)
            placed = [merged]
    out = stored(_union([*placed, todo]))
    discard(down, todo, waits, floors, *placed)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors): sorted findings for calls with any; types as ``schema_of_variant`` names them."""
    parsed = calls.select("conv_id", "call_id", "name", F.try_parse_json(F.coalesce("arguments", F.lit(""))).alias("v"))
    key = ["conv_id", "call_id"]
    bad_json = parsed.where(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT")).select(*key, F.lit("arguments: not an object").alias("error"))
    good = parsed.where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    names = F.broadcast(schemas.select("name").distinct())
    unknown = parsed.join(names, "name", "left_anti").select(*key, F.concat(F.coalesce("name", F.lit("null")), F.lit(": no such function")).alias("error"))
    given = good.lateralJoin(good.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*key, "name", F.col("key").alias("param"), F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("got"))
    wanted = F.broadcast(schemas)
    due = good.join(wanted, "name").select(*key, "name", "param", "type", "required")
    met = due.join(given, [*key, "name", "param"], "full")
    error = F.when(F.col("type").isNull(), F.lit("not in the schema")).when(F.col("got").isNull() & F.col("required"), F.lit("missing")).when(F.col("got") != F.col("type"), F.concat(F.lower("got"), F.lit(" for "), F.lower("type")))
    found = met.join(names, "name", "left_semi").select(*key, F.concat("param", F.lit(": "), error).alias("error")).where("error is not null")
    return bad_json.unionByName(unknown).unionByName(found).groupBy(*key).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a distinct (conv_id, call_id), of calls and of results without a call.

    Columns: conv_id, call_id, turn, name, level (0 first; null on or behind a cycle), n_calls, n_results, n_missing
    (dependencies that are no calls), status (linked, unanswered, orphan), errors (sorted), valid, message (canonical
    JSON of id, name, arguments and result; null for orphans). Of rows with one identifier the first by turn counts,
    of equals the least text. Rows without conversation or identifier are left out. ``schemas`` (name, param, type,
    required) is a list of functions written by hand and is broadcast. Empty tables give no rows; other columns are
    ignored. ``every_row`` has what is only counted here.
    """
    key = ["conv_id", "call_id"]
    first = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls"))
    own = stored(first.select(*key, "c.*", "n_calls"))
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    edges = own.select(*key, F.explode("after").alias("dep")).where("dep is not null").distinct()
    known = edges.join(own.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    missing = edges.join(own.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_anti").groupBy(*key).agg(F.count("*").alias("n_missing"))
    levels = topological_levels(known).withColumn("placed", F.lit(True))
    errors = argument_errors(own, schemas)
    all_ = own.join(answers, key, "full").join(levels, key, "left").join(missing, key, "left").join(errors, key, "left")
    called = F.col("n_calls").isNotNull()
    status = F.when(~called, "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    none = F.array().cast("array<string>")
    arguments = F.to_json(F.try_parse_json("arguments"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r"^\{\"x\":|\}$", "")
    parts = F.concat_ws(",", F.concat(F.lit('"arguments":'), arguments), F.concat(F.lit('"id":'), quoted("call_id")), F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), quoted("name"))), F.when(F.col("r.content").isNotNull(), F.concat(F.lit('"result":'), quoted("r.content"))))
    message = F.when(called, F.concat(F.lit("{"), parts, F.lit("}")))
    return all_.select(
        *key, F.coalesce("turn", "r.turn").alias("turn"), "name", F.when(called, F.when(F.col("placed"), F.col("level")).otherwise(0)).alias("level"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("n_missing", F.lit(0)).alias("n_missing"), status.alias("status"), F.coalesce("errors", none).alias("errors"), (called & F.col("errors").isNull()).alias("valid"), message.alias("message"))


def reply_schema(spark: SparkSession) -> DataFrame:
    """The schema rows of ``reply``, the function that ``calls_of`` reads plain conversations as calls of."""
    return spark.sql(f"select * from {REPLY}")
