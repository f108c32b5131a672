"""Tool-call linking, in DataFrame functions alone.

Calls and results meet in a hash join on the call's identifier. A call may name the call it follows; its level is the
number of calls before it, found for all calls at once by pointer doubling, so a chain of n calls takes log2(n) rounds
whatever conversation it is in. Calls sorted by (level, at, call_id) are in topological order. Arguments are checked
against the tool's schema and every record is written as canonical JSON: keys sorted, no white space, numbers normal.

Defined results: calls that are equal in every column are one, counted in ``copies``, and results likewise. Calls that
share an identifier but differ are a record each with status ``conflict``, and so is the call whose results differ: it
shows the least of them, every other one is a record of its own with that status. An identifier's level is that of its
least call. Every call and every result without an identifier is a record of its own (``no identifier``) and never linked;
a call that follows an unknown call is a root; calls on a cycle, or behind one, have no level; every orphan result is a
record of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize


@dataclass(frozen=True)
class Parameter:
    """A property of a tool's arguments. ``kind`` is string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True
    shortest: int | None = None
    longest: int | None = None
    least: float | None = None
    most: float | None = None


# The tools that a conversation's turns are read as.
CONVERSATION_TOOLS = {
    "ask": (Parameter("prompt", "string", shortest=1, longest=300), Parameter("turn", "integer", least=0)),
    "configure": (Parameter("instructions", "string", shortest=1), Parameter("turn", "integer", least=0, most=0)),
}
_KINDS = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",),
}


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of calls (call_id, after) with distinct identifiers; the level is null on and behind cycles."""
    known = calls.select(F.col("call_id").alias("id"))
    state = calls.filter("call_id IS NOT NULL").join(known, F.col("after") == F.col("id"), "left").select(
        "call_id", F.col("id").alias("up"), F.when(F.col("id").isNotNull(), 1).otherwise(0).cast("long").alias("level"),
    )
    state = materialize(state, "levels")
    n, reach = state.count(), 1
    while reach <= n and state.filter("up IS NOT NULL").take(1):
        above = state.select(F.col("call_id").alias("id"), F.col("up").alias("next"), F.col("level").alias("more"))
        open_ = state.filter("up IS NOT NULL").join(above, F.col("up") == F.col("id")).select("call_id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        state = materialize(state.filter("up IS NULL").union(open_), "levels")
        reach *= 2
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def _is(value: Column, kind: str) -> Column:
    said = F.schema_of_variant(value)
    match = F.lit(False)
    for k in _KINDS[kind]:
        match = match | said.startswith(k)
    return match


def _faults(arguments: Column, parameters: tuple[Parameter, ...]) -> Column:
    """What is wrong with an object of arguments, as sorted short texts."""
    checks = []
    for p in parameters:
        value = F.try_variant_get(arguments, f"$.{p.name}", "variant")
        absent = value.isNull() | (F.schema_of_variant(value) == "VOID")
        if p.required:
            checks.append(F.when(absent, F.lit(f"{p.name}: missing")))
        checks.append(F.when(~absent & ~_is(value, p.kind), F.lit(f"{p.name}: not {p.kind}")))
        length = F.char_length(F.try_variant_get(arguments, f"$.{p.name}", "string"))
        number = F.try_variant_get(arguments, f"$.{p.name}", "double")
        for limit, wrong, said in (
            (p.shortest, lambda b: length < b, "too short"), (p.longest, lambda b: length > b, "too long"),
            (p.least, lambda b: number < b, "too small"), (p.most, lambda b: number > b, "too large"),
        ):
            if limit is not None:
                checks.append(F.when(~absent & _is(value, p.kind) & wrong(limit), F.lit(f"{p.name}: {said}")))
    names = F.array(*[F.lit(p.name) for p in parameters]) if parameters else F.array().cast("array<string>")
    extra = F.transform(F.array_except(F.json_object_keys(F.to_json(arguments)), names), lambda k: F.concat(k, F.lit(": not in the schema")))
    return F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra))


def link(calls: DataFrame, results: DataFrame, tools: dict[str, tuple[Parameter, ...]]) -> DataFrame:
    """One record per call, and per result that no call's record shows.

    ``calls``: scope, call_id, at, name, arguments (JSON text), after. ``results``: scope, call_id, content.
    Gives scope, call_id, at, level, status, errors, copies and json.
    """
    columns = ["call_id", "name", "arguments", "at", "after", "scope"]
    single = materialize(calls.filter("call_id IS NOT NULL").groupBy(*columns).agg(F.count("*").alias("copies")), "calls")
    least = F.min(F.struct("name", "arguments", "at", "after", "scope")).alias("c")
    first = materialize(single.groupBy("call_id").agg(least, F.count("*").alias("kinds")), "identifiers")
    said = materialize(results.filter("call_id IS NOT NULL").groupBy("call_id", "content", "scope").agg(F.count("*").alias("copies")), "results")
    shown = F.min(F.struct(F.col("content").isNull().alias("empty"), "content", "scope")).alias("r")
    answers = said.groupBy("call_id").agg(shown, F.count("*").alias("replies"))
    known = materialize(first.select("call_id", "kinds").join(answers, "call_id", "left"), "answers")
    order = levels(first.select("call_id", F.col("c.after").alias("after")))
    places = known.join(order, "call_id").select(
        "call_id", "level", F.col("r.content").alias("result"), F.col("r").isNotNull().alias("answered"),
        ((F.col("kinds") > 1) | F.coalesce(F.col("replies") > 1, F.lit(False))).alias("conflict"),
    )
    rows = single.join(places, "call_id").select(*columns, "copies", "level", "result", "answered", "conflict")
    nameless = calls.filter("call_id IS NULL").select(
        *columns, F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("level"), F.lit(None).cast("string").alias("result"),
        F.lit(False).alias("answered"), F.lit(False).alias("conflict"),
    )
    rows = rows.union(nameless).withColumn("value", F.try_parse_json("arguments"))

    is_object = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    errors = F.array(F.lit("unknown tool"))
    for name, parameters in tools.items():
        errors = F.when(F.col("name") == name, _faults(F.col("value"), parameters)).otherwise(errors)
    errors = F.when(~is_object, F.array(F.lit("arguments are not an object"))).otherwise(errors)
    status = (
        F.when(F.col("call_id").isNull(), "no identifier").when(F.col("conflict"), "conflict").when(F.size("errors") > 0, "invalid").when(F.col("level").isNull(), "cycle")
        .when(F.col("answered"), "linked").otherwise("no result")
    )
    rows = rows.withColumn("errors", errors).withColumn("status", status)
    record = F.to_json(F.struct(
        F.col("value").alias("arguments"), F.col("call_id").alias("id"), "level", "name", "result", "status",
    ))
    linked = rows.select("scope", "call_id", "at", "level", "status", F.array_join("errors", "; ").alias("errors"), "copies", record.alias("json"))
    # Results that no call's record shows: of unknown calls, further ones of known calls, and those without an identifier.
    apart = said.join(known.select("call_id", "r", F.lit(True).alias("called")), "call_id", "left")
    apart = apart.filter("called IS NULL OR NOT (content <=> r.content AND scope <=> r.scope)").select(
        "scope", "call_id", "content", F.when(F.col("called"), "conflict").otherwise("orphan result").alias("status"), "copies",
    )
    apart = apart.union(results.filter("call_id IS NULL").select("scope", "call_id", "content", F.lit("no identifier"), F.lit(1).cast("long")))
    null = lambda kind: F.lit(None).cast(kind)
    lost = apart.select(
        "scope", "call_id", null(calls.schema["at"].dataType).alias("at"), null("long").alias("level"), "status", F.lit("").alias("errors"), "copies",
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), "status")).alias("json"),
    )
    return linked.union(lost)


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results.

    A user's turn asks and a system turn configures; any other role but the assistant is a tool of that name. An
    assistant's turn is the result of the turn before it. A call follows the call one turn before it, or else the one two
    turns before it.
    """
    number = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    named_ = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    ident = lambda back: F.when(named_, number(back))
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure").otherwise(F.col("role"))
    asks = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    sets = F.to_json(F.struct(F.col("text").alias("instructions"), "turn"))
    is_result = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.filter(~is_result).select(
        F.col("conv_id").alias("scope"), ident(0).alias("call_id"), F.col("turn").alias("at"), name.alias("name"),
        F.when(F.col("role") == "system", sets).otherwise(asks).alias("arguments"), ident(1).alias("one"), ident(2).alias("two"),
    )
    known = calls.select(F.col("call_id").alias("id")).filter("id IS NOT NULL").distinct()
    bare = calls.filter("one IS NULL").withColumn("id", F.lit(None).cast("string"))  # would all meet in one task
    calls = calls.filter("one IS NOT NULL").join(known, F.col("one") == F.col("id"), "left").union(bare)
    calls = calls.select("scope", "call_id", "at", "name", "arguments", F.coalesce("id", "two").alias("after"))
    results = turns.filter(is_result).select(F.col("conv_id").alias("scope"), ident(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, level, status, errors, copies and json of every call, and of every result that no call shows."""
    calls, results = from_conversations(turns)
    return link(calls, results, CONVERSATION_TOOLS).withColumnRenamed("scope", "conv_id").withColumnRenamed("at", "turn")
