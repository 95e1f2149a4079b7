"""Tool calls in chats: join calls with results, order them by their references, validate, write canonical JSON.

Calls and results meet in one grouping by conversation and identifier. A call may refer to the result of another one
by {"$ref": "<id>"} in its arguments. A call's level is the longest chain of references behind it. Small conversations are ordered in
the task they lie in; in large ones, chains of calls with one reference are cut short by doubling their length each round, and
only calls with several references are peeled one after another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table

#: Argument fields by tool: (type, required). Fixed values.
SCHEMAS = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "after": ("object", False)}}
#: Conversations of so many calls, at most, are ordered by one task each; larger ones by rounds of joins.
SMALL = 256
CALL = "array<struct<id:string,name:string,arguments:string>>"


def canonical(value: object) -> str:
    """JSON with keys in code-point order, no spaces, no escapes but the needed ones; no NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(arguments: str | None) -> tuple[object, str | None]:
    """(value, fault) of arguments: what can't be read or written again stays the text it is, and the fault says why."""
    try:
        value = json.loads(arguments or "", parse_constant=lambda c: 1 / 0)
        canonical(value).encode()
    except UnicodeEncodeError:
        return arguments, "lone surrogate"
    except (ValueError, ZeroDivisionError, RecursionError) as error:
        return arguments, "number out of range" if "float" in str(error) or "Out of range" in str(error) else "not JSON"
    return value, None


def _is(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str), "integer": number and value == int(value), "number": number, "boolean": isinstance(value, bool),
        "array": isinstance(value, list), "object": isinstance(value, dict), "null": value is None,
    }[kind]


def invalid(name: str | None, given: object, schemas: dict) -> str | None:
    """What is wrong with the parsed arguments of a call: the first fault in the order of the fields, or None."""
    if not isinstance(given, dict):
        return "not an object"
    for field, (kind, required) in sorted(schemas[name].items()):
        if field not in given:
            if required:
                return f"missing {field}"
        elif not _is(given[field], kind) and not (isinstance(given[field], dict) and "$ref" in given[field]):
            return f"{field} is no {kind}"
    extra = sorted(set(given) - set(schemas[name]))
    return f"unexpected {extra[0]}" if extra else None


def references(arguments: str | None) -> list[str]:
    """The identifiers that {"$ref": "<id>"} names anywhere in the arguments, each once; none where they are no JSON."""
    if not arguments or ("ref" not in arguments and "\\" not in arguments):
        return []
    value, fault = parsed(arguments)
    found, waiting = {}, [] if fault else [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            if isinstance(named := at.get("$ref"), str):
                found[named] = None
            waiting += at.values()
        elif isinstance(at, list):
            waiting += at
    return sorted(found)


def group_levels(ids: list[str], needs: list[tuple[str, str]]) -> dict[str, int | None]:
    """The level of each call of one conversation: one more than the highest it needs; None on or behind a cycle."""
    left, wanted_by, level = dict.fromkeys(ids, 0), {}, dict.fromkeys(ids, 0)
    for a, b in set(needs):
        left[a] += 1
        wanted_by.setdefault(b, []).append(a)
    ready = [i for i, n in left.items() if n == 0]
    while ready:
        done = ready.pop()
        for a in wanted_by.get(done, []):
            level[a] = max(level[a], level[done] + 1)
            left[a] -= 1
            if left[a] == 0:
                ready.append(a)
    return {i: level[i] if left[i] == 0 else None for i in level}


def levels(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv_id, id, level) of calls: 0 without references, else one more than the highest level referred to; null on or behind a cycle.

    nodes: conv_id, id; edges: conv_id, id, needs, both ids being nodes. Conversations of `small` calls or fewer are ordered where
    they lie, one after another; those of more by level_rounds(), with the same result.
    """
    sizes = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("calls"))
    large = spool(sizes.filter(F.col("calls") > small).select("conv_id"), "large")
    rows = nodes.select("conv_id", "id", F.lit(None).cast("string").alias("needs")).unionByName(edges.select("conv_id", "id", "needs"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str | None]] = []
        of: object = None

        def out() -> pa.RecordBatch:
            found = group_levels([i for i, n in held if n is None], [(i, n) for i, n in held if n is not None])
            return pa.RecordBatch.from_arrays([pa.array([of] * len(found), types), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], ["conv_id", "id", "level"])

        for batch in batches:
            types = batch.schema.field(0).type
            for conv, id_, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != of and held:
                    yield out()
                    held = []
                of = conv
                held.append((id_, needs))
        if held:
            yield out()

    few = rows.join(large, "conv_id", "left_anti") if (any_large := bool(large.take(1))) else rows
    found = few.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, f"conv_id {kind}, id string, level int")
    if not any_large:
        return found
    return found.unionByName(level_rounds(nodes.join(large, "conv_id", "left_semi"), edges.join(large, "conv_id", "left_semi")))


def level_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels() by joins, for conversations of any size: 0 without references, else one more than the highest level referred to; null on or behind a cycle.

    nodes: conv_id, id; edges: conv_id, id, needs, both ids being nodes. Calls with one reference hand on the end of
    their chain in rounds that double its length; they number about log2 of the longest chain, or of the calls of the
    largest conversation where there are cycles. Calls with several references wait for each other, one round for each
    such call on the longest path. All rows are narrow and meet by conversation and id.
    """
    key = ["conv_id", "id"]
    counted = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("ptr"))
    graph = spool(nodes.join(counted, key, "left").select(*key, F.coalesce("n", F.lit(0)).alias("n"), "ptr"), "graph")
    chains = graph.filter("n = 1").select(*key, "ptr", F.lit(1).cast("long").alias("dist"))
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        ends = chains.select("conv_id", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("more"))
        longer = spool(chains.join(ends, ["conv_id", "ptr"], "left").select(*key, F.coalesce("next", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("moved")), "chains")
        chains = longer.drop("moved")
        if not longer.filter("moved").take(1):
            break
    # Where each call's chain ends: at a call without references, at one with several, or (in a cycle) nowhere.
    kinds = graph.select("conv_id", F.col("id").alias("ptr"), F.col("n").alias("end_n"))
    ended = chains.join(kinds, ["conv_id", "ptr"]).select(*key, "ptr", "dist", "end_n")
    own = graph.filter("n <> 1").select(*key, F.col("id").alias("ptr"), F.lit(0).cast("long").alias("dist"), F.col("n").alias("end_n"))
    reach = spool(ended.unionByName(own), "reach")

    known = graph.filter("n = 0").select(*key, F.lit(0).cast("long").alias("level"))
    waits = edges.join(graph.filter("n > 1").select(*key), key).join(reach.select("conv_id", F.col("id").alias("needs"), "ptr", "dist", "end_n"), ["conv_id", "needs"])
    waits = spool(waits.select(*key, "ptr", F.when(F.col("end_n") == 1, F.lit(None)).otherwise(F.col("dist") + 1).alias("dist"), (F.col("end_n") == 0).alias("free")), "waits")
    settled = None
    while waits.take(1):
        ready = waits.groupBy(*key).agg(F.min("free").alias("ready"), F.max("dist").alias("level"), F.bool_or(F.col("dist").isNull()).alias("lost"))
        ready = spool(ready.filter("ready AND NOT lost").select(*key, "level"), "ready")
        if not ready.take(1):
            break
        settled = ready if settled is None else spool(settled.unionByName(ready), "settled")
        left = waits.join(ready.select(*key), key, "left_anti")
        ends = ready.select("conv_id", F.col("id").alias("ptr"), F.col("level").alias("end_level"))
        left = left.join(ends, ["conv_id", "ptr"], "left")
        # A waiting reference to a settled call is freed, its distance now counted from calls without references.
        freed = F.col("end_level").isNotNull() & ~F.col("free")
        waits = spool(left.select(*key, "ptr", F.when(freed, F.col("dist") + F.col("end_level")).otherwise(F.col("dist")).alias("dist"), (F.col("free") | freed).alias("free")), "waits")
    known = known if settled is None else known.unionByName(settled)
    ends = known.select("conv_id", F.col("id").alias("ptr"), F.col("level").alias("end_level"))
    return reach.join(ends, ["conv_id", "ptr"], "left").select(*key, F.when(F.col("end_n") != 1, F.col("end_level") + F.col("dist")).cast("int").alias("level"))


def link_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row for each call, each result without a call, and each other message; a message with calls has one for its text.

    messages: conv_id, turn, role, text, calls (array of id, name, arguments as JSON text), result_of (id or null).
    Returns conv_id, turn, place, role, id, result_turn, level, status, fault, json. A conversation's calls in the order
    (level, turn, place) follow their references. status: linked; no_result; invalid (fault says why; the result, if
    any, stays linked); cycle; repeated_call and repeated_result (an id used before: the first by turn, then place,
    counts); orphan_result; message. A reference to an id that the conversation lacks is a fault of the call.
    A null or empty id links to nothing, and so do rows of a null conversation: their calls have level 0 and no result,
    their results are orphans. Null texts and arguments are null in the JSON; arguments that can't be read as JSON, or hold
    a number out of range or half a surrogate pair, stay text in it. Rows that repeat are repeated calls or messages.
    Other columns are left out. No rows give no rows. `schemas` is a parameter, tool -> field -> (type, required).
    """
    rows = messages.select("conv_id", "turn", "role", "text", F.col("calls").cast(CALL).alias("calls"), F.col("result_of").cast("string").alias("result_of"))
    key = ["conv_id", "id"]
    calls = rows.select("conv_id", "turn", "role", F.posexplode("calls").alias("place", "call")).select("conv_id", "turn", "role", "place", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    needs = F.pandas_udf(lambda texts: texts.map(references), "array<string>")("arguments")
    named = calls.filter("id <> '' AND conv_id IS NOT NULL").select(*key, F.struct("turn", "place", needs.alias("needs")).alias("call"))
    answered = rows.filter("result_of <> '' AND conv_id IS NOT NULL").select("conv_id", F.col("result_of").alias("id"), F.struct("turn", "text").alias("answer"))
    both = named.unionByName(answered, allowMissingColumns=True)
    met = spool(both.groupBy(*key).agg(F.min("call").alias("call"), F.min("answer").alias("result")), "met")

    nodes = met.filter("call IS NOT NULL").select(*key, "call.needs")
    there = nodes.select("conv_id", F.col("id").alias("needs"), F.lit(True).alias("there"))
    wanted = spool(nodes.select(*key, F.explode("needs").alias("needs")).join(there, ["conv_id", "needs"], "left"), "references")
    lost = wanted.filter("there IS NULL").groupBy(*key).agg(F.min("needs").alias("lost"))
    found = levels(nodes.select(*key), wanted.filter("there").select(*key, "needs"))
    at = F.struct("call.turn", "call.place")
    links = met.join(found, key, "left").join(lost, key, "left").select(*key, F.when(F.col("call").isNotNull(), at).alias("at"), "result", "level", F.col("level").isNull().alias("cycle"), "lost")
    links = spool(links, "links")

    linked = calls.join(links, key, "left")
    again = F.coalesce(F.col("at") < F.struct("turn", "place"), F.lit(False))
    cycle = F.coalesce("cycle", F.lit(False))
    null = lambda kind: F.lit(None).cast(kind)
    called = linked.select(
        "conv_id", "turn", "place", "role", "id", "name", "arguments", F.when(~again, F.col("result.turn")).alias("result_turn"), F.when(~again, F.col("result.text")).alias("text"),
        F.when(cycle, null("int")).otherwise(F.coalesce("level", F.lit(0))).alias("level"), F.when(again, "repeated_call").when(cycle, "cycle").alias("status"), F.when(~again, F.col("lost")).alias("lost"), F.lit("call").alias("kind"),
    )
    answers = rows.filter("result_of <> ''").select("conv_id", "turn", "role", "text", F.col("result_of").alias("id")).join(links.select(*key, "at", "result"), key, "left")
    unused = F.when(F.col("at").isNull(), "orphan_result").when(F.struct("turn", "text") != F.col("result"), "repeated_result")
    answers = answers.withColumn("status", unused).filter("status IS NOT NULL")
    said = (F.coalesce(F.size("calls"), F.lit(0)) <= 0) | F.coalesce(F.col("text") != "", F.lit(False))
    plain = rows.filter(said & F.coalesce(F.col("result_of") == "", F.lit(True))).withColumns({"id": null("string"), "status": F.lit("message")})
    other = answers.select("conv_id", "turn", "role", "text", "id", "status").unionByName(plain.select("conv_id", "turn", "role", "text", "id", "status"))
    other = other.select("conv_id", "turn", null("int").alias("place"), "role", "id", null("string").alias("name"), null("string").alias("arguments"), null(rows.schema["turn"].dataType).alias("result_turn"), "text", null("int").alias("level"), "status", null("string").alias("lost"), F.lit("message").alias("kind"))

    def write(kind: pd.Series, role: pd.Series, id_: pd.Series, name: pd.Series, arguments: pd.Series, text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        def one(kind, role, id_, name, arguments, text, lost):
            if kind == "message":
                return None, canonical({"content": text, "role": role, "tool_call_id": id_} if id_ else {"content": text, "role": role})
            given, fault = parsed(arguments)
            fault = "unknown tool" if name not in schemas else fault or invalid(name, given, schemas) or (f"unknown reference {lost}" if lost else None)
            return fault, canonical({"arguments": given, "id": id_, "name": name, "result": text, "role": role})

        clean = lambda s: s.astype(object).where(s.notna(), None)
        found = [one(*r) for r in zip(*map(clean, (kind, role, id_, name, arguments, text, lost)), strict=True)]
        return pd.DataFrame(found, columns=["fault", "json"])

    written = F.pandas_udf(write, "fault string, json string")("kind", "role", "id", "name", "arguments", "text", "lost")
    every = called.unionByName(other).withColumn("written", written)
    status = F.coalesce("status", F.when(F.col("written.fault").isNotNull(), "invalid").when(F.col("result_turn").isNull(), "no_result").otherwise("linked"))
    return every.select("conv_id", "turn", "place", "role", "id", "result_turn", "level", status.alias("status"), F.col("written.fault").alias("fault"), F.col("written.json").alias("json"))


def as_calls(conversations: DataFrame) -> DataFrame:
    """Chats without calls as messages for link_calls(): a user turn calls `reply`, the assistant turn after it is the result.

    The call's arguments hold the text, which is not said a second time, and the turn, and refer to the call two turns before where that is a user's too.
    """
    key = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turn = F.col("turn")
    earlier = conversations.filter("role = 'user'").select("conv_id", (turn + 2).alias("turn"), F.lit(True).alias("earlier")).distinct()
    rows = conversations.select("conv_id", "turn", "role", "text").join(earlier, ["conv_id", "turn"], "left")
    user = F.col("role") == "user"
    after = F.when(F.col("earlier"), F.struct(key(turn - 2).alias("$ref")))
    call = F.struct(key(turn).alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), turn.alias("turn"), after.alias("after"))).alias("arguments"))
    said = F.when(user, F.lit(None)).otherwise(F.col("text")).alias("text")
    return rows.select("conv_id", "turn", "role", said, F.when(user, F.array(call)).otherwise(F.array().cast(CALL)).alias("calls"), F.when(F.col("role") == "assistant", key(turn - 1)).alias("result_of"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations."""
    return link_calls(as_calls(table(spark, sf_dir, "conversations")))

