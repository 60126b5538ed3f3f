"""Tool-call linking in conversations: calls, results, their order, checks and canonical JSON."""

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and whole floats written as integers."""
    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """How a value breaks a JSON schema of type, enum, const, required, properties,
    additionalProperties, items, pattern, anyOf, allOf, oneOf, not, and limits of numbers, lengths
    and counts. A type that is none, a pattern that is none, and `$ref` are told as what cannot be checked."""
    kinds = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds is not None:
        def fits(kind):
            if kind in ("number", "integer"):
                return number and (kind == "number" or float(value).is_integer())
            return isinstance(value, KINDS[kind])
        named = [kinds] if isinstance(kinds, str) else kinds
        if not isinstance(named, list) or not all(isinstance(k, str) and (k in KINDS or k in ("number", "integer")) for k in named):
            return [f"{at}: unknown type {canonical(kinds)}"]
        if not any(fits(k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return [f"{at}: not {kinds}"]
    out = [f"{at}: $ref is not followed"] if "$ref" in schema else []
    out += [problem for part in schema.get("allOf", []) for problem in violations(value, part, at)]
    if "anyOf" in schema and all(violations(value, part, at) for part in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, part, at) for part in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: what it must not be")
    if isinstance(value, str) and "pattern" in schema:
        try:
            out += [] if re.search(schema["pattern"], value) else [f"{at}: not the pattern"]
        except (re.error, TypeError):
            out.append(f"{at}: unknown pattern")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if number:
        out += [f"{at}: under minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: over maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: under {low}"] if len(value) < schema.get(low, 0) else []
        out += [f"{at}: over {high}"] if len(value) > schema.get(high, len(value)) else []
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def _reject(name):
    raise ValueError(f"{name} is no JSON")


def check_column(schemas: dict[str, dict]):
    """(tool, arguments text) to (canonical arguments or null, list of violations)."""
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tools, texts in batches:
            out = []
            for tool, text in zip(tools, texts):
                try:
                    value = json.loads(text if isinstance(text, str) else "", parse_constant=_reject)
                    line = canonical(value)
                except (ValueError, RecursionError):
                    out.append((None, ["$: not JSON"]))
                    continue
                found = violations(value, schemas[tool]) if tool in schemas else ["unknown tool"]
                out.append((line, found))
            yield pd.DataFrame(out, columns=["canonical", "problems"])

    return F.pandas_udf(run, "canonical string, problems array<string>")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that can be ordered: 0 without needs,
    else one more than the highest level needed.

    `calls` has conv_id, call_id and needs, the ids of calls of that conversation.
    Chains of calls that need one other are followed by pointer doubling, in rounds
    that grow with the logarithm of their length. What is left are calls that need
    several: a round settles all whose needs are settled, and these rounds are as
    many as the longest path of such calls. Each round is a join on the call, so a
    conversation of any size is spread over tasks. Needs that name no call are
    ignored; calls on a cycle, and those that need them, get no level.
    """
    keys = ["conv_id", "call_id"]
    edges = calls.select(*keys, F.explode(F.array_distinct("needs")).alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = written(edges.join(known, ["conv_id", "need"], "left_semi"), "calls")
    needs = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    # each call points down its chain, at last to a call with no or several needs
    chain = written(calls.select(*keys).join(needs, keys, "left").select(
        *keys, F.when(single, F.col("need")).otherwise(F.col("call_id")).alias("foot"), single.cast("long").alias("steps"), (~single).alias("done"), F.col("n").isNull().alias("free")), "calls")
    settled, before = chain.where("done").count(), -1
    while settled > before:
        below = chain.select("conv_id", F.col("call_id").alias("foot"), F.col("foot").alias("to"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        chain = written(chain.where("not done").join(below, ["conv_id", "foot"]).select(
            *keys, F.col("to").alias("foot"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"), "free").unionByName(chain.where("done")), "calls")
        before, settled = settled, chain.where("done").count()
    chain = chain.where("done")

    # between the feet of chains; a need without a foot stays open for good
    feet = chain.select("conv_id", F.col("call_id").alias("need"), "foot", (F.col("steps") + 1).alias("steps"))
    waiting = written(edges.join(needs.where("n > 1").select(*keys), keys, "left_semi").join(feet, ["conv_id", "need"], "left").select(*keys, "foot", "steps"), "calls")
    fresh = written(chain.where("free and steps = 0").select(*keys, F.lit(0).cast("long").alias("level")), "calls")
    done = fresh
    while not fresh.isEmpty() and not waiting.isEmpty():
        at = done.select("conv_id", F.col("call_id").alias("foot"), "level")
        reached = waiting.join(at, ["conv_id", "foot"], "left").groupBy(*keys).agg(
            F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        fresh = written(reached.where("open = 0").select(*keys, "level"), "calls")
        waiting = written(waiting.join(fresh.select(*keys), keys, "left_anti"), "calls")
        done = done.unionByName(fresh)
    done = done.select("conv_id", F.col("call_id").alias("foot"), "level")
    return chain.join(done, ["conv_id", "foot"]).select(*keys, (F.col("level") + F.col("steps")).cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Link tool calls to their results, order them, check their arguments and write them as JSON.

    `calls` has conv_id, turn, call_id, tool, arguments (JSON text) and needs (ids of
    calls whose results it uses); `results` has conv_id, turn, call_id, content.
    Both are hashed on (conv_id, call_id) and joined. If an id is called twice the
    first turn counts and later calls are marked `repeated`; of several results the
    first counts and the others are rows of status `extra`. Rows without conv_id or call_id are left out.

    Returns one row per call: (conv_id, turn, call_id, tool, level, result_turn,
    status, problems, message). level orders the calls of a conversation so that
    each comes after those it needs, ties by turn; it is null on cycles. status is
    `linked`, `unanswered`, or `early` for a result before its call; results without a call
    are rows of status `orphan`. problems lists what breaks the tool's schema;
    message is the canonical JSON of call and result, with the arguments as read,
    or as text if they are no JSON. Empty tables give no rows; other columns are ignored.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.where("conv_id is not null and call_id is not null").select(*keys, "turn", "tool", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    asked = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_last(), "tool", "arguments")
    calls = written(calls.withColumn("nth", F.row_number().over(asked)), "calls")
    first = calls.where("nth = 1")
    told = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_last(), "content")
    results = results.where("conv_id is not null and call_id is not null").select(
        *keys, F.struct(F.col("turn").alias("result_turn"), F.col("content").alias("content")).alias("answer"), F.row_number().over(told).alias("place"))
    results = written(results, "calls")
    both = calls.join(results.where("place = 1").drop("place"), keys, "full").withColumn("extra", F.lit(False))
    both = both.unionByName(results.where("place > 1").drop("place").withColumn("extra", F.lit(True)), allowMissingColumns=True)
    orphan = F.col("nth").isNull()
    status = (F.when(F.col("extra"), "extra").when(orphan, "orphan").when(F.col("nth") > 1, "repeated").when(F.col("answer").isNull(), "unanswered")
              .when(F.col("answer.result_turn") < F.col("turn"), "early").otherwise("linked"))
    checked = both.withColumn("status", status).withColumn("check", check_column(schemas)(F.col("tool"), F.col("arguments")))
    checked = checked.join(levels(first.select(*keys, "needs")), keys, "left")

    def serialise(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ids, tools, lines, texts, contents, status in batches:
            out = []
            for i, tool, line, text, content, s in zip(ids, tools, lines, texts, contents, status):
                body = {"id": i, "result": None if pd.isna(content) else content, "status": s}
                if s not in ("orphan", "extra"):
                    body |= {"name": None if pd.isna(tool) else tool, "arguments": json.loads(line) if isinstance(line, str) else None if pd.isna(text) else text}
                out.append(canonical(body))
            yield pd.Series(out)

    message = F.pandas_udf(serialise, "string")(F.col("call_id"), "tool", "check.canonical", "arguments", "answer.content", "status")
    problems = F.when(F.col("nth").isNull(), F.array().cast("array<string>")).otherwise(F.col("check.problems"))
    level = F.when(F.col("nth") == 1, F.col("level"))
    return checked.select("conv_id", "turn", "call_id", "tool", level.alias("level"), F.col("answer.result_turn").alias("result_turn"), "status",
                          problems.alias("problems"), message.alias("message"))


# The given conversations hold no tool calls, so their turns are read as such.
SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
            "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}},
    "instruct": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "maximum": 0}}},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read turns (conv_id, turn, role, text) as tool calls and results.

    A user or system turn is a call of `ask` or `instruct` with its whole text; an
    assistant turn is the result of the call one turn earlier. A call needs the
    call two turns earlier, if there is one. Other turns are in other_turns.
    """
    turn = F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("call-"), F.xxhash64("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    chained = (F.col("role") == "user") & (turn >= 2)
    body = F.struct(F.col("text"), turn.alias("turn"), F.when(chained, name(turn - 2)).alias("after"))
    calls = conversations.where(F.col("role").isin("user", "system")).select(
        "conv_id", turn.alias("turn"), name(turn).alias("call_id"), F.when(F.col("role") == "user", "ask").otherwise("instruct").alias("tool"),
        F.to_json(body).alias("arguments"), F.when(chained, F.array(name(turn - 2))).alias("needs"))
    results = conversations.where(F.col("role") == "assistant").select("conv_id", turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that are neither call nor result as rows like those of link: of
    status `unplaced` without conversation or number, `other` with another or no role."""
    turn = F.col("turn").cast("long")
    status = F.when(F.col("conv_id").isNull() | turn.isNull(), "unplaced").when(~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False)), "other")

    def serialise(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for roles, texts, states in batches:
            yield pd.Series([canonical({"role": r if isinstance(r, str) else None, "text": t if isinstance(t, str) else None, "status": s})
                             for r, t, s in zip(roles, texts, states)], dtype=object)

    rest = conversations.withColumn("status", status).where("status is not null")
    null = lambda kind: F.lit(None).cast(kind)
    return rest.select("conv_id", turn.alias("turn"), null("string").alias("call_id"), null("string").alias("tool"), null("int").alias("level"), null("long").alias("result_turn"),
                       "status", F.array().cast("array<string>").alias("problems"), F.pandas_udf(serialise, "string")("role", "text", "status").alias("message"))


def link_turns(conversations: DataFrame) -> DataFrame:
    """link for turns read as calls and results: a row for every turn that is no linked result."""
    return link(*turns_as_calls(conversations.where("conv_id is not null and turn is not null")), SCHEMAS).unionByName(other_turns(conversations))
