"""Chat formatting: tool calls linked to their results, ordered and serialised.

Calls and results are joined by identifier, put in an order in which a result
stands behind its call and a call behind the results that its arguments refer
to, checked against argument schemas, and written as canonical JSON (sorted
keys, no spaces, UTF-8, shortest numbers). Rows stay one for each message, and
messages that neither call nor answer are joined to nothing, so a conversation
with most of the rows is never in one task.

The order takes rounds that double the reach of a chain of calls and results,
then one round for each layer of calls that wait for several results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, staged

#: Schemas by tool name; only the keywords that check() knows.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {
            "prompt": {"type": "string", "minLength": 1, "maxLength": 1000},
            "turn": {"type": "integer", "minimum": 0},
            "context": {"type": "string", "pattern": "^\\$result:"},
            "system": {"type": "boolean"},
        },
        "additionalProperties": False,
    },
}
#: Arguments and contents that are nested deeper make a plain message.
MAX_DEPTH = 200
_REF = re.compile(r"^\$result:(.+)$")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON text of a value; numbers that are whole have no fraction."""
    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        return v

    return well_formed(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


_LONE = re.compile("[\ud800-\udfff]")


def well_formed(text: str) -> str:
    """The text with lone surrogates, which no encoding has, as the escapes they came from."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def depth(value) -> int:
    """Levels of nesting."""
    n, level = 0, [value]
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        n += 1
    return n


def identifier(value) -> str | None:
    """A string or whole number as an identifier; anything else is none."""
    if isinstance(value, str):
        return well_formed(value)
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else None


def check(value, schema: dict, at: str = "$") -> list[str]:
    """Faults of a value against a schema: type, enum, required, properties, additionalProperties, items, bounds, lengths, pattern."""
    kind = schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]

        def is_a(k: str) -> bool:
            if k in ("integer", "number"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or isinstance(value, int) or value.is_integer())
            return isinstance(value, _TYPES[k]) if k in _TYPES else False

        if not any(map(is_a, kinds)):
            return [f"{at}: not {'/'.join(kinds)}"]
    faults = []
    if "enum" in schema and value not in schema["enum"]:
        faults.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        faults += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                faults += check(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                faults.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            faults += check(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        faults += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        faults += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        if "pattern" in schema and not re.search(schema["pattern"], value):
            faults.append(f"{at}: no match of pattern")
    return faults


def references(value) -> list[str]:
    """Identifiers of the results that arguments refer to: strings "$result:ID" at any depth."""
    if isinstance(value, str):
        m = _REF.match(value)
        return [m[1]] if m else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return sorted({r for x in inner for r in references(x)})


def parse_messages(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, kind, call_id, name, arguments, refs) from (conv_id, turn, role, text).

    A text that is a JSON object {"tool_call": {"id", "name", "arguments"}} is a
    call, {"tool_result": {"id", "content"}} a result, anything else a plain
    message. A message with several calls ({"tool_calls": [...]}) gives a row
    for each. `arguments` is canonical JSON; arguments that are a string are read
    as JSON, and stay a string where they are none. An id that is no string or
    whole number is null and links to nothing, a name that is no string is null.
    Lone surrogates come as escapes. What is nested deeper than MAX_DEPTH is a
    plain message.
    """
    schema = "conv_id long, turn long, part int, role string, text string, kind string, call_id string, name string, arguments string, refs array<string>"
    types = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 6, pa.list_(pa.string()))

    def of(text: str | None) -> list[tuple]:
        plain = [("message", None, None, None, [])]
        if not text or not text.lstrip().startswith("{"):
            return plain
        try:
            top = json.loads(text)
            found = []
            calls = top.get("tool_calls") or ([top["tool_call"]] if "tool_call" in top else [])
            for c in calls:
                args = c.get("arguments")
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except ValueError:
                        pass
                if depth(args) > MAX_DEPTH:
                    return plain
                name = c.get("name")
                found.append(("call", identifier(c.get("id")), well_formed(name) if isinstance(name, str) else None, canonical(args), sorted(map(well_formed, references(args)))))
            if "tool_result" in top:
                r = top["tool_result"]
                if depth(r.get("content")) > MAX_DEPTH:
                    return plain
                found.append(("result", identifier(r.get("id")), None, canonical(r.get("content")), []))
            return found or plain
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            return plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["conv_id"], r["turn"], i, r["role"], r["text"], *x) for r in batch.to_pylist() for i, x in enumerate(of(r["text"]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_batches(df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")), run, schema)


def turns_as_calls(df: DataFrame) -> DataFrame:
    """Tool calls and results as parse_messages() finds them; what is left of a dialogue as calls of the tool `reply`.

    A user's turn calls, the assistant's next turn is the result. The identifier
    is the calling turn's number, `by_turn` keeps it apart from identifiers that
    messages name. From turn 2 on a call's argument `context` refers to the
    result of the call two turns before. Other turns stay messages.
    """
    df = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # only texts that begin like a JSON object can hold a call
    json_like = F.coalesce(F.col("text").rlike("^[ \\t\\r\\n]*\\{"), F.lit(False))
    none = F.lit(None).cast("string")
    plain = df.where(~json_like).select("conv_id", "turn", F.lit(0).alias("part"), "role", "text", F.lit("message").alias("kind"), none.alias("call_id"), none.alias("name"), none.alias("arguments"), F.array().cast("array<string>").alias("refs"))
    rows = plain.unionByName(parse_messages(df.where(json_like)))
    left = F.col("kind") == "message"
    asks, answers = left & F.coalesce(F.col("role") == "user", F.lit(False)), left & F.coalesce(F.col("role") == "assistant", F.lit(False))
    earlier = F.when(F.col("turn") >= 2, (F.col("turn") - 2).cast("string"))
    args = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn", F.concat(F.lit("$result:"), earlier).alias("context")))
    return rows.select(
        "conv_id", "turn", "part", "role", "text",
        F.when(asks, "call").when(answers, "result").otherwise(F.col("kind")).alias("kind"),
        F.when(asks, F.col("turn").cast("string")).when(answers, (F.col("turn") - 1).cast("string")).otherwise(F.col("call_id")).alias("call_id"),
        F.when(asks, "reply").otherwise(F.col("name")).alias("name"),
        F.when(asks, args).otherwise(F.col("arguments")).alias("arguments"),
        F.when(asks & earlier.isNotNull(), F.array(earlier)).otherwise(F.col("refs")).alias("refs"), (asks | answers).alias("by_turn"),
    )


def link(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Linked, ordered, validated and serialised rows of parsed messages.

    Returns conv_id, turn, part, role, kind, call_id, status, place, level,
    faults, json. status: `linked` (call with a result, or result with a call),
    `open` (call without), `orphan` (result without), `cyclic` (a call whose
    arguments depend on its own result), `message`. Of calls with one
    identifier the first by (turn, part) counts, the others are `repeated`;
    a call may have several results. (place, level) orders a conversation: the
    turn, or that of what must come before it if that is later, then the depth
    of such dependencies. Ties keep (turn, part). faults: what check() says of
    a call's arguments, then references to results that are not there. A null
    conversation, turn or identifier is linked to nothing; repeated rows give a
    row each; an empty table gives none. Where messages have a column
    `by_turn`, identifiers are compared within each of its values.
    """
    if "by_turn" not in messages.columns:
        messages = messages.withColumn("by_turn", F.lit(False))
    key = ["conv_id", "by_turn", "call_id"]
    rows = staged(messages.withColumn("uid", F.monotonically_increasing_id()), "chat")
    # identifiers only; texts and arguments are joined to the outcome once, at the end
    slim = rows.where("kind <> 'message'").select("uid", "conv_id", "turn", "part", "kind", "by_turn", "call_id", "refs")
    named = slim.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
    results = named.where("kind = 'result'")
    firsts = named.where("kind = 'call'").groupBy(*key).agg(F.min(F.struct("turn", "part", "uid")).alias("f")).select(*key, F.col("f.uid").alias("call_uid"))
    answered = results.groupBy(*key).agg(F.count("*").alias("answers"))
    status = (
        F.when(F.col("kind") == "result", F.when(F.col("call_uid").isNull(), "orphan").otherwise("linked"))
        .when(F.col("call_uid") != F.col("uid"), "repeated")
        .when(F.col("answers").isNull(), "open")
        .otherwise("linked")
    )
    out = named.join(firsts, key, "left").join(answered, key, "left").select("uid", status.alias("status"))
    # what must come before: a result's call, a call's referred results
    after_call = results.join(firsts, key).select("uid", F.col("call_uid").alias("before"))
    refs = slim.where("kind = 'call'").select("uid", "conv_id", "by_turn", F.explode("refs").alias("call_id"))
    after_result = refs.join(results.select(*key, F.col("uid").alias("before")), key).select("uid", "before")
    missing = refs.join(answered, key, "left_anti").groupBy("uid").agg(F.sort_array(F.collect_set("call_id")).alias("missing"))
    edges = staged(after_call.unionByName(after_result).distinct(), "chat-edges")
    order = _order(slim.select("uid", F.coalesce("turn", F.lit(-1)).alias("place")), edges)
    out = slim.select("uid").join(out, "uid", "left").join(order, "uid", "left").join(missing, "uid", "left")
    out = rows.drop("refs").join(out, "uid", "left")
    alone = F.when(F.col("kind") == "message", "message").when(F.col("kind") == "result", "orphan").otherwise("open")
    out = out.select(
        "conv_id", "turn", "part", "role", "text", "kind", "call_id", "name", "arguments",
        F.when(F.col("cyclic"), "cyclic").otherwise(F.coalesce("status", alone)).alias("status"),
        F.when(F.col("place") >= 0, F.col("place")).otherwise(F.col("turn")).alias("place"), F.coalesce("level", F.lit(0)).alias("level"), "missing",
    )
    return _serialise(out, schemas)


def _chains(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, head, place, steps, done) of the rows that have one predecessor.

    Each round a row takes over how far the row it points to has come, so the
    reach doubles. The head is the first row behind a chain that has no
    predecessor or several; `place` is the latest of the chain's, without the
    head's. Rows that are not done when a round brings none forward are on a
    cycle of such rows or behind one.
    """
    single = edges.groupBy("uid").agg(F.count("*").alias("n"), F.min("before").alias("head")).where("n = 1").drop("n")
    state = staged(single.join(places, "uid").withColumns({"steps": F.lit(1).cast("long"), "done": F.lit(False)}), "chat-chains")
    left = None
    while True:
        to_do = state.where("NOT done").count()
        if not to_do or to_do == left:
            return state
        left = to_do
        ahead = state.select(F.col("uid").alias("a_uid"), F.col("head").alias("a_head"), F.col("place").alias("a_place"), F.col("steps").alias("a_steps"), F.col("done").alias("a_done"))
        moved = state.where("NOT done").join(ahead, F.col("head") == F.col("a_uid"), "left").select(
            "uid", F.coalesce("a_head", "head").alias("head"), F.greatest("place", "a_place").alias("place"),
            (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"), F.coalesce("a_done", F.lit(True)).alias("done"),
        )
        fresh = staged(state.where("done").unionByName(moved), "chat-chains")
        dropped(state)
        state = fresh


def _order(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, place, level, cyclic) of all rows; those on or behind a cycle have neither place nor level."""
    heads = places.join(edges.select("uid").distinct(), "uid", "left_anti").withColumn("level", F.lit(0).cast("long"))
    if edges.isEmpty():
        return heads.select("uid", "place", F.col("level").cast("int"), F.lit(False).alias("cyclic"))
    chains = _chains(places, edges)
    several = edges.join(edges.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1"), "uid")
    fresh, found, waits = staged(heads, "chat-order"), [], not several.isEmpty()
    waiting = several.select("uid", "before", "n").withColumns({"b_place": F.lit(None).cast("long"), "b_level": F.lit(None).cast("long")})
    while True:
        found.append(fresh)
        top = fresh.select(F.col("uid").alias("head"), F.col("place").alias("h_place"), F.col("level").alias("h_level"))
        behind = chains.where("done").join(top, "head").select("uid", F.greatest("place", "h_place").alias("place"), (F.col("steps") + F.col("h_level")).alias("level"))
        behind = staged(behind, "chat-order")
        found.append(behind)
        if not waits:
            break
        # the rows with several predecessors whose last one has just got its place
        new = fresh.unionByName(behind).select(F.col("uid").alias("before"), F.col("place").alias("n_place"), F.col("level").alias("n_level"))
        waiting = staged(waiting.join(new, "before", "left").select("uid", "before", "n", F.coalesce("b_place", "n_place").alias("b_place"), F.coalesce("b_level", "n_level").alias("b_level")), "chat-waiting")
        ready = waiting.groupBy("uid").agg(F.max("n").alias("n"), F.count("b_level").alias("met"), F.max("b_place").alias("b_place"), F.max("b_level").alias("b_level")).where("met = n")
        fresh = staged(ready.join(places, "uid").select("uid", F.greatest("place", "b_place").alias("place"), (F.col("b_level") + 1).alias("level")), "chat-order")
        if fresh.isEmpty():
            break
        waiting = waiting.join(fresh, "uid", "left_anti")
    order = found[0]
    for x in found[1:]:
        order = order.unionByName(x)
    order = order.select("uid", "place", F.col("level").cast("int").alias("level"))
    return places.select("uid").join(order, "uid", "left").withColumn("cyclic", F.col("level").isNull())


def _serialise(rows: DataFrame, schemas: dict) -> DataFrame:
    schema = "conv_id long, turn long, part int, role string, kind string, call_id string, status string, place long, level int, faults array<string>, json string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                faults: list[str] = []
                body: dict = {"role": r["role"]}
                if r["kind"] == "call":
                    args = json.loads(r["arguments"]) if r["arguments"] is not None else None
                    faults = check(args, schemas[r["name"]]) if r["name"] in schemas else [f"$: no schema {r['name']}"]
                    faults += [f"$result:{x}: no result" for x in r["missing"] or ()]
                    body |= {"tool_call": {"id": r["call_id"], "name": r["name"], "arguments": args}}
                elif r["kind"] == "result":
                    body |= {"tool_result": {"id": r["call_id"], "content": json.loads(r["arguments"]) if r["arguments"] is not None else r["text"]}}
                else:
                    body |= {"content": r["text"]}
                out.append((*(r[k] for k in ("conv_id", "turn", "part", "role", "kind", "call_id", "status", "place", "level")), faults, canonical(body)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_batches(rows, run, schema)
