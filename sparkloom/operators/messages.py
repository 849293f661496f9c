"""Chat messages as array<struct<role, content, ...>>: merging, prefixes, pairing, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Chat roles and the aliases of the multimodal corpus.
ROLES = ("system", "developer", "user", "assistant", "tool")
ALIASES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system", "tool": "tool"}
_MESSAGE = "array<struct<role:string,content:string>>"


def collected(turns: DataFrame, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """conv, messages in order of turn; a conversation is one row, as its users need it whole."""
    item = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(content).alias("content"))
    ordered = F.sort_array(F.collect_list(item))
    return turns.groupBy(conv).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def merged(messages: Column) -> Column:
    """Roles by alias, unknown roles and empty contents out, contents normalized, neighbours of one role
    joined by a blank line (tool turns stay apart)."""
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    contents = T.normalize_all(F.transform(messages, lambda m: m["content"]))
    known = F.zip_with(messages, contents, lambda m, c: F.struct(F.try_element_at(alias, F.lower(m["role"])).alias("role"), c.alias("content")))
    known = F.filter(known, lambda m: m["role"].isNotNull() & (m["content"] != ""))

    def joined(k: Column) -> Column:
        """Runs of one role, by where they begin: each message is looked at once."""
        role = lambda i: F.get(k, i)["role"]
        n = F.size(k)
        begins = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (role(i) == "tool") | ~role(i).eqNullSafe(role(i - 1)))
        return _once(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(n)), lambda x, y: F.struct(role(x).alias("role"), F.array_join(F.transform(F.slice(k, x + 1, y - x), lambda m: m["content"]), "\n\n").alias("content"))))

    return _once(known, joined).cast(_MESSAGE)


def _once(c: Column, f) -> Column:
    """f of the column, which is worked out once and not for each element of what f goes through."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strictly_valid(messages: Column) -> Column:
    """All or nothing: a non-empty list in which every role is known."""
    return F.coalesce((F.size(messages) > 0) & F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))), F.lit(False))


def strictly_valid_json(raw: Column) -> Column:
    """array<struct<role, content>> of a JSON list, all or nothing: null if it is empty, or if an element is no
    object, has an unknown role or a content that is neither text, list nor null."""
    items = F.from_json(raw, "array<string>")

    def kind(item: Column, key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{key}", "variant"))

    def whole(item):
        content = F.coalesce(kind(item, "content"), F.lit("VOID"))
        return F.startswith(F.ltrim(item), F.lit("{")) & (kind(item, "role") == "STRING") & (content.isin("STRING", "VOID") | F.startswith(content, F.lit("ARRAY")))

    messages = F.from_json(raw, _MESSAGE)
    return F.when(strictly_valid(messages) & F.forall(items, lambda x: F.coalesce(whole(x), F.lit(False))), messages)


def tool_objects(raw: Column) -> Column:
    """array<string> of the JSON objects of a list, elements given as text included; null if one is no object."""
    items = F.from_json(raw, "array<string>")
    whole = F.forall(items, lambda x: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("OBJECT")), F.lit(False)))
    return F.when((F.size(items) > 0) & whole, items)


def json_objects(raw: Column) -> Column:
    """array<string> of the JSON objects of a list, elements given as text included; other elements are left out."""
    items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("OBJECT")), F.lit(False)))


def leniently_valid(messages: Column) -> Column:
    """Messages with a known role, its blanks off; the others are left out one by one."""
    known = F.filter(messages, lambda m: F.coalesce(T.strip(m["role"]).isin(*ROLES), F.lit(False)))
    return F.transform(known, lambda m: F.struct(T.strip(m["role"]).alias("role"), m["content"].alias("content")))


def last_user_prefixes(df: DataFrame, most: int, keep: list[str]) -> DataFrame:
    """For the last ``most`` user turns: turn_index, prefix and the assistant's next message ("" without one).

    most = 0 gives no rows.
    """
    at = F.filter(F.sequence(F.lit(0), F.size("messages") - 1), lambda i: F.get("messages", i)["role"] == "user")
    rows = df.where(F.size("messages") > 0).select(*keep, "messages", at.alias("_at"))
    last = F.slice("_at", F.greatest(F.size("_at") - F.lit(most) + 1, F.lit(1)), F.lit(most)) if most else F.array().cast("array<int>")
    rows = rows.select(*keep, "messages", F.explode(last).alias("turn_index"))
    after = F.get("messages", F.col("turn_index") + 1)
    return rows.select(*keep, F.col("turn_index").cast("long"), F.slice("messages", 1, F.col("turn_index") + 1).alias("prefix"), F.when(after["role"] == "assistant", after["content"]).otherwise("").alias("reference"))


def first_call_and_answer(turns: DataFrame, conv: str, turn: str, role: str, content: str, mark: str = "[", anywhere: bool = False) -> DataFrame:
    """The first call (content starts with the mark, or has it anywhere) and the first answer
    of each conversation, among assistant turns right behind a user or tool turn."""
    w = Window.partitionBy(conv).orderBy(turn)
    body = F.regexp_replace(content, r"(?U)^\s+", "")
    call = F.contains(F.col(content), F.lit(mark)) if anywhere else F.startswith(body, F.lit(mark))
    pairs = turns.withColumn("_before", F.lag(role).over(w)).where((F.col(role) == "assistant") & F.col("_before").isin("user", "tool")).withColumn("is_call", call)
    one = Window.partitionBy(conv, "is_call").orderBy(turn)
    return pairs.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").drop("_rn", "_before")


def paired(messages: Column, require_tool: bool = False, required: tuple[str, ...] = ()) -> Column:
    """struct<valid, errors, assistant_turns, tool_calls, tool_results> of a tool-using conversation.

    messages: array<struct<role, tool_call_id, tool_calls: array<struct<id, name>>>>.
    A result closes a call that was opened earlier and is open; an id may be
    used again after that. One fold over the messages in their order.
    """
    state = "struct<open:array<string>,errors:array<string>,turns:bigint,calls:bigint,results:bigint,names:array<string>>"
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("errors"), F.lit(0).cast("long").alias("turns"), F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("results"), F.array().cast("array<string>").alias("names")).cast(state)

    def opened(a, c):
        again = F.array_contains(a["open"], c["id"])
        return F.struct(
            F.when(again, a["open"]).otherwise(F.concat(a["open"], F.array(c["id"]))).alias("open"),
            F.when(again, F.concat(a["errors"], F.array(F.concat(F.lit("duplicate_tool_call_id:"), c["id"])))).otherwise(a["errors"]).alias("errors"),
            a["turns"].alias("turns"), (a["calls"] + 1).alias("calls"), a["results"].alias("results"), F.concat(a["names"], F.array(c["name"])).alias("names"),
        )

    def step(a, m):
        turn = F.struct(a["open"].alias("open"), a["errors"].alias("errors"), (a["turns"] + 1).alias("turns"), a["calls"].alias("calls"), a["results"].alias("results"), a["names"].alias("names"))
        calls = F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,name:string>>"))
        spoke = F.aggregate(calls, turn, opened)
        own = F.coalesce(m["tool_call_id"], F.lit(""))
        there = F.array_contains(a["open"], own)
        closed = F.struct(
            F.when(there, F.filter(a["open"], lambda x: x != own)).otherwise(a["open"]).alias("open"),
            F.when(there, a["errors"]).otherwise(F.concat(a["errors"], F.array(F.concat(F.lit("orphan_tool_result:"), own)))).alias("errors"),
            a["turns"].alias("turns"), a["calls"].alias("calls"), (a["results"] + 1).alias("results"), a["names"].alias("names"),
        )
        return F.when(m["role"] == "assistant", spoke).when(m["role"] == "tool", closed).otherwise(a)

    none = F.array().cast("array<string>")
    last = F.get(messages, F.size(messages) - 1)

    def finish(a):
        errors = [a["errors"], F.when(F.size(a["open"]) > 0, F.array(F.concat(F.lit("missing_tool_results:"), F.array_join(F.sort_array(a["open"]), ",")))).otherwise(none)]
        if require_tool:
            errors.append(F.when(a["calls"] == 0, F.array(F.lit("required_tool_call_missing"))).otherwise(none))
        for name in required:
            errors.append(F.when(F.array_contains(a["names"], name), none).otherwise(F.array(F.lit(f"required_tool_call_missing:{name}"))))
        ended = F.coalesce(last["role"] == "assistant", F.lit(False))
        errors.append(F.when(~ended, F.array(F.lit("trajectory_does_not_end_with_assistant"))).when(F.coalesce(F.size(last["tool_calls"]), F.lit(0)) > 0, F.array(F.lit("trajectory_ends_with_unresolved_tool_call"))).otherwise(none))
        every = F.concat(*errors)
        return F.struct((F.size(every) == 0).alias("valid"), every.alias("errors"), a["turns"].alias("assistant_turns"), a["calls"].alias("tool_calls"), a["results"].alias("tool_results"))

    return F.aggregate(messages, start, step, finish)


def paired_rows(turns: DataFrame, conv: str, order: str, role: str = "role", own: str = "tool_call_id", calls: str = "tool_calls", require_tool: bool = False, required: tuple[str, ...] = ()) -> DataFrame:
    """paired for turns as rows: conv, valid, errors, assistant_turns, tool_calls and tool_results of each conversation.

    What happens to one call id is a sequence of its own: a call after a call
    is a duplicate, a result after no call an orphan, and a call at the end
    has no result. So no set of open calls is carried along, and a
    conversation of any length is sorted, not folded. Turns of one order are
    in any order; the calls of a turn come in theirs.
    """
    d = turns.select(F.col(conv).alias("conv"), F.col(order).alias("at"), F.col(role).alias("role"), F.coalesce(F.col(own), F.lit("")).alias("own"), F.coalesce(F.col(calls), F.array().cast("array<struct<id:string,name:string>>")).alias("calls"))
    opened = d.where("role = 'assistant'").select("conv", "at", F.posexplode("calls").alias("sub", "c")).select("conv", "at", "sub", F.lit("call").alias("kind"), F.col("c.id").alias("id"), F.col("c.name").alias("name"))
    closed = d.where("role = 'tool'").select("conv", "at", F.lit(0).alias("sub"), F.lit("result").alias("kind"), F.col("own").alias("id"), F.lit(None).cast("string").alias("name"))
    by_id = Window.partitionBy("conv", "id").orderBy("at", "sub")
    e = opened.unionByName(closed).withColumn("before", F.lag("kind").over(by_id)).withColumn("after", F.lead("kind").over(by_id))
    call, after_call = F.col("kind") == "call", F.col("before").eqNullSafe("call")
    wrong = F.when(call & after_call, F.concat(F.lit("duplicate_tool_call_id:"), "id")).when(~call & ~after_call, F.concat(F.lit("orphan_tool_result:"), "id"))
    left = F.when(call & F.col("after").isNull(), F.col("id"))
    listed = lambda c: F.collect_list(F.when(c.isNotNull(), F.struct("at", "sub", c.alias("what"))))
    events = e.groupBy("conv").agg(
        F.transform(F.sort_array(listed(wrong)), lambda x: x["what"]).alias("wrong"), F.sort_array(F.collect_set(left)).alias("left"),
        F.count_if(call).alias("tool_calls"), F.count_if(~call).alias("tool_results"), *[F.coalesce(F.bool_or(F.col("name") == n), F.lit(False)).alias(f"_{i}") for i, n in enumerate(required)],
    )
    whole = d.groupBy("conv").agg(F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.max_by(F.struct("role", F.size("calls").alias("n")), "at").alias("last"))
    j = whole.join(events, "conv", "left")
    none = F.array().cast("array<string>")
    some = lambda bad, what: F.when(bad, F.array(what)).otherwise(none)
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    errors = [F.coalesce("wrong", none), some(n(F.size("left").cast("long")) > 0, F.concat(F.lit("missing_tool_results:"), F.array_join("left", ",")))]
    if require_tool:
        errors.append(some(n(F.col("tool_calls")) == 0, F.lit("required_tool_call_missing")))
    errors += [some(~F.coalesce(f"_{i}", F.lit(False)), F.lit(f"required_tool_call_missing:{name}")) for i, name in enumerate(required)]
    ended = F.col("last.role").eqNullSafe("assistant")
    errors += [some(~ended, F.lit("trajectory_does_not_end_with_assistant")), some(ended & (F.col("last.n") > 0), F.lit("trajectory_ends_with_unresolved_tool_call"))]
    every = F.concat(*errors)
    return j.select(F.col("conv").alias(conv), (F.size(every) == 0).alias("valid"), every.alias("errors"), "assistant_turns", n(F.col("tool_calls")).alias("tool_calls"), n(F.col("tool_results")).alias("tool_results"))


def distinct_tools(tools: Column) -> Column:
    """Tools (structs with a name) in order, the first of each name; unnamed ones out."""
    named = F.filter(tools, lambda t: F.coalesce(t["name"], F.lit("")) != "")
    names = F.transform(named, lambda t: t["name"])
    return F.filter(named, lambda t, i: F.array_position(names, t["name"]) == i + 1)


def with_system_note(messages: Column, note: str) -> Column:
    """The note once behind the first system message, or as a system message in front."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    added = F.transform(messages, lambda m, i: F.when((i + 1 == at) & ~F.contains(m["content"], F.lit(note)), F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\n\n"), F.lit(note)).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))
    return F.when(at > 0, added).otherwise(F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(note).alias("content"))), added))


def rendered(messages: Column) -> Column:
    """<role>content</role> of every message, one after the other."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m["role"], F.lit(">"), m["content"], F.lit("</"), m["role"], F.lit(">"))), "")


def assistant_mask(messages: Column) -> Column:
    """One 0/1 for each character of ``rendered``: 1 inside an assistant's content.

    With a template that joins spans, running lengths are all that is needed.
    """
    def spans(m):
        on = F.when(m["role"] == "assistant", 1).otherwise(0)
        tag = F.length(m["role"])
        return F.concat(F.array_repeat(F.lit(0), tag + 2), F.array_repeat(on, F.length(m["content"])), F.array_repeat(F.lit(0), tag + 3))

    return F.flatten(F.transform(messages, spans))


def supervised(mask: Column) -> Column:
    """Set positions, the last one not counted: nothing follows it."""
    return F.aggregate(F.slice(mask, 1, F.greatest(F.size(mask) - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)


def terminal_reason(rounds: Column, most: int, pending: Column) -> Column:
    """Why a recorded rollout ended: the last round's finish reason, or the limit."""
    last = F.get(rounds, F.size(rounds) - 1)
    full = F.size(rounds) >= most
    return F.when(last["finish_reason"].isin("length", "max_tokens", "content_filter"), last["finish_reason"]).when(full & (pending > 0), "max_rounds_with_pending_user_turns").when(full & (last["n_calls"] > 0), "max_rounds").otherwise("final_answer")
