"""JSON operators fed with the tables' own texts: quotes, line ends and letters of all kinds inside lists, tools, calls and arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import conditions as C
from ..operators import messages as M
from ..operators import tools
from .registry import query


@query("""WITH d AS (SELECT doc_id, 0 AS position, lang AS name, text AS description, '{"n":' || n_chars || ',"type":"object"}' AS parameters FROM documents
UNION ALL SELECT doc_id, 1, source, '', '{"a":' || to_json(text) || ',"b":' || n_chars || '}' FROM documents UNION ALL SELECT doc_id, 2, 'plain', '', '{"additionalProperties":true,"type":"object"}' FROM documents)
SELECT doc_id, position::BIGINT AS position, name, description, parameters FROM d""")
def c10_text_tools(t):
    """Each text as a flat tool's description, inside another's parameters (themselves JSON text), in a tool without a name and in one whose parameters are a list."""
    flat = F.struct(F.col("lang").alias("name"), F.col("text").alias("description"), F.struct(F.lit("object").alias("type"), F.col("n_chars").alias("n")).alias("input_schema"))
    inner = F.to_json(F.struct(F.col("n_chars").alias("b"), F.col("text").alias("a")))
    nested = F.struct(F.lit("function").alias("type"), F.struct(F.col("source").alias("name"), inner.alias("parameters")).alias("function"))
    plain = F.struct(F.struct(F.lit("plain").alias("name"), F.array("text").alias("parameters")).alias("function"))
    raw = F.concat(F.lit("["), F.concat_ws(", ", *[F.to_json(x) for x in (flat, nested, F.struct(F.col("text").alias("description")), plain)]), F.lit(", 5]"))
    return t.documents.select("doc_id", F.posexplode(tools.tool_definitions(raw)).alias("position", "x")).select("doc_id", F.col("position").cast("long").alias("position"), "x.name", "x.description", "x.parameters")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"text":' || to_json(text) || '}' WHEN 1 THEN '{"raw_arguments":' || to_json('«' || text || '»') || '}' ELSE '{"raw_arguments":[' || to_json(text) || ']}' END AS arguments FROM documents""")
def c11_text_arguments(t):
    """Objects, texts that are no JSON, and lists, each of a document's text."""
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct("text"))).when(k == 1, F.concat(F.lit("«"), "text", F.lit("»"))).otherwise(F.to_json(F.array("text")))
    return t.documents.select("doc_id", C.tool_arguments(raw).alias("arguments"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"in":[{"lang":' || to_json(lang) || ',"text":' || to_json(text) || '}]}' AS canonical FROM documents""")
def d3_text_canonical(t):
    inner = F.array(F.struct("text", "lang")).alias("in")
    return t.documents.select("doc_id", H.canonical(F.to_json(F.struct(inner, "doc_id"))).alias("canonical"))


@query("""SELECT doc_id, CASE WHEN contains(lead, '[') THEN NULL ELSE '[' || to_json(text) || ',{"lang":' || to_json(lang) || '}]' END AS array_json, CASE WHEN contains(lead, '[') THEN lead || ' [' || to_json(text) || ',{"lang":' || to_json(lang) || '}] end' ELSE lead || '   end' END AS rest
FROM (SELECT doc_id, text, lang, text[:60] AS lead FROM documents)""")
def d10_text_split(t):
    """A JSON array with the whole text in it, behind the text's begin."""
    array = F.concat(F.lit("["), F.get_json_object(F.to_json(F.struct(F.array("text").alias("x"))), "$.x").substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(","), F.to_json(F.struct("lang")), F.lit("]"))
    raw = F.concat(F.left("text", F.lit(60)), F.lit(" "), array, F.lit(" end"))
    return t.documents.select("doc_id", C.split_array(raw).alias("r")).select("doc_id", "r.array_json", "r.rest")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'answer' WHEN 1 THEN 'answer,patch' ELSE '' END AS keys FROM documents""")
def d23_text_keys(t):
    """The texts under keys that must not be there, and as values that look like them."""
    k = F.col("doc_id") % 3
    look = F.concat(F.lit('"patch": "answer": '), "text")
    one = F.to_json(F.struct(F.struct(look.alias("answer")).alias("text")))
    two = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("patch"), F.struct(look.alias("answer")).alias("x"))).alias("in")))
    raw = F.when(k == 0, one).when(k == 1, two).otherwise(F.to_json(F.struct(look.alias("text"))))
    return t.documents.select("doc_id", F.array_join(F.array_sort(C.forbidden_keys(raw, ("answer", "patch"))), ",").alias("keys"))


@query("""SELECT doc_id, 2 AS n, '{"text":' || to_json(text) || '}' AS first, '{"lang":' || to_json(lang) || ',"of":{"text":' || to_json(text) || '}}' AS second FROM documents""")
def n29_text_objects(t):
    """An object given as JSON text, one given as such, a number and the plain text."""
    as_text = F.to_json(F.struct(F.to_json(F.struct("text")).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.to_json(F.struct("text")).alias("x")))) - 6)
    plain = F.to_json(F.struct(F.concat(F.lit("«"), "text").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.concat(F.lit("«"), "text").alias("x")))) - 6)
    raw = F.concat(F.lit("["), F.concat_ws(",", as_text, F.to_json(F.struct("lang", F.struct("text").alias("of"))), F.col("n_chars").cast("string"), plain), F.lit("]"))
    x = M.json_objects(raw)
    return t.documents.select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("n"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS position, role, text AS content, CASE WHEN turn % 4 = 1 THEN '{"said":' || to_json(text) || '}' END AS arguments FROM conversations WHERE turn % 3 < 2""")
def c9_text_messages(t):
    """The conversations as JSON lists: turns of an unknown role among them, and calls whose arguments hold the text."""
    k = F.col("turn")
    call = F.when(k % 4 == 1, F.array(F.struct(F.lit("c").alias("id"), F.struct(F.lit("f").alias("name"), F.to_json(F.struct(F.col("text").alias("said"))).alias("arguments")).alias("function"))))
    item = F.struct("turn", F.when(k % 3 == 2, "narrator").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"), call.alias("tool_calls"))
    raw = t.conversations.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("raw"))
    rows = raw.select("conv_id", F.posexplode(C.cleaned_messages(F.col("raw"))).alias("position", "m"))
    return rows.select("conv_id", F.col("position").cast("long").alias("position"), "m.role", "m.content", F.get("m.tool_calls", F.lit(0))["arguments"].alias("arguments"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'a call without a name' WHEN 2 THEN 'arguments are no object' END AS violation, CASE WHEN doc_id % 3 = 0 THEN '{"text":' || to_json(text) || '}' END AS arguments FROM documents""")
def c15_text_calls(t):
    """Calls whose arguments are the texts, as objects or as they are."""
    k = F.col("doc_id") % 3
    call = F.struct(F.lit("i").alias("id"), F.when(k == 1, " ").otherwise(F.col("source")).alias("name"), F.when(k == 2, F.to_json(F.array("text"))).otherwise(F.to_json(F.struct("text"))).alias("arguments"))
    c = tools.strict_calls(t.documents.select("doc_id", F.array(call).alias("calls")))
    good = c.good.select("doc_id", F.lit(None).cast("string").alias("violation"), F.get("calls", F.lit(0))["arguments"].alias("arguments"))
    return good.unionByName(c.bad.select("doc_id", "violation", F.lit(None).cast("string").alias("arguments")))


@query("""SELECT conv_id, '[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || CASE WHEN turn % 4 = 1 THEN ',"tool_calls":[{"id":"c","type":"function","function":{"name":"f","arguments":' || to_json('{"said":' || to_json(text) || '}') || '}}]' ELSE '' END || '}', ',' ORDER BY turn) || ']' AS wire,
 '[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(text) || CASE WHEN turn % 4 = 1 THEN ',"tool_calls":[{"id":"c","type":"function","function":{"name":"f","arguments":{"said":' || to_json(text) || '}}}]' ELSE '' END || '}', ',' ORDER BY turn) || ']' AS template FROM conversations GROUP BY conv_id""")
def c15_wire_messages(t):
    """The conversations with calls that hold the text, in the wire's and the template's form."""
    call = F.when(F.col("turn") % 4 == 1, F.array(F.struct(F.lit("c").alias("id"), F.lit("f").alias("name"), F.to_json(F.struct(F.col("text").alias("said"))).alias("arguments"))))
    item = F.struct("turn", "role", F.col("text").alias("content"), call.alias("tool_calls"), F.col("turn").alias("_wire"))
    raw = t.conversations.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("raw"))
    m = raw.select("conv_id", C.cleaned_messages(F.col("raw")).alias("m"))
    return m.select("conv_id", tools.wire_messages(F.col("m")).alias("wire"), tools.template_messages(F.col("m")).alias("template"))
