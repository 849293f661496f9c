"""Contexts, routes, tools, answers and media: inputs are made row by row from the shared tables in forms that reach each rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import conditions as C
from ..operators import contracts as K
from ..operators import messages as M
from ..operators import reconcile, routing, tools
from ..operators import metrics as G
from .registry import query


def _pick(key: str, values) -> Column:
    """The value at key modulo their number; {s} is the row's source and {l} its language."""
    chosen = F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))
    return chosen


def _filled(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{s}"), F.col("source")), F.lit("{l}"), F.col("lang"))


def _sql_pick(key: str, values, filled: bool = False) -> str:
    """The same choice in SQL."""
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    out = f"([{', '.join(quote(v) for v in values)}])[1 + {key} % {len(values)}]"
    return f"replace(replace({out}, '{{s}}', source), '{{l}}', lang)" if filled else out


#: (context, what the prompt becomes or the last message, its source, number of tools)
_CONTEXTS = (
    (None, "ask {s}", "prompt", None),
    ("", "ask {s}", "prompt", None),
    ("  ", "ask {s}", "prompt", None),
    ("[1]", "ask {s}", "prompt", None),
    ('{"messages":[{"role":"user","content":"{s}"}],"tools":["{\\"name\\":\\"f\\"}",{"name":"g"}]}', "{s}", "context_json.messages", 2),
    ('{"messages":[{"role":"robot","content":"x"}]}', "ask {s}", "context_json.invalid_messages_fallback_to_prompt", None),
    ('{"messages":[{"role":"user","content":{"a":1}}]}', "ask {s}", "context_json.invalid_messages_fallback_to_prompt", None),
    ('{"unparsed_text":"...[TRUNCATED]... {"}', "ask {s}", "context_json.truncated_messages_fallback_to_prompt", None),
    ('{"prior_user_prompts":[{"prompt":"p1"},{"prompt":" "},{"prompt":"p2"}],"artifact":{"type":"issue","title":"{l}"}}', '<incomplete_conversation_context>\nOnly earlier user requests are available; assistant replies are unavailable.\n<artifact>\ntype: issue\ntitle: {l}\n</artifact>\n<prior_user_request index="1">\np1\n</prior_user_request>\n<prior_user_request index="2">\np2\n</prior_user_request>\n</incomplete_conversation_context>\n<current_user_request>\nask {s}\n</current_user_request>', "context_json.incomplete_user_history+prompt", None),
    ('{"old_contents":"line","path":""}', '<file_before_change path="<unknown>">\nline\n</file_before_change>\n<task>\nask {s}\n</task>', "context_json.static_context+prompt", None),
    ('{"conversation_prefix":[{"type":"comment","author":"a","body":"b","thread_replies":[{"author":"c","body":"d"}]}],"repo":"{s}","diff_context":{"b":1,"a":["é"]}}', '<conversation_prefix>\n[event 1]\ntype: comment\nauthor: a\nbody: b\nthread_replies:\n[thread reply 1]\nauthor: c\nbody: d\n</conversation_prefix>\n<context_metadata>\nrepo: {s}\n</context_metadata>\n<diff_context>\n{\n  "b": 1,\n  "a": [\n    "é"\n  ]\n}\n</diff_context>\n<current_request>\nask {s}\n</current_request>', "context_json.static_context+prompt", None),
    ('{"task":"t","repo":"{s}"}', "<repository_context>\ntask: t\nrepo: {s}\n</repository_context>\n<current_request>\nask {s}\n</current_request>", "context_json.static_context+prompt", None),
    ('{"unparsed_text":"{\\"messages\\":[{\\"role\\":\\"user\\",\\"content\\":\\"a\\tb {l}\\"}],\\"tools\\":[5]}"}'.replace("\t", "\\t"), "a\tb {l}", "context_json.unparsed_text.messages", None),
    ('{"messages":[],"repo":""}', "ask {s}", "prompt", None),
    ('{"messages":[{"role":"tool","content":null},{"role":"user","content":["{l}"]}],"tools":[7]}', '["{l}"]', "context_json.messages", None),
)


@query(f"SELECT doc_id, {_sql_pick('doc_id', [c[1] for c in _CONTEXTS], True)} AS content, {_sql_pick('doc_id', [c[2] for c in _CONTEXTS])} AS conversation_source, {_sql_pick('doc_id', [c[3] for c in _CONTEXTS])} AS n_tools FROM documents")
def c7_normalized_contexts(t):
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("ask "), "source").alias("prompt"), _filled(_pick("doc_id", [c[0] for c in _CONTEXTS])).alias("context_json"))
    n = routing.normalized(d)
    return n.select("doc_id", F.get("messages", F.size("messages") - 1)["content"].alias("content"), "conversation_source", F.size("tools").alias("n_tools"))


@query(f"SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, 0::BIGINT AS n_duplicates, 0::BIGINT AS n_empty_keys, 0::BIGINT AS n_empty_texts, count(*) FILTER (doc_id % {len(_CONTEXTS)} IN (2, 3)) AS n_malformed FROM documents")
def g1_audit_contexts(t):
    d = t.documents.withColumn("context_json", _pick("doc_id", [c[0] for c in _CONTEXTS]))
    return G.audit(d, "doc_id", "text", json="context_json")


#: (input kind, context, route, user text or the prefix's length, workspace needed, warning)
_ROUTES = (
    (None, None, "single_turn", "ask {s}", False, None),
    ("developer_conversation_user_followup", '{"prior_user_prompts":[{"prompt":" first "},{"prompt":"second"}]}', "conversation_seed", "first", False, None),
    ("developer_conversation_with_repo_artifact", '{"artifact":{"type":"issue","url":"http://u","body":"aGVsbG8gd29ybGQ="}}', "single_turn", "Supplied issue (http://u):\n\n```text\nhello world\n```\n\nCurrent request:\nask {s}", False, None),
    ("pull_request_discussion", '{"conversation_prefix":[{"reviewer":"r","path":"p.py","body":" x "},{"body":""}]}', "single_turn", "Pull request discussion so far:\n\n[r on p.py]\nx\n\nCurrent request:\nask {s}", False, None),
    ("file_before_change", '{"old_contents":"c","path":"/a/b.py"}', "workspace_task", "ask {s}\n\nThe checkout initially contains `a/b.py`. Inspect it with tools before editing.", True, None),
    ("file_before_change", "{}", "workspace_task", "ask {s}", False, None),
    ("terminal_instruction", '{"platform":"linux","shell":"bash"}', "single_turn", "Target environment: linux, bash.\n\nask {s}", False, None),
    ("agent_trajectory_prefix", '{"messages":[{"role":" user ","content":"{l}"},{"role":"robot","content":"x"}]}', "trajectory_prefix", None, True, None),
    ("agent_trajectory_prefix", "broken", "workspace_task", "ask {s}", True, "structured trajectory prefix could not be decoded; using prompt only"),
)


@query(f"SELECT doc_id, {_sql_pick('doc_id', [r[2] for r in _ROUTES])} AS route, {_sql_pick('doc_id', [r[3] for r in _ROUTES], True)} AS \"user\", {_sql_pick('doc_id', [r[4] for r in _ROUTES])} AS workspace_required, {_sql_pick('doc_id', [r[5] for r in _ROUTES])} AS warning, doc_id % {len(_ROUTES)} = 7 AS has_prefix, CASE WHEN doc_id % {len(_ROUTES)} = 1 THEN 2 ELSE 0 END AS turns_left FROM documents")
def c5_routes(t):
    d = t.documents.select("doc_id", "source", "lang", F.lit("").alias("id"), F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit(" ask "), "source", F.lit("\n")).alias("prompt"), _pick("doc_id", [r[0] for r in _ROUTES]).alias("input_kind"), _filled(_pick("doc_id", [r[1] for r in _ROUTES])).alias("context_json"))
    r = routing.routed(d)
    return r.select("doc_id", "route", "user", "workspace_required", "warning", (F.coalesce(F.size("prefix"), F.lit(0)) == 1).alias("has_prefix"), F.size("remaining_user_turns").alias("turns_left"))


@query("SELECT doc_id, 'lang=' || lang || ',source=' || source AS provenance FROM documents")
def c14_provenance(t):
    p = routing.provenance(t.documents.withColumn("license", F.lit("")).withColumn("category", F.lit(None).cast("string")), ("category", "source", "lang", "license"))
    kv = F.array_sort(F.transform(F.map_entries(p), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return t.documents.withColumn("license", F.lit("")).withColumn("category", F.lit(None).cast("string")).select("doc_id", F.array_join(kv, ",").alias("provenance"))


_TOOLS = (
    ('[{"name":"a","description":"d","input_schema":{"type":"object","x":1}}]', 'a|d|{"type":"object","x":1}'),
    ('[{"type":"function","function":{"name":"b","parameters":"{\\"y\\": 2}"}}, {"description":"no name"}]', 'b||{"y":2}'),
    ('["{\\"name\\": \\"c\\"}", 5, {"function":{"name":"e","parameters":[1]}}]', 'c||{"type":"object"};e||{"additionalProperties":true,"type":"object"}'),
    ("not json", ""),
    (None, ""),
)


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _TOOLS])} AS tools FROM documents")
def c10_tool_definitions(t):
    d = t.documents.select("doc_id", tools.tool_definitions(_pick("doc_id", [x[0] for x in _TOOLS])).alias("x"))
    return d.select("doc_id", F.array_join(F.transform("x", lambda f: F.concat_ws("|", f["name"], f["description"], f["parameters"])), ";").alias("tools"))


_ARGUMENTS = ((None, "{}"), ("null", "{}"), ('{"a": 1}', '{"a": 1}'), ("[1, 2]", '{"raw_arguments":[1, 2]}'), ('say "x"', '{"raw_arguments":"say \\"x\\""}'), ("7", '{"raw_arguments":7}'))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _ARGUMENTS])} AS arguments FROM documents")
def c11_tool_arguments(t):
    return t.documents.select("doc_id", C.tool_arguments(_pick("doc_id", [x[0] for x in _ARGUMENTS])).alias("arguments"))


@query("""SELECT doc_id, 'call_' || left(sha256(doc_id || ':3:0'), 24) || ',given' AS ids, CASE doc_id % 3 WHEN 1 THEN 'a call without a name' WHEN 2 THEN 'arguments are no object' END AS violation FROM documents""")
def c15_strict_calls(t):
    k = F.col("doc_id") % 3
    first = F.struct(F.lit("").alias("id"), F.when(k == 1, " ").otherwise("f").alias("name"), F.when(k == 2, "[1]").otherwise('{"a":1}').alias("arguments"))
    d = t.documents.select("doc_id", tools.call_ids(F.array(first, F.struct(F.lit("given").alias("id"), F.lit("g").alias("name"), F.lit("{}").alias("arguments"))), F.col("doc_id"), F.lit(3)).alias("calls"))
    c = tools.strict_calls(d)
    return c.good.withColumn("violation", F.lit(None).cast("string")).unionByName(c.bad).select("doc_id", F.array_join(F.transform("calls", lambda x: x["id"]), ",").alias("ids"), "violation")


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang || '_x' END AS executor, CASE WHEN lang NOT IN ('en', 'de') THEN 'no executor' END AS violation FROM documents""")
def e8_dispatch(t):
    routes = t._spark.createDataFrame([("en", "en_x"), ("de", "de_x"), ("zz", "never")], "name string, executor string")
    c = tools.dispatch(t.documents.select("doc_id", F.col("lang").alias("name")), routes)
    return c.good.withColumn("violation", F.lit(None).cast("string")).unionByName(c.bad).select("doc_id", "executor", "violation")


@query("SELECT c_custkey, CASE WHEN n_name IS NULL THEN '' ELSE 'S' || c_nationkey END || '|S0' AS schemas FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def e7_schemas(t):
    catalogue = t.nation.select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit("S"), "n_nationkey").alias("schema"))
    d = t.customer.select("c_custkey", F.array(F.col("c_nationkey").cast("string"), F.lit("unknown"), F.lit("0")).alias("names"))
    return tools.schemas_for(d, catalogue).select("c_custkey", F.array_join(F.transform("tools", lambda x: x["schema"]), "|").alias("schemas"))


_ANSWERS = (("  The ﬁrst, ANSWER! ", "the first answer"), ("STRASSE—straße", "strasse strasse"), ("a -b", "a b"), ("", ""))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _ANSWERS])} AS answer FROM documents")
def d2_normalized_answer(t):
    return t.documents.select("doc_id", T.normalize_answer(_pick("doc_id", [x[0] for x in _ANSWERS])).alias("answer"))


_ARRAYS = (('say [1, {"a": "]"}] now', '[1,{"a":"]"}]', "say   now"), ("no array", None, "no array"), ("bad [1, then", None, "bad [1, then"), ("[]", "[]", " "))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _ARRAYS])} AS array_json, {_sql_pick('doc_id', [x[2] for x in _ARRAYS])} AS rest FROM documents")
def d10_split_array(t):
    r = C.split_array(_pick("doc_id", [x[0] for x in _ARRAYS]))
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", "r.array_json", "r.rest")


@query("SELECT doc_id, source || '.py,' || lang || '/b.c,new.txt' AS paths FROM documents")
def d18_patch_paths(t):
    patch = F.concat(F.lit("--- a/"), "source", F.lit(".py\n+++ b/"), "source", F.lit(".py\n@@ -1 +1 @@\n-x\n+y\n--- "), "lang", F.lit("/b.c\t2024\n+++ /dev/null\n--- /dev/null\n+++ b/new.txt\n"))
    return t.documents.select("doc_id", F.array_join(T.patch_paths(patch), ",").alias("paths"))


_KEYED = (('{"a": {"answer": 1, "b": [{"patch ": 2, "patch": 3}]}}', "answer,patch"), ('{"text": "\\"answer\\": 1", "x": "patch"}', ""), ('{"answer" : "y:{}"}', "answer"), ("answer", ""), (None, ""))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _KEYED])} AS keys FROM documents")
def d23_forbidden_keys(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(C.forbidden_keys(_pick("doc_id", [x[0] for x in _KEYED]), ("answer", "patch"))), ",").alias("keys"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 3 THEN 'query' WHEN 4 THEN 'locale' ELSE NULL END AS reason, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'url' WHEN 2 THEN 'timeout' ELSE 'max_length' END AS page FROM nation")
def c23_requests(t):
    k = F.col("n_nationkey")
    said = C.search_request(F.when(k % 5 == 3, F.repeat(F.lit("x"), F.lit(501))).otherwise(F.col("n_name")), F.lit(3), F.when(k % 5 == 4, "eng").otherwise("en"))
    page = C.browser_request(F.when(k % 4 == 1, "u:p@h").otherwise("example.org"), F.when(k % 4 == 2, 0.5).otherwise(5.0), F.when(k % 4 == 3, 40000))
    return t.nation.select("n_nationkey", F.when(said == "long query", "query").otherwise(said).alias("reason"), page.alias("page"))


@query("""SELECT n_nationkey, '1:http://h/' || n_nationkey || ',3:https://h' AS hits FROM nation""")
def c22_search_results(t):
    item = lambda link: F.struct(F.col("n_name").alias("title"), link.alias("link"), F.lit("s").alias("snippet"), F.lit("o").alias("source"))
    items = F.array(item(F.concat(F.lit("http://h/"), "n_nationkey")), item(F.lit("ftp://h")), item(F.lit("https://h")), item(F.lit("https://late")))
    r = C.search_results(items, 2)
    return t.nation.select("n_nationkey", F.array_join(F.transform(r, lambda x: F.concat_ws(":", x["rank"], x["link"])), ",").alias("hits"))


@query("SELECT conv_id, min_by(role, turn) AS first, count(*) FILTER (role = 'user') - 1 AS plain_users, max(turn) FILTER (role = 'user') AS at, 'image,text' AS types FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0")
def c19_media_in_messages(t):
    c = M.collected(t.conversations, "conv_id", "turn", "role", "text")
    with_ = C.with_media(F.col("messages"), F.array(F.struct(F.lit("IMAGE").alias("type"), F.lit("/p.png").alias("path"))))
    c = c.where(F.exists("messages", lambda m: m["role"] == "user")).withColumn("m", with_)
    at = F.array_max(F.transform("m", lambda x, i: F.when(F.size(x["parts"]) > 1, i).otherwise(-1)))
    plain = F.size(F.filter("m", lambda x: (x["role"] == "user") & (F.size(x["parts"]) == 1))).cast("long")
    return c.select("conv_id", F.get("m", F.lit(0))["role"].alias("first"), plain.alias("plain_users"), at.cast("long").alias("at"), F.array_join(F.transform(F.get("m", at)["parts"], lambda p: p["type"]), ",").alias("types"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/base/' || source || '.png' ELSE 'http://h/' || source END AS path, 'image,audio' AS modalities FROM documents")
def n17_native_media(t):
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("./"), "source", F.lit(".png"))).otherwise(F.concat(F.lit("http://h/"), "source"))
    part = lambda k, v: F.struct(F.lit(k).alias("type"), v.alias("value"))
    m = F.array(F.struct(F.lit("user").alias("role"), F.array(part("Image", value), part("text", F.lit("x"))).alias("parts")), F.struct(F.lit("user").alias("role"), F.array(part("audio", F.lit("/a.wav"))).alias("parts")))
    r = t.documents.select("doc_id", C.native_media(m, "/base/").alias("r"))
    return r.select("doc_id", F.get(F.get("r.messages", F.lit(0))["parts"], F.lit(0))["value"].alias("path"), F.array_join("r.modalities", ",").alias("modalities"))


@query("""SELECT doc_id, 'image' AS type, CASE WHEN lang = 'es' THEN NULL ELSE strlen(text) END AS size, CASE WHEN lang = 'es' THEN NULL ELSE sha256(text) END AS sha256, CASE WHEN lang = 'es' THEN 'missing' END AS violation FROM documents
UNION ALL SELECT doc_id, 'audio', CASE WHEN doc_id % 2 = 0 THEN 7 END, CASE WHEN doc_id % 2 = 0 THEN sha256('data:,x') END, CASE WHEN doc_id % 2 = 1 THEN 'remote' END FROM documents""")
def n13_media_inventory(t):
    files = t.documents.where("lang <> 'es'").select(F.concat(F.lit("/m/"), "doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    listed = F.to_json(F.array(F.struct(F.lit("image").alias("type"), F.concat(F.lit("file:///m/"), "doc_id").alias("path"))))
    said = F.when(F.col("doc_id") % 2 == 0, "data:,x").otherwise("https://h/x")
    inline = F.to_json(F.array(F.struct(F.array(F.struct(F.lit("audio").alias("type"), said.alias("audio"))).alias("content"))))
    d = t.documents.select("doc_id", listed.alias("media_json"), inline.alias("messages_json"))
    return C.media_inventory(d, files, "doc_id")


@query("SELECT * FROM (VALUES ('audio_encoder', true, true), ('vision_encoder', true, true), ('thinker', true, true), ('talker', false, false), ('mtp', false, false), ('code2wav', false, false)) v(component, loaded, executed)")
def n19_components(t):
    kinds = t.events.select(F.when(F.col("event_type") == "click", "audio").when(F.col("event_type") == "view", "image").otherwise("text").alias("kind"))
    return C.components(kinds, "kind")


@query("SELECT conv_id, CASE WHEN max_by(role, turn) = 'assistant' THEN count(*) - 1 END AS messages FROM conversations GROUP BY conv_id")
def n21_prompt_only(t):
    c = M.collected(t.conversations, "conv_id", "turn", "role", "text")
    return c.select("conv_id", F.size(C.prompt_only(F.col("messages"))).cast("long").alias("messages"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN 'eos' ELSE 'length' END AS finish_reason, CASE doc_id % 4 WHEN 3 THEN 'empty prompt' WHEN 2 THEN 'empty completion' END AS violation,
  CASE doc_id % 4 WHEN 3 THEN 'empty' ELSE CASE WHEN doc_id % 8 = 5 THEN 'too long' END END AS sequence_violation FROM documents""")
def n15_completions(t):
    k = F.col("doc_id") % 4
    ids = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<int>")
    p = F.when(k == 3, ids()).when(F.col("doc_id") % 8 == 5, ids(*range(9))).otherwise(ids(1, 2))
    r = F.when(k.isin(0, 3), ids(5, 2)).otherwise(ids(5, 6))
    d = t.documents.select("doc_id", p.alias("p"), r.alias("r"), F.when(k == 2, " ").otherwise("x").alias("text"))
    done = d.select("doc_id", *C.completion(F.col("p"), F.col("r"), F.col("text"), F.lit("length"), 2)[:1], *C.completion(F.col("p"), F.col("r"), F.col("text"), F.lit("length"), 2)[3:], C.sequences(F.col("p"), F.col("r"), 8)[2].alias("sequence_violation"))
    return done


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 16 WHEN 1 THEN 8 WHEN 2 THEN 8 ELSE 16 END AS block_size, 3 AS epochs, CASE event_id % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 4.0 WHEN 2 THEN 4.0 ELSE 2.0 END::DOUBLE AS gamma, CASE WHEN event_id % 4 = 3 THEN 'block size must be 8' END AS violation FROM events""")
def n28_recipe(t):
    k = F.col("event_id") % 4
    r = K.recipe(F.when(k.isin(1, 3), "short").otherwise("other"), F.when(k == 2, 8).when(k == 3, 16), F.lit(None).cast("int"), F.lit(None).cast("double"), F.when(k == 3, 2.0), "short")
    return t.events.select("event_id", r.alias("r")).select("event_id", "r.block_size", "r.epochs", "r.gamma", "r.violation")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN n_chars::BIGINT END AS n, CASE WHEN doc_id % 10 = 7 THEN 'ValueError: bad ' || doc_id END AS error FROM documents""")
def k6_isolated(t):
    def work(part):
        if len(bad := part[part.doc_id % 10 == 7]):
            raise ValueError(f"bad {bad.doc_id.iloc[0]}")
        return part.assign(n=part.n_chars)

    out = K.isolated(t.documents.select("doc_id", "n_chars"), work, "doc_id long, n double", batch_rows=16)
    return out.select("doc_id", F.col("n").cast("long"), "error")


@query("SELECT doc_id, 'a,b' AS differing FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '' FROM documents WHERE doc_id % 2 = 1")
def c25_drift(t):
    left = F.create_map(F.lit("a"), "source", F.lit("c"), "lang")
    right = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("a"), F.concat("source", F.lit("x")), F.lit("b"), F.lit("y"), F.lit("c"), "lang")).otherwise(left)
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.map_keys(reconcile.drift(left, right))), ",").alias("differing"))


_MESSAGES = (
    ('[{"role":" user ","content":"a","think":"x"},{"role":"robot"},5,"{\\"role\\":\\"tool\\",\\"tool_call_id\\":\\"t1\\"}"]', "user=a;tool@t1"),
    ('[{"role":"assistant","content":null,"tool_calls":[{"id":"t1","function":{"name":"f","arguments":"{\\"x\\": 1}"}},{"name":"g","arguments":"loose"},7]}]', 'assistant:f{"x": 1}:g{"raw_arguments":"loose"}'),
    ("[]", ""),
    ("{}", ""),
    (None, ""),
)


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _MESSAGES])} AS messages FROM documents")
def c9_cleaned_messages(t):
    m = t.documents.select("doc_id", C.cleaned_messages(_pick("doc_id", [x[0] for x in _MESSAGES])).alias("m"))
    one = lambda x: F.concat(x["role"], F.coalesce(F.concat(F.lit("="), x["content"]), F.lit("")), F.coalesce(F.concat(F.lit("@"), x["tool_call_id"]), F.lit("")), F.array_join(F.transform(x["tool_calls"], lambda c: F.concat(F.lit(":"), c["name"], c["arguments"])), ""))
    return m.select("doc_id", F.array_join(F.transform("m", one), ";").alias("messages"))


_JSON = (('{"b": 1.0, "a": [true, null, "é"]}', '{"a":[true,null,"é"],"b":1.0}'), ('"\\u00e9 "', '"é "'), ("{bad", None), ("[1, 2.50]", "[1,2.5]"), ('{"z": {"y": 1, "x": 2}}', '{"z":{"x":2,"y":1}}'))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _JSON])} AS json FROM documents")
def d3_canonical_json(t):
    return t.documents.select("doc_id", H.canonical(_pick("doc_id", [x[0] for x in _JSON])).alias("json"))


@query()
def d6_condition_seed(t):
    return t.documents.select("doc_id", H.condition_seed("creative", 7, F.col("doc_id"), "generation-v1").alias("seed"))


_RAW = (('["{\\"a\\":1}", {"b":2}, 5, "x"]', 2), ("[]", 0), ("no", 0), (None, 0))


@query(f"SELECT doc_id, {_sql_pick('doc_id', [x[1] for x in _RAW])} AS n FROM documents")
def n29_json_objects(t):
    return t.documents.select("doc_id", F.size(M.json_objects(_pick("doc_id", [x[0] for x in _RAW]))).alias("n"))


@query("""SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'length' WHEN 1 THEN 'max_rounds_with_pending_user_turns' WHEN 2 THEN 'max_rounds' ELSE 'final_answer' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations)""")
def h18_terminal_reason(t):
    k = F.col("conv_id") % 4
    one = F.struct(F.when(k == 0, "length").otherwise("stop").alias("finish_reason"), F.when(k == 2, 1).otherwise(0).alias("n_calls"))
    return t.conversations.select("conv_id").distinct().select("conv_id", M.terminal_reason(F.array(one, one), 2, F.when(k == 1, 3).otherwise(0)).alias("reason"))


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS supervised FROM conversations GROUP BY conv_id")
def g28_supervised(t):
    c = M.collected(t.conversations, "conv_id", "turn", "role", "text").withColumn("mask", M.assistant_mask(F.col("messages")))
    return c.select("conv_id", M.supervised(F.col("mask")).alias("supervised"))
