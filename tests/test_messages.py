import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.operators import messages as M
from sparkloom.operators import routing as R

CALL = "array<struct<role:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string>>>>"


def paired(spark, turns, **kw):
    rows = [(r, i, c) for r, i, c in turns]
    return spark.createDataFrame([(rows,)], f"m {CALL}").select(M.paired(F.col("m"), **kw).alias("r")).first().r


def test_pairing_accepts_a_closed_conversation(spark):
    r = paired(spark, [("user", None, None), ("assistant", None, [("a", "read"), ("b", "run")]), ("tool", "b", None), ("tool", "a", None), ("assistant", None, None)])
    assert r.valid and r.errors == [] and (r.assistant_turns, r.tool_calls, r.tool_results) == (2, 2, 2)


def test_pairing_lets_an_id_be_used_again(spark):
    r = paired(spark, [("assistant", None, [("a", "x")]), ("tool", "a", None), ("assistant", None, [("a", "x")]), ("tool", "a", None), ("assistant", None, None)])
    assert r.valid


@pytest.mark.parametrize(
    "turns,kw,errors",
    [
        ([("assistant", None, [("a", "x"), ("a", "x")]), ("tool", "a", None), ("assistant", None, None)], {}, ["duplicate_tool_call_id:a"]),
        ([("tool", "z", None), ("assistant", None, None)], {}, ["orphan_tool_result:z"]),
        ([("assistant", None, [("b", "x"), ("a", "x")]), ("assistant", None, None)], {}, ["missing_tool_results:a,b"]),
        ([("assistant", None, None)], {"require_tool": True, "required": ("x",)}, ["required_tool_call_missing", "required_tool_call_missing:x"]),
        ([("user", None, None)], {}, ["trajectory_does_not_end_with_assistant"]),
        ([("assistant", None, [("a", "x")]), ("tool", "a", None), ("assistant", None, [("c", "x")])], {}, ["missing_tool_results:c", "trajectory_ends_with_unresolved_tool_call"]),
        ([], {}, ["trajectory_does_not_end_with_assistant"]),
    ],
)
def test_pairing_errors(spark, turns, kw, errors):
    r = paired(spark, turns, **kw)
    assert not r.valid and r.errors == errors


def chat(spark, *turns):
    return spark.createDataFrame([([(a, b) for a, b in turns],)], "messages array<struct<role:string,content:string>>")


def test_merge(spark):
    df = chat(spark, ("human", " a "), ("user", "b"), ("odd", "x"), ("gpt", "c"), ("tool", "t"), ("tool", "u"), ("assistant", " "), ("assistant", "d"))
    out = df.select(M.merged(F.col("messages")).alias("m")).first().m
    assert [(x.role, x.content) for x in out] == [("user", "a\n\nb"), ("assistant", "c"), ("tool", "t"), ("tool", "u"), ("assistant", "d")]


def test_prefixes(spark):
    df = chat(spark, ("user", "1"), ("assistant", "2"), ("user", "3"), ("assistant", "4"), ("user", "5")).withColumn("k", F.lit(1))
    got = sorted((r.turn_index, len(r.prefix), r.reference) for r in M.last_user_prefixes(df, 2, ["k"]).collect())
    assert got == [(2, 3, "4"), (4, 5, "")]
    assert M.last_user_prefixes(df, 0, ["k"]).collect() == [] and M.last_user_prefixes(df, 9, ["k"]).count() == 3


def test_tools_and_notes(spark):
    df = spark.createDataFrame([([("a", "1"), ("", "0"), ("b", "2"), ("a", "3")],)], "t array<struct<name:string,v:string>>")
    assert [x.v for x in df.select(M.distinct_tools(F.col("t")).alias("t")).first().t] == ["1", "2"]
    noted = chat(spark, ("user", "q"), ("system", "s")).select(M.with_system_note(F.col("messages"), "N").alias("m")).first().m
    assert [(x.role, x.content) for x in noted] == [("user", "q"), ("system", "s\n\nN")]


def test_mask_marks_assistant_text(spark):
    df = chat(spark, ("user", "ab"), ("assistant", "xyz"))
    text, mask = df.select(M.rendered(F.col("messages")), M.assistant_mask(F.col("messages"))).first()
    assert len(text) == len(mask) and "".join(c for c, m in zip(text, mask) if m) == "xyz"
    assert df.select(M.supervised(M.assistant_mask(F.col("messages")))).first()[0] == 3


CASES = [
    (None, "prompt", "P"),
    ("not json", "prompt", "P"),
    ("[1]", "prompt", "P"),
    (json.dumps({"messages": [{"role": "user", "content": "hi"}]}), "context_json.messages", "hi"),
    (json.dumps({"messages": [{"role": "robot", "content": "hi"}]}), "context_json.invalid_messages_fallback_to_prompt", "P"),
    (json.dumps({"unparsed_text": '{"messages": [...[TRUNCATED]...'}), "context_json.truncated_messages_fallback_to_prompt", "P"),
    (json.dumps({"unparsed_text": '{"messages": [{"role": "user", "content": "a\nb"}]}'}), "context_json.unparsed_text.messages", "a\nb"),
    (json.dumps({"path": "a.py", "old_contents": "x = 1"}), "context_json.static_context+prompt", '<file_before_change path="a.py">\nx = 1\n</file_before_change>\n<task>\nP\n</task>'),
    (json.dumps({"task": "fix", "repo": "o/r"}), "context_json.static_context+prompt", "<repository_context>\ntask: fix\nrepo: o/r\n</repository_context>\n<current_request>\nP\n</current_request>"),
    (json.dumps({"prior_user_prompts": [{"prompt": "one"}, {"prompt": " "}], "artifact": {"title": "T"}}), "context_json.incomplete_user_history+prompt", '<incomplete_conversation_context>\nOnly earlier user requests are available; assistant replies are unavailable.\n<artifact>\ntitle: T\n</artifact>\n<prior_user_request index="1">\none\n</prior_user_request>\n</incomplete_conversation_context>\n<current_user_request>\nP\n</current_user_request>'),
    (json.dumps({"review_prefix": [{}, {"reviewer": "r", "body": "b", "thread_replies": [{"author": "a", "body": "c"}]}], "task": "t"}), "context_json.static_context+prompt", "<review_prefix>\n[event 2]\nreviewer: r\nbody: b\nthread_replies:\n[thread reply 1]\nauthor: a\nbody: c\n</review_prefix>\n<context_metadata>\ntask: t\n</context_metadata>\n<current_request>\nP\n</current_request>"),
]


def test_normalized_prompts(spark):
    df = spark.createDataFrame([Row(id=str(i), prompt="P", context_json=c) for i, (c, _, _) in enumerate(CASES)], "id string, prompt string, context_json string")
    got = {int(r.id): r for r in R.normalized(df).collect()}
    for i, (_, source, content) in enumerate(CASES):
        assert (got[i].conversation_source, got[i].messages[0].content) == (source, content)
    bad = spark.createDataFrame([(" ", "x", None), ("1", "  ", None)], df.schema)
    assert sorted(r.violation for r in R.normalized(bad).collect()) == ["empty id", "empty prompt"]


def test_routes(spark):
    rows = [
        ("1", None, " do it ", None, None),
        ("2", None, "p", "agent_trajectory_prefix", json.dumps({"messages": [{"role": "user", "content": "u"}, {"role": "alien", "content": "x"}]})),
        ("3", None, "p", "terminal_trajectory_prefix", "{}"),
        ("4", None, "now", "developer_conversation_user_followup", json.dumps({"prior_user_prompts": [{"prompt": " a "}, {"prompt": ""}, {"prompt": "b"}]})),
        ("5", None, "p", "developer_conversation_with_repo_artifact", json.dumps({"artifact": {"type": "file", "url": "u", "body": "aGVsbG8="}})),
        ("6", None, "p", "pull_request_inline_review", json.dumps({"review_prefix": [{"reviewer": "r", "path": "f", "body": " x "}, {"body": ""}]})),
        ("7", None, "p", "file_before_change", json.dumps({"path": "/a/b.py", "old_contents": "z"})),
        ("8", None, "p", "file_before_change", json.dumps({"path": "a"})),
        ("9", None, "p", "terminal_instruction", json.dumps({"platform": "linux", "shell": "bash"})),
        ("", "s10", "p", "repo_checkout_reference", None),
        (None, None, "p", None, None),
    ]
    df = spark.createDataFrame(rows, "id string, source_id string, prompt string, input_kind string, context_json string")
    got = {r.row_id: r for r in R.routed(df).collect()}
    assert (got["1"].route, got["1"].user, got["1"].kind) == ("single_turn", "do it", "instruction_only")
    assert got["2"].route == "trajectory_prefix" and [m.content for m in got["2"].prefix] == ["u"] and got["2"].workspace_required
    assert got["3"].route == "workspace_task" and got["3"].warning and got["3"].user == "p"
    assert (got["4"].route, got["4"].user, got["4"].remaining_user_turns) == ("conversation_seed", "a", ["b", "now"])
    assert got["5"].user == "Supplied file (u):\n\n```text\nhello\n```\n\nCurrent request:\np"
    assert got["6"].user == "Pull request discussion so far:\n\n[r on f]\nx\n\nCurrent request:\np"
    assert got["7"].workspace_required and got["7"].workspace_seed_files == {"a/b.py": "z"} and "`a/b.py`" in got["7"].user
    assert not got["8"].workspace_required and got["8"].user == "p"
    assert got["9"].user == "Target environment: linux, bash.\n\np"
    assert got["s10"].workspace_required and got[None].violation == "no id"


def test_pairing_of_rows_is_that_of_lists(spark):
    import random

    rng = random.Random(5)
    rows = []
    for conv in range(150):
        for at in range(rng.randint(0, 9)):
            role = rng.choice(["assistant", "assistant", "tool", "tool", "user"])
            calls = [(rng.choice("xyz"), rng.choice(["f", "g"])) for _ in range(rng.choice([0, 1, 1, 2]))] if role == "assistant" else None
            rows.append((conv, at, role, rng.choice(["x", "y", "z", None]) if role == "tool" else None, calls))
    df = spark.createDataFrame(rows, "conv int, at int, role string, tool_call_id string, tool_calls array<struct<id:string,name:string>>")
    item = F.struct("at", "role", "tool_call_id", "tool_calls")
    for more in ({}, {"require_tool": True, "required": ("f", "g")}):
        lists = df.groupBy("conv").agg(F.sort_array(F.collect_list(item)).alias("m")).select("conv", M.paired(F.col("m"), **more).alias("r")).select("conv", "r.*")
        got = M.paired_rows(df, "conv", "at", **more).select(*lists.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, lists.collect())))
