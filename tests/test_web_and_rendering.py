import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import conditions, rendering, web
from sparkloom.operators.rendering import Template

public_tokenizers = pytest.importorskip("public_tokenizers")


def of(spark, f, raws):
    return [r.x for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").repartition(1).sortWithinPartitions("i").select(f(F.col("raw")).alias("x")).collect()]


def test_search_arguments(spark):
    good = [({"query": " a b "}, {"query": "a b"}), ({"query": "x", "top_k": 3, "timeout": 5, "gl": "DE", "hl": None}, {"gl": "de", "query": "x", "timeout": 5.0, "top_k": 3}), ({"query": "ü", "timeout": 1.5}, {"query": "ü", "timeout": 1.5})]
    got = of(spark, web.search_arguments, [json.dumps(a) for a, _ in good])
    assert [(json.loads(r.arguments), r.violation) for r in got] == [(b, None) for _, b in good]
    assert got[1].arguments == json.dumps(good[1][1], sort_keys=True, separators=(",", ":"))
    bad = [("[]", "no object"), ("x", "no object"), (None, "no object"), ({"q": 1, "a": 2, "query": "x"}, "unknown arguments: a, q"), ({}, "query"), ({"query": 5}, "query"), ({"query": " "}, "query"), ({"query": "x" * 501}, "long query"), ({"query": "x", "top_k": True}, "top_k"), ({"query": "x", "top_k": "3"}, "top_k"), ({"query": "x", "top_k": 3.5}, "top_k"), ({"query": "x", "top_k": 11}, "top_k"), ({"query": "x", "timeout": "5"}, "timeout"), ({"query": "x", "timeout": 61}, "timeout"), ({"query": "x", "timeout": False}, "timeout"), ({"query": "x", "gl": "deu"}, "gl"), ({"query": "x", "hl": 5}, "hl")]
    assert [r.violation for r in of(spark, web.search_arguments, [a if isinstance(a, str) or a is None else json.dumps(a) for a, _ in bad])] == [v for _, v in bad]


def test_page_arguments(spark):
    rows = [({"url": " a.b/c?d "}, '{"url":"https://a.b/c?d"}', None), ({"url": "http://a", "timeout": 2, "max_length": 9}, '{"max_length":9,"timeout":2.0,"url":"http://a"}', None), ({"url": "http://u@a"}, None, "url"), ({"url": "http://a#f"}, None, "url"), ({"url": "a", "max_length": 0}, None, "max_length"), ({"url": "a", "timeout": 0.5}, None, "timeout"), ({"url": "a", "wait": 1}, None, "unknown arguments: wait")]
    assert [(r.arguments, r.violation) for r in of(spark, web.page_arguments, [json.dumps(a) for a, _, _ in rows])] == [(b, v) for _, b, v in rows]


def test_listings(spark):
    a = {"organic": [{"position": 7, "title": "t" * 600, "link": "http://a", "snippet": "s", "displayedLink": "d"}, 5, {"title": "x", "link": "ftp://no"}, {"link": "https://b", "source": "src", "position": 0}]}
    got = of(spark, lambda c: web.listing(c, 5), [json.dumps(a), json.dumps({"organic": [], "news": [{"link": "http://n"}]}), "{}", "no json", None])
    assert [(r.rank, len(r.title), r.link, r.snippet, r.source) for r in got[0]] == [(7, 500, "http://a", "s", "d"), (4, 0, "https://b", "", "src")]
    assert [(r.rank, r.link, r.type) for r in got[1]] == [(1, "http://n", "organic")] and got[2:] == [[], [], []]
    b = {"results": [{"title": "t", "url": "http://a", "content": "c", "engine": "e"}, {"url": "http://b", "engines": ["x", "y"]}, {"url": "http://c"}]}
    got = of(spark, lambda c: web.listing(c, 2, engines=True), [json.dumps(b)])
    assert [(r.rank, r.title, r.link, r.snippet, r.source) for r in got[0]] == [(1, "t", "http://a", "c", "e"), (2, "", "http://b", "", "x,y")]


def test_tool_result(spark):
    df = spark.createDataFrame([("c {}", "a\n \r\nb\x0cc", None, None, None, True)], "c string, o string, e string, x int, t boolean, u boolean")
    r = df.select(web.tool_result(*[F.col(c) for c in "coextu"]).alias("r")).first().r
    assert r.asDict() == {"command": "c {}", "stdout": "a\n \r\nb\x0cc", "stderr": "", "exit_code": 0, "timed_out": False, "truncated": True, "information_lines": ["a", "b", "c"]}


def test_paths_are_resolved(spark):
    paths = {"./a": "/base/a", "a/../b": "/base/b", "../x/./y": "/x/y", "/abs/../kept": "/abs/../kept", "http://h/../x": "http://h/../x", "a//b/": "/base/a/b", "../../..": "/", ".": "/base"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in df.select("p", conditions.resolved(F.col("p"), "/base").alias("q")).collect()} == paths


def brute(tokenizer, template, messages, start):
    """Whole renderings of every prefix."""
    enc = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    text = lambda ms: template.begin + "".join(template.turn(r, c) for r, c in ms)
    full = enc(text(messages))
    mask = [0] * len(full)
    for k, (r, _) in enumerate(messages):
        if k >= start and r == "assistant":
            a, b = enc(text(messages[:k]) + template.prompt()), enc(text(messages[: k + 1]))
            if full[: len(a)] != a or full[: len(b)] != b or len(b) <= len(a):
                return full, None
            mask[len(a) : len(b)] = [1] * (len(b) - len(a))
    if mask:
        mask[-1] = 0
    return full, mask if any(mask) else None


@pytest.mark.parametrize("template", [Template("<{role}>\n", "<|endoftext|>", "Begin. "), Template("\n{role}: ", "\n"), Template("{role} ", "")])
def test_masks_equal_whole_renderings(spark, template):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(4)
    words = ["the", "Übel", "x" * 9, "a\nb", " ", "12", "<|endoftext|>", "don't", ""]
    talks = [[(rng.choice(["system", "user", "assistant"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 7))] for _ in range(120)]
    rows = [(i, [{"role": r, "content": c} for r, c in t], i % 3) for i, t in enumerate(talks)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role:string,content:string>>, start int").repartition(3)
    tokenizer = Tokenizer.from_file(path)
    seen = set()
    for r in rendering.token_masks(df, template, path, start="start").collect():
        ids, mask = brute(tokenizer, template, talks[r.i], r.start)
        assert r.input_ids == ids and (mask is None) == (r.violation is not None)
        if mask is not None:
            assert r.loss_mask == mask
        seen.add(r.violation is None)
    assert True in seen
    assert all(r.violation for r in rendering.token_masks(df.where("size(messages) > 2"), template, path, most=1).collect())
