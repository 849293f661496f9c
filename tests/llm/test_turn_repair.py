import heapq
import itertools
import random

from sparkloom.llm import turn_repair as m

from .texts import held_to_sql


def cheapest(signature):
    """All edit strings by cost, then by their letters, until one closes the conversation."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(signature) and last in ("", "a"):
            return cost, audit
        given = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, given))
        if i < len(signature):
            c = signature[i]
            late, kind = c in "SUAO", c.lower()
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if c != "-":
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, given))
                if last + kind in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, kind))


def test_every_short_signature():
    for n in range(5):
        for t in itertools.product("suaoSUAO-", repeat=n):
            assert m.solve("".join(t)) == cheapest("".join(t))
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("suaoSUAO-") for _ in range(rng.randint(5, 60)))
        assert m.solve(s) == cheapest(s)


def test_a_very_long_conversation_is_solved():
    assert m.solve("ua" * 5000) == (0, "KK" * 5000)
    cost, audit = m.solve("u-" * 3000 + "a")
    assert (cost, audit) == cheapest("u-" * 3000 + "a") and audit.count("D") >= 3000


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"),
    (2, 0, "user", "One."), (2, 1, "user", "Two"), (2, 3, "assistant", "Three  \n"), (2, 5, "assistant", "Three  \n"),
    (3, None, "tool", "x."), (3, 2, None, "y?"), (3, 2, "assistant", None), (3, 2, "user", " \t"), (3, None, "user", "No end"),
    (4, 7, "user", "Same."), (4, 7, "user", "Same."), (4, 7, "user", "Same."), (4, 8, "assistant", "Übel?"),
    (5, 0, "assistant", "First."), (6, None, None, None), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (8, 0, "", "Empty role."),
    (9, 0, "system", "a."), (9, 1, "system", "b."), (9, 2, "ux", "c."), (9, 3, "assistant", "d" * 200000 + "."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, rows):
    return {r.conv: r for r in m.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_repair(spark):
    got = repaired(spark, ROWS)
    assert set(got) == {1, 2, 3, 4, 5, 6, None, 8, 9}
    assert (got[1].audit, got[1].cost, got[1].signature) == ("KKK", 0, "sua")
    assert (got[2].gaps, got[2].blank, got[2].duplicate, got[2].truncated, got[2].illegal, got[2].signature) == (2, 0, 1, 2, 2, "uUA-")
    assert (got[3].gaps, got[3].blank) == (0, 2) and got[4].duplicate == 2
    assert (got[6].gaps, got[6].blank, got[6].audit, got[6].repaired) == (0, 1, "D", [])
    assert got[5].audit == "IK" and got[None].audit == "KK"
    for r in got.values():
        cost, audit = cheapest(r.signature)
        assert (r.cost, r.audit) == (cost, audit)
        last = ""
        for t in r.repaired:
            assert t.role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last]
            last = t.role[:1]
        assert last in ("", "a")
    assert [t.role for t in got[9].repaired][-1][:1] == "a"


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], SCHEMA + ", audit string, place int, fault int")
    assert sorted(map(repr, m.repair(df).collect())) == sorted(map(repr, m.repair(df.select("conv_id", "turn", "role", "text")).collect()))
    assert m.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_matches_its_sql(spark, tmp_path):
    rng = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "cut", "", None, "End. ", "Ä. "]
    more = [(c, rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "user", "tool", None]), rng.choice(texts)) for c in range(100, 190) for _ in range(rng.randint(1, 9))]
    # the copies of one turn lie side by side, whatever the order of equal turns
    more = list({(c, t): (c, t, r, x) for c, t, r, x in more}.values())
    once = [r for r in ROWS if r[0] not in (4,)]
    spark.createDataFrame(once + more, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    held_to_sql(m.op12_turn_repair(spark, str(tmp_path)), m.ORACLE["op12_turn_repair"], tmp_path, ["conversations"])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert m.op12_turn_repair(spark, f"{tmp_path}/none").collect() == []


def test_distinct_signatures_are_solved_once(spark, monkeypatch):
    seen = []
    known = m.solved
    monkeypatch.setattr(m, "solved", lambda df: seen.append(sorted(r[0] for r in df.collect())) or known(df))
    rows = [(c, t, r, f"{c} {t}.") for c in range(200) for t, r in enumerate(["user", "assistant"])]
    assert {r.audit for r in m.repair(spark.createDataFrame(rows, SCHEMA)).collect()} == {"KK"}
    assert seen == [["ua"]]
