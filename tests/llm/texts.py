"""Small corpora with the cases that every operator has to define."""

import random

import duckdb

VOCAB = [a + b + c for a in ("ta", "ré", "so", "mi", "lu", "ka") for b in ("n", "r", "st", "l") for c in ("do", "ve", "in", "e")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def near_copy(rng, text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1, n=60):
    """(doc_id, text) with copies, near copies, shared passages, nulls, blanks and repeated rows."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 160)) for _ in range(n)]
    base = prose(rng, 140)
    out += [near_copy(rng, base, rng.random() * 0.16) for _ in range(40)]
    out += [out[0]] * 5
    passage = prose(rng, 50)
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    out += [passage + " " + passage, None, "", " \t\n", "one", "ONE", "two words", "a " * 120, "😀 é " * 60, "x" * 5000, prose(rng, 6000)]
    rows = list(enumerate(out))
    return rows + [rows[3], rows[3], (None, out[5]), (None, None), (None, base)]


def frame(spark, rows, more=False):
    """With columns whose names clash with the operators' own, if more."""
    if not more:
        return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return spark.createDataFrame([(d, t, 7, "s", 1.5, "k") for d, t in rows], "doc_id long, text string, n_words int, spans string, row double, kept string").repartition(3)


def held_to_sql(df, sql, folder, tables):
    """The rows of df are those of the SQL over the folder's Parquet tables."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want.fetchall())
