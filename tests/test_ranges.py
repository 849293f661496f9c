import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.plans import ranged, registry
from sparkloom.sources import files, ranges
from sparkloom.violations import ContractError

STREAMS = {"input_ids": "<i8", "loss_mask": "u1", "aux": "<f2"}


def samples(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.randint(0, 40)
        rows.append((rng.choice(["a", "b b", "c"]), f"s{i}", i, [rng.randint(-(2**40), 2**40) for _ in range(k)], [rng.randint(0, 1) for _ in range(k)], [float(rng.randint(-8, 8)) / 4 for _ in range(2 * k)]))
    rows.append(("c", "none", n, None, [], None))
    return rows, spark.createDataFrame(rows, "shard string, sample_id string, source_index long, input_ids array<long>, loss_mask array<long>, aux array<double>").repartition(5)


def test_packed_store_round_trip(spark, tmp_path):
    rows, df = samples(spark)
    root = f"file://{tmp_path}/store"
    index = ranges.write_packed(df, root, STREAMS, cap=1500)
    assert index.count() == len(rows) and index.agg(F.max("segment")).first()[0] > 3
    got = {r.sample_id: r for r in ranges.read_packed(index, root, STREAMS).collect()}
    for shard, key, i, ids, mask, aux in rows:
        r = got[key]
        assert (r.shard, r.source_index, r.input_ids, r.loss_mask, r.aux, r.violation) == (shard, i, ids or [], mask or [], aux or [], None)
    # a second run of the writer's tasks leaves one whole file for each stream
    assert not list(tmp_path.glob("store/shard=*/segment-*/_*"))
    one = next(p for p in tmp_path.glob("store/shard=*/segment-00000/aux.bin") if p.stat().st_size)
    raw = bytearray(one.read_bytes())
    raw[0] ^= 1
    one.write_bytes(raw)
    bad = [r for r in ranges.read_packed(index, root, STREAMS).collect() if r.violation]
    assert len(bad) == 1 and bad[0].violation == "aux: checksum" and bad[0].aux is None and bad[0].input_ids
    one.write_bytes(raw[:-1])
    assert {r.violation for r in ranges.read_packed(index, root, STREAMS, verify=False).collect()} == {None, "aux: short"}
    one.unlink()
    assert {r.violation for r in ranges.read_packed(index, root, STREAMS, verify=False).collect()} == {None, "aux: missing"}


def test_offsets_beyond_four_gigabytes(spark, tmp_path):
    """A sparse file: ranges behind 2**32 are read where they lie, from several tasks."""
    at = [0, 2**31 - 3, 2**32 + 7, 5 * 2**30]
    with open(tmp_path / "big.bin", "wb") as f:
        for a in at:
            f.seek(a)
            f.write(f"here {a}".encode())
    df = spark.createDataFrame([(f"file://{tmp_path}/big.bin", a, len(f"here {a}"), hashlib.sha256(f"here {a}".encode()).hexdigest(), "kept") for a in at], "p string, o long, n long, h string, violations string")
    out = ranges.read_ranges(df, {"raw": (F.col("p"), F.col("o"), F.col("n"), F.col("h"), None)}, ["o"])
    assert {r.o: bytes(r.raw).decode() for r in out.collect()} == {a: f"here {a}" for a in at}
    assert ranges.file_hashes(ranges.files_below(spark, str(tmp_path)).limit(0)).collect() == []


def test_files_are_opened_once_in_order(monkeypatch, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}").write_bytes(b"x" * 10)
    f = ranges._Files()
    for i in range(40):
        assert f.get(f"{tmp_path}/{i}")[1] == 10
    assert len(f._open) == ranges.OPEN and f.get(f"{tmp_path}/absent") == (None, 0)
    f.close()
    assert not f._open


def test_chunk_hashes(spark, tmp_path):
    data = {"a": b"", "b": b"x" * 10, "c d": bytes(range(256)) * 9}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    # Spark lists no empty files; a caller may name them
    listed = ranges.files_below(spark, str(tmp_path)).unionByName(spark.createDataFrame([(f"{tmp_path}/a", 0)], "path string, bytes long"))
    got = {r.path.rpartition("/")[2]: r.digest for r in ranges.file_hashes(listed, 1000).collect()}
    for k, v in data.items():
        chunks = [v[i : i + 1000] for i in range(0, len(v), 1000)] or [b""]
        assert got[k] == hashlib.sha256("".join(hashlib.sha256(c).hexdigest() for c in chunks).encode()).hexdigest()
    plain = {r.path.rpartition("/")[2]: r.sha256 for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert plain == {k: hashlib.sha256(v).hexdigest() for k, v in data.items() if v}


def test_footers_and_fingerprints(spark, tmp_path):
    for name, table, group in (("a", pa.table({"x": [1, 2, 3], "y": pa.array([None] * 3, pa.string())}), 2), ("b", pa.table({"x": [4]}), 1)):
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=group)
    root = str(tmp_path)
    got = {r.path.rpartition("/")[2]: (r.columns, r.rows, r.row_groups) for r in ranges.footers(spark, root).collect()}
    assert got == {"a.parquet": (["x", "y"], 3, 2), "b.parquet": (["x"], 1, 1)}
    # a column of nulls is there, one that the file lacks is not
    assert [(r.path[-9:], r.missing) for r in ranges.missing_columns(spark, root, ["y", "x"]).collect()] == [("b.parquet", ["y"])]
    with pytest.raises(ContractError, match="b.parquet lacks y"):
        ranges.require_file_columns(spark, root, ["x", "y"])
    ranges.require_file_columns(spark, root, ["x"])
    one = ranges.content_fingerprint(spark, root, chunk=100).first()
    assert (one.files, one.rows, one.row_groups) == (2, 4, 3) and one == ranges.content_fingerprint(spark, root, chunk=100).first()
    (tmp_path / "moved").mkdir()
    for p in list(tmp_path.glob("*.parquet")):
        (tmp_path / "moved" / p.name).write_bytes(p.read_bytes())
    assert ranges.content_fingerprint(spark, f"{root}/moved", chunk=100).first() == one
    pq.write_table(pa.table({"x": [5]}), tmp_path / "moved" / "b.parquet")
    assert ranges.content_fingerprint(spark, f"{root}/moved", chunk=100).first().fingerprint != one.fingerprint


def test_no_task_gets_a_whole_language(spark, tmp_path):
    """Each task writes what it has of a language; files count by language, whatever its name."""
    langs = ["en", "en", "de", None, "", "a/b+c %2B=d", "en", "de"]
    rows = [(i, f"text {i}", langs[i % len(langs)], "s", 6) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    root = ranged._by_language(registry.Tables(spark, str(tmp_path)))
    assert ranges.files_below(spark, root, "*.parquet").where(F.contains("path", F.lit("en/"))).count() > 1
    for name in ("a6_footers", "g10_content_fingerprint"):
        got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        want = duckdb.sql(registry.SQL[name].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a", "b"):
        lines = [rng.choice(['{"i": %d}' % i, "", "[1]", "x" * rng.randint(0, 300), '{"i": 1, "t": "é"}']) for i in range(4000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * (name == "a"))
        want |= {(name, i): v for i, v in enumerate(lines, 1)}
    size, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        df = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = {(r.path.rpartition("/")[2][:1], r.line_no): r.value for r in df.collect()}
        assert got == {k: v for k, v in want.items() if k[0] == "a" or k[1] < 4000 or v}
        c = files.parsed_lines(spark, str(tmp_path), "i long")
        bad = {(r.path.rpartition("/")[2][:1], r.line_no) for r in c.bad.collect()}
        assert bad == {k for k, v in want.items() if v and not v.startswith("{")}
        assert {(r.path.rpartition("/")[2][:1], r.line_no) for r in c.good.collect()} == {k for k, v in want.items() if v.startswith("{")}
        first = min(k for k in bad if k[0] == "a")
        with pytest.raises(ContractError, match=f"^line {first[1]} is no JSON object"):
            files.json_lines(spark, str(tmp_path), "i long")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_folders_of_queries_can_be_removed(spark):
    from pathlib import Path

    from sparkloom import session

    where = Path(session.place(spark, "x").replace("file:", ""))
    spark.range(3).write.parquet(str(where))
    assert where.exists() and where.parent.name.startswith("run-")
    session.clean_places(spark)
    assert not where.exists() and not session._places
