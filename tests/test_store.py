"""Trees, stores and jobs, end to end; every check ends in the same oracle: verify, prefix, materialise, compare."""

import os
import random

import pytest
from pyspark.sql import functions as F

from snapweave.operators import snapshot
from snapweave.plans import faults
from snapweave.plans.job import replicate
from snapweave.plans.store import Store
from snapweave.schema import EngineError
from snapweave.sources.tree import listed, register, scan, stream_chunks


@pytest.fixture
def tree(tmp_path):
    rnd, root = random.Random(8), tmp_path / "tree"
    files = {"empty.bin": b"", "one.bin": b"x", ".dot": b"hidden", "_under": b"too", "nested/deep/inner.bin": rnd.randbytes(90000), "big.bin": rnd.randbytes(400000), "zeros.bin": b"\0" * 300000, "exact.bin": rnd.randbytes(65536)}
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink("/etc/hostname", root / "link")
    os.chmod(root / "one.bin", 0o750)
    return root, files


def same(root, out, files):
    assert sorted(p for p, _ in listed(str(out))[0]) == sorted(files)
    for name, data in files.items():
        assert (out / name).read_bytes() == data
        assert os.stat(out / name).st_mode == os.stat(root / name).st_mode


def test_scan_keeps_every_regular_file(spark, tree):
    root, files = tree
    f, refs = scan(spark, str(root))
    rows = {r.path: r for r in f.collect()}
    assert set(rows) == set(files) and rows["one.bin"].mode == 0o750
    assert rows["big.bin"].mtime_ns == os.stat(root / "big.bin").st_mtime_ns
    assert refs.agg(F.sum("length")).first()[0] == sum(map(len, files.values()))
    assert listed(str(root))[1] == 1
    register(spark)
    whole = {r.path: bytes(r.content) for r in spark.read.format("tree").load(str(root)).collect()}
    assert whole == files


def test_stream_chunks_equal_whole(tmp_path, monkeypatch):
    from snapweave.operators.chunking import Params, cuts
    from snapweave.sources import tree as t

    monkeypatch.setattr(t, "BLOCK", 100_000)
    data = random.Random(9).randbytes(700_000)
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as f:
        parts = list(stream_chunks(f, Params()))
    assert b"".join(parts) == data and [len(p) for p in parts] == [b - a for a, b in zip([0, *cuts(data)], cuts(data))]  # noqa: B905


def test_generations_end_to_end(spark, tree, tmp_path):
    root, files = tree
    store = Store.open(spark, str(tmp_path / "store"))
    first = replicate(spark, str(root), store, "backup", 0)
    assert first["files"] == 8 and first["chunks_sent"] == first["chunks_total"]
    again = replicate(spark, str(root), store, "backup", 1)
    assert again["chunks_sent"] == 0 and again["files_unchanged"] == 8
    data = bytearray(files["big.bin"])
    data[200000] ^= 1
    (root / "big.bin").write_bytes(data)
    (root / "moved.bin").write_bytes(files["exact.bin"])
    third = replicate(spark, str(root), store, "backup", 2)
    assert 1 <= third["chunks_sent"] <= 3 and third["files_unchanged"] == 7
    now = files | {"big.bin": bytes(data), "moved.bin": files["exact.bin"]}
    store.materialize("backup", 2, str(tmp_path / "out"))
    same(root, tmp_path / "out", now)
    assert store.verify(deep=True)["problems"] == 0 and store.latest("backup") == 2
    assert [r.files for r in store.catalog().orderBy("generation").collect()] == [8, 8, 9]
    with pytest.raises(EngineError) as e:
        store.commit("backup", 1, *scan(spark, str(root)))
    assert e.value.code == "exists"
    with pytest.raises(EngineError):
        store.manifest("backup", 9)


@pytest.mark.parametrize("point", faults.POINTS)
def test_a_failure_anywhere_is_mended_by_a_retry(spark, tree, tmp_path, point):
    root, files = tree
    small = {k: v for k, v in files.items() if len(v) < 70000}
    for k in set(files) - set(small):
        os.remove(root / k)
    store = Store.open(spark, str(tmp_path / "store"))
    faults.clear()
    faults.arm(point)
    done = replicate(spark, str(root), store, "backup", 0)
    faults.clear()
    assert done["attempts"] == 2
    assert store.verify()["problems"] == 0
    assert store.sweep() == (point in ("after_manifest", "before_marker"))
    store.materialize("backup", 0, str(tmp_path / "out"))
    same(root, tmp_path / "out", small)


def test_gap_and_damage_are_reported(spark, tree, tmp_path):
    root, _ = tree
    store = Store.open(spark, str(tmp_path / "store"))
    replicate(spark, str(root), store, "backup", 5)
    assert [x[0] for x in store.verify()["detail"]] == ["gap in generations"]
    one = store.fingerprints().orderBy("length").first()
    part = f"{store.root}/chunks/shard={bytes(one.fp)[0]}"
    for name in os.listdir(part):
        os.remove(os.path.join(part, name))
    assert "missing chunk" in [x[0] for x in store.verify()["detail"]]
    with pytest.raises(EngineError) as e:
        store.materialize("backup", 5, str(tmp_path / "out"))
    assert e.value.code == "not-found"
    replicate(spark, str(root), store, "backup", 0)  # the set difference asks for what is lost, unchanged files or not
    store.materialize("backup", 5, str(tmp_path / "out"))


def test_guards(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "store"))
    with pytest.raises(EngineError) as e:
        store.put(spark.createDataFrame([(b"\0" * 32, b"data")], "fp binary, payload binary"))
    assert e.value.code == "fingerprint-mismatch"
    from snapweave.operators.chunking import Params

    with pytest.raises(EngineError):
        Store.open(spark, str(tmp_path / "store"), Params(256, 1024, 4096))
    files = spark.createDataFrame([], "path string, mode int, size long, mtime_ns long, digest binary")
    refs = spark.createDataFrame([], "path string, chunk_no int, offset long, length int, fp binary")
    with pytest.raises(EngineError):
        store.commit(".bad", 0, files, refs)
    store.commit("none", 0, files, refs)
    assert store.catalog().first().files == 0 and store.verify()["problems"] == 0


def test_dense_number_by_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.lit("x").alias("b"))
    for size in (10_000, 700, 40):
        got = snapshot.dense_number(rows, ["a", "b"], "n", range_rows=size).orderBy("a").collect()
        assert [r.n for r in got] == list(range(5000))
    assert snapshot.dense_number(rows.limit(0), ["a", "b"], "n").count() == 0


def test_batches_in_blocks_equal_one_walk(spark):
    rnd = random.Random(11)
    for most, limit in ((50, 100), (300, 100), (5, 1000), (1, 3)):
        sizes = [rnd.randrange(1, most + 1) for _ in range(500)]
        plan = spark.createDataFrame(list(enumerate(sizes)), "seq long, length int").repartition(3)
        want = list(snapshot.greedy_batches([n + 1 + (n > 127) for n in sizes], limit))
        for block in (1, 7, 64, 1000):
            assert [r.batch for r in snapshot.pack_batches(plan, limit, block).orderBy("seq").collect()] == want, (most, limit, block)
    assert snapshot.pack_batches(plan.limit(0)).count() == 0


def test_union_and_deltas_of_runs(spark):
    from snapweave.functions.codecs import runs_of

    rnd = random.Random(12)
    a, b = (sorted(rnd.sample(range(1000), n)) + list(range(1500, 1700, 2)) for n in (100, 400))
    a += range(1900, 2100)
    df = [spark.createDataFrame([(i,) for i in x], "idx long") for x in (a, b)]
    runs = [snapshot.need_runs(d, block=16) for d in df]
    got = snapshot.union_runs(*runs, block=16)
    assert sorted(map(tuple, got.collect())) == runs_of(sorted({*a, *b}))
    want = runs_of(sorted({*a, *b}))
    deltas = sorted(map(tuple, snapshot.run_deltas(got, block=32).collect()))
    assert deltas == [(s, e, s - (want[i - 1][1] + 1 if i else 0), e - s) for i, (s, e) in enumerate(want)]


def test_torn_markers_are_none(spark, tree, tmp_path):
    root, _ = tree
    store = Store.open(spark, str(tmp_path / "store"))
    (tmp_path / "store/commits/backup").mkdir(parents=True)
    for torn in ("", '{"generation": 0, "dig', "[]", "{}"):
        (tmp_path / "store/commits/backup/g0000000000.json").write_text(torn)
        assert store.commits().count() == 0 and store.verify()["generations"] == 0
    replicate(spark, str(root), store, "backup", 0)
    assert store.commits().count() == 1 and store.verify(deep=True)["problems"] == 0
    assert not os.listdir(tmp_path / "store/scans")


def test_a_marker_is_created_once(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "store"))
    assert store._create("commits/a/x.json", "1") and not store._create("commits/a/x.json", "2")
    assert store._read("commits/a/x.json") == "1" and os.listdir(tmp_path / "store/commits/a") in (["x.json"], [".x.json.crc", "x.json"], ["x.json", ".x.json.crc"])


def test_runs_across_blocks(spark):
    rnd = random.Random(10)
    for density in (0.1, 0.9):
        indices = sorted(rnd.sample(range(1000), int(1000 * density))) + list(range(2000, 2200))
        df = spark.createDataFrame([(i,) for i in indices * 2], "idx long")
        from snapweave.functions.codecs import encode_need, runs_of

        runs = snapshot.need_runs(df, block=16)
        assert sorted(map(tuple, runs.collect())) == runs_of(indices)
        assert snapshot.encoded_size(runs).first()[0] == len(encode_need(runs_of(indices)))
        assert sorted(r.idx for r in snapshot.expand_runs(runs, most=7).collect()) == indices
        asked = spark.range(2300).withColumnRenamed("id", "idx")
        assert sorted(r.idx for r in snapshot.in_runs(asked, runs, block=32).collect()) == indices


def test_a_corrupt_chunk_is_not_written(spark, tree, tmp_path):
    root, _ = tree
    store = Store.open(spark, str(tmp_path / "store"))
    replicate(spark, str(root), store, "backup", 0)
    rows = store.chunks().collect()
    big = max(rows, key=lambda r: r.length)
    spark.createDataFrame([(bytes(r.fp), r.length, b"!" * r.length if r is big else bytes(r.payload), r.shard) for r in rows], "fp binary, length int, payload binary, shard int").write.partitionBy("shard").parquet(str(tmp_path / "other/chunks"))
    store.remove("chunks")
    os.rename(tmp_path / "other/chunks", tmp_path / "store/chunks")
    with pytest.raises(EngineError) as e:
        store.materialize("backup", 0, str(tmp_path / "out"))
    assert e.value.code == "corrupt" and not any(p.endswith(".tmp") or p == e.value.detail for p, _ in listed(str(tmp_path / "out"))[0])
    assert "corrupt chunk" in [x[0] for x in store.verify(deep=True)["detail"]]
