import random

from pyspark.sql import functions as F

from snapweave.functions import columns as c
from snapweave.functions import udfs
from snapweave.streaming.arrivals import Tracker, high_water_stream, ingest_stream

GOOD_PATHS = ["a", "a/b", "a.b/c-d", "..a", "a..", "x" * 4096, "sp ace/é"]
BAD_PATHS = ["", "/a", "a/", "a//b", ".", "..", "a/..", "../a", "a/./b", "a\\b", "a\tb", "a\nb", "a\n", "x" * 4097]


def test_predicates(spark):
    rows = [(p, True) for p in GOOD_PATHS] + [(p, False) for p in BAD_PATHS]
    got = spark.createDataFrame(rows, "p string, ok boolean").withColumn("got", c.valid_path(F.col("p"))).collect()
    assert [r.p for r in got if r.ok != r.got] == []
    names = [("a", 1), ("A-b_c.9", 1), ("x" * 128, 1), ("", 0), (".a", 0), ("a b", 0), ("a\n", 0), ("x" * 129, 0), ("a/b", 0)]
    got = spark.createDataFrame(names, "n string, ok int").withColumn("got", c.valid_dataset(F.col("n"))).collect()
    assert all(bool(r.ok) == r.got for r in got)
    ids = [("a1-f", 1), ("0" * 64, 1), ("", 0), ("A", 0), ("g", 0), ("0" * 65, 0), ("a\n", 0)]
    got = spark.createDataFrame(ids, "n string, ok int").withColumn("got", c.valid_session(F.col("n"))).collect()
    assert all(bool(r.ok) == r.got for r in got)


def test_scalars(spark):
    import hashlib

    row = spark.range(1).select(
        c.to_hex(c.le64(F.lit(258))).alias("le"), c.varint_size(F.lit(16384)).alias("v"), c.lz_bound(F.lit(1000)).alias("b"), c.dirname(F.lit("a/b/c")).alias("d"), c.dirname(F.lit("c")).alias("e"),
        c.session_id(F.lit("backup"), F.lit(7), F.lit(b"d" * 32)).alias("s"), c.shard(F.lit(b"\xfe" + b"0" * 31)).alias("sh"), c.clamped(F.lit(float("nan")), 1, 5).alias("cl"),
    ).first()
    assert row.le == "0201000000000000" and row.v == 3 and row.b == 1019 and (row.d, row.e) == ("a/b", ".")
    assert row.s == hashlib.sha256(b"backup" + (7).to_bytes(8, "little") + b"d" * 32).hexdigest()[:32]
    assert row.sh == 254 and row.cl == 1


def test_codec_columns(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([b"ab" * 300, rnd.randbytes(200), b""])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, data binary")
    packed = df.withColumn("z", udfs.lz_compress_col("data")).withColumn("s", c.smaller(F.col("data"), F.col("z"))).select("*", "s.*")
    back = packed.withColumn("d", udfs.lz_decompress_col("payload", F.octet_length("data")))
    assert back.where("compressed AND (d.code <> 'ok' OR d.data <> data)").count() == 0 and back.where("compressed").count() > 0
    assert back.where("NOT compressed AND payload <> data").count() == 0
    frames = df.withColumn("f", udfs.encode_frame_col(F.lit(8), F.lit(0), "id", F.octet_length("data"), "data")).withColumn("g", udfs.decode_frame_col("f"))
    assert frames.where("g.code <> 'ok' OR g.payload <> data OR g.seq <> id").count() == 0
    assert frames.select(udfs.decode_frame_col(F.substring("f", 1, 20)).alias("g")).where("g.code <> 'short-read'").count() == 0
    ints = spark.range(300).select("id", udfs.decode_varint_col(udfs.varint_col("id")).alias("v"))
    assert ints.where("v.code <> 'ok' OR v.value <> id").count() == 0
    assert spark.createDataFrame([(b"123456789",)], "d binary").select(udfs.crc32c_col("d")).first()[0] == 0xE3069283


def test_tracker_against_bitmap():
    rnd = random.Random(12)
    for _ in range(60):
        n, window = rnd.randrange(1, 300), rnd.choice([16, 1000])
        t, seen = Tracker(n, window=window), set()
        for _ in range(400):
            a, k = rnd.randrange(n), rnd.randrange(1, 38)
            base = next(i for i in range(n + 1) if i not in seen)
            said = t.mark(a, k)
            if a + k > n or a + k > base + window:
                assert said == "protocol"
                continue
            new = set(range(a, a + k)) - seen
            assert said == ("ok" if new else "duplicate")
            seen |= new
            assert t.base == next(i for i in range(n + 1) if i not in seen)
            assert Tracker.unpack(t.base, t.pack()) == t.ahead


def test_high_water_stream_survives_restart(spark, tmp_path):
    src, chk = tmp_path / "in", tmp_path / "chk"
    kind = "session string, seq long, count long, plan_size long"
    spark.createDataFrame([("a", 0, 10, 30), ("a", 20, 10, 30), ("b", 5, 2, 9)], kind).coalesce(1).write.parquet(str(src / "1"))
    out = []

    def run():
        s = high_water_stream(spark.readStream.schema(kind).parquet(str(src / "*")))
        q = s.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(chk)).trigger(availableNow=True).start()
        q.awaitTermination(90)

    run()
    assert {(r.session, r.high_water, r.pending) for r in out} == {("a", 10, 10), ("b", 0, 2)}
    out.clear()
    spark.createDataFrame([("a", 10, 10, 30), ("a", 0, 5, 30), ("a", 29, 5, 30)], kind).coalesce(1).write.parquet(str(src / "2"))
    run()
    assert [(r.session, r.high_water, r.duplicates, r.refused, r.complete) for r in out] == [("a", 30, 1, 1, True)]


def test_ingest_stream_is_idempotent(spark, tmp_path):
    from snapweave.plans.store import Store

    store, rows = Store.open(spark, str(tmp_path / "store")), spark.createDataFrame([(bytes([i]) * 50,) for i in range(20)] * 2, "payload binary").select(c.fingerprint(F.col("payload")).alias("fp"), "payload")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        q = ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / f"chk{k}")).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert store.totals().first().chunks == 20 and store.chunks().count() == 20


def test_varints_as_expressions(spark):
    from snapweave.functions.codecs import put_varint

    values = [0, 1, 127, 128, 16383, 16384, *[(1 << (7 * n)) + d for n in range(3, 9) for d in (-1, 0, 1)], (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in [*values, -1]], "v long").select("v", c.varint(F.col("v")).alias("b")).collect()
    assert all(bytes(r.b) == put_varint(r.v) if r.v >= 0 else r.b is None for r in rows)
