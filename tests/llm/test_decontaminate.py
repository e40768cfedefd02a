import random

from snapweave.llm import decontaminate as d

from .conftest import ODD


def brute(text, items, window=10):
    words, hit, found = d.alnum_words((text or "").encode()), set(), set()
    for item, t in items:
        for p in d.windows(d.alnum_words((t or "").encode()), window):
            for i in range(len(words) - len(p) + 1):
                if tuple(words[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = "the of and a to in b c d e f g h".split()
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(12)]
    rows = []
    for k in range(60):
        words = rnd.choices(vocabulary + ["noise"] * 20, k=rnd.randrange(40))
        if k % 3:
            part = rnd.choice(items)[1].split()
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part[rnd.randrange(3) :]
        rows.append((k, rnd.choice([" ", ", ", "-"]).join(words).title()))
    return rows, items


def test_equals_brute_force_in_one_and_in_many_blocks(spark, docs):
    rows, items = corpus(1)
    items += [(None, "noise noise"), (99, None), (100, "?!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 300):
        got = d.decontaminate(docs(rows), bench, block_bytes=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute(dict(rows)[r.doc_id], [x for x in items if x[0] is not None]), block


def test_odd_rows_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(7, "word " * 12)], "item_id long, text string")
    got = d.decontaminate(docs(ODD), bench).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.n_hit for r in got}[6] == 30000 and sum(r.n_hit for r in got) == 30000
    assert all(r.n_words == 0 for r in got if not (r.text or "").strip())
    assert sum(r.n_hit for r in d.decontaminate(docs(ODD), bench.limit(0)).collect()) == 0
    assert d.decontaminate(docs(ODD).limit(0), bench).count() == 0


def test_items_without_id_hit_as_in_sql(spark, tmp_path):
    import duckdb

    rows, items = corpus(2)
    items += [(None, "noise noise"), (None, "the of"), (None, None)]
    for name, t in (("documents", spark.createDataFrame(rows, "doc_id long, text string")), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.execute(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, d.op1_decontaminate(spark, str(tmp_path)).collect()))
    assert got == sorted(duckdb.execute(d.ORACLE).fetchall())
    docs, bench = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    one, many = ({(r.doc_id, r.n_hit, tuple(r["items"])) for r in d.decontaminate(docs, bench, block_bytes=b, nameless=True).collect()} for b in (8 << 20, 300))
    assert one == many and any(None in x[2] for x in one)


def test_clashing_names_in_one_and_in_many_blocks(spark):
    rows, items = corpus(3)
    df = spark.createDataFrame([(k, t, 1, 2, "x", "y", 5, "z") for k, t in rows], "doc_id long, text string, N_HIT int, _key int, Items string, _r string, _starts int, hits string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = {}
    for block in (8 << 20, 300, 100):
        got = d.decontaminate(df, bench, block_bytes=block)
        assert got.columns == ["doc_id", "text", "_key", "_r", "_starts", "hits", "n_words", "hit_starts", "hit_ends", "items", "n_hit"]
        found = {r.doc_id: r for r in got.collect()}
        assert all((r._key, r._r, r._starts, r.hits) == (2, "y", 5, "z") for r in found.values())
        assert plain.setdefault("of", found) == found
