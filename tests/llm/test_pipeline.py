import random

import pytest

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages_catch_planted_rows_and_keep_clean_ones(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("bdfghklnprtu", k=6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(60), text(14)
    rows, labels = [], []
    for k in range(300):
        t = text(40)
        if k % 6 == 0:
            t += " idiot moron idiot"
        rows.append((k, t))
        labels.append((k, int(k % 6 == 0)))
    # one word of 60 changed leaves 51 of 61 five-grams (0.836), one of 45 only 36 of 46 (0.783, below the threshold)
    base, less = text(60), text(45)
    changed = lambda t, k: " ".join(w if i != k else "changed" for i, w in enumerate(t.split()))
    rows += [(1000, base), (1001, changed(base, 20)), (1008, less), (1009, changed(less, 20)), (1002, passage + " " + text(20)), (1003, text(20) + " " + passage), (1004, text(9) + " " + item + "."), (1005, "you idiot, you moron " + text(20)), (1006, ""), (1007, rows[1][1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns, name
        d.write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r.doc_id: r.text for r in d.collect()}
    clean = {k for k in range(300) if k % 6}
    assert clean <= set(kept["decontaminate"])
    assert not {k for k in kept["toxicity"] if k < 300 and k % 6 == 0} and 1005 not in kept["toxicity"]
    assert kept["line_dedup"][1002] == dict(rows)[1002] and len(kept["line_dedup"][1003].split()) == 20
    assert 1001 in kept["line_dedup"] and 1001 not in kept["ngram_join"] and 1000 in kept["ngram_join"] and 1007 not in kept["ngram_join"]
    assert {1008, 1009} <= set(kept["ngram_join"])
    assert 1004 in kept["ngram_join"] and 1004 not in kept["decontaminate"] and 1006 in kept["decontaminate"]
    got = cp.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == set(kept["decontaminate"])


def odd_tables(spark, path, rows):
    """Tables whose documents have null ids and texts, repeated rows, and columns named like what operators add."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, Toxicity string, n_words int, N_HIT int, _key int, `odd.name` string"
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "own", 1, 2, 3, "x") for k, t in rows], kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k, _ in rows if k is not None] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_odd_rows_and_clashing_names_pass_every_stage(spark, tmp_path):
    import corpus_pipeline as cp

    from .conftest import ODD

    odd_tables(spark, str(tmp_path), ODD)
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = d.columns
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == columns, name
        d.write.parquet(f"{tmp_path}/out{k}")
        d = spark.read.parquet(f"{tmp_path}/out{k}")
        rows = d.collect()
        assert all((r.Toxicity, r.n_words, r.N_HIT, r._key, r["odd.name"]) == ("own", 1, 2, 3, "x") for r in rows), name
        assert {None, 1, 2, 3} <= {r.doc_id for r in rows}
    assert sorted(r.text for r in rows if r.doc_id == 4) == ["another text", "twice"]
    assert cp.run(spark, str(tmp_path)).count() >= len(rows)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    odd_tables(spark, str(tmp_path), [])
    assert cp.run(spark, str(tmp_path)).count() == 0
