import random
import re
import time

from snapweave.llm import licenses as L

from .conftest import ODD


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text):
    w, out = words(text), []
    for t in L.BASE:
        out += [(t.label, i) for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
    return sorted(out)


def test_base_phrases_equal_brute_force(docs):
    rnd = random.Random(3)
    pool = "gnu general public license apache cc by mit noise the Licensed under version".split()
    rows = [(k, rnd.choice([" ", "-", ". "]).join(rnd.choices(pool, k=rnd.randrange(60)))) for k in range(200)]
    rows += [(1000, "MIT License MIT LICENSE mit-license"), (1001, "MIT Kelvin License"), (1002, "émit license"), (1003, "K mit license İ CC BY")]
    for r in L.scan_licenses(docs(rows)).collect():
        got = sorted((h.label, h.start) for h in r.license_hits if h.base)
        assert got == brute(dict(rows)[r.doc_id]) and r.n_words == len(words(r.text))
        assert all(0 <= h.share <= 1 for h in r.license_hits)


def test_notices_tolerate_changed_words(docs):
    grant = "Permission is hereby granted, free of charge, to any human obtaining a copy of this software"
    broken = "Permission is granted, charge free, to any person obtaining a copy of this software"
    got = {r.doc_id: {h.label for h in r.license_hits} for r in L.scan_licenses(docs([(1, grant), (2, broken), (3, "Licensed under CC BY-NC 4.0.")])).collect()}
    assert got[1] == {"mit-grant"} and got[2] == set() and {"cc-by", "cc-by-nc"} <= got[3]


def test_odd_rows(docs):
    got = L.scan_licenses(docs(ODD)).collect()
    assert len(got) == len(ODD) and all(r.license_hits == [] for r in got)
    assert {r.doc_id: r.n_words for r in got}[6] == 30000
    assert L.scan_licenses(docs(ODD).limit(0)).count() == 0
    many = L.scan_licenses(docs([(1, "mit license " * 5000)])).first()
    assert len(many.license_hits) == 5000


def test_many_hits_cost_linear_time(docs):
    began = time.time()
    r = L.scan_licenses(docs([(1, "apache license x " * 50_000)])).first()
    assert time.time() - began < 60
    assert [(h.start, h.label, h.share) for h in r.license_hits if h.base] == [(3 * k, "apache", 1.0) for k in range(50_000)]


def test_clashing_names(spark):
    df = spark.createDataFrame([("mit license", 1, "x", 2, 3)], "text string, _words int, N_WORDS string, _votes int, License_Hits int")
    r = L.scan_licenses(df).first()
    assert list(r.asDict()) == ["text", "_words", "_votes", "n_words", "license_hits"] and (r._words, r._votes, r.n_words) == (1, 2, 2)
    assert [h.label for h in r.license_hits] == ["mit"]


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(5)
    pool = sorted({w for t in L.BASE + L.NOTICES for w in t.words}) + ["noise"] * 20
    rows = [(k, " ".join(rnd.choices(pool, k=rnd.randrange(40)))) for k in range(300)]
    for k, t in enumerate(L.BASE + L.NOTICES):
        w = t.words
        w[rnd.randrange(len(w))] = rnd.choice([w[0], "other"])
        rows += [(1000 + k, f"noise {t.text.upper()}, noise; {t.text}"), (2000 + k, " ".join(w))]
    rows += [(3000, None), (3001, ""), (1, "mit license"), (1, "mit license"), (None, "cc-by")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(repr, (tuple(r) for r in L.op3_license_scan(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, duckdb.execute(L.ORACLE).fetchall()))
