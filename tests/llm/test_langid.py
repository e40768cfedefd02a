import random

import numpy as np
from pyspark.sql import functions as F

from snapweave.llm import langid as g

from .conftest import ODD

PARTS = {"aa": "ba be bi ko ku la".split(), "bb": "strz ość szcz ny wa".split(), "cc": "tion eau eux ment é".split(), "dd": "ung keit sch ß en".split(), "ee": "zione gli che are o".split(), "ff": "ij oe aar heid van".split(), "gg": "ción dad llo ñ ar".split()}


def corpus(langs, n=60):
    rnd = random.Random(11)
    rows = []
    for k in range(n * len(langs)):
        lang = langs[k % len(langs)]
        rows.append((k, " ".join("".join(rnd.choices(PARTS[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    for langs in (["aa"], ["aa", "bb"], list(PARTS)[:4], list(PARTS)):
        rows = corpus(langs)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = g.learn(df, ~g.held_out(F.col("doc_id")), per_language=40)
        got = g.identify(df.select("doc_id", "text"), model).where(g.held_out(F.col("doc_id"))).collect()
        truth = {k: lang for k, _, lang in rows}
        assert got and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.95
        assert all(0 <= r.score <= 1 for r in got)


def test_codewords_differ():
    for n in range(2, 20):
        code = g.codebook(n)
        assert code.shape[0] == n and all((code[i] != code[j]).sum() >= code.shape[1] / 4 for i in range(n) for j in range(i))


def test_odd_rows(spark, docs):
    df = spark.createDataFrame(corpus(["aa", "cc"]), "doc_id long, text string, lang string")
    model = g.learn(df.unionByName(spark.createDataFrame([(1, None, "aa"), (2, "x", None), (3, "123", "zz")], df.schema)), F.lit(True))
    assert model.languages == ["aa", "cc"]
    rows = [*ODD, (7, "123 ... !"), (8, "—…"), (9, "½ ² ① Ⅷ"), (10, "½ x")]
    got = g.identify(docs(rows), model).collect()
    assert len(got) == len(rows)
    assert all((r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or "")) for r in got)
    nothing = g.learn(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in g.identify(docs(ODD), nothing).collect()} == {"und"}
    assert g.identify(docs(ODD).limit(0), model).count() == 0


def test_repeated_rows_teach_once(spark):
    rows = corpus(["aa", "bb"], 30)
    df = spark.createDataFrame(rows + rows[:1] * 3000, "doc_id long, text string, lang string")
    own = df.where("doc_id < 5")
    model = g.learn(own, F.lit(True), per_language=10)
    assert set(model.languages) <= {"aa", "bb"}
    out = g.identify(df.select("doc_id", "text").withColumn("LANG_PRED", F.lit("q")).withColumn("n", F.lit(1)), model)
    assert out.columns == ["doc_id", "text", "n", "lang_pred", "score", "ambiguous"] and out.count() == len(rows) + 3000
