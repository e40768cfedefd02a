import random

from pyspark.sql import functions as F

from snapweave.llm import toxicity as t

from .conftest import ODD


def edits(a, b):
    """Optimal string alignment with look-alike digits, by the textbook table."""
    same = lambda x, y: x == y or y in t.LOOKALIKE.get(x, "")
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same(a[i - 1], b[j - 1])))
            if i > 1 and j > 1 and same(a[i - 1], b[j - 2]) and same(a[i - 2], b[j - 1]):
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms, rnd = ["idiot", "moron", "scum", "disgusting", "abc"], random.Random(5)
    trie = t.FuzzyTrie(terms)
    for _ in range(3000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k : k + rnd.randrange(2)] = rnd.choices("idotmrnscu10", k=rnd.randrange(2))
        word = "".join(w)
        near = [(edits(word, x), x) for x in terms if edits(word, x) <= t.edits_allowed(x)]
        got = trie.match(word)
        assert (got is None) == (not near), word
        if got:
            assert got[1] == min(near)[0], word


def corpus(spark, n=600):
    rnd = random.Random(6)
    plain = ["".join(rnd.choices("bdfghklnprtu", k=5)) for _ in range(400)]
    bad, rows, labels = ["idiot", "moron", "vequance", "veqution", "vequel"], [], []
    for k in range(n):
        w, toxic = rnd.choices(plain, k=40), k % 6 == 0
        if toxic:
            for _ in range(3):
                w[rnd.randrange(40)] = rnd.choice(bad)
        rows.append((k, " ".join(w) + "."))
        labels.append((k, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_terms_stems_misspellings_and_context(spark, docs):
    rows, labels = corpus(spark)
    d = t.learn(docs(rows), labels, ~t.held_out(F.col("doc_id")))
    assert {"idiot", "moron"} <= set(d.terms) and any(x.startswith("veq") and x.endswith("*") for x in d.terms)
    got = {r.doc_id: r for r in t.score_toxicity(docs(rows), d).collect()}
    assert all((got[k].toxicity >= 0.3) == (k % 6 == 0) for k, _ in rows)
    more = docs([(1, "you are an idoit and a m0ron, vequzzz"), (2, "plain words only"), (3, 'the report quoted the word "idiot" here'), (4, "an idiot here")])
    got = {r.doc_id: r for r in t.score_toxicity(more, d).collect()}
    assert [h.misspelled for h in got[1].toxic_terms] == [True, True, False] and got[1].toxicity > 0.3 > got[2].toxicity
    assert got[3].toxic_terms[0].quoted and not got[4].toxic_terms[0].quoted and got[3].toxicity < got[4].toxicity


def test_odd_rows(spark, docs):
    rows, labels = corpus(spark, 200)
    d = t.learn(docs(rows), labels, F.lit(True))
    got = t.score_toxicity(docs(ODD), d).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity <= 1 for r in got)
    none = labels.limit(0)
    assert {r.toxicity for r in t.score_toxicity(docs(ODD), t.learn(docs(ODD), none, F.lit(True))).collect()} == {0.0}
    assert t.score_toxicity(docs(ODD).limit(0), d).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    assert t.learn(docs(ODD), nulls, F.lit(True)).coefficients is None


def test_long_words_and_repeated_ids(spark, docs):
    rows, labels = corpus(spark)
    d = t.learn(docs(rows + rows[:6] * 200), labels, F.lit(True))
    assert {"idiot", "moron"} <= set(d.terms)
    stem = next(x[:-1] for x in d.terms if x.startswith("veq") and x.endswith("*"))
    more = docs([(1, "you " + stem + "z" * 60), (2, "z" * 100_000)])
    got = {r.doc_id: r for r in t.score_toxicity(more.withColumn("TOXICITY", F.lit(9)), d).collect()}
    assert [h.term for h in got[1].toxic_terms] == [stem + "*"] and not got[2].toxic_terms


def test_terms_are_not_capped():
    words = ["".join(chr(97 + (k // 26**i) % 26) for i in range(5)) for k in range(0, 26**5, 9973)]
    found = t.pick_terms([(w, 40, 0) for w in words], 1000, 7000)
    assert len(found) == len(words) > 500
