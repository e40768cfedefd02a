import random

import numpy as np
import pytest

from snapweave.llm import ngram_join as nj

from .conftest import ODD


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num):
    own = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= num * (len(own[i]) + len(own[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(own[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def families(seed, n_families=25, hot=60):
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    for f in range(n_families):
        base = [word() for _ in range(rnd.choice([2, 5, 9, 12, 20, 40, 80, 300]))]
        if f % 4 == 0:
            base[2:2] = passage
        for _ in range(hot if f == 7 else rnd.randrange(1, 6)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.3:
                w = w[: max(1, len(w) - rnd.randrange(1 + len(w) // 12))]
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(docs, n, num):
    rows = families(n)
    got = nj.ngram_join(docs(rows), n=n, num=num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, n, num)


def test_keep_one(docs):
    rows = families(9, 8, 20)
    want = brute(rows, 5, 80)
    kept = {r.doc_id for r in nj.keep_one(docs(rows), n=5, num=80).collect()}
    assert kept == {c for _, _, c in want}


def test_odd_rows(docs):
    got = nj.ngram_join(docs(ODD), n=3, num=90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(ODD, 3, 90)
    assert nj.ngram_join(docs(ODD).limit(0)).count() == 0
    kept = nj.keep_one(docs(ODD)).collect()
    assert sorted((r.text or "" for r in kept if r.doc_id == 4)) == ["another text", "twice"] and len(kept) == len(ODD) - 1


@pytest.mark.parametrize("num", [80, 90])
def test_pigeonhole_never_misses(num):
    """Pairs that link share a kept word of their sketches, whatever the order."""
    rng = np.random.default_rng(4)
    bands = nj.Bands(num, 100)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop, add = rng.integers(0, 1 + size // 8, 2)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(add), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < num * (len(a) + len(b) - both):
            continue
        hot = np.sort(rng.permutation(a)[: len(a) // 2])
        keys = [np.concatenate([nj.buckets(x, band, bands.words(band), keep, hot, np.ones(len(hot), np.int64)) for band, keep in bands.kept(len(x))]) for x in (a, b)]
        assert len(np.intersect1d(*keys)) > 0
        differ = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(nj.sketch(a).view(np.uint64), nj.sketch(b).view(np.uint64), strict=True))
        assert differ <= len(a) + len(b) - 2 * both


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_links_equal_brute_force(docs, n, num):
    rows = families(n, 25, 40) + [(9000, None), (9001, "")]
    links, members = nj.ngram_links(docs(rows), n=n, num=num)
    class_of = {r.doc_id: r for r in members.collect()}
    sets = {class_of[d].class_id: shingles(t, n) for d, t in rows if shingles(t, n)}
    want = {(a, b) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    assert len(want) > 20 and {(r.class_id, r.other) for r in links.collect()} == want
    for d, t in rows:
        r = class_of[d]
        assert r.n_shingles == len(shingles(t, n)) and r.n_links == (sum(a == r.class_id for a, _ in want) if shingles(t, n) else None)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (3, None, 7, 8, 9)], "doc_id long, text string, _key int, KEY int, cls int")
    assert sorted(map(tuple, nj.keep_one(df).collect()), key=repr) == [(1, "a b c d e f", 1, 2, 3), (3, None, 7, 8, 9)]
