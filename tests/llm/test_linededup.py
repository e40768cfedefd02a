import random

import numpy as np

from snapweave.llm import linededup as L

from .conftest import ODD


def brute(rows, need=50):
    """Texts' words without those in a run of `need` words that stands earlier in another text."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = (text or "").encode().lower().split()
        mark = [False] * len(w)
        own = [b" ".join(w[i : i + need]) for i in range(len(w) - need + 1)]
        for i, g in enumerate(own):
            if g in seen:
                mark[i : i + need] = [True] * need
        seen.update(own)
        out[doc] = [x for x, m in zip(w, mark, strict=True) if not m]
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmn", k=5))
    passages = [[word() for _ in range(n)] for n in (30, 49, 50, 51, 60, 75, 130)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(rnd.randrange(5, 120))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(passages)
        if k % 9 == 8:
            w = list(rows[k - 3][1].split())
        rows.append((k, "".join(x + rnd.choice([" ", " ", "\n"]) for x in w).strip()))
    return rows


def test_equals_brute_force(docs):
    rows = corpus(1)
    got = L.dedup_lines(docs(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.text.encode().lower().split() == want[r.doc_id], r.doc_id
        assert r.n_words - r.n_deleted == len(want[r.doc_id])
    assert sum(r.n_deleted for r in got) > 1000


def test_clean_texts_stay_as_they_are(docs):
    rnd = random.Random(2)
    rows = [(k, "\n ".join(str(rnd.random()) for _ in range(100)) + "\nAll rights reserved.\n") for k in range(20)]
    assert {r.doc_id: r.text for r in L.dedup_lines(docs(rows)).collect()} == dict(rows)


def test_copies_and_self_repetition(docs):
    line = " ".join(f"w{i}" for i in range(70))
    got = {r.doc_id: r.text for r in L.dedup_lines(docs([(1, line), (2, line), (3, "\n".join([line.upper()] * 4)), (4, "x " + line + "\ny")])).collect()}
    assert got[1] == line and got[2] == "" and got[3] == "" and got[4] == "x\ny"


def test_odd_rows(docs):
    got = L.dedup_lines(docs(ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.text == dict(((d, t), t) for d, t in ODD)[(r.doc_id, r.text)] for r in got if r.doc_id != 6)
    assert 50 <= len(next(r for r in got if r.doc_id == 6).text.split()) <= 200
    assert L.dedup_lines(docs(ODD).limit(0)).count() == 0


def test_every_window_has_its_leftmost_minimum():
    rng = np.random.default_rng(3)
    for n in (25, 26, 49, 200):
        h = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(30)
        own = L._least(h, 25)
        assert own.tolist() == [s + int(np.argmin(h[s : s + 25])) for s in range(n - 24)]
    w = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    assert (L.rolling(w, 26)[10:30] == L.rolling(w[10:55], 26)).all()


def test_texts_side_by_side_have_their_own_spans():
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (1, 300, 49, 50, 51, 3, 120, 20)]
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    together = list(zip(*(x.tolist() for x in L.spans(np.concatenate(texts), 26, 25, starts)), strict=True))
    alone = [(h, s, a + int(b), m) for t, b in zip(texts, starts, strict=True) for h, s, a, m in zip(*(x.tolist() for x in L.spans(t, 26, 25)), strict=True)]
    assert together == alone


def test_long_texts_come_in_parts(monkeypatch):
    rnd = random.Random(7)
    texts = [None, b"", b"\n".join(b" ".join(b"%d" % rnd.randrange(50) for _ in range(rnd.randrange(60))) for _ in range(40)), b"a b", b"x " * 127, b"y " * 500 + b"\n" + b"z " * 20, b"z " * 20]
    whole = L.prints_of(texts, 26, 25, 5)
    monkeypatch.setattr(L, "CHUNK", 128)
    cut = L.prints_of(texts, 26, 25, 5)
    windows = lambda rows: sorted((t, a + i) for _, _, t, a, n in rows if n >= 50 for i in range(n - 49))
    lines = lambda rows: sorted((h, t, a, n) for h, _, t, a, n in rows if n < 50)
    one, many = (list(zip(*(x.tolist() for x in found), strict=True)) for found in (whole, cut))
    assert set(windows(one)) == set(windows(many)) and lines(one) == lines(many) and len(lines(one)) > 10
    assert len(windows(one)) == sum(max(0, len((t or b"").split()) - 49) for t in texts)


def test_edited_and_cut_earlier_copies(docs):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmn", k=6))
    rows, exact = [], 0
    for n in (50, 51, 55, 60, 80, 120):
        for kind in range(12):
            p = [word() for _ in range(n)]
            edited = list(p)
            edited[rnd.randrange(n)] = word()
            other = [edited, p[: rnd.randrange(26, n + 1)], p[rnd.randrange(n - 25) :]][kind % 3]
            for w in (other, p, p):
                w = [word() for _ in range(rnd.randrange(30))] + w + [word() for _ in range(rnd.randrange(30))]
                rows.append((len(rows), " ".join(w)))
            exact += n
    want = brute(rows)
    got = {r.doc_id: r for r in L.dedup_lines(docs(rows)).collect()}
    for k, w in want.items():
        assert got[k].text.encode().lower().split() == w, k
    assert sum(got[k].n_deleted for k in got if k % 3 == 2) == exact


def test_spans_tell_windows_by_their_leftmost_minimum():
    rng = np.random.default_rng(5)
    for n, kinds in ((49, 9), (50, 9), (300, 2), (300, 1), (300, 1 << 60)):
        words = rng.integers(0, kinds, n).astype(np.uint64)
        h, (found, _, first, more) = L.rolling(words, 26), L.spans(words, 26, 25)
        own = [s + int(np.argmin(h[s : s + 25])) for s in range(n - 49)]
        assert [h[x] for x in own] == [f for f, m in zip(found, more, strict=True) for _ in range(m + 1)]
        assert first.tolist() == [s for s, x in enumerate(own) if not s or own[s - 1] != x]


def test_a_paragraph_that_stands_twice_in_a_row(docs):
    rows = [(n, " ".join([f"d{n}w{i}" for i in range(n)] * 2 + ["end"])) for n in range(48, 111)]
    rows.append((200, " ".join([f"w{i}" for i in range(30)] * 4)))
    got = {r.doc_id: r.text.split() for r in L.dedup_lines(docs(rows), far=L.OWN_FAR).collect()}
    for n, text in rows[:-1]:
        w = text.split()
        assert got[n] == (w[:n] + ["end"] if n >= 50 else w), n
    assert got[200] == rows[-1][1].split()[:60]


def test_equals_brute_force_with_own_repetitions(docs):
    rows, seen = corpus(1), {}
    got = {r.doc_id: r for r in L.dedup_lines(docs(rows), far=L.OWN_FAR).collect()}
    for doc, text in rows:
        w = text.encode().lower().split()
        mark = [False] * len(w)
        for i in range(len(w) - 49):
            first = seen.setdefault(b" ".join(w[i : i + 50]), (doc, i))
            if first[0] < doc or first[1] <= i - 50:
                mark[i : i + 50] = [True] * 50
        assert got[doc].text.encode().lower().split() == [x for x, m in zip(w, mark, strict=True) if not m], doc
    assert any(got[doc].text.encode().lower().split() != w for doc, w in brute(rows).items())


def with_lines(rows, least, need=50):
    """Brute force: windows that stand earlier in another text (or `need` words before), and lines that stand earlier."""
    windows, lines, out = {}, {}, {}
    for doc, text in sorted(rows):
        w, cuts = [], []
        for line in (text or "").encode().lower().split(b"\n"):
            cuts.append((len(w), len(line.split())))
            w += line.split()
        mark = [False] * len(w)
        for i in range(len(w) - need + 1):
            first = windows.setdefault(b" ".join(w[i : i + need]), (doc, i))
            if first[0] < doc or first[1] <= i - need:
                mark[i : i + need] = [True] * need
        for i, n in cuts:
            if least <= n < need and lines.setdefault(b" ".join(w[i : i + n]), (doc, i)) != (doc, i):
                mark[i : i + n] = [True] * n
        out[doc] = [x for x, m in zip(w, mark, strict=True) if not m]
    return out


def test_repeated_lines_go_however_few(docs):
    line = " ".join(f"word{i}" for i in range(12))
    rows = [(k, f"start {k} of it\n{line}\nmiddle {k}\n{line.upper()} \nseven words that stand in every text\nend {k}") for k in range(50)]
    got = {r.doc_id: r for r in L.dedup_lines(docs(rows), far=L.OWN_FAR, line_words=8).collect()}
    assert got[0].n_deleted == 12 and all(got[k].n_deleted == 24 and "seven words" in got[k].text for k in range(1, 50))
    assert all(r.n_deleted == 0 for r in L.dedup_lines(docs(rows), far=L.OWN_FAR).collect())


def test_lines_and_passages_equal_brute_force(docs):
    rnd, rows = random.Random(8), corpus(2)
    pool = [" ".join("".join(rnd.choices("abcdefghijklmn", k=5)) for _ in range(n)) for n in (1, 7, 8, 9, 30, 49, 50, 70)]
    rows = [(k, "\n".join(rnd.sample([t, *rnd.choices(pool, k=4)], 5))) for k, t in rows]
    want = with_lines(rows, 8)
    got = {r.doc_id: r for r in L.dedup_lines(docs(rows), far=L.OWN_FAR, line_words=8).collect()}
    assert all(got[k].text.encode().lower().split() == w for k, w in want.items())


def test_nothing_stitched_from_several_sources_goes(docs):
    rnd, rows = random.Random(9), []
    word = lambda: "".join(rnd.choices("abcdefghijklmn", k=6))
    for k in range(20):
        x = [word() for _ in range(62)]
        rows += [(3 * k, " ".join(x[:44])), (3 * k + 1, " ".join(x[20:])), (3 * k + 2, " ".join(x))]
    got = L.dedup_lines(docs(rows)).collect()
    assert all(r.n_deleted == 0 for r in got)


def test_clashing_names(spark):
    rows = [(1, "a b", "x", 1, 2, "p"), (2, None, "y", 3, 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Words string, _key int, doc int, parts string")
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_key", "doc", "parts", "n_words", "n_deleted"]
    assert sorted((r.doc_id, r._key, r.doc, r.parts, r.n_words) for r in got.collect()) == [(1, 1, 2, "p", 2), (2, 3, 4, "q", 0)]
