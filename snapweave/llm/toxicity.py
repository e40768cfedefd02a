"""Toxicity: a learned lexicon, met exactly or misspelled, in its context.

The lexicon is learned from labelled rows: words, and stems that many words begin with, far commoner in toxic texts. Misspelled terms are caught by
Levenshtein automata intersected with the lexicon's trie: a state is a set of (trie node, edits, character
awaited by a swap), made deterministic as words are read, so a word costs one look-up per character and
most words die after a few. Look-alike digits count as their letters. Around each hit a window of
characters is searched for signs of quotation (quote marks, verbs of saying) and of address; direct,
quoted and misspelled hits are separate features of a logistic score.

Scale: learning takes about `sample` labelled rows (a documented bound), whose ids are all that is
broadcast; word counts are aggregated where they arise. Scoring is one narrow map.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, alnum_words, bounded_batches, hashed_share, table, without
from .langid import held_out

#: Digits read as letters in words that hide (fixed values).
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
QUOTE_MARKS = re.compile("[\"“”„«»‹›]")
SAYING = re.compile(r"\b(?:said|says|say|wrote|writes|called|quote|quoted|quotes|reported|word|words|term|terms|phrase)\b", re.I)
ADDRESS = re.compile(r"\b(?:you|your|youre|u|ur|yourself)\b", re.I)
N_FEATURES = 7


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class FuzzyTrie:
    """The lexicon's trie, read through Levenshtein automata (insertion, deletion, change, swap)."""

    def __init__(self, terms):
        self.children, self.ends = [{}], [None]
        for term in sorted(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][c]
            self.ends[node] = term
        self.most = max(map(edits_allowed, terms), default=0)
        self.start = self._closed({(0, ""): 0})
        self.steps: dict[tuple, dict | None] = {}
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict] = []
        self.first = self._number(self.start)

    def _closed(self, state: dict) -> dict:
        """With letters of terms left out."""
        todo = list(state.items())
        while todo:
            (node, wait), e = todo.pop()
            if wait or e >= self.most:
                continue
            for child in self.children[node].values():
                key = (child, "")
                if state.get(key, 99) > e + 1:
                    state[key] = e + 1
                    todo.append((key, e + 1))
        return state

    def _number(self, state: dict) -> int:
        key = frozenset(state.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(state)
        return self.states[key]

    def _step(self, number: int, c: str) -> int:
        """The next state's number; -1 when no term can be reached any more."""
        out: dict = {}

        def put(node, wait, e):
            if e <= self.most and out.get((node, wait), 99) > e:
                out[(node, wait)] = e

        like = LOOKALIKE.get(c, "") + c
        for (node, wait), e in self.sets[number].items():
            if wait:
                if wait in like:
                    put(node, "", e)
                continue
            put(node, "", e + 1)  # a letter too many
            for x, child in self.children[node].items():
                put(child, "", e if x in like else e + 1)
                for y, grand in self.children[child].items():
                    if y in like and y != x:
                        put(grand, x, e + 1)  # swapped with the next letter
        return self._number(self._closed(out)) if out else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowance, else None."""
        at = self.first
        for c in word:
            key = (at, c)
            nxt = self.steps.get(key)
            if nxt is None:
                if len(self.steps) > 2_000_000:
                    self.steps.clear()
                nxt = self.steps[key] = self._step(at, c)
            if nxt < 0:
                return None
            at = nxt
        found = [(e, self.ends[node]) for (node, wait), e in self.sets[at].items() if not wait and self.ends[node] and e <= edits_allowed(self.ends[node])]
        e, term = min(found, default=(0, None))
        return (term, e) if term else None


class Detector:
    """Terms with weights, words that only look like them, and the score's coefficients."""

    def __init__(self, terms: dict[str, float], clean: set[str], coefficients: np.ndarray | None = None, prior: float = 0.0, context: int = 60, limit: int = 400_000):
        self.terms, self.clean, self.coefficients, self.prior, self.context, self.limit = terms, clean, coefficients, prior, context, limit
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.trie, self.seen, self.hits = FuzzyTrie([t for t in terms if not t.endswith("*")]), set(), {}

    def meet(self, words: set[bytes]) -> None:
        """Remember which of these words match a term."""
        if len(self.seen) > self.limit:
            self.seen, self.hits = set(), {}
        for w in words.difference(self.seen):
            word = w.decode()
            if len(word) < 3:
                continue
            if (m := self.trie.match(word)) and (word == m[0] or word not in self.clean):
                self.hits[w] = (m[0], word != m[0])
            elif stem := next((word[:k] for k in range(3, 9) if word[:k] in self.stems), None):
                self.hits[w] = (stem + "*", False)
        self.seen |= words

    def features(self, text: bytes | None) -> tuple[np.ndarray, list]:
        """The features of one text and its hits (start byte, end byte, term, misspelled, quoted)."""
        x = np.zeros(N_FEATURES)
        words = alnum_words(text) if text else []
        own = set(words)
        self.meet(own)
        known = own & self.hits.keys()
        if not known:
            return x, []
        spans = []
        low = text.translate(LOWER_KEEP)
        for w in known:
            at = low.find(w)
            while at >= 0:
                if not _inside(low, at, at + len(w)):
                    spans.append((at, at + len(w), w))
                at = low.find(w, at + len(w))
        found = []
        for a, b, w in sorted(spans):
            term, misspelled = self.hits[w]
            before, after = (s.decode("utf-8", "ignore") for s in (text[max(0, a - self.context) : a], text[b : b + self.context]))
            marked = (QUOTE_MARKS.search(before[-12:]) and QUOTE_MARKS.search(after[:12])) is not None
            spoken = bool(SAYING.search(before)) and not ADDRESS.search(after[:20])
            quoted = marked or spoken and bool(QUOTE_MARKS.search(before) or QUOTE_MARKS.search(after))
            found.append((a, b, term, misspelled, quoted))
            weight = self.terms[term]
            x[0 if not misspelled and not quoted else 1 if not quoted else 2] += weight
            x[5] += bool(ADDRESS.search(before) or ADDRESS.search(after))
        total = sum(x[:3])
        x[3] = total / max(1, len(words)) * 20
        x[4] = max(self.terms[f[2]] for f in found if not f[4]) if any(not f[4] for f in found) else 0
        x[6] = len({f[2] for f in found if not f[4]})
        x[:3], x[5], x[6] = np.log1p(x[:3]), np.log1p(x[5]), np.log1p(x[6])
        return x, found

    def score(self, text: bytes | None) -> tuple[float, list]:
        if self.coefficients is None:
            return self.prior, []
        x, found = self.features(text)
        z = float(self.coefficients[:-1] @ x + self.coefficients[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40)))), found


LOWER_KEEP = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _inside(low: bytes, a: int, b: int) -> bool:
    """Whether the place is part of a longer word."""
    word = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    return a > 0 and word(low[a - 1]) or b < len(low) and word(low[b])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        g = x.T @ (p - y) / len(y) + penalty @ c / len(y) * 10
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty / len(y) * 10 + 1e-9 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c = c - step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return c


def stems(word: str) -> list[str]:
    """A word and its beginnings of 3 to 8 letters, marked by a star."""
    return [word, *(word[:k] + "*" for k in range(3, min(8, len(word) - 1) + 1))]


def pick_terms(counts: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words and stems far commoner in toxic texts, with their weights.

    A term stands in at least four toxic texts and 3 % of them, and the log odds are above 1.5 by two
    standard errors. Of nested terms the one with most toxic texts (less five for each clean one) stays; ties go
    to the whole word, then to the longer stem. Their number is bounded by the learned rows' words.
    """
    found = []
    for term, a, b in counts:
        if a < max(4, 0.03 * n_toxic) or not term.rstrip("*").isalpha() or len(term) < 3:
            continue
        odds = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((b + 0.5) / (n_clean - b + 0.5))
        error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds - 2 * error > 1.5:
            found.append((a - 5 * b, not term.endswith("*"), len(term), term, odds - error))
    kept: dict[str, float] = {}
    stemmed, begun = set(), set()  # stems that are kept, and all beginnings of what is kept
    for _, _, _, term, odds in sorted(found, reverse=True):
        own = term.rstrip("*")
        if any(own[:k] in stemmed for k in range(3, len(own) + 1)) or term.endswith("*") and own in begun:
            continue
        kept[term] = float(min(3.0, max(0.5, odds / 2)))
        begun |= {own[:k] for k in range(3, len(own) + 1)}
        if term.endswith("*"):
            stemmed.add(own)
    return kept


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = 8_000) -> Detector:
    """A detector from about `sample` labelled rows (less than twice as many) of `docs` (`doc_id`, `text`) that may be learned from.

    The rows are chosen by a hash of their id, an id of several rows teaches by its least text; labels of null ids, null labels and other labels than 0 and 1
    teach nothing, and an id labelled both ways counts as toxic. Without both classes every score is the share
    of toxic rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    picked = [(r.doc_id, r._toxic) for r in hashed_share(known.where(learnable), sample, "doc_id").collect()]
    if len({t for _, t in picked}) < 2:
        return Detector({}, set(), None, float(np.mean([t for _, t in picked])) if picked else 0.0)
    own = spark.createDataFrame(picked, "doc_id long, _toxic int")  # a bounded sample
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")).select("text", "_toxic")  # one text an id, however often it stands

    def words(batches):
        for batch in batches:
            text, toxic = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            tally = (Counter(), Counter())
            for x, t in zip(text, toxic, strict=True):
                tally[t].update({s for w in set(alnum_words(x)) for s in stems(w.decode())})
            out = sorted(tally[0].keys() | tally[1].keys())
            for low in range(0, len(out), 50_000):
                part = out[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([tally[t][w] for w in part], pa.int64()) for t in (1, 0))], names=["word", "a", "b"])

    counts = rows.mapInArrow(words, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n_toxic = sum(t for _, t in picked)
    n_clean = len(picked) - n_toxic
    counts = Shelf(spark).put(counts, "counts")
    likely = counts.where((F.col("a") >= max(4, 0.03 * n_toxic)) & (F.col("a") * n_clean > 4 * F.col("b") * n_toxic)).collect()
    terms = pick_terms([(r.word, r.a, r.b) for r in likely], n_toxic, n_clean)
    trie = FuzzyTrie([t for t in terms if not t.endswith("*")])

    def near(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if (m := trie.match(w)) and m[1]], pa.string())], names=["word"])

    clean = {r.word for r in counts.where((F.col("b") > 0) & ~F.col("word").endswith("*")).select("word").mapInArrow(near, "word string").collect()} if terms else set()
    shared = spark.sparkContext.broadcast(Detector(terms, clean))

    def featurise(batches):
        d = shared.value
        for batch in batches:
            x = [d.features(t)[0].tobytes() for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])

    made = sorted((bytes(r.x), r.y) for r in rows.mapInArrow(featurise, "x binary, y int").collect())
    if len({y for _, y in made}) < 2:
        return Detector(terms, clean, None, float(np.mean([y for _, y in made])) if made else 0.0)
    x, y = np.stack([np.frombuffer(b) for b, _ in made]), np.array([y for _, y in made], float)
    return Detector(terms, clean, fit(x, y))


def score_toxicity(docs: DataFrame, detector: Detector) -> DataFrame:
    """Every row and column of `docs` (which must have `text`), and

    toxicity double (0 to 1), toxic_terms array<struct<start int, end int, term string, misspelled boolean,
    quoted boolean>> with places in bytes of the UTF-8 text.

    Null and empty texts get the score of a text without hits. Equal texts get equal results. Columns of `docs`
    named like an output column, in any case, are replaced; names that begin with `__w_` are reserved and such columns dropped.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, "toxicity", "toxic_terms")
    at = [c.lower() for c in docs.columns].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("misspelled", pa.bool_()), ("quoted", pa.bool_())])
    terms = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("misspelled", T.BooleanType()), T.StructField("quoted", T.BooleanType())]))
    names = ("start", "end", "term", "misspelled", "quoted")

    def score(batches):
        d = shared.value
        for batch in batches:
            found = [d.score(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            hits = pa.array([[dict(zip(names, h, strict=True)) for h in f[1]] for f in found], pa.list_(hit))
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array([f[0] for f in found], pa.float64()), hits], names=batch.schema.names + ["toxicity", "toxic_terms"])

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic_terms", terms)]))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    detector = learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    found = score_toxicity(docs, detector)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), F.size("toxic_terms").alias("n_terms"))
