"""Language identification by error-correcting output codes.

Every learned language has a codeword; one linear classifier over character n-grams predicts each bit.
Decoding is loss-weighted: the codeword with the smallest logistic loss over all bits wins, and a
document whose second codeword is nearly as close is flagged as ambiguous.

Scale: learning takes at most `per_language` documents of each language (a documented bound; their
features, not their texts, reach the driver). Prediction is one narrow map: a word's n-grams score
alike wherever it stands, so a worker sums remembered word scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, mix64, table, without

#: What may be a letter; fractions, roman and circled numbers are here too.
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes but letters become blanks.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    """Rows that learning must not see; a row without id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def codebook(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all two-part splits of the languages up to six, else the best of seeded draws."""
    if n <= 6:
        rows = [[1 if (s >> k) & 1 else -1 for s in range(1, 1 << max(n - 1, 1))] for k in range(n - 1)]
        return np.array([*rows, [-1] * ((1 << max(n - 1, 1)) - 1)], np.float32)[-n:]
    bits, rng, best = 8 * int(np.ceil(np.log2(n))), np.random.default_rng(7), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        gram = code @ code.T - 2 * bits * np.eye(n)
        if (best is None or gram.max() < best[0]) and (np.abs(code.sum(0)) < n).all():
            best = (gram.max(), code)
    return best[1]


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def grams(words: list[bytes], dims: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, hash below `dims`) of every n-gram of 1 to `longest` bytes; words' ends are marked.

    N-grams are of UTF-8 bytes, so that an accented letter counts as a pair.
    """
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owner, hashed, own = [], [], np.zeros(len(text) + 1, np.uint64)
    for n in range(1, longest + 1):
        own = own[: max(0, len(text) - n + 1)] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(1)
        inside = word[: len(own)] == word[n - 1 :]
        owner.append(word[: len(own)][inside])
        hashed.append((mix64(own[inside]) % np.uint64(dims)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(hashed)


def features(text: str, dims: int) -> np.ndarray:
    """Shares of the n-grams of one text, by hash."""
    words = letter_words(text)
    if not words:
        return np.zeros(dims, np.float32)
    total = np.bincount(grams(words, dims)[1], minlength=dims)
    return (total / total.sum()).astype(np.float32)


class Model:
    """Languages, codewords and bit classifiers over `dims` hashed n-grams."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, limit: int = 200_000):
        self.languages, self.code, self.weights, self.bias, self.limit = languages, code, weights, bias, limit
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, weights.shape[1] + 1), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        """Scores of the words not met yet: sums over their n-grams, and how many those are."""
        if len(self.known) > self.limit:
            self.known, self.rows = {}, self.rows[:0]
        new = sorted(set(words).difference(self.known))
        for low in range(0, len(new), 5000):
            part = new[low : low + 5000]
            word, gram = grams(part, len(self.weights))
            order = np.argsort(word, kind="stable")
            starts = np.searchsorted(word[order], np.arange(len(part)))
            sums = np.add.reduceat(self.weights[gram[order]], starts, axis=0)
            made = np.hstack([sums, np.bincount(word, minlength=len(part))[:, None]]).astype(np.float32)
            self.known.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate([self.rows, made])

    def margins(self, words: list[bytes]) -> np.ndarray:
        """The bit classifiers' outputs for one document's words."""
        total = self.rows[list(map(self.known.__getitem__, words))].sum(0, dtype=np.float64)
        return total[:-1] / max(total[-1], 1) + self.bias

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; words are met in groups of about 200,000."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(letter_words(t) if t and self.languages and has_letter(t) else None)
            size += len(held[-1] or ())
            if size > 200_000:
                out += self._decode(held)
                held, size = [], 0
        return out + self._decode(held)

    def _decode(self, texts: list[list[bytes] | None]) -> list[tuple[str, float, bool]]:
        self._learn(list(set().union(*(t for t in texts if t))))
        return [self.predict(t) for t in texts]

    def predict(self, words: list[bytes] | None) -> tuple[str, float, bool]:
        """The nearest codeword by loss; `und` where there are no words to judge (None)."""
        if words is None:
            return "und", 0.0, False
        loss = np.logaddexp(0, -self.code * self.margins(words)).sum(1)
        odds = np.exp(loss.min() - loss)
        share = odds / odds.sum()
        top = int(loss.argmin())
        rest = np.delete(share, top)
        return self.languages[top], float(share[top]), bool(len(rest) and rest.max() > 0.5 * share[top])


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier per bit, by Adam on all rows; languages weigh alike."""
    target, scale = code[y], 1 / max(float(np.sqrt((x**2).sum(1)).mean()), 1e-9)
    x = x * scale
    weight = (1 / np.bincount(y, minlength=len(code))[y] / len(code))[:, None].astype(np.float32)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    for t in range(1, steps + 1):
        g = x.T @ (-target * weight / (1 + np.exp(np.clip(target * (x @ w), -50, 50)))) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * 0.1
    return w[:-1] * scale, w[-1]


def learn(docs: DataFrame, learnable: Column, per_language: int = 200, dims: int = 4096) -> Model:
    """A model from at most about `per_language` rows of `docs` (`doc_id`, `text`, `lang`) of each language.

    The rows are those whose content hash falls into a share of 1 / (rows / per_language), each once however often it
    repeats; a language with fewer rows gives all of them. Null texts, texts without letters and null languages teach nothing.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, 0)), np.zeros((dims, 0)), np.zeros(0))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // per_language))]), F.col("lang")), F.lit(1))
    picked = usable.where(F.pmod(F.xxhash64("doc_id", "text"), share) == 0).select("doc_id", "text", "lang").dropDuplicates()

    def featurise(batches):
        for batch in batches:
            rows = [(lang, features(text, dims).tobytes()) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in picked.select("lang", "text").mapInArrow(featurise, "lang string, x binary").collect())
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((dims, 0)), np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float32) for _, b in rows])
    code = codebook(len(languages))
    return Model(languages, code, *train(x, np.array([languages.index(lang) for lang, _ in rows]), code))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row and column of `docs` (which must have `text`), and lang_pred string, score double, ambiguous boolean.

    A null text, or one without a letter, is `und` with score 0; so is every text for a model without
    languages. Equal texts get equal results. Columns of `docs` named like an output column, in any case, are replaced;
    names that begin with `__w_` are reserved and such columns dropped.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, "lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]

    at = [c.lower() for c in docs.columns].index("text")

    def predict(batches):
        own = shared.value
        for batch in batches:
            found = own.predict_all(batch.column(at).to_pylist())
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns + cols, names=batch.schema.names + [f.name for f in added])

    return docs.mapInArrow(predict, T.StructType([*docs.schema, *added]))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
