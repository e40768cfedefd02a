"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word n-grams as 64-bit hashes. Its sketch in a size band is a row of k words:
every n-gram is XORed into the word its hash selects. A differing n-gram changes one word at most, so the number
of differing words (and likewise the number of differing bits of a 512-bit sketch into which every n-gram flips
one bit) is a lower bound of the symmetric difference. Two sets of sizes a <= b link only if they differ in at
most D = (1-t)/(1+t) (a+b) n-grams; hence at least k-D of their words agree, and if both keep the D+1 words that
are first in one global order, they share one of those (pigeonhole). The order puts words whose every n-gram is
frequent last, and empty words at the very end, so passages and emptiness that many documents share hardly select anything.

Documents with equal sets are one class. Within a bucket (band, word's place, word) every class is first verified
against one centre only, in a few turns with a new centre each; then classes of a bucket that still are in different
components, and only those, are compared with each other. Sizes and 512-bit sketches go before n-grams. So a bucket of
copies costs about as many comparisons as it has classes, and no link between components is lost.

Scale: two scans of the texts; buckets hold two numbers a row and are met in slices; one shuffle of the texts keeps those
of classes that have a candidate. Nothing that grows with the data is collected: the driver gets counts, and at most `hot` frequent n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, bounded_batches, give_back, grouped, hashed_words, mix64, row_key, table, without
from .components import components

U = np.uint64
BITS = 512
SKETCH = tuple(f"s{i}" for i in range(BITS // 64))
SCAN = ", ".join(["kind int, doc_id long, key long, cls long, size int", *(f"{c} long" for c in (*SKETCH, "token", "n"))])
SCAN_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * (len(SKETCH) + 2)]
SCAN_NAMES = [x.split()[0] for x in SCAN.split(", ")]


class Shingler:
    """Texts to sorted arrays of their distinct n-grams' hashes."""

    def __init__(self, n: int):
        self.n = n
        self.factors = mix64(np.arange(1, n + 1, dtype=U)) | U(1)

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n consecutive words."""
        if len(h) < n:
            return np.zeros(0, U)
        total = np.full(len(h) - n + 1, U(n))
        for i in range(n):
            total = total * self.factors[i] + mix64(h[i : len(h) - n + 1 + i] ^ self.factors[i])
        return mix64(total)

    def many(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """The sets of some texts, whose words are hashed together."""
        for _, some in grouped(texts):
            yield from self._some(some)

    def _some(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        words = hashed_words(texts)
        all_, begin = self.grams(words.hashes, self.n), 0
        for count in words.counts.tolist():
            if count >= self.n:
                yield np.unique(all_[begin : begin + count - self.n + 1])
            else:
                yield self.grams(words.hashes[begin : begin + count], count) if count else np.zeros(0, U)
            begin += count


def most_differing(a: int, b: int, num: int, den: int) -> int:
    """The largest symmetric difference of sets of sizes a and b that link (num/den is the threshold)."""
    return (den - num) * (a + b) // (den + num)


class Bands:
    """Size bands by doubling: words of a sketch, and how many of them a size keeps."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def of(self, size: int) -> int:
        return size.bit_length() - 1

    def words(self, band: int) -> int:
        high = (2 << band) - 1
        return 5 * (most_differing(high, high * self.den // self.num, self.num, self.den) + 1) // 4 + 3

    def kept(self, size: int) -> list[tuple[int, int]]:
        """(band, words to keep): the own band, and the one before when smaller partners are there."""
        own, low = self.of(size), self.of(-(-self.num * size // self.den))
        out = [(own, most_differing(size, size * self.den // self.num, self.num, self.den) + 1)]
        if low < own:
            out.append((low, most_differing((2 << low) - 1, size, self.num, self.den) + 1))
        return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits of parity: each n-gram flips one."""
    odd = np.bincount((mix64(tokens ^ U(0x5851F42D4C957F2D)) % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def class_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name, from its size, XOR and sum."""
    with np.errstate(over="ignore"):
        x = mix64(np.bitwise_xor.reduce(tokens, keepdims=True)) ^ mix64(tokens.sum(keepdims=True) + U(len(tokens)))
    return int(mix64(x).view(np.int64)[0])


def buckets(tokens: np.ndarray, band: int, k: int, keep: int, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The keys of the first `keep` of a sketch's k words in the global order."""
    place = (mix64(tokens ^ U(0xD1342543DE82EF95 ^ band)) % U(k)).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, tokens = place[order], tokens[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    word = np.bitwise_xor.reduceat(tokens, first)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
        rank = np.minimum.reduceat(np.where(hot[at] == tokens, level[at], 0), first)
    else:
        rank = np.zeros(len(first), np.int64)
    name = mix64(word + mix64((place[first] + (band << 40)).astype(U)))
    if len(name) >= keep:
        return name[np.lexsort((name, rank))[:keep]]
    empty = np.setdiff1d(np.arange(k), place[first])
    return np.concatenate([name, np.sort(mix64((empty + (band << 40) + (1 << 39)).astype(U)))[: keep - len(name)]])


def _scan(docs: DataFrame, n: int, frequent: int) -> DataFrame:
    """Kind 0: a row per document; kind 1: n-grams that a batch has in at least `frequent` documents."""

    def scan(batches):
        shingle = Shingler(n)
        for batch in batches:
            rows, seen, held, size = [], set(), [], 0

            def tally():
                if held:
                    token, count = np.unique(np.concatenate(held), return_counts=True)
                    often = count >= frequent
                    rows.extend((1, *[None] * (4 + len(SKETCH)), int(t), int(c)) for t, c in zip(token[often].view(np.int64), count[often], strict=True))
                    held.clear()

            for doc, key, tokens in zip(*(batch.column(i).to_pylist() for i in range(2)), shingle.many(batch.column(2).to_pylist()), strict=True):
                if not len(tokens):
                    rows.append((0, doc, key, None, 0, *[None] * (len(SKETCH) + 2)))
                    continue
                cls = class_of(tokens)
                rows.append((0, doc, key, cls, len(tokens), *map(int, sketch(tokens)), None, None))
                if cls not in seen:
                    seen.add(cls)
                    held.append(tokens)
                    size += len(tokens)
                    if size > 1_000_000:
                        tally()
                        size = 0
            tally()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCAN_KINDS, strict=True)], names=SCAN_NAMES) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in SCAN_KINDS], names=SCAN_NAMES)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "key", F.col("text").cast("binary")).mapInArrow(scan, SCAN)


def _bucket_rows(docs: DataFrame, n: int, bands: Bands, hot: np.ndarray, level: np.ndarray) -> DataFrame:
    """(bucket, cls): each class once per task."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, level))

    def emit(batches):
        shingle, seen, (hot, level) = Shingler(n), set(), shared.value
        for batch in batches:
            keys, classes = [], []
            for tokens in shingle.many(batch.column(0).to_pylist()):
                if not len(tokens) or (cls := class_of(tokens)) in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(cls)
                for band, keep in bands.kept(len(tokens)):
                    own = buckets(tokens, band, bands.words(band), keep, hot, level)
                    keys.append(own)
                    classes.append(np.full(len(own), cls, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], names=["bucket", "cls"])
        give_back()

    return docs.select(F.col("text").cast("binary")).mapInArrow(emit, "bucket long, cls long")


class Join:
    """One run of the join: its threshold, its tables."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, hot: int, slices: int):
        self.spark, self.n, self.num, self.den, self.hot, self.slices = docs.sparkSession, n, num, den, hot, slices
        bounded_batches(self.spark)
        self.shelf = Shelf(self.spark)
        self.docs = docs.select(F.col("doc_id"), F.col("text"), row_key("doc_id", "text").alias("key"))

    def scan(self) -> None:
        seen = self.shelf.put(_scan(self.docs, self.n, frequent=8), "scan")
        self.rows = seen.where("kind = 0").select("doc_id", "key", "cls", "size")
        self.classes = self.shelf.put(
            seen.where("kind = 0 AND cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", *SKETCH)]), "classes"
        )
        often = seen.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n"))
        top = sorted((r.token, r.n) for r in often.orderBy(F.desc("n"), "token").limit(self.hot).collect())  # at most `hot` rows
        tokens = np.array([t for t, _ in top], np.int64).view(U)
        order = np.argsort(tokens)
        self.hot_tokens, self.hot_level = tokens[order], np.log2(np.array([c for _, c in top], float)).astype(np.int64)[order] + 1

    def candidates(self) -> None:
        """`members`: rows (bucket, cls) of the buckets with more than one class; `texts`: a text for each of their classes.

        Buckets are met in slices of their hashes one after the other, and so are texts, so what is shuffled at a time is a share of all.
        """
        rows = _bucket_rows(self.docs, self.n, Bands(self.num, self.den), self.hot_tokens, self.hot_level)
        rows = self.shelf.put(rows, "buckets")
        self.members = None
        for j in range(self.slices):
            part = rows.where(F.pmod("bucket", F.lit(self.slices)) == j)
            shared = part.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("bucket")
            shared = self.shelf.put(shared, f"shared{j}")  # a plain table, so that the join can split a hot bucket
            part = self.shelf.put(part.join(shared, "bucket", "left_semi").distinct(), f"members{j}")
            self.shelf.drop(f"shared{j}")
            self.members = part if self.members is None else self.members.unionByName(part)
            self.shelf.settle()
        self.shelf.drop("buckets")
        # merged at every size, so that small tables show what large ones take
        keys = self.shelf.put(self.members.select("cls").distinct().join(self.classes.select("cls", "key"), "cls"), "keys")
        self.texts = None
        for j in range(self.slices):
            part = F.pmod("key", F.lit(self.slices)) == j
            texts = self.docs.where(part).select("key", F.col("text").cast("binary").alias("text")).join(keys.where(part).hint("merge"), "key").dropDuplicates(["cls"])
            texts = self.shelf.put(texts.select("cls", "text"), f"texts{j}")
            self.texts = texts if self.texts is None else self.texts.unionByName(texts)
            self.shelf.settle()

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """`pairs` (a, b) by their n-grams: (a, b, linked)."""
        pairs = self.shelf.put(pairs, f"{name}-pairs")
        needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        texts = self.shelf.put(self.texts.join(needed.hint("merge"), "cls", "left_semi"), f"{name}-texts")
        full = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        n, num, den = self.n, self.num, self.den

        def compare(batches):
            shingle, last, x = Shingler(n), None, None
            for batch in batches:
                out = []
                for a, b, ta, y in zip(*(batch.column(i).to_pylist() for i in range(3)), shingle.many(batch.column(3).to_pylist()), strict=True):
                    if a != last:
                        last, x = a, next(shingle.many([ta]))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((a, b, den * both >= num * (len(x) + len(y) - both)))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "linked"])
            give_back()

        done = self.shelf.put(full.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, linked boolean"), f"{name}-verified")
        self.shelf.drop(f"{name}-texts", f"{name}-pairs")
        self.shelf.settle()
        return done

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs (x, y) as (a, b), a < b, that neither sizes nor sketches exclude."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        for side in "ab":
            own = self.classes.select(F.col("cls").alias(side), F.col("size").cast("long").alias(f"{side}_size"), *[F.col(c).alias(f"{side}_{c}") for c in SKETCH])
            pairs = pairs.join(own, side)
        return pairs.where(self.may_link("a_", "b_")).select("a", "b")

    def may_link(self, x: str, y: str) -> Column:
        """Whether rows with these prefixes of size and sketch columns can link."""
        a, b = F.col(f"{x}size"), F.col(f"{y}size")
        differ = sum((F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in SKETCH), F.lit(0))
        return (F.least(a, b) * self.den >= F.greatest(a, b) * self.num) & (differ * (self.den + self.num) <= (a + b) * (self.den - self.num))

    def label(self, rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """`rows` of buckets that still hold several components, with the component c of each."""
        known = rows.select("bucket", "cls").join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
        known = self.shelf.put(known, f"{name}-labelled")
        several = self.shelf.put(known.groupBy("bucket").agg(F.min("c").alias("lc"), F.max("c").alias("hc")).where("lc <> hc").select("bucket"), f"{name}-several")
        kept = self.shelf.put(known.join(several, "bucket"), f"{name}-open")
        self.shelf.drop(f"{name}-labelled")
        return kept

    def star(self, rows: DataFrame, turn: int) -> DataFrame:
        """Every class of a bucket with the bucket's centre of this turn, where their components differ."""
        centre = self.shelf.put(rows.groupBy("bucket").agg(F.min_by(F.struct("cls", "c"), F.xxhash64("cls", F.lit(turn))).alias("m")), f"centres{turn}")
        return rows.join(centre, "bucket").where(F.col("c") != F.col("m.c")).select(F.col("cls").alias("x"), F.col("m.cls").alias("y"))

    def sketched(self, rows: DataFrame) -> DataFrame:
        """`rows` with the sizes and sketches of their classes."""
        return rows.join(self.classes.select("cls", F.col("size").cast("long").alias("size"), *SKETCH), "cls")

    def residual(self, rows: DataFrame) -> DataFrame:
        """Pairs that share a bucket but no component: those outside a bucket's largest component against all.

        Both sides are plain tables, so that the join splits a hot bucket over tasks; sizes and sketches are compared in the join.
        """
        sizes = rows.groupBy("bucket", "c").count()
        large = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("large"))
        full = self.shelf.put(self.sketched(rows), "residual")
        x = full.join(self.shelf.put(large, "largest"), "bucket").where("c <> large").drop("large")
        x = self.shelf.put(x.select(*[F.col(k).alias(f"x_{k}") for k in x.columns]), "outside")
        joined = x.join(full, (F.col("x_bucket") == F.col("bucket")) & (F.col("x_c") != F.col("c")) & self.may_link("x_", ""))
        return joined.select(F.least("x_cls", "cls").alias("a"), F.greatest("x_cls", "cls").alias("b")).distinct()

    def links(self) -> DataFrame:
        """(a, b) of all classes that link, a < b: every pair that shares a bucket and that sizes and sketches allow is verified."""
        self.scan()
        self.candidates()
        full = self.shelf.put(self.sketched(self.members), "sketched")
        x = full.select(*[F.col(k).alias(f"x_{k}") for k in full.columns])
        pairs = x.join(full, (F.col("x_bucket") == F.col("bucket")) & (F.col("x_cls") < F.col("cls")) & self.may_link("x_", ""))
        return self.verify(pairs.select(F.col("x_cls").alias("a"), F.col("cls").alias("b")).distinct(), "links").where("linked").select("a", "b")

    def run(self, turns: int = 3) -> DataFrame:
        self.scan()
        self.candidates()
        rows = self.members.withColumn("c", F.col("cls"))
        links = labels = None
        for turn in range(turns):
            new = self.verify(self.plausible(self.star(rows, turn)), f"star{turn}").where("linked").select("a", "b")
            links = new if links is None else links.unionByName(new)
            if turn and not new.limit(1).count():
                break
            labels = components(links, self.shelf, f"components{turn}")
            rows = self.label(rows, labels, f"star{turn}")
        rest = self.verify(self.residual(rows), "rest").where("linked").select("a", "b")
        if rest.limit(1).count():
            labels = components(links.unionByName(rest), self.shelf, "components")
        named = self.classes.select("cls", "least").join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
        least = named.groupBy("c").agg(F.min("least").alias("component_id"))
        named = named.join(least, "c").select("cls", "c", "component_id")
        return self.rows.join(named, "cls", "left").select("doc_id", "key", F.col("cls").alias("class_id"), F.col("c").alias("component"), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, hot: int = 20_000, slices: int = 3) -> DataFrame:
    """One row per row of `docs` (`doc_id`, `text`): doc_id, key, class_id, component, n_shingles, component_id.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; a document's set is its distinct n-grams of
    words, with fewer words the whole sequence as one. Two documents link when the Jaccard similarity of their sets is at least
    num/den. Rows with equal sets share class_id, those linked by any path component; component_id is the smallest doc_id reachable by links, itself
    included (null ids are passed over, and a component of none but null ids has null). Without words the set is empty, class_id and component null,
    and the document linked with nothing. key is the hash of (doc_id, text) by which rows are told apart. Sets are compared by 64-bit hashes.
    """
    return Join(docs, n, num, den, hot, slices).run()


def ngram_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, hot: int = 20_000, slices: int = 3) -> tuple[DataFrame, DataFrame]:
    """The links themselves: (class_id, other, both ways) and a row per row of `docs`: doc_id, key, class_id, n_shingles, n_links.

    Links are between classes, the distinct sets, each by a 64-bit hash; copies are told by membership. n_links is the number of other
    classes that a row's class links to (null without words). As many rows come out as there are links, so in a large
    group of texts that are all alike but not equal they grow with its square; `ngram_join` finds components without them.
    """
    join = Join(docs, n, num, den, hot, slices)
    found = join.links()
    both = join.shelf.put(found.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("class_id"), F.col("a").alias("other"))), "both")
    counts = both.groupBy("class_id").agg(F.count("*").alias("n_links"))
    rows = join.rows.select("doc_id", "key", F.col("cls").alias("class_id"), F.col("size").cast("long").alias("n_shingles")).join(counts, "class_id", "left")
    n_links = F.when(F.col("class_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return both, rows.select("doc_id", "key", "class_id", "n_shingles", n_links.alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each component of `docs` the row of the smallest (doc_id, key) only, with all its columns.

    Rows without words stay, all of them; of rows that agree in doc_id and text one stays. A null id comes last. Rows are told
    apart by doc_id and the hash of both. Columns whose names begin with `__w_` are reserved and dropped.
    """
    docs = without(docs)
    found = ngram_join(docs, **options)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("m"))
    kept = least.select(F.col("m.key").alias("__w_key"), F.coalesce("m.doc_id", F.lit(0)).alias("__w_id"))
    keyed = docs.withColumn("__w_key", row_key("doc_id", "text")).withColumn("__w_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    one = keyed.where(~wordless).join(kept, ["__w_key", "__w_id"], "left_semi").dropDuplicates(["__w_key", "__w_id"])
    return one.select(*docs.columns).unionByName(docs.where(wordless))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Documents whose word 3-grams agree to 90 %, as components."""
    return ngram_join(table(spark, sf_dir, "documents"), n=3, num=90).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v) m USING (doc_id)
"""
