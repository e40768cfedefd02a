"""Line dedup by winnowing.

Lines: every line of `line_words` words or more has a hash; the first in the corpus (smallest document, then smallest
place) stays, and later ones go, however short a run of lines they stand in.

Passages, which need not begin or end with a line: a text is read as one line of words however it is broken. Every run
of `k` words has a rolling hash; a passage of k+w-1 words (a window) is told by the leftmost minimum of its `w` hashes,
its fingerprint. Windows in a row that have one fingerprint make a span. Equal windows have equal fingerprints at the
same place, so only windows of fingerprints that stand twice in the corpus may be copies. Of equal spans the first in the
corpus stays, and all windows of the others are copies. Where spans of one fingerprint differ, as at the ends of passages
and at edits, their windows are compared one by one: a match is extended both ways to exactly the windows that
stand earlier, whichever text they stand in, and nothing stitched together from several sources goes.

Scale: lines and spans are joined with one position only, never with all others of their group, so a passage in a third
of the documents costs as many rows as it has occurrences; first positions are pre-aggregated. Fingerprints are
written once and met in `slices` of their hashes one after the other, so what is shuffled at a time is a share of them, and
those that stand once go at the first meeting. Texts are shuffled twice (for differing spans, and for the
deletion), everything else is a few numbers a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, bounded_batches, give_back, grouped, hashed_words, mix64, row_key, table, without, word_counts, word_edges

U = np.uint64
PRINTS = ["h", "s", "doc", "key", "at", "n"]
#: How far apart a text's own repetitions begin at least in the query and the pipeline: the length of a passage.
OWN_FAR = 50
#: From how many words on the query deletes a line that stands earlier as a line.
LINE_WORDS = 8
_BASE = U(0x9E3779B97F4A7C15)


def _powers(n: int, known={}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the base and of its inverse; remembered up to a million."""
    if n > len(known.get("of", ((),))[0]):
        size = max(n, 1 << 14)
        made = tuple(np.cumprod(np.r_[U(1), np.full(size - 1, U(b))]) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)))
        if size > 1 << 20:
            return made[0][:n], made[1][:n]
        known["of"] = made
    return known["of"][0][:n], known["of"][1][:n]


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums modulo 2^64 in which word j weighs BASE^j."""
    return np.r_[U(0), np.cumsum(hashes * _powers(len(hashes))[0])]


def rolling(hashes: np.ndarray, k: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every run of k words, from prefix sums modulo 2^64."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    prefix = _sums(hashes) if prefix is None else prefix
    return mix64((prefix[k:] - prefix[:-k]) * _powers(n)[1][: n - k + 1])


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every w consecutive values, by doubling."""
    pick, size = (np.minimum if least else np.maximum), 1
    while 2 * size <= w:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


#: Words that are hashed at a time; a place among them takes 20 bits.
CHUNK = 1 << 20


def _least(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every w consecutive hashes the place of the leftmost minimum of their upper 44 bits (at most CHUNK hashes)."""
    low = U(CHUNK - 1)
    return (_sliding((hashes & ~low) | np.arange(len(hashes), dtype=U), w, True) & low).astype(np.int64)


def spans(hashes: np.ndarray, k: int, w: int, starts: np.ndarray | None = None, prefix: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(fingerprint, hash of the span, first window, windows after it) of every span of the texts that begin at `starts` of one row of words."""
    need, n, none = k + w - 1, len(hashes), np.zeros(0, np.int64)
    if n < need:
        return np.zeros(0, U), np.zeros(0, U), none, none
    prefix = _sums(hashes) if prefix is None else prefix
    starts = np.zeros(1, np.int64) if starts is None else starts
    h = rolling(hashes, k, prefix)
    own = _least(h, w)
    ends = np.r_[starts[1:], n]
    whole = ends - starts >= need
    # the first window of a text begins a span; windows that reach into the next text are none
    opens, fits = np.zeros(len(own), bool), np.zeros(len(own) + 1, np.int32)
    opens[starts[whole]] = True
    np.add.at(fits, starts[whole], 1)
    np.add.at(fits, ends[whole] - need + 1, -1)
    fits = np.cumsum(fits[:-1]) > 0
    opens[1:] |= own[1:] != own[:-1]
    first = np.flatnonzero(opens & fits)
    last = np.flatnonzero(np.r_[opens[1:] | ~fits[1:], True] & fits)
    at = own[first]
    content = mix64((prefix[last + need] - prefix[first]) * _powers(n)[1][first])
    shape = (last - first).astype(U) * U(w) + (at - first).astype(U)
    return h[at], mix64(content + mix64(shape + U(1))), first, last - first


def line_hashes(starts: np.ndarray, counts: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """A hash of every run of `counts` words from `starts` on, apart from those of spans."""
    return mix64(mix64((prefix[starts + counts] - prefix[starts]) * _powers(len(prefix) - 1)[1][starts]) + mix64(counts.astype(U) + (U(1) << U(40))))


def parts(counts: np.ndarray, need: int):
    """(first word, word after the last, done) of parts of at most CHUNK words that together hold every window of texts of these word counts.

    A part is some whole texts, or a piece of a longer one that shares need-1 words with the next; done says up to where
    the part before has read the same text.
    """
    ends = np.cumsum(counts)
    low = k = 0
    while k < len(counts):
        if counts[k] > CHUNK:
            at = done = low
            while True:
                yield at, min(at + CHUNK, int(ends[k])), done
                if at + CHUNK >= ends[k]:
                    break
                done, at = at + CHUNK, at + CHUNK - need + 1
            low, k = int(ends[k]), k + 1
            continue
        long = counts[k:] > CHUNK
        upto = k + (int(long.argmax()) if long.any() else len(long))
        last = min(upto, max(k + 1, int(np.searchsorted(ends, low + CHUNK, side="right"))))
        if ends[last - 1] > low:
            yield low, int(ends[last - 1]), low
        low, k = int(ends[last - 1]), last


def prints_of(texts: list[bytes | None], k: int, w: int, line_words: int | None) -> tuple[np.ndarray, ...]:
    """(fingerprint, hash of the whole, number of the text, first word, words) of all spans and of all lines shorter than one."""
    groups = [_prints(some, k, w, line_words, low) for low, some in grouped(texts)]
    return tuple(np.concatenate(x) for x in zip(*groups, strict=True))


def _prints(texts: list[bytes | None], k: int, w: int, line_words: int | None, number: int) -> tuple[np.ndarray, ...]:
    """The same of texts whose words are hashed together, the first of which has this number."""
    need, all_, out = k + w - 1, hashed_words(texts), []
    begins = np.cumsum(all_.counts) - all_.counts
    line_ends = all_.line_starts + all_.line_counts
    for a, b, done in parts(all_.counts, need):
        h = all_.hashes[a:b]
        prefix = _sums(h)
        inside = np.unique(np.clip(begins[np.searchsorted(begins, a, side="left") : np.searchsorted(begins, b, side="left")], a, b) - a)
        f, s, first, more = spans(h, k, w, inside if len(inside) and not inside[0] else np.r_[0, inside], prefix)
        out.append((f, s, first + a, more + need))
        if line_words is not None:
            low, high = np.searchsorted(line_ends, (done, b), side="right")
            start, count = all_.line_starts[low:high], all_.line_counts[low:high]
            keep = (start >= a) & (count >= max(1, line_words)) & (count < need)
            own = line_hashes(start[keep] - a, count[keep], prefix)
            out.append((own, own, start[keep], count[keep]))
    if not out:
        return np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3
    f, s, first, n = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(begins, first, side="right") - 1
    return f, s, text + number, first - begins[text], n


def fingerprints(docs: DataFrame, k: int, w: int, line_words: int | None) -> DataFrame:
    """(h, s, doc, key, at, n) of every span and of every line shorter than one: fingerprint, hash of the whole, first word, words."""

    def scan(batches):
        for batch in batches:
            f, s, text, first, n = prints_of(batch.column(2).to_pylist(), k, w, line_words)
            cols = [f.view(np.int64), s.view(np.int64), *(batch.column(i).to_numpy()[text] for i in range(2)), first.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=PRINTS)
        give_back()

    return docs.select("__w_doc", "__w_key", F.col("text").cast("binary")).mapInArrow(scan, "h long, s long, doc long, key long, at int, n int")


def _windows(docs: DataFrame, asked: DataFrame, k: int, w: int) -> DataFrame:
    """(g, doc, key, at) of every window of the asked (doc, key, at, n): the hash of its words."""
    own = asked.groupBy("doc", "key").agg(F.collect_set(F.struct("at", "n")).alias("places"))  # bounded by the document's words
    full = docs.select(F.col("__w_doc").alias("doc"), F.col("__w_key").alias("key"), F.col("text").cast("binary").alias("text")).join(own, ["doc", "key"]).dropDuplicates(["doc", "key"])
    need = k + w - 1

    def cut(batches):
        for batch in batches:
            places, out = batch.column(3).to_pylist(), []
            for low, texts in grouped(batch.column(2).to_pylist()):
                words, begin = hashed_words(texts), 0
                for n, own in zip(words.counts.tolist(), places[low : low + len(texts)], strict=True):
                    g = rolling(words.hashes[begin : begin + n], need)
                    at = np.concatenate([np.arange(p["at"], p["at"] + p["n"] - need + 1, dtype=np.int32) for p in own])
                    out.append((g[at].view(np.int64), at))
                    begin += n
            text = np.repeat(np.arange(len(out)), [len(x[1]) for x in out])
            cols = [np.concatenate([x[0] for x in out]), *(batch.column(i).to_numpy()[text] for i in range(2)), np.concatenate([x[1] for x in out])] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["g", "doc", "key", "at"])
        give_back()

    return full.select("doc", "key", "text", "places").mapInArrow(cut, "g long, doc long, key long, at int")


def regions(docs: DataFrame, shelf: Shelf, k: int, w: int, far: int, line_words: int | None, slices: int) -> DataFrame:
    """Per document with copied words: doc, key and parts, structs (a, b) of the words to delete, b exclusive."""
    need, copied = k + w - 1, None
    prints = shelf.put(fingerprints(docs, k, w, line_words), "prints")
    for j in range(slices):
        part = prints.where(F.pmod("h", F.lit(slices)) == j)
        # what is joined to is a plain table, so that the join can split a hot fingerprint
        again = shelf.put(part.groupBy("h").count().where("count > 1").select("h"), f"again{j}")
        part = shelf.put(part.join(again, "h", "left_semi"), f"copied{j}")
        copied = part if copied is None else copied.unionByName(part)
        shelf.settle()
    shelf.drop("prints")
    low = F.min(F.struct("doc", "key", "at")).alias("low")
    # a text's own window counts as copied from `far` words after its source on; a line any time later
    same = (F.col("doc") == F.col("low.doc")) & (F.col("key") == F.col("low.key"))
    apart = ~same | (F.col("at") >= F.col("low.at") + far)
    first = shelf.put(copied.groupBy("h", "s").agg(low), "first")
    whole = F.when(F.col("n") < need, ~same | (F.col("at") > F.col("low.at"))).otherwise(apart)
    known = shelf.put(copied.join(first, ["h", "s"]).select("h", "doc", "key", "at", "n", whole.alias("whole")), "known")
    several = shelf.put(first.groupBy("h").count().where("count > 1").select("h"), "several")
    asked = shelf.put(known.where("NOT whole").join(several, "h", "left_semi").select("doc", "key", "at", "n"), "asked")
    shelf.drop("first", "several", *[f"{t}{j}" for j in range(slices) for t in ("copied", "again")])
    shelf.settle()
    windows = shelf.put(_windows(docs, asked, k, w), "windows")
    shelf.settle()
    twice = shelf.put(windows.groupBy("g").agg(low, F.count("*").alias("times")).where("times > 1").drop("times"), "twice")
    single = windows.join(twice, "g").where(apart).select("doc", "key", F.col("at").alias("a"), (F.col("at") + need).alias("b"))
    found = known.where("whole").select("doc", "key", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")).unionByName(single)
    found = shelf.put(found.groupBy("doc", "key").agg(F.collect_set(F.struct("a", "b")).alias("parts")), "regions")  # bounded by the document's words
    shelf.drop("known", "asked", "windows", "twice")
    shelf.settle()
    return found


def merged(parts: list) -> list[tuple[int, int]]:
    """The ranges of words to delete, in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((p["a"], p["b"]) for p in parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without these words; what stood around a deleted range is joined by one line break or blank."""
    edges = word_edges(text)
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at : edges[2 * a]])
        at = int(edges[2 * b - 1])
    out.append(text[at:])
    kept = [out[0]]
    for x in out[1:]:
        gap = kept[-1][len(kept[-1].rstrip()) :] + x[: len(x) - len(x.lstrip())]
        kept[-1] = kept[-1].rstrip()
        x = x.lstrip()
        if any(kept) and x:
            kept.append(b"\n" if b"\n" in gap else b" ")
        kept.append(x)
    return b"".join(kept), sum(b - a for a, b in ranges)


def dedup_lines(docs: DataFrame, k: int = 26, w: int = 25, far: int | None = None, line_words: int | None = None, slices: int = 2) -> DataFrame:
    """Every row and column of `docs` (`doc_id`, `text`), text without passages of k+w-1 words or more that stand earlier and
    without lines of `line_words` words or more that stand earlier as lines (none unless given), and

    n_words long (of the text as it was), n_deleted long.

    Earlier is in a document of smaller (doc_id, hash of the row), or before it in the same text, for passages begun at least
    `far` words before (2*(k+w) unless given; from k+w-1 on the two can't overlap); a null id comes last. Lines end at
    line breaks and are compared word by word, A-Z lower-cased.
    Rows with equal id and text are one document: they keep the same text. A text copied whole becomes empty. A
    null text stays null. Columns of `docs` named like an output column, in any case, are replaced; names that begin
    with `__w_` are reserved and such columns dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, "n_words", "n_deleted")
    names, kinds = docs.columns, docs.schema
    at = [n.lower() for n in names].index("text")
    keyed = docs.withColumn("__w_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__w_key", row_key("doc_id", "text"))
    parts = regions(keyed, Shelf(spark), k, w, 2 * (k + w) if far is None else far, line_words, slices)
    parts = parts.select(F.col("doc").alias("__w_doc"), F.col("key").alias("__w_key"), F.col("parts").alias("__w_parts"))
    full = keyed.join(parts, ["__w_doc", "__w_key"], "left").select(*[keyed[n] for n in names], "__w_parts")

    def delete(batches):
        for batch in batches:
            texts, gone = batch.column(at).cast(pa.binary()).to_pylist(), [0] * len(batch)
            total = word_counts(texts)
            for i, own in enumerate(batch.column(len(names)).to_pylist()):
                if own:
                    texts[i], gone[i] = cut_words(texts[i], merged(own))
            new = pa.array(texts, pa.binary()).cast(pa.string()) if any(gone) else batch.column(at)
            cols = [new if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(gone, pa.int64())], names=[*names, "n_words", "n_deleted"])
        give_back()

    return full.mapInArrow(delete, T.StructType([*kinds, T.StructField("n_words", T.LongType()), T.StructField("n_deleted", T.LongType())]))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines of eight words or more, and the passages of 50 words or more, that stand earlier."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), far=OWN_FAR, line_words=LINE_WORDS)
    return found.select("doc_id", "n_words", "n_deleted", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
