"""License scans by a positional index of rare words, in DataFrame functions only.

Templates are licence phrases and notices. Each is indexed by its highest-IDF words (document counts of
the templates' words over the whole corpus): a posting is (template, place in it). A file's words that are
indexed are looked up; each occurrence and posting vote for where the template would start; templates
with enough votes for one start are kept (so postings intersect by relative position), and at last the
template's mandatory key phrases must stand there word by word.

Scale: two scans, no shuffle of texts. The first counts in how many files each word of the templates
stands (a few hundred rows after map-side aggregation); the second keeps a file's words in one array and works on
it row by row, in time linear in the text and in the votes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NON_WORD, UPPER, table, without


@dataclass(frozen=True)
class Template:
    """A label, the words in their order, the key phrases that must stand, and how many votes of how many rare words."""

    label: str
    text: str
    keys: tuple[str, ...] = field(default=())
    rare: int = 6
    share: float = 0.6

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def key_places(self) -> list[tuple[int, list[str]]]:
        found = []
        for k in self.keys or (self.text,):
            w = k.split()
            found.append((next(i for i in range(len(self.words)) if self.words[i : i + len(w)] == w), w))
        return found


#: Phrases that must be found at every place where their words stand, with their labels (fixed values).
BASE = (
    Template("gpl", "gnu general public license", rare=2, share=1.0),
    Template("apache", "apache license", rare=2, share=1.0),
    Template("cc-by", "cc by", rare=2, share=1.0),
    Template("mit", "mit license", rare=2, share=1.0),
)
#: Further notices, by their own words.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",), rare=3, share=1.0),
)


def ascii_words(text):
    """The words of a text, A-Z lower-cased.

    `lower` is many times faster than `translate`; only U+0130 and U+212A give it new ASCII letters, so texts
    with either take the exact way. In others, it changes no word's bounds and no word of ASCII letters.
    """
    exact = text.contains("İ") | text.contains("K")
    return F.array_remove(F.split(F.when(exact, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text)), NON_WORD), "")


def document_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of `vocabulary` stands; one row per word reaches the driver."""
    own = F.array_distinct(F.filter("__w_words", lambda w: w.isin(vocabulary)))
    counts = words.select(F.explode(own).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counts.collect()}


def index(templates: tuple[Template, ...], counts: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, place) of each template's rarest words; ties by word. A repeated word posts all its places."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, x in enumerate(templates):
        for w in sorted(set(x.words), key=lambda w: (counts.get(w, 0), w))[: x.rare]:
            postings.setdefault(w, []).extend((t, i) for i, y in enumerate(x.words) if y == w)
    return postings


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, base: int = len(BASE)) -> DataFrame:
    """Every row and column of `docs` (which must have `text`), and

    n_words long; license_hits array<struct<label string, base boolean, start int, share double>> in order of
    (place in `templates`, start): the verified templates, the first word each would start at, and the share
    of its rare words that stand there.

    The first `base` templates are found at every place. Null and empty texts have no words and no hits.
    Rows are independent: repeated rows get equal results. Columns named like an output column, in any case, are
    replaced; names that begin with `__w_` are reserved and such columns dropped.
    """
    docs = without(docs, "n_words", "license_hits")
    split = docs.withColumn("__w_words", ascii_words(F.coalesce("text", F.lit(""))))
    vocabulary = sorted({w for t in templates for w in t.words})
    postings = index(templates, document_counts(split, vocabulary))
    rare = [len({w for w in t.words if any(p == i for p, _ in postings.get(w, ()))}) for i, t in enumerate(templates)]
    need = [max(1, -int(-t.share * n // 1)) for t, n in zip(templates, rare, strict=True)]
    # literals of a few hundred entries
    by_word = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in postings[w]]))])
    needs, totals = F.array(*map(F.lit, need)), F.array(*map(F.lit, rare))
    keys = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, w)).alias("w")) for i, w in t.key_places()]) for t in templates])
    labels = F.array(*[F.lit(t.label) for t in templates])

    seen = F.filter(F.transform("__w_words", lambda w, i: F.when(w.isin(sorted(postings)), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    votes = F.array_sort(F.flatten(F.transform("__w_seen", lambda s: F.transform(F.element_at(by_word, s["w"]), lambda p: F.struct(p["t"].alias("t"), (s["i"] - p["i"]).alias("at"))))))
    v = F.col("__w_votes")
    # equal votes stand in a row, so the first of them sees by its place how many there are
    equal = lambda x, i: F.coalesce(F.get(v, i) == x, F.lit(False))
    n_votes = lambda x, i: sum(((F.lit(j) < F.get(totals, x["t"])) & equal(x, i + j)).cast("int") for j in range(max(rare, default=0)))
    stands = lambda x: F.forall(F.get(keys, x["t"]), lambda k: (x["at"] + k["i"] >= 0) & (F.slice("__w_words", F.greatest(x["at"] + k["i"] + 1, F.lit(1)), F.size(k["w"])) == k["w"]))
    hit = lambda x, i: F.struct(F.get(labels, x["t"]).alias("label"), (x["t"] < base).alias("base"), x["at"].alias("start"), F.least(F.lit(1.0), n_votes(x, i) / F.get(totals, x["t"])).alias("share"))
    first = lambda x, i: (i == 0) | (F.get(v, i - 1) != x)
    hits = F.filter(F.transform(v, lambda x, i: F.when(first(x, i) & equal(x, i + F.get(needs, x["t"]) - 1) & stands(x), hit(x, i))), lambda h: h.isNotNull())
    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")
    some = F.size("__w_seen") > 0
    found = split.withColumn("__w_seen", seen).withColumn("__w_votes", F.when(some, votes)).withColumn("license_hits", F.when(some, hits).otherwise(none))
    return found.withColumn("n_words", F.size("__w_words").cast("long")).select(*docs.columns, "n_words", "license_hits")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("license_hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"].cast("long"))
    named = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named("license_hits").alias("labels"),
        F.coalesce(F.array_max(F.transform("license_hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )


def _oracle(templates: tuple[Template, ...] = BASE + NOTICES, base: int = len(BASE)) -> str:
    """The same in DuckDB SQL: each template's rarest words over all documents, votes of words for a start, key phrases that must stand there."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {text(x.label)}, {x.rare}, {x.share}, {text(x.text)})" for t, x in enumerate(templates))
    keys = ", ".join(f"({t}, {i}, {len(w)}, {text(' '.join(w))})" for t, x in enumerate(templates) for i, w in x.key_places())
    return f"""
WITH t(t, label, rare, share, words) AS (VALUES {rows}), k(t, i, n, phrase) AS (VALUES {keys}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT t, unnest(string_split(words, ' ')) AS word, unnest(range(len(string_split(words, ' ')))) AS place FROM t),
x AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d WHERE len(w) > 0),
m AS (SELECT r, word, pos FROM x WHERE word IN (SELECT word FROM p)),
c AS (SELECT word, count(DISTINCT r) AS n FROM m GROUP BY word),
o AS (SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) AS k FROM (SELECT DISTINCT t, word FROM p) LEFT JOIN c USING (word)),
g AS (SELECT t, word FROM o JOIN t USING (t) WHERE k <= rare),
s AS (SELECT t, count(*) AS total, greatest(1, ceil(any_value(share) * count(*))) AS need FROM g JOIN t USING (t) GROUP BY t),
v AS (SELECT r, t, m.pos - p.place AS start, count(*) AS votes FROM m JOIN g USING (word) JOIN p USING (t, word) GROUP BY ALL),
h AS (
  SELECT v.r, v.t, start, least(1.0::DOUBLE, votes::DOUBLE / total) AS share FROM v JOIN s USING (t) JOIN d USING (r) JOIN k USING (t)
  WHERE votes >= need GROUP BY v.r, v.t, start, votes, total
  HAVING bool_and(start + k.i >= 0 AND array_to_string(w[start + k.i + 1 : start + k.i + k.n], ' ') = phrase)),
a AS (
  SELECT r, count(*) FILTER (WHERE t < {base}) AS n_base, min(start) FILTER (WHERE t < {base}) AS first_word, max(start) FILTER (WHERE t < {base}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE t < {base}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(h.share) AS score FROM h JOIN t USING (t) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""


ORACLE = _oracle()
