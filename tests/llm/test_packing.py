import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from snapweave.llm import packing as p
from snapweave.llm.common import Shelf
from snapweave.llm.tokens import Encoder

from .conftest import ODD

public = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_library_s_ids(name):
    rnd = random.Random(7)
    letters = [*"ab1Z 'é.\n,|ßİ%—́5²½K \t-<>", "'s", "'ll", "<|endoftext|>", "  ", "...", "the "]
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(1, 40))) for _ in range(3000)]
    texts += [" ".join("".join(rnd.choices("abé1'.,|é’́", k=rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    enc = Encoder(public.path(name), limit=500)
    assert [enc.encode(t) for t in texts] == enc.whole(texts)
    assert enc.encode(None) == enc.encode("") == b""


def best_fit_one_by_one(counts, capacity):
    """Best fit by decreasing length, a piece at a time."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, g in enumerate(gaps) if g >= length]
            if fit:
                gaps[min(fit, key=lambda i: gaps[i])] -= length
            else:
                gaps.append(capacity - length)
    return len(gaps)


def packed(spark, lengths, capacity):
    """The sequences' lengths by the operator's rounds."""
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length int").repartition(3)
    got = p.place(items, capacity, Shelf(spark)).collect()
    assert sorted(r.item for r in got) == list(range(len(lengths)))
    used = defaultdict(list)
    for r in got:
        used[r.bin].append(lengths[r.item])
    assert all(sum(x) <= capacity for x in used.values())
    return used


def test_rounds_pack_as_one_by_one_best_fit(spark):
    rnd = random.Random(8)
    for lengths in (
        [rnd.randrange(1, 1024) for _ in range(1500)],
        [rnd.choice([300, 300, 300, 40, 700]) for _ in range(1500)],
        [rnd.randrange(1, 60) for _ in range(3000)],
        [600] * 200 + [7] * 3000,
        [1023, 1, 512, 512, 511, 513, 256, 256, 256, 256, 128],
    ):
        assert len(packed(spark, lengths, 1024)) == best_fit_one_by_one(Counter(lengths), 1024)
    assert not packed(spark, [], 1024) and len(packed(spark, [1, 1, 1], 2)) == 2


def test_rounds_over_many_ranges(spark):
    rnd = random.Random(9)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for lengths in ([rnd.randrange(1, 1024) for _ in range(2000)], [900] * 100 + [rnd.randrange(1, 100) for _ in range(1500)]):
            assert len(packed(spark, lengths, 1024)) <= best_fit_one_by_one(Counter(lengths), 1024) * 1.01 + 2
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_matches_are_resolved_by_rank():
    counts = [(p.LEFT, 0, 500, 2), (p.LEFT, 0, 400, 1), (p.UNPLACED, 1, 200, 4), (p.UNPLACED, 1, 150, 1), (p.LEFT, 1, 180, 1), (p.UNPLACED, 2, 90, 9), (p.UNPLACED, 3, 10, 5)]
    matches, opening = p.resolve(counts)
    assert matches == [(1, 0, 2, 0, 400, 0, 2), (1, 2, 3, 0, 500, 0, 2), (2, 0, 2, 1, 180, 0, 2)] and opening == {3}


def test_pieces_tile_documents_and_sequences(docs):
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "gamma", "Zürich"], k=rnd.choice([0, 1, 30, 200, 1500])))) for k in range(80)] + ODD
    got = p.pack(docs(rows), keep_ids=True).collect()
    enc, want = Encoder(public.path("byte_bpe_50k.json")), defaultdict(list)
    for doc, text in rows:
        want[doc].append(enc.whole([text or ""])[0] + np.array([2], "<u4").tobytes())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 1 <= r.length <= 1024
        by_doc[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, texts in want.items():
        assert sum(len(x[3]) for x in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            own = sorted(by_doc[doc])
            assert [x[0] for x in own] == list(range(len(own))) and b"".join(x[3] for x in own) == texts[0]
            assert [x[1] for x in own] == [sum(y[2] for y in own[:k]) for k in range(len(own))] and all(x[2] == 1024 for x in own[1:])
    for own in by_seq.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 1024) * 1.05 + 1
    assert p.pack(docs(ODD).limit(0)).count() == 0
