import random
import zlib

import numpy as np
import pytest

from snapweave.llm import idstore as s
from snapweave.llm.common import shared_dir
from snapweave.llm.tokens import Encoder

from .conftest import ODD

public = pytest.importorskip("public_tokenizers")


def test_round_trip(spark, docs):
    rnd = random.Random(10)
    rows = [(k, " ".join(rnd.choices(["alpha", "beta", "Gamma", "delta!"], k=rnd.randrange(200)))) for k in rnd.sample(range(1000), 400)] + ODD
    folder = shared_dir(spark)
    manifest = s.write_ids(docs(rows), folder, dictionary_bytes=2048, file_bytes=2000)
    got = sorted(map(tuple, s.read_ids(manifest, folder).collect()), key=lambda r: r[1])
    enc = Encoder(public.path("word_bpe_49k.json"))
    ids = lambda t: enc.whole([t or ""])[0] + np.array([2], "<u4").tobytes()
    assert [r[0] for r in got] == [None, None, *sorted(d for d, _ in rows if d is not None)]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert sorted((r[2], r[3]) for r in got) == sorted((len(ids(t)) // 4, zlib.crc32(ids(t))) for _, t in rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(ids(t))
    assert all(zlib.crc32(texts[r[0]][0]) == r[3] for r in got if r[0] is not None and len(texts[r[0]]) == 1)
    store, path = s._store(folder)
    dictionary = s.read_dictionary(folder)
    assert dictionary
    hit = 0
    for m in manifest.collect():
        r = s.Reader(store, f"{path}/{m.file}", dictionary)
        for doc in texts:
            if doc is not None and (found := r.find(doc)):
                hit += len(found)
                assert all(x.astype("<u4").tobytes() in texts[doc] for x in found)
        with pytest.raises(ValueError):
            s.Reader(store, f"{path}/{m.file}", dictionary + b"x")
    assert hit == len(rows) - 2


def test_empty(spark, docs):
    folder = shared_dir(spark)
    manifest = s.write_ids(docs(ODD).limit(0), folder)
    assert manifest.count() == 0 and s.read_ids(manifest, folder).count() == 0
