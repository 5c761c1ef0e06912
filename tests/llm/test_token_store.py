import uuid
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapline.llm import token_store
from tapline.llm.token_store import WaveletMatrix
from tapline.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("size,letters", [(0, 1), (1, 1), (5, 1), (513, 2), (3000, 40), (5000, 50_000)])
def test_matrix(size, letters):
    ids = np.random.default_rng(size).integers(0, letters, size).astype("<u4")
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
    assert m.ids().tolist() == ids.tolist()
    for i in range(0, size, max(1, size // 50)):
        assert m.access(i) == ids[i]
        assert m.count(int(ids[i]), size // 3, size) == int((ids[size // 3 :] == ids[i]).sum())
        where = np.flatnonzero(ids == ids[i])
        assert m.select(int(ids[i]), len(where) - 1) == where[-1]
        assert m.occurrences(int(ids[i]))[:3] == where[:3].tolist()
    assert m.count(60_000) == 0
    with pytest.raises(ValueError):
        m.select(60_000, 0)


def test_shards(spark):
    texts = [None, "", "Conn  to\n10.0.0.1 <|endoftext|> x", "ä" * 300, "a b " * 20_000, "same", "same"]
    rows = [(i * 7 % 5 - 1 if i < 5 else 9, t, "clash") for i, t in enumerate(texts)] + [(100 + i, f"event {i} closed", "c") for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, raw string, start string")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_store.write_token_shards(events.repartition(3), PATH, folder, end_id=2, shard_tokens=300)
    got = token_store.read_token_shards(spark, folder).orderBy("event_id", "start").collect()
    t, start = Tokenizer.from_file(PATH), 0
    assert len(got) == len(rows)
    for row, (event_id, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.event_id, row.start, row.n_tokens) == (event_id, start, len(ids))
        assert zlib.crc32(bytes(row.ids)) == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_empty(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_store.write_token_shards(spark.createDataFrame([], "event_id long, raw string"), PATH, folder, end_id=2)
    assert token_store.read_token_shards(spark, folder).agg(F.count("*")).first()[0] == 0
