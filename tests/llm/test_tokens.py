import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapline.llm import bpe_codec, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  conn  to \n b", "\n\n x", "a<|endoftext|>b <|endoftext|> c", " <|endoftext|>", "日本語 日本 　 a", "it's we're  'll", "a" * 3000, "ab" * 900 + " 123456 $$$",
    "\x1c x \x85 y \xa0z ​ q", "🎉🎉 é é", "▁a ▁▁ b▁c", "x   ", "a \nb", "\na", "a\n", "a\nb.\nc,\n\nd", "<s>x</s> <unk>", "same row", "same row", "word " * 20_000,
]


def noise(seed):
    r = random.Random(seed)
    return "".join(r.choice("ab e\n  .,'s<|>é漢🎉0") for _ in range(400))


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + [noise(i) for i in range(30)])] + [(None, "no id", "x")], "event_id long, raw string, decoded string")


def test_codec(spark, events):
    t = Tokenizer.from_file(BYTES)
    got = {r.event_id: r for r in bpe_codec.encode_records(events, BYTES).collect()}
    digests = {r.event_id: r for r in bpe_codec.record_digests(bpe_codec.encode_records(events, BYTES)).collect()}
    assert len(got) == events.count() == len(digests)
    for row in events.collect():
        ids = t.encode(row.raw or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert got[row.event_id].token_ids == ids and got[row.event_id].n_tokens == len(ids) and got[row.event_id].decoded == text
        assert digests[row.event_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[row.event_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_codec.encode_records(events.limit(0), BYTES).count() == 0
    c = bpe_codec.Codec(BYTES)
    for ids in ([50256, 0, 255], [127, 200, 300]):
        assert c.decode(__import__("numpy").array(ids)) == t.decode(ids, skip_special_tokens=False)


def test_trees_agree():
    """One tree at a time and many trees in one array give the same ids."""
    c = bpe_codec.Codec(BYTES)
    words = ["x" * n for n in range(2, 34)] + [noise(i)[:20].replace(" ", "") + "q" for i in range(50)]
    words = [w for w in dict.fromkeys(words) if 2 <= len(w.encode()) <= 33]
    assert c.learn(words) == {w: c.word(w) for w in words}


def test_budget(spark, events):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.event_id: r for r in token_counts.token_budget(events, PIECES, limit=40, keep_prefixes=True).collect()}
    assert len(got) == events.count()
    for row in events.collect():
        text, mine = row.raw or "", got[row.event_id]
        assert (mine.n_tokens, mine.n_bytes) == (len(sp.encode(text)), len(text.encode())), text[:50]
        assert mine.over_limit == (mine.n_tokens > 40)
        if len(text) < 1000:
            want = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
            assert mine.prefix_tokens == want, text[:50]
            assert mine.fit_chars == max(i for i, n in enumerate(want) if n <= 40)
    assert token_counts.token_budget(events.limit(0), PIECES).count() == 0


def test_questions(spark, events):
    kept = token_counts.token_budget(events, PIECES, limit=12, keep_prefixes=True)
    for r in kept.select("fit_chars", "prefix_tokens", token_counts.chars_within(F.col("prefix_tokens"), 12).alias("c"), token_counts.tokens_before(F.col("prefix_tokens"), 1).alias("b")).collect():
        assert r.c == r.fit_chars
        assert r.b == (r.prefix_tokens[1] if len(r.prefix_tokens) > 1 else None)
