import random

import pytest

import twinspan.llm.tokens as tokens
from twinspan.work import Workspace

PIECES = ["a", "b", "re", "'", "r", "e", "'ll", "  ", " ", "\n", "1", "é", "\u00a0", "!", "<|endoftext|>", "word ", "\t", "中", "\u200b", "🚀"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.VOCABULARY)


@pytest.mark.parametrize("mask,least,most", [(3, 1, 50), (1, 1, 5), (7, 2, 9), (255, 32, 4096)])
def test_joins_are_exact(encoder, monkeypatch, mask, least, most):
    monkeypatch.setattr(tokens, "MASK", mask)
    monkeypatch.setattr(tokens, "LEAST", least)
    monkeypatch.setattr(tokens, "MOST", most)
    rng = random.Random(mask)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 90 if mask < 100 else 900))) for _ in range(600)]
    chunked = 0
    for text, parts in zip(texts, tokens.cut(texts), strict=True):
        assert "".join(a + (b or "") for a, b in parts) == text
        assert [i for a, b in parts for i in encoder.join(a) + encoder.encode(b or "")] == encoder.bpe.encode_ordinary(text)
        assert tokens.cut([text]) == [parts] and encoder.count(text) == len(encoder.bpe.encode_ordinary(text))
        chunked += sum(b is not None for _, b in parts) > 1
    assert chunked > 100


def test_every_character_beside_a_sure_boundary(encoder):
    for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)]):
        for text in ("ab" + c + " cd", "x" + c + "\n" + c, c + "中。" + c, " " + c + "\u3000" + c + "あ、'll"):
            codes = tokens.np.frombuffer(text.encode("utf-32-le"), dtype=tokens.np.uint32)
            for p in tokens._sure(codes).tolist():
                assert encoder.encode(text[:p]) + encoder.encode(text[p:]) == encoder.encode(text), (text, p)


def test_cuts_follow_content():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ,.") for _ in range(20000))
    a, b = tokens.cut([shared + " tail", "some head " + shared])
    assert len({x for _, x in a} & {x for _, x in b}) > 10
    once = sum(len(x) for x in {x for _, x in a + b if x})
    assert once < 1.2 * len(shared)


def test_table(spark, encoder):
    long = "x" * 60_000 + " " + "ab " * 20_000
    rows = [(1, "hello world", "k"), (2, None, "k"), (3, "", "k"), (4, "hello world", "k"), (4, "again", "k"), (None, "no id", "k"), (5, long, "k"), (6, "\n \t", "k"), (7, "中文没有空格。" * 3000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = tokens.encoded(df, "doc_id", "text", Workspace(spark, "t")).collect()
    want = sorted((i or 0, encoder.bpe.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == want
    assert tokens.encoded(df.limit(0), "doc_id", "text", Workspace(spark, "t")).count() == 0
