import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from basalt.llm import bpe, vocab  # noqa: E402

PATH = f"{vocab.tokenizer_dir()}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def pair():
    return bpe.ByteBPE(PATH), tiktoken.Encoding("own", pat_str=vocab.BYTE_PATTERN, mergeable_ranks=vocab.byte_ranks(PATH), special_tokens={})


def check(pair, texts):
    mine, theirs = pair
    offsets, ids = mine.encode_batch(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == (theirs.encode_ordinary(t) if t else []), t


def test_words(pair):
    r = random.Random(1)
    check(pair, ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABC012 ") for _ in range(r.randint(1, 40))) for _ in range(3000)])


def test_blanks_and_scripts(pair):
    r = random.Random(2)
    parts = ["a", "Bc", "  ", " ", "\n", "\t", " ", "'s", "'LL", "12", ".,", "\x1c", "é", "é", "\r\n", "中文", "😀", "👩‍💻", "<|endoftext|>", "﻿", "​"]
    check(pair, ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(3000)] + [None, ""])


def test_long_words(pair):
    check(pair, ["a" * 3000, "ab" * 2000, "é" * 900, "x" * 199 + "y", "=" * 5000, " " * 4000, "word " * 20000])


def test_speculation_is_verified(pair):
    mine, _ = pair
    assert mine.exact_words > 0
    assert mine.compatible(*map(lambda x: __import__("numpy").array(x), ([mine.ranks[b"a"]], [mine.ranks[b"b"]])))[0] == (b"ab" not in mine.ranks)


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "text", ["doc_id"], PATH).collect()}
    assert got == {1: [31373, 995], 2: [], 3: []}
    assert [r.n_tokens for r in bpe.encode(df, "text", ["doc_id"], PATH, as_count=True).orderBy("doc_id").collect()] == [2, 0, 0, 0]
    assert bpe.encode(df.limit(0), "text", ["doc_id"], PATH).count() == 0


def test_chunks_of_long_runs_of_blanks():
    import time

    text = "a" + " " * 2_000_000 + "b  c\n d"
    began = time.time()
    cut = bpe.ByteBPE.chunks(text)
    assert "".join(cut) == text and time.time() - began < 5
    assert bpe.ByteBPE.chunks("ab  c\n d e") == ["ab", "  c\n d", " e"] and bpe.ByteBPE.chunks(" ") == [" "] and bpe.ByteBPE.chunks("") == [""]
