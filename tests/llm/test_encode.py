from __future__ import annotations

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomoframe.llm import tokenizers
from tomoframe.llm.chunks import chunk_starts
from tomoframe.llm.encode import _Joiner, encoded

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokenizers.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary")
WORDS = ["the", "pump", " makes", "\n", "\n\n", "  ", "\t", "\r\n", "noise", "'s", "don't", "123", "4567", "...", "ポンプ", "から変な音がします。", "Зал", "é", "👍🏽", " ", "　", "<|endoftext|>", "x" * 40, "===", " "]


def texts(seed, n):
    rng = random.Random(seed)
    shared = " ".join(rng.choice(WORDS) for _ in range(60))
    out = ["", None, " ", "\n", "a", "日" * 700, "x" * 3000, shared, shared]
    out += ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(200))) + (shared if rng.random() < 0.4 else "") for _ in range(n)]
    return out


@pytest.mark.parametrize("mean, most", [(128, 8192), (16, 24), (6, 5)])
def test_equals_the_tokenizer_on_whole_texts(spark, mean, most):
    docs = [(i if i != 5 else None, t, "clash", i) for i, t in enumerate(texts(mean, 60))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, ids string, seq int").repartition(3)
    encode = tokenizers.byte_bpe()[0].encode_ordinary
    want = sorted(((d[0] is None, d[0] or 0), encode(d[1] or "")) for d in docs)
    got = sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids)) for r in encoded(df, mean=mean, most=most).collect())
    assert got == want


def test_empty_table(spark):
    assert encoded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_passages_are_cut_alike():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400))

    def chunks(text):
        data = np.frombuffer(text.encode(), np.uint8)
        starts = chunk_starts(data, np.array([0, len(data)]), 64, 1 << 20)
        return [bytes(data[a:b]) for a, b in zip(starts, np.append(starts[1:], len(data)))]

    a, b = chunks("one two three " + passage), chunks("something else " * 20 + passage)
    assert b"".join(a).decode() == "one two three " + passage
    assert len(set(a) & set(b)) >= len(a) - 2 and len(a) > 15


def test_long_pieces_are_cut_between_characters():
    data = np.frombuffer(("日本" * 50).encode(), np.uint8)
    starts = chunk_starts(data, np.array([0, 0, len(data)]), 64, 10)
    assert starts[0] == 0 and np.diff(starts).max() <= 12
    for a, b in zip(starts, np.append(starts[1:], len(data))):
        bytes(data[a:b]).decode()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=8)), max_size=40), st.sampled_from([(6, 5), (6, 12), (12, 40), (64, 4000)]))
def test_any_text_is_repaired_to_the_whole_encoding(pieces, sizes):
    text = "".join(pieces).encode("utf-8", "ignore").decode()
    data = np.frombuffer(text.encode(), np.uint8)
    joiner = _Joiner("byte_bpe_50k", tokenizers.FOLDER)
    starts = chunk_starts(data, np.array([0, len(data)]), *sizes)
    chunks = [bytes(data[a:b]).decode() for a, b in zip(starts, np.append(starts[1:], len(data)))]
    assert "".join(chunks) == text
    assert joiner.joined([np.array(joiner.encode(c), np.int32) for c in chunks]).tolist() == joiner.encode(text)


@pytest.mark.parametrize("chunks", [["x'", "l", "l b"], ["aa", "'l", "l b"], ["a ", "\n", "\nb", "c"], ["日", "本", "語", "。x", "y"], ["1", "2", "3", "4"], ["\U0003d000'", "s"], ["\u1c89'", "s"], ["\u0378", "a'", "s"]])
def test_short_chunks(chunks):
    joiner = _Joiner("byte_bpe_50k", tokenizers.FOLDER)
    assert joiner.joined([np.array(joiner.encode(c), np.int32) for c in chunks]).tolist() == joiner.encode("".join(chunks))


@pytest.mark.parametrize("unit", ["acgtgcta", "日本語文章", "ab12", "x y" + "z" * 3000])
def test_unbroken_texts_take_linear_time(unit):
    import time

    joiner = _Joiner("byte_bpe_50k", tokenizers.FOLDER)

    def took(size):
        rng = random.Random(size)
        text = "".join(rng.choice(unit) for _ in range(size)) if len(unit) < 100 else unit * (size // len(unit))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = chunk_starts(data, np.array([0, len(data)]), 128, 8192)
        pieces = [np.array(joiner.encode(bytes(data[a:b]).decode()), np.int32) for a, b in zip(starts, np.append(starts[1:], len(data)))]
        began = time.process_time()
        got = joiner.joined(pieces)
        spent = time.process_time() - began
        assert got.tolist() == joiner.encode(text)
        return spent

    small, large = took(200_000), took(1_600_000)
    assert large < 8 * 2.5 * max(small, 0.02)
