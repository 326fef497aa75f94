import zlib

import numpy as np
import pytest
from data import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from vigilake.llm import op2_packing as op2
from vigilake.llm import op3_token_counts as op3
from vigilake.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "", " ", "It's WE'RE they'll o'clock '' 's", "Große STRAßE, Éç ÿ ½ × ÷ µ", "tab\there\x0bthere\x0c\x1cx\x85y\xa0z", "é à́ ﬁ Ⅷ ٣ 漢字かな 😀👍🏽",
    "a<|endoftext|>b <|startoftext|> <|endoftex", "İstanbul ΣΑΣ ǅ", "x" * 300, "1234 5,000.10", "--- ==> !!! ' \" 's't",
]


@pytest.fixture(scope="module")
def coder():
    return Encoder()


def ids(coder, text):
    return coder.full.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_library_s_ids(coder):
    for text in ODD + [r[1] or "" for r in documents()]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids(coder, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=1, max_codepoint=0x250, exclude_categories=["Cs"]), max_size=60))
def test_encoder_on_any_text(text):
    from vigilake.llm.tokens import encoder

    c = encoder("word_bpe_49k.json")
    assert np.frombuffer(c.encode(text), "<u4").tolist() == ids(c, text)


def test_a_full_memory_changes_nothing(monkeypatch):
    from vigilake.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    c = tokens.Encoder()
    for text in ["one two three", "four five six seven", "one two eight nine ten"] * 2:
        assert np.frombuffer(c.encode(text), "<u4").tolist() == ids(c, text)
    assert len(c.known) <= 5


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (64, 40), (200, 10), (1000, 64)])
def test_chunks_resynchronise(coder, chunk, overlap):
    texts = ["".join(x + " " for x in ODD) * 3, "ab" * 400, "word " * 100 + "y" * 500 + " end it's", "<|endoftext|>" * 30, "é" * 200, " " * 300 + "z"]
    texts += [r[1] or "" for r in documents(30)]
    for text in texts:
        got = op3.chunked_tokens(coder, text, chunk, overlap)
        assert [t[0] for t in got] == ids(coder, text)


def test_counts(spark, coder):
    rows = documents() + [(5000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = sorted((tuple(r) for r in op3.token_counts(frame(spark, rows), chunk=2000).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), n := len(ids(coder, r[1] or "")), n > 2048) for r in rows]
    assert got == sorted(want, key=str)
    assert op3.token_counts(frame(spark, [], 1)).count() == 0


def test_other_vocabularies(spark):
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        c = Encoder(name)
        r = op3.token_counts(frame(spark, [(1, "Hello there, world", None, None, None)], 1), name).first()
        own = c.pieces.encode("Hello there, world") if c.pieces else ids(c, "Hello there, world")
        assert r.n_tokens == len(own)


def test_packing_round_trip(spark, coder):
    rows = documents() + [(5000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    got = op2.pack(frame(spark, rows)).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    by_length = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        by_length.setdefault(r.length, []).append(r.sequence_id)
    assert all(x[-1] - x[0] == len(x) - 1 for x in by_length.values())
    single = {r[0]: r[1] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    for doc_id, text in single.items():
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == ids(coder, text or "") + [1]
        assert {r.doc_tokens for r in mine} == {len(ids(coder, text or "")) + 1}
    again = op2.pack(frame(spark, rows, 3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((tuple(r) for r in again), key=str)
    assert op2.pack(frame(spark, [], 1)).count() == 0
    with pytest.raises(ValueError):
        op2.pack(frame(spark, [], 1), longest=1000)


def test_sequences_are_the_same_in_any_session(spark):
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(str(tuple(r)) for r in op2.pack(frame(spark, documents(40), 3), with_ids=False).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]
