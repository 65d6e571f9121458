import zlib

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm.packing import pack_documents, piece_lengths
from graphloom.llm.sentencepiece_codec import LONG_WORD, chunk_table, encode_documents

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a \n", "tab\tand\r\nline", "x\x1cy z", "no\xa0break", "　wide  space",
    "▁marker ▁▁two", "don't we'll  they'RE 12345 6,789.00", "<|endoftext|> </s> <s> <unk>", "a<|endoftext|>", "one <|endoftext|>two  <|endoftext|>", "<|endoftext", "<|endoftext|>", "ﬁ① \U0001f600\U0001f469‍\U0001f469", "\x00nul\x00 b",
    "word " * 3000, "nospace" * 2000, "é ́a", "   lead", "trail   ", "...  !!! ???", "日本語 テキスト", "word—,x y…! z²,3 naïve's ñ'll 12's a_b ab--cd 'tis i'm\u0301", "a\u0085b c",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()
    return ODD + [r.text for r in rows]


def test_sentencepiece_equals_the_library(docs_of, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in encode_documents(docs_of([*enumerate(texts), (10_000, None), (None, "x")]), path).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (10_000, "")]:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, t
        assert got[i].decoded == sp.decode(ids), t


@pytest.mark.parametrize("table_words", [30, 100_000])
def test_sentencepiece_with_a_small_and_a_large_table(docs_of, texts, table_words):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = docs_of([*enumerate(texts), *enumerate(texts, 1000)]).repartition(3)
    known = chunk_table(docs.select("doc_id", "text"), path, 2000, table_words).collect()
    assert 0 < len(known) <= table_words and len({r.word for r in known}) == len(known) and all(len(r.word) <= LONG_WORD for r in known)
    assert table_words == 30 or len(known) > 300
    want = [sp.encode(t, add_bos=True, add_eos=True) for t in texts]
    got = encode_documents(docs, path, stretch_bytes=2000, table_words=table_words).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = want[r.doc_id % 1000]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids)


def test_packing_equals_the_tokenizer(docs_of, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = pack_documents(docs_of([*enumerate(texts), (10_000, None), (None, "x")]), path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for i, t in [*enumerate(texts), (10_000, "")]:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(r.ids for r in mine) == np.array(ids, "<u4").tobytes(), t
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.doc_tokens == len(ids) for r in mine)
        assert zlib.crc32(b"".join(r.ids for r in mine)) == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_piece_lengths():
    assert piece_lengths(0, 8) == [] and piece_lengths(1, 8) == [1] and piece_lengths(8, 8) == [8] and piece_lengths(23, 8) == [8, 8, 4, 2, 1]
    with pytest.raises(ValueError):
        pack_documents(None, "", max_length=1000)


def test_empty_tables(docs_of):
    assert encode_documents(docs_of([]), public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    assert pack_documents(docs_of([]), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
