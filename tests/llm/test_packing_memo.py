import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import packing


def test_a_full_memo_keeps_frequent_units(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_UNITS", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = packing.UnitEncoder(path), Tokenizer.from_file(path)
    for k in range(12):
        texts = [f"the cat and the dog saw the naïve word{k}x{j} here, too" for j in range(6)]
        assert [e.tolist() for e in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(enc.memo) <= 20 + 15
    enc.trim()
    assert " the" in enc.memo and len(enc.memo) <= 10
