import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import tokens
from quernstone.llm.tokens import encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equal_to_whole_texts(name):
    e = encoder(name)

    @settings(max_examples=600, deadline=None)
    @given(st.text(st.sampled_from(list("aBtsll're   \n\n.,!9é́ÉßİÿÀ×\t \x1c|<>-²Σ")), max_size=40))
    def same(text):
        assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids

    same()
    for text in (None, "", "<|endoftext|> it's  <|startoftext|>", "\n\n  The. \n\tx", "a" * 5000):
        assert e.encode([text])[0].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_corpus_rows_equal():
    pq = pytest.importorskip("pyarrow.parquet")
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(name)
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert np.array_equal(ids, e.tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_small_blocks_and_few_slots(name, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 7)
    monkeypatch.setattr(tokens, "_SLOT_BITS", 3)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 9)
    e = tokens.Encoder(name)
    words = ["it", "'s", "É", "seventeen-letters", "abcdefghijklmnop", "abcdefghijklmnopq", "a" * 40, "é,", "×", "ñ÷", "3rd!", "中文", "\n", "\n\n", " ", "  ", "“x”", "\0", "€", "ab\0", "ab"]

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from([*words, *(f" {w}" for w in words)]), max_size=12).map("".join)), max_size=6))
    def same(texts):
        for t, ids in zip(texts, e.encode(texts), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids

    same()


def test_pieces_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 100)
    e = tokens.Encoder("byte_bpe_50k.json")
    asked, model = [], e.model

    class Model:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    e.model = Model()
    for i in range(40):
        new = "".join(f" {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}x" for j in range(20))
        assert e.encode([f"often these{new} often these"])[0].tolist() == e.tokenizer.encode(f"often these{new} often these").ids
    assert len(asked) > 700 and asked.count(f"{e.blank}these") == asked.count(f"{e.blank}often") == 1
