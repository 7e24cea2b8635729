"""The cache of pieces under a worker's encoder, and where texts are cut."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from faultline.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = [" ", " ", "  ", "\n", "\n", "\n\n", "\r\n", "\t", "\x0b", " ", "　", " ", "a", "Foo", "bar", "don't", "'s", "é", "Été", "Straße", "ǆ", "ɐx", "漢字", "12", "3.5", ".", ",", "!?", "'", "`", "\x00", "\x1f", "\x7f", "😀", "x" * 30, "ab" * 500]


def whole(texts):
    return [LIB.encode(t or "", add_special_tokens=False).ids for t in texts]


def coded(own, texts):
    counts, ids = own.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("slots, ids", [(20, 4 << 20), (3, 4 << 20), (20, 60), (0, 1)])
def test_pieces_equal_the_library(monkeypatch, slots, ids):
    monkeypatch.setattr(tokens, "SLOT_BITS", slots)
    monkeypatch.setattr(tokens, "CACHE_IDS", ids)
    if slots == 0:
        monkeypatch.setattr(tokens, "SLOT_BITS", 1)
    rng, own = np.random.default_rng(slots), tokens.Encoder(PATH)
    for _ in range(12):
        texts = ["".join(rng.choice(PARTS, rng.integers(0, 25))) for _ in range(60)] + [None, "", "\n", "\nfoo", "foo\n", "<|endoftext|>a\nb", "a.\nB <|endoftext|>"]
        want = whole(texts)
        assert coded(own, texts) == want
        assert own.encode(pa.array(texts, pa.string()), lengths_only=True)[0].tolist() == [len(x) for x in want]


def test_a_worker_encodes_a_piece_once_in_all_its_tasks(monkeypatch):
    monkeypatch.setattr(tokens, "_loaded", {})
    asked = []
    ids_of = tokens.Encoder._ids_of
    monkeypatch.setattr(tokens.Encoder, "_ids_of", lambda self, texts: asked.extend(texts) or ids_of(self, texts))
    texts = ["Some words.\nOthers, words\nand some", "Others words some."]
    for _ in range(2):  # two tasks of one worker
        got = [x for _, counts, ids in tokens.encoded_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), PATH) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert [x.tolist() for x in got] == whole(texts)
    assert sorted(asked) == sorted(["Some", " words", ".", "\n", "Others", ",", "and", " some"])
