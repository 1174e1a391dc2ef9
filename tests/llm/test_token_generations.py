"""op10: letters and the marks after them are asked for once each, two generations of words are remembered, blocks are coded from whole arrays."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from sparklines.llm import token_files
from sparklines.llm.token_files import BLOCK, _encoded, _Model, _Words, decode_blocks, encode_blocks

BYTES = public_tokenizers.path("byte_bpe_50k.json")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"


def definition(**changes) -> str:
    with open(BYTES, encoding="utf-8") as f:
        return json.dumps(json.load(f) | changes)


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.words += [w for t in texts for w in t.split(" ") if w]
        return self.tokenizer.encode_batch_fast(texts, **more)


def library_ids(words, texts):
    return [[*e.ids, 0] for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_letters_and_marks_go_to_the_library_once():
    words = _Words(definition())
    letters, marks = ["tionan", "éaieux", "Ŀ", "a"], [".", ",", "%%%", "!?", "-"]
    texts = ["first " + " ".join(a + b for a in letters for b in ["", *marks]), " ".join(a + b for b in marks for a in letters)]
    plain = library_ids(words, texts)
    words.tokenizer = counted = Counted(words.tokenizer)
    assert [x.tolist() for x in _encoded(words, texts, 0)] == plain
    assert len(counted.words) == len(set(counted.words)) <= len(letters) + len(marks) + 2


@pytest.mark.parametrize("added", [None, "an%", "%%", "a"])
def test_ids_of_marked_words(added):
    told = json.loads(definition())
    if added:
        more = dict(told["added_tokens"][0]) if told["added_tokens"] else {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        told["added_tokens"].append(more | {"id": 50_257, "content": added})
    words, rng = _Words(json.dumps(told)), random.Random(4)
    pool = ["an", "tion", "é", "ß", "ª", "º", "×", "÷", "ɐ", "字", "1", "\n", "²", "s", "t", "ll", *MARKS]
    texts = [" ".join("".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(60)) for _ in range(400)]
    assert [x.tolist() for x in _encoded(words, texts, 0)] == library_ids(words, texts)
    assert words.parted == (added is None or not words.apart)


def test_common_words_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 8000)
    words = _Words(definition())
    words.tokenizer = counted = Counted(words.tokenizer)
    for k in range(40):
        [_] = _encoded(words, ["start common " + " ".join(f"w{k}x{i}" for i in range(150))], 0)
        assert words.size <= 8000
    assert counted.words.count("common") == 1


def test_blocks_are_coded_without_contexts(monkeypatch):
    monkeypatch.setattr(_Model, "predict", None)
    rng = np.random.default_rng(5)
    parts = [np.minimum(rng.zipf(1.3, size=n), 60_000).astype(np.uint32) for n in (BLOCK, 1, 64, 65, 0, 777, BLOCK - 1)] + [np.tile(rng.integers(0, 9, 5), 300).astype(np.uint32)]
    coded = encode_blocks(parts)
    monkeypatch.undo()
    sizes = np.array([len(p) for p in parts])
    got = decode_blocks(coded, sizes, np.full(len(parts), 1 << 20))
    assert all((g[: len(p)] == p).all() for g, p in zip(got, parts, strict=True))
