"""op10: words go to the library once, and the state of a block is small; same ids and blocks as one by one."""

import json
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparklines.llm import token_files
from sparklines.llm.token_files import BLOCK, _encoded, _Words, encode_blocks, pack, pack_all, unpack, unpack_all

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"aB \n.,'’5é́ſ\t  ᠎​﻿\x1c\x1f\x85字<|>²٣\r\x0b😀", "<|endoftext|>", "'s", " 'd", "don't", " \n ", "  ", " the", " word"]


def definition(**changes) -> str:
    with open(BYTES, encoding="utf-8") as f:
        return json.dumps(json.load(f) | changes)


class Counted:
    """A tokenizer that counts the characters that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.characters = tokenizer, 0

    def encode_batch_fast(self, texts, **more):
        self.characters += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_a_word_goes_to_the_library_once(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit\namet", "é,"]) for _ in range(300)) for _ in range(50)]
    words = _Words(definition())
    words.tokenizer = counted = Counted(words.tokenizer)
    plain = [[*e.ids, 0] for e in counted.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in _encoded(words, texts, 0)] == plain
    assert counted.characters < 100
    monkeypatch.setattr(token_files, "REMEMBERED", 5)  # forgetting changes no id
    assert [x.tolist() for x in _encoded(words, texts, 0)] == plain and words.size <= 5
    assert [x.tolist() for x in _encoded(words, texts, 0)] == plain


@pytest.mark.parametrize("changes", [{}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_ids_of_odd_texts(changes):
    rng, words = random.Random(4), _Words(definition(**changes))
    texts = ["", " ", "  ", "\n", " \n a", "a  b", "a ᠎b", *("".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(20_000))]
    assert words.apart == (not changes)
    plain = Tokenizer.from_str(definition(**changes)).encode_batch_fast(texts, add_special_tokens=False)
    assert all(got.tolist() == [*e.ids, 7] for got, e in zip(_encoded(words, texts, 7), plain, strict=True))


def test_state_of_a_block_is_small():
    ids = np.random.default_rng(5).integers(0, 1 << 20, 64 * BLOCK).astype(np.uint32)
    tracemalloc.start()
    payload = pack([1], np.array([len(ids)]), ids)
    back = unpack(payload)[2]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (back == ids).all() and most < 64 * 400_000


def test_blocks_do_not_depend_on_others():
    rng = np.random.default_rng(6)
    parts = [rng.zipf(1.3, n).clip(0, 60_000).astype(np.uint32) for n in (BLOCK, 5, BLOCK, 700, 1)]
    assert encode_blocks(parts) == [encode_blocks([p])[0] for p in parts]
    files = [([k], np.array([len(p)]), p) for k, p in enumerate([*parts, parts[0][:0], np.concatenate(parts)])]
    payloads = pack_all(files)
    assert payloads == [pack(*f) for f in files]
    assert all(names == f[0] and (ids == f[2]).all() for (names, _, ids), f in zip(unpack_all(payloads), files, strict=True))
