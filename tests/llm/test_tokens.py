"""Token ids and prefix counts against the library: resets of the memory, all scripts, long words."""

import random
import time

import numpy as np
import pytest

from schemaloom.llm import token_counts, wordbpe

ALPHABETS = ["abcdefgh", "'strevelld", "日本語文", "😀🎉", "éàü", "ẹ́̇", "İIiẞ", "각각", "ÅÅ̈́", "กำาี", " \t  ", "0١²Ⅷ", "!?.'’", "ΑΣσΪ́ς", "क़न", "x̧̀́"]
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "'re", "'ll"]


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(x) for x in raw)])


def mixed(r, n):
    out = []
    while len(out) < n:
        letters = r.choice(ALPHABETS)
        out += [r.choice(letters) for _ in range(r.randint(1, 5))]
        if r.random() < 0.03:
            out.append(r.choice(SPECIAL))
    return "".join(out)


def latin(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))


@pytest.fixture
def front():
    path = token_counts.tokenizer_path()
    return wordbpe.WordBpe(path), wordbpe.PrefixCounts(path)


def ids(front, text):
    return front[0].library.encode(text, add_special_tokens=False).ids


def check(front, texts, most=200):
    for lo in range(0, len(texts), 16):
        part = texts[lo : lo + 16]
        for text, got in zip(part, front[0].encode_block(*block(part))):
            assert got.tolist() == ids(front, text)
        for text, got in zip(part, front[1].prefix_block(*block(part))):
            assert len(got) == len(text) + 1
            for j in range(len(text) + 1) if len(text) < most else (0, len(text) // 2, len(text)):
                assert got[j] == len(ids(front, text[:j])), (text[:j], j)


def test_all_scripts_special_tokens_and_composed_texts(front):
    r = random.Random(1)
    texts = [mixed(r, r.choice([1, 3, 10, 30, 80])) for _ in range(120)]
    texts += ["".join(r.choice("ẹạôu") for _ in range(150)), "!" * 150 + "'ś", "'śab", "x" * 100 + "ẹ́ 'ré", "Å", "́a", "", "<|endoftext|>" * 3]
    check(front, texts)


def test_many_resets_of_the_memory(front, monkeypatch):
    monkeypatch.setattr(wordbpe, "MOST_WORDS", 512)
    for f in front:
        f.reset()
    r = random.Random(2)
    check(front, [mixed(r, 40) for _ in range(40)] + [latin(r, 3000) for _ in range(3)] + [mixed(r, 40) for _ in range(40)])


def test_a_table_takes_as_many_keys_as_it_promises():
    table = wordbpe.HashTable(1000)
    keys = np.arange(1, 1001, dtype=np.uint64) << np.uint64(32)
    table.put(keys, np.arange(1000, dtype=np.int32))
    assert table.get(keys).tolist() == list(range(1000)) and table.get(keys + np.uint64(1)).max() == -1


@pytest.mark.parametrize("name", ["letters", "ideographs", "emoji", "decomposed", "specials", "one letter"])
def test_long_runs_take_seconds(front, name):
    r = random.Random(3)
    text = {
        "letters": "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)),
        "ideographs": "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(20_000)),
        "emoji": "some words here 😀 and more " * 20_000,
        "decomposed": "".join(r.choice(["é", "ạ", "o", "k"]) for _ in range(50_000)),
        "specials": "<|endoftext|> a" * 20_000,
        "one letter": "a" * 500_000,
    }[name]
    began = time.time()
    got = front[1].prefix_block(*block([text]))[0]
    assert time.time() - began < 20
    want = ids(front, text)
    assert got[-1] == len(want) and front[0].encode_block(*block([text]))[0].tolist() == want
    for j in (1, len(text) // 7, len(text) // 2, len(text) - 1):
        assert got[j] == len(ids(front, text[:j]))


def test_a_run_of_over_65536_tokens(front):
    text = "".join(random.Random(4).choices("qxzjv", k=100_000))
    assert len(ids(front, text)) > 65_536
    assert front[1].prefix_block(*block([text]))[0][-1] == len(ids(front, text))


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        wordbpe.WordBpe(token_counts.tokenizer_path("byte_bpe_50k.json"))
