import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from colloquy.llm import rank_bpe

TEXTS = [
    "Hello world, it's 12 o'clock!!", "", None, " leading", "trailing  ", "a\n\n b\t\tc \n", "é" * 300, "日本語 text ½ ² Ⅷ",
    "x<|endoftext|>  y", "\xa0nbsp\x85em", "\x1c\x1f z _a_ b_", "z" * 4000, "ab" * 700, "😀👩‍👩‍👧 %%% ***", "'s 'S 'll don't",
    "mixed " * 3000, "�\x00\x07", "ъ" * 60 + " " * 70 + "end", "\U0003dde1x \U000125abq", " ", "\n", " \0 a \0b c", "a \n b", "ñandú ÷ × 5",
]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    own = rank_bpe.RankCodec(rank_bpe.default_ranks())
    rng = random.Random(1)
    letters = "  \n\t\x1c'sdtmrevl09éß½ñ%_!|日́ \U0003dde1"
    texts = [t or "" for t in TEXTS]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)]))
                      for _ in range(rng.randint(1, 30))) for _ in range(1000)]
    for text, ids in zip(texts, own.encode_written(texts)):
        want = library.encode_ordinary(text)
        assert list(map(int, ids.split())) == want, text
        assert own.decode_written(ids) == library.decode_bytes(want) == text.encode()


def test_rows_and_single_trees_merge_alike():
    own = rank_bpe.codec()
    rng = random.Random(2)
    for alphabet in (b"etaoin", b"a", b" the", bytes(range(256))):
        words = [bytes(rng.choice(alphabet) for _ in range(n)) for n in (1, 2, 3, 5, 31, 32, 33, 63, 64) for _ in range(5)]
        rows = own.merge_rows(words)
        for word, ids in zip(words, rows):
            assert ids == own.merge_word(word) == plain_merge(own, word)


def plain_merge(own, word):
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((own.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [own.ranks[p] for p in parts]


def test_a_very_long_word(library):
    own = rank_bpe.codec()
    rng = random.Random(3)
    word = "".join(rng.choice("thearnios") for _ in range(40_000))
    assert own.merged([word.encode()]) == [library.encode_ordinary(word)]


def test_remembered_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(rank_bpe, "REMEMBERED", 5)
    own = rank_bpe.RankCodec(rank_bpe.default_ranks())
    for i in range(20):
        text = f"word{i} other{i} word{i - 1}"
        assert list(map(int, own.encode_written([text])[0].split())) == library.encode_ordinary(text)
    assert len(own.words) + len(own.stretches) < 40


def test_operators(docs_of, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "no id")]
    docs = docs_of(rows).selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS i", "4 AS bytes")
    got = rank_bpe.round_trips(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    ids = {r.doc_id: r.ids for r in rank_bpe.encoded(docs).collect()}
    raw = {r.doc_id: r.bytes for r in rank_bpe.decoded(rank_bpe.encoded(docs)).collect()}
    for i, text in rows:
        want = library.encode_ordinary(text or "")
        assert ids[i] == want and raw[i] == (text or "").encode() and by_id[i].n_tokens == len(want)
        assert by_id[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert rank_bpe.round_trips(docs.limit(0)).count() == 0
