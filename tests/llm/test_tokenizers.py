"""Token counts and SentencePiece encoding against the libraries themselves."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobmix.llm.sentencepieces import PieceModel, RecentWords, encode_decode
from jobmix.llm.token_counts import Counter, MergeRanks, count_tokens

ODD = ["", " ", "  a  b ", "\n\n", "aaaa aaaaa", "ΑΣ ΣΑΣ σς", "İstanbul ǅ ß ﬁ é é", "a\x00b\x85c d", "a\x1cb \x1f c",
       "😀😀 👩‍👩‍👧 x²½Ⅷ٣", "'S 's I'LL don't DON'T", "mississippi" * 50, "한국어 日本語ｶﾞ", "▁▁x ▁ y▁", "<s> </s> <0x41>",
       "<|endoftext|> a<|startoftext|>b", "word" * 3000, "a\t b\r\n c", "１２３ ٤٥ 12345", "!!!???...,,,;;"]


def texts():
    rng = random.Random(5)
    pool = "aAbBéÉÅΣσ ßİ'sS09٣½<|>\n\t ▁日本ﾞx̂😀‍,.!"
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(2000)]


@pytest.fixture(scope="module")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def piece_path():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(word_path):
    lib, own = Tokenizer.from_file(word_path), Counter(word_path)
    many = texts()
    assert own.count(many) == [len(e.ids) for e in lib.encode_batch(many, add_special_tokens=False)]


def test_counts_survive_a_full_cache(word_path, monkeypatch):
    import jobmix.llm.token_counts as T
    monkeypatch.setattr(T, "CACHE_WORDS", 3)
    lib, own = Tokenizer.from_file(word_path), Counter(word_path)
    for _ in range(3):
        for text in ODD:
            assert own.count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]


def test_merging_leaves_no_pair_with_a_rank(word_path):
    ranks = MergeRanks(word_path)
    assert ranks.counts([b"a"]).tolist() == [1]
    assert (ranks.counts([b"aaaaaaaa", b"the", b"zq"]) >= 1).all()


def test_ids_and_text_equal_the_library(piece_path):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=piece_path), PieceModel(piece_path)
    for text in texts():
        ids = lib.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids), text


def test_compatible_pairs_are_those_that_encode_to_themselves(piece_path):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=piece_path), PieceModel(piece_path)
    rng = random.Random(1)
    starts = [i for i in own.parts if own.piece[i].startswith("▁") and own.piece[i] != "▁"]
    rest = [i for i in own.parts if "▁" not in own.piece[i]]
    for _ in range(3000):
        a, b = rng.choice(starts), rng.choice(rest)
        joined = (own.piece[a] + own.piece[b]).replace("▁", " ")[1:]
        assert own.compatible(a, b) == (lib.encode(joined) == [a, b])


def test_recent_words_keep_what_is_asked_for():
    memory = RecentWords(2)
    for i in range(6):
        memory.put(i, i)
        assert memory.get(0) == 0
    assert memory.get(1) is None


def rows(spark):
    data = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (100, None, "x"), (0, ODD[0], "x")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens string"), data


def test_count_query_on_odd_rows(spark, word_path):
    df, data = rows(spark)
    lib = Tokenizer.from_file(word_path)
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 20) for i, t, _ in data
                  for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in count_tokens(df, word_path, limit=20).collect())
    assert got == want
    assert count_tokens(df.limit(0), word_path).collect() == []


def test_encode_query_on_odd_rows(spark, piece_path):
    df, data = rows(spark)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i if i is not None else -1, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), ids,
                   lib.decode(ids)) for i, t, _ in data for ids in [lib.encode(t or "")])
    got = sorted((r[0] if r[0] is not None else -1, *r[1:])
                 for r in encode_decode(df, piece_path, with_ids=True, with_text=True).collect())
    assert got == want
    assert encode_decode(df.limit(0), piece_path).collect() == []
