"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aisle.llm import bpe
from tests.llm.cases import TEXTS, odd_documents

ODD = [
    "I'LL don't WE'VE it's 'tis", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ﬁ", "á ë", "x y z\x85w\x1cq", "日本語 テスト 한국어",
    "😀😀 👩‍👩‍👧", "<|endoftext|>a<|startoftext|>", "<|endoftext|", "12345 6.7 ½ Ⅷ", "a" * 5000, "!!!???...", "</w> w</w>", "​zero",
    "naïve café ÀÉÎ", "mixed<|ENDOFTEXT|>case", "\x00\x01", "ß ẞ", "don’t", "snake_case camelCase",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def test_as_the_library(library):
    own = bpe.vocabulary()
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñ' -.0123456789"
    texts = [*ODD, *[t for t in TEXTS if t], *["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    docs = odd_documents(spark)
    rows = bpe.token_digests(docs).collect()
    assert len(rows) == docs.count()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for d in docs.select("doc_id", "text").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        expected.append((d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert bpe.token_digests(docs.limit(0)).count() == 0


def test_round_trip(spark, library):
    docs = odd_documents(spark)
    tokens = bpe.encode(docs)
    back = {(r.doc_id, r.text) for r in bpe.decode(tokens).collect()}
    for r in tokens.collect():
        assert (r.doc_id, library.decode(list(r.ids), skip_special_tokens=False)) in back
