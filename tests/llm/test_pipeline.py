"""The pipeline against its stages' brute-force versions, one after the other."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from aisle.llm import bpe, toxicity
from tests.llm import test_line_dedup, test_ngram_join
from tests.llm.cases import odd_documents

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def digests(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_as_brute_force(spark, library):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    labels = spark.read.parquet(f"{DIRECTORY}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted and r.doc_id is not None}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is None or r.doc_id not in toxic]
    assert 0 < len(toxic) < docs.count() / 4
    cleaned = [(d, text) for d, _, _, text in test_line_dedup.expected(rows)]
    kept = {d for d, _, root in test_ngram_join.expected(cleaned) if d == root}
    wanted = {digests(library, d, t) for d, t in cleaned if d in kept}
    found = [tuple(r) for r in cp.run(spark, DIRECTORY).collect()]
    assert set(found) == wanted
    assert len(found) >= len(wanted)


def test_stages_bear_odd_rows(spark):
    docs = odd_documents(spark)
    for given in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, given, DIRECTORY)
            assert out.columns == docs.columns
            assert out.count() == 0 or given is docs
        assert cp.tokens(spark, given, DIRECTORY).count() == given.count()


def test_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    assert set(cp.queries()) == {"pipeline"} and not cp.oracle_sql()
