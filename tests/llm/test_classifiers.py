"""Toxicity and language: held-out accuracy on the test tables, and language against vectors written out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.llm import language_id, toxicity
from tests.llm.cases import odd_documents

DIRECTORY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIRECTORY}/labels.parquet")


def test_toxicity_held_out(docs, labels):
    found = toxicity.toxicity(docs, labels).join(labels.where("toxic IN (0, 1)"), "doc_id").where("held_out").collect()
    wrong = sum(r.predicted != r.toxic for r in found)
    assert len(found) > 20
    assert wrong <= 0.1 * len(found), (wrong, len(found))


def test_toxicity_learns_from_no_held_out_label(spark, docs, labels):
    twisted = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    part = docs.limit(150).cache()
    scores = [{r.doc_id: r.score for r in toxicity.toxicity(part, x).collect()} for x in (labels, twisted)]
    assert scores[0] == scores[1]


def test_toxicity_odd_rows(spark, labels):
    odd = odd_documents(spark)
    own = spark.createDataFrame([(4, 1), (7, 0), (11, 1), (9, 0), (None, 1), (3, None), (2, 7)], "doc_id long, toxic int")
    for given in (own, own.limit(0), own.where("toxic = 1")):
        found = toxicity.toxicity(odd, given).collect()
        assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.score for r in toxicity.toxicity(odd, own.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(odd.limit(0), own).count() == 0
    kept = toxicity.drop_toxic(odd, own)
    assert kept.columns == odd.columns and {0, 77} <= {r.doc_id for r in kept.collect()}


def test_language_held_out(docs):
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    found = [r for r in found if r.lang is not None]
    right = sum(r.lang_pred == r.lang for r in found)
    assert len(found) > 100
    assert right >= 0.9 * len(found), (right, len(found))


def test_language_as_written_out_vectors(spark, docs):
    taught = docs.where("lang IS NOT NULL AND text IS NOT NULL").limit(20).cache()
    names, matrix = language_id.prototypes(taught)
    asked = docs.where("text IS NOT NULL").orderBy(F.length("text")).limit(40).cache()
    texts = {r.doc_id: r.text for r in asked.collect()}
    sums = {}
    for r in taught.collect():
        sums[r.lang] = sums.get(r.lang, 0) + bundle(r.text)
    assert names == sorted(sums)
    own = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    own -= own.mean(axis=0)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    assert np.allclose(own, matrix)
    for r in language_id.predict(asked, names, matrix).collect():
        vector = bundle(texts[r.doc_id])
        cosines = own @ vector
        if r.lang_pred == "und":
            assert not vector.any()
        elif np.diff(np.sort(cosines))[-1] > 1e-6:
            assert r.lang_pred == names[int(cosines.argmax())]


def bundle(text):
    """Sum of the bound vectors of every trigram of every word."""
    out = np.zeros(language_id.DIMENSIONS)
    for word in language_id.LETTERS.findall(text.lower()):
        padded = f" {word} "
        for i in range(len(padded) - 2):
            bound = np.ones(language_id.DIMENSIONS)
            for place, letter in enumerate(padded[i : i + 3]):
                random = np.random.Generator(np.random.PCG64(ord(letter))).integers(0, 2, language_id.DIMENSIONS, np.int8) * 2 - 1
                bound *= np.roll(random, 2 - place)
            out += bound
    return out


def test_language_odd_rows(spark):
    odd = odd_documents(spark)
    found = language_id.identify(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        if r.doc_id in (0, 1, 2, 11, 77):  # null, empty, blank and signs alone
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    nothing = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0
