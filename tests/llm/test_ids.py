"""Ids stay exact beside null ones: 2**53 + 1 is no float."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, html, licenses, packing, secrets, simhash, substring, toxicity, warc

BIG = 9007199254740993
TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT), (None, TEXT), (BIG + 2, None), (3, "token = \"9f8a7b6c5d4e3f2a1b0c\" " + TEXT)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


IDS = sorted(map(str, (BIG, None, BIG + 2, 3)))


def ids(df, column="id"):
    return sorted(str(r[0]) for r in df.select(column).distinct().collect())


def test_text_operators_keep_ids(spark, docs):
    benchmark = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert ids(toxicity.score(docs, toxicity.Model(np.zeros(toxicity.SLOTS), -3.0))) == IDS
    assert ids(simhash.fingerprints(docs)) == IDS
    assert ids(simhash.near_duplicates(docs.where("doc_id is not null"))) == sorted(map(str, (BIG, BIG + 2, 3)))
    assert ids(substring.without_repeats(docs)) == IDS
    assert ids(decontamination.contamination(docs, benchmark)) == IDS
    assert ids(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")), "doc_id") == IDS
    scanner = secrets.Scanner(secrets.Lexicon({}, set()), None)
    long = docs.withColumn("text", F.coalesce("text", F.lit("token = abcdef123456789"))).withColumn("text", F.concat("text", F.lit(" abcdef123456789")))
    assert ids(secrets.scan(long, path_col=None, scanner=scanner)) == IDS
    assert ids(licenses.scan(docs.withColumn("text", F.lit(TEXT)), {"t": TEXT})) == IDS


def test_pages_keep_ids(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.coalesce("text", F.lit("")).alias("html"))
    assert ids(html.extract(pages, html.learn(pages)), "page_id") == IDS
    twins = pages.union(pages.where(f"page_id = {BIG}").selectExpr("page_id + 10", "url", "html"))
    found = {r.page_id: r.refers_to for r in warc.round_trip(spark, twins).collect()}
    assert found[BIG] == BIG + 10 and found[BIG + 10] is None and None in found


@pytest.mark.parametrize("text", [" " * 1000000, "\n" * 1000000, "\t" * 1000000, "\xa0" * 1000000, "a" + " " * 400000 + "b", "x" * 1000000])
def test_very_long_white_space_is_encoded_as_the_plain_library_does(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = list(packing.encoder(path)([text, "and more"]))
    assert own == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in (text, "and more")]
