"""Token counts and shards against the library."""

import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewatch.llm import catalogue, token_counts, token_shards, tokenizing
from tapewatch.session import scratch_path
from tests.llm.conftest import FOLDER


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PIECES = ["a", "b", "the", "'re", "'", "r", "l", "ll", "'ll", " ", "  ", "\n", "\t", "\xa0", "　", "é", "漢字", "😀", "1", "23", "--", "$", "<|endoftext|>", "<|", "endof", "'s", "S", "ing", "tion", "\x1c", "\x85", "ſ", "γ", "-" * 9, " " * 17, "́"]


def test_counts_of_every_prefix(library):
    counter = token_counts.PrefixCounter("byte_bpe_50k.json")
    draw = random.Random(1)
    for _ in range(800):
        text = "".join(draw.choices(PIECES, k=draw.randint(0, 14)))
        steps = np.frombuffer(counter.steps([text])[0], np.int8)
        assert np.cumsum(steps).tolist() == [len(library.encode(text[:k]).ids) for k in range(1, len(text) + 1)], text


def test_units_and_memory_do_not_matter(library, monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 7)
    monkeypatch.setattr(tokenizing, "PART", 20)
    encoder = tokenizing.Encoder("byte_bpe_50k.json", "<u2")
    draw = random.Random(2)
    for _ in range(400):
        text = "".join(draw.choices(PIECES, k=draw.randint(0, 30)))
        assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == library.encode(text).ids, text


def test_prefix_questions(spark, library, odd, empty):
    counted = token_counts.prefix_counts(odd)
    steps = F.col("tokens.steps")
    rows = counted.select("text", "tokens.n_tokens", "tokens.n_bytes", token_counts.tokens_of_prefix(steps, F.lit(25)).alias("n25"), token_counts.longest_prefix(steps, F.lit(9)).alias("fit"))
    for r in rows.collect():
        text = r["text"] or ""
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["n25"]) == (count(text), len(text.encode()), count(text[:25]))
        assert r["fit"] == max((k for k in range(min(len(text), 200) + 1) if count(text[:k]) <= 9), default=0)
    assert token_counts.prefix_counts(empty).count() == 0


def test_op9(spark, texts, library):
    for r in catalogue.QUERIES["op9_token_counts"](spark, FOLDER).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_op2(spark, texts, library):
    rows = {r["doc_id"]: r for r in catalogue.QUERIES["op2_token_shards"](spark, FOLDER).collect()}
    start = 0
    for key in sorted(texts):
        ids = library.encode(texts[key], add_special_tokens=False).ids + [2]
        r = rows.pop(key)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_odd_store(spark, library, odd, odd_rows):
    store = token_shards.write_tokens(odd, scratch_path(spark, "store"))
    assert token_shards.TokenStore.open(spark, store.folder) == store
    places = token_shards.locate(store, token_shards.keys_of(spark, store))
    found = token_shards.read_ids(spark, store, places, lambda ids: (ids.tolist(),), "ids array<long>").orderBy("start").collect()
    assert [r["start"] for r in found] == np.cumsum([0, *[len(r["ids"]) for r in found]])[:-1].tolist()
    assert [r["key"] for r in found] == sorted((r[0] for r in odd_rows), key=lambda k: (k is not None, k or 0))
    expected = sorted(library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in odd_rows)
    assert sorted(r["ids"] for r in found) == expected
    absent = spark.createDataFrame([(99, 0), (1, 2), (None, 2)], "key long, copy long")
    assert token_shards.locate(store, absent).count() == 0


def test_one_key_for_many_rows_and_no_rows(spark, empty, monkeypatch):
    monkeypatch.setattr(token_shards, "BUCKET_KEYS", 20)
    docs = spark.range(200).select((F.col("id") % 3 * 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(4)
    store = token_shards.write_tokens(docs, scratch_path(spark, "store"))
    keys = token_shards.keys_of(spark, store)
    assert store.buckets == 10 and keys.distinct().count() == 200 and keys.agg(F.max("copy")).first()[0] == 66
    assert token_shards.locate(store, keys).select("shard", "offset").distinct().count() == 200
    none = token_shards.write_tokens(empty, scratch_path(spark, "store"))
    assert token_shards.locate(none, token_shards.keys_of(spark, none)).count() == 0


def test_perfect_hash():
    draw = np.random.default_rng(7)
    h1, h2 = draw.integers(-(2**63), 2**63 - 1, (2, 5000))
    found = token_shards.PerfectHash.build(h1, h2)
    assert sorted(found.slots(h1, h2)) == list(range(5000))
