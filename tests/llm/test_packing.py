"""Packing: every id once, gapless sequences, little padding."""

import zlib

import numpy as np
import pytest

from steadycast.llm import packing, queries

SCHEMA = "doc_id long, text string, length int, part string"


def encoder():
    """A nested function travels to the workers by value; this module is not on their path."""

    def letters():
        import numpy

        return lambda text: numpy.frombuffer(text.encode(), numpy.uint8).astype("<u4")

    return letters


letters = encoder()


def checked(frame, docs, encode, window):
    """Brute force: pieces of each document on end are its ids; sequences have no gap."""
    for doc_id, text in docs:
        own = frame[frame.doc_id == doc_id].sort_values("start")
        ids = np.append(encode(text or ""), packing.END_ID).astype("<u4")
        assert own.start.tolist() == np.append(0, own.length.cumsum()[:-1]).tolist() and own.length.sum() == len(ids)
        assert set(own.doc_tokens) == {len(ids)}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    ordered = frame.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= window
    return ordered.groupby("sequence_id").length.sum()


@pytest.mark.parametrize("parts, fan_in", [(1, 32), (7, 2), (7, 32)])
def test_small_windows(spark, parts, fan_in):
    rng = np.random.default_rng(3)
    docs = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 200, 150))] + [(900, None), (901, ""), (902, "yz" * 500)]
    df = spark.createDataFrame([(*d, 7, "clash") for d in docs], SCHEMA).repartition(parts)
    frame = packing.pack(df, letters, window=64, open_windows=4, min_cut=3, fan_in=fan_in).toPandas()
    sizes = checked(frame, docs, letters(), 64)
    assert len(sizes) * 64 - sizes.sum() <= 3 * len(sizes) + 64


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), letters).count() == 0
    twice = spark.createDataFrame([(1, "abc", 1, "")] * 2 + [(None, "d", 1, "")], SCHEMA).coalesce(1)
    frame = packing.pack(twice, letters).toPandas()
    assert len(frame) == 3 and frame.length.sum() == 10 and frame.sequence_id.nunique() == 1


def test_query_on_given_table(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame = queries.QUERIES["op1_packing"](spark, sf_dir).toPandas()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sizes = checked(frame, docs, lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, "<u4"), 2048)
    assert len(sizes) * 2048 <= 1.01 * sizes.sum() + 2048


@pytest.mark.parametrize("text", ["<|endoftext|> a", "don't  stop\t\n x", "äöü 漢字 😀\u200b", "a" * 3000, " \u00a0 ", "\r\n\r\n"])
def test_both_encoders_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.byte_bpe()(text).tolist() == slow.encode(text, add_special_tokens=False).ids
