"""Alignment of two tokenizers against whole texts cut by hand."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from public_tokenizers import path
from test_tokens import odd_texts
from tokenizers import Tokenizer

from steadycast.llm import alignment, queries

PATHS = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, n_a int, n long"


def by_hand(rows):
    """Whole texts, ends from the tokens' bytes, links by comparing all ranges of neighbours."""
    a_of, b_of = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_of.encode_special_tokens = True
    signs = alignment.byte_of()
    held, docs = Counter(), []
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a, b = a_of.encode(" " + (text or ""), add_special_tokens=False).ids, b_of.encode(text or "")
        spelt_a = [bytes(signs[c] for c in a_of.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spelt_a) != want or b"".join(spelt_b) != want:
            docs.append((doc_id, [], [], "", 0))
            continue

        def ends(tokens):
            out, at = [], 0
            for t in tokens:
                at += len(t)
                out.append(at)
            return out

        ends_a, ends_b = ends(spelt_a), ends(spelt_b)
        shared = sorted(set(ends_a) & set(ends_b))
        groups = [
            ",".join(str(i) for i, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= high)
            for low, high in zip([0, *shared], shared)
        ] if len(want) < 3000 else None
        links, j = [], 0
        for i, (x, y) in zip(a, zip([0, *ends_a], ends_a)):
            while ends_b[j] <= x:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < y:
                links.append((i, b[k]))
                k += 1
        held.update(set(links))
        docs.append((doc_id, a, b, links, groups if groups is None else ";".join(groups)) + (len(shared),))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, a, b, links, groups, *n in docs:
        digest = None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), n[0] if n else 0, len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), digest))
    return out


def same(got, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:7])
    got, wanted = sorted(map(tuple, got), key=key), sorted(wanted, key=key)
    assert len(got) == len(wanted)
    for x, y in zip(got, wanted):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7]), (x, y)


@pytest.mark.parametrize("block", [1 << 22, 500])
def test_equals_whole_texts(spark, block):
    rows = list(enumerate(odd_texts(1500))) + [(None, "x y"), (None, None), (7, "same"), (7, "same"), (8, " a"), (9, "a b,c.d 1a?!'s")]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts(300, 9))] + [(20_000, "long text, with words. " * 20_000)]
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA).repartition(3)
    same(alignment.align(df, *PATHS, block=block).collect(), by_hand(rows))


def test_query_equals_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    same(queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect(), by_hand([(r.doc_id, r.text) for r in docs]))


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []


def test_spans_and_bytes():
    assert alignment.refined([(0, 2), (2, 5)], [b" a", b"bcd"]) == [2, 5]
    assert alignment.refined([(0, 1), (1, 2), (1, 2), (2, 3)], [b" ", b"\xe6", b"\x97\xa5", b"x"]) == [1, 2, 4, 5]
    assert alignment.grouped([1, 2, 3], [2, 4, 6], [8, 9], [3, 6]) == (1, [(1, 8), (2, 8), (2, 9), (3, 9)], "1,2,3|8,9")
