"""Token files and alignment against the libraries' own results on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.orc
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from steadycast.llm import orcfiles, queries

SCHEMA = "doc_id long, text string, place int, ids string, file string"
ODD = [
    "a", "B", "'s", "'", "’", "1", "22", "Σ", "ς", "é", "é", "́", " ", "　", "\x1c", "\x0b", "\x85", "\r", " ", "  ", "\n", "\t",
    "日", "𝟓", "İ", "ß", "<|endoftext|>", "endoftext", "<|", "|>", ".", ",", "-", "_", "​", "😀", "\0", "\\", "~", "{", "^", "▁", "<0x41>", "<s>",
]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(n)] + [None, "", " ", "x" * 5000, "ab " * 3000, "H̱ ẖ"]


def test_word_encoder_equals_library():
    slow = Tokenizer.from_file(path("word_bpe_49k.json"))
    encode = orcfiles.word_bpe(path("word_bpe_49k.json"))()
    for texts in (odd_texts(8000), [], [None], ["", "a"]):
        ids, upto = encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[upto[i] : upto[i + 1]].tolist() == slow.encode(t or "", add_special_tokens=False).ids, repr(t)


def by_hand(rows):
    slow = Tokenizer.from_file(path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op12_orc_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == by_hand([(r.doc_id, r.text) for r in docs])


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """4000 documents in files with many stripes, ids in steps of three."""
    where = str(tmp_path_factory.mktemp("orc"))
    docs = [(3 * i, f"word{i} " * (i % 50), 1, "x", "y") for i in range(4000)]
    orcfiles.write(spark.createDataFrame(docs, SCHEMA).repartition(5), where, orcfiles.word_bpe(path("word_bpe_49k.json")), parts=4,
                   stripe_bytes=1 << 16, index_rows=1000)
    return where, by_hand([d[:2] for d in docs])


def scanned(df):
    """Rows that left the file scans of a query that has run."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan orc") and "ids" in node.schema().simpleString():
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_order_stripes_and_filters(spark, written):
    where, wanted = written
    rows = orcfiles.checksums(orcfiles.read(spark, where)).collect()
    assert sorted(map(tuple, rows)) == wanted
    files = orcfiles.file_list(spark, where).orderBy("file").collect()
    assert len(files) == 4 and all(a.last_id < b.first_id for a, b in zip(files, files[1:]))
    local, _ = pyarrow.fs.FileSystem.from_uri(f"file://{where}/rows/{files[0].file}")
    file = pyarrow.orc.ORCFile(local.open_input_file(f"{where}/rows/{files[0].file}"))
    assert file.nrows == files[0].n_docs and file.row_index_stride == 1000
    assert sum(file.read_stripe(i, ["doc_id"]).num_rows for i in range(file.nstripes)) == file.nrows


def test_look_up_reads_little(spark, written):
    where, wanted = written
    df = orcfiles.look_up(spark, where, [300, 301, 9000])
    rows = orcfiles.checksums(df).collect()
    assert sorted(map(tuple, rows)) == [w for w in wanted if w[0] in (300, 9000)]
    df = orcfiles.look_up(spark, where, [300])
    assert len(df.collect()) == 1 and scanned(df) <= 1000
    absent = orcfiles.look_up(spark, where, [301])
    assert absent.collect() == [] and scanned(absent) == 0
    assert orcfiles.look_up(spark, where, []).collect() == [] and orcfiles.look_up(spark, where, [-5]).collect() == []


@pytest.mark.parametrize("first, n", [(0, 1), (777, 5000), (0, 10**7), (123456, 40), (5, 0)])
def test_token_range(spark, written, first, n):
    where, _ = written
    whole = [i for r in orcfiles.read(spark, where).orderBy("start").collect() for i in r.ids]
    rows = orcfiles.token_range(spark, where, first, n).orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == whole[first : first + n]
    assert all(whole[r.start : r.start + r.n_tokens] == r.ids for r in rows)


def test_odd_rows(spark, tmp_path):
    docs = [(None, "n", 1, "", "")] * 40 + [(2, "same", 1, "", "")] * 3 + [(2, None, 1, "", ""), (-9, "", 1, "", ""), (5, "long " * 300_000, 1, "", "")]
    encoder = orcfiles.word_bpe(path("word_bpe_49k.json"))
    orcfiles.write(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "a"), encoder, parts=3)
    rows = orcfiles.checksums(orcfiles.read(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 40 + [-9] + [2] * 4 + [5]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert rows[-1].n_tokens == 300_001 and rows[40].n_tokens == 1
    orcfiles.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"), encoder)
    assert orcfiles.read(spark, str(tmp_path / "b")).count() == 0
    assert orcfiles.look_up(spark, str(tmp_path / "b"), [1]).count() == 0
