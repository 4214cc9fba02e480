"""Near-duplicates, repeated strings, phrase fingerprints and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steadycast.llm import near_dup, phrases, queries, suffixes
from steadycast.llm.common import WordHashes
from steadycast.llm.components import components

SCHEMA = "doc_id long, text string, rep string, label int"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], SCHEMA)


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (200, 300), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if p[0] != p[1]]
    want = roots(real, {x for p in real for x in p})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, size):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def brute(docs, size):
    sets = {i: shingle_set(t, size) for i, t in docs}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {i: (len(sets[i]), c, i == c) for i, c in roots(links, ids).items()}


def edited(words, rng, share):
    return [w if rng.random() > share else f"e{rng.randrange(999)}" for w in words]


def test_near_duplicates_with_chains_and_odd_texts(spark):
    rng = random.Random(2)
    docs, n = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one two three")], 10
    for family in range(4):
        words = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(40):
            if rng.random() < 0.5:  # copies of copies: chains of links
                words = edited(words, rng, 0.01)
            docs.append((n, " ".join(edited(words, rng, 0.01 * family))))
            n += 1
    docs += [(n, docs[20][1]), (n + 1, docs[20][1].upper()), (n + 2, "solo " * 3000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.group(frame(spark, docs), size=4).collect()}
    assert got == brute(docs, 4)


def test_near_duplicates_of_long_lists(spark, monkeypatch):
    """Lists longer than a block are cut, and nothing is lost."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = [(i, " ".join(edited(words, rng, 0.02))) for i in range(150)]
    whole = near_dup.residual
    monkeypatch.setattr(near_dup, "residual", lambda *a: whole(*a, block=20))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.group(frame(spark, docs), size=5).collect()}
    assert got == brute(docs, 5)


@pytest.mark.parametrize("bulk", [500, 5])
def test_candidates_are_given_once_and_packed_by_list(spark, bulk):
    """Loosely alike documents: no more rows than documents of lists, a row for each pair before."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    docs = near_dup.keyed(frame(spark, [(i, " ".join(edited(words, rng, 0.03))) for i in range(60)]))
    sets = near_dup.sign(docs, 5).where("n > 0").withColumnRenamed("doc_id", "rep").cache()
    # One label of ten documents, the rest alone.
    label = F.when(F.col("rep") < 10, 0).otherwise(F.col("rep")).cast("long").alias("label")
    members = F.when(F.col("rep") < 10, 10).otherwise(1).cast("long").alias("members")
    posted = near_dup.postings(sets).select("*", label, members).cache()
    rows = near_dup.residual(posted, sets, 80, 1, block=20, bulk=bulk).collect()
    got = sorted(tuple(sorted((r.a, b))) for r in rows for b in r.others)
    of = {r.rep: (r.n, np.array(r.sig)) for r in sets.collect()}
    tokens = {}
    for r in posted.collect():
        tokens.setdefault(r.rep, set()).add(r.token)
    name = lambda i: 0 if i < 10 else i
    want = [
        (a, b) for a in range(60) for b in range(a + 1, 60)
        if name(a) != name(b) and tokens.get(a, set()) & tokens.get(b, set()) and (of[a][1] == of[b][1]).sum() >= near_dup.MATCHES
        and 100 * min(of[a][0], of[b][0]) >= 80 * max(of[a][0], of[b][0])
    ]
    assert len(want) > 300 and got == want
    assert len({(r.label, r.block, r.share, r.a) for r in rows}) == len(rows)
    assert any(r.block >= 0 for r in rows) == (bulk == 5) and any(r.block < 0 for r in rows)
    if bulk == 500:
        assert len(rows) < len(want) / 2


def test_near_duplicates_null_ids_repeated_rows_empty_table(spark):
    assert near_dup.group(frame(spark, [])).count() == 0
    got = near_dup.group(frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, None, False), (False, None, False), (True, None, True)]


def test_unlike_texts_of_one_id_are_not_linked(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    unlike = [text() for _ in range(30)]
    near = unlike[0] + " tail"
    docs = [(None, t) for t in unlike] + [(None, near), (5, unlike[1] + " more"), (5, text()), (6, text())]
    got = near_dup.marked(frame(spark, docs), size=5).collect()
    assert len(got) == len(docs)
    marks = {r.mark: r for r in got}
    of = {t: m for t, m in zip([t for _, t in docs], frame(spark, docs).select(near_dup.mark_of(F.col("text"))).toPandas().iloc[:, 0])}
    assert all(marks[of[t]].kept for t in unlike[1:]) and marks[of[unlike[0]]].kept != marks[of[near]].kept
    assert [(marks[of[t]].component_id, marks[of[t]].kept) for _, t in docs[-3:]] == [(None, False), (5, True), (6, True)]


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = [text() for _ in range(12)]
    rows = [(None, t, "en", "s0") for t in texts] + [(None, texts[0], "de", "s1"), (3, texts[1] + " tail", "en", "s0"), (4, text(), "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.unlike(spark, docs, "").collect()
    assert sorted(r.text for r in out) == sorted([*texts, rows[-1][1]])
    split = spark.createDataFrame([(None, t, "en", "s0") for t in texts] + [(10, text() * 20, "en", "s0")], docs.schema)
    taken = corpus_pipeline.mixing.mix(split, epochs=1, weights=corpus_pipeline.queries.MIX_WEIGHTS).where("copies > 0")
    assert corpus_pipeline.mixed(spark, split, "").count() == taken.count() == len(texts)


def test_shingles_are_those_of_each_text():
    known = WordHashes()
    texts = ["a b c d e", "", "x y", "a b c d e", "a b c d"]
    keys, n = near_dup.shingles(texts, 4, known)
    assert n.tolist() == [2, 0, 1, 2, 1] and keys[:2].tolist() == keys[3:5].tolist() and keys[5] in keys[:2]


def cut(docs):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for q in range(len(data) - 99):
            w = data[q : q + 100]
            gone[q : q + 100] |= w in seen
            seen.add(w)
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int(np.count_nonzero(np.diff(np.append(0, gone.astype(int))) == 1))
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def repeated_docs():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, base = text(40), text(120)
    docs = [(i, text(rng.randrange(5, 60)) + (common if i % 3 == 0 else "") + text(9)) for i in range(60)]
    docs += [(100 + i, base[i : i + 300] + text(5) + base[: 150 + i]) for i in range(20)]
    docs += [(200, "a" * 1000), (201, "a" * 99), (202, "a" * 100), (203, "ab" * 300), (204, None), (205, ""), (206, docs[3][1]), (207, docs[3][1])]
    return docs


@pytest.mark.parametrize("hot", [8000, 5])
def test_repeated_strings(spark, monkeypatch, hot):
    docs = repeated_docs()
    whole = suffixes.repeated
    monkeypatch.setattr(suffixes, "repeated", lambda d, copied: whole(d, copied, hot))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove(frame(spark, docs).repartition(5)).collect()}
    assert got == cut(docs)


def test_hot_stretches_go_in_pieces():
    """A passage in many texts: a stretch is a few pieces, or one settled row, and not a row for each string."""
    rng = random.Random(9)
    noise = lambda: "".join(rng.choices("abcdefgh ", k=80))
    passage = noise() * 3
    docs = [(i, noise() + passage + noise()) for i in range(200)]
    wanted, stretches, strings = [], 0, 0
    for _, text in docs:
        _, firsts, lasts, _ = suffixes.anchors(text.encode())
        wanted.append([{"number": k, "hot": True} for k in range(len(firsts))])
        stretches += len(firsts)
        strings += int((lasts - firsts + 1).sum())
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "digest": i, "wanted": w} for (i, t), w in zip(docs, wanted)])
    columns = list(zip(*(r.values() for b in suffixes.send_stretches(iter([batch])) for r in b.to_pylist())))
    assert len(columns[0]) < 4 * stretches < strings / 4
    # Every string is in one row, and pieces hold at most STEP strings.
    rows = list(zip(*columns))
    assert sum(r[5] - r[4] + 1 for r in rows) == strings
    assert all(r[5] - r[4] < suffixes.STEP for r in rows if r[7] is not None)

    def sort(hot, rows):
        out = suffixes.sort_stretches(hot)(iter([suffixes._batch(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))]))
        return [tuple(r.values()) for b in out for r in b.to_pylist()]

    starts = lambda rows: sorted((r[2], q) for r in rows for q in range(r[4], r[5] + 1))
    plain, spilled = sort(None, rows), sort(50, rows)
    assert any(r[7] is not None for r in spilled) and all(len(r[7]) == suffixes.LENGTH for r in spilled if r[7] is not None)
    assert starts(sort(None, spilled)) == starts(plain) != []


def test_repeated_rows_null_ids_empty_table(spark):
    assert suffixes.remove(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(100)))
    got = suffixes.remove(frame(spark, [(4, text), (4, text), (None, text + "x")])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (4, len(text)), (4, len(text))]
    # Unlike texts of one id are documents of their own, and a repeated row does not repeat itself.
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(20)]
    got = suffixes.remove(frame(spark, [(None, t) for t in texts] + [(None, texts[0]), (7, texts[3][:150] + texts[4])])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0)] * 21 + [(7, 450)]


@pytest.mark.parametrize("hot", [1, 3, 50])
@pytest.mark.parametrize("batch", [1, 2, 7, 1000])
def test_shared_anchors_stream(hot, batch):
    rng = random.Random(hot * 100 + batch)
    rows = []
    for h in range(60):
        texts = [(h, d, d % 5 * 1000 + 7, rng.randrange(2)) for d in range(rng.choice([1, 1, 2, 9]))]
        rows += texts + texts[:1] * rng.choice([0, 0, 6])
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    size = range(0, len(rows), batch)
    arrow = (pa.RecordBatch.from_arrays([pa.array(c[k : k + batch]) for c in columns], names=["hash", "doc_id", "digest", "number"]) for k in size)
    got = [tuple(r.values()) for b in suffixes.shared_anchors(hot)(arrow) for r in b.to_pylist()]
    want = {r[1:] for r in rows if len({q[2:] for q in rows if q[0] == r[0]}) > 1}
    assert {g[:3] for g in got} == want
    assert list(suffixes.shared_anchors(hot)(iter([]))) == []


def test_suffix_order():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 50, 300):
        s = rng.integers(97, 99, size)
        rank = suffixes.suffix_ranks(s)
        data = bytes(s.astype(np.uint8))
        want = sorted(range(size), key=lambda i: data[i:])
        assert sorted(range(size), key=lambda i: rank[i]) == want


def test_cleaned_texts_keep_columns_and_characters(spark):
    text = "é" * 120
    df = frame(spark, [(1, text), (2, "x" + text + "tail"), (3, text), (4, None)]).withColumn("n_chars", F.lit(0).cast("long"))
    got = {r.doc_id: r for r in suffixes.clean(df).collect()}
    assert set(got) == {1, 2, 4} and got[2].text in ("xtail", "xétail") and got[2].n_chars == len(got[2].text) and got[2].rep == "clash"
    assert got[4].text is None and suffixes.clean(df).columns == df.columns


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_phrases_of_neighbours(spark, parts):
    docs = [(i * 3, "".join(random.Random(i).choices("ab cdé😀", k=i * 7 % 90))) for i in range(60)] + [(500, None), (501, ""), (None, "null id")]
    out = {r.doc_id: r for r in phrases.neighbours(frame(spark, docs), parts).collect()}
    order = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    assert len(out) == len(docs)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        whole = phrases.edit(text or "", following or "")
        own, new, other = map(phrases.fingerprint, (text, whole, following))
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text or ""), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (phrases.hexed(own), phrases.hexed(new))
        assert (r.near_edited, r.near_next) == (phrases.likeness(own, new), phrases.likeness(own, other))


def test_phrases_alone_and_empty(spark):
    assert phrases.neighbours(frame(spark, [])).count() == 0
    r = phrases.neighbours(frame(spark, [(1, "abcabc")])).first()
    assert r.near_next == 1.0
    assert [tuple(map(bytes, phrases.parse(b"aababc", set())[0]))] == [(b"a", b"ab", b"abc")]


@pytest.mark.parametrize("name", ["op2_minhash_near_dedup", "op7_suffix_array_dedup"])
def test_queries_on_given_table(spark, sf_dir, name):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES[name](spark, sf_dir).collect()
    if name.startswith("op2"):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, 4)
    else:
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == cut(docs)
