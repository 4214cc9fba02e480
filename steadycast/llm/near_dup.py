"""Near-duplicate documents by an inverted join of signature coordinates.

Each document's set of word shingles gets a MinHash signature of ``COORDINATES`` numbers. A
number at its place is a coordinate-value pair, and two documents are candidates when they agree
in ``MATCHES`` places or more. Documents with equal sets are one to begin with. The rest is
posted under its pairs in order of rarity: two documents that agree in ``MATCHES`` places must
meet under one of their ``COORDINATES - MATCHES + 1`` rarest, so the common pairs are skipped.

A list is not expanded into its pairs. It is cut into blocks, agreements are counted between
the documents of two blocks at a time, and only a spanning forest of the best candidates is
confirmed first; confirmed links join into components. Pairs within a component are skipped from
then on. What still agrees often enough between two components is then confirmed in full. Such a
candidate is given out once, by the first place under which both documents are posted. It is packed by blocks of
a large component, and by the blocks of the list in which it meets otherwise, so that a text is sent
to a block once and not to each of its pairs, and a block of a list gives no more rows than it has documents
for each block of a large component. Every link is confirmed on the full sets.

Two sets of Jaccard index 0.8 agree in fewer than 36 of 64 places in about 3 of a million cases;
that is the only way to lose a link, and only if no other link connects the two.

Defined cases. A null or empty text has no shingles and is linked with nothing. Fewer words
than a shingle make one shingle. Null ids count as the least id. Texts that share an
id are told apart by a digest. Repeated rows have equal sets
and fall together. An empty table gives an empty table. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadycast.llm import charlm
from steadycast.llm.common import WordHashes, mix64, store, utf8
from steadycast.llm.components import components

COORDINATES, MATCHES = 64, 36
LEAST_ID = -(2**63)
_SEED = np.random.default_rng(20240229)
_FACTORS = _SEED.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _SEED.integers(0, 2**63, COORDINATES, dtype=np.uint64)
SIGNED = "doc_id long, mark long, n long, set_a long, set_b long, sig array<int>"


def shingles(texts: list[str], size: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts on end, sorted within a text, and their numbers."""
    split = [utf8(t).lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.array([known[w] for ws in split for w in ws], dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    count = max(len(words) - size + 1, 0)
    key = np.full(count, np.uint64(size))
    for k in range(size):
        key = mix64(key + words[k : count + k] * np.uint64(2 * k + 1))
    inside = np.flatnonzero(doc[:count] == doc[size - 1 :]) if count else np.empty(0, np.int64)
    key, doc = key[inside], doc[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    extra = np.empty(len(short), np.uint64)
    for i, d in enumerate(short):
        h = np.full(1, np.uint64(sizes[d]))
        for k in range(sizes[d]):
            h = mix64(h + words[starts[d] + k : starts[d] + k + 1] * np.uint64(2 * k + 1))
        extra[i] = h[0]
    key, doc = np.concatenate([key, extra]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[first], doc[first]
    return key, np.bincount(doc, minlength=len(texts))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def sign(docs: DataFrame, size: int) -> DataFrame:
    """Number of shingles, digest of the set, and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in charlm.chunks(texts):
                keys, n = shingles(texts[a:b], size, known)
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                digest = np.zeros((2, b - a), np.uint64)
                sig = np.zeros((b - a, COORDINATES), np.uint32)
                if len(full):
                    digest[0, full] = _sums(mix64(keys), starts)
                    digest[1, full] = _sums(mix64(keys ^ np.uint64(0x5BD1E9955BD1E995)), starts)
                    for c in range(COORDINATES):
                        v = ((keys * _FACTORS[c] + _OFFSETS[c]) >> np.uint64(32)).astype(np.uint32)
                        sig[full, c] = np.minimum.reduceat(v, starts)
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n), *(pa.array(d.view(np.int64)) for d in digest),
                        pa.ListArray.from_arrays(offsets, pa.array(sig.ravel().view(np.int32))),
                    ],
                    names=["doc_id", "mark", "n", "set_a", "set_b", "sig"],
                )

    return docs.select("doc_id", "text", "mark").mapInArrow(run, SIGNED)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` without nulls, ``text``, and ``mark``: rows of one id are told apart by a digest of the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.col("text").cast("string"), mark_of(F.col("text")).alias("mark")
    )


def mark_of(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def postings(sets: DataFrame) -> DataFrame:
    """(token, rep, places): each set under its rarest coordinate-value pairs, and the bits of their places."""
    tokens = sets.select(
        "rep", F.posexplode(F.slice("sig", 1, COORDINATES)).alias("place", "value")
    ).select("rep", F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = tokens.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    # Pairs that nobody else has are the rarest; they fill the first places of the prefix.
    room = COORDINATES - MATCHES + 1 - (COORDINATES - F.size("t"))
    rare = met.where(room > 0).select("rep", F.expr(f"slice(t, 1, size(t) - {MATCHES - 1})").alias("t"))
    places = F.aggregate("t.token", F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 32).cast("int"))))
    return rare.select(F.explode("t.token").alias("token"), "rep", places.alias("places"))


def confirm(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, percent: int, block: int = 500, few: int = 200_000) -> DataFrame:
    """The pairs (a, b) of ``sets`` that are links on their full sets; ``docs`` is ``keyed``.

    Texts go to the groups of their ``b``; the members of a group are cut into blocks of about
    ``block``, each of which gets the text of ``b``. Ids are broadcast up to ``few`` of them, more
    are joined by a shuffle.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = pairs.join(blocks, "b").select(
        F.col("a").alias("rep"), "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("part"), F.lit(1).alias("member")
    )
    heads = blocks.select(
        F.col("b").alias("rep"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"), F.lit(0).alias("member")
    )
    wanted = store(members.unionByName(heads).join(sets.select("rep", "doc_id", "mark"), "rep"), "pairs")
    ids = F.broadcast(wanted) if wanted.count() <= few else wanted
    dealt = docs.join(ids, ["doc_id", "mark"]).repartition("b", "part").sortWithinPartitions("b", "part", "member", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group, head = WordHashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            rows = batch.to_pydict()
            texts = [t or "" for t in rows["text"]]
            links = []
            for start, stop in charlm.chunks(texts):
                keys, n = shingles(texts[start:stop], size, known)
                ends = np.cumsum(n)
                for k in range(start, stop):
                    own = keys[ends[k - start] - n[k - start] : ends[k - start]]
                    at = (rows["b"][k], rows["part"][k])
                    if not rows["member"][k]:
                        if at != group:
                            group, head = at, own.copy()
                    elif at == group:
                        common = len(np.intersect1d(own, head, assume_unique=True))
                        if common and 100 * common >= percent * (len(own) + len(head) - common):
                            links.append((rows["rep"][k], at[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

    return dealt.select("rep", "text", "b", "part", "member").mapInArrow(run, "a long, b long")


def agreements(sig: np.ndarray, n: np.ndarray, rows: np.ndarray, percent: int) -> np.ndarray:
    """Numbers of equal coordinates of the chosen rows with all rows; 0 where sizes forbid a link."""
    out = np.zeros((len(rows), len(sig)), np.uint8)
    for c in range(sig.shape[1]):
        column = np.ascontiguousarray(sig[:, c])
        out += column[rows][:, None] == column[None, :]
    low, high = np.minimum(n[rows][:, None], n[None, :]), np.maximum(n[rows][:, None], n[None, :])
    out[100 * low < percent * high] = 0
    return out


def forest(same: np.ndarray, label: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges of a maximum spanning forest of the candidates; rows of one label are joined already."""
    weight = same.astype(np.int16)
    weight[weight < MATCHES] = -1
    weight[label[:, None] == label[None, :]] = COORDINATES + 1
    count, found = len(label), []
    best, source = np.full(count, -1, np.int16), np.zeros(count, np.int64)
    waiting = np.ones(count, bool)
    for _ in range(count):
        at = int(np.argmax(np.where(waiting, best, -2)))
        if 0 <= best[at] <= COORDINATES:
            found.append((int(source[at]), at, int(best[at])))
        waiting[at] = False
        closer = waiting & (weight[at] > best)
        best[closer], source[closer] = weight[at][closer], at
    return found


PAIRS = "a long, b long"
GROUPED = "label long, block long, share long, a long, others array<long>"


def residual(posted: DataFrame, sets: DataFrame, percent: int, shares: int | None, block: int = 700, bulk: int = 500) -> DataFrame:
    """Candidates of different labels from lists that hold several labels.

    ``posted``: (token, rep, places, label, members), the last being the size of the label. A list is cut
    into blocks, and each pair of its blocks is one group, so a group is bounded.

    Without ``shares``: pairs (a, b), a spanning forest of the candidates of each group. With it:
    all candidates, each once, packed by document as ``GROUPED``. Those of ``a`` in a label of more than ``bulk``
    documents are packed by a block of this label, documents like ``a`` being dealt out to ``shares`` shares;
    all others by their group, whose name is its token and, below 0 and so unlike a block, its blocks.
    """
    lists = posted.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x != y")
    lists = lists.select("token", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = posted.join(lists, "token").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A group for each pair of blocks; a list of one block is paired with itself.
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("own"))
    )
    rows = rows.select("token", "rep", "label", "members", "places", "own", F.explode(others).alias("other"))
    rows = rows.join(sets.select("rep", "n", "sig"), "rep").select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label", "n", "members", "places", "own", "sig"
    )

    def large(rep: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Candidates of one group as pairs of its rows."""
        if shares is None:
            found = forest(agreements(sig, n, np.arange(len(rep)), percent), label)
            return np.array([(x, y) for x, y, _ in found], np.int64).reshape(-1, 2).T
        names, back, counts = np.unique(label, return_inverse=True, return_counts=True)
        # Pairs within the largest label need no look; every other pair has a row outside it.
        outside = back != np.argmax(counts)
        few = np.flatnonzero(outside)
        found = [np.zeros((2, 0), np.int64)]
        for start in range(0, len(few), 256):
            part = few[start : start + 256]
            hit = (agreements(sig, n, part, percent) >= MATCHES) & (label[part][:, None] != label[None, :])
            # Two rows outside it meet twice.
            hit &= ~outside[None, :] | (part[:, None] < np.arange(len(rep))[None, :])
            x, y = np.nonzero(hit)
            found.append(np.stack([part[x], y]))
        return np.concatenate(found, axis=1)

    def small(starts: np.ndarray, size: int, rep: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[np.ndarray]:
        """Candidates of many groups of one small size at a time."""
        for x in range(size):
            for y in range(x + 1, size):
                a, b = starts + x, starts + y
                use = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                a, b = a[use], b[use]
                hit = (sig[a] == sig[b]).sum(axis=1) >= MATCHES
                yield np.stack([a[hit], b[hit]])

    def owned(keys: list[np.ndarray], pairs: np.ndarray, places: np.ndarray, own: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Of candidates those that no other group gives: a pair belongs to the first place under which both rows are
        posted, and, with both in one block, to the first pair of blocks."""
        token, i, j = (k[pairs[0]] for k in keys)
        one = own[pairs[0]]
        use = (one != own[pairs[1]]) | (i == 0) & ((one == j) | (j <= 1))
        pairs, place, kept = pairs[:, use], token[use] >> 32, []
        for start in range(0, pairs.shape[1], 1 << 16):
            x, y = pairs[:, start : start + (1 << 16)]
            both = (places[x] & places[y]).view(np.uint64)
            met = (sig[x] == sig[y]) & (both[:, None] >> np.arange(COORDINATES, dtype=np.uint64) & np.uint64(1)).astype(bool)
            kept.append(met.argmax(axis=1) == place[start : start + (1 << 16)])
        return pairs[:, np.concatenate(kept)] if kept else pairs

    def solve(keys: list[np.ndarray], columns: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(keys[0]), bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(change)))
        rep, label, n, members, places, own, sig = columns
        take = lambda pairs: pairs if shares is None else owned(keys, pairs, places, own, sig)
        parts = [np.zeros((2, 0), np.int64)]
        for size in np.unique(sizes):
            heads = starts[sizes == size]
            if 1 < size <= 12:
                parts += map(take, small(heads, size, rep, label, n, sig))
            elif size > 12:
                parts += [take(large(*(c[at : at + size] for c in (rep, label, n, sig))) + at) for at in heads]
        x, y = np.concatenate(parts, axis=1)
        if shares is None:
            out = np.unique(np.stack([np.maximum(rep[x], rep[y]), np.minimum(rep[x], rep[y])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b"])
        # The end in the larger label gives the block, so that its members are gathered once.
        swap = (members[x] > members[y]) | (members[x] == members[y]) & (label[x] > label[y])
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        spread = lambda ids, parts: (mix64(ids.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        whole = members[y] > bulk
        names = np.where(whole, label[y], keys[0][x])
        blocks = np.where(whole, spread(rep[y], np.maximum(-(-members[y] // 500), 1)), -1 - keys[1][x].astype(np.int64))
        share = np.where(whole, spread(rep[x], np.full(len(x), shares, np.int64)), keys[2][x])
        out = np.stack([names, blocks, share, rep[x]])
        order = np.lexsort((rep[y], *out[::-1]))
        out, others = out[:, order], rep[y][order]
        heads = np.flatnonzero(np.append(True, (out[:, 1:] != out[:, :-1]).any(axis=0))[: len(others)])
        others = pa.ListArray.from_arrays(pa.array(np.append(heads, len(others)).astype(np.int32)), pa.array(others))
        return pa.RecordBatch.from_arrays([*(pa.array(c[heads]) for c in out), others], names=["label", "block", "share", "a", "others"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column(9).flatten().to_numpy().reshape(-1, COORDINATES)
            held.append([*(batch.column(c).to_numpy() for c in range(9)), sig])
            waiting += batch.num_rows
            if waiting < 20_000:
                continue
            joined = [np.concatenate(c) for c in zip(*held)]
            # The last group may go on in the next batch.
            last = joined[0] != joined[0][-1]
            for k in (1, 2):
                last |= joined[k] != joined[k][-1]
            cut = len(last) - int(np.argmax(last[::-1])) if last.any() else 0
            if cut:
                yield solve([c[:cut] for c in joined[:3]], [c[:cut] for c in joined[3:]])
            held, waiting = [[c[cut:] for c in joined]], len(last) - cut
        if waiting:
            joined = [np.concatenate(c) for c in zip(*held)]
            yield solve(joined[:3], joined[3:])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "rep")
    if shares is None:
        return dealt.mapInArrow(merge, PAIRS).distinct()
    key = ["label", "block", "share", "a"]
    packed = dealt.mapInArrow(merge, GROUPED).groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    return packed


def confirm_grouped(docs: DataFrame, sets: DataFrame, packed: DataFrame, size: int, percent: int, few: int = 200_000) -> DataFrame:
    """The links (a, b) among packed candidates, on their full sets.

    A group gets the texts of a share of documents and of one block of a label, or of two blocks of a list, each once.
    """
    group = ["label", "block", "share"]
    heads = packed.select(*group, F.col("a").alias("rep"), "others")
    members = packed.groupBy(*group).agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("m"))
    members = members.select(*group, F.explode("m").alias("rep"), F.lit(None).cast("array<long>").alias("others"))
    wanted = store(heads.unionByName(members).join(sets.select("rep", "doc_id", "mark"), "rep"), "groups")
    ids = F.broadcast(wanted) if wanted.count() <= few else wanted
    dealt = docs.join(ids, ["doc_id", "mark"]).select(*group, "rep", "text", "others").repartition(*group).sortWithinPartitions(*group)

    def links(sets: dict[int, np.ndarray], asked: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
        out = []
        for a, others in asked:
            own = sets[a]
            for b in others:
                common = len(np.intersect1d(own, sets[b], assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(sets[b]) - common):
                    out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, sets, asked = WordHashes(), None, {}, []
        for batch in batches:
            rows = batch.to_pydict()
            texts, done = [t or "" for t in rows["text"]], []
            for start, stop in charlm.chunks(texts):
                keys, n = shingles(texts[start:stop], size, known)
                ends = np.cumsum(n)
                for k in range(start, stop):
                    at = (rows["label"][k], rows["block"][k], rows["share"][k])
                    if at != now:
                        done += links(sets, asked)
                        now, sets, asked = at, {}, []
                    sets[rows["rep"][k]] = keys[ends[k - start] - n[k - start] : ends[k - start]].copy()
                    if rows["others"][k]:
                        asked.append((rows["rep"][k], rows["others"][k]))
            yield _links(done)
        yield _links(links(sets, asked))

    return dealt.mapInArrow(run, PAIRS)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, label) after links (a, b) between labels have joined them."""
    joined = components(links).select(F.col("node").alias("label"), F.col("component"))
    return labels.join(joined, "label", "left").select("rep", F.coalesce("component", "label").alias("label"))


def group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked when their sets of ``size``-word shingles have a Jaccard index of
    ``percent`` hundredths or more; a component is named by its least id, and that one is kept.
    Of several texts with this id the one of the least mark is kept.
    """
    return marked(docs, size, percent).drop("mark")


def marked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The columns of ``group``, and ``mark`` of the text."""
    texts = keyed(docs)
    signed = store(sign(texts, size), "signed")
    key = ["set_a", "set_b", "n"]
    sets = signed.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "sig")).alias("d"))
    # A set has a number of its own, as ids may be shared by unlike texts.
    number = F.monotonically_increasing_id().alias("rep")
    sets = store(sets.select(number, F.col("d.doc_id").alias("doc_id"), F.col("d.mark").alias("mark"), "n", F.col("d.sig").alias("sig"), "set_a", "set_b"), "sets")
    posted = store(postings(sets), "postings")

    labels = store(sets.select("rep", F.col("rep").alias("label")), "labels")
    # Lists of similar documents are many times the same, so two of each document's come first.
    chosen = Window.partitionBy("rep").orderBy(F.xxhash64("token"))
    some = posted.withColumn("k", F.row_number().over(chosen)).where("k <= 2").drop("k")

    def labelled(lists: DataFrame) -> DataFrame:
        sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
        return lists.join(labels.join(sizes, "label"), "rep")

    def joined(links: DataFrame) -> DataFrame:
        x, y = (labels.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        links = links.join(x, "a").join(y, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        return store(relabel(labels, links), "labels")

    for lists in (some, posted):
        pairs = store(residual(labelled(lists), sets, percent, None), "candidates")
        if pairs.isEmpty():
            continue
        labels = joined(confirm(texts, sets, pairs, size, percent))
    shares = -(-sets.count() // 50_000) or 1
    packed = store(residual(labelled(posted), sets, percent, shares), "candidates")
    if not packed.isEmpty():
        labels = joined(confirm_grouped(texts, sets, packed, size, percent))

    of_set = sets.select(*key, "rep", "doc_id", "mark").join(labels, "rep")
    heads = of_set.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("head"))
    of_set = of_set.join(heads, "label").select(*key, "head")
    out = signed.select("doc_id", "mark", *key).join(of_set, key, "left")
    own = F.struct("doc_id", "mark")
    head = F.coalesce("head", own)
    back = lambda c: F.nullif(c, F.lit(LEAST_ID))
    return out.select(
        back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(head["doc_id"]).alias("component_id"),
        (own == head).alias("kept"), "mark",
    )
