"""Near-copy join: pairs of texts whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

MinHash banding finds candidates: bands of r minima, with r as large as the budget of hash
functions allows and b bands such that a pair at the threshold meets in some band with the
target recall. Candidates are verified on the full 5-gram sets of their texts.

Groups may be huge, so pairs within a group are not enumerated. Texts are first folded into
classes of equal texts. In each band bucket the member that meets most others is the hub:

    1. every member is verified against the hubs of its buckets;
    2. verified links are joined into components (large-star and small-star steps);
    3. in buckets that still hold several components, members of different components are
       compared on their full sets: as pairs in buckets of a few members, in larger ones block
       by block within a task, which returns links only.

After that, each two members of a bucket are either in one component or were compared, so a
component is exactly that of the complete graph of similar candidate pairs: no link between
different texts is lost, while a group of n near copies that resemble a hub costs about n
comparisons, and no step emits the pairs of a group.

The links of a text are counted afterwards: all members of a component are compared on their
full sets, block by block, each pair in one task only, and tasks return counts. This takes a
share of n * n of a group of n texts, and is left out where only classes are asked for.

Results: ``class_id`` is the least doc_id of the component, ``text_id`` the least doc_id of
the equal texts, ``n_copies`` their number, ``n_links`` the number of other different texts
of the component that the text is similar to.

Defined results. A text of fewer than five words has one n-gram, all its words. A text
without words (null, empty, white space) is only ever equal to itself: its copies share a
class and have no links. Repeated rows are copies. Null doc_ids form classes like others and
take the id of a non-null copy where there is one. Classes are named by ids, so classes of
different texts with one id, or without ids, have the same name; keep_one_per_class tells them
apart by their texts and keeps one row of each. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from termforge.llm.common import KeyFilter, discard, join_per_key, materialize

N, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 150
#: Buckets of more members than FEW are compared in blocks of about BLOCK members.
FEW, BLOCK = 12, 512
#: N-grams of at most LIGHT members of a block are counted pair by pair, others as matrices of GRAMS columns.
LIGHT, GRAMS = 32, 4_096
_SLICE = 1 << 20
_SIGNATURE = "doc_id long, rid long, digest binary, key long, n_grams long, bands array<long>"


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest chance candidates, within max_hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1.0 - recall) / math.log1p(-(threshold**rows)) - 1e-9))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(words: list[bytes]) -> np.ndarray:
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    own = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return own[codes]


def gram_hashes(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of every n-gram, in text order."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode().split()
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashed = _word_hash(words)
    starts = np.cumsum(counts) - counts
    grams = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), grams)
    first = np.repeat(starts, grams) + (np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams))
    length = np.minimum(counts, n)[doc]
    value = np.zeros(len(doc), np.uint64)
    for k in range(n):
        inside = k < length
        value = np.where(inside, value * np.uint64(0x9E3779B97F4A7C15) + hashed[np.minimum(first + k, len(hashed) - 1)], value)
    return doc, _mix(value)


def signatures(texts: list[str | None], bands: int, rows: int) -> tuple[np.ndarray, list]:
    """Distinct n-grams and band keys of each text."""
    doc, value = gram_hashes(texts)
    sizes = np.zeros(len(texts), np.int64)
    keys: list = [[] for _ in texts]
    if len(doc):
        codes = pd.factorize(value ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[0]
        fresh = np.zeros(codes.max() + 1, np.int64)
        fresh[codes] = doc
        sizes += np.bincount(fresh, minlength=len(texts))
        own = np.unique(doc)
        starts = np.searchsorted(doc, own)
        state = np.random.default_rng(20240229)
        odd = state.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        made = np.empty((len(own), bands), np.int64)
        scratch = np.empty_like(value)
        for b in range(bands):
            key = np.full(len(own), b + 1, np.uint64)
            for r in range(rows):
                np.multiply(value, odd[b * rows + r], out=scratch)
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(scratch, starts))
            made[:, b] = key.view(np.int64)
        for i, d in enumerate(own.tolist()):
            keys[d] = made[i]
    return sizes, keys


def row_id(doc_id, text):
    """A hash by which rows of (doc_id, text) are told apart; rows that repeat both share it."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def sign_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, rid (row_id), digest of the text (and its first 60 bits as key), number of distinct n-grams, band keys."""
    bands, rows = choose_bands(threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, run, size = [], [], 0
            for doc_id, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append((doc_id, rid))
                run.append(text.as_py())
                size += len(run[-1] or "")
                if size >= _SLICE:
                    yield made(ids, run)
                    ids, run, size = [], [], 0
            if ids:
                yield made(ids, run)

    def made(ids: list, texts: list) -> pa.RecordBatch:
        sizes, keys = signatures(texts, bands, rows)
        digests = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
        columns = [
            pa.array([doc_id for doc_id, _ in ids], pa.int64()),
            pa.array([rid for _, rid in ids], pa.int64()),
            pa.array([bytes.fromhex(d[:32]) for d in digests], pa.binary()),
            pa.array([int(d[:15], 16) for d in digests], pa.int64()),
            pa.array(sizes),
            pa.array(keys, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "digest", "key", "n_grams", "bands"])

    own = F.col("doc_id").cast("long").alias("doc_id"), row_id(F.col("doc_id"), F.col("text")).alias("rid"), F.col("text").cast("string").alias("text")
    return docs.select(*own).mapInArrow(sign, _SIGNATURE)


def _gram_set(text: str) -> set:
    words = text.encode().split()
    if len(words) < N:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(N))))


def jaccard(a: str, b: str) -> float:
    """Jaccard similarity of the n-gram sets of two texts (0 where both are without words)."""
    x, y = _gram_set(a), _gram_set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def text_key(text):
    """The key of a text column, as sign_documents gives it."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def _bodies(docs: DataFrame, wanted: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, text) of the texts whose keys are wanted, each once; heads: key and rid of one row with the text.

    Rows that surely aren't wanted are left out in the scan by a key filter, and rows that repeat
    a text are folded before they are moved; so about the wanted texts are shuffled, once.
    """
    found = heads.join(wanted.distinct(), "key", "left_semi")
    found = materialize(found, "ngram-wanted")
    rows = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("rid"), F.col("text").cast("string").alias("text"))
    maybe = KeyFilter(found.select("rid"), "ngram-wanted-filter").mark(rows, F.col("rid"), "maybe").where("maybe")
    texts = maybe.select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    return texts.join(found.select("key"), "key", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    """The keys of pairs (a, b), as key."""
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b"))


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar; texts: key, text, each key once.

    Only texts in some pair are moved. The joins are sort-merge joins on keys, which the
    adaptive planner splits where one text has very many pairs.
    """
    a = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
    both = a.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, set()
        for batch in batches:
            left, right = [], []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                tb = tb.as_py()
                if tb != last_text:
                    last_text, last_set = tb, _gram_set(tb)
                own = _gram_set(ta.as_py())
                common = len(own & last_set)
                if common and common >= threshold * (len(own) + len(last_set) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def linked_in_block(rows: list[tuple[int, int, int, str]], i: int, j: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links between members (key, root, block, text) of blocks i and j that join different roots.

    The overlaps of a member with all others come from an inverted index of the full n-gram
    sets. Roots that have been joined count as one from then on, so fewer links than members
    are returned, and every two similar members end up connected.
    """
    home = {root: root for _, root, _, _ in rows}

    def find(root: int) -> int:
        while home[root] != root:
            home[root] = root = home[home[root]]
        return root

    left = len(home)
    if left < 2:
        return []
    index: dict = {}
    owned, sizes = [], np.zeros(len(rows), np.int64)
    for at, (_, _, _, text) in enumerate(rows):
        own = _gram_set(text)
        sizes[at] = len(own)
        owned.append(own)
        for gram in own:
            index.setdefault(gram, []).append(at)
    postings = {gram: np.array(at) for gram, at in index.items() if len(at) > 1}
    block = np.array([r[2] for r in rows])
    out = []
    for at, (key, root, own_block, _) in enumerate(rows):
        if own_block != i:
            continue
        common = np.zeros(len(rows), np.int64)
        for gram in owned[at]:
            found = postings.get(gram)
            if found is not None:
                common[found] += 1
        similar = (common > 0) & (common >= threshold * (sizes[at] + sizes - common)) & (block == j)
        for y in np.flatnonzero(similar).tolist():
            a, b = find(root), find(rows[y][1])
            if a != b:
                home[a] = b
                out.append((key, rows[y][0]))
                left -= 1
        if left < 2:
            break
    return out


def compare_blocks(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) within each (band, i, j) of members (band, i, j, key, root, own); texts: key, text.

    A large bucket is split into blocks of about BLOCK members, and each pair of blocks is a
    group of its own, so a task holds the texts of two blocks at most and returns links only.
    """
    rows = members.join(texts.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("band", "i", "j", "key", "root", "own", "text")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(at, group):
            found = linked_in_block(group, at[1], at[2], threshold)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        last, group = None, []
        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(6)]
            for band, i, j, key, root, own, text in zip(*plain, batch.column(6)):
                if (band, i, j) != last:
                    if len(group) > 1:
                        yield made(last, group)
                    last, group = (band, i, j), []
                group.append((key, root, own, text.as_py()))
        if len(group) > 1:
            yield made(last, group)

    return dealt.mapInArrow(links, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], n: int) -> np.ndarray:
    """Number of common n-grams of each of left and each of right; sets are arrays of different numbers below n."""
    a, b = (np.repeat(np.arange(len(side)), [len(own) for own in side]) for side in (left, right))
    x, y = (np.concatenate([*side, np.zeros(0, np.int64)]) for side in (left, right))
    order = np.argsort(y, kind="stable")
    b, y = b[order], y[order]
    size = np.bincount(y, minlength=n)
    start = np.cumsum(size) - size
    common = np.zeros((len(left), len(right)), np.int64)

    light = np.flatnonzero((size[x] > 0) & (size[x] <= LIGHT))
    for at in range(0, len(light), 1 << 16):
        own = light[at : at + (1 << 16)]
        times = size[x[own]]
        found = np.repeat(start[x[own]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        common += np.bincount(np.repeat(a[own], times) * len(right) + b[found], minlength=common.size).reshape(common.shape)

    heavy = np.flatnonzero((size > LIGHT) & (np.bincount(x, minlength=n) > 0))
    column = np.full(n, -1)
    column[heavy] = np.arange(len(heavy))
    for at in range(0, len(heavy), GRAMS):
        sides = []
        for member, gram, rows in ((a, x, len(left)), (b, y, len(right))):
            own = np.flatnonzero((column[gram] >= at) & (column[gram] < at + GRAMS))
            sides.append(np.zeros((rows, min(GRAMS, len(heavy) - at)), np.float32))
            sides[-1][member[own], column[gram[own]] - at] = 1.0
        common += (sides[0] @ sides[1].T).astype(np.int64)
    return common


def counts_in_block(rows: list[tuple[int, int, str]], i: int, j: int, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(key, number of similar members of the other block) of the members (key, block, text) of blocks i and j."""
    number: dict = {}
    owned = [np.array([number.setdefault(gram, len(number)) for gram in _gram_set(text)], np.int64) for _, _, text in rows]
    left, right = ([at for at, row in enumerate(rows) if row[1] == block] for block in (i, j))
    common = overlaps([owned[at] for at in left], [owned[at] for at in right], len(number))
    sizes = np.array([len(own) for own in owned])
    similar = (common > 0) & (common >= threshold * (sizes[left][:, None] + sizes[right] - common))
    if i == j:
        np.fill_diagonal(similar, False)
    out = [(rows[at][0], n) for at, n in zip(left, similar.sum(1).tolist())]
    if i != j:
        out += [(rows[at][0], n) for at, n in zip(right, similar.sum(0).tolist())]
    return out


def count_links(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links) of members (key, root, n) of components of n texts; texts: key, text.

    Like compare_blocks, with every pair of a component in one pair of blocks.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "key", "own")
    rows = dealt.join(texts.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("root", "i", "j", "key", "own", "text")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(at, group):
            found = counts_in_block(group, at[1], at[2], threshold)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["key", "n"])

        last, group = None, []
        for batch in batches:
            plain = [batch.column(k).to_pylist() for k in range(5)]
            for root, i, j, key, own, text in zip(*plain, batch.column(5)):
                if (root, i, j) != last:
                    if group:
                        yield made(last, group)
                    last, group = (root, i, j), []
                group.append((key, own, text.as_py()))
        if group:
            yield made(last, group)

    return rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n_links"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the least node reachable.

    Alternates large-star steps (a node's larger neighbours move to its least neighbour) and
    small-star steps (its smaller neighbours and itself do) until the edges no longer change.
    A node's neighbours are never gathered; hubs are joined against their one-row minimum.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )

    def state(e: DataFrame):
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("w", "m")).distinct()
        last, edges = edges, materialize(small, name)
        discard(last)
        before, now = now, state(edges)
        if before == now:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialize(found.union(edges.select("v", "v").toDF("node", "root").distinct()), name)


def link_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(signed documents, classes by digest: key, rid, root, text_id, n_copies, class_id, and n_links if counted), both materialised."""
    signed = materialize(sign_documents(docs, threshold, recall), "ngram-signatures")
    # Equal texts: one class each, with the least id; folded before the shuffle.
    texts = materialize(
        signed.groupBy("digest", "key").agg(
            F.min("doc_id").alias("text_id"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid"),
            F.count(F.lit(1)).alias("n_copies"),
            F.max("n_grams").alias("n_grams"),
        ),
        "ngram-texts",
    )
    heads = texts.where("n_grams > 0").select("key", "rid")
    own = (
        signed.join(heads.toDF("k", "head"), (F.col("rid") == F.col("head")) & (F.col("key") == F.col("k")))
        .dropDuplicates(["key"])
        .select("key", "n_grams", F.explode("bands").alias("band"))
    )
    own = materialize(own, "ngram-bands")
    shared = own.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(own.join(shared, "band"), "ngram-members")

    reach = members.groupBy("key").agg(F.sum("size").alias("reach"))
    hubs = (
        members.join(reach, "key")
        .groupBy("band")
        .agg(F.max(F.struct("reach", "key", "n_grams")).alias("hub"))
        .select("band", F.col("hub.key").alias("hub"), F.col("hub.n_grams").alias("hub_grams"))
    )

    def close(x: str, y: str):
        # Sets whose sizes differ more than the threshold allows can't be similar.
        return F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)

    stars = (
        members.join(hubs, "band")
        .where((F.col("key") != F.col("hub")) & close("n_grams", "hub_grams"))
        .select(F.col("key").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )
    stars = materialize(stars, "ngram-stars")
    star_links = materialize(verify(stars, _bodies(docs, _ends(stars), heads), threshold), "ngram-links")
    roots = components(star_links)

    placed = members.join(roots, members["key"] == roots["node"], "left").select("band", "key", "n_grams", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    placed = materialize(placed.join(mixed, "band"), "ngram-mixed")
    size = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    sized = placed.join(size, "band")

    # Buckets of a few members: their pairs, as rows.
    few = sized.where(F.col("n") <= FEW).select("band", "key", "n_grams", "root")
    other = few.select("band", F.col("key").alias("x"), F.col("n_grams").alias("x_grams"), F.col("root").alias("x_root"))
    rest = (
        few.join(other, "band")
        .where((F.col("key") > F.col("x")) & (F.col("root") != F.col("x_root")) & close("n_grams", "x_grams"))
        .select(F.col("key").alias("a"), F.col("x").alias("b"))
        .distinct()
    )
    seen = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = materialize(rest.join(seen, ["a", "b"], "left_anti"), "ngram-rest")

    # Larger ones: block against block.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    many = sized.where(F.col("n") > FEW).withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    many = many.select("band", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "key", "root", "own")
    bodies = _bodies(docs, _ends(rest).union(many.select("key")), heads)
    rest_links = materialize(verify(rest, bodies, threshold).union(compare_blocks(many, bodies, threshold)), "ngram-links")
    links = star_links.union(rest_links)
    roots = components(links)

    placed = texts.join(roots, texts["key"] == roots["node"], "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min("text_id").alias("class_id")).withColumnRenamed("root", "r")
    classes = placed.join(named, placed["root"] == named["r"]).select("digest", "key", "rid", "root", "text_id", "n_copies", "class_id")
    if counted:
        # The two texts of a component of two have one link; larger components are compared in full.
        large = materialize(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "ngram-large")
        linked = join_per_key(roots.select(F.col("node").alias("key"), "root"), large, ["root"])
        linked = materialize(linked, "ngram-linked")
        crowd = linked.where("n is not null")
        bodies = _bodies(docs, crowd.select("key"), heads)
        degree = linked.where("n is null").select("key", F.lit(1).cast("long").alias("n_links")).union(count_links(crowd, bodies, threshold))
        classes = classes.join(degree.withColumnRenamed("key", "linked"), F.col("key") == F.col("linked"), "left")
        classes = classes.select("digest", "key", "root", "text_id", "n_copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "rid", "digest", "key"), materialize(classes, "ngram-classes")


def link_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links of every document."""
    signed, classes = link_texts(docs, threshold, recall)
    # A third of all rows may be copies of one text: digests are joined (the planner splits a hot one).
    return signed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each component, with all columns: that with the least id (of rows that repeat it, one).

    Two key filters, of the rows that stay and of those that go, decide nearly all rows in the
    scan; only rows that both may hold are moved, to be decided exactly.
    """
    signed, classes = link_texts(docs, threshold, recall, counted=False)
    first = F.struct(F.col("text_id").isNull(), F.col("text_id"), F.col("key"), F.col("rid"))
    kept = classes.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.rid").alias("kept_rid"), F.col("first.key").alias("kept_key"))
    kept = materialize(kept, "ngram-kept")
    # Rows that go: those of other texts, other ids, and all of a kept row that repeats, so that it is folded below.
    rows_of = signed.groupBy("rid", "key").agg(F.count(F.lit(1)).alias("n"))
    sole = kept.select(F.col("kept_rid").alias("rid"), F.col("kept_key").alias("key"))
    gone = rows_of.join(sole, ["rid", "key"], "left_anti").select("rid").union(rows_of.where("n > 1").select("rid"))
    nested = docs.select(F.struct(*docs.columns).alias("row"), row_id(F.col("doc_id"), F.col("text")).alias("rid"))
    marked = KeyFilter(kept.select("kept_rid"), "ngram-kept-filter").mark(nested, F.col("rid"), "stays")
    marked = KeyFilter(gone, "ngram-gone-filter").mark(marked, F.col("rid"), "goes")
    sure = marked.where("stays and not goes").select("row.*")
    open_rows = marked.where("stays and goes").withColumn("key", text_key(F.col("row.text")))
    settled = open_rows.join(kept, (F.col("rid") == F.col("kept_rid")) & (F.col("key") == F.col("kept_key")))
    return sure.union(settled.dropDuplicates(["kept_key"]).select("row.*"))
