"""License scans, hard negatives and periodic runs against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from termforge.llm import hardnegatives, licenses, periodicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, runs int, at string, label string, row long"


# periodic runs ------------------------------------------------------------------------------
def slow_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period is compared along the whole text; a stretch's smallest period is its own."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looped_words(r: random.Random) -> list[bytes]:
    n = r.randint(0, 160)
    words = [b"%d" % r.randrange(r.choice([1, 2, 3, 10])) for _ in range(n)]
    if n and r.random() < 0.7:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return words


def test_runs_match_brute_force():
    r = random.Random(1)
    for _ in range(150):
        texts = [looped_words(r) for _ in range(r.randint(1, 7))]
        assert periodicity.find(texts) == [slow_runs(t) for t in texts]


def test_classes_are_equal_factors():
    r = random.Random(2)
    words = [r.randrange(2) for _ in range(90)]
    codes = np.array([*[w + 1 for w in words], 0])
    partition = periodicity.Partition(codes, np.zeros(91, np.int64), np.full(91, 91))
    more = True
    while more:
        factors: dict = {}
        for i in range(91 - partition.length):
            factors.setdefault(tuple(words[i : i + partition.length]), set()).add(i)
        by_class: dict = {}
        for i in range(91 - partition.length):
            by_class.setdefault(int(partition.cls[i]), set()).add(i)
        assert sorted(map(sorted, factors.values())) == sorted(map(sorted, by_class.values()))
        more = partition.refine()


def test_long_periodic_texts_end():
    words = [b"%d" % (i % 4_001) for i in range(20_000)]
    assert periodicity.find([words, [b"a"] * 30_000]) == [[(0, 20_000, 4_001)], [(0, 30_000, 1)]]


def slow_digest(doc_id: int | None, text: str | None) -> tuple:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)), n)


def test_digests_with_edges(spark):
    r = random.Random(3)
    texts = [None, "", " \t\n", "one", "la " * 23, "la " * 24, "la " * 25, "a b " * 13 + "c", "x\x1cy\x85z " * 30, "é 漢 😀 " * 20, ("w " * 30 + "\n") * 3, "A a " * 20]
    rows = [(i, t, 1, "x", "y", 2) for i, t in enumerate(texts)] + [(None, "b " * 40, 1, None, None, None)] * 2
    loops = [i for i in range(4_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows += [(i, " ".join(str(r.randrange(50)) for _ in range(r.randint(0, 300))), None, None, None, None) for i in [*loops, *loops[:3]]]
    got = periodicity.digest_runs(spark.createDataFrame(rows, DOCS).repartition(3))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((slow_digest(a, b) for a, b, *_ in rows), key=key)
    assert periodicity.digest_runs(spark.createDataFrame([], DOCS)).count() == 0


# license scans ------------------------------------------------------------------------------
def slow_labels(text: str | None) -> tuple:
    """All blocks against all templates, counted in full."""
    paragraphs = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in p)) for p in re.split(r"\n[ \t\r]*\n", text or "")]
    words = [w for p in paragraphs for w in p]
    starts, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                starts.append(i)
                base.add(label)
    labels, best, matches = set(base), 0.0, 0
    for p in paragraphs:
        for first in range(0, max(len(p) - 64, 1), 64):
            block = p[first : first + 128]
            for t in licenses.TEMPLATES:
                own, need = set(t.text.split()), math.ceil(0.85 * len(set(t.text.split())) - 1e-9)
                width = 2 * len(t.text.split())
                shares = [len(own & set(w)) for e in range(len(block)) for w in [block[max(0, e + 1 - width) : e + 1]] if len(own & set(w)) >= need and set(t.keys) <= set(w)]
                if shares:
                    labels.add(t.label)
                    best, matches = max(best, max(shares) / len(own)), matches + 1
    n = len(starts)
    return len(words), n, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if n else best, matches


def license_texts() -> list:
    r = random.Random(4)
    texts = [None, "", "\n\n", "MIT", "mit license", "Mit Lizenz der License", "Licensed under CC BY-NC 4.0.", "cc by cc by-sa", "gnu General-PUBLIC license", "GNU general\n\npublic license", "apache_license x", "ß mit license é"]
    plain = ["der", "mit", "und", "the", "of", "under", "license", "public", "software", "any", "gnu", "apache", "to"]
    for t in licenses.TEMPLATES:
        own = t.text.split()
        for lost in (0, 1, 2, len(own) // 6 + 1):
            kept = [w for i, w in enumerate(own) if i not in set(r.sample(range(len(own)), min(lost, len(own))))]
            for before in (0, 50, 63, 64, 100, 127):
                texts.append(" ".join([r.choice(plain) for _ in range(before)] + [w.upper() if r.random() < 0.2 else w for w in kept] + [r.choice(plain) for _ in range(r.randrange(90))]).replace(" of ", ",\n", 1))
    texts += [" ".join(r.choice(plain) for _ in range(r.randrange(400))) for _ in range(60)]
    return texts


def test_labels_match_all_pairs(spark):
    rows = [(i, t, 1, "x", "y", 2) for i, t in enumerate(license_texts())] + [(None, "Released under the MIT License.", 1, None, None, None)] * 2
    got = licenses.label_documents(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    want = [(i, *slow_labels(t)) for i, t, *_ in rows]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key)
    assert sum(x["labels"] != x["base_labels"] for x in got) > 100  # the templates add labels
    assert licenses.label_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_filters_lose_no_pair():
    """Prefix, length and positional filters keep every pair at the threshold, under any frequencies."""
    r = random.Random(5)
    letters = [chr(97 + i) for i in range(20)]
    for _ in range(200):
        templates = [licenses.Template(str(i), " ".join(r.sample(letters, r.randint(1, 12))), ()) for i in range(5)]
        vocabulary = licenses.Vocabulary(templates, {})
        index = licenses.Index(vocabulary, {k: r.randrange(30) for k in vocabulary.number.values()}, r.choice([0.5, 0.7, 0.85, 1.0]))
        held = set(r.sample(sorted(vocabulary.number.values()), r.randint(1, len(vocabulary.number))))
        want = {t for t, own in enumerate(vocabulary.sets) if len(own & held) >= index.need[t]}
        assert want <= (index.candidates(held) if len(held) >= index.least else set())


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.Vocabulary([licenses.Template("x", " ".join(f"w{i}" for i in range(70)), ())], {})
    with pytest.raises(ValueError):
        licenses.Vocabulary([licenses.Template("x", "a b " * 20_000, ())] * 2, {})


# hard negatives -----------------------------------------------------------------------------
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long, row string"


def slow_negatives(rows: list, n_positives: int = 5, n_negatives: int = 10) -> list[tuple]:
    kept = []
    for vec_id, embedding, label, *_ in rows:
        if label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in embedding]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1])
    for k, (vec_id, label, v) in enumerate(kept):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, own == label) for m, (other, own, w) in enumerate(kept) if m != k]
        for p, positive, _ in sorted((s for s in scored if s[2]), key=order)[:n_positives]:
            inside = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:n_negatives]
            out += [(vec_id, positive, rank, negative, p, s) for rank, (s, negative, _) in enumerate(inside, 1)]
    return out


def clustered(seed: int, n: int, dim: int = 6) -> list[tuple]:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return [(i * 5, [float(x) for x in np.round(centres[i % 12] + 0.15 * r.normal(size=dim), 2).astype(np.float32)], int(i // 3 % 10), 1, "x") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_match_all_pairs(spark, seed, monkeypatch):
    """Clustered vectors, ties, repeated rows and ids, one very common vector; small lists, blocks and packs, so that all rounds are walked."""
    monkeypatch.setattr(hardnegatives, "BLOCK", 40)
    monkeypatch.setattr(hardnegatives, "PACK", 3)
    monkeypatch.setattr(hardnegatives, "FIRST_LISTS", 2)
    monkeypatch.setattr(hardnegatives, "GROWTH", 3)
    rows = clustered(seed, 420)
    rows += [(10_000 + i, [0.5, -0.25, 0.125, 0.0, 0.5, 0.1], i % 3, None, None) for i in range(150)]  # one vector, many ids
    rows += [(7_000, [0.3, 0.1, 0.0, 0.0, 0.2, 0.4], 4, None, None)] * 3  # repeated anchors
    rows += [(None, [0.4] * 6, 2, 1, "x"), (11_000, None, 1, 1, "x"), (11_100, [0.1] * 6, None, 1, "x"), (11_200, [0.1, None, 0.1, 0.1, 0.1, 0.1], 3, 1, "x")]
    rows += [(11_300, [float("nan")] * 6, 3, 1, "x"), (11_400, [float("inf")] + [0.0] * 5, 3, 1, "x"), (11_500, [0.0] * 6, 5, 1, "x"), (11_600, [], 6, 1, "x"), (11_700, [0.5, 0.5], 6, 1, "x"), (11_800, [-1.0] * 6, 99, 1, "x")]
    got = hardnegatives.mine_embeddings(spark.createDataFrame(rows, EMBEDDINGS).repartition(3))
    key = lambda x: tuple((v is None, v) for v in x)
    want = slow_negatives(rows)
    assert len(want) > 200 and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("chunk, times", [(3, 1.0), (6, 3e3), (1_000, 2e5)])
def test_negatives_of_many_chunks_and_large_components(spark, monkeypatch, chunk, times):
    """Anchors sent in several parts; scores in float32, in float64 and in whole numbers."""
    monkeypatch.setattr(hardnegatives, "CHUNK", chunk)
    rows = [(i, [x * times for x in v], label, score, row) for i, v, label, score, row in clustered(4, 240)]
    got = hardnegatives.mine_embeddings(spark.createDataFrame(rows, EMBEDDINGS).repartition(3))
    want = slow_negatives(rows)
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == sorted(want)


def test_negatives_of_empty_tables(spark):
    assert hardnegatives.mine_embeddings(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    assert hardnegatives.mine_embeddings(spark.createDataFrame([(1, [1.0], 1, 1, "x")], EMBEDDINGS)).count() == 0
    assert hardnegatives.mine_embeddings(spark.createDataFrame([(100, [1.0], 1, 1, "x")], EMBEDDINGS)).count() == 0


def test_bounds_hold_and_skip():
    r = np.random.default_rng(6)
    centres = r.integers(-2_000, 2_000, (30, 8))
    members = np.concatenate([c + r.integers(-40, 40, (50, 8)) for c in centres])
    near, far = hardnegatives.nearest_centroid(members, centres)
    radii = np.array([far[near == k].max(initial=0) for k in range(30)])
    lists = hardnegatives.Lists(centres, radii, np.ones(30, np.int64), "<i8")
    anchors = members[::37]
    low, high = lists.bounds(anchors)
    scores = hardnegatives.products(anchors, members)
    for k in range(30):
        assert (scores[:, near == k] <= high[:, k][:, None]).all() and (scores[:, near == k] >= low[:, k][:, None]).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (high < tenth[:, None]).mean() > 0.8  # most lists end the search unseen


def test_negatives_of_a_large_table_without_clusters(spark, tmp_path):
    """Vectors that no list can be skipped for, 1.2 billion pairs: in seconds, by plain scores of some anchors."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    n, r = 350_000, np.random.default_rng(9)
    x = r.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    label = r.integers(0, 10, n)
    columns = [pa.array(np.arange(n)), pa.ListArray.from_arrays(np.arange(0, 64 * n + 1, 64, dtype=np.int32), pa.array(x.ravel())), pa.array(label.astype(np.int32))]
    pq.write_table(pa.table(columns, names=["vec_id", "embedding", "label"]), tmp_path / "e.parquet", row_group_size=n // 8)
    began = time.time()
    got = hardnegatives.mine_embeddings(spark.read.parquet(str(tmp_path / "e.parquet"))).toPandas()
    assert time.time() - began < 80  # all of this test took 123 s before anchors were sent to the blocks
    label, whole = np.where(np.arange(n) % 7 == 0, (label + 1) % 10, label), np.floor(256 * x.astype(float))
    assert got["anchor_id"].nunique() == n // 100
    for anchor in range(0, n, 25_000):
        score = (whole @ whole[anchor]).astype(int)
        order = np.lexsort((np.arange(n), -score))
        order = order[order != anchor]
        same = label[order] == label[anchor]
        want = []
        for p in order[same][:5]:
            s = score[order]
            inside = order[~same & (30 * score[p] <= 100 * s) & (100 * s <= 90 * score[p])][:10]
            want += [(anchor, p, rank, m, score[p], score[m]) for rank, m in enumerate(inside, 1)]
        own = got[got["anchor_id"] == anchor].itertuples(index=False, name=None)
        assert sorted(own) == sorted(want) and len(want) == 50


def test_scores_are_exact_where_float32_is_used():
    """Components up to the bound of the number type give whole scores."""
    assert [hardnegatives.exact_kind(x) for x in (2.0**24 - 1, 2.0**24, 2.0**53)] == [np.float32, np.float64, np.int64]
    r = np.random.default_rng(3)
    a = r.integers(-511, 512, (50, 63))  # norms under 4,096
    assert (a.astype(np.float32) @ a.astype(np.float32).T == hardnegatives.products(a, a)).all()


def test_products_are_exact():
    big = np.array([[1 << 28, -(1 << 28), 3]])
    assert hardnegatives.products(big, big)[0, 0] == 2 * (1 << 56) + 9


# repeated rows in mixes, long texts in fingerprints ------------------------------------------
def test_repeated_rows_do_not_move_a_source_off_its_target(spark):
    from pyspark.sql import functions as F

    from termforge.llm import mixing

    rows = [(7, "same words in this one row here " * 4, "a", 1)] * 2_000 + [(i + 100, f"w{i} " * (10 + i % 40), "a", 2) for i in range(400)]
    rows += [(i + 1_000, f"v{i} " * (10 + i % 40), "b", 3) for i in range(1_500)] + [(None, "no id at all", "c", 4)] * 800 + [(9, None, "c", 5)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, cut int").repartition(5)
    mixed = mixing.mix_documents(docs).toPandas()
    assert len(mixed) == len(rows)
    source = {7: "a"} | {i + 100: "a" for i in range(400)} | {i + 1_000: "b" for i in range(1_500)}
    mixed["source"] = [source.get(i, "c") for i in mixed["doc_id"]]
    for _, own in mixed.groupby("source"):
        assert own["taken"].sum() == pytest.approx(own["target"].iloc[0], rel=0.01)
    assert (mixed["taken"] <= 2 * mixed["size"]).all()
    taken = mixing.take_documents(docs)
    assert taken.columns == docs.columns
    words = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.sum(mixing.words_of(F.col("text"))).alias("n")).collect()}
    assert words == mixed.groupby("source")["taken"].sum().to_dict()


def test_likeness_of_long_texts(spark):
    """50,000 paragraphs in seconds, by the plain count of common nodes."""
    import time

    from pyspark.sql import functions as F

    from termforge.llm import merkle

    n = 50_000
    a, b = ("\n".join(f"line {i * k} of a log" for i in range(n)) for k in (1, 2))
    rows = merkle.with_tree(merkle.with_tree(spark.createDataFrame([(a, b)], "a string, b string"), F.col("a"), "x"), F.col("b"), "y")
    began = time.time()
    got = merkle.likeness(rows, "x", "y", "like").select("like").first()["like"]
    assert time.time() - began < 60
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    nodes = [{(md5(md5(line))[:8], md5(line)[:6]) for line in t.split("\n")} for t in (a, b)]
    common = {x[0] for x in nodes[0]} & {x[0] for x in nodes[1]}
    rest = [{x[1] for x in own if x[0] not in common} for own in nodes]
    assert got == pytest.approx(2 * (len(common) + len(rest[0] & rest[1])) / (2 * len(common) + len(rest[0]) + len(rest[1])))
