"""The training-data operators against brute force on small tables with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from termforge.llm import bytebpe, merkle, mixing, ngramjoin, orcstore, quality, sharding, tokencount, toxicity, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, __own int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "re", "mi", "on", "é", "sh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edge_rows() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        base, base, base.replace(" re", " RE", 1), "", None, " \t\n ", "one", "a b c d", "x\n\ny\n\n\nz", "line one\nline one\nline two", prose(2, 40) + "\n\n" + prose(3, 60),
        "##" * 50 + " tail", "mot é ü 漢字 😀 " * 8, "word" * 3_000, prose(4, 6_000), base, " ".join(f"w{i}" for i in range(50)), "a" * 300, "\x1c\x85x　y",
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, 1, True, 7, 1) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(50 + i, 30 + i % 7), "en", "bulk", 0, None, None, None) for i in range(60)]
    return rows + [(None, "no id here at all", "en", "src1", None, None, None, None), (7, "a b c d", "en", "src3", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# quality ------------------------------------------------------------------------------------
def slow_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t #|", max_size=80)), max_size=8))
def test_counts_match_brute_force(texts):
    got = quality.count_texts(texts)
    assert [tuple(int(got[c][i]) for c in quality.COUNTS) for i in range(len(texts))] == [slow_counts(t) for t in texts]


def test_quality_rows_and_outliers(spark, docs, none):
    rows = quality.judge_documents(docs, min_group=20).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id != 7}
    for doc_id, text, *_ in edge_rows():
        if doc_id == 7:
            continue
        r = by_id[doc_id]
        counts = slow_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert not (r.base_failed and r.kept)
    assert all(by_id[100 + i].kept for i in range(60))
    odd = spark.createDataFrame(edge_rows() + [(900, prose(9, 40) + " " + "#| " * 60, "en", "bulk", 0, None, None, None)], DOCS)
    verdict = {r.doc_id: r.kept for r in quality.judge_documents(odd, min_group=20).collect()}
    assert verdict[900] is False
    assert quality.judge_documents(none).count() == 0


def test_small_groups_are_judged(spark):
    junk = prose(9, 40) + " " + "#| " * 60
    rows = [(i, prose(200 + i, 30 + i % 9), "en", f"big{i % 2}") for i in range(120)]
    rows += [(1_000 + i, prose(400 + i, 35), lang, f"tiny{i}") for i, lang in enumerate(["en", "en", "xx", None])]
    rows += [(2_000 + i, junk, lang, source) for i, (lang, source) in enumerate([("en", "tiny0"), ("en", None), ("xx", "odd"), (None, None)])]
    rows += [(3_000, "too short", "zz", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    assert len(got) == len(rows)
    assert all((r.distance is None) == r.base_failed for r in got.values())
    assert all(got[1_000 + i].kept for i in range(4)) and not any(got[2_000 + i].kept for i in range(4))
    assert got[3_000].kept is False
    assert {r.doc_id for r in quality.filter_documents(docs).collect()} == {i for i, r in got.items() if r.kept}
    few = quality.judge_documents(docs.where("doc_id in (1, 2, 3)")).collect()
    assert all(r.distance is not None and r.kept for r in few)


def test_quality_filter_keeps_columns(docs):
    kept = quality.filter_documents(docs, min_group=20)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in quality.judge_documents(docs, min_group=20).collect() if r.kept)
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_mcd_resists_a_third_of_outliers():
    r = np.random.default_rng(1)
    good = r.normal(0, 1, (400, 5)) * (1, 0.3, 0.1, 0.1, 0.1)
    x = np.rint(np.vstack([good, r.normal(8, 0.1, (120, 5))]) * 1000).astype(np.int64)
    import pandas as pd

    cells = pd.DataFrame({"n": 1, **{f"s{i}": x[:, i] for i in range(5)}, **{f"q{i}{j}": x[:, i] * x[:, j] for i, j in quality._PAIRS}})
    centre, scatter = quality.mcd(cells, 0.7)
    assert np.abs(centre).max() < 0.3
    assert abs(math.sqrt(scatter[0, 0]) - math.hypot(1, quality.FLOOR[0])) < 0.3


# sharding -----------------------------------------------------------------------------------
def slow_feistel(pos: int, n: int, key: str = sharding.KEY) -> int:
    a, b = sharding.permutation_sides(n)

    def f(half: int, i: int, side: int) -> int:
        return int(hashlib.md5(f"{key}:{i}:{half}".encode()).hexdigest()[:12], 16) % side

    while True:
        l, r = pos % a, pos // a
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                l = (l + f(r, i, a)) % a
            else:
                r = (r + f(l, i, b)) % b
        pos = l + r * a
        if pos < n:
            return pos


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 81, 1000])
def test_feistel_is_the_stated_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r.p for r in spark.range(n).select(sharding.feistel(F.col("id"), n).alias("p")).orderBy("id").collect()]
    assert got == [slow_feistel(i, n) for i in range(n)]
    assert sorted(got) == list(range(n))


def test_shards_are_even_and_gapless(docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert rows == sharding.shard_documents(docs.repartition(5)).orderBy("doc_id").collect() or Counter(rows) == Counter(sharding.shard_documents(docs.repartition(5)).collect())
    texts = [(i, t or "") for i, t, *_ in edge_rows()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(by_shard) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard_documents(none).count() == 0


def test_row_number_order_is_the_stated_one(docs):
    rows = sharding.shard_documents(docs).collect()
    def order(r):
        i = "null" if r.doc_id is None else str(r.doc_id)
        return hashlib.md5(f"{sharding.KEY}:{i}:{r.size}:{r.text_crc32}".encode()).hexdigest()
    listed = sorted(rows, key=order)
    for number, r in enumerate(listed):
        place = slow_feistel(number, len(rows))
        if r.doc_id != 7:
            assert (r.shard, r.slot) == (place % 24, place // 24)


# token counts -------------------------------------------------------------------------------
def slow_pieces(word: str, scores: dict, byte_score: float) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(best[end - 1][0] + byte_score, -(best[end - 1][1] + width))]
        options += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in scores]
        score, pieces = max(options)
        best.append((score, -pieces))
    return best[-1][1]


def test_token_counts_match_brute_force(docs, none):
    path = P.path("piece_bpe_32k.model")
    scores, byte_score = tokencount.read_pieces(path)
    texts = {i: t for i, t, *_ in edge_rows()}
    memo: dict = {}

    def pieces(word):
        if word not in memo:
            memo[word] = slow_pieces(tokencount.MARK + word, scores, byte_score) if len(word) <= 1_000 else None
        return memo[word]

    for r in tokencount.count_tokens(docs, path).collect():
        words = WORD.findall(texts[r.doc_id] or "")
        assert r.n_words == len(words)
        if all(len(w) <= 1_000 for w in words):
            assert r.n_tokens == sum(map(pieces, words))
    assert tokencount.count_tokens(none, path).count() == 0


def test_trie_agrees_with_the_unigram_model_of_a_library(spark, docs, sample):
    """Whole texts, long words and any characters: the library's unigram model with byte fallback, on the same scores."""
    from tokenizers import Tokenizer, models

    path = P.path("piece_bpe_32k.model")
    scores, byte_score = tokencount.read_pieces(path)
    least = min(scores.values())
    library = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{i:02X}>", least) for i in range(256)), *scores.items()], unk_id=0, byte_fallback=True))
    memo: dict = {}

    def tokens(text):
        for w in set(WORD.findall(text or "")) - memo.keys():
            memo[w] = len(library.encode(tokencount.MARK + w).ids)
        return sum(memo[w] for w in WORD.findall(text or ""))

    for table in (docs, sample):
        texts = defaultdict(set)
        for r in table.select("doc_id", "text").collect():
            texts[r.doc_id].add(tokens(r.text))
        for r in tokencount.count_tokens(table, path).collect():
            assert r.n_tokens in texts[r.doc_id], r.doc_id


def test_a_full_trie_changes_nothing(monkeypatch):
    scores, byte_score = tokencount.read_pieces(P.path("piece_bpe_32k.model"))
    text = prose(12, 500)
    want = tokencount.TokenCounter(scores, byte_score).count(text)
    monkeypatch.setattr(tokencount, "TRIE_NODES", 20)
    monkeypatch.setattr(tokencount, "MEMO_WORDS", 10)
    assert tokencount.TokenCounter(scores, byte_score).count(text) == want


# ORC ----------------------------------------------------------------------------------------
def test_token_ids_match_the_library(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = orcstore.encode_documents(docs, path).collect()
    texts = sorted(((i is not None, i or 0, t is not None, t or ""), i, t) for i, t, *_ in edge_rows())
    start, want = 0, []
    for _, i, t in texts:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert orcstore.encode_documents(none, path).count() == 0


def test_store_has_indexes_and_looks_up_ids(spark, sample, tmp_path):
    store = str(tmp_path / "store")
    orcstore.write_store(sample, store, P.path("word_bpe_49k.json"))
    found = orcstore.read_store(spark, store, [5, 17])
    assert sorted(r.doc_id for r in found.collect()) == [5, 17]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull" in plan or "In(doc_id" in plan
    import glob

    from pyarrow import orc

    files = sorted(glob.glob(f"{store}/*.orc"))
    read = [orc.ORCFile(f) for f in files]
    assert sum(f.nrows for f in read) == sample.count()
    assert all(f.nstripes >= 1 for f in read if f.nrows)
    ids = [i for f in read for i in f.read(columns=["doc_id"]).column("doc_id").to_pylist()]
    assert ids == sorted(ids)


def scanned(df) -> int:
    """Rows that the scan of an executed query has read."""
    df.collect()
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan orc"):
            return node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().length())]
    raise AssertionError("no scan")


def test_stripes_are_read_apart_and_row_groups_pruned(spark, tmp_path):
    import glob

    from pyarrow import orc
    from pyspark.sql import functions as F

    ids = [3 * i for i in range(12_000)]
    table = spark.createDataFrame([(i, prose(i % 50, 12)) for i in ids], "doc_id long, text string").repartition(5)
    store = str(tmp_path / "store")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orcstore.write_store(table, store, P.path("word_bpe_49k.json"), stripe_bytes=64 << 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (path,) = glob.glob(f"{store}/*.orc")
    file = orc.ORCFile(path)
    assert file.nstripes >= 3 and file.nrows == len(ids)
    # stripe by stripe, each by itself, in ascending order
    stripes = [file.read_stripe(i, columns=["doc_id"]).column("doc_id").to_pylist() for i in range(file.nstripes)]
    assert [i for s in stripes for i in s] == ids and max(map(len, stripes)) < len(ids) / 2
    # one id: its row group is read, by min and max; an id between two, by the Bloom filter, mostly nothing
    assert 1 <= scanned(orcstore.read_store(spark, store, [ids[7_000]])) <= orcstore.ROW_GROUP
    absent = [scanned(orcstore.read_store(spark, store, [ids[k] + 1])) for k in range(500, 12_000, 1_000)]
    assert sum(n == 0 for n in absent) >= len(absent) - 2
    # a range of ids: only the stripes and row groups it meets
    some = orcstore.read_store(spark, store).where(F.col("doc_id").between(ids[100], ids[1_900]))
    assert some.count() == 1_801 and scanned(some.select("doc_id")) <= 3_000


# n-gram join --------------------------------------------------------------------------------
def slow_classes(rows: list[tuple], threshold: float = 0.8) -> dict:
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    listed, sets, post = list(texts), [], defaultdict(list)
    home = list(range(len(listed)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for at, t in enumerate(listed):
        own = ngramjoin._gram_set(t)
        for other, k in Counter(o for g in own for o in post[g]).items():
            if k >= threshold * (len(own) + len(sets[other]) - k):
                home[find(at)] = find(other)
        for g in own:
            post[g].append(at)
        sets.append(own)
    groups = defaultdict(list)
    for at, t in enumerate(listed):
        groups[find(at)] += texts[t]
    return {frozenset(Counter(map(str, g)).items()) for g in groups.values()}


def grouped(rows) -> set:
    groups = defaultdict(list)
    for r in rows:
        groups[r.class_id].append(str(r.doc_id))
    return {frozenset(Counter(g).items()) for g in groups.values()}


def chain_rows() -> list[tuple]:
    words = [f"v{i}" for i in range(200)]
    out = []
    for k in range(40):  # a chain: neighbours are similar, the ends are not
        w = list(words)
        w[k * 3 : k * 3 + 3] = [f"n{k}_{j}" for j in range(3)]
        out.append((1_000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("few,block", [(12, 512), (1, 3)])
def test_classes_match_brute_force(spark, sample, monkeypatch, few, block):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in sample.where("doc_id < 400").collect()] + chain_rows()
    got = ngramjoin.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert grouped(got) == slow_classes(rows)
    linked = Counter(r.class_id for r in got)
    assert all((r.n_links > 0) == (linked[r.class_id] > r.n_copies) for r in got)


def test_join_edges(docs, none):
    got = ngramjoin.link_documents(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].class_id == by_id[1].class_id == by_id[2].class_id == by_id[15].class_id == 0
    assert by_id[0].n_copies == 3 and by_id[3].class_id == by_id[4].class_id == 3 and by_id[5].class_id == 5
    assert ngramjoin.link_documents(none).count() == 0
    kept = ngramjoin.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 90").collect()) == sorted({r.class_id for r in got if r.class_id is not None and r.class_id < 90})


def test_unrelated_texts_without_or_with_one_id_are_kept(spark):
    words = prose(31, 80).split()
    near = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in (0, 79)]
    rows = [(None, prose(600 + i, 30)) for i in range(6)] + [(5, prose(650 + i, 30)) for i in range(4)] + [(5, prose(650, 30)), (None, prose(600, 30))]
    rows += [(None, near[0]), (None, near[1]), (9, prose(32, 50)), (None, prose(32, 50)), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text or "") for r in ngramjoin.keep_one_per_class(table).collect())
    assert max(got.values()) == 1
    (one,) = [t for t in near if (None, t) in got]
    want = {(i, t or "") for i, t in rows if t not in near and (i, t) != (None, prose(32, 50))} | {(None, one)}
    assert set(got) == want


def slow_links(texts: list[str]) -> dict:
    sets = {t: ngramjoin._gram_set(t) for t in set(texts)}
    return {t: sum(u != t and len(own & other) >= 0.8 * len(own | other) > 0 for u, other in sets.items()) for t, own in sets.items()}


@pytest.mark.parametrize("few,block", [(12, 512), (1, 3)])
def test_link_counts_match_brute_force(spark, monkeypatch, few, block):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    texts = [t for _, t in chain_rows()]
    for n, size in ((3, 90), (60, 150)):  # groups of mutually similar variants
        words = prose(700 + n, size).split()
        texts += [" ".join(words[: k * 2] + [f"u{n}_{k}"] + words[k * 2 + 1 :]) for k in range(n)]
    texts += [texts[0], texts[50], "one of its kind only here", "", None]
    got = ngramjoin.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = slow_links([t or "" for t in texts])
    assert max(want.values()) > 50
    assert {r.doc_id: r.n_links for r in got} == {i: want[t or ""] for i, t in enumerate(texts)}


def test_overlaps_match_sets(monkeypatch):
    monkeypatch.setattr(ngramjoin, "LIGHT", 4)
    monkeypatch.setattr(ngramjoin, "GRAMS", 7)
    r = np.random.default_rng(3)
    left, right = ([np.flatnonzero(r.random(60) < np.linspace(0.02, 0.9, 60)) for _ in range(n)] for n in (9, 20))
    want = [[len(set(x) & set(y)) for y in right] for x in left]
    assert ngramjoin.overlaps(left, right, 60).tolist() == want


def test_bands_reach_the_recall():
    bands, rows = ngramjoin.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        ngramjoin.choose_bands(0.1, 0.999, 3)


# mixing -------------------------------------------------------------------------------------
def slow_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + share * weight[s] >= 2 * sizes[s] - 1e-9}
        if not over:
            for s in open_:
                target[s] += share * weight[s]
            break
        for s in over:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
        open_ -= over
    return target


def test_mix_meets_targets(docs, sample, none):
    for table in (docs, sample):
        rows = mixing.mix_documents(table).collect()
        source = defaultdict(list)
        for r in table.select("doc_id", "source").collect():
            source[r.doc_id].append(r.source)
        got, want, size = Counter(), {}, Counter()
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            if len(source[r.doc_id]) == 1:
                got[source[r.doc_id][0]] += r.taken
        for r in table.select("source", "text").collect():
            size[r.source] += len(WORD.findall(r.text or ""))
        want = slow_targets(dict(size))
        for r in rows:
            if len(source[r.doc_id]) == 1:
                assert r.target == pytest.approx(want[source[r.doc_id][0]]) and r.source_size == size[source[r.doc_id][0]]
        if table is sample:
            assert all(abs(got[s] - want[s]) <= 0.01 * want[s] for s in want)
            again = mixing.mix_documents(table.repartition(7)).collect()
            assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mix_documents(none).count() == 0


def test_taken_rows_follow_the_plan(docs):
    taken = mixing.take_documents(docs)
    assert taken.columns == docs.columns
    planned = Counter()
    for r in mixing.plan_copies(docs).collect():
        planned[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in taken.collect()) == +planned


def test_inclusion_rates_are_the_stated_ones(spark):
    """Many sources of documents of the same sizes are many draws of one sample design."""
    sizes = [40, 41, 42, 43, 40, 41, 42, 43, 17, 17, 16, 9, 9, 9, 9, 9, 3, 3, 1, 120]
    rows = [(1_000 * d + k, f"w{d} " * n, f"s{d}") for d in range(400) for k, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan_copies(table, weights=(1,), share=0.45).toPandas()
    planned["k"] = planned["doc_id"] % 1_000
    assert planned["copies"].isin([0, 1]).all()
    for k, own in planned.groupby("k"):
        p = own["inclusion"].iloc[0]
        assert own["inclusion"].nunique() == 1 and abs(own["copies"].mean() - p) <= 4 * math.sqrt(max(p * (1 - p), 1e-9) / 400) + 0.02, k
    # fixed sizes: each size class gives the same number of documents in every draw, and larger ones of a class are likelier
    counts = planned.groupby(["source", "size"])["copies"].sum().unstack()
    assert counts[9].nunique() == counts[17].nunique() == 1
    of = planned.drop_duplicates("k").set_index("k")["inclusion"]
    assert of[0] < of[1] or of[0] == of[1] in (0.0, 1.0)
    words = (planned["copies"] * planned["size"]).groupby(planned["source"]).sum()
    assert abs(words / (0.45 * sum(sizes)) - 1).max() <= 0.06


def test_mix_edges(spark):
    table = spark.createDataFrame([(None, f"t{i} " * 5, "a", 1) for i in range(40)] + [(7, None, "b", 2), (7, "", None, 3)], "doc_id long, text string, source string, u int")
    taken = mixing.take_documents(table)
    assert taken.columns == table.columns
    assert taken.count() == sum(r.copies for r in mixing.plan_copies(table).collect())
    words = sum(len(r.text.split()) for r in taken.where("source = 'a'").collect())
    assert abs(words - 300) <= 5
    assert mixing.take_documents(table.limit(0)).count() == 0


# fingerprints -------------------------------------------------------------------------------
def slow_tree(text: str) -> tuple[str, list]:
    """The fingerprint, and sections as (node, [(node, chunks)])."""
    chunk = re.compile(merkle.CHUNK)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    sections, tree = [], []
    for s in text.split("\n\n"):
        parts, nodes = [], []
        for p in s.split("\n"):
            own = [md5(c) for c in chunk.findall(p)]
            nodes.append(md5("".join(own)))
            parts.append((nodes[-1][:8], [c[:6] for c in own]))
        sections.append(md5("".join(nodes)))
        tree.append((sections[-1][:8], parts))
    written = ";".join(node + ":" + ",".join(p + "=" + "".join(cs) for p, cs in parts) for node, parts in tree)
    return hashlib.sha256("".join(sections).encode()).hexdigest()[:32] + "|" + written, tree


def slow_likeness(a: tuple, b: tuple) -> float:
    if a[0][:32] == b[0][:32]:
        return 1.0
    common = 0
    x, y = a[1], b[1]
    both = {n for n, _ in x} & {n for n, _ in y}
    common += sum(sum(len(cs) for _, cs in parts) for parts in {n: parts for n, parts in x if n in both}.values())
    x, y = ([p for n, parts in t if n not in both for p in parts] for t in (x, y))
    both = {n for n, _ in x} & {n for n, _ in y}
    common += sum(len(cs) for cs in {n: cs for n, cs in x if n in both}.values())
    x, y = ({c for n, cs in t if n not in both for c in cs} for t in (x, y))
    total = 2 * common + len(x) + len(y)
    return 2.0 * (common + len(x & y)) / total if total else 0.0


def test_likeness_descends_sections_and_paragraphs(spark):
    from pyspark.sql import functions as F

    one, two, three = (prose(70 + i, 60) for i in range(3))
    a = f"{one}\n{two}\n\n{three}\n{one} end"
    cases = [a, f"{three}\n{one} end\n\n{one}\n{two}", f"{one}\n{two} more\n\n{three}\n{one} end", f"{two}\n\nother words", "", "\n\n", f"{one}\n\n{one}\n\n{one}", a + "\n\n"]
    rows = spark.createDataFrame([(x, y) for x in cases for y in cases], "x string, y string")
    rows = merkle.with_tree(merkle.with_tree(rows, F.col("x"), "fx"), F.col("y"), "fy")
    for r in merkle.likeness(rows, "fx", "fy", "near").select("x", "y", "near").collect():
        assert r.near == pytest.approx(slow_likeness(slow_tree(r.x), slow_tree(r.y))), (r.x, r.y)
        assert 0 <= r.near <= 1 and (r.near == 1 or r.x != r.y)


def test_rows_without_ids_have_ranges_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 5)
    table = spark.createDataFrame([(i if i % 3 else None, f"text {i}") for i in range(60)], "doc_id long, text string").repartition(4)
    order = sorted(table.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.sha256(r.text.encode()).hexdigest() if r.doc_id is None else ""))
    want = {r.text: order[(k + 1) % len(order)].text for k, r in enumerate(order)}
    assert {r.text: r.next_text for r in merkle.with_next(table).collect()} == want


@pytest.mark.parametrize("range_rows", [3_000, 7])
def test_fingerprints_match_brute_force(docs, none, monkeypatch, range_rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", range_rows)
    texts = [(i, t or "") for i, t, *_ in edge_rows()]
    texts.sort(key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    head = [x for x in texts if x[0] == 7]
    head.sort(key=lambda x: hashlib.sha256(x[1].encode()).hexdigest())
    at = next(k for k, x in enumerate(texts) if x[0] == 7)
    texts[at : at + 2] = head
    rows = merkle.fingerprint_documents(docs).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    want = Counter()
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = slow_tree(t), slow_tree(e), slow_tree(nxt)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), a[0], b[0], round(slow_likeness(a, b), 9), round(slow_likeness(a, c), 9)] += 1
    assert got == want
    assert merkle.fingerprint_documents(none).count() == 0


def test_changed_paragraphs_are_located(spark):
    from pyspark.sql import functions as F

    a, b = "p one\np two\n\nq one\nq two", "p one\np two\n\nq one\nq 2\nq three"
    row = spark.createDataFrame([(a, b)], "a string, b string")
    row = merkle.with_tree(merkle.with_tree(row, F.col("a"), "fa"), F.col("b"), "fb")
    spots = row.select(merkle.changed_paragraphs(F.col("fa"), F.col("fb")).alias("x")).first().x
    assert [(s.section, s.paragraph) for s in spots] == [(1, 1), (1, 2)]


# URLs ---------------------------------------------------------------------------------------
def slow_rule(url: str | None) -> tuple:
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_url_rules(spark, sf_dir):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/en/1x?q=1", "https://example.org/es/", "http://x.com/fr/", "http://com/de/a#b", "ftp://u:p@ex.com:80", "http://xorg/", "a://b://org/", "http://É.org/Z"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, None, 1)], "page_id long, url string, host int")
    rows = urlfilter.judge_pages(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = slow_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urlfilter.judge_pages(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert urlfilter.judge_pages(real).count() == real.count()


def test_url_features_match_brute_force(spark):
    urls = [None, "", "http://A.b.ORG/en/12/x.html?q=1&r=2#f", "a://é.com/%7Edir_1//y", "http://x.net", "https://www.a-b.de/fr/9?x", "no scheme 123"]
    rows = urlfilter.with_lexical(urlfilter.with_rule(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"))).collect()
    for r in rows:
        u = urls[r.page_id] or ""
        host, path, *_ = slow_rule(u)
        share = [u.count(c) / len(u) for c in set(u)]
        query = u.split("#", 1)[0].partition("?")[2]
        want = [len(u), len(host), len(path), len([p for p in path.split("/") if p]), host.count(".") + 1 if host else 0, sum(c in "0123456789" for c in u) / max(1, len(u)),
                -sum(p * math.log2(p) for p in share), query.count("&") + 1 if query else 0, sum(c in "-_%=~@" for c in u)]
        assert [r[f] for f in urlfilter.LEXICAL] == pytest.approx(want), u
        assert (r.domain, r.head, r.fold) == (host.rsplit(".", 1)[-1], path[:5], zlib.crc32(host.encode()) % 64)


def test_url_rates_leave_out_the_own_fold(spark, sf_dir):
    rows = urlfilter.with_rates(urlfilter.with_lexical(urlfilter.with_rule(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")))).collect()
    known = [r for r in rows if r.ruled]
    prior = sum(r.ruled == "block" for r in known) / len(known)
    for r in rows:
        for key in urlfilter.RATES:
            own = [x.ruled == "block" for x in known if x[key] == r[key] and not (r.ruled and x.fold == r.fold)]
            assert r[f"{key}_rate"] == pytest.approx((sum(own) + 2 * prior) / (len(own) + 2))


def test_url_trees_agree_with_labels_of_hosts_held_out(spark, sf_dir):
    """Whole pages at the larger scale: URLs of hosts that no tree was trained on."""
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.01', 'sf0.1')}/pages.parquet")
    rows = [r for r in urlfilter.judge_pages(pages).collect() if r.rule]
    out = [(r.score, r.verdict == "block") for r in rows if zlib.crc32(r.host.encode()) % 5 == 0]
    pos, neg = [s for s, y in out if y], [s for s, y in out if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    print(f"held-out URLs {len(out)}: AUC {area:.3f}, agreement {sum((s >= 0.5) == y for s, y in out) / len(out):.3f}; all {sum((r.score >= 0.5) == (r.verdict == 'block') for r in rows) / len(rows):.3f}")
    assert area >= 0.95 and sum((s >= 0.5) == y for s, y in out) >= 0.9 * len(out)


def test_splits_and_leaves_are_the_best_ones():
    r = np.random.default_rng(4)
    x = r.integers(0, 6, size=(200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (r.random(200) < 0.2)).astype(float)
    trees = urlfilter.boost(x, y, rounds=1, depth=1)
    base = math.log(y.mean() / (1 - y.mean()))
    grad, hess = y - y.mean(), np.full(200, y.mean() * (1 - y.mean()))
    best = (-1.0, None)
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, urlfilter.BINS + 1)[1:-1])):
            sides = [x[:, j] <= cut, x[:, j] > cut]
            if min(s.sum() for s in sides) >= urlfilter.LEAST_LEAF:
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in sides)
                best = max(best, (gain, (j, cut)), key=lambda b: b[0])
    feature, cut, left, right, value = trees.trees[0]
    assert trees.base == pytest.approx(base) and (feature[0], cut[0]) == best[1]
    for node, side in ((left[0], x[:, feature[0]] <= cut[0]), (right[0], x[:, feature[0]] > cut[0])):
        assert value[node] == pytest.approx(urlfilter.RATE * grad[side].sum() / (hess[side].sum() + 1))


def test_boosting_learns_a_rule():
    r = np.random.default_rng(3)
    x = r.normal(size=(3_000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = urlfilter.boost(x[:2_000], y[:2_000])
    assert ((trees.log_odds(x[2_000:]) > 0) == (y[2_000:] > 0)).mean() > 0.9
    assert (urlfilter.boost(x, np.ones(len(x))).log_odds(x) > 0).all()


# byte-level BPE -----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def coders():
    import tiktoken

    ranks = bytebpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bytebpe.ByteBpe(ranks, bytebpe.split_as_tiktoken(P.PATTERN)), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([b"a", b" ", b"tion", b"th", b"==", b"\xc3", b"er"]), st.binary(max_size=6)), max_size=12))
def test_pieces_are_exact(coders, parts):
    own, library = coders
    piece = b"".join(parts)
    if piece:
        assert own.encode_piece(piece) == library._encode_single_piece(piece)


def test_all_characters_split_as_the_library_splits_them(coders):
    own, library = coders
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    r = random.Random(3)
    texts = [" ".join(points[::3]), "".join(points[::5]), "".join(r.choices(points[:0x600] + [" ", "\n", "1"] * 200, k=5_000))]
    texts += ["".join(r.choices(points, k=r.randint(1, 9))) + r.choice([" \t a", "'s 12", "\u3000 \x85"]) for _ in range(2_000)]
    for text in texts:
        assert own.encode(text) == library.encode_ordinary(text)


def test_documents_round_trip(docs, none, coders):
    _, library = coders
    texts = {i: t or "" for i, t, *_ in edge_rows()}
    for r in bytebpe.code_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bytebpe.code_documents(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_column_functions_invert_each_other(docs):
    from pyspark.sql import functions as F

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = docs.select("text", bytebpe.encode_column(path, P.PATTERN)("text").alias("ids"))
    back = ids.select("text", bytebpe.decode_column(path, P.PATTERN)("ids").cast("string").alias("back"))
    assert back.where(F.coalesce("text", F.lit("")) != F.col("back")).count() == 0


# toxicity -----------------------------------------------------------------------------------
def test_toxicity_is_learned_and_held_out(spark, sf_dir, docs, none):
    plain = [prose(1_000 + i, 60) for i in range(300)]
    r = random.Random(5)
    def spoil(t):
        words = t.split()
        for k in r.sample(range(len(words)), 4):
            words[k] = r.choice(["vilewort", "grobian", "scheusal"])
        return " ".join(words)
    rows = [(i, spoil(t) if i % 4 == 0 else t, int(i % 4 == 0)) for i, t in enumerate(plain)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_documents(table, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.95 * len(out)
    edge = toxicity.score_documents(docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= x.score <= 1 for x in edge)
    assert toxicity.score_documents(none, labels).count() == 0
    assert all(x.score == 0 for x in toxicity.score_documents(table.limit(3), labels.limit(0)).collect())
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(1 for x in got.values() if x.score < 0.5)


def test_scores_are_compressed_length_differences():
    import zstandard

    words = ["alba", "borin", "cedo", "dunat", "ferol", "gimar", "hestu", "ilvan"]
    r = random.Random(3)
    plain = [" ".join(r.choice(words) + r.choice(words) for _ in range(80)) for _ in range(60)]
    toxic = [t + " vilewort grobian " + " ".join(r.choice(words) for _ in range(9)) + " scheusal" for t in plain[:30]]
    model = toxicity.train(toxic, plain[30:])
    assert model.ordinary[:4] == model.toxic[:4] == model.common[:4] == (0xEC30A437).to_bytes(4, "little")  # all three come from the trainer
    assert b"vilewort" in model.toxic and b"vilewort" not in model.ordinary + model.common

    def length(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=toxicity.LEVEL)
        own = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(own.compress(window))

    text = toxic[0] + " " + plain[40]
    pieces = toxicity.windows(text)
    want = [length(w, model.ordinary + model.common) - length(w, model.toxic + model.common) for w in pieces]
    scorer = toxicity.Scorer(model)
    assert scorer.differences(pieces).tolist() == want
    top = sorted(want, reverse=True)[:3]
    x = [1.0, (top[0] - model.scale[0]) / model.scale[1], (sum(top) / 3 - model.scale[0]) / model.scale[1], 3 * (sum(want) / len(want) - model.scale[0]) / model.scale[1]]
    x += [math.log1p(sum(v > t for v in want)) for t in model.thresholds]
    z = sum(a * b for a, b in zip(x, model.weights))
    assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert scorer.score(None) == scorer.score("") < 0.5


def test_toxicity_edges(spark):
    rows = [(i, prose(i, 40) + (" vilewort grobian scheusal" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(200)]
    long_one = prose(9_000, 20_000)
    table = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(900, None, "x", 2.0), (901, "", "x", 3.0), (902, long_one, "x", 4.0), (902, long_one, "x", 4.0), (None, "a", "x", 5.0)],
                                  "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1), (5_000, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(table, labels).collect()
    by = defaultdict(set)
    for x in got:
        by[x.doc_id].add(x.score)
    assert len(got) == 205 and len(by[902]) == 1 and by[900] == by[901] and max(by[900]) < 0.5
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and toxicity.drop_toxic(table.limit(0), labels).count() == 0
    assert sorted(r.score for r in kept.where("doc_id >= 900 and doc_id < 902").collect()) == [2.0, 3.0]


def test_key_filters_miss_nothing(spark):
    from pyspark.sql import functions as F

    from termforge.llm.common import KeyFilter

    marked = KeyFilter(spark.range(-30_000, 30_000, 3).toDF("k")).mark(spark.range(-30_000, 30_000), F.col("id"), "may")
    counts = {(r.own, r.may): r["count"] for r in marked.groupBy((F.pmod("id", F.lit(3)) == 0).alias("own"), "may").count().collect()}
    assert counts[True, True] == 20_000 and (True, False) not in counts
    assert counts[False, True] <= 0.15 * 40_000
    assert KeyFilter(spark.range(0).toDF("k")).mark(spark.range(10), F.col("id"), "may").where("may").count() == 0


def test_windows_cover_the_whole_text():
    text = prose(8, 700) + " " + "y" * 500
    joined = b" ".join(w.strip(b" ") for w in toxicity.windows(text))
    assert joined.replace(b" ", b"") == toxicity.normal(text).encode().replace(b" ", b"")
