"""Mixing sources to target weights by Pareto order sampling.

Source targets. Sources share a multiple of all words by weight. No target exceeds ``cap``
times its source's words; what is over goes to the others by weight until none is over. That
is the level L at which the sum of min(cap * words, weight * L) is the total, found from
running sums over the sources in order of cap * words / weight.

Certain copies. A source's ratio of target to words gives each of its documents floor(ratio)
certain whole copies; what is left of the target, ``open`` words, is drawn as one more copy of
some documents.

Pareto order sampling. A source's documents are parted by size into classes (sixteen to
a doubling). A class with N documents of W words in all gives a sample of fixed size n, with inclusion
probabilities in proportion to size, p = n * size / W (n / N for all, where a share would
reach 1): documents are ranked by the odds of a uniform number by hash, (u / (1 - u)), divided by
the inclusion odds p / (1 - p), and the n of least rank are taken. n is the whole number
nearest to the class's share of the open words, plus what larger classes left over: classes are gone
through from the largest documents down, each passing on the words that its whole number of documents
is expected to miss by. So small documents make up for large ones, and a source ends near its target
though no document is taken out of its order. Reruns agree, since u depends on the seed, the id and
the text only.

Scale. Words are counted once into a table without texts. Sums by source and class
are partial sums; a source has at most a few hundred classes. A class's ranking is never
sorted as a whole: ranks are folded into BUCKETS buckets, the bucket in which the sample size is reached is
found from counts, and only that bucket's distinct ranks are ordered. What is decided is one
row for each (source, class): sample size and greatest rank taken. From it every document's copies follow
in the scan (take_documents moves no text while that table fits a broadcast).

Defined results. A null text has no words; it gets the certain copies of its source and counts
nothing. A null source is a source, last in order. Sources without words have target 0.
Rows that repeat id and text have one rank; at the cut as many of them are taken as the
sample has places left, so repeats don't move a source off its target. An empty table gives an empty
result. Extra columns, whatever their names, are not read by mix_documents and kept by take_documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termforge.llm.common import SALTS, WORD, join_per_key, materialize

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, "mix"
#: Size classes to a doubling of size, as a power of two.
CLASS_BITS = 4
BUCKETS = 4096
#: Rows of the plan, one for each source and class, up to which it is broadcast (about 60 bytes each).
PLAN_ROWS = 400_000
KEYS = ["source", "size_class"]


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) by hash of seed, id and text, the same in any engine with MD5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def size_class(size: Column) -> Column:
    """The leading CLASS_BITS + 1 bits of a size and the number of bits after them, as one number that grows with size."""
    rest = F.greatest(F.length(F.bin(size)) - (CLASS_BITS + 1), F.lit(0))
    return (rest * (1 << CLASS_BITS) + F.floor(size / F.pow(F.lit(2.0), rest))).cast("int")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target; one row per source of sized (source, size)."""
    sources = materialize(sized.groupBy("source").agg(F.sum("size").cast("double").alias("words")), "mix-sources")
    # One row per source: these windows see sources, not documents.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("turn", F.lit(cap) * F.col("words") / F.col("weight"))
    by_turn = Window.orderBy("turn", F.col("source").asc_nulls_last())
    total = F.lit(share) * F.sum("words").over(Window.partitionBy())
    left = total - F.coalesce(F.sum(F.lit(cap) * F.col("words")).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    to_share = F.sum("weight").over(by_turn.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", left / to_share).withColumn("full", F.col("level") >= F.col("turn"))
    level = F.min(F.when(~F.col("full"), F.struct("turn", F.col("source").isNull(), "source", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full"), F.lit(cap) * F.col("words")).otherwise(F.col("weight") * level)
    return levelled.select("source", F.col("words").cast("long").alias("source_size"), target.alias("target"))


def sample_sizes(sized: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """source, size_class, source_size, target, certain, n_docs, words, even, take: the sample size of each class.

    even marks classes whose documents have equal odds. One row a class: sources' lists of
    classes are a few hundred entries long.
    """
    square = (F.col("size") * F.col("size")).cast("decimal(38,0)")
    classes = sized.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").cast("double").alias("w"), F.sum(square).cast("double").alias("q"), F.max("size").cast("double").alias("top")
    )
    listed = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size_class", "n", "w", "q", "top")), asc=False).alias("classes"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = join_per_key(listed, targets, ["source"]).withColumn("certain", F.floor(F.least(ratio, F.lit(cap))).cast("long"))
    rows = rows.withColumn("share", F.when(F.col("source_size") > 0, (F.col("target") - F.col("certain") * F.col("source_size")) / F.col("source_size")).otherwise(F.lit(0.0)))

    def step(state: Column, c: Column) -> Column:
        due = F.col("share") * c["w"] + state["carry"]
        wanted = F.when(c["w"] > 0, F.floor(due / (c["q"] / F.greatest(c["w"], F.lit(1.0))) + 0.5)).otherwise(F.lit(0)).cast("long")
        take = F.greatest(F.least(wanted, c["n"]), F.lit(0).cast("long"))
        even = take * c["top"] >= c["w"]
        got = F.when(take == c["n"], c["w"]).when(even, take * c["w"] / c["n"]).otherwise(take * c["q"] / F.greatest(c["w"], F.lit(1.0)))
        done = F.struct(c["size_class"].alias("size_class"), c["n"].alias("n_docs"), c["w"].alias("words"), even.alias("even"), take.alias("take"))
        return F.struct((due - got).alias("carry"), F.concat(state["done"], F.array(done)).alias("done"))

    empty = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<size_class:int,n_docs:bigint,words:double,even:boolean,take:bigint>>").alias("done"))
    walked = rows.select("source", "source_size", "target", "certain", F.explode(F.aggregate("classes", empty, step, lambda s: s["done"])).alias("c"))
    return walked.select("source", "source_size", "target", "certain", "c.*")


def inclusion(size: Column) -> Column:
    """The inclusion probability of a document of a class: columns take, n_docs, words, even."""
    p = F.when(F.col("even"), F.col("take") / F.col("n_docs")).otherwise(F.col("take") * size / F.greatest(F.col("words"), F.lit(1.0)))
    return F.when(F.col("take") == F.col("n_docs"), F.lit(1.0)).otherwise(p)


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds, for 0 < p < 1; null otherwise."""
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def plan_classes(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sample_sizes with cut: the rank of the last document taken of each class whose sample is a part of it."""
    targets = materialize(source_targets(sized, weights, share, cap), "mix-targets")
    sizes = materialize(sample_sizes(sized, targets, cap), "mix-classes")
    part = sizes.where("take > 0 and take < n_docs").select(*KEYS, "take", "n_docs", "words", "even")
    ranked = join_per_key(sized, part, KEYS, "inner", PLAN_ROWS).withColumn("rank", pareto_rank(F.col("u"), inclusion(F.col("size"))))
    bucket = F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int")
    ranked = materialize(ranked.select(*KEYS, "take", "rank", bucket.alias("bucket")), "mix-ranks")
    counts = ranked.groupBy(*KEYS, "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("take").alias("take"))
    summed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("bucket")))
    # The bucket in which the sample size is reached, and how many of its documents are taken.
    edge = summed.where("upto >= take").groupBy(*KEYS).agg(F.min(F.struct("bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("open"))).alias("e"))
    edge = materialize(edge.select(*KEYS, F.col("e.bucket").alias("edge"), F.col("e.open").alias("open")), "mix-edges")
    # Equal ranks are counted before they are ordered, so rows that repeat are one row here.
    ranks = join_per_key(ranked, edge, KEYS, "inner", PLAN_ROWS).where("bucket = edge").groupBy(*KEYS, "open", "rank").agg(F.count(F.lit(1)).alias("n"))
    reached = ranks.withColumn("upto", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("rank"))).where("upto >= open and upto - n < open")
    cuts = reached.select(*KEYS, F.col("rank").alias("cut"), F.col("n").alias("at_cut"), (F.col("open") - F.col("upto") + F.col("n")).alias("taken_at_cut"))
    return materialize(join_per_key(sizes, materialize(cuts, "mix-cuts"), KEYS), "mix-plan")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size_class, size, u) with their class's plan and `copies`: how often each is taken.

    Of rows that share the rank of the cut, as many are taken as the sample has places left. Only where a class has
    fewer places than such rows are these numbered, dealt over SALTS parts.
    """
    p = inclusion(F.col("size"))
    rank = pareto_rank(F.col("u"), p)
    planned = join_per_key(rows, plan, KEYS, limit=PLAN_ROWS)
    tied = F.coalesce((rank == F.col("cut")) & (F.col("taken_at_cut") < F.col("at_cut")), F.lit(False))
    drawn = F.coalesce((p == 1) | (rank <= F.col("cut")), F.lit(False))
    copies = lambda extra: (F.coalesce("certain", F.lit(0)) + extra.cast("int")).cast("long").alias("copies")
    if plan.where("taken_at_cut < at_cut").isEmpty():
        return planned.select("*", copies(drawn))
    salted = planned.where(tied).withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    salted = materialize(salted, "mix-ties")
    sizes = salted.groupBy(*KEYS, "__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.partitionBy(*KEYS).orderBy("__part")) - F.col("n")).drop("n")
    numbered = join_per_key(salted, materialize(before, "mix-tie-counts"), [*KEYS, "__part"])
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*KEYS, "__part").orderBy("u"))
    chosen = numbered.select("*", copies(place <= F.col("taken_at_cut"))).drop("__part", "__before")
    return planned.where(~tied).select("*", copies(drawn)).unionByName(chosen)


def _with_size(docs: DataFrame, seed: str, *kept: Column) -> DataFrame:
    size = words_of(F.col("text"))
    return docs.select(*kept, "source", size.alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u")).withColumn("size_class", size_class(F.col("size")))


def plan_copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, inclusion (probability of the drawn copy), copies of every document."""
    sized = materialize(_with_size(docs, seed, F.col("doc_id").cast("long").alias("doc_id")), "mix-sizes")
    plan = plan_classes(sized, weights, share, cap)
    rows = _with_copies(sized, plan)
    return rows.select("doc_id", "source", "size", "source_size", "target", inclusion(F.col("size")).alias("inclusion"), "copies")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), inclusion of every document."""
    planned = plan_copies(docs, **how)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "inclusion")


def take_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    sized = materialize(_with_size(docs, seed), "mix-sizes")
    plan = plan_classes(sized, weights, share, cap)
    rows = _with_copies(_with_size(docs, seed, F.struct(*docs.columns).alias("row")), plan)
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
