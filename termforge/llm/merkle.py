"""Document fingerprints: a Merkle tree over chunks, paragraphs and sections.

A text splits at empty lines ("\\n\\n") into sections, these at "\\n" into paragraphs, these
into chunks of up to eight space-separated words; nothing is dropped, so different texts
have different trees. A chunk's node is its MD5, a paragraph's the MD5 of its chunks' nodes,
a section's the MD5 of its paragraphs' nodes, the root the SHA-256 of the sections' nodes.

The fingerprint writes the tree as text: the root's first 32 digits, then for each section
its first 8 digits and its paragraphs, each as 8 digits and 6 digits a chunk:

    root|section:paragraph=chunkchunk,paragraph=chunk;section:...

Equal roots mean equal texts. Where roots differ, the sections, then the paragraphs whose
digits differ locate the edit (changed_paragraphs), without the texts.

Likeness of two fingerprints descends the tree. Sections whose digits are in both count as common with
all their chunks, and are not looked into. In the rest, paragraphs whose digits are in both do,
and in what then is left single chunks do. Likeness is twice the common chunks divided by those of
both, each node counted once: 1 where all is common, 0 where nothing is.

Scale. Built-in functions only. To see the next document, texts are dealt into ranges of
doc_id of about RANGE_ROWS rows each, more beyond MAX_RANGES ranges; their bounds are quantiles of the ids. Documents without id
follow all others by the digests of their texts, and are dealt by these. Each range
also gets a copy of the first document of the following range, looked up in a table of one row a range. So texts
are shuffled once and sorted within ranges, and no task sees all rows.

Defined results. A null text counts as empty; an empty text has one empty chunk. Null
doc_ids sort below all others. Rows that repeat an id are ordered by the digests of their
texts. With one document, it is its own next one. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from termforge.llm.common import materialize

CHUNK = r"(?: *[^ ]+){1,8} *| +"
RANGE_ROWS, MAX_RANGES = 3_000, 65_536
ROOT, NODE, LEAF = 32, 8, 6
#: Nodes up to which a plain search costs less than halving.
FEW = 32


def _chunk_nodes(text: Column) -> Column:
    """Array of sections of arrays of paragraphs of arrays of chunk MD5s."""

    def chunks(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(CHUNK), F.lit(0)), lambda c: F.md5(c))

    def paragraphs(section: Column) -> Column:
        return F.transform(F.split(section, "\n", -1), chunks)

    return F.transform(F.split(text, "\n\n", -1), paragraphs)


def with_tree(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with columns `name` (the fingerprint) and `name`_tree (its sections, paragraphs and chunks) for a text.

    The tree is an array of sections (node, paragraphs), these of (node, chunks), with nodes as the fingerprint writes them.
    """
    cut = lambda node, n: F.substring(node, 1, n)
    tree = rows.withColumn("__chunks", _chunk_nodes(text))
    tree = tree.withColumn("__paragraphs", F.transform("__chunks", lambda s: F.transform(s, lambda p: F.md5(F.array_join(p, "")))))
    tree = tree.withColumn("__sections", F.transform("__paragraphs", lambda s: F.md5(F.array_join(s, ""))))
    nodes = F.transform(
        F.arrays_zip(F.col("__sections").alias("s"), F.col("__paragraphs").alias("p"), F.col("__chunks").alias("c")),
        lambda x: F.struct(
            cut(x["s"], NODE).alias("node"),
            F.zip_with(x["p"], x["c"], lambda p, c: F.struct(cut(p, NODE).alias("node"), F.transform(c, lambda k: cut(k, LEAF)).alias("chunks"))).alias("paragraphs"),
        ),
    )
    tree = tree.withColumn(f"{name}_tree", nodes)
    written = F.transform(
        f"{name}_tree",
        lambda s: F.concat(
            s["node"], F.lit(":"), F.array_join(F.transform(s["paragraphs"], lambda p: F.concat(p["node"], F.lit("="), F.array_join(p["chunks"], ""))), ",")
        ),
    )
    root = F.substring(F.sha2(F.array_join("__sections", ""), 256), 1, ROOT)
    return tree.withColumn(name, F.concat(root, F.lit("|"), F.array_join(written, ";"))).drop("__chunks", "__paragraphs", "__sections")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _holds(ordered: Column, node: Column) -> Column:
    """Whether an ordered array holds the node: halving the range, so that a lookup in n nodes takes log2 n steps."""
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    first = F.aggregate(
        F.sequence(F.lit(1), F.length(F.bin(F.size(ordered)))),
        F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(ordered, middle(s)) < node, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
        lambda s: s["lo"],
    )
    halved = F.coalesce(F.get(ordered, first) == node, F.lit(False))
    return F.when(F.size(ordered) <= FEW, F.array_contains(ordered, node)).otherwise(halved)


def likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with the likeness of the fingerprints in columns a and b, made by with_tree.

    Common nodes are ordered once and looked up by halving; sets are sets of strings, which Spark hashes.
    """
    nodes = lambda x: F.transform(x, lambda n: n["node"])
    inside = lambda x, common: F.filter(x, lambda n: _holds(common, n["node"]))
    outside = lambda x, common: F.filter(x, lambda n: ~_holds(common, n["node"]))
    named = lambda x, size: F.transform(x, lambda n: F.concat(n["node"], size(n).cast("string")))
    sized = lambda x, size: _sum(F.transform(F.array_distinct(named(x, size)), lambda y: F.substr(y, F.lit(NODE + 1)).cast("int")))
    x, y = F.col(f"{a}_tree"), F.col(f"{b}_tree")
    out = rows.withColumn("__sections", F.sort_array(F.array_intersect(nodes(x), nodes(y))))
    whole = sized(inside(x, F.col("__sections")), lambda n: _sum(F.transform(n["paragraphs"], lambda p: F.size(p["chunks"]))))
    rest = {c: F.flatten(F.transform(outside(t, F.col("__sections")), lambda n: n["paragraphs"])) for c, t in (("__x", x), ("__y", y))}
    out = out.withColumns({"__whole": whole, **rest}).withColumn("__paragraphs", F.sort_array(F.array_intersect(nodes(F.col("__x")), nodes(F.col("__y")))))
    more = sized(inside(F.col("__x"), F.col("__paragraphs")), lambda n: F.size(n["chunks"]))
    left = {c: F.array_distinct(F.flatten(F.transform(outside(F.col(c), F.col("__paragraphs")), lambda n: n["chunks"]))) for c in ("__x", "__y")}
    out = out.withColumns({"__whole": F.col("__whole") + more, **left})
    common = F.col("__whole") + F.size(F.array_intersect("__x", "__y"))
    total = 2 * F.col("__whole") + F.size("__x") + F.size("__y")
    value = F.when(total > 0, 2.0 * common / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0))
    equal = F.substring(F.col(a), 1, ROOT) == F.substring(F.col(b), 1, ROOT)
    return out.withColumn(name, F.when(equal, F.lit(1.0)).otherwise(value)).drop("__sections", "__whole", "__x", "__y", "__paragraphs")


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Array of (section, paragraph) numbers, from 0, at which two fingerprints differ.

    Descends only into sections whose nodes differ. Sections or paragraphs that only one of
    the two has are differences too.
    """
    sections = lambda f: F.split(F.element_at(F.split(f, r"\|"), 2), ";")

    def paragraphs(s: Column) -> Column:
        listed = F.split(F.element_at(F.split(s, ":"), 2), ",")
        return F.when(s.isNull(), F.array().cast("array<string>")).otherwise(listed)

    def within(pair: Column, i: Column) -> Column:
        differ = F.zip_with(
            paragraphs(pair["a"]), paragraphs(pair["b"]), lambda p, q: ~F.substring(p, 1, NODE).eqNullSafe(F.substring(q, 1, NODE))
        )
        spots = F.transform(differ, lambda d, k: F.when(d, F.struct(i.alias("section"), k.alias("paragraph"))))
        same_node = F.substring(pair["a"], 1, NODE).eqNullSafe(F.substring(pair["b"], 1, NODE))
        return F.when(same_node, F.filter(spots, lambda _: F.lit(False))).otherwise(F.filter(spots, lambda x: x.isNotNull()))

    pairs = F.zip_with(sections(a), sections(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(pairs, within))


def range_bounds(ids: DataFrame) -> tuple[list[int], int]:
    """At most MAX_RANGES quantiles of doc_id that part the rows with an id evenly, and the number of ranges for those without."""
    n = ids.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("named")).first()
    parts = min(MAX_RANGES, -(-n["named"] // RANGE_ROWS))
    unnamed = min(MAX_RANGES, max(1, -(-(n["all"] - n["named"]) // RANGE_ROWS)))
    if parts < 2:
        return [], unnamed
    exact = max(10_000, min(1_000_000, 10 * parts))
    found = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], exact).alias("q")).first()["q"]
    return sorted(set(found)), unnamed


def _range_of(doc_id: Column, digest: Column, bounds: list[int], unnamed: int) -> Column:
    """Number of bounds at or above the id: 0 for the greatest ids; null ids come last, by their leading digest digits."""
    last = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * unnamed / float(16**8)).cast("int") + len(bounds) + 1
    if not bounds:
        return F.when(doc_id.isNull(), last).otherwise(F.lit(0))
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    # Binary search: the number of bounds below the id.
    below = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(bounds).bit_length())),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(listed, middle(s)) < doc_id, F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))),
        lambda s: s["lo"],
    )
    return F.when(doc_id.isNull(), last).otherwise(F.lit(len(bounds)) - below)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: of the document that follows in descending doc_id; after the last, the first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    picked = picked.withColumn("digest", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)))  # of unnamed rows only
    bounds, unnamed = range_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    ranged = picked.withColumn("part", _range_of(F.col("doc_id"), F.col("digest"), bounds, unnamed))
    # One row a range: its first document, and the range before it, which that document closes.
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"), F.min("digest").alias("head_digest"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    heads = materialize(heads.select("head", "head_digest", before.alias("closes")), "merkle-heads")
    named = F.col("doc_id").eqNullSafe(F.col("head")) & F.col("digest").eqNullSafe(F.col("head_digest"))
    found = ranged.join(F.broadcast(heads), named, "left")
    own = F.struct(F.col("part"), F.lit(0).alias("guest"))
    places = F.when(F.col("closes").isNotNull(), F.array(own, F.struct(F.col("closes").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    dealt = found.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.guest")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.sha2("text", 256))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").drop("part", "guest")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    rows = with_next(docs).withColumn("__edited", edited(F.col("text"), F.col("next_text")))
    rows = with_tree(rows, F.col("text"), "fingerprint")
    rows = with_tree(rows, F.col("__edited"), "edited_fingerprint")
    rows = with_tree(rows, F.col("next_text"), "__next")
    rows = likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = likeness(rows, "fingerprint", "__next", "near_next")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
