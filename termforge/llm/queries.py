"""The queries of this subpackage, and SQL for those that SQL can express.

Each takes (spark, sf_dir) and applies one operator, with production parameters, to a whole
table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termforge.config import ship_package
from termforge.llm import bytebpe, hardnegatives, licenses, merkle, mixing, ngramjoin, orcstore, periodicity, quality, sharding, tokencount, toxicity, urlfilter

UNIGRAM_PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def docs(operator):
        return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))

    return {
        "op1_quality_rules": docs(quality.judge_documents),
        "op2_sharding": docs(sharding.shard_documents),
        "op3_token_counts": docs(lambda d: tokencount.count_tokens(d, UNIGRAM_PIECES)),
        "op4_token_ids_orc": docs(lambda d: orcstore.encode_documents(d, WORD_TOKENIZER)),
        "op5_ngram_jaccard_join": docs(ngramjoin.link_documents),
        "op6_source_mixing": docs(mixing.mix_documents),
        "op7_merkle_fingerprints": docs(merkle.fingerprint_documents),
        "op8_url_filters": lambda spark, sf_dir: urlfilter.judge_pages(_table(spark, sf_dir, "pages")),
        "op9_byte_bpe": docs(lambda d: bytebpe.code_documents(d, BYTE_RANKS, public_tokenizers.PATTERN)),
        "op10_toxicity": lambda spark, sf_dir: toxicity.score_documents(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "op11_license_scans": docs(licenses.label_documents),
        "op12_hard_negatives": lambda spark, sf_dir: hardnegatives.mine_embeddings(_table(spark, sf_dir, "embeddings")),
        "op13_periodic_runs": docs(periodicity.digest_runs),
    }


def _tree_sql(text: str) -> str:
    """A struct of a text's sections, paragraphs and chunks, as nested lists of MD5s."""
    return f"""list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
      lambda p: list_transform(regexp_extract_all(p, '{merkle.CHUNK}'), lambda c: md5(c))))"""


def _print_sql(tree: str) -> str:
    """The fingerprint of such lists."""
    nodes = f"list_transform({tree}, lambda s: list_transform(s, lambda p: md5(array_to_string(p, ''))))"
    sections = f"list_transform({nodes}, lambda s: md5(array_to_string(s, '')))"
    paragraph = "substr(md5(array_to_string(p, '')), 1, 8) || '=' || array_to_string(list_transform(p, lambda c: substr(c, 1, 6)), '')"
    section = f"""substr(md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')), 1, 8) || ':' || array_to_string(list_transform(s, lambda p: {paragraph}), ',')"""
    return f"substr(sha256(array_to_string({sections}, '')), 1, 32) || '|' || array_to_string(list_transform({tree}, lambda s: {section}), ';')"


def _nodes_sql(tree: str) -> str:
    """The lists as sections (node, paragraphs (node, chunks)), with nodes cut as fingerprints write them."""
    return f"""list_transform({tree}, lambda s: {{'node': substr(md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')), 1, 8),
      'ps': list_transform(s, lambda p: {{'node': substr(md5(array_to_string(p, '')), 1, 8), 'cs': list_transform(p, lambda c: substr(c, 1, 6))}})}})"""


def _like_sql(a: str, b: str) -> tuple[str, ...]:
    """CTEs that follow y: common sections, then common paragraphs of the rest, then common chunks of what is left."""
    n = f"{a}{b}"
    names = lambda x: f"list_transform({x}, lambda n: n.node)"
    sums = lambda x: f"coalesce(list_sum(list_transform(list_distinct({x}), lambda n: n.k)), 0)"
    whole = sums(f"list_transform(list_filter(t{a}, lambda n: list_contains(s{n}, n.node)), lambda n: {{'node': n.node, 'k': list_sum(list_transform(n.ps, lambda p: len(p.cs)))}})")
    rest = lambda t: f"flatten(list_transform(list_filter(t{t}, lambda n: NOT list_contains(s{n}, n.node)), lambda n: n.ps))"
    more = sums(f"list_transform(list_filter(u{n}, lambda n: list_contains(p{n}, n.node)), lambda n: {{'node': n.node, 'k': len(n.cs)}})")
    left = lambda t: f"list_distinct(flatten(list_transform(list_filter({t}{n}, lambda n: NOT list_contains(p{n}, n.node)), lambda n: n.cs)))"
    return (
        f"SELECT *, list_intersect({names('t' + a)}, {names('t' + b)}) AS s{n} FROM ",
        f"SELECT *, {whole} AS k{n}, {rest(a)} AS u{n}, {rest(b)} AS v{n} FROM ",
        f"SELECT *, list_intersect({names('u' + n)}, {names('v' + n)}) AS p{n} FROM ",
        f"SELECT *, {more} AS m{n}, {left('u')} AS x{n}, {left('v')} AS y{n} FROM ",
        f"""SELECT *, CASE WHEN substr(f{a}, 1, 32) = substr(f{b}, 1, 32) THEN 1.0::DOUBLE WHEN 2 * (k{n} + m{n}) + len(x{n}) + len(y{n}) = 0 THEN 0.0::DOUBLE
          ELSE 2.0::DOUBLE * (k{n} + m{n} + len(list_intersect(x{n}, y{n}))) / (2 * (k{n} + m{n}) + len(x{n}) + len(y{n})) END AS like_{n} FROM """,
    )


def _chain(first: str, *steps: str) -> str:
    out = first
    for step in steps:
        out = f"{step}({out})"
    return out


_FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, sha256(t))),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS et FROM n),
x AS (SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, {_tree_sql('t')} AS xa, {_tree_sql('et')} AS xb, {_tree_sql('nt')} AS xc FROM e),
y AS (SELECT *, {_print_sql('xa')} AS fa, {_print_sql('xb')} AS fb, {_print_sql('xc')} AS fc, {_nodes_sql('xa')} AS ta, {_nodes_sql('xb')} AS tb, {_nodes_sql('xc')} AS tc FROM x)
SELECT doc_id, n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, like_ab AS near_edited, like_ac AS near_next FROM ({_chain('SELECT * FROM y', *_like_sql('a', 'b'), *_like_sql('a', 'c'))})"""

_MIX = f"""
WITH RECURSIVE z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
d AS (SELECT *, greatest(length(bin(size)) - 5, 0) * 16 + size // (2 ** greatest(length(bin(size)) - 5, 0))::BIGINT AS cls FROM z),
s AS (SELECT source, sum(size)::DOUBLE AS words FROM z GROUP BY 1),
k AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * words / weight AS turn FROM k),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(words) FROM s) - coalesce(sum(2.0::DOUBLE * words) OVER (ORDER BY turn, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY turn, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, words, CASE WHEN level >= turn THEN 2.0::DOUBLE * words ELSE weight * (SELECT arg_min(level, (turn, source IS NULL, source)) FROM l WHERE level < turn) END AS target FROM l),
c AS (SELECT *, CASE WHEN words > 0 THEN floor(least(target / words, 2.0::DOUBLE)) ELSE 0 END AS certain FROM t),
o AS (SELECT *, CASE WHEN words > 0 THEN (target - certain * words) / words ELSE 0 END AS share FROM c),
g AS (SELECT source, cls, count(*) AS n, sum(size)::DOUBLE AS w, sum(size::HUGEINT * size)::DOUBLE AS q, max(size)::DOUBLE AS top FROM d GROUP BY 1, 2),
h AS (SELECT g.*, share, row_number() OVER (PARTITION BY g.source ORDER BY cls DESC) AS step FROM g JOIN o ON g.source IS NOT DISTINCT FROM o.source),
walk(source, step, carry, cls, n, w, even, take) AS (
  SELECT source, 0::BIGINT, 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BOOLEAN, NULL::BIGINT FROM o
  UNION ALL
  SELECT source, step, due - CASE WHEN take = n THEN w WHEN take * top >= w THEN take * w / n ELSE take * q / greatest(w, 1.0::DOUBLE) END, cls, n, w, take * top >= w, take FROM (
    SELECT *, greatest(least(CASE WHEN w > 0 THEN floor(due / (q / greatest(w, 1.0::DOUBLE)) + 0.5::DOUBLE) ELSE 0 END::BIGINT, n), 0)::BIGINT AS take FROM (
      SELECT h.source, h.step, h.share * h.w + walk.carry AS due, h.cls, h.n, h.w, h.q, h.top
      FROM walk JOIN h ON h.source IS NOT DISTINCT FROM walk.source AND h.step = walk.step + 1))),
p AS (SELECT d.doc_id, d.source, d.size, d.cls, d.u, n, take, CASE WHEN take = n THEN 1.0::DOUBLE WHEN even THEN take::DOUBLE / n ELSE take * d.size / greatest(w, 1.0::DOUBLE) END AS inclusion
  FROM d JOIN walk ON walk.step > 0 AND walk.cls = d.cls AND d.source IS NOT DISTINCT FROM walk.source),
q AS (SELECT *, CASE WHEN inclusion > 0 AND inclusion < 1 THEN (u / (1 - u)) / (inclusion / (1 - inclusion)) END AS rank FROM p),
x AS (SELECT *, row_number() OVER (PARTITION BY source, cls ORDER BY rank) AS place FROM q)
SELECT doc_id, size, words::BIGINT AS source_size, target, (size * (certain + (inclusion = 1 OR (rank IS NOT NULL AND place <= take))::INTEGER))::BIGINT AS taken, inclusion
FROM x JOIN o ON x.source IS NOT DISTINCT FROM o.source"""


def _shards_sql(n_shards: int = 24) -> str:
    """CRC-32 by its byte table; the permutation's rounds as nested selects, repeated while the place is n or more."""
    rounds = "SELECT row, step, n, a, b, place % a AS l, place // a AS r FROM walk, sides WHERE step = 0 OR place >= n"
    for i in range(sharding.ROUNDS):
        half, side, move = ("r", "a", "l") if i % 2 == 0 else ("l", "b", "r")
        moved = f"({move} + ('0x' || substr(md5('{sharding.KEY}:{i}:' || {half}), 1, 12))::BIGINT % {side}) % {side} AS {move}"
        rounds = f"SELECT row, step, n, a, b, {moved}, {half} FROM ({rounds})"
    return f"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(1, 9)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(n))),
d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(t[((xor(c, x)) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32 FROM d, tab),
o AS (SELECT *, row_number() OVER (ORDER BY md5('{sharding.KEY}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || text_crc32), doc_id, size, text_crc32) - 1 AS row FROM e),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*))))::BIGINT AS a FROM documents)),
walk AS (SELECT row, 0 AS step, row AS place FROM o UNION ALL SELECT row, step + 1, l + r * a FROM ({rounds}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {n_shards})::INTEGER AS shard, place // {n_shards} AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN walk USING (row) CROSS JOIN sides WHERE step > 0 AND place < n"""

#: CRC-32's byte table, by its polynomial, and the CRC of an ASCII string.
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(1, 9)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(n)))"""


def _crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)),
    lambda c, x: xor(t[((xor(c, x)) & 255) + 1], c >> 8)), 4294967295::BIGINT)"""


_RUNS = f"""
WITH {_CRC_TABLE},
c AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc_sql('doc_id::VARCHAR')} AS h FROM documents, tab),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
e AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
u AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
q AS (SELECT x.r, x.i, y.i - x.i AS q FROM u x JOIN u y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM q),
s AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
m AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM m),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM u ANTI JOIN d USING (r, i) GROUP BY r),
b AS (SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length::DOUBLE / period, start, period)) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM m GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, n::BIGINT AS n_words
FROM e LEFT JOIN b USING (r) LEFT JOIN k USING (r)"""

_NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r AS other, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
n AS (SELECT p.anchor_id, p.r, p.other, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, s.other AS o
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, other ORDER BY negative_score DESC, negative_id NULLS LAST, o)::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n QUALIFY rank <= 10"""


def _licenses_sql() -> str:
    """Every block against every template, counted in full."""
    need = lambda t: math.ceil(licenses.THRESHOLD * len(set(t.text.split())) - 1e-9)
    templates = ", ".join(
        f"({i}, '{t.label}', {need(t)}, {licenses.SPREAD * len(t.text.split())}, {len(set(t.text.split()))}, {len(set(t.keys))})" for i, t in enumerate(licenses.TEMPLATES)
    )
    tokens = ", ".join(f"({i}, '{w}', {w in t.keys})" for i, t in enumerate(licenses.TEMPLATES) for w in sorted(set(t.text.split())))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    word, half = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", licenses.BLOCK // 2
    return rf"""
WITH templates(t, label, need, width, size, n_keys) AS (VALUES {templates}), tokens(t, word, is_key) AS (VALUES {tokens}), phrases(phrase, label, k) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT r, unnest(regexp_split_to_array(x, '
[ 	
]*
')) AS x, generate_subscripts(regexp_split_to_array(x, '
[ 	
]*
'), 1) AS g FROM d),
gw AS (SELECT r, g, regexp_extract_all(x, '{word}') AS ws FROM g),
w AS (SELECT r, g, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM gw),
a AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY g, i) - 1 AS pos FROM w),
f AS (SELECT r, pos, phrases.label FROM (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM a WINDOW o AS (PARTITION BY r ORDER BY pos)) x
  JOIN phrases ON phrase = CASE k WHEN 2 THEN word || ' ' || w1 ELSE word || ' ' || w1 || ' ' || w2 || ' ' || w3 END),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM f GROUP BY r),
h AS (SELECT r, g, i, word, unnest(range(greatest(0, (i - {licenses.BLOCK - half}) // {half} * 1), i // {half} + 1)) AS block, size FROM a WHERE word IN (SELECT word FROM tokens)),
k AS (SELECT r, g, block, i, t, word, is_key FROM h JOIN tokens USING (word) WHERE i >= block * {half} AND i < block * {half} + {licenses.BLOCK} AND (block = 0 OR block * {half} < size - {half})),
c AS (SELECT r, g, block, t FROM k JOIN templates USING (t) GROUP BY r, g, block, t HAVING count(DISTINCT word) >= any_value(need)),
s AS (SELECT r, g, block, t, y.i, count(DISTINCT x.word) AS n, count(DISTINCT CASE WHEN x.is_key THEN x.word END) AS n_k
  FROM c JOIN templates USING (t) JOIN k y USING (r, g, block, t) JOIN k x USING (r, g, block, t) WHERE x.i > y.i - width AND x.i <= y.i GROUP BY r, g, block, t, y.i),
m AS (SELECT r, g, block, t, any_value(label) AS label, max(n)::DOUBLE / any_value(size) AS containment FROM s JOIN templates USING (t) WHERE n >= need AND n_k = n_keys GROUP BY r, g, block, t),
z AS (SELECT r, count(*) AS n_matches, max(containment) AS score, list(label) AS labels FROM m GROUP BY r)
SELECT doc_id, (SELECT count(*) FROM a WHERE a.r = d.r)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(z.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM d LEFT JOIN b USING (r) LEFT JOIN z USING (r)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators whose functions DuckDB has."""
    return {"op2_sharding": _shards_sql(), "op6_source_mixing": _MIX, "op7_merkle_fingerprints": _FINGERPRINTS, "op11_license_scans": _licenses_sql(), "op12_hard_negatives": _NEGATIVES, "op13_periodic_runs": _RUNS}
