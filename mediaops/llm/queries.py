"""The operators over the given tables, with the SQL that tells the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def vocabulary(path: str | None = None):
    """The rank file of the byte-level tokenizer, cut by its pattern."""
    import public_tokenizers as tokenizers

    from mediaops.llm.bpe import Vocabulary

    return Vocabulary.load(path or tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary()).drop("text")


@query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import sharding

    placed = sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 over the UTF-8 bytes: the usual table of the reversed polynomial, built by its rule.
_CRC = """
bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS crc FROM bits WHERE k = 8)"""

ORACLES["op10_shard"] = f"""WITH RECURSIVE {_CRC},
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
placed AS (
  SELECT doc_id, size::BIGINT AS size, h, CAST((sum(size) OVER (ORDER BY doc_id) - size) * 16 // sum(size) OVER () AS INT) AS shard
  FROM sized)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM placed, lookup"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.judge(docs, model).drop("text")


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import langid

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import mixing

    mixed = mixing.replicate(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"))
    return mixed.select("doc_id", "copy", "repeats", "mix_key", "source", "lang", "n_chars", "text")


ORACLES["op4_mixture"] = """WITH RECURSIVE sizes AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / sum(1.0::DOUBLE) OVER () * sum(size) OVER () / size::DOUBLE AS rate FROM sizes),
parted AS (SELECT source, ceil(rate / 500)::INT AS parts, rate / ceil(rate / 500)::INT AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 10 * sqrt(mean)) + 20),
drawn AS (
  SELECT doc_id, part, source,
    ('0x' || substr(md5('20|n|' || doc_id || '|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents JOIN parted USING (source), LATERAL (SELECT unnest(range(1, parts + 1)) AS part)),
repeated AS (SELECT doc_id, count(*)::INT AS repeats FROM drawn JOIN cdf ON drawn.source = cdf.source AND c <= u GROUP BY doc_id)
SELECT doc_id, copy::INT AS copy, repeats, ('0x' || substr(md5('20|o|' || doc_id || '|' || copy), 1, 15))::BIGINT AS mix_key,
  source, lang, n_chars, text
FROM documents JOIN repeated USING (doc_id), LATERAL (SELECT unnest(range(0, repeats)) AS copy)"""


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import urls

    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), urls.fit(spark)).drop("url")


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import html

    pages = html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _license_oracle() -> str:
    """The same windows, with every template tried in every window instead of those the bands retrieve."""
    from mediaops.llm import licenses

    shingles, n = [], licenses.SHINGLE
    for name, text in licenses.TEMPLATES.items():
        words = licenses.template_words(text)
        distinct = {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}
        width = 1
        while width < len(words) - n + 1:
            width *= 2
        shingles += [f"('{name}', {len(distinct)}, {width}, '{s}')" for s in sorted(distinct)]
    return f"""WITH known(license, m, width, s) AS (VALUES {", ".join(shingles)}),
words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, '{licenses._UPPER}', '{licenses._LOWER}'), '[^a-z0-9]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS pos FROM words),
hits AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS s FROM runs),
placed AS (
  SELECT doc_id, pos, hits.s, license, m, width, unnest([pos // width, pos // width - 1]) AS k FROM hits JOIN known ON hits.s = known.s),
held AS (
  SELECT doc_id, license, m, count(DISTINCT s) AS n, min(pos) AS first_word FROM placed GROUP BY doc_id, license, m, width, k
  HAVING count(DISTINCT s) >= {licenses.CONTAINMENT} * m)
SELECT doc_id, license, max(n::DOUBLE / m) AS containment, min(first_word)::INT AS first_word FROM held GROUP BY doc_id, license"""


ORACLES["op6_licenses"] = _license_oracle()


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import ann

    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import merkle

    made = merkle.manifest(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))
    return made.drop("steps")


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"

ORACLES["op11_merkle"] = f"""WITH RECURSIVE {_CRC},
chosen AS (
  SELECT doc_id AS d, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])) AS state
  FROM documents, lookup),
leaves AS (
  SELECT doc_id, source, {_LEAF.format(_field("text"))} AS leaf,
    CASE WHEN xor(state, 4294967295) % 2 = 0 THEN {_LEAF.format(_field("replace(text, chr(10), '')"))} END AS changed
  FROM documents JOIN chosen ON doc_id = d),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
lower_nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1
  GROUP BY tree, lvl, pos // 3, n),
subroots AS (SELECT tree, lvl AS height, h AS subroot FROM lower_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (
  SELECT tree, lvl, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM lower_nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3
  UNION ALL
  SELECT NULL, lvl, pos // 3, list(h ORDER BY pos) FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 3),
walk AS (
  SELECT doc_id, tree, 0 AS lvl, pos, coalesce(changed, leaf) AS node, '' AS proof FROM placed
  UNION ALL
  SELECT doc_id, w.tree, w.lvl + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3] || [node] || hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:pos % 3] || hs[pos % 3 + 2:], '')
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.pos // 3),
climb AS (
  SELECT doc_id, 0 AS lvl, w.tree AS pos, node, proof FROM walk w JOIN subroots s ON w.tree = s.tree AND w.lvl = s.height
  UNION ALL
  SELECT doc_id, w.lvl + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3] || [node] || hs[pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:pos % 3] || hs[pos % 3 + 2:], '')
  FROM climb w JOIN runs r ON r.tree IS NULL AND r.lvl = w.lvl AND r.run = w.pos // 3)
SELECT p.doc_id, p.leaf, s.subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = u.h AS verified
FROM placed p JOIN subroots s USING (tree) JOIN upper_nodes u ON u.n = 1 JOIN climb c ON c.doc_id = p.doc_id AND c.lvl = u.lvl"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import whitening

    white = whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediaops.llm import decontaminate

    found = decontaminate.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated")


_ASCII_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op13_decontaminate"] = f"""WITH cut AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ASCII_WORDS}'), []) AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ASCII_WORDS}') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM cut, sizes),
hits AS (
  SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON v.size = p.size AND array_to_string(w[i:i + p.size - 1], ' ') = win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits)
  GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AS contaminated
FROM cut LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)"""
