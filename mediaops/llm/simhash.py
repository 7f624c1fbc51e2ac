"""SimHash near-duplicates by multi-index hashing.

A fingerprint is one long. It is cut into two segments of 32 bits. Fingerprints at most two bits apart either
differ in at most one bit of the upper segment, or agree in the lower one. So the table of the upper segment is
probed with that segment's Hamming ball of radius one, the table of the lower segment with the segment itself,
and every match is verified on all 64 bits. Only the upward half of a ball is enumerated (bits that are 0): of
two segments one bit apart, one has the bit unset and finds the other.

A segment value that very many different fingerprints share (a large family of near copies) would give all pairs
within it. Fingerprints that touch such a crowded value are linked another exact way: the radius-one balls of
both segments are enumerated with the other segment held. Two fingerprints meet in such a point exactly if they
are at most two bits apart, and at most 65 different fingerprints can surround a point, so no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import add_columns, word_pieces
from mediaops.llm.components import connected_components
from mediaops.session import materialise

SHINGLE = 3
SEED = 42
#: Fingerprints in one entry of a segment table from which on it counts as crowded.
CROWDED = 64
_SLICE = 1 << 16


def shingle_hashes(text: str | None, words: int = SHINGLE):
    """Arrays of the hashes of a text's word shingles, repeats included, in pieces; a text of fewer words is one
    shingle, one without words yields nothing."""
    import numpy as np
    from xxhash import xxh64_intdigest

    some, tail = False, []
    for piece in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        run = tail + piece
        tail = run[max(0, len(run) - words + 1):]
        for at in range(0, len(run) - words + 1, _SLICE):
            part = run[at:at + _SLICE + words - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(words))))
            yield np.fromiter([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
            some = True
    if tail and not some:
        yield np.array([xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def bits_of(hashes) -> int:
    """The fingerprint of the shingles whose hashes the arrays hold, as a signed 64-bit number; 0 for none."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number."""
    return bits_of(shingle_hashes(text, words))


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of every whole text: a bit is 1 if it is set in over half the hashes of the word
    shingles, repeats included. A null or blank text has fingerprint 0; one shorter than a shingle is its own
    shingle. Other columns pass through; a column named ``out`` is replaced."""

    def run(texts):
        import pyarrow as pa

        return [pa.array([fingerprint_of(t, words) for t in texts.to_pylist()], pa.int64())]

    return add_columns(df, [text], f"`{out}` long", run)


def add_sketches(df: DataFrame, words: int) -> DataFrame:
    """Adds ``fp`` and the min-hash ``bands`` (null for a text without words) of the column ``text``."""
    from mediaops.llm.resemblance import sketch_of

    def run(texts):
        import pyarrow as pa

        prints, sketches = [], []
        for text in texts:
            hashes = list(shingle_hashes(text.as_py(), words))
            prints.append(bits_of(hashes))
            sketches.append(sketch_of(hashes))
        return [pa.array(prints, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]

    return add_columns(df, ["text"], "fp long, bands array<long>", run)


def links(nodes: DataFrame, crowded_at: int = CROWDED) -> DataFrame:
    """Edges ``a, b`` that connect the different fingerprints ``fp`` at most two bits apart.

    ``nodes`` holds each fingerprint once. Outside crowded segment values each pair is an edge; inside, the
    fingerprints around one point are joined to the least of them, which connects the same ones.
    """
    upper, lower = "shiftrightunsigned(fp, 32)", "fp & 4294967295L"
    table = nodes.selectExpr("fp", f"explode(array(struct(0 AS seg, {upper} AS v), struct(1 AS seg, {lower} AS v))) AS e"
                             ).select("fp", "e.seg", "e.v")
    crowded = materialise(table.groupBy("seg", "v").count().where(F.col("count") > crowded_at).select("seg", "v"), "crowded")
    ball = f"""transform(filter(sequence(-1, 31), i -> i < 0 OR ({upper} & shiftleft(1L, i)) = 0),
                         i -> struct(0 AS seg, IF(i < 0, {upper}, {upper} | shiftleft(1L, i)) AS v))"""
    probes = nodes.selectExpr("fp", f"explode(array_append({ball}, struct(1 AS seg, {lower} AS v))) AS e"
                              ).select(F.col("fp").alias("probe"), "e.seg", "e.v")
    pairs = (table.join(crowded, ["seg", "v"], "left_anti").join(probes, ["seg", "v"])
             .where("probe <> fp AND bit_count(probe ^ fp) <= 2")
             .select(F.greatest("fp", "probe").alias("a"), F.least("fp", "probe").alias("b")))
    touching = probes.join(crowded, ["seg", "v"], "left_semi").select(F.col("probe").alias("fp")).distinct()
    points = touching.selectExpr("fp", "explode(transform(sequence(-1, 63), i -> IF(i < 0, fp, fp ^ shiftleft(1L, i)))) AS p")
    around = points.groupBy("p").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
    stars = around.selectExpr("fps[0] AS b", "explode(slice(fps, 2, size(fps) - 1)) AS a").where("bit_count(a ^ b) <= 2")
    return pairs.unionByName(stars).distinct()


def _labelled(df: DataFrame, key: str, text: str, words: int, alike: float | None = None) -> DataFrame:
    """``key, h, fp, root, component_id`` of every row; ``h`` tells texts of one key apart. With ``alike``, texts whose
    shingle sets are at least so similar are linked too."""
    named = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    added = add_fingerprints(named, "text", "fp", words) if alike is None else add_sketches(named, words)
    rows = materialise(added.drop("text"), "prints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    edges = links(nodes)
    if alike is not None:
        from mediaops.llm.resemblance import resemblance_links

        edges = materialise(edges, "links")
        edges = edges.unionByName(resemblance_links(rows, named, edges, words, alike))
    roots = connected_components(edges)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = materialise(rooted.join(names, "root").select("fp", "root", "component_id"), "labels")
    return rows.select("key", "h", "fp").join(labels, "fp")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """``key, fp, component_id`` for every row: the smallest key that links of at most two bits reach.

    Equal texts share a fingerprint and are reduced before any link is looked for. Repeated keys are kept as
    rows; a null key is never the name of a component unless no member has one. An empty table gives no rows.
    """
    return _labelled(df, key, text, words).select(F.col("key").alias(key), "fp", "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, alike: float | None = 0.8) -> DataFrame:
    """The rows of ``df`` without near copies, columns as in ``df``: of each component the row with the smallest
    key stays; rows without a key stay only where no member has one. Shingles of five words by default. Texts are
    linked by fingerprints at most two bits apart, or by shingle sets at least ``alike`` (see ``resemblance``). Of rows
    alike in key and text that differ elsewhere the one whose columns hash least stays."""
    found = _labelled(df, key, text, words, alike)
    order = F.struct(F.col("key").isNull().alias("no"), "key", "h")
    chosen = found.groupBy("root").agg(F.min(order).alias("c")).select(
        F.col("c.key").alias("__chosen_key"), F.col("c.h").alias("__chosen_h"))
    marked = df.withColumn("__h", F.xxhash64(F.col(f"`{text}`").cast("string")))
    met = marked.join(chosen, F.col(f"`{key}`").eqNullSafe(F.col("__chosen_key")) & (F.col("__h") == F.col("__chosen_h")))
    # rows alike in key and text: the one whose other columns hash least
    place = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind))
    one = met.groupBy("__chosen_key", "__chosen_h").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), place).alias("__row"))
    return one.select([F.col("__row")[c].alias(c) for c in df.columns])
