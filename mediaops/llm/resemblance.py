"""Links between texts whose sets of word shingles are alike, found where fingerprints are too far apart.

Fingerprints of 64 bits tell a similarity of 0.8 from the rest only at distances whose Hamming balls would reach a
fixed share of all pairs. So candidates come from min-hash bands here (32 bands of 6 rows; two texts of similarity
0.8 share none with probability 6e-5), and exact similarity of the whole shingle sets decides.

No bucket gives all its pairs. Its members are first verified against two of them only: the smallest, and the one that meets
most others, which is the original where there is one. What the links so far connect needs no further look. Members of
buckets that still hold several components are compared by an exact prefix-filter join: their shingles are ordered by how many
of these members hold them, the shorter text of a pair is found by its rarest ones, the longer one looks with its own,
and lengths and places bound what two texts can still share. That join loses no pair of these members. Copies that
fall short of one another keep their own changes first in that order, so they meet nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.components import connected_components
from mediaops.llm.simhash import shingle_hashes
from mediaops.session import materialise

BANDS, ROWS = 32, 6
#: Pairs with one partner in one part.
PART = 512
_STEP = 256


def sketch_of(hashes) -> list[int] | None:
    """One long per band. ``hashes`` yields arrays of shingle hashes; none at all gives ``None``."""
    import numpy as np
    from xxhash import xxh64_intdigest

    draw = np.random.default_rng(7)
    factor = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
    least, any_ = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), False
    for part in hashes:
        for at in range(0, len(part), _STEP):
            np.minimum(least, (part[at:at + _STEP, None] * factor + shift).min(axis=0), out=least)
            any_ = True
    if not any_:
        return None
    keys = [xxh64_intdigest(least[i:i + ROWS].tobytes(), i) for i in range(0, BANDS * ROWS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_set(text: str, words: int):
    """The different shingle hashes of a whole text, sorted."""
    import numpy as np

    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def similarity(one: str, other: str, words: int) -> float:
    """Shared shingles over all shingles of two whole texts."""
    import numpy as np

    sets = shingle_set(one, words), shingle_set(other, words)
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both / max(1, len(sets[0]) + len(sets[1]) - both)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, at: float) -> DataFrame:
    """The ``pairs`` (a, b) at least ``at`` alike. A partner of very many is dealt in parts."""

    def alike(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [similarity(x.as_py(), y.as_py(), words) >= at for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).alias("parts"))
    left = (pairs.join(parts, "b").withColumn("part", F.expr("pmod(xxhash64(a), parts)"))
            .join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a"))
    right = parts.join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b").selectExpr(
        "b", "y", "explode(sequence(0L, parts - 1)) AS part")
    return left.join(right, ["b", "part"]).select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def _shingle_rows(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``h, comp, n, tok``: the different shingles of every member (h, comp), ``n`` in number."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(2)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["h", "comp", "toks"])

    held = members.join(texts, "h").select("h", "comp", "text").mapInArrow(cut, "h long, comp long, toks array<long>")
    return held.select("h", "comp", F.size("toks").alias("n"), F.explode("toks").alias("tok"))


def alike_across(members: DataFrame, texts: DataFrame, words: int, at: float) -> DataFrame:
    """Candidate pairs ``a, b`` of members (``h, comp``) of different components, among them all that are at least ``at`` alike.

    Two sets of n and m >= n shingles are that alike only if they share s >= at / (1 + at) * (n + m), which is at least
    2 at / (1 + at) * n and at least at * m. So they meet in the n - 2 at / (1 + at) * n + 1 rarest ones of the one and the
    m - at * m + 1 rarest ones of the other; where they first meet, each has s left.
    """
    rows = materialise(_shingle_rows(members, texts, words), "shingles")
    # a shingle of one member only joins nothing, but counts as the rarest
    counts = rows.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    kept = rows.join(counts, "tok").groupBy("h", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("toks"))
    placed = kept.select("h", "comp", "n", (F.col("n") - F.size("toks")).alias("own"), F.posexplode("toks").alias("i", "t")).select(
        "h", "comp", "n", (F.col("own") + F.col("i")).alias("i"), "t.tok")
    slack = 1e-9
    share = at / (1 + at)
    found = placed.where(f"i < n - ceil({2 * share} * n - {slack}) + 1").alias("x")
    looking = placed.where(f"i < n - ceil({at} * n - {slack}) + 1").alias("y")
    met = found.join(looking, F.expr(
        f"x.tok = y.tok AND x.comp <> y.comp AND (x.n < y.n OR (x.n = y.n AND x.h < y.h)) AND x.n >= {at} * y.n - {slack} "
        f"AND least(x.n - x.i, y.n - y.i) >= {share} * (x.n + y.n) - {slack}"))
    return met.selectExpr("least(x.h, y.h) AS a", "greatest(x.h, y.h) AS b").distinct()


def resemblance_links(prints: DataFrame, docs: DataFrame, known: DataFrame, words: int, at: float) -> DataFrame:
    """Edges ``a, b`` between fingerprints whose texts are at least ``at`` alike, enough of them to connect all that are.

    ``prints`` holds ``key, h, fp, bands`` of every text (``bands`` null where it has no word), ``docs`` holds ``key, h,
    text``, ``known`` edges between fingerprints that are linked already.
    """
    once = prints.where("bands IS NOT NULL").groupBy("h").agg(
        *(F.first(c).alias(c) for c in ("fp", "bands")), F.min("key").alias("key"))
    entries = materialise(once.select("h", "fp", "key", F.posexplode("bands").alias("band", "v")), "entries")
    shared = entries.groupBy("band", "v").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    met = materialise(entries.join(shared.drop("hi"), ["band", "v"]), "met")
    # the text that copies were made of meets more of them than they meet one another
    popular = met.join(met.groupBy("h").agg(F.sum("n").alias("meets")), "h")
    hubs = popular.groupBy("band", "v").agg(F.max(F.struct("meets", "h")).alias("hub")).select("band", "v", "hub.h").withColumnRenamed("h", "hub")
    names = met.select("h", "fp", "key").distinct()
    # of equal texts the one with the least key, so that copies do not meet before they are reduced
    one = docs.join(names.select(F.col("h").alias("_h"), F.col("key").alias("_key")), F.col("h").eqNullSafe(F.col("_h")) & F.col("key").eqNullSafe(F.col("_key")))
    texts = materialise(one.groupBy("h").agg(F.first("text").alias("text")), "texts")

    def edges(pairs, name):
        ends = names.selectExpr("h AS a", "fp AS fa"), names.selectExpr("h AS b", "fp AS fb")
        return materialise(_verified(pairs, texts, words, at).join(ends[0], "a").join(ends[1], "b")
                           .select(F.col("fa").alias("a"), F.col("fb").alias("b")).where("a <> b").distinct(), name)

    stars = materialise(met.join(hubs, ["band", "v"]).selectExpr("h AS a", "explode(array(lo, hub)) AS b").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    first = edges(stars, "alike")
    roots = connected_components(known.unionByName(first)).withColumnRenamed("node", "fp")
    placed = met.join(roots, "fp", "left").withColumn("comp", F.coalesce("root", "fp"))
    several = placed.groupBy("band", "v").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).where("one <> other")
    members = materialise(placed.join(several, ["band", "v"]).select("h", "comp").distinct(), "members")
    rest = materialise(alike_across(members, texts, words, at).join(stars, ["a", "b"], "left_anti"), "rest")
    return first.unionByName(edges(rest, "alike"))
