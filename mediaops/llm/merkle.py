"""A Merkle manifest of a dataset: every row a leaf, one ternary tree per source, one over the sources.

A tree is worked on in superblocks: aligned runs of ``BLOCK`` (a power of three) consecutive nodes, so that each is a whole
subtree. First every superblock is reduced to its top; the tops are the nodes of the next storey, which is cut into
superblocks in turn, until each tree has one left. On the way down the steps above a superblock (the siblings its
top meets up to the root) are cogrouped with its nodes; there the local reduction is finished, local and outer siblings
are joined to proofs, and leaves are folded to the root. No task holds more than one superblock and its few outer steps,
however large a source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.session import materialise

FANOUT = 3
#: Nodes in a superblock, a power of FANOUT.
BLOCK = FANOUT ** 6
#: Superblocks of one source that share one copy of the steps above the source.
_SHARE = 1 << 14
#: Steps above a source are numbered from here on; the two marks hold the source's own root and the root of all.
_CROWN, _SUBROOT, _ROOT = 1000, 999, 1999

_STEPS = "tree long, block long, step int, place int, others string"


def digest(text: str) -> str:
    from hashlib import sha256

    return sha256(text.encode()).hexdigest()


def storeys(nodes: list[str], whole: int) -> list[list[str]]:
    """The nodes of a superblock and of each level above it. ``whole``: nodes of the whole tree. A tree of one superblock
    ends at its root; otherwise every superblock, also a short last one, rises by as many levels."""
    levels = [nodes]
    while len(nodes) > 1 if whole <= BLOCK else FANOUT ** (len(levels) - 1) < BLOCK:
        nodes = [digest("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        levels.append(nodes)
    return levels


def steps_of(levels: list[list[str]], i: int) -> list[tuple[int, str]]:
    """``(place in its run, the run's other digests)`` of node ``i`` and of what it becomes, below the top."""
    steps = []
    for nodes in levels[:-1]:
        run = i - i % FANOUT
        steps.append((i - run, "".join(nodes[run:i] + nodes[i + 1:run + FANOUT])))
        i //= FANOUT
    return steps


def fold(node: str, steps) -> str:
    """The root that a node and its siblings give."""
    for place, others in steps:
        node = digest(others[:64 * place] + node + others[64 * place:])
    return node


def _tops(nodes: DataFrame) -> DataFrame:
    """The storey above ``nodes`` (tree, n, pos, digest): one node per superblock."""

    def top(key, rows):
        import pandas as pd

        n = int(rows["n"].iloc[0])
        levels = storeys(rows.sort_values("pos")["digest"].tolist(), n)
        return pd.DataFrame({"tree": [key[0]], "n": [-(-n // BLOCK)], "pos": [key[1]], "digest": [levels[-1][0]]})

    blocks = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return blocks.groupBy("tree", "block").applyInPandas(top, "tree long, n long, pos long, digest string")


def _outer(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``(steps, roots)``: the steps above every superblock of ``nodes``, and ``tree, digest`` of every root. As many
    storeys as powers of ``BLOCK`` in the largest tree."""
    tops = materialise(_tops(nodes), name)
    if (tops.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.sparkSession.createDataFrame([], _STEPS), tops.select("tree", "digest")
    above, roots = _outer(tops, name)

    def descend(key, rows, outer):
        import pandas as pd

        rows = rows.sort_values("pos")
        levels = storeys(rows["digest"].tolist(), int(rows["n"].iloc[0]))
        rest = list(outer.sort_values("step")[["place", "others"]].itertuples(index=False, name=None))
        made = [(key[0], pos, k, place, others) for i, pos in enumerate(rows["pos"].tolist())
                for k, (place, others) in enumerate(steps_of(levels, i) + rest)]
        return pd.DataFrame(made, columns=["tree", "block", "step", "place", "others"])

    blocks = tops.withColumn("block", F.expr(f"pos div {BLOCK}"))
    steps = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(descend, _STEPS)
    return materialise(steps, name), roots


def _numbered(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows dealt into key ranges, with their ``part`` and their place ``at`` in it, and for every part and tree
    ``part, tree, first, start``: its first place, and the tree's rows in earlier parts."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ids = F.monotonically_increasing_id()
    stored = materialise(dealt.withColumn("part", F.shiftright(ids, 33).cast("int")).withColumn("at", ids.bitwiseAND((1 << 33) - 1)), "ranges")
    spans = stored.groupBy("part", tree).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    return stored, spans.selectExpr("part", tree, "first", "rows", f"sum(rows) OVER (PARTITION BY {tree} ORDER BY part) - rows AS start")


def leaves(df: DataFrame, key: str, source: str, fields: list[str], text: str) -> DataFrame:
    """``key, source, leaf, changed``: the digest of every row, and the one after tampering where ``key`` is chosen for it."""
    def part(column):
        value = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def row(body):
        return F.sha2(F.concat(*(part(body if f == text else F.col(f"`{f}`")) for f in fields)).cast("binary"), 256)

    body = F.col(f"`{text}`").cast("string")
    chosen = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0
    return df.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), row(body).alias("leaf"),
        F.when(chosen & body.contains("\n"), row(F.translate(body, "\n", ""))).alias("changed"))


def manifest(df: DataFrame, key: str = "doc_id", source: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """``key, leaf, subroot, root, steps, proof_sha256, folded_root, verified`` for every row.

    A leaf is the SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value. Leaves of a source
    ascend by key (null first), then digest, so rows that are alike in all fields may stand in for one another. A null
    source is a source, the first. ``steps`` lists ``place, others`` from the leaf up to the root. Rows whose key has
    an even CRC-32 are folded from the text without its line feeds; a null key is never tampered with. An empty table
    gives no rows; columns besides the named ones are not read.
    """
    made = materialise(leaves(df, key, source, list(fields), text), "leaves")
    stored, spans = _numbered(made, "source", ["key", "leaf"])
    totals = spans.groupBy("source").agg(F.sum("rows").alias("n"))
    # sources are numbered as the leaves are, in their own order
    ranged, firsts = _numbered(totals.withColumn("all", F.lit(0)), "all", ["source"])
    trees = materialise(ranged.join(firsts.drop("all"), "part").selectExpr("source AS name", "n", "start + at - first AS tree"), "trees")
    starts = spans.join(trees, spans["source"].eqNullSafe(trees["name"])).selectExpr("part AS p", "name", "first", "start", "tree", "n")
    nodes = materialise(
        stored.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("name"))).selectExpr(
            "tree", "n", "start + at - first AS pos", "key", "leaf AS digest", "changed"), "nodes")

    steps, subroots = _outer(nodes.select("tree", "n", "pos", "digest"), "storey")
    outer = steps.unionByName(_crown(subroots, trees))
    kind = nodes.schema["key"].dataType.simpleString()
    blocks = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return (blocks.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
            .applyInPandas(_finish, f"key {kind}, leaf string, subroot string, root string, steps array<struct<place: int, others: string>>, "
                                    "proof_sha256 string, folded_root string, verified boolean")
            .withColumnRenamed("key", key))


def _crown(subroots: DataFrame, trees: DataFrame) -> DataFrame:
    """The steps above the sources, the source's root and the root of all, for every superblock of every source."""
    nodes = materialise(subroots.selectExpr("0L AS tree", f"{trees.count()}L AS n", "tree AS pos", "digest"), "subroots")
    above, root = _outer(nodes, "crown")
    top = root.first()  # the one root; none for an empty table

    def descend(_, rows, outer):
        import pandas as pd

        rows = rows.sort_values("pos")
        levels = storeys(rows["digest"].tolist(), int(rows["n"].iloc[0]))
        rest = list(outer.sort_values("step")[["place", "others"]].itertuples(index=False, name=None))
        made = []
        for i, (pos, own) in enumerate(zip(rows["pos"].tolist(), rows["digest"].tolist())):
            steps = steps_of(levels, i) + rest
            made += [(pos, _CROWN + k, place, others) for k, (place, others) in enumerate(steps)]
            made += [(pos, _SUBROOT, -1, own)]
        return pd.DataFrame(made, columns=["tree", "step", "place", "others"])

    blocks = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    steps = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(
        descend, "tree long, step int, place int, others string")
    steps = steps.unionByName(trees.select(
        "tree", F.lit(_ROOT).alias("step"), F.lit(-1).alias("place"), F.lit(top["digest"] if top else None).cast("string").alias("others")))
    shared = trees.selectExpr("tree", f"explode(sequence(0L, (n - 1) div {BLOCK * _SHARE})) AS share", "n")
    spread = shared.join(steps, "tree")
    return spread.selectExpr(
        "tree", f"explode(sequence(share * {_SHARE}, least((share + 1) * {_SHARE}, (n - 1) div {BLOCK} + 1) - 1)) AS block", "step", "place", "others")


def _finish(key, rows, outer):
    """Proofs and folded roots of the leaves of one superblock."""
    import pandas as pd

    rows = rows.sort_values("pos")
    levels = storeys(rows["digest"].tolist(), int(rows["n"].iloc[0]))
    marks = {step: others for step, place, others in outer[["step", "place", "others"]].itertuples(index=False, name=None) if place < 0}
    rest = list(outer[outer["place"] >= 0].sort_values("step")[["place", "others"]].itertuples(index=False, name=None))
    above = "".join(others for _, others in rest)
    out = []
    for i, (leaf, changed) in enumerate(zip(rows["digest"].tolist(), rows["changed"].tolist())):
        steps = steps_of(levels, i)
        folded = fold(fold(changed or leaf, steps), rest)
        out.append((leaf, marks[_SUBROOT], marks[_ROOT], [{"place": p, "others": o} for p, o in steps + rest],
                    digest("".join(o for _, o in steps) + above), folded, folded == marks[_ROOT]))
    made = pd.DataFrame(out, columns=["leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", "verified"])
    made.insert(0, "key", rows["key"].to_numpy())
    return made
