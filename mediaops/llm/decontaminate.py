"""Benchmark passages in documents, by a prefix-filtered set join.

A window (``WINDOW`` words in a row of an item, or a whole shorter item) is the set of its word shingles. It has to be
contained as a whole, so one shingle is prefix enough: the rarest. Documents are joined with the windows on that shingle
only; its place in the window gives where the window would start, both ends must lie inside the stretch (positional and
length bounds), and the words themselves decide.

Documents would give a row per word, so one pass first keeps the stretches that can hold a window at all: enough shingles
in a row whose bit is set in a bitmap of the windows' shingles. The bitmap has a fixed size; with a large benchmark more
passes it, and nothing is ever missed. Equal stretches (copies, common passages) are then worked on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.session import materialise

WINDOW = 10
SHINGLE = 3
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap of window shingles: 8 MB, whatever the benchmark.
BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes hashed at once.
_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Hashes of all words of many texts at once, from running sums over their bytes.

    A word is a polynomial in an odd base modulo 2^64 over random numbers for its bytes; the difference of two running sums,
    divided by the power where the word starts, is its value.
    """

    def __init__(self):
        import numpy as np

        draw = np.random.default_rng(13)
        byte = np.arange(256)
        self.inside = ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A)) | (byte >= 0x80)
        upper = (byte >= 0x41) & (byte <= 0x5A)
        self.inside |= upper
        self.lower = np.where(upper, byte + 32, byte).astype(np.uint8)
        self.number = draw.integers(0, 1 << 63, 256, np.uint64)[self.lower]
        self.mixers = draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers = None

    def powers(self, n: int):
        import numpy as np

        if self._powers is None or len(self._powers[0]) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self._powers = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, inverse))
        return self._powers

    def words(self, data, cuts):
        """``starts, ends, hashes`` of the words of ``data`` (bytes as an array), none across a cut (where a text starts)."""
        import numpy as np

        inside = self.inside[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        starts = np.flatnonzero(after & (~before | edge))
        ends = np.flatnonzero(before & (~after | edge))
        up, down = self.powers(len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.number[data] * up[:len(data)])])
        hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
        return starts, ends, _mixed(hashes)

    def pieces(self, data):
        """``starts, ends, hashes`` of one long text, piece by piece; pieces end where no word does."""
        import numpy as np

        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + _PIECE)
            while end < len(data):
                outside = np.flatnonzero(~self.inside[data[end:end + _PIECE]])
                if len(outside):
                    end += int(outside[0])
                    break
                end = min(len(data), end + _PIECE)
            s, e, h = self.words(data[at:end], [0])
            found.append((s + at, e + at, h))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found))

    def shingles(self, hashes, k: int):
        """Hashes of ``k`` words in a row, one less than ``k`` fewer than words."""
        import numpy as np

        n = max(0, len(hashes) - k + 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total += hashes[i:i + n] * self.mixers[i]
        return _mixed(total)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bit(shingles, size: int):
    """The bit of each shingle of windows of ``size`` words."""
    import numpy as np

    return (_mixed(shingles + np.uint64(size)) & np.uint64(BITS - 1)).astype(np.int64)


def _groups(column):
    """``(first text, bytes, offsets)`` of runs of texts of an Arrow column: about a piece in size, or one longer text."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + _PIECE, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def _hashed(hasher: Hasher, data, offsets):
    """``starts, ends, hashes, text`` of the words of a group."""
    import numpy as np

    if len(offsets) == 2:
        starts, ends, hashes = hasher.pieces(data) if len(data) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        return starts, ends, hashes, np.zeros(len(starts), np.int64)
    starts, ends, hashes = hasher.words(data, offsets[:-1])
    return starts, ends, hashes, np.searchsorted(offsets, starts, "right") - 1


def _sizes(window: int, shingle: int, size: int) -> tuple[int, int]:
    """Words of a shingle, and shingles, of a window of ``size`` words."""
    k = min(shingle, size)
    return k, size - k + 1


def word_list(column: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(column.cast("string"), _UPPER, _LOWER), F.lit(WORDS), 0), F.array().cast("array<string>"))


def _bitmap(items: DataFrame, window: int, shingle: int):
    """``(sizes of windows that occur, bitmap of their shingles)``."""
    import numpy as np

    def bits(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            for _, data, offsets in _groups(batch.column(0)):
                _, _, hashes, text = _hashed(hasher, data, offsets)
                counts = np.bincount(text, minlength=len(offsets) - 1)
                at = 0
                for n in counts.tolist():
                    own, at = hashes[at:at + n], at + n
                    if n:
                        size = min(n, window)
                        places = _bit(hasher.shingles(own, _sizes(window, shingle, size)[0]), size)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), size, np.int32)), pa.array(places + 1)], names=["size", "bit"])

    found = items.mapInArrow(bits, "size int, bit long").groupBy("size", F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out, sizes = np.zeros(BITS // 8, np.uint8), set()
    merged = found.groupBy("bucket").agg(F.bitmap_or_agg("bits"), F.collect_set("size"))  # at most BITS / 32768 rows of 4 KB
    for bucket, part, some in merged.collect():
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(part, np.uint8)
        sizes |= set(some)
    return sorted(sizes), out


def _stretches(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``key, place, n_words, runs`` of every document: ``runs`` are its stretches that may hold a window, with their words."""
    sizes, bitmap = _bitmap(items, window, shingle)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        hasher, bits = Hasher(), shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.string())]))
        for batch in batches:
            n_words, runs = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for first, data, offsets in _groups(batch.column(2)):
                starts, ends, hashes, text = _hashed(hasher, data, offsets)
                counts = np.bincount(text, minlength=len(offsets) - 1)
                n_words[first:first + len(counts)] = counts
                inside = np.zeros(len(hashes) + 1, np.int64)
                for size in sizes:
                    k, need = _sizes(window, shingle, size)
                    places = _bit(hasher.shingles(hashes, k), size)
                    hit = (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
                    hit &= text[:len(hit)] == text[k - 1:k - 1 + len(hit)]
                    at = np.flatnonzero(hit)
                    if len(at) < need:
                        continue
                    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) != 0)) + 1
                    lows, highs = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])]
                    long = highs - lows + 1 >= need
                    np.add.at(inside, lows[long], 1)
                    np.add.at(inside, highs[long] + k, -1)
                at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                if not len(at):
                    continue
                breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) != 0)) + 1
                own = np.concatenate([[0], np.cumsum(counts)])
                for part in np.split(at, breaks):
                    doc = int(text[part[0]])
                    words = b" ".join(hasher.lower[data[starts[i]:ends[i]]].tobytes() for i in part.tolist())
                    runs[first + doc].append({"start": int(part[0] - own[doc]), "words": words.decode("utf-8", "replace")})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(runs, kind)],
                                             names=["key", "place", "n_words", "runs"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "place", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        scan, f"key {kind}, place long, n_words long, runs array<struct<start: long, words: string>>")


def _tokens(words: str, sizes: str) -> str:
    """SQL for ``pos, tok`` of all shingles of an array of words, of each of an array of lengths."""
    return (f"flatten(transform({sizes}, k -> IF(size({words}) < k, CAST(array() AS array<struct<pos: int, tok: string>>), "
            f"transform(sequence(0, size({words}) - k), i -> struct(i AS pos, array_join(slice({words}, i + 1, k), ' ') AS tok)))))")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, spans, contaminated`` for every row of ``docs``.

    ``spans`` (``start, end``, end excluded) are the words inside any occurrence of a window of an item; ``n_hit`` counts
    them. ``items`` lists the names of the items that occur, sorted as strings; an item that has no name marks words but
    is not listed, one of a name used twice is listed once. Null and empty texts have no words, and items without words
    never occur. Repeated rows and keys are rows of their own. Empty tables give no rows or no hits. Other columns are
    not read.
    """
    # stored repetitive rows are far smaller than in memory, so no join here leaves it to their size whether to send a side to all
    named = docs.select(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("place"), F.col(f"`{text}`").cast("string").alias("text"))
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    stored = materialise(_stretches(named, items.select(F.coalesce("text", F.lit("")).alias("text")), window, shingle), "stretches")

    # every different stretch once, with the number of its copies
    runs = stored.select("place", F.explode("runs").alias("run")).select("place", "run.start", "run.words")
    once = materialise(runs.groupBy("words").agg(F.count("*").alias("copies")).withColumn("rid", F.monotonically_increasing_id()), "once")
    held = once.selectExpr("rid", "copies", "split(words, ' ') AS w")

    # every different window once, as its shingles
    of_item = items.select("item", word_list(F.col("text")).alias("w")).where("size(w) > 0")
    of_item = of_item.select("item", F.explode(F.expr(
        f"IF(size(w) < {window}, array(w), transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})))")).alias("w"))
    of_item = materialise(of_item.select("item", F.array_join("w", " ").alias("win")).distinct(), "windows")
    windows = of_item.select("win").distinct().withColumn("w", F.split("win", " "))
    shingles = windows.select("win", F.size("w").alias("size"), F.explode(F.expr(_tokens("w", f"array(least({shingle}, size(w)))"))).alias("t")
                              ).select("win", "size", "t.pos", "t.tok")

    # rarity over all documents; a window with a shingle that nowhere stands can't occur
    lengths = f"array({', '.join(map(str, range(1, shingle + 1)))})"
    seen = materialise(held.select("rid", "copies", F.explode(F.expr(_tokens("w", lengths))).alias("t")).select("rid", "copies", "t.pos", "t.tok").join(
        shingles.select("tok").distinct().hint("merge"), "tok"), "shingles")
    counts = seen.groupBy("tok").agg(F.sum("copies").alias("n"))
    rated = shingles.join(counts, "tok", "left")
    prefix = rated.groupBy("win", "size").agg(
        F.min(F.struct("n", "tok", "pos")).alias("p"), F.count("*").alias("all"), F.count("n").alias("there")).where("all = there")
    prefix = prefix.selectExpr("p.tok AS tok", "win", "size", "p.pos AS inner")

    # join on the rarest shingle; bounds; then the words themselves
    met = seen.select("tok", "rid", "pos").join(prefix.hint("merge"), "tok").selectExpr("rid", "pos - inner AS low", "size", "win").where("low >= 0")
    true = materialise(met.join(held.hint("merge"), "rid").where("low + size <= size(w) AND array_join(slice(w, low + 1, size), ' ') = win").select(
        "rid", "low", "size", "win"), "found")

    merged = """aggregate(array_sort(collect_set(struct(low AS s, low + size AS e))), CAST(array() AS array<struct<s: int, e: int>>),
      (acc, x) -> CASE WHEN size(acc) > 0 AND x.s <= element_at(acc, -1).e
        THEN array_append(slice(acc, 1, size(acc) - 1), struct(element_at(acc, -1).s AS s, greatest(element_at(acc, -1).e, x.e) AS e))
        ELSE array_append(acc, x) END)"""
    spans = true.groupBy("rid").agg(F.expr(merged).alias("spans"))
    names = true.select("rid", "win").distinct().join(of_item.hint("merge"), "win").groupBy("rid").agg(F.collect_set("item").alias("items"))
    results = once.join(spans.hint("merge"), "rid").join(names.hint("merge"), "rid").select("words", "spans", "items")

    # a common passage or shingle is one row on the right of these joins; adaptive execution splits the left
    per_doc = runs.join(results.hint("merge"), "words").groupBy("place").agg(
        F.expr("array_sort(flatten(collect_list(transform(spans, x -> struct(start + x.s AS start, start + x.e AS end)))))").alias("spans"),
        F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items"))
    none = F.expr("CAST(array() AS array<struct<start: long, end: long>>)"), F.expr("CAST(array() AS array<string>)")
    left = stored.where("size(runs) > 0").select("key", "place", "n_words").join(per_doc.hint("merge"), "place", "left").select(
        "key", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    clean = stored.where("size(runs) = 0").select("key", "n_words", none[0].alias("spans"), none[1].alias("items"))
    return left.unionByName(clean).select(
        F.col("key").alias(key), "n_words", F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))
