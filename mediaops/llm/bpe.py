"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes."""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import DataFrame

from mediaops.llm.common import add_columns

#: Keys per bucket of the hash, on average.
_BUCKET = 4
#: Pre-tokens that one process remembers with their ids before it lets the older ones go, and a third as many words; it
#: holds up to twice as many.
_REMEMBERED = 250_000
#: Characters of a text that are cut at once, and of short texts whose new words are looked up at once.
_CHARS = 1 << 20
#: Ids that are decoded at once.
_IDS = 1 << 16


@dataclass
class PerfectHash:
    """Maps each of n byte strings to its own slot in 0..n-1 (hash and displace).

    A key's 64-bit hash names a bucket and, with the bucket's displacement, a slot. Buckets are placed largest
    first, each with the first displacement that brings all its keys to free slots. Other strings land on some
    slot too, so ``find`` compares the key kept there.
    """

    keys: list
    values: list
    moves: object

    @classmethod
    def build(cls, items: dict[bytes, int]) -> PerfectHash:
        import numpy as np
        from xxhash import xxh64_intdigest

        n = len(items)
        if not n:
            return cls([], [], np.zeros(0, np.uint64))
        names = list(items)
        hashes = np.array([xxh64_intdigest(k) for k in names], np.uint64)
        buckets = (hashes % np.uint64(max(1, n // _BUCKET))).astype(np.int64)
        order = np.argsort(buckets, kind="stable")
        sizes = np.bincount(buckets, minlength=max(1, n // _BUCKET))
        ends = np.cumsum(sizes)
        moves, taken, at = np.zeros(len(sizes), np.int64), np.zeros(n, bool), np.empty(n, np.int64)
        trials = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(-sizes, kind="stable"):
            members = order[ends[b] - sizes[b]:ends[b]]
            if not len(members):
                break
            first = np.uint64(0)
            while True:
                slots = _slots(hashes[members][None, :], trials + first, n)
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    hit = int(free.argmax())
                    moves[b], at[members] = int(first) + hit, slots[hit]
                    taken[slots[hit]] = True
                    break
                first += np.uint64(256)
        keys, values = [b""] * n, [0] * n
        for name, slot in zip(names, at.tolist()):
            keys[slot], values[slot] = name, items[name]
        return cls(keys, values, moves.astype(np.uint64))

    def find(self, names: list[bytes]) -> list[int]:
        """The value of each name, -1 for names that are not keys."""
        import numpy as np
        from xxhash import xxh64_intdigest

        if not self.keys or not names:
            return [-1] * len(names)
        hashes = np.array([xxh64_intdigest(k) for k in names], np.uint64)
        moves = self.moves[(hashes % np.uint64(len(self.moves))).astype(np.int64)]
        keys, values = self.keys, self.values
        return [values[s] if keys[s] == k else -1 for k, s in zip(names, _slots(hashes, moves, len(keys)).tolist())]


def _slots(hashes, moves, n):
    """Slots of hashes under displacements; the mixing lets every displacement deal keys anew."""
    import numpy as np

    x = hashes ^ (moves * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class Vocabulary:
    """Ranks of byte strings and the pattern that cuts texts into pre-tokens.

    ``strays`` maps characters whose class (letter, number, other) differs between the pattern engine here and
    the one of the reference tokenizer to a stand-in of the right class.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, strays: dict[int, str] | None = None):
        self.ranks, self.pattern, self.strays = ranks, pattern, strays or {}
        self.hash = PerfectHash.build(ranks)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._encoder = self._tables = None

    def tables(self):
        """Of every id the bytes of its token (where they start in one long array, how many there are) and its decimal text with
        a space behind, as rows filled up with zeros."""
        import numpy as np

        if self._tables is None:
            n = max(self.bytes_of, default=-1) + 1
            tokens = [self.bytes_of.get(i, b"") for i in range(n)]
            sizes = np.array([len(t) for t in tokens], np.int64)
            wide = len(str(n)) + 1
            decimal = np.zeros((n, wide), np.uint8)
            for i in range(n):
                text = b"%d " % i
                decimal[i, :len(text)] = np.frombuffer(text, np.uint8)
            self._tables = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes, decimal
        return self._tables

    def encoder(self) -> Encoder:
        """One encoder per process, so that what it remembers serves the next task too."""
        self._encoder = self._encoder or Encoder(self)
        return self._encoder

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """Reads a rank file: a line holds a token in base64 and its rank."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern, class_gaps())


def class_gaps() -> dict[int, str]:
    """Characters that the ``regex`` module and tiktoken's engine count to different classes, each with a stand-in.

    The two carry different Unicode versions. tiktoken is asked by encoders that only match one class.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    theirs = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs[name] = set(bytes(coder.encode_ordinary(every)).decode("utf-8"))
    stand_in = {r"\p{L}": "ª", r"\p{N}": "²", r"\s": " "}
    ours = {name: set(regex.findall(name, every)) for name in theirs}
    odd = set().union(*(ours[name] ^ theirs[name] for name in theirs))
    return {ord(c): next((stand_in[n] for n in theirs if c in theirs[n]), "") for c in odd}


def pair_ranks(ranks: dict[bytes, int], width: int) -> dict[int, int]:
    """Rank of the merge of two tokens, by ``left << width | right``."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left << width | right] = rank
    return found


def merge(piece: bytes, single: dict[int, int], pairs: dict[int, int], width: int) -> list[int]:
    """Token ids of one pre-token: the pair with the lowest rank is merged first, the leftmost of equals.

    The parts are a doubly linked list over the bytes, each with its token; a heap holds rank and place of the candidate pairs
    in one number. An entry is stale if it is not the one that its place last got. A token that pairs with nothing
    stands behind the last byte, and so before the first one.
    """
    from heapq import heapify, heappop, heappush

    n = len(piece)
    ids = [single[b] for b in piece]
    ids.append((1 << width) - 1)
    after, before = [*range(1, n + 2)], [*range(-1, n)]
    rank_of, shift = pairs.get, n.bit_length()
    places = (1 << shift) - 1
    ranks = map(rank_of, [a << width | b for a, b in zip(ids, ids[1:])])
    now = [-1 if rank is None else rank << shift | i for i, rank in enumerate(ranks)]
    heap = [entry for entry in now if entry >= 0]
    now.append(-1)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & places
        if now[i] != entry:
            continue
        j = after[i]
        end, left, rank = after[j], before[i], entry >> shift
        ids[i], after[i], before[end], now[i], now[j] = rank, end, i, -1, -1
        found = rank_of(rank << width | ids[end])
        if found is not None:
            now[i] = entry = found << shift | i
            heappush(heap, entry)
        found = rank_of(ids[left] << width | rank)
        if found is not None:
            now[left] = entry = found << shift | left
            heappush(heap, entry)
        elif left >= 0:
            now[left] = -1
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Memo:
    """Remembers values; beyond ``most`` entries the older ones go, unless they are asked for again."""

    def __init__(self, most: int):
        self.most, self.known, self.older = most, {}, {}

    def missing(self, names) -> list:
        """Those of the names that are not remembered; the others are at hand in ``known`` until the next call."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        new = []
        for name in {*names}.difference(self.known):
            if name in self.older:
                self.known[name] = self.older[name]
            else:
                new.append(name)
        return new


class Encoder:
    """Encodes texts within one task; remembers resolved pre-tokens and words up to a bound.

    A text is cut before every space that stands between two other characters: there a pre-token starts, whatever the pattern
    does elsewhere. What follows the space up to the next one is a word here. The pattern cuts new words into pre-tokens;
    new pre-tokens of a whole batch of texts are looked up in the hash at once. Texts with other white space beside a
    space, or with characters on which the two engines differ, are cut by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.words, self.tokens = Memo(_REMEMBERED // 3), Memo(_REMEMBERED)
        self.cut = regex.compile(vocabulary.pattern)
        self.gap = regex.compile(r"(?<=\S)\s")
        self.odd = {chr(c) for c in vocabulary.strays}
        self.beyond = regex.compile(f"[\\U{min(vocabulary.strays):08X}-\U0010FFFF]") if self.odd else None
        self.width = max(vocabulary.ranks.values(), default=0).bit_length() + 1
        self.pairs = pair_ranks(vocabulary.ranks, self.width)
        self.single = {t[0]: i for t, i in vocabulary.ranks.items() if len(t) == 1}

    def strange(self, text: str) -> bool:
        return bool(self.odd) and not text.isascii() and bool(self.beyond.search(text)) and not self.odd.isdisjoint(text)

    def pieces(self, text: str):
        """Lists of pre-tokens. A text is cut only before white space that follows other characters, where no
        pre-token goes on."""
        at = 0
        while at < len(text):
            hit = self.gap.search(text, at + _CHARS) if at + _CHARS < len(text) else None
            end = hit.start() if hit else len(text)
            part = text[at:end] if at or end < len(text) else text
            at = end
            if self.strange(part):
                masked = part.translate(self.v.strays)
                yield [part[m.start():m.end()] for m in self.cut.finditer(masked)]
            else:
                yield self.cut.findall(part)

    def parts(self, text: str):
        """``(first word, words)``, then ``(None, words)``, of stretches of a text that end before a space."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + _CHARS) if at + _CHARS < len(text) else -1
            while end >= 0 and (text[end - 1].isspace() or text[end + 1:end + 2].isspace() or end + 1 == len(text)):
                end = text.find(" ", end + 1)
            part = text[at:end if end >= 0 else len(text)]
            words = part.split(" ")
            yield (None if at else words[0]), words[1:]
            at += len(part)

    def resolve(self, tokens) -> dict:
        """Ids of pre-tokens, packed as bytes: whole ones from the hash, all in one look, the others by merging."""
        from array import array

        new = self.tokens.missing(tokens)
        names = [t.encode("utf-8") for t in new]
        known = self.tokens.known
        for t, name, value in zip(new, names, self.v.hash.find(names)):
            known[t] = array("i", (value,) if value >= 0 else merge(name, self.single, self.pairs, self.width)).tobytes()
        return known

    def encode_all(self, texts):
        """The ids of each text of a batch, as arrays."""
        import numpy as np

        small = sum(map(len, texts)) <= 4 * _CHARS  # longer ones are cut again where they are needed
        found, held = set(), []
        for text in texts:
            parts = list(self.parts(text)) if small else self.parts(text)
            own, ok = set(), True
            for first, rest in parts:
                own.update(rest)
                ok = ok and (first is None or bool(first) and not first[-1].isspace() and not self.strange(first))
            held.append((parts if small else None) if ok else ())
            if ok:
                found |= own
        bad = self._learn(self.words.missing(found))
        for text, parts in zip(texts, held):
            done = None if parts == () and text else self._by_words(self.parts(text) if parts is None else parts, bad)
            yield np.frombuffer(self._by_pattern(text) if done is None else done, np.int32)

    def _learn(self, new: list[str]) -> set[str]:
        """Cuts and resolves new words, all at once: joined by spaces, each begins where a pre-token begins with one. Returns
        those that only the whole text can tell how to cut."""
        odd = self.strange(" ".join(new))
        bad = {w for w in new if not w or w[0].isspace() or w[-1].isspace() or odd and self.strange(w)}
        words = [w for w in new if w not in bad] if bad else new
        if not words:
            return bad
        tokens = self.cut.findall(" " + " ".join(words))
        ids_of, known = self.resolve(tokens), self.words.known
        starts = [i for i, t in enumerate(tokens) if t[0] == " "]
        for w, low, high in zip(words, starts, [*starts[1:], len(tokens)], strict=True):
            known[w] = ids_of[tokens[low]] if high - low == 1 else b"".join([ids_of[t] for t in tokens[low:high]])
        return bad

    def _by_words(self, parts, bad: set[str]) -> bytes | None:
        out, ids_of = [], self.words.known.__getitem__
        for first, rest in parts:
            if bad and not bad.isdisjoint(rest):
                return None
            if first is not None:
                cut = self.cut.findall(first)
                out += map(self.resolve(cut).__getitem__, cut)
            out.append(b"".join(map(ids_of, rest)))
        return b"".join(out)

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.resolve(tokens).__getitem__, tokens)) for tokens in self.pieces(text))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()


def _batches(texts):
    """Slices of an Arrow column of texts, as lists, of about ``_CHARS`` bytes or one longer text each."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < _CHARS):
            some.append(texts[at].as_py() or "")
            size += len(some[-1])
            at += 1
        yield some


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the token ids (array of int) of the whole text, as the rank file gives them, without special
    tokens. A null or empty text has no ids. Other columns pass through; a column named ``out`` is replaced.

    The vocabulary is a fixed file of some ten thousand tokens, sent once to each executor.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts):
        import numpy as np
        import pyarrow as pa

        coder = shared.value.encoder()
        parts, offsets = [], [0]
        for some in _batches(texts):
            for ids in coder.encode_all(some):
                parts.append(ids)
                offsets.append(offsets[-1] + len(ids))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]

    return add_columns(df, [text], f"`{out}` array<int>", run)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes (binary) that the ids stand for. A null list gives no bytes; null or unknown ids in
    a list raise an error. Other columns pass through; a column named ``out`` is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.bytes_of)

    def run(lists):
        import pyarrow as pa

        name = shared.value.__getitem__
        return [pa.array([b"".join(map(name, x.values.to_pylist())) if x.is_valid else b"" for x in lists], pa.binary())]

    return add_columns(df, [ids], f"`{out}` binary", run)


def digest(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` (of the decimal ids, joined by one space) and ``decoded_sha256`` (of the bytes that the ids
    stand for) of every whole text, in one pass. A null or empty text has no ids. Other columns pass through; columns of
    these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        coder, (tokens, starts, sizes, decimal) = shared.value.encoder(), shared.value.tables()
        counts, ids_hashes, hashes = [], [], []
        for some in _batches(texts):
            for ids in coder.encode_all(some):
                numbers, decoded, left = sha256(), sha256(), len(ids)
                for at in range(0, len(ids), _IDS):
                    part = ids[at:at + _IDS]
                    left -= len(part)
                    text = decimal[part].ravel()
                    text = text[text != 0]
                    numbers.update(text if left else text[:-1])
                    size = sizes[part]
                    ends = np.cumsum(size)
                    decoded.update(tokens[np.arange(ends[-1]) + np.repeat(starts[part] - ends + size, size)])
                counts.append(len(ids))
                ids_hashes.append(numbers.hexdigest())
                hashes.append(decoded.hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hashes, pa.string()), pa.array(hashes, pa.string())]

    return add_columns(df, [text], "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
