"""Quality rules: counts that fail a text outright, then a share of content lines.

Lines are labelled content or boilerplate by a linear-chain conditional random field: a weight per line feature,
one per pair of neighbouring labels. Viterbi decoding finds the best labelling of the whole text. A text stays if
content lines hold at least half of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import add_columns, word_pieces

MIN_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
CONTENT_SHARE = 0.5
#: Labelled texts per class that the line model is fitted on, and lines in a sequence; longer texts are several.
FIT_TEXTS = 1500
FIT_LINES = 32
#: Weight of all good texts together in the fit; the rest is that of the bad ones. Above a half: in doubt, keep.
GOOD_WEIGHT = 0.7

FEATURES = ("one log_words symbols capitals digits letters shouts ends_sentence seen_before word_length "
            "short_line repeated_words").split()

# kinds of bytes
_SPACE, _SYMBOL, _UPPER, _LETTER, _DIGIT, _SHOUT, _INNER = (1 << i for i in range(7))


def _kinds():
    import numpy as np

    kinds = np.zeros(256, np.uint8)
    kinds[[32, *range(9, 14)]] |= _SPACE
    kinds[list(SYMBOLS)] |= _SYMBOL
    kinds[65:91] |= _UPPER | _LETTER
    kinds[97:123] |= _LETTER
    kinds[0xC2:0xF5] |= _LETTER  # first byte of a longer character
    kinds[48:58] |= _DIGIT
    kinds[33] |= _SHOUT
    kinds[0x80:0xC0] |= _INNER
    return kinds


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text in UTF-8."""
    import numpy as np

    hashes = np.concatenate([np.fromiter(map(hash, piece), np.int64, len(piece)) for piece in word_pieces(data)]
                            or [np.zeros(0, np.int64)]).view(np.uint64)
    n_words, n_repeat = len(hashes), 0
    if n_words > WINDOW:
        windows = np.zeros(n_words - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k:n_words - WINDOW + 1 + k]
        order = np.argsort(windows, kind="stable")
        equal = windows[order][1:] == windows[order][:-1]
        if equal.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][equal]] = twice[order[:-1][equal]] = True
            covered = np.zeros(n_words + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            n_repeat = int((np.cumsum(covered)[:-1] > 0).sum())
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    n_symbols = sum(data.count(bytes([s])) for s in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    word_chars = len(data.decode("utf-8", "surrogatepass")) - spaces
    return n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat


def line_features(data: bytes):
    """A row of FEATURES for each line with a word, and the words of each such line."""
    import numpy as np

    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    if not lines:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    kinds = _kinds()[np.frombuffer(b"\n".join(lines), np.uint8)]
    count = lambda kind: np.add.reduceat((kinds & kind) != 0, starts, dtype=np.int64)
    space = (kinds & _SPACE) != 0
    opens = ~space
    opens[1:] &= space[:-1]
    words = np.add.reduceat(opens, starts, dtype=np.int64)
    chars = np.maximum(sizes + 1 - count(_INNER) - count(_SPACE), 1)
    letters, seen, before = count(_LETTER), set(), []
    for line in lines:
        before.append(line in seen)
        seen.add(line)
    ends = [_ends_sentence(line) for line in lines]
    distinct = np.fromiter((len(set(line.split())) for line in lines), np.int64, len(lines))
    columns = [np.ones(len(lines)), np.log1p(words) / 4, count(_SYMBOL) / chars, count(_UPPER) / np.maximum(letters, 1),
               count(_DIGIT) / chars, letters / chars, np.minimum(count(_SHOUT) / words, 2), ends, before,
               np.minimum(chars / words / 10, 2), words < 5, np.where(words >= 8, 1 - distinct / words, 0)]
    return np.column_stack(columns).astype(np.float32), words


def _ends_sentence(line: bytes) -> bool:
    tail = line.rstrip()[-3:]
    return tail[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"'", b")") or tail in (b"\xe2\x80\xa6", b"\xe3\x80\x82", b"\xc2\xbb")


@dataclass
class LineModel:
    """``lean``: weights whose product with a line's features says how far it leans to content.
    ``pairs[a][b]``: weight of label b after label a; 1 is content."""

    lean: list
    pairs: list

    def decode(self, leanings: list[float]) -> list[int]:
        """The labelling with the largest sum of weights; ties go to content."""
        (stay0, up), (down, stay1) = self.pairs
        bad, good, back = 0.0, 0.0, []
        for i, lean in enumerate(leanings):
            if not i:
                bad, good = 0.0, lean
                continue
            to_bad, to_good = good + down >= bad + stay0, good + stay1 >= bad + up
            back.append((to_bad, to_good))
            bad, good = (good + down if to_bad else bad + stay0), (good + stay1 if to_good else bad + up) + lean
        if not leanings:
            return []
        label = int(good >= bad)
        out = [label]
        for to_bad, to_good in reversed(back):
            label = int(to_good if label else to_bad)
            out.append(label)
        return out[::-1]

    def content_share(self, data: bytes) -> float:
        """The share of words in content lines; 0 without words."""
        features, words = line_features(data)
        if not len(words):
            return 0.0
        labels = self.decode((features @ _array(self.lean)).tolist())
        return float((words * labels).sum() / words.sum())


def _array(values):
    import numpy as np

    return np.asarray(values, np.float32)


def fit_line_model(texts: list[str], good: list[int], rounds: int = 150) -> LineModel:
    """Fits the field by gradient ascent on the mean log-likelihood of labelled line sequences.

    The lines of a text take its label. Runs on a bounded sample (FIT_TEXTS per class), on all of its lines,
    cut into sequences of FIT_LINES; the pair of lines at a cut is not learned from.
    Without both classes every line is content.
    """
    import numpy as np

    if len(set(good)) < 2:
        return LineModel([1.0] + [0.0] * (len(FEATURES) - 1), [[0.0, 0.0], [0.0, 0.0]])
    rows = []
    for text, label in zip(texts, good):
        features, _ = line_features((text or "").encode("utf-8", "surrogatepass"))
        for at in range(0, len(features), FIT_LINES):
            part = features[at:at + FIT_LINES]
            rows.append((part, np.full(len(part), label)))
    n, longest = len(rows), max(len(f) for f, _ in rows)
    x, y, there = np.zeros((n, longest, len(FEATURES))), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(rows):
        x[i, :len(f)], y[i, :len(f)], there[i, :len(f)] = f, labels, True
    classes = np.array([labels.mean() > 0.5 for _, labels in rows])
    weigh = np.where(classes, GOOD_WEIGHT / max(1, classes.sum()), (1 - GOOD_WEIGHT) / max(1, (~classes).sum()))
    lean, pairs = np.zeros(len(FEATURES)), np.zeros((2, 2))
    speed = [np.zeros_like(lean), np.zeros_like(pairs)], [np.zeros_like(lean), np.zeros_like(pairs)]
    onehot = np.eye(2)[y]
    for step in range(1, rounds + 1):
        scores = np.zeros((n, longest, 2))
        scores[:, :, 1] = x @ lean
        forward, back = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + scores[:, t]
            forward[:, t] = np.where(there[:, t, None], nxt, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        d_pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            after = scores[:, t + 1] + back[:, t + 1]
            nxt = np.stack([np.logaddexp(pairs[a, 0] + after[:, 0], pairs[a, 1] + after[:, 1]) for a in (0, 1)], 1)
            live = there[:, t + 1, None]
            back[:, t] = np.where(live, nxt, 0)
            both = np.exp(np.clip(forward[:, t, :, None] + pairs + after[:, None, :] - total[:, None, None], -50, 0))
            told = onehot[:, t, :, None] * onehot[:, t + 1, None, :]
            d_pairs += ((told - both) * (live[:, :, None] * weigh[:, None, None])).sum(0)
        content = np.exp(np.clip(forward[:, :, 1] + back[:, :, 1] - total[:, None], -50, 0))
        d_lean = np.einsum("nt,ntk->k", (y - content) * there * weigh[:, None], x) - 1e-3 * lean
        d_pairs -= 1e-3 * pairs
        for value, grad, first, second in ((lean, d_lean, speed[0][0], speed[1][0]), (pairs, d_pairs, speed[0][1], speed[1][1])):
            first *= 0.9
            first += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad * grad
            value += 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return LineModel(lean.tolist(), pairs.tolist())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
        per_class: int = FIT_TEXTS) -> LineModel:
    """Fits the line model on the ``per_class`` labelled texts with the smallest keys of either class.

    The keys come first, from the narrow label table, so the texts are read by a key range with a bounded list
    behind it. Rows with a null key or label are not used.
    """
    named = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{quality}`").alias("good")).where("key IS NOT NULL")
    chosen = named.where("good = 1").orderBy("key").limit(per_class).unionByName(
        named.where("good = 0").orderBy("key").limit(per_class))
    rows = chosen.groupBy("key").agg(F.min("good").alias("good")).collect()  # at most 2 * per_class
    if not rows:
        return fit_line_model([], [])
    last = max(r.key for r in rows)
    wanted = F.broadcast(docs.sparkSession.createDataFrame(rows, "key " + named.schema["key"].dataType.simpleString() + ", good int"))
    near = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("key") <= F.lit(last))
    found = near.join(wanted, "key").select("key", "text", "good").dropDuplicates(["key"]).collect()
    found.sort(key=lambda r: r.key)
    return fit_line_model([r.text for r in found], [int(r.good) for r in found])


def judge(df: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``kept`` (boolean)
    and ``content_share`` (double, 0 where there is no word).

    Null and empty texts have no words, so they fail. Repeated 5-word windows are told by 64-bit hashes. Other
    columns pass through; columns with these names are replaced.
    """
    lean, pairs = model.lean, model.pairs

    def run(texts):
        import pyarrow as pa

        field, rows = LineModel(lean, pairs), []
        for value in texts:
            data = (value.as_py() or "").encode("utf-8", "surrogatepass")
            counts = base_counts(data)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEATED_PERCENT * counts[0]
            share = field.content_share(data)
            rows.append((*counts, failed, not failed and share >= CONTENT_SHARE, share))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        return [pa.array(list(column), kind) for column, kind in zip(zip(*rows) if rows else [()] * 8, kinds)]

    return add_columns(df, [text], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                   "base_failed boolean, kept boolean, content_share double", run)
