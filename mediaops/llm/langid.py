"""Language identification with blended-spectrum string kernels.

A text is the set of its letter n-grams of lengths 1 to 3 over the folded text. The presence kernel of two texts
is the number of n-grams they share over the geometric mean of their set sizes. Nyström: the kernel is taken
against landmark texts only; one-versus-rest ridge regression on those columns, regularised by the landmarks' own
kernel, gives a score per language. N-grams are numbered exactly, over all characters; of each that a landmark has, the
landmarks that have it are listed, so a text costs what it shares with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaops.llm.common import add_columns

#: Texts per language that the classifier is fitted on, and landmarks among them.
FIT_TEXTS = 300
LANDMARKS = 24
RIDGE = 1e-2
UNKNOWN = "und"

_CODES = 0x110000  # letters are their code points, 0 stands for a gap
_BATCH = 128


class Alphabet:
    """Folds characters to codes: a letter, or a mark that is part of a word, is the code point of its lower case; all
    else is a gap."""

    def __init__(self):
        self._table = None

    def __reduce__(self):
        return Alphabet, ()  # the table is made again where it is used

    def table(self):
        from unicodedata import category

        import numpy as np

        if self._table is None:
            table = np.zeros(_CODES, np.int32)
            for point in range(_CODES):
                c = chr(point)
                if c.isalpha():
                    table[point] = ord(c.lower()[0])
                elif category(c)[0] == "M" and not (0x20D0 <= point < 0x2100 or 0xFE00 <= point < 0xFE10 or point >= 0xE0100):
                    table[point] = point  # but for what dresses up signs
            self._table = table
        return self._table

    def codes(self, text: str):
        """Letter codes with one gap at either end and between words."""
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros(len(points) + 2, np.int64)
        codes[1:-1] = self.table()[points]
        gap = codes == 0
        return codes[np.concatenate([[True], ~(gap[1:] & gap[:-1])])]


def grams(codes):
    """Numbers of all n-grams of lengths 1 to 3, each its own; lengths do not mix."""
    import numpy as np

    two = codes[:-1] * _CODES + codes[1:]
    three = two[:-1] * _CODES + codes[2:]
    return np.concatenate([codes[codes > 0], two + _CODES, three + _CODES * (_CODES + 1)])


@dataclass
class LanguageModel:
    """``vocabulary``: n-grams of any landmark, sorted; ``starts`` and ``members``: for each the landmarks that have it;
    ``norms``: set sizes of the landmarks; ``ridge``: a column per language."""

    languages: list
    alphabet: Alphabet
    vocabulary: object
    starts: object
    members: object
    norms: object
    ridge: object

    def kernel(self, texts: list[str]):
        """A row per text: its kernel with every landmark; and whether it has a letter."""
        import numpy as np

        shared, norms = np.zeros((len(texts), len(self.norms))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = grams(self.alphabet.codes(text))
            if not _has_letter(found):
                continue
            found = np.unique(found)
            norms[i] = len(found)
            at = np.searchsorted(self.vocabulary, found)
            at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == found]
            counts = self.starts[at + 1] - self.starts[at]
            places = np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared[i] = np.bincount(self.members[places], minlength=len(self.norms))
        return shared / np.sqrt(np.maximum(norms, 1))[:, None] / np.sqrt(self.norms), norms > 0

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        import numpy as np

        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        kernel, lettered = self.kernel(texts)
        scores = kernel @ self.ridge
        best = scores.argmax(axis=1)
        # marks count as n-grams, but only letters make a text one of a language
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool) & lettered
        # one-versus-rest targets are 0 and 1
        value = np.clip(scores[np.arange(len(texts)), best], 0, 1)
        return ([self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
                np.where(lettered, value, 0.0).tolist())


def _has_letter(found) -> bool:
    return bool(len(found)) and bool((found[:1] < _CODES).any())


def fit_language_model(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on labelled texts. Of every language the first ``landmarks`` texts serve as landmarks. Texts without a
    letter are left out; without any text the model answers ``und``."""
    import numpy as np

    rows = [(t, l) for t, l in zip(texts, languages) if t and any(c.isalpha() for c in t)]
    names, alphabet = sorted({l for _, l in rows}), Alphabet()
    if not rows:
        return LanguageModel([], alphabet, None, None, None, None, None)
    chosen = [t for name in names for t in [t for t, l in rows if l == name][:landmarks]]
    sets = [np.unique(grams(alphabet.codes(t))) for t in chosen]
    norms = np.array([len(found) for found in sets])
    vocabulary, place = np.unique(np.concatenate(sets), return_inverse=True)
    members = np.repeat(np.arange(len(sets), dtype=np.int32), norms)[np.argsort(place, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(place))])
    model = LanguageModel(names, alphabet, vocabulary, starts, members, norms, None)
    column = {name: i for i, name in enumerate(names)}
    of = np.array([column[l] for _, l in rows])
    weight = 1 / np.bincount(of)[of]  # languages weigh alike
    left, right = ridge * (model.kernel(chosen)[0] + 1e-6 * np.eye(len(chosen))), np.zeros((len(chosen), len(names)))
    for i in range(0, len(rows), _BATCH):
        kernel = model.kernel([t for t, _ in rows[i:i + _BATCH]])[0]
        weighed = kernel * weight[i:i + _BATCH, None]
        left += kernel.T @ weighed
        right += weighed.T @ np.eye(len(names))[of[i:i + _BATCH]]
    model.ridge = np.linalg.solve(left, right)
    return model


def held_out(key: str = "doc_id") -> Column:
    """True for rows that are never learned from: the CRC-32 of the key as text leaves 2 modulo 4. A null key has no
    CRC; it gives false, and such rows are not learned from either."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = FIT_TEXTS) -> LanguageModel:
    """Learns from the ``per_language`` rows with the smallest keys of each language that are not held out.

    Keys and languages are read first, in one pass without the texts; the texts then by a key range with a bounded list
    behind it (``per_language`` rows a language). All languages are learned. Rows with a null key, text or language are not used.
    """
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"),
                        held_out(key).alias("held"))
    usable = named.where("NOT held AND key IS NOT NULL AND lang IS NOT NULL").select("key", "lang")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))  # limited in every partition before they meet
    rows = usable.withColumn("at", first).where(F.col("at") <= per_language).select("key", "lang").collect()
    if not rows:
        return fit_language_model([], [])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in {r.key for r in rows}], "key " + named.schema["key"].dataType.simpleString()))
    near = named.where((F.col("key") <= F.lit(max(r.key for r in rows))) & ~F.col("held") & F.col("lang").isNotNull())
    found = near.join(wanted, "key", "left_semi").select("key", "lang", "text").dropDuplicates(["key"]).collect()
    found.sort(key=lambda r: r.key)
    once = {(r.text, r.lang): None for r in found if r.text}
    return fit_language_model([t for t, _ in once], [l for _, l in once])


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` (a learned language, ``und`` if the text is null or has no letter) and ``score`` (the ridge
    score of that language cut to 0..1; 0 for ``und``). Whole texts are read. Equal scores go to the first language
    by name. Other columns pass through; columns with these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # the n-grams of LANDMARKS texts a language

    def run(texts):
        import pyarrow as pa

        names, scores = [], []
        for at in range(0, len(texts), _BATCH):
            got = shared.value.predict([t.as_py() or "" for t in texts[at:at + _BATCH]])
            names += got[0]
            scores += got[1]
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(df, [text], "lang_pred string, score double", run)
