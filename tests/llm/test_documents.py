"""Operators on documents against brute force, and their answers to nulls, ties, long and empty texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from mediaops.llm import bpe, langid, licenses, mixing, quality, sharding, simhash
from mediaops.llm.components import connected_components

EXTRA = "doc_id long, text string, lang string, source string, fp long, ids string, shard int, copy string, key string, size double"


def frame(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with those the operators add."""
    full = [(i, t, "en", "s", 7, "x", 1, "c", "k", 0.5) for i, t in rows]
    return spark.createDataFrame(full, EXTRA)


def fingerprint(text, n=3):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(keys, linked):
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("crowded", [0, 2, 64])
def test_links_find_all_within_two_bits(spark, crowded):
    rng = random.Random(5)
    prints = {0, -1, 1 << 62}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(5):
            prints.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    signed = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in prints})
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = roots(signed, [(r.a, r.b) for r in simhash.links(nodes, crowded).collect()])
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert near and got == roots(signed, near)


def test_fingerprints_and_components(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base + " x"), (7, base), (1, None), (2, ""), (3, " \n\t"), (5, "One"), (6, "one two"), (6, "one two"), (None, "lone text here"),
            (8, "A" * 300_000), (10, "Ünï CODE wörds and Ä" * 3)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    unsigned = lambda v: v & (1 << 64) - 1
    assert Counter((r.doc_id, unsigned(r.fp)) for r in got) == Counter((i, fingerprint(t)) for i, t in rows)
    component = {r.doc_id: r.component_id for r in got}
    assert component[1] == component[2] == component[3] == 1
    assert component[9] == component[7] == component[4] if bin(fingerprint(base) ^ fingerprint(base + " x")).count("1") <= 2 else True
    assert component[6] == 6 and component[None] is None


def test_long_texts_are_cut_without_loss(monkeypatch):
    import mediaops.llm.common as common

    text = " ".join(f"word{i % 97}\n" if i % 7 else "x" for i in range(5000))
    whole = simhash.fingerprint_of(text)
    counts = quality.base_counts(text.encode())
    monkeypatch.setattr(common, "PIECE", 50)
    monkeypatch.setattr(simhash, "_SLICE", 13)
    assert simhash.fingerprint_of(text) == whole
    assert quality.base_counts(text.encode()) == counts


def test_keep_one_keeps_one(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text), (2, text), (2, text), (5, "something else that is here for all to see"), (None, text), (6, None), (7, None)]
    df = frame(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]


@pytest.mark.parametrize("block", [2, 512])
def test_keep_one_connects_all_texts_that_are_alike(spark, monkeypatch, block):
    from mediaops.llm import resemblance

    monkeypatch.setattr(resemblance, "PART", block)
    rng, rows, key = random.Random(3), [], 0
    for family in range(12):
        base = [f"{family}w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(12):
            words, key = list(base), key + 1
            for at in rng.sample(range(len(words)), len(words) // rng.choice([30, 45, 60, 100]) or rng.randint(0, 1)):
                words[at] = f"x{rng.random()}"
            base = words if rng.random() < 0.3 else base
            rows += [(key, " ".join(words))] * rng.randint(1, 2)
    rows += [(key + 1, "short text"), (key + 2, "Short  text"), (key + 3, "another one"), (key + 4, None), (key + 5, " ")]
    sets = {k: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for k, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, near)
    assert 12 < len(set(want.values())) < len(want)
    got = simhash.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_sketches_estimate_similarity():
    from mediaops.llm import resemblance

    words = [f"w{i}" for i in range(2000)]
    one, other = " ".join(words[:1800]), " ".join(words[200:])
    a, b = (resemblance.sketch_of(simhash.shingle_hashes(t, 5)) for t in (one, other))
    assert abs(resemblance.similarity(one, other, 5) - 0.8) < 0.01 and resemblance.similarity("", "", 5) == 0
    assert len(a) == resemblance.BANDS and set(a) & set(b)
    assert resemblance.sketch_of(simhash.shingle_hashes(" ", 5)) is None


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    hub = [(1, i) for i in range(200, 260)] + [(300, 300), (5, 6), (6, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 181)} == {100} and got[230] == 1 and got[6] == 5 and 300 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def words():
    import public_tokenizers as tokenizers

    return bpe.Vocabulary.load(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


TEXTS = [None, "", " ", "Hello,  world!\n\n\tIt's 12345 o'clock  ", "naïve Ünïcödé — 中文字符    🙂🙃", "<|endoftext|> plain", "a" * 5000,
         "ab" * 4000, "՘࢏Ẕb \U00010940x \U00011de0 9", "\x00\x7f\x1c\x85", " leading", "trailing \n"]


def test_encoding_equals_the_public_library(spark, words):
    import public_tokenizers as tokenizers
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})
    df = frame(spark, list(enumerate(TEXTS)))
    got = bpe.decode(bpe.encode(df, words), words).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [coder.encode_ordinary(t or "") for t in TEXTS]
    assert [bytes(r.decoded) for r in got] == [(t or "").encode() for t in TEXTS]
    rng, own = random.Random(3), bpe.Encoder(words)
    letters = "aeinst 'sd\n\t 09.,!é中՘ 🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("aeinst's.é\n\x1c\x85") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(200)]
    assert [own.encode(t) for t in texts] == [coder.encode_ordinary(t) for t in texts]
    assert [ids.tolist() for ids in bpe.Encoder(words).encode_all(texts)] == [coder.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("at_once", [3, 1 << 16])
def test_digests_are_of_the_ids_and_of_the_text(spark, words, monkeypatch, at_once):
    monkeypatch.setattr(bpe, "_IDS", at_once)
    df = frame(spark, list(enumerate(TEXTS)))
    got = bpe.digest(df, words).orderBy("doc_id").collect()
    ids = [list(r.ids) for r in bpe.encode(df, words).orderBy("doc_id").collect()]
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got] == [
        (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip(ids, TEXTS)]
    assert got[0].source == "s" and bpe.encode(df, words).columns == [c for c in df.columns if c != "ids"] + ["ids"]
    assert bpe.digest(frame(spark, []), words).collect() == [] and bpe.encode(frame(spark, []), words).collect() == []


def test_encoding_in_pieces_and_with_a_short_memory(words, monkeypatch):
    text = "Some words, numbers 123 and  spaces\n\nagain " * 30
    whole = bpe.Encoder(words).encode(text)
    monkeypatch.setattr(bpe, "_CHARS", 5)
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    assert bpe.Encoder(words).encode(text) == whole
    monkeypatch.setattr(bpe, "_CHARS", 200)
    assert bpe.Encoder(words).encode("x" + text.replace("\n", "").replace("  ", " ")) == bpe.Encoder(words).encode_all(
        ["x" + text.replace("\n", "").replace("  ", " ")]).__next__().tolist()


def test_perfect_hash_is_minimal():
    items = {f"key{i}".encode(): i for i in range(1000)}
    built = bpe.PerfectHash.build(items)
    assert len(built.keys) == 1000 and sorted(built.keys) == sorted(items)
    assert built.find(list(items) + [b"other"]) == [*range(1000), -1]
    assert bpe.PerfectHash.build({}).find([b"x"]) == [-1]


def base_counts(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [line for line in (text or "").encode().split(b"\n") if line.split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(covered))


def test_base_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = [None, "", "a b c", "x " * 40, "l1\nl1\n \nl1 ", "a\x0bb\x0cc\rd  e # | <>"] + [
        "\n".join(" ".join(rng.choice("abcdefg") + rng.choice("xyz") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9)))
        for _ in range(60)]
    model = quality.fit_line_model(["Some good words stand here, and here.\nAnd here."] * 3 + ["%% ## BAD!! $$ %%\n## ##"] * 3, [1] * 3 + [0] * 3, 30)
    got = quality.judge(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        counts = base_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == counts
        assert row.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert row.kept == (not row.base_failed and row.content_share >= 0.5)


def test_viterbi_finds_the_best_labelling():
    rng = random.Random(2)
    for _ in range(60):
        model = quality.LineModel([], [[rng.gauss(0, 2) for _ in "ab"] for _ in "ab"])
        leanings = [rng.gauss(0, 2) for _ in range(rng.randint(1, 8))]

        def weight(labels):
            return sum(l for l, on in zip(leanings, labels) if on) + sum(model.pairs[a][b] for a, b in zip(labels, labels[1:]))

        best = max(weight([n >> i & 1 for i in range(len(leanings))]) for n in range(2 ** len(leanings)))
        assert math.isclose(weight(model.decode(leanings)), best, abs_tol=1e-9)
    assert model.decode([]) == []


def test_quality_is_learned_from_labels(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["tree", "river", "stone", "and", "the"]) + str(i) for i in range(12)) + ".\n" + "It was so, said the man of the house again." for _ in range(40)]
    bad = ["$$% " * 3 + " ".join("%%" + rng.choice("abcdef") * 2 + "##" + str(i) for i in range(14)) for _ in range(40)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows if i % 2] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = frame(spark, rows)
    kept = {r.doc_id for r in quality.judge(df, quality.fit(df, labels)).where("kept").collect()}
    assert kept == set(range(40))
    empty = quality.fit(df.limit(0), labels.limit(0))
    assert quality.judge(df.limit(0), empty).count() == 0


def test_languages(spark):
    rng = random.Random(6)
    stems = {"en": ["the", "thing", "was", "with"], "de": ["der", "schön", "und", "nicht"], "fr": ["le", "être", "avec", "où"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) for _ in range(15)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    odd = [(500, None, "en"), (501, "123 !!", "de"), (502, "", None), (None, "the thing", "en"), (503, "der und " * 60_000, "de"), (504, "中文", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs.withColumnRenamed("lang", "score"), langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert got[None].lang_pred == "en" and got[503].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(held[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows) and held[None] is False
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_all_lines_of_a_text_teach():
    plain = "\n".join(f"Line {i} is a plain sentence, and ends." for i in range(32))
    texts = [plain + "\nAnd so it goes on, as plain as that." * 40, plain + "\n## $$ %% || <>" * 40] * 5
    at = [quality.FEATURES.index(name) for name in ("symbols", "letters")]
    lean = quality.fit_line_model(texts, [1, 0] * 5).lean
    assert lean[at[0]] < -0.2 < 0.2 < lean[at[1]]


@pytest.mark.parametrize("at", [0.5, 0.8])
def test_the_prefix_join_loses_no_pair(spark, at):
    from mediaops.llm import resemblance

    rng, texts = random.Random(11), []
    for family in range(8):
        base = [f"{family}w{rng.randrange(40)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(14):
            words = base[:len(base) - rng.randint(0, len(base) // 6)] + [f"y{k}" for k in range(rng.randint(0, 3))]
            for k in rng.sample(range(len(words)), rng.randint(0, len(words) // 12)):
                words[k] = f"x{rng.randrange(30)}"
            texts.append(" ".join(words))
    texts = sorted({*texts})
    members = [(i, rng.randrange(6)) for i in range(len(texts))]
    got = resemblance.alike_across(
        spark.createDataFrame(members, "h long, comp long"), spark.createDataFrame(list(enumerate(texts)), "h long, text string"), 2, at).collect()
    comp = dict(members)
    near = {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b] and resemblance.similarity(texts[a], texts[b], 2) >= at}
    assert near and near <= {(r.a, r.b) for r in got} and all(comp[r.a] != comp[r.b] for r in got)
    assert len(got) < 4 * len(near)


def scripts(rng):
    """Texts of random words over the letters of a script, two languages of one script among them."""
    letters = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת",
               "zh": [chr(0x4E00 + i) for i in range(400)], "ko": [chr(0xAC00 + 7 * i) for i in range(400)], "th": [chr(0x0E01 + i) for i in range(46)],
               "ja": [chr(0x3041 + i) for i in range(80)], "ka": [chr(0x10D0 + i) for i in range(33)], "hy": [chr(0x0561 + i) for i in range(38)]}
    return {lang: lambda n, own=own: " ".join("".join(rng.choice(own) for _ in range(rng.randint(2, 7))) for _ in range(n)) for lang, own in letters.items()}


def test_scripts_are_told_apart():
    made = scripts(random.Random(3))
    rows = [(make(400), lang) for lang, make in made.items() for _ in range(12)]
    model = langid.fit_language_model([t for t, _ in rows], [l for _, l in rows], landmarks=6)
    for lang, make in made.items():
        assert model.predict([make(n) for n in (5, 50, 2000)])[0] == [lang] * 3, lang
    numbers = {tuple(langid.grams(model.alphabet.codes(c)).tolist()) for c in "中文字한글กขאבжщ"}
    assert len(numbers) == 11


def test_all_languages_are_learned():
    names = [f"l{i:03d}" for i in range(230)]
    texts = [" ".join([chr(0x4E00 + 3 * i), chr(0x4E01 + 3 * i) * 2, chr(0x4E02 + 3 * i)] * 3) for i in range(230)]
    model = langid.fit_language_model(texts, names, landmarks=1)
    assert model.predict(texts)[0] == names


def test_more_than_two_hundred_languages_of_a_table(spark):
    rows = [(i, " ".join([chr(0x4E00 + 3 * i), chr(0x4E01 + 3 * i) * 2]), f"l{i:03d}") for i in range(290)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(290)) > 200


def test_kernel_equals_shared_sets():
    texts = ["the cat sat", "le chat noir", "der Hund, und", "cats and dogs"]
    model = langid.fit_language_model(texts, ["en", "fr", "de", "en"])
    import numpy as np

    sets = [set(langid.grams(model.alphabet.codes(t)).tolist()) for t in texts]
    order = sorted(range(4), key=lambda i: ["en", "fr", "de", "en"][i])
    expected = [[len(a & sets[j]) / math.sqrt(len(a) * len(sets[j])) for j in order] for a in sets]
    assert np.allclose(model.kernel(texts)[0], expected, atol=1e-6)


def poisson(u, mean):
    p = c = math.exp(-mean)
    k = 0
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixture_draws_and_weights(spark):
    rows = [(i, "x" * (i % 50), None, ["a", "b", None, "a"][i % 4]) for i in range(2000)] + [(None, None, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repeats string, source string")
    rates = {r.source: r.rate for r in mixing.rates(df, {"a": 1, "b": 3}).collect()}
    assert rates[None] == 0
    got = mixing.replicate(df, {"a": 1, "b": 3}).collect()
    counts = Counter(r.doc_id for r in got)
    for i, _, _, source in rows[:-1]:
        u = int(hashlib.md5(f"{mixing.SEED}|n|{i}|1".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert counts[i] == (poisson(u, rates[source]) if rates[source] else 0), i
    bytes_of = Counter()
    for r in got:
        bytes_of[r.source] += len(r.text or "") + 1
    assert abs(bytes_of["b"] / sum(bytes_of.values()) - 0.75) < 0.05
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    assert mixing.replicate(df.limit(0)).count() == 0
    assert mixing.replicate(df, {"a": 1, "b": 3}).collect() and sum(counts.values()) == mixing.replicate(df, {"a": 1, "b": 3}).count()


def test_large_means_are_drawn_in_parts(spark):
    df = spark.createDataFrame([(1, "abc", "s")], "doc_id long, text string, source string")
    n = mixing.replicate(df, total=4 * 1700).count()
    assert abs(n - 1700) < 6 * math.sqrt(1700)


def test_shards(spark):
    rows = [(i, "é" * (i * 37 % 211)) for i in range(500, 0, -1)] + [(None, None), (7, "twice"), (7, "twice"), (900, "z" * 4000)]
    got = sharding.assign_shards(frame(spark, rows), shards=16).collect()
    assert len(got) == len(rows) and {r.shard for r in got} <= set(range(16))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in order]
    assert keys == sorted(keys)
    start, total, slots = 0, sum(r.size for r in got), Counter()
    for r in order:
        assert r.shard == start * 16 // total and r.slot == slots[r.shard]
        slots[r.shard] += 1
        start += r.size
    assert all(r.text_crc32 == zlib.crc32(t.encode() if t else b"") for r in got for i, t in rows if i == r.doc_id and i not in (7,))
    assert sharding.assign_shards(frame(spark, [])).count() == 0


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["mit-grant"], licenses.TEMPLATES["apache-2.0-header"]
    filler = " ".join(f"w{i}" for i in range(700))
    words = mit.split()
    rows = [(1, filler + " " + mit + " " + filler), (2, apache.upper() + mit), (3, None), (4, ""), (5, "All RIGHTS, reserved"), (6, "all rights"),
            (7, " ".join(words[:len(words) // 2])), (8, " ".join(words[: int(len(words) * 0.9)])), (5, "All RIGHTS, reserved"), (9, filler)]
    got = {(r.doc_id, r.license): r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (1, "mit-grant") in got and got[1, "mit-grant"].first_word == 700 and got[1, "mit-grant"].containment == 1
    assert {(2, "mit-grant"), (2, "apache-2.0-header"), (5, "all-rights-reserved"), (8, "mit-grant")} <= set(got)
    assert not {i for i, _ in got} & {3, 4, 6, 7, 9}
    assert licenses.scan(frame(spark, rows), {}).count() == 0 and licenses.scan(frame(spark, [])).count() == 0
