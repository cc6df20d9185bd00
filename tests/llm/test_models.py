"""Quality rules, SentencePiece, language identification and mixing."""

import dataclasses
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from docloom.llm import langid, mixing, ngrams, pieces, quality, word_model
from docloom.llm.textblocks import blocks

WORD = r"[^\x20\x09-\x0D]+"
ODD = ["", None, " \n\t", "a", "x " * 60_000, "same line\n" * 30, "é ü 漢字 # $ | <b>\x0bend", "no\x00null", "1 2 3", "y" * 300_000]


def brute_base(text):
    words = re.findall(WORD, text or "")
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


def test_quality_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = quality.op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows) > 0.9 * sum(not r.base_failed for r in rows)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", True) for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, lang string, kept boolean")
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(r.text)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_quality_bands_reject_planted_junk(spark, sf):
    """Scrambled letters in some words (above the band) and a few words over and over in any order (below) go; clean text stays."""
    big = sf.replace("sf0.001", "sf0.01")
    clean = [r.text for r in spark.read.parquet(f"{big}/documents.parquet").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("lang = 'en' and quality = 1 and length(text) between 600 and 6000").collect()]
    rng = random.Random(0)
    noise = [" ".join("".join(rng.sample(w, len(w))) if rng.random() < 0.3 else w for w in t.split(" ")) for t in clean[:10]]
    dull = [" ".join(rng.choices(["the", "and", "of", "to"], k=200)) for _ in range(5)]
    rows = [(i, t, "en") for i, t in enumerate(clean + noise + dull)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("not base_failed").collect()}
    n = len(clean)
    assert not any(kept[i] for i in range(n, len(rows)) if i in kept) and sum(i >= n for i in kept) >= 12
    assert sum(kept[i] for i in kept if i < n) >= 0.93 * sum(i < n for i in kept)


def slow_kneser_ney(others, everything, text):
    """Interpolated modified Kneser-Ney of word bigrams with plain dictionaries: counts of the other documents, discounts and words of all."""
    count = lambda docs: Counter((a, b) for d in docs for a, b in zip(d, d[1:]))
    c, full = count(others), count(everything)
    before = lambda pairs: Counter(b for _, b in pairs)
    kinds = lambda values: np.array([sum(v == k for v in values) for k in range(1, 5)])
    words = {w for pair in full for w in pair}
    k_all, k_own = before(full), before(c)
    d2, d1 = word_model.discounts(kinds(full.values())), word_model.discounts(kinds([k_all[w] for w in words]))
    spare = sum(d1[min(k_all[w], 3)] if k_all[w] else d1[3] for w in words) / len(full)

    def p1(w):
        return max(k_own[w] - d1[min(k_own[w], 3)], 0) / len(c) + spare / len(words)

    def p2(u, v):
        after = {b: n for (a, b), n in c.items() if a == u}
        if not after:
            return p1(v)
        n, total = after.get(v, 0), sum(after.values())
        return (max(n - d2[min(n, 3)], 0) + sum(d2[min(x, 3)] for x in after.values()) * p1(v)) / total

    return (math.log2(p1(text[0])) + sum(math.log2(p2(a, b)) for a, b in zip(text, text[1:]))) / len(text)


@pytest.mark.parametrize("chunk", [400, 1 << 20])
def test_kneser_ney_matches_definition(spark, chunk):
    rng = random.Random(0)
    words = [f"w{i}" for i in range(25)]
    texts = [rng.choices(words, [1 / (i + 1) for i in range(25)], k=rng.randint(2, 60)) for _ in range(40)] + [["only"], ["new", "words", "here"], []]
    docs = spark.createDataFrame([(i, " ".join(t).replace("w1 ", "W1 "), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).cache()
    got = {r.doc_id: r.log_ppl for r in quality.score(docs, carry=["doc_id"], chunk=chunk, spelled=False).collect()}
    for i, t in enumerate(texts):
        if t:
            assert -got[i] == pytest.approx(slow_kneser_ney([d for k, d in enumerate(texts) if k != i], texts, t), rel=1e-9), i
        else:
            assert got[i] is None


def test_model_grows_and_tells_languages_apart(spark):
    rows = [(i, "the cat sat on the mat", "en") for i in range(4)] + [(i, "le chat est sur le lit", "fr") for i in range(4, 8)] + [(8, "the cat sat on the mat", "fr"), (9, "the cat sat on the mat", None)]
    got = {r.doc_id: r.log_ppl for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), carry=["doc_id"]).collect()}
    assert got[0] < 5 and got[8] > 2 * got[0] and got[9] > 2 * got[0]


def slow_ppm(texts, order):
    """Code length of the last byte of a gram by PPM with escapes (method C)."""
    levels = [Counter() for _ in range(order)]
    top = Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))
    levels[-1] = top
    for k in range(order - 1, 0, -1):
        for g, n in levels[k].items():
            levels[k - 1][g[1:]] += n

    def bits(gram):
        if not gram:
            return 8.0
        after = {g: n for g, n in levels[len(gram) - 1].items() if g[:-1] == gram[:-1]}
        total, distinct = sum(after.values()), len(after)
        if not total:
            return bits(gram[1:])
        if gram in after:
            return -math.log2(after[gram] / (total + distinct))
        return -math.log2(distinct / (total + distinct)) + bits(gram[1:])

    return bits


def test_ppm_matches_definition():
    rng = random.Random(1)
    sample = {g: [bytes(rng.choices(b"abcde", w, k=rng.randint(5, 40))) for _ in range(8)] for g, w in (("p", [5, 4, 1, 1, 1]), ("q", [1, 1, 1, 4, 5]))}
    order = 3
    counts = {}
    for g, texts in sample.items():
        c = Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))
        counts[g] = (np.array([int.from_bytes(x, "big") for x in c], np.uint64), np.array(list(c.values())))
    names, table = langid.build_table(counts, order)
    assert names == ["p", "q"]
    for t in (b"abcdeabc", b"zz", b"eedd", b"a"):
        got = table.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:, 0]
        for i, g in enumerate(names):
            bits = slow_ppm(sample[g], order)
            assert -got[i] == pytest.approx(sum(bits(t[max(0, k - order + 1) : k + 1]) for k in range(len(t))), rel=1e-5)


def test_hash_arrays():
    codes = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 20_000).astype(np.uint64))
    table = ngrams.HashArrays(codes)
    assert (table.find(codes) == np.arange(len(codes))).all()
    assert (table.find(codes + np.uint64(1))[~np.isin(codes + np.uint64(1), codes)] == -1).all()
    assert (ngrams.HashArrays(codes[:0]).find(codes) == -1).all()


def test_counts_match_python(spark):
    texts = [("a", "abcabcab"), ("b", "abc"), (None, "xyxyx"), ("a", "abca"), ("a", None), ("b", "")]
    got = {(r.group, r.code): r.n for r in ngrams.count_ngrams(spark.createDataFrame(texts, "g string, t string"), "g", "t", 3).collect()}
    want = Counter((g or "", int.from_bytes(t[i : i + 3].encode(), "big")) for g, t in texts if t for i in range(len(t) - 2))
    assert got == want


def test_blocks_handle_nulls_and_slices():
    column = pa.array(["ab", None, "", "cde", "f"]).slice(1)
    parts = [(row, data.tobytes(), offsets.tolist()) for row, data, offsets in blocks(column, 3)]
    assert "".join(p[1].decode() for p in parts) == "cdef" and sum(len(p[2]) - 1 for p in parts) == 4


def test_language_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    rows = langid.op9_language_id(spark, sf.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) == len(docs)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].text]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    train = spark.createDataFrame([(i, "en" if i % 2 else "de", "the house and the garden " * 5 if i % 2 else "das Haus und der Garten " * 5) for i in range(20)], "doc_id long, lang string, text string")
    model = langid.train(train)
    odd = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*ODD, "the garden", "der Garten", "the garden"])], "doc_id long, text string, lang_pred int")
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    letters = lambda t: any(c.isalpha() for c in t or "")
    for i, t in enumerate(ODD):
        assert (rows[i].lang_pred == "und") == (not letters(t))
    n = len(ODD)
    assert [rows[n + i].lang_pred for i in range(3)] == ["en", "de", "en"]
    assert langid.train(train.limit(0)) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_pieces_round_trip(vocabulary):
    import sentencepiece

    own, library = pieces.Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(0)
    texts = [t for t in ODD if t is not None] + ["▁ literal ▁▁ mark", "  two  spaces ", "\r\n\t", "😀 \u200b é"] + ["".join(rng.choices("ab ▁é漢\n😀.'", k=rng.randint(1, 50))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        assert own.decode(ids) == t
        if "▁" not in t and "\x00" not in t:
            assert library.decode(ids) == t


def test_pieces_are_the_librarys(spark, vocabulary):
    """Ids of whole documents, and of odd texts, are those of the library."""
    import sentencepiece

    assert vocabulary.merges
    own, library = pieces.Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text] + [t for t in ODD if t]
    texts += ["".join(rng.choices("etaoin shr  \nélü漢字x.,'0129😀\t", k=rng.randint(1, 60))) for _ in range(2000)] + [" " * n + "the" + " " * n for n in range(1, 90)] + ["ab" * 5000, "a" * 3000, "=" * 777]
    for t in texts:
        if "▁" not in t:
            assert np.frombuffer(own.encode(t), "<i4").tolist() == library.encode(t), t[:80]


def test_pieces_match_unigram(vocabulary):
    from tokenizers import Tokenizer, models

    table = [(p.replace(" ", "▁") if ok else f"<no {i}>", s if ok else -1e12) for i, (p, s, ok) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.plain))]
    library, own = Tokenizer(models.Unigram(table, unk_id=0, byte_fallback=False)), pieces.Encoder(dataclasses.replace(vocabulary, merges=False))
    rng = random.Random(3)
    for _ in range(200):
        t = " ".join("".join(rng.choices("etaoinshrdlu,.-éü", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 12)))
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        other = library.encode((" " + t).replace(" ", "▁"), add_special_tokens=False).ids
        score = lambda x: sum(vocabulary.scores[i] for i in x)
        assert score(ids) == pytest.approx(score(other)), t


def test_pieces_small_vocabulary():
    """Exhaustive search over all segmentations."""
    names = (" ", "a", "b", "ab", "ba", "aba", " a", "bb")
    scores = (-3.0, -2.0, -2.5, -3.1, -4.0, -4.4, -3.2, -9.0)
    v = pieces.Vocabulary(names + tuple(f"<0x{b:02X}>" for b in range(256)), scores + (0.0,) * 256, (True,) * 8 + (False,) * 256, tuple(range(8, 264)))
    own = pieces.Encoder(v)

    def best(t):
        if not t:
            return 0.0
        out = [scores[i] + best(t[len(n) :]) for i, n in enumerate(names) if t.startswith(n)]
        return max(out + ([own.unknown + best(t[1:])] if t[0] not in names else []))

    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choices("ab c", k=rng.randint(1, 9)))
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        assert sum(scores[i] if i < 8 else own.unknown for i in ids) == pytest.approx(best(" " + t)) and own.decode(ids) == t


def test_pieces_query(spark, sf, vocabulary):
    rows = pieces.op3_sentencepiece(spark, sf).collect()
    assert rows and all(r.round_trip for r in rows)
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(ODD)], "doc_id long, text string, ids int")
    encoded = pieces.encode(docs, vocabulary)
    back = {r.doc_id: (r.text, r.decoded, r.ids) for r in pieces.decode(encoded, vocabulary).collect()}
    assert all(a == b for a, b, _ in back.values()) and back[0][2] == [] and back[1][2] is None
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0


def test_mixing_sql(spark, sf):
    same_rows(mixing.op6_mixing(spark, sf), mixing.op6_sql(), sf)


def test_mixing_ways_agree_and_meet_targets(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice(["en", "de"]), "x" * rng.randint(0, 400)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = {"source": spark.createDataFrame([("a", 3.0), ("hot", 1.0), ("nowhere", 9.0)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.7), ("de", 0.3)], "value string, share double")}
    ways = [{(r.source, r.lang): r.wanted for r in mixing.mix_weights(docs, ["source", "lang"], targets=targets, budget=0.4, most=10, max_cells=n).collect()} for n in (1000, 0)]
    assert ways[0].keys() == ways[1].keys() and all(ways[0][k] == pytest.approx(ways[1][k]) for k in ways[0])
    by, total = defaultdict(float), sum(ways[0].values())
    for (source, lang), w in ways[0].items():
        by[source] += w / total
        by[lang] += w / total
    assert by["en"] == pytest.approx(0.7, abs=1e-4) and by["a"] / by["hot"] == pytest.approx(3, rel=1e-3)


@pytest.mark.parametrize("budget, most, source", [(0.3, 1, [("a", 3.0), ("hot", 5.0), ("b", 2.0)]), (2.0, 7, [("a", 4.0), ("hot", 3.0), ("b", 3.0)])])
def test_mixing_draws_meet_targets(spark, budget, most, source):
    """With targets that the cap allows, expected shares are the targets, and drawn ones are within sampling error."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["a", "b"]), rng.choice(["en", "en", "de"]), "x" * rng.randint(100, 400)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = {"source": spark.createDataFrame(source, "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")}
    mixed = mixing.mix(docs, ["source", "lang"], targets=targets, budget=budget, most=most)
    assert mixed.agg(F.max("draws")).first()[0] <= most
    told = mixing.shortfalls(mixed, ["source", "lang"], targets).collect()
    assert len(told) == 5
    for r in told:
        assert r.expected == pytest.approx(r.target, abs=1e-4) and r.drawn == pytest.approx(r.target, abs=0.02), r
    tokens = mixing.tokens_of(F.col("text"))
    sums = mixed.agg(F.sum(tokens).alias("all"), F.sum(tokens * F.col("draws")).alias("drawn")).first()
    assert sums.drawn == pytest.approx(budget * sums["all"], rel=0.05)


def test_mixing_cap_leaves_the_rest_to_other_cells(spark):
    """A value that the cap keeps from its target is told as short; the other margin still meets its own."""
    rows = [(i, "rare" if i < 20 else "common", "en" if i % 3 else "de", "x" * 100) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = {"source": spark.createDataFrame([("rare", 0.5), ("common", 0.5)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")}
    told = {(r.margin, r.value): r for r in mixing.shortfalls(mixing.mix(docs, ["source", "lang"], targets=targets, budget=0.4), ["source", "lang"], targets).collect()}
    assert told["source", "rare"].expected < 0.15 and told["lang", "en"].expected == pytest.approx(0.5, abs=0.01)


def test_mixing_query_meets_tempered_targets(spark, sf):
    """op6 on documents: every margin within one part in a hundred of its target before the draw."""
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").withColumn("topic", mixing.topic_of(F.col("text")))
    mixed = mixing.mix(docs, mixing.MARGINS, alpha=mixing.ALPHA, budget=mixing.BUDGET, most=mixing.MOST)
    cells = docs.groupBy(*mixing.MARGINS).agg(F.sum(mixing.tokens_of(F.col("text"))).alias("__tokens"))
    targets = {m: mixing.tempered(cells, m, mixing.ALPHA) for m in mixing.MARGINS}
    for r in mixing.shortfalls(mixed, mixing.MARGINS, targets).collect():
        print(tuple(r))
        assert r.expected == pytest.approx(r.target, abs=0.01), r


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, "a", None, 1), (1, "a", None, 1), (None, None, "", 1), (3, "b", "long " * 40_000, 1)], "doc_id long, source string, text string, kept int")
    rows = mixing.mix(docs, ["source"], alpha=0.5).collect()
    assert len(rows) == 4 and all(r.draws == 0 and not r.kept for r in rows if not r.text)
    assert mixing.mix(docs.limit(0), ["source"], alpha=0.5).count() == 0
