import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import language

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(word, p):
    if not word:
        return 1.0
    return sum(p[word[:n]] * every_segmentation(word[n:], p) for n in range(1, len(word) + 1) if word[:n] in p)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"]
    lattice = language.Lattice(pieces)
    rng = np.random.RandomState(1)
    p = np.r_[rng.rand(len(pieces)), 1e-7, 0.0]
    words = ["▁", "▁a", "▁abab", "▁bababa", "▁aaaa"]
    got = np.exp(lattice.log_probability(words, np.stack([p, p], axis=1)))
    want = [every_segmentation(w, dict(zip(pieces, p))) for w in words]
    assert np.allclose(got[:, 0], want) and np.allclose(got[:, 1], want)
    assert np.isclose(np.exp(lattice.log_probability(["▁z"], p[:, None])[0, 0]), p[0] * 1e-7)


def test_expected_counts_add_up():
    pieces = ["▁", "a", "b", "ab"]
    lattice = language.Lattice(pieces)
    c = lattice.expected(["▁ab"], np.array([2.0]), np.array([[0.25]] * 4 + [[1e-7], [0.0]]))
    # segmentations: (▁ a b) at 1/64, (▁ ab) at 1/16
    assert np.allclose(c[:4], [2, 2 * 0.2, 2 * 0.2, 2 * 0.8])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs, MODEL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert len(got) == docs.count() and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 + 3!", "en"), (903, "x" * 5000, None), (904, "chien", None), (904, "chien", None), (None, "cat", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int")
    got = {r.doc_id: r for r in language.language_id(df, MODEL).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[901].score == 0
    assert got[904].lang_pred == "fr" and got[903].lang_pred in ("en", "fr") and got[None].lang_pred == "en"
    assert language.language_id(df.limit(0), MODEL).collect() == []
    unlabelled = language.language_id(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang"), MODEL).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


@pytest.mark.parametrize("size", [1, 30, 31, 32, 33, 63, 64, 65, 1000, 5000])
def test_words_of_any_length_are_summed_whole(size):
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "abababababab", "b" * 16]
    lattice, rng = language.Lattice(pieces), np.random.RandomState(size)
    p = np.c_[np.r_[rng.rand(len(pieces)) / 20, 1e-7, 0.0], np.r_[rng.rand(len(pieces)) / 20, 1e-7, 0.0]]
    words = ["▁" + "".join(rng.choice(["a", "b", "ab" * 6, "b" * 16, "é"], size))[:size] for _ in range(3)] + ["▁a", "▁"]
    got = lattice.log_probability(words, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            logs = [0.0]
            for j in range(1, len(w) + 1):
                terms = [logs[j - n] + np.log(p[pieces.index(w[j - n : j]), k]) for n in range(1, min(j, 16) + 1) if w[j - n : j] in pieces]
                logs.append(np.logaddexp.reduce(terms or [logs[j - 1] + np.log(1e-7)]))
            assert np.isclose(row[k], logs[-1])


def test_no_piece_of_letters_is_left_out():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters = [x for x in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if x.replace("▁", "").isalpha() and x == x.lower() and x.count("▁") == x.startswith("▁")]
    assert len(language.pieces_of(MODEL)) >= len(set(letters)) > 22_000


def test_identified_rows_stay_and_get_a_language(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    rows += [(100, "the dog", None), (101, "7 + 7", None), (102, None, "en"), (103, "qzqzq", "xx"), (None, "le chien", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    model = language.train(df, MODEL)
    got = language.keep_identified(df, model, least_score=0.3)
    assert got.columns == df.columns
    lang = {r.doc_id: r.lang for r in got.collect()}
    assert lang[100] == "en" and lang[None] == "fr" and lang[103] == "xx" and 101 not in lang and 102 not in lang
    assert language.keep_identified(df, model, least_score=1.0).count() == 0


def test_expected_counts_of_words_of_any_length():
    rnd = random.Random(7)
    pieces = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "bbbb"]
    lattice = language.Lattice(pieces)
    p = np.array([0.1, 0.2, 0.15, 0.1, 0.05, 0.1, 0.1, 0.1, 0.1, 0.0])

    def plain(word):
        """By sums over all beginnings and ends, without scaling."""
        n = len(word)
        a, b, ids = [1.0] + [0.0] * n, [0.0] * n + [1.0], {x: k for k, x in enumerate(pieces)}
        steps = [(i, i + len(x), k) for i in range(n) for x, k in ids.items() if word.startswith(x, i)] + [(i, i + 1, len(pieces)) for i in range(n) if word[i] not in ids]
        for i, j, k in sorted(steps):
            a[j] += a[i] * p[k]
        for i, j, k in sorted(steps, reverse=True):
            b[i] += p[k] * b[j]
        out = np.zeros(len(p))
        for i, j, k in steps:
            out[k] += a[i] * p[k] * b[j] / a[n]
        return out

    words = ["▁" + "".join(rnd.choices("abbx", k=rnd.choice([0, 1, 3, 9, 40, 41, 120]))) for _ in range(60)]
    times = np.array([float(rnd.randrange(1, 9)) for _ in words])
    want = sum(t * plain(w) for w, t in zip(words, times, strict=True))
    assert np.allclose(lattice.expected(words, times, p), want, rtol=1e-9)
    long = "▁" + "".join(rnd.choices("ab", k=30_000))
    found = lattice.expected([long, "▁ab"], np.array([1.0, 2.0]), p)
    assert np.isfinite(found).all() and abs(sum(c * len(x) for c, x in zip(found, pieces, strict=False)) - len(long) - 6) < 1e-3
