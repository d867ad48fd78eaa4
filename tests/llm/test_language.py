"""Language identification: the code, the weights by hand, held-out rows and the awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from small import ODD, edge_tables

from tideline.llm import language_id
from tideline.llm.common import QUERIES
from tideline.llm.language_id import ROWS, Model, code_of, fit, identify

SYLLABLES = {"aa": "ka lo mi nu re", "bb": "sch ung ei ach ver", "cc": "ção nho el ê lh", "dd": "字 語 漢 人 大"}


def spoken(language, r, words=40):
    parts = SYLLABLES[language].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(words))


def corpus(n, seed=1):
    r = random.Random(seed)
    names = [sorted(SYLLABLES)[k % 4] for k in range(n)]
    return [spoken(x, r) for x in names], names


@pytest.mark.parametrize("n", range(2, 40))
def test_codewords_are_apart(n):
    code = code_of(n)
    assert set(np.unique(code)) == {-1, 1} and (np.abs(code.sum(axis=0)) < n).all()
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 6 else code.shape[1] / 4)


def test_a_wrong_bit_does_not_change_the_language():
    code = code_of(4)
    model = Model(list("abcd"), code, np.zeros((ROWS + 1, 7), np.float32), np.ones(7), np.ones(7) / 7)
    for k in range(4):
        for wrong in range(7):
            margins = 3 * code[[k]]
            margins[0, wrong] *= -1
            picked, belief, lead = model.decode(margins)
            _, sure, wide = model.decode(3 * code[[k]])
            assert picked[0] == k and belief[0] < sure[0] and 0 < lead[0] < wide[0]


def weights_by_hand(model, text):
    """Mean weight of a text's n-grams, one at a time."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    total, count = np.zeros(model.code.shape[1]), 0
    for n in (1, 2, 3, 4):
        for at in range(len(raw) - n + 1):
            gram = raw[at: at + n]
            if b"  " not in gram:
                key = (int.from_bytes(gram, "big") + (n << 40)) * 0x9E3779B97F4A7C15 % (1 << 64) >> 47
                total, count = total + model.weights[key], count + 1
    return total / max(count, 1) * model.slope


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 18])
def test_weights_of_whole_texts_by_hand(monkeypatch, step):
    monkeypatch.setattr(language_id, "STEP", step)
    r = np.random.default_rng(3)
    weights = r.normal(size=(ROWS + 1, 3)).astype(np.float32)
    weights[ROWS] = 0
    model = Model(list("abc"), code_of(3), weights, np.array([1.0, 2.0, 3.0]), np.ones(3) / 3)
    texts = [t or "" for t in ODD if len(t or "") < 400] + ["ÀÈ. É", "the  END", "\x00a"]
    found = model.margins(pa.array(texts, pa.string()))
    assert np.allclose(found, [weights_by_hand(model, t) for t in texts], atol=1e-4)


def test_fitted_on_made_up_languages():
    texts, names = corpus(200)
    model = fit(texts, names)
    new, truth = corpus(80, seed=2)
    picked, belief, _ = model.decode(model.margins(pa.array(new)))
    assert [model.languages[k] for k in picked] == truth and belief.min() > 0.9
    mixed = [" ".join([spoken("aa", random.Random(1), 20), spoken("bb", random.Random(1), 20)])]
    assert model.decode(model.margins(pa.array(mixed)))[2][0] < np.median(model.decode(model.margins(pa.array(new)))[2])
    assert fit([], []) is None and fit(texts[:3], ["x"] * 3).decode(np.zeros((2, 0)))[0].tolist() == [0, 0]


def test_language_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op12_language_id"](spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_looked_at(spark):
    texts, names = corpus(120)
    folds = [zlib.crc32(str(i).encode()) % 4 for i in range(120)]
    rows = [(i, t, x, "s", 1) for i, (t, x) in enumerate(zip(texts, names))]
    other = [(i, t, "zz" if folds[i] == 2 else x, "q", 1) for i, t, x, _, _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    results = [sorted((r.doc_id, r.held_out, r.lang_pred, r.score) for r in identify(spark.createDataFrame(x, schema)).collect())
               for x in (rows, other)]
    assert results[0] == results[1]
    assert [r[1] for r in results[0]] == [f == 2 for f in folds]
    assert [r[2] for r in results[0]] == names


def test_awkward_rows(spark):
    full, empty = edge_tables(spark)
    clash = full.selectExpr("*", "1 AS score", "'x' AS row", "'y' AS letters", "2 AS share", "3 AS place", "text AS copy")
    rows = identify(clash).collect()
    assert len(rows) == full.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r.copy or "")
        assert r.lang_pred == ("en" if has_letter else "und") and r.score == (1.0 if has_letter else 0.0)
        assert (r.row, r.letters, r.share, r.place) == ("x", "y", 2, 3)
    assert identify(empty).count() == 0
    unknown = full.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in identify(unknown).collect()} == {("und", 0.0)}
    # a text above any step and slice, beside repeated ids that hold most rows
    texts, names = corpus(60)
    long_text = spoken("bb", random.Random(9), 400_000)
    many = [(i, t, x) for i, (t, x) in enumerate(zip(texts, names))] + [(1, texts[1], names[1])] * 200 + [(77, long_text, None)]
    got = identify(spark.createDataFrame(many, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(many) and [r.lang_pred for r in got if r.doc_id == 77] == ["bb"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 1}) == 1
