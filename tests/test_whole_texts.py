"""Evaluation queries read whole texts: brute force over a small fixture whose texts are longer than any cut."""

import random
import re

import pytest

from marlstone.functions import text, unicode
from marlstone.plans import registry


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def said(rng, n):
    return " ".join(rng.choice(["the", "other", "one", "sees", "too", "42", "Über", "x,"]) for _ in range(n))


def hypotheses(i, whole):
    reference = re.sub(r"[^\x20-\x7e]", "", whole)
    baseline = reference.replace("the", "teh").replace("o", "0")
    return reference, baseline, (baseline, baseline.replace("0", "o"), reference, baseline.replace("e", ""))[i % 4]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rng = random.Random(3)
    docs = {i: said(rng, rng.choice([30, 120])) for i in range(12)} | {12: "", 13: "x" * 80 + " the o"}
    items = {i: "a" * 60 + "".join(rng.choice("abcdefgh ") for _ in range(200)) for i in range(4)}
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "s") for i, t in docs.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def run(spark, fixture, name):
    return registry.queries()[name](spark, fixture[0]).collect()


def test_edits_and_rates_of_whole_texts(spark, fixture):
    docs = fixture[1]
    edits = {r["id"]: (r["edits"], r["ratio"]) for r in run(spark, fixture, "q13_edit_ratio")}
    cer = {r["id"]: (r["baseline_cer"], r["corrected_cer"]) for r in run(spark, fixture, "q14_cer_rows")}
    wer = {r["id"]: (r["wer"], r["cer"]) for r in run(spark, fixture, "q14_wer_rows")}
    words = {r["id"]: (r["words"], r["spaces"]) for r in run(spark, fixture, "q64_word_tokens")}
    key = lambda t: re.sub(r"[^a-z0-9$+<=>^`|~]", "", t.lower())
    for i, whole in docs.items():
        r, b, c = hypotheses(i, whole)
        n = table_distance(r, b)
        assert edits[i] == (n, pytest.approx(n / max(1, len(r)), abs=1e-6))
        assert cer[i] == pytest.approx([table_distance(key(r), key(x)) / max(1, len(key(r))) for x in (b, c)], abs=2e-6)
        w, v = unicode._words(r), unicode._words(c)
        assert wer[i][0] == pytest.approx(table_distance(w, v) / max(1, len(w)), abs=1e-6)
        assert words[i] == (len(b.split()), b.count(" "))
    assert edits[13][0] == 3
    total = run(spark, fixture, "q15_eval_summary")[0]
    assert total["baseline_cer"] == pytest.approx(sum(x for x, _ in cer.values()) / len(docs), abs=1e-5)


def test_corrections_after_the_old_cut(spark, fixture):
    docs = fixture[1]
    assert any(r["start"] > 80 for r in run(spark, fixture, "q53_alignment_inventory"))
    decided = {r["id"]: r["corrected_text"] for r in run(spark, fixture, "q57_decisions")}
    assert all(len(decided[str(i)]) > 80 for i, t in docs.items() if len(t) > 100)


def test_bigrams_of_whole_items(spark, fixture):
    items = fixture[2]
    grams = lambda t: {t[k : k + 2] for k in range(len(t) - 1)}
    for r in run(spark, fixture, "q12_ngram_jaccard"):
        a, b = grams(items[r["a"]]), grams(items[r["b"]])
        assert (r["shared"], r["jaccard"]) == (len(a & b), pytest.approx(len(a & b) / len(a | b), abs=1e-6))


def test_distances_against_the_table(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    pairs = [(word(rng.randrange(90)), word(rng.randrange(90))) for _ in range(150)]
    for _ in range(150):  # few edits, so that the bands decide
        a = list(word(rng.randrange(1, 120)))
        b = [x for x in a if rng.random() > 0.04] + list(word(rng.randrange(3)))
        pairs.append(("".join(a), "".join(b)))
    want = [table_distance(a, b) for a, b in pairs]
    assert [unicode.distance(a, b) for a, b in pairs] == want
    monkeypatch.setattr(unicode, "LEAST_BAND", 2)
    assert [unicode.distance(a, b) for a, b in pairs] == want
    for (a, b), d in zip(pairs, want, strict=True):
        for most in range(max(1, abs(len(a) - len(b))), len(a) + 1, 7):
            assert unicode._within(a, b, most) == (d if d <= most else None) or not b
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    assert [r[0] for r in df.orderBy("i").select(text.edit_distance(df.a, df.b)).collect()] == want
