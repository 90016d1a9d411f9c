"""Decontamination, BPE, language, quality and licences on small cases and against brute force."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st

from marlstone.llm import byte_bpe, decontaminate, lang_id, license_scan, quality

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, rows, kind="doc_id long, text string, ids string, ranges string"):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], kind)


# --- decontamination -----------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isascii() and c.isalnum() else " " for c in text or "").split(" ") if w]
    hit, found = set(), set()
    for item, said in items:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c if c >= "\x80" or c.isascii() and c.isalnum() else " " for c in said or "").split(" ") if x]
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def contaminated_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(12)] + [(100, None), (101, "..."), (3, "A b c")]
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "x" * 50_000)]
    for i in range(5, 60):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(3)]
        said = rng.choice(items)[1] or ""
        rows.append((i, ", ".join([parts[0], said.upper() if rng.random() < 0.5 else said.replace(" ", "\n-- "), *parts[1:]])))
    return rows, items


@pytest.mark.parametrize("block", [1_000_000, 150])
def test_hits_against_brute_force(spark, block):
    rows, items = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_hits(docs(spark, rows), bench, max_block_bytes=block).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        r = got[i]
        assert (r["n_words"], sum(x["end"] - x["first"] for x in r["ranges"]), r["items"]) == (n, hit, found)
        covered = sum(len(decontaminate.words_of(t[x["start"] : x["end"]])) for x in r["spans"])
        assert covered == hit
    kept = decontaminate.remove_contaminated(docs(spark, rows), bench, max_block_bytes=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, t in rows if not brute_hits(t, items)[1])
    assert kept.columns == ["doc_id", "text", "ids", "ranges"]


def test_items_without_an_id_hit_too(spark):
    bench = spark.createDataFrame([(None, "one two three"), (7, "two three four")], "item_id long, text string")
    d = docs(spark, [(1, "x one two three y"), (2, "one two three four"), (3, "x y z")])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.op7_decontaminate(d, bench).collect()}
    assert got == {1: (3, 0, True), 2: (4, 1, True), 3: (0, 0, False)}
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(d, bench).collect()] == [3]


def test_repeated_documents_and_items(spark):
    bench = spark.createDataFrame([(7, "one two three"), (7, "one two three"), (7, "four five"), (8, "one two three")], "item_id long, text string")
    d = docs(spark, [(1, "one two three"), (1, "one two three"), (1, "four five"), (None, "one two three"), (None, None)])
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.op7_decontaminate(d, bench).collect()), key=str)
    assert got == sorted([(1, 3, 3, 2), (1, 3, 3, 2), (1, 2, 2, 1), (None, 3, 3, 2), (None, 0, 0, 0)], key=str)
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(d, bench).collect()] == [None]


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.op7_decontaminate(docs(spark, [(1, "a b")]), none).collect()] == [False]
    assert decontaminate.op7_decontaminate(docs(spark, []), none).count() == 0


# --- BPE -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.vocabulary(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(text=st.text(max_size=60))
def test_encoding_is_that_of_the_library(vocab, reference, text):
    ids = vocab.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert byte_bpe.decode(vocab, ids, block=3) == text.encode()


@pytest.mark.parametrize("states", [20, 1_000])
def test_a_full_table_is_emptied_and_the_machine_goes_on(reference, monkeypatch, states):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", states)
    v = byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(4)
    said = ["".join(rng.choice("abcdeéß \n'st.") for _ in range(rng.randrange(60))) for _ in range(400)] + ["ab" * 9_000]
    assert all(v.encode(t) == reference.encode_ordinary(t) for t in said)
    assert len(v.states) <= states + 1


def test_every_piece_of_the_table_goes_through_the_machine(vocab, reference):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    pieces = {p.encode() for t in texts for p in vocab.pattern.findall(t)}
    fresh = byte_bpe.Vocabulary(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for p in pieces:
        if p not in fresh.rank:
            assert list(fresh.encode_piece(p)) == reference.encode_ordinary(p.decode())
    # A move is built once and then serves every piece that comes by.
    assert len(fresh.moves) < sum(len(p) for p in pieces) / 4


@given(ids=st.lists(st.integers(0, 50_255), max_size=40), block=st.integers(1, 5))
def test_stream_decoding_of_any_ids(vocab, ids, block):
    d = byte_bpe.StreamDecoder(vocab)
    parts = [d.feed(ids[i : i + block]) for i in range(0, len(ids), block)]
    whole = b"".join(vocab.token[i] for i in ids)
    assert b"".join(parts) + d.finish() == whole
    try:
        whole.decode()
    except UnicodeDecodeError:
        return
    for p in parts:
        p.decode()  # every block ends between characters


def test_long_pieces(vocab, reference):
    for t in ("a" * 5_000, " " * 3_000 + "x", "ab" * 3_000, "\n" * 999, "=" * 1_234, "é" * 999):
        assert vocab.encode(t) == reference.encode_ordinary(t)


def test_documents_round_trip(spark, reference):
    rows = [(1, None), (2, ""), (3, "Hello wörld 😀\n\n x"), (3, "Hello wörld 😀\n\n x"), (None, "a"), (5, "lorem ipsum " * 5_000)]
    out = byte_bpe.encode_documents(docs(spark, rows), PATH, public_tokenizers.PATTERN)
    for r in out.collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = reference.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    back = byte_bpe.decode_documents(out, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert byte_bpe.encode_documents(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


# --- language ---------------------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model = lang_id.Model(["a", "b", "c"])
    rng = np.random.default_rng(2)
    worker = lang_id.Labeller(model, penalty=1.5)
    worker.table = rng.normal(size=(20, 3)).astype(np.float32)
    sizes = np.array([4, 0, 6, 1])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    numbers = rng.integers(0, 20, sizes.sum())
    got = worker.viterbi(numbers, starts, sizes)
    for s, n in zip(starts, sizes, strict=True):
        score = lambda path: sum(worker.table[numbers[s + i], p] for i, p in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: B023, E731
        if n:
            assert score(tuple(got[s : s + n])) == pytest.approx(max(score(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-4)


def test_spans_of_mixed_text(spark):
    train = [("the cat and the dog are in the house with this thing", "en"), ("der hund und die katze sind nicht in dem haus", "de"), ("кошка и собака живут в доме", "ru")] * 5
    model = lang_id.learn(train)
    text = "The dog and the cat. КОШКА живут в доме! Der Hund und die Katze"
    rows = [(1, text), (2, None), (3, "123 ..."), (4, "漢字"), (5, ""), (6, "İstanbul the cat and the dog")]
    got = {r["doc_id"]: r for r in lang_id.predict(docs(spark, rows), model).collect()}
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in got[1]["spans"]] == [("The dog and the cat", "en"), ("КОШКА живут в доме", "ru"), ("Der Hund und die Katze", "de")]
    assert [got[i]["lang_pred"] for i in (2, 3, 5)] == ["und"] * 3 and got[2]["score"] == 0
    assert got[4]["lang_pred"] in model.langs and 0 <= got[4]["score"] <= 1
    assert got[6]["spans"][0]["start"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_every_letter_of_a_long_run_is_scored():
    run = "".join(chr(0x4E00 + i % 300) for i in range(500))
    pieces = lang_id.pieces_of(run)
    assert "".join(map(lang_id.body_of, pieces)) == run and max(len(lang_id.body_of(p)) for p in pieces) <= lang_id.PIECE
    whole = [f"<{run}>"[i : i + k] for k in lang_id.ORDERS for i in range(len(run) + 3 - k)]
    assert sorted(g for p in pieces for g in lang_id.grams_of(p)) == sorted(whole)
    assert lang_id.pieces_of("漢字かなkatakana") == ("漢字", "かな", "katakana")
    assert lang_id.pieces_of("été") == ("été",) and lang_id.pieces_of("x" * 24) == ("x" * 24,) and list(map(len, map(lang_id.body_of, lang_id.pieces_of("é" * 49)))) == [24, 24, 1]


def test_text_without_spaces(spark):
    rng = random.Random(8)
    zh, ja = ("".join(rng.choice(s) for _ in range(4_000)) for s in ("的一是不了人我在有他这中大来上国", "のにはをたがでてとしれさあいうか日本"))
    model = lang_id.learn([(zh, "zh"), (ja, "ja")])
    text = zh[:24] + ja[:440] + zh[100:124]
    got = {r["doc_id"]: r for r in lang_id.predict(docs(spark, [(1, text), (2, ja[:440]), (3, zh[:30_000])]), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["ja", "ja", "zh"]
    assert [s["lang"] for s in got[1]["spans"]] == ["zh", "ja", "zh"]
    # Letters that both use may fall to either side.
    assert all(abs(s["end"] - want) <= 3 for s, want in zip(got[1]["spans"], (24, 464, 488), strict=True))


def test_many_languages_and_repeated_rows(spark):
    said = lambda k: f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x " * 8
    model = lang_id.learn([(said(k), f"l{k:03}") for k in range(300)])
    rows = [(k, said(k)) for k in (0, 127, 128, 255, 256, 299)] * 2 + [(None, said(200)), (None, None), (9, said(131) * 20_000)]
    got = lang_id.predict(docs(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == f"l{131 if r['doc_id'] == 9 else r['doc_id']:03}" for r in got if r["doc_id"] is not None)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None) == ["l200", "und"]


def test_predictions_are_those_of_a_plain_version(spark):
    """Log posteriors by the definition and every path's best by a plain Viterbi, over documents of the table."""
    import math

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [(r["text"], r["lang"]) for r in d if r["doc_id"] % 2 and r["lang"]]
    model = lang_id.learn(train)
    counts = lang_id.count_grams(train)
    kinds = {k: {g for _, g in counts if not g.startswith("\0") and len(g) == k} for k in lang_id.ORDERS}
    total = {(lang, k): sum(counts[lang, g] for g in kinds[k]) + 0.5 * len(kinds[k]) for lang in model.langs for k in lang_id.ORDERS}
    letters = {lang: {g[1:]: n for (x, g), n in counts.items() if x == lang and g.startswith("\0")} for lang in model.langs}

    def posterior(word):
        script = lang_id.script_of(word[0])
        fits = [lang for lang in model.langs if script and letters[lang].get(script, 0) >= lang_id.SCRIPT_SHARE * max(1, sum(letters[lang].values()))]
        said = {lang: sum(math.log((counts[lang, g] + 0.5) / total[lang, len(g)]) / 3 for g in lang_id.grams_of(word) if g in kinds[len(g)]) if lang in fits or not fits else -math.inf for lang in model.langs}
        if not fits:
            said = dict.fromkeys(said, 0.0)
        most = max(said.values())
        norm = most + math.log(sum(math.exp(v - most) for v in said.values()))
        return {lang: max(-20.0, v - norm) for lang, v in said.items()}

    rows = [r for r in d if not r["doc_id"] % 2 and r["text"]][:40]
    got = {r["doc_id"]: r for r in lang_id.predict(docs(spark, [(r["doc_id"], r["text"]) for r in rows]), model).collect()}
    for r in rows:
        words = lang_id.words_of(r["text"])
        seen = [posterior(w) for w in words]
        best = dict.fromkeys(model.langs, 0.0)
        for p in seen:
            best = {a: p[a] + max(best[a], max(best.values()) - lang_id.SWITCH_PENALTY) for a in model.langs}
        spans = got[r["doc_id"]]["spans"]
        labels = [s["lang"] for s in spans for w in lang_id.words_of(r["text"][s["start"] : s["end"]])]
        mine = sum(p[a] for p, a in zip(seen, labels, strict=True)) - lang_id.SWITCH_PENALTY * (len(spans) - 1)
        assert mine == pytest.approx(max(best.values()), rel=1e-4, abs=1e-2)
        share = {a: sum(len(lang_id.body_of(w)) for w, x in zip(words, labels, strict=True) if x == a) for a in model.langs}
        assert share[got[r["doc_id"]]["lang_pred"]] == max(share.values())


def test_language_accuracy_and_empty(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lang_id.op5_language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert lang_id.op5_language_id(d.limit(0)).count() == 0
    unlabelled = d.selectExpr("doc_id", "text", "cast(null as string) lang").limit(3)
    assert {r["lang_pred"] for r in lang_id.op5_language_id(unlabelled).collect()} == {"und"}


# --- quality ------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = d.join(labels.select("doc_id", "quality"), "doc_id", "left_semi")
    out = quality.op9_quality(known, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)
    good = [r for r in out if r["quality"] == 1]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)


def test_quality_gradients():
    import numpy as np

    net = quality.Network(seed=1)
    net.w["bias"] += 0.05  # off the kink, where padding would stand
    texts, y, w = [quality.padded("some text here"), quality.padded("#a#b" * 200 + "other end")], np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    g, base = net.step(texts, y, w)
    for name in ("out", "hidden", "filter", "bias", "vector"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.w[name][at] += 1e-3
        up = net.step(texts, y, w)[1]
        net.w[name][at] -= 2e-3
        down = net.step(texts, y, w)[1]
        net.w[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.1, abs=2e-3)


def test_gradients_block_by_block(monkeypatch):
    import numpy as np

    net = quality.Network(seed=3)
    texts, y, w = [quality.padded("ab c" * n) for n in (3, 400, 90)], np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    whole, loss = net.step(texts, y, w)
    monkeypatch.setattr(quality, "BLOCK_HALVES", 5)
    parts, again = net.step(texts, y, w)
    assert again == pytest.approx(loss, rel=1e-5)
    assert all(np.allclose(whole[k], parts[k], rtol=1e-3, atol=1e-5) for k in whole)


def test_documents_with_two_labels_and_long_training_texts(spark):
    rows = [(i, ("good words in a line " if i % 2 else "#!#! $$ %% ") * (3_000 if i < 2 else 8)) for i in range(60)]
    labels = [(i, i % 2) for i, _ in rows] + [(5, 0), (5, 1), (None, 1), (7, None), (999, 1)]
    net = quality.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows), net).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i, _ in rows) >= 55


def test_compiled_scores_are_the_networks():
    import numpy as np

    net = quality.Network(seed=4)
    for text in ("", "short", "long text é " * 200):
        codes = quality.padded(text)
        cut = np.stack([codes[k : k + quality.HALF + quality.WIDTH - 1] for k in range(0, len(codes) - quality.WIDTH + 1, quality.HALF)])
        *_, most, total = net._halves(cut)
        pair = np.arange(len(cut) - 1)[:, None] + np.arange(2)
        h = net.hidden(most[pair], total[pair])[1]
        z = float(np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ net.w["out"] + net.w["out_bias"][0])
        assert net.compiled().score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_cases(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (3, "a" * 100_000), (None, "x"), (3, "again")]
    out = quality.op9_quality(docs(spark, rows), labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    kept = quality.keep_good(docs(spark, rows), quality.Network(), threshold=0.0)
    assert kept.count() == 5 and kept.columns == ["doc_id", "text", "ids", "ranges"]
    assert quality.op9_quality(docs(spark, []), labels).count() == 0


# --- licences ----------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit, gpl = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[3][1]
    files = [
        (1, "LICENSE", mit), (2, "/a/b/x.py", "code"), (3, "a/LICENSE.txt", f"text\n{gpl}\n"), (4, "a/b/c/y.py", f"# {license_scan.TEMPLATES[2][1]}\ncode"), (5, "z.py", None), (6, "q/z.py", ""),
        (7, "a/b/COPYING", "no licence words here about anything"), (8, None, mit), (9, "deep/" * 30 + "f", "licence " * 3_000), (2, "/a/b/x.py", "code"),
    ]
    df = spark.createDataFrame([(i, p, t, "x", "y") for i, p, t in files], "doc_id long, path string, text string, dir string, row string")
    rows = license_scan.scan(df).collect()
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_dir"]) for r in rows}
    assert len(rows) == len(files)
    assert got[1] == ("MIT", "MIT", None) and got[4] == ("Apache-2.0", "Apache-2.0", None) and got[3] == ("GPL-3.0", "GPL-3.0", None)
    assert got[2] == (None, "GPL-3.0", "a") and got[7] == (None, "GPL-3.0", "a")
    assert got[5] == got[6] == (None, "MIT", "") and got[8] == ("MIT", "MIT", None) and got[9] == (None, "MIT", "")
    assert license_scan.scan(df.limit(0)).count() == 0


def test_several_licence_files_and_equal_scores(spark):
    mit, apache = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[2][1]
    files = [(1, "a/LICENSE", mit), (2, "a/COPYING", mit), (3, "a/LICENSE.apache", apache), (4, "a/x.c", "code"), (5, "b/LICENSE", f"{mit} and more words here"), (6, "b/COPYING", apache), (7, "b/y.c", "code"), (8, "c.c", f"{apache}\n{mit}"), (9, "c.d", f"{mit}\n{apache}"), (None, "a/z.c", None)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["license_dir"]) for r in license_scan.scan(df).collect()}
    # Of equal scores the file whose path sorts first, else the most similar; of equal lines the first.
    assert got[4] == got[None] == ("MIT", "a") and got[7] == ("Apache-2.0", "b")
    assert got[8] == ("Apache-2.0", None) and got[9] == ("MIT", None)


def test_weights_of_words_of_no_template(spark):
    import math
    from collections import Counter

    said = "Released under the MIT License, zorbly quux quux"
    texts = [said, *["zorbly quux plain text"] * 30, "quux", None]
    df = Counter(w for t in texts for w in set(license_scan.words(t or "")))
    vector = lambda t: {w: k * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, k in Counter(license_scan.words(t)).items()}
    a, b = vector(said), vector(license_scan.TEMPLATES[0][1])
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)
    files = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    row = license_scan.scan(files).where("doc_id = 0").first()
    assert (row["own_license"], row["own_score"]) == ("MIT", pytest.approx(want, abs=1e-8))


def test_wrapped_headers_licence_files_and_identifiers(spark):
    from pathlib import Path

    full = {p.stem: p.read_text() for p in (Path(license_scan.__file__).parent / "licenses").glob("*.txt")}
    gpl = "/*\n * Copyright (C) 2020 A. Person\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main;\n"
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\nimport x\n'
    files = [("a.c", gpl, "GPL-3.0"), ("b.c", gpl.replace("version 3", "version 2"), "GPL-2.0"), ("c.py", apache, "Apache-2.0"), ("d.py", "# x\n# Released under\n# the MIT License.\ncode", "MIT"), ("e.py", "# SPDX-License-Identifier: MIT\n", "MIT")]
    files += [("f.py", "// SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"), ("g.py", "no licence here\nat all", None)] + [(f"{n}/LICENSE", t, n) for n, t in full.items()]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["own_license"] for r in license_scan.scan(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(files)}


def test_native_plans_have_no_python(spark):
    from marlstone.llm import chat_format, exact_dedup

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    for df in (exact_dedup.classify(d), exact_dedup.deduplicate(d), chat_format.format_conversations(c), license_scan.op10_license_scan(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
