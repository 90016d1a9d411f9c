"""Queries that SQL can't express against plain Python models, on whole tables of the smallest scale."""

import difflib
import itertools
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from marlstone.config import Turns
from marlstone.functions import unicode
from marlstone.operators import alignment, incremental, turns
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict(recursive=True) for r in registry.queries()[name](spark, SF).collect()]


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def test_similarity_of_items(spark):
    said = {r["item_id"]: plain(r["text"]) for r in table(spark, "benchmark")}
    got = {r["item_id"]: r["similarity"] for r in rows(spark, "q52_similarity")}
    assert set(got) == {i for i in said if i + 1 in said}
    for i, s in got.items():
        a, b = said[i], said[i + 1]
        g, h = ({x + y for x, y in itertools.pairwise(t)} for t in (a, b))
        both = len(g & h)
        assert s == pytest.approx(0.5 * difflib.SequenceMatcher(None, a, b).ratio() + 0.35 * both / len(g | h) + 0.15 * min(both / len(g), both / len(h)), abs=1e-6)


def test_clusters_of_vectors(spark):
    groups = {}
    for r in table(spark, "embeddings"):
        groups.setdefault(r["label"], []).append((r["vec_id"], np.array(r["embedding"], float)))
    got = {}
    for r in rows(spark, "q51_agglomerative"):
        got.setdefault(r["utt"], {}).setdefault(r["cluster"], set()).add(r["key"])
    for utt, members in groups.items():
        if len(members) > 60:  # the model compares all pairs of clusters again for each merge
            continue
        unit = {k: v / np.linalg.norm(v) for k, v in members}
        clusters = [{k} for k, _ in sorted(members, key=lambda m: m[0])]
        mean = lambda a, b, u=unit: 1 - np.mean([u[x] @ u[y] for x in a for y in b])
        while len(clusters) > 1:
            d, a, b = min((mean(x, y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(clusters), 2))
            if d >= 0.5 - 1e-12:
                break
            clusters[a] |= clusters.pop(b)
        assert sorted(map(sorted, got[utt].values())) == sorted(map(sorted, clusters))


def test_evidence_lines(spark):
    by_page = {}
    for r in rows(spark, "q56_evidence_selection"):
        by_page.setdefault(r["media"], []).append(r)
    for page in table(spark, "pages"):
        listed = [x for x in re.sub("<[^>]*>", "\n", page["html"]).split("\n") if x]
        heard, seen, found = listed[0], set(), []
        for place, line in enumerate(listed):
            c = re.sub(r"\s+", "", line)
            noise = not c or re.search(r"(?i)(?:https?://|www\.)\S", line) or re.fullmatch(r"\d+(?:[.,]\d+)?", c) or re.fullmatch(r"[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]?", c) or not any(x.isalnum() for x in c)
            key = plain(line)
            if noise or not key or key in seen:
                continue
            seen.add(key)
            n = len(c)
            subtitle = min(1.0, 0.65 * sum(x.isalnum() for x in c) / n + 0.35 * (1.0 if 4 <= n <= 80 else 0.65 if 2 <= n <= 140 else 0.25) + (0.1 if re.search("[!?.,]", line) else 0))
            found.append((round(unicode._similarity(line, heard), 6), round(subtitle, 6), place, line))
        near = [x for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2]))[:4] if x[0] >= 0.05]
        rest = sorted((x for x in found if x not in near), key=lambda x: (-x[1], -x[0], x[2]))
        kept, used = [], 0
        for k, x in enumerate((near + rest)[:8]):
            used += len(x[3]) + (k > 0)
            if k == 0 or used <= 600:
                kept.append(x[3][:600] if k == 0 else x[3])
        got = sorted(by_page.get(page["page_id"], []), key=lambda r: r["rank"])
        assert [r["line"] for r in got] == kept


def test_decisions_splice_accepted_edits(spark):
    inventory = {}
    for r in rows(spark, "q53_alignment_inventory"):
        inventory.setdefault(r["id"], []).append(r)
    heard = {str(r["doc_id"]): re.sub(r"[^\x20-\x7e]", "", r["text"] or "").replace("the", "teh").replace("o", "0") for r in table(spark, "documents")}
    for i, found in inventory.items():
        for r in found:
            assert 0 <= r["start"] <= r["end"] <= len(heard[i]) and heard[i][r["start"] : r["end"]] != r["replacement"]
        spans = sorted((r["start"], r["end"]) for r in found)
        hit = any(b[0] < a[1] for a, b in itertools.pairwise(spans))
        assert hit == any(r["status"] == "conflicting" for r in found)
        assert len({r["status"] for r in found} & {"classifiable", "over_capacity"}) < 2
    for r in rows(spark, "q57_decisions"):
        text = heard[r["id"]]
        assert r["accepted"] == (r["corrected_text"] != text) == (r["edits"] > 0)
        reference = text if not r["accepted"] else None
        assert reference in (None, r["corrected_text"])


def test_blocks_are_those_of_difflib():
    rng = np.random.default_rng(3)
    for _ in range(400):
        letters = list("abcdefgh"[: int(rng.integers(1, 9))])
        a = [str(x) for x in rng.choice(letters, rng.integers(0, 60))]
        b = [str(x) for x in rng.choice(letters, rng.integers(0, 60))]
        if rng.random() < 0.6:
            b = [x for x in a if rng.random() > 0.15]
        want = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert alignment.matching_blocks(a, b, small=int(rng.choice([0, 30]))) == want


def test_blocks_of_two_or_more_are_those_of_difflib():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, int(rng.integers(0, 60)))] for _ in range(2))
        want = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 2]
        for small in (0, 10, 10_000):
            assert alignment.matching_blocks(a, b, small=small, least=2) == want


def test_blocks_of_many_texts_at_once_are_those_of_difflib(monkeypatch):
    """Runs don't go over from one pair of texts to the next, whether a pair repeats much or little."""
    rng = np.random.default_rng(5)
    for small in (0, 5, 8_000):
        monkeypatch.setattr(alignment, "SMALL", small)
        for _ in range(60):
            sides = [[rng.integers(0, int(rng.integers(1, 9)), int(rng.integers(0, 90))).astype(np.uint64) for _ in range(8)] for _ in range(2)]
            ends = [np.cumsum([0, *map(len, side)]) for side in sides]
            want = []
            for k, (a, b) in enumerate(zip(*sides, strict=True)):
                found = difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).get_matching_blocks()
                want += [[m.a + int(ends[0][k]), m.b + int(ends[1][k]), m.size] for m in found if m.size >= 2]
            cells = np.stack([ends[0][:-1], ends[0][1:], ends[1][:-1], ends[1][1:]], 1)
            assert alignment._common(*map(np.concatenate, sides), cells, 2).tolist() == want


def test_texts_are_aligned_together(spark, monkeypatch):
    """Requests of one batch are aligned by one call, each as it would be alone."""
    heard, line = "we like the red hause on the hill", "we like the red house on the hill"
    texts = [(heard, line), ("see the old mill, see the", "see the old mill, see a"), (heard.upper(), "Wir mögen das rote Haus"), ("", line), (heard, heard), ("die mögen das Haus am see", "die mögen das Hans am see")]
    alone = [alignment.gaps(*x) for x in texts]
    assert [len(x) for x in alone] == [1, 1, 0, 0, 0, 1] and alignment.all_gaps(texts) == alone
    df = spark.createDataFrame([(str(k), h, [("L01", x)]) for k, (h, x) in enumerate(texts)], "id string, heard string, lines array<struct<line_id:string,text:string>>").coalesce(1)
    got = {r["id"]: (r["start"], r["end"], r["original"], r["replacement"]) for r in alignment.inventory(df).collect()}
    assert got == {str(k): x[0][:4] for k, x in enumerate(alone) if x}
    asked = lambda n: (n, "a" * 40, [{"line_id": "L01", "text": "a" * 40}])
    batch = lambda *n: pa.RecordBatch.from_pylist([dict(zip(("id", "heard", "lines"), asked(x), strict=True)) for x in n])
    for most, want in ((1000, [["1", "2", "3"]]), (160, [["1", "2"], ["3"]]), (10, [["1"], ["2"], ["3"]])):
        monkeypatch.setattr(alignment, "MOST_CHARS", most)
        assert [[r[0] for r in x] for x in alignment._together(iter([batch("1", "2"), batch("3")]))] == want


def test_texts_meet_their_candidates_once(spark):
    """The inventory follows from a request's row alone, and decisions join texts with an array of candidates."""
    lines = [("L01", "we like the red house on the hill")]
    df = spark.createDataFrame([("1", "we like the red hause on the hill", lines)], "id string, heard string, lines array<struct<line_id:string,text:string>>")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    found = alignment.inventory(df)
    assert not any(x in plan(found) for x in ("Join", "Window", "Aggregate"))
    decided = alignment.decide(df, found)
    assert plan(decided).count("Join") == 1
    assert [tuple(r) for r in decided.collect()] == [("1", "we like the red house on the hill", True, 1, ["accepted"])]


def test_equal_lines_are_aligned_once(monkeypatch):
    calls, plain = [], alignment._gaps
    monkeypatch.setattr(alignment, "_gaps", lambda a, b: calls.append(b.text) or plain(a, b))
    line = lambda k, t: {"line_id": f"L0{k}", "text": t}
    house, mouse = "we like the red house on the hill", "we like the red mouse on the hill"
    found = alignment.enumerate_candidates("we like the red hause on the hill", [line(1, house), line(2, house), line(3, mouse)])
    assert calls == [house, mouse] and [(c["replacement"], c["lines"]) for c in found] == [("house", ["L01", "L02"]), ("mouse", ["L03"])]
    alignment.mark_conflicts(found)
    assert [(c["conflict_group"], c["conflict_size"]) for c in found] == [(1, 2), (1, 2)]


def test_gaps_of_anchored_texts(spark):
    cut = lambda heard, line: [(g[2], g[3], *g[4:]) for g in alignment.gaps(heard, line)]
    assert cut("we like the red hause on the hill", "we like the red house on the hill") == [("hause", "house", "replace", "two_sided", 0, [])]
    assert cut("we like the red on the hill", "we like the red house on the hill") == [("", "house", "insert", "two_sided", 0, ["insert_diagnostic"])]
    assert cut("Dear all, see the red house", "Deer all, see the red house") == [("Dear", "Deer", "replace", "one_sided", 5, [])]
    assert cut("see the red hause now, he said", "see the red house now") == [("hause now,", "house now", "replace", "one_sided", 3, [])]
    assert cut("a b x", "a b y") == [("x", "y", "replace", "one_sided", 2, [])]
    # No anchor: one content token only, or a run that occurs twice.
    assert cut("a x", "a y") == [] and cut("a b x a b", "a b y a b") == []
    # Five content tokens at the line's end are too many; more than twelve between anchors are too long.
    assert cut("so it goes one", "so it goes 1 2 3 4 5") == []
    assert cut("so it " + "w " * 13 + "goes on", "so it now goes on")[0][-1] == ["long_span"]
    assert cut("so it goes on", "so it, goes on") == [("", ",", "replace", "two_sided", 0, ["surface_only"])]


def test_inventory_statuses(spark):
    line = lambda k, t: (f"L0{k}", t)
    asks = [
        ("ok", "we like the red hause on the hill", [line(1, "we like the red house on the hill"), line(2, "we like the red house on the hill")]),
        ("weak", "a b x", [line(1, "a b y")]),
        ("moved", "so it goes and then it goes", [line(1, "so it goes then")]),
        ("mixed", "we like the hause here", [line(1, "we like the house here now"), line(2, "we like the house")]),
        ("over", " ".join(f"a{i} b{i} x{i}" for i in range(30)) + " end of it", [line(1, " ".join(f"a{i} b{i} y{i}" for i in range(30)) + " end of it")]),
        ("bytes", "we like the red hause on the hill", [line(1, "we like the red house on the hill"), line(2, "z" * 25_000)]),
    ]
    df = spark.createDataFrame(asks, "id string, heard string, lines array<struct<line_id:string,text:string>>")
    got = {}
    for r in alignment.inventory(df).collect():
        got.setdefault(r["id"], []).append((r["original"], r["replacement"], r["status"], r["support"], list(r["reasons"])))
    assert got["ok"] == [("hause", "house", "classifiable", 2, [])]
    assert got["weak"] == [("x", "y", "diagnostic_only", 1, ["weak_one_sided_anchor"])]
    assert got["moved"] == [("and", "then", "diagnostic_only", 1, ["relocated_existing_text"])]
    assert len(got["over"]) == 30 and {r[2] for r in got["over"]} == {"over_capacity"}
    assert got["bytes"] == [("hause", "house", "over_capacity", 1, [])]


def test_turns_cover_their_segments(spark):
    """Parts of a segment are in order, without gaps, and hold its letters once."""
    got = {}
    for r in rows(spark, "q41_turn_split"):
        got.setdefault(r["media"], []).append(r)
    said = {}
    for r in sorted(table(spark, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        said.setdefault(r["conv_id"], []).append(r["text"] or "")
    letters = lambda t: [c for c in t if c.isalnum()]
    for media, parts in got.items():
        parts.sort(key=lambda r: r["start_ms"])
        assert letters("".join(p["text"] for p in parts)) == letters("".join(said[media]))
        assert all(a["end_ms"] <= b["start_ms"] for a, b in itertools.pairwise(parts))


def slow_snap(texts, starts, ends, speakers, cfg):
    """The rule word by word: a change in mid-sentence moves behind the sentence's end, if that is near and enough words follow."""
    out = list(speakers)
    ends_sentence = [bool(re.search("[.!?]$", t)) for t in texts]
    changes = [i for i in range(1, len(speakers)) if speakers[i] != speakers[i - 1]]
    for i, stop in zip(changes, [*changes[1:], len(speakers)], strict=False):
        near = [j for j in range(i, min(stop, i + cfg.snap_tokens)) if ends_sentence[j]]
        if not ends_sentence[i - 1] and near and stop - near[0] - 1 >= cfg.snap_following and ends[near[0]] - starts[i] <= cfg.snap_ms:
            out[i : near[0] + 1] = [speakers[i - 1]] * (near[0] + 1 - i)
    return out


def test_snapping_against_the_rule():
    rng = np.random.default_rng(5)
    cfg = Turns()
    for _ in range(500):
        n = int(rng.integers(3, 16))
        texts = [str(rng.choice(["a", "b.", "c", "d!"])) for _ in range(n)]
        starts = np.cumsum(rng.integers(50, 700, n)).tolist()
        ends = [s + 40 for s in starts]
        who = [str(x) for x in np.repeat(rng.choice(list("ABC"), n), rng.integers(1, 5, n))[:n]]
        assert turns.snap(texts, starts, ends, who, cfg) == slow_snap(texts, starts, ends, who, cfg)


def test_sentences_go_to_one_speaker():
    texts, starts = ["So", "we", "go.", "Now", "you"], [0, 100, 200, 300, 400]
    ends = [s + 90 for s in starts]
    assert turns.coherent(texts, starts, ends, list("AAABB"), "So we go. Now you") == list("AAABB")
    assert turns.coherent(texts, starts, ends, list("AABBB"), "So we go. Now you") == list("AAABB")
    assert turns.coherent(texts, starts, ends, list("ABBBA"), "So we go. Now you") == list("BBBBA")
    assert turns.coherent(texts, starts, [9_000] * 5, list("AABBB"), "So we go. Now you") == list("AABBB")
    assert turns.coherent([], [], [], [], "x") == [] and turns.coherent(["a"], [0], [1], ["A"], "One. Two. Three.") == ["A"]


def test_retries_read_statuses():
    assert all(incremental.retryable(e) for e in ("HTTP 429", "HTTP/1.1 503 Busy", "status code: 502", "read timed out", "Connection reset by peer", ConnectionError("x"), TimeoutError()))
    assert not any(incremental.retryable(e) for e in ("row 1500 is broken", "HTTP 404", "500 rows", ValueError("429 items"), "no connection string"))
    try:
        try:
            raise KeyError("a")
        except KeyError as e:
            raise ValueError("b") from e
    except ValueError as e:
        assert incremental.error_chain(e) == "ValueError: b <- KeyError: 'a'"
    assert incremental.implementation_digest(turns, unicode) == incremental.implementation_digest(unicode, turns) != incremental.implementation_digest(turns)


def test_fingerprints_refuse_nan(spark):
    df = spark.createDataFrame([(1, math.nan)], "a long, b double")
    with pytest.raises(Exception, match="NaN"):
        df.select(incremental.fingerprint("a", "b")).collect()
    both = df.select(incremental.fingerprint("a", version="2").alias("x"), incremental.fingerprint(df["a"].alias("a"), version="2").alias("y")).first()
    assert both["x"] == both["y"]


def test_local_deletions():
    line = "We saw the red house."
    assert alignment.local_deletion("we saw the the red house", "the the", "the", [line], 3) == "unique_local_replacement"
    assert alignment.local_deletion("saw the the red", "the the", "the", ["Saw the red"], 3) == "unique_local_replacement"
    # Where the heard text ends within the width the line must end too.
    assert alignment.local_deletion("aw the the red", "the the", "the", [line], 8) == "local_alignment_not_found"
    assert alignment.local_deletion("x the the y", "the the", "the", ["x the y", "x  the  y"], 3) == "unique_local_replacement"
    assert alignment.local_deletion("1 ab cd ab 2", "cd", "", ["1 abab 2 1 abab 2"], 1) == "ambiguous_local_alignment"
    assert alignment.local_deletion("", "", "", [], 3) == "span_not_unique" and alignment.local_deletion("a b a", "a", "c", [line], 3) == "span_not_unique"
