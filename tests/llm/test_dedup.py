"""Exact and near deduplication against brute force."""

import os
import random

from marlstone.llm import exact_dedup, near_dedup, shared

KIND = "doc_id long, text string, rank string, n long"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], KIND)


def test_classify_cases(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (9, "x" * 300_000), (8, "x" * 300_000)]
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup.classify(docs(spark, rows), keep=keep).collect()
        assert len(got) == len(rows)
        by: dict = {}
        for i, t in rows:
            by.setdefault(t or "", []).append(i)
        for r in got:
            group = next(g for t, g in by.items() if r["doc_id"] in g and len(g) == r["group_size"] or r["doc_id"] is None and r["group_size"] == len(g) and None in g)
            known = [i for i in group if i is not None]
            assert r["keep_id"] == (pick(known) if known else None)
        assert sum(r["kept"] for r in got) == len(by)


def test_extreme_identifiers_and_many_runs(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a"), (most, "a"), (0, "a"), (None, "a"), (least, "b"), (None, "b"), (None, "b")]
    for keep, best in (("smallest", least), ("largest", most)):
        for parts in (1, 40, 300):
            got = exact_dedup.classify(docs(spark, rows).repartition(parts), keep=keep).collect()
            assert {r["keep_id"] for r in got if r["group_size"] == 4} == {best} and {r["keep_id"] for r in got if r["group_size"] == 3} == {least}
            assert sum(r["kept"] for r in got) == 2
    kept = exact_dedup.deduplicate(docs(spark, rows), keep="largest").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(least, "b"), (most, "a")]


def test_classify_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "", None, f"t{rng.randrange(40)}", f"u{i}"])) for i in range(600)]
    rng.shuffle(rows)
    best: dict = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", -1), i)
    got = exact_dedup.classify(docs(spark, rows).repartition(7), keep="largest").collect()
    texts = dict(rows)
    assert all(r["keep_id"] == best[texts[r["doc_id"]] or ""] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_deduplicate_keeps_columns_and_one_row(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "a")]
    kept = exact_dedup.deduplicate(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "rank", "n"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a"), (3, None), (5, "b"), (None, "c")], key=str)


def test_empty(spark):
    assert exact_dedup.classify(docs(spark, [])).count() == 0
    assert exact_dedup.deduplicate(docs(spark, [])).count() == 0
    assert near_dedup.classes(docs(spark, [])).count() == 0
    assert near_dedup.deduplicate(docs(spark, [])).count() == 0


def brute(rows, percent):
    """Components by comparing all pairs of shingle sets made of real words."""

    def sets(t):
        w = [x for x in near_dedup.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {i: sets(t) for i, t in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s[i]), find(i)) for i in ids}


def near_rows():
    """Groups of copies with a few words changed, chains of drifting texts, a shared passage, short and odd texts."""
    rng = random.Random(5)
    word = lambda: rng.choice("ab") + "".join(rng.choice("cdefghij") for _ in range(4))
    rows, i = [], 0
    for size, n in ((40, 120), (12, 60), (3, 30)):
        base = [word() for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(n)] = word()
            rows.append((i := i + 1, " ".join(t)))
    drift = [word() for _ in range(100)]
    for _ in range(30):
        drift[rng.randrange(100)] = word()
        rows.append((i := i + 1, " ".join(drift)))
    passage = " ".join(word() for _ in range(80))
    rows += [(i := i + 1, f"{passage} {' '.join(word() for _ in range(40))}") for _ in range(30)]
    rows += [(i := i + 1, t) for t in (None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", " x y", "x\x0by", "x y", "É é É é É é")]
    rows += [(i := i + 1, " ".join(word() for _ in range(30_000)))]
    rng.shuffle(rows)
    return rows


def test_components_against_brute_force(spark):
    rows = near_rows()
    for percent in (80, 85):
        want = brute(rows, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(docs(spark, rows).repartition(5), near_dedup.Forest(percent=percent)).collect()}
        assert got == want


def test_dense_regions_lose_no_link(spark):
    rows = near_rows()
    tight = near_dedup.Forest(percent=85, block=4, window=1, keep=1, best_rounds=0)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs(spark, rows), tight).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 85).items()}


def test_rows_that_share_an_id(spark):
    rng = random.Random(6)
    said = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(3)]
    rows = [(1, said[0]), (1, said[1]), (2, said[1] + " z"), (3, said[2]), (3, said[2]), (None, said[2]), (4, None), (4, "")]
    kept = near_dedup.deduplicate(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, said[0]), (1, said[1]), (3, said[2]), (None, said[2]), (4, None), (4, "")], key=str)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.classes(docs(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, 3), (4, 4)}


def test_near_deduplicate(spark):
    rows = [(3, "a b c d e f g"), (2, "A b c d e f g"), (5, None), (6, ""), (7, "q"), (7, "q"), (None, "a b c d e f g")]
    kept = near_dedup.deduplicate(docs(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, "A b c d e f g"), (5, None), (6, ""), (7, "q"), (None, "a b c d e f g")], key=str)
    assert kept.columns == ["doc_id", "text", "rank", "n"]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["id"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    more = spark.createDataFrame([(40, 101), (500, 501), (3, 4)], "a long, b long")
    again = near_dedup.joined(spark.createDataFrame(list(got.items()), "id long, comp long"), more, [])
    assert {r["id"]: r["comp"] for r in again.collect()} == {i: 0 for i in (*range(41), 100, 101, 102)} | {500: 500, 501: 500}


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(i, max(0, i - rng.randrange(1, 40))) for i in rng.sample(range(3_000), 2_400)]
    parent = list(range(3_000))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e}


def test_tables_between_steps_have_no_side_files(spark):
    """Each file with a .crc beside it starts `chmod` four times in an executor on a local shared folder."""
    paths = []
    made = shared.materialise(spark.range(1000).repartition(4), "plain", paths)
    names = os.listdir(paths[0].removeprefix("file://"))
    assert sum(n.startswith("part-") for n in names) == 4
    assert not [n for n in names if n.endswith(".crc")]
    assert sorted(r["id"] for r in made.collect()) == list(range(1000))
    shared.drop_tables(spark, paths)
    assert not paths
