"""The pipeline's stages one by one against plain versions, and every query's SQL."""

import duckdb
import pytest

import corpus_pipeline
from marlstone.llm import decontaminate, registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.items() <= before.items()
        if name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[t] = min(best.get(t, i), i)
            assert sorted(after) == sorted(best.values())
        if name == "benchmark decontamination":
            windows = decontaminate.Windows(bench)
            assert sorted(after) == sorted(i for i, t in before.items() if not windows.scan(decontaminate.words_of(t))[0])
    out = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert out.count() == kept.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_the_whole_pipeline_against_a_plain_version(spark):
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    from marlstone.llm import quality
    from tests.llm.test_dedup import brute
    from tests.llm.test_text_ops import brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).compiled()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    good = [(i, t) for i, t in rows if net.score(t) >= 0.7]
    first = {}
    for i, t in good:
        first.setdefault(t, i)
    once = [(i, t) for i, t in good if first[t] == i]
    comp = brute(once, 80)
    apart = [(i, t) for i, t in once if comp[i][1] == i]
    # A text that holds no whole first window of an item, nor any other, is clean; the brute force walks the words.
    clean = [(i, t) for i, t in apart if not brute_hits(t, items)[1]]
    assert len(rows) > len(good) > len(once) > len(apart) > len(clean) > 0
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: (reference.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in clean}


def test_stages_on_odd_rows(spark):
    said = "the same plain words are said here once more so that a shingle or two can be made of them"
    rows = [(1, None, 1), (2, "", 2), (3, said, 3), (3, said, 4), (4, said, 5), (None, said, 6), (None, None, 7), (5, "x" * 300_000, 8), (6, said.upper(), 9), (6, "other", 10)]
    docs = spark.createDataFrame([(i, t, "en", str(k)) for i, t, k in rows], "doc_id long, text string, row_key string, kept string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "row_key", "kept"], name
    assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str) == sorted([(1, None), (3, said), (5, "x" * 300_000), (6, "other")], key=str)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 or pytest.fail("rows from nothing")
        if "text" not in docs.columns:
            break


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
