"""Queries over the seams to external clients, with clients whose answers follow from what they are asked, and over splices and model items."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.adapters import EMO, SEG, emotions, segments, table, vectors
from marlstone.config import Complexity
from marlstone.functions import policy, text, unicode
from marlstone.operators import alignment, clustering, incremental, routing, select, stages, turns
from marlstone.operators.durable import durable, new_path
from marlstone.plans.queries_text import STRIP, WORDS
from marlstone.plans.registry import query
from marlstone.sources import clients, writers


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'the cat sat' END AS one, CASE doc_id % 3 WHEN 0 THEN 'a cat sits' WHEN 1 THEN 'the cat sits' ELSE 'teh cat sat' END AS several FROM documents""")
def q112_splices(spark: SparkSession, d: str) -> DataFrame:
    """One exact replacement, and several from the right."""
    i = F.col("doc_id")
    edit = lambda a, b, said: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(said).alias("replacement"))
    none = F.array().cast("array<struct<start:int,end:int,replacement:string>>")
    edits = F.when(i % 3 == 0, F.array(edit(0, 3, "a"), edit(8, 11, "sits"))).when(i % 3 == 1, F.array(edit(8, 11, "sits"), edit(0, 3, "the"))).otherwise(none)
    original = F.when(i % 2 == 0, "teh").otherwise("the")
    return table(spark, d, "documents").select("doc_id", text.splice(F.lit("teh cat sat"), F.lit(0), F.lit(3), original, F.lit("the")).alias("one"), text.splice_all(F.lit("teh cat sat"), edits).alias("several"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'c1,c2' END AS shown, doc_id % 2 = 0 AND doc_id % 3 <> 2 AS changed FROM documents""")
def q113_model_items(spark: SparkSession, d: str) -> DataFrame:
    """What a model sees of a request, and returned items that differ from those sent."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    requests = docs.select("id", F.lit("a b c d e").alias("heard"), F.lit("secret").alias("label"))
    one = lambda k, status: F.struct(F.lit(f"c{k}").alias("candidate_id"), F.lit(2 * k).alias("start"), F.lit(2 * k + 1).alias("end"), F.lit("x").alias("original"), F.lit("y").alias("replacement"), status.alias("status"))
    good = F.when(F.col("id") % 3 == 2, "conflicting").otherwise("classifiable")
    found = docs.select("id", F.inline(F.array(one(2, good), one(1, good), one(3, F.lit("conflicting")))))
    sent = alignment.model_items(requests, found)
    back = sent.withColumn("candidates", F.when(F.col("id") % 2 == 0, F.reverse("candidates")).otherwise(F.col("candidates")))
    wrong = alignment.same_items(sent, back).withColumn("changed", F.lit(True))
    shown = sent.select("id", F.array_join(F.transform("candidates", lambda c: c["candidate_id"]), ",").alias("shown"), F.size(F.array_except(F.array(*map(F.lit, sent.columns)), F.array(F.lit("id"), F.lit("text"), F.lit("candidates")))).alias("extra"))
    return shown.where("extra = 0").join(wrong, "id", "left").select("id", "shown", F.coalesce("changed", F.lit(False)).alias("changed"))


@query(f"""SELECT lang, count(*) FILTER (words >= 5) AS long, count(*) FILTER (clauses >= 2) AS hard FROM (SELECT lang, len(regexp_extract_all(t, '{WORDS}')) AS words, CASE WHEN t = '' THEN 0 ELSE len(regexp_extract_all(t, '{policy.CLAUSE}')) + 1 END AS clauses FROM (SELECT lang, {STRIP.replace('X', 'text', 1)} AS t FROM documents WHERE lang = 'en')) GROUP BY lang""")
def q114_settings(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds that the environment overrides."""
    cfg = Complexity.from_env(env={"MARLSTONE_EN_LONG_WORDS": " 5 ", "MARLSTONE_COMPLEX_CLAUSES": "2", "MARLSTONE_ZH_LONG_CHARS": ""})
    rows = table(spark, d, "documents").where("lang = 'en'").select("lang", policy.complexity(F.col("text"), F.col("lang"), cfg).alias("c"))
    return rows.groupBy("lang").agg(F.count_if("c.is_long").alias("long"), F.count_if("c.is_complex").alias("hard"))


@query("""SELECT count(*) FILTER (quality = 0) || ' rows failed: ' || min(doc_id) FILTER (quality = 0) || ': poor' AS message FROM labels""")
def q115_required(spark: SparkSession, d: str) -> DataFrame:
    """All failing rows are told at once, the first by name."""
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "poor").alias("error"))
    try:
        routing.require_good(rows)
        message = "none"
    except ValueError as e:
        message = str(e).split(",")[0]
    return spark.createDataFrame([(message,)], "message string")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '2' WHEN 1 THEN 'missing' WHEN 2 THEN 'unknown' WHEN 3 THEN 'repeated' WHEN 4 THEN 'range' ELSE 'broken' END AS outcome FROM documents""")
def q116_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Replies that must judge every expected candidate once, and no other."""
    i = F.col("doc_id")
    one = lambda c, x: '{"candidate_id":"' + c + '","correspondence":"same","confidence":' + x + "}"
    bodies = [(one("a", "0.9"), one("b", "1")), (one("a", "0.9"),), (one("a", "1"), one("b", "1"), one("z", "1")), (one("a", "1"), one("a", "1"), one("b", "1")), (one("a", "1"), one("b", "1.5")), ("{",)]
    reply = F.lit("")
    for k, parts in enumerate(bodies):
        reply = F.when(i % 6 == k, '{"judgments":[' + ",".join(parts) + "]}").otherwise(reply)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for said in batch["reply"]:
                try:
                    out.append(str(len(alignment.strict_judgments(said, ["b", "a"]))))
                except json.JSONDecodeError:
                    out.append("broken")
                except ValueError as e:
                    ids = [] if "range" in str(e) else [j["candidate_id"] for j in json.loads(said)["judgments"]]
                    out.append("range" if not ids else "unknown" if "z" in ids else "missing" if len(ids) < 2 else "repeated")
            yield pd.DataFrame({"doc_id": batch["doc_id"], "outcome": out})

    return table(spark, d, "documents").select("doc_id", reply.alias("reply")).mapInPandas(run, "doc_id long, outcome string")


@query("""SELECT item_id, CASE WHEN k <= 24 AND k % 10 <> 3 THEN 'answer' ELSE 'open' END AS state, CASE WHEN k > 24 THEN 0 ELSE 1 END AS attempts FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark)""")
def q117_budget(spark: SparkSession, d: str) -> DataFrame:
    """Answers within three calls of eight items; items that a reply leaves out and those beyond stay open."""
    keys = [str(r[0]) for r in table(spark, d, "benchmark").select("item_id").orderBy("item_id").collect()]
    silent = {k for n, k in enumerate(keys, 1) if n % 10 == 3}
    cache: dict[str, object] = {}
    ledger: list[dict] = []
    incremental.Budget(calls=3, attempts=1).run(keys, cache, ledger, lambda asked: {k: "answer" for k in asked if k not in silent})
    events = spark.createDataFrame([(e["event"], e["call"], e["keys"]) for e in ledger], "event string, call int, keys array<string>")
    rows = spark.createDataFrame([(k, str(cache.get(k, "open"))) for k in keys], "key string, state string")
    tried = incremental.attempts(events)
    return rows.join(tried, "key", "left").select(F.col("key").cast("long").alias("item_id"), "state", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'answer after 3' WHEN 1 THEN 'ValueError: HTTP 404 <- KeyError: ''x''' WHEN 2 THEN 'answer after 2' WHEN 3 THEN 'TimeoutError: slow <- KeyError: ''x''' WHEN 4 THEN 'ValueError: row 1500 <- KeyError: ''x''' ELSE 'answer after 1' END AS outcome, CASE n_nationkey % 6 WHEN 0 THEN 3.0 WHEN 2 THEN 1.0 WHEN 3 THEN 3.0 ELSE 0.0 END AS waited FROM nation""")
def q118_retries(spark: SparkSession, d: str) -> DataFrame:
    """Calls again after transient errors, with waits that double; other errors are told with what they came from."""
    out = []
    for n in sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()):
        errors = {0: [ValueError("HTTP 503"), ConnectionError("gone")], 1: [ValueError("HTTP 404")], 2: [ValueError("status 429")], 3: [TimeoutError("slow")] * 3, 4: [ValueError("row 1500")], 5: []}[n % 6]
        waits: list[float] = []
        left, tries = list(errors), [0]

        def call(left=left, tries=tries) -> str:
            tries[0] += 1
            if left:
                raise left.pop(0) from KeyError("x")
            return f"answer after {tries[0]}"

        try:
            outcome = str(incremental.with_retries(call, sleep=waits.append))
        except Exception as e:
            outcome = incremental.error_chain(e)
        out.append((n, outcome, float(sum(waits))))
    return spark.createDataFrame(out, "n_nationkey long, outcome string, waited double")


class Slow:
    """A speech engine of two characters a second that has no voice for texts ending in a comma."""

    name, extension, signature = "slow", ".wav", "slow-1"

    def synthesize(self, text: str, language: str, path: str) -> float:
        if text.endswith(","):
            raise ValueError("no voice")
        return len(text) / 2


@query("""WITH c AS (SELECT conv_id, turn, 5.0 + turn % 4 AS target, unnest(['ab', 'abcdefgh,', 'abcdefghijkl', 'c' || conv_id || repeat('x', 20)]) AS t, unnest([0, 1, 2, 3]) AS idx FROM conversations),
m AS (SELECT *, CASE WHEN t LIKE '%,' THEN NULL WHEN t = 'ab' THEN 5.5 ELSE length(t) / 2.0 END AS s FROM c)
SELECT conv_id AS media, turn AS pos, idx, round(abs(s - target), 6) AS duration_error, 'success' AS status FROM m WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(s - target), idx) = 1""")
def q119_measured(spark: SparkSession, d: str) -> DataFrame:
    """Candidates measured by an engine where the cache lacks them, and the nearest in duration."""
    said = F.array(F.lit("ab"), F.lit("abcdefgh,"), F.lit("abcdefghijkl"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.repeat(F.lit("x"), F.lit(20))))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("media"), F.col("turn").alias("pos"), (F.lit(5.0) + F.col("turn") % 4).alias("target"), F.lit("en").alias("language"), F.posexplode(said).alias("idx", "text"))
    known = clients.measure(rows, spark.createDataFrame([], "fingerprint string, measured double"), Slow, "slow-1").where("text = 'ab'").select("fingerprint", F.lit(5.5).alias("measured")).distinct()
    best = select.closest_duration(clients.measure(rows, durable(known, "measured"), Slow, "slow-1"))
    return best.select("media", "pos", "idx", F.round("duration_error", 6).alias("duration_error"), "status")


class Reader:
    """A frame reader that can't read the frames of every fifth recording."""

    def read(self, media: str, seconds: float) -> str:
        if int(media) % 5 == 4:
            raise ValueError("dark")
        return f"{media}@{seconds:.3f}"


@query(f"""WITH {SEG} SELECT media % 5 = 4 AS dark, count(*) FILTER (media % 5 <> 4) AS read, CAST(sum(n) AS BIGINT) AS frames FROM (SELECT media, pos, len(list_distinct(list_transform([0.2, 0.5, 0.8], lambda f: round(start_ms / 1000.0 + (end_ms - start_ms) / 1000.0 * CAST(f AS DOUBLE), 3)))) AS n FROM seg) GROUP BY 1""")
def q120_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames read by a client; after failures in a row a task stops asking."""
    rows = segments(table(spark, d, "conversations"))
    wanted = clients.frames(rows.select("media", "pos", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))).withColumn("pos", F.col("pos").cast("long"))
    dark = F.col("media").cast("long") % 5 == 4
    none = spark.createDataFrame([], "media string, pos long, at double, text string, error string")
    got = durable(clients.read_frames(wanted.where(~dark), none, Reader), "frames")
    both = clients.read_frames(wanted, got, Reader)
    right = F.col("text") == F.format_string("%s@%.3f", "media", "at")
    return both.groupBy(dark.alias("dark")).agg(F.count_distinct(F.when(right, F.struct("media", "pos"))).alias("read"), F.count(F.lit(1)).alias("frames"))


MOOD = "CASE label WHEN 'anger' THEN 'angry' WHEN 'happiness' THEN 'happy' WHEN 'surprise' THEN 'surprised' WHEN 'happy/sad' THEN 'sad' ELSE 'neutral' END"


@query(f"""WITH {EMO} SELECT CAST(media || '-' || pos AS VARCHAR) AS id, text, {MOOD} AS emotion, greatest(0, start_ms) AS offset_ms, -6.0 AS background_db FROM emo""")
def q121_written_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments checked, written and read again, and where their clips go."""
    rows = emotions(table(spark, d, "conversations"))
    ident = F.concat_ws("-", F.col("media").cast("string"), F.col("pos").cast("string")).alias("id")
    kept = rows.select(ident, "text", "speaker", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.lit("en").alias("source_lang"), F.lit("zh").alias("target_lang"), policy.emotion_label(F.col("label")).alias("emotion"), F.lit("f5tts").alias("tts_engine"))
    path = new_path(spark, "segments")
    writers.save_segments(kept, path)
    clips = writers.mix_plan(rows.select(ident.alias("segment_id"), F.lit("x.wav").alias("file"), "start_ms"))
    return spark.read.schema(kept.schema).json(path).join(clips.withColumnRenamed("segment_id", "id"), "id").select("id", "text", "emotion", "offset_ms", "background_db")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' cd' WHEN 1 THEN 'b|f' ELSE '' END AS gone, CASE doc_id % 3 WHEN 0 THEN ', cat' WHEN 1 THEN 'dog' ELSE '' END AS unique_window, CASE doc_id % 2 WHEN 0 THEN 1.0 ELSE 0.0 END AS similarity FROM documents""")
def q122_alignment_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a replacement lacks, the smallest window that stands once, and likeness."""
    i = F.col("doc_id")
    gone = unicode.deletions(F.when(i % 3 == 0, "ab cd").when(i % 3 == 1, "abcdef").otherwise("same"), F.when(i % 3 == 0, "ab").when(i % 3 == 1, "acde").otherwise("same"))
    said = F.when(i % 3 == 0, "cat ran, cat sat, the sat").when(i % 3 == 1, "a dog ran").otherwise("x x")
    window = unicode.unique_window(said, F.when(i % 3 == 0, 9).when(i % 3 == 1, 2).otherwise(0), F.when(i % 3 == 0, 12).when(i % 3 == 1, 5).otherwise(3))
    rows = table(spark, d, "documents").select("doc_id", gone.alias("g"), said.alias("said"), window.alias("w"), unicode.similarity(F.lit("Same words!"), F.when(i % 2 == 0, "same WORDS").otherwise("zzz")).alias("similarity"))
    cut = F.substring("said", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    return rows.select("doc_id", F.array_join("g", "|").alias("gone"), F.when(i % 3 == 2, "").otherwise(cut).alias("unique_window"), F.round("similarity", 6).alias("similarity"))


@query("""SELECT doc_id, part, speaker, said FROM (SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN [0, 1] WHEN 1 THEN [0] ELSE [0, 1] END) AS part, unnest(CASE doc_id % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A'] ELSE ['A', 'B'] END) AS speaker, unnest(CASE doc_id % 3 WHEN 0 THEN ['So we go.', 'Now you do'] WHEN 1 THEN ['So we go. Now you do'] ELSE ['So we go.', 'Now you do'] END) AS said FROM documents)""")
def q123_turns(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut where their words change speaker, after changes went to sentence ends or to a sentence's main speaker."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i)
    rows = docs.select(i.alias("media"), F.lit(0).cast("long").alias("pos"), F.lit("So we go. Now you do").alias("text"), F.lit(0).cast("long").alias("start_ms"), F.lit(1200).cast("long").alias("end_ms"))
    # Speakers of the six words: a change in mid-sentence, none, and one word of another speaker in the first sentence.
    who = F.when(i % 3 == 0, F.lit("AABBBB")).when(i % 3 == 1, F.lit("AAAAAA")).otherwise(F.lit("ABABBB"))
    words = F.array(*map(F.lit, ("So", "we", "go.", "Now", "you", "do")))
    spoken = docs.select(i.alias("media"), F.lit(0).cast("long").alias("pos"), who.alias("who"), F.posexplode(words).alias("word", "said"))
    at = (F.col("word") * 200).cast("long")
    spoken = spoken.select("media", "pos", "word", "said", at.alias("start_ms"), (at + 190).alias("end_ms"), F.substring("who", F.col("word") + 1, F.lit(1)).alias("speaker"))
    cut = turns.split_segments(rows, spoken, sentences=True)
    return cut.select(F.col("media").alias("doc_id"), "part", "speaker", F.col("text").alias("said"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1.5 WHEN 3 THEN 2.0 ELSE 0.0 END AS number, doc_id % 4 IN (1, 3) AS yes, doc_id % 3 = 0 AS within, 'a b' AS bare, doc_id % 5 = 0 AS done FROM documents""")
def q124_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Lenient casts, subsets, trimmed white space of any script, and rows that are done."""
    i = F.col("doc_id")
    number = policy.lenient_double(F.when(i % 4 == 0, "1.5").when(i % 4 == 1, "x").when(i % 4 == 2, "").otherwise(" 2 "))
    yes = policy.truthy(F.when(i % 4 == 0, "no").when(i % 4 == 1, " TRUE ").when(i % 4 == 2, F.lit(None)).otherwise("1"))
    within = text.is_subset(F.when(i % 3 == 0, F.array(F.lit("L2"), F.lit("L1"))).otherwise(F.array(F.lit("L1"), F.lit("L9"))), F.array(F.lit("L1"), F.lit("L2"), F.lit("L3")))
    bare = policy.strip(F.lit("　 a b \n\t"))
    done = stages.has_emotion(F.when(i % 5 != 1, "success").otherwise("failed"), F.when(i % 5 != 2, F.when(i % 5 == 3, "").otherwise("sad")), F.when(i % 5 != 4, 0.5))
    return table(spark, d, "documents").select("doc_id", number.alias("number"), yes.alias("yes"), within.alias("within"), bare.alias("bare"), done.alias("done"))


@query("""SELECT 'm' || doc_id || '-00000' || (100 + doc_id % 50) || '-00000' || (900 + doc_id % 50) || ' m' || doc_id || ' 0.' || (100 + doc_id % 50) || ' 0.' || (900 + doc_id % 50) AS value, 64 AS digits FROM documents""")
def q125_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Lines that speaker programs read, bound to the code that writes them."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.concat(F.lit("m"), i.cast("string")).alias("media"), (F.lit(100) + i % 50).alias("start_ms"), (F.lit(900) + i % 50).alias("end_ms"))
    bound = incremental.implementation_digest(writers)
    return writers.segment_list(rows).withColumn("digits", F.when(F.lit(bound).rlike("^[0-9a-f]{64}$"), F.length(F.lit(bound))))


def by_sign(x: np.ndarray) -> np.ndarray:
    """A clusterer that goes by the sign of the first component."""
    return (x[:, 0] > 0).astype(int)


@query("""SELECT label AS utt, vec_id AS key, CAST(embedding[1] > 0 AS INTEGER) AS cluster, 'sign' AS method FROM embeddings
UNION ALL SELECT CAST(doc_id AS INTEGER), k, CASE WHEN k < 2 THEN 0 ELSE 1 END, 'linkage' FROM documents, (VALUES (0), (1), (2)) AS v(k)""")
def q126_clusterers(spark: SparkSession, d: str) -> DataFrame:
    """Vectors grouped by another clusterer, and by average linkage where the groups are plain."""
    signs = clustering.cluster(vectors(table(spark, d, "embeddings")), by_sign).withColumn("method", F.lit("sign"))
    made = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("utt"), F.posexplode(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 0.0), (0.99, 0.1), (0.0, 1.0))))).alias("key", "vector"))
    return signs.unionByName(clustering.cluster(made.withColumn("key", F.col("key").cast("long"))).withColumn("method", F.lit("linkage")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, CASE k WHEN 0 THEN 'hause' WHEN 1 THEN 'x' WHEN 2 THEN 'and' ELSE 'hause' END AS original, CASE k WHEN 1 THEN 'y' WHEN 2 THEN 'then' ELSE 'house' END AS replacement, CASE k WHEN 0 THEN 'classifiable' WHEN 3 THEN 'over_capacity' ELSE 'diagnostic_only' END AS status,
CASE k WHEN 1 THEN 'one_sided' WHEN 2 THEN 'one_sided' ELSE 'two_sided' END AS alignment, CASE k WHEN 0 THEN 'L01,L02' ELSE 'L01' END AS lines, CASE k WHEN 1 THEN 'weak_one_sided_anchor' WHEN 2 THEN 'relocated_existing_text' ELSE '' END AS reasons FROM (SELECT doc_id, doc_id % 4 AS k FROM documents)""")
def q127_inventories(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of requests whose gaps are known: merged lines, weak anchors, moved text and capacity."""
    i = F.col("doc_id")
    line = lambda k, said: F.struct(F.lit(f"L0{k}").alias("line_id"), said.alias("text"))
    heard = F.when(i % 4 == 1, "a b x").when(i % 4 == 2, "so it goes and then it goes").otherwise("we like the red hause on the hill")
    house = F.lit("we like the red house on the hill")
    lines = F.when(i % 4 == 0, F.array(line(2, house), line(1, house))).when(i % 4 == 1, F.array(line(1, F.lit("a b y")))).when(i % 4 == 2, F.array(line(1, F.lit("so it goes then")))).otherwise(F.array(line(1, house), line(2, F.repeat(F.lit("z"), F.lit(25_000)))))
    found = alignment.inventory(table(spark, d, "documents").select(i.cast("string").alias("id"), heard.alias("heard"), lines.alias("lines")))
    return found.select("id", "original", "replacement", "status", "alignment", F.array_join("lines", ",").alias("lines"), F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT doc_id AS media, k AS rank, 'L0' || k AS line_id, CASE k WHEN 1 THEN 'same words' ELSE 'zzz' END AS line, CASE k WHEN 1 THEN 1.0 ELSE 0.0 END AS lexical, CASE k WHEN 1 THEN 'lexical' ELSE 'subtitle_candidate' END AS selection FROM documents, (VALUES (1), (2)) AS v(k)""")
def q128_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines whose likeness is known: noise and repeated lines go."""
    said = F.array(*map(F.lit, ("http://x.org", "zzz", "same words", "SAME  words", "12:30")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("media"), F.lit("Same words!").alias("heard"), F.posexplode(said).alias("pos", "line"))
    return select.evidence(rows).select("media", "rank", "line_id", "line", "lexical", "selection")


@query("""SELECT doc_id AS media, k AS id, CASE k WHEN 0 THEN 'A' ELSE 'B' END AS speaker, CASE k WHEN 0 THEN 'So we go.' ELSE 'Now you do' END AS text, CASE k WHEN 0 THEN 0 ELSE 595 END AS start_ms, CASE k WHEN 0 THEN 595 ELSE 1190 END AS end_ms FROM documents, (VALUES (0), (1)) AS v(k)""")
def q129_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The whole assignment where it is known: words to spans, changes to the sentence's end, parts to speakers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("media"))
    long = lambda x: F.lit(x).cast("long")
    rows = docs.select("media", long(0).alias("pos"), F.lit("So we go. Now you do").alias("text"), long(0).alias("start_ms"), long(1190).alias("end_ms"))
    words = docs.select("media", long(0).alias("pos"), F.posexplode(F.array(*map(F.lit, ("So", "we", "go.", "Now", "you", "do")))).alias("word", "said"))
    words = words.withColumn("start_ms", (F.col("word") * 200).cast("long")).withColumn("end_ms", F.col("start_ms") + 190)
    spans = docs.select("media", F.posexplode(F.array(F.lit("A"), F.lit("B"))).alias("pos", "speaker")).select("media", F.col("pos").cast("long").alias("pos"), "speaker", F.when(F.col("pos") == 0, long(0)).otherwise(long(395)).alias("start_ms"), F.when(F.col("pos") == 0, long(395)).otherwise(long(1190)).alias("end_ms"))
    return turns.assign_speakers(rows, words, spans).select("media", "id", "speaker", "text", "start_ms", "end_ms")
