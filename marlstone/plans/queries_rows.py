"""Queries over keys: joins, coverage, duplicates, fingerprints, ledgers, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.adapters import segments, table, vectors
from marlstone.functions import policy
from marlstone.operators import clustering, incremental, select, sequence
from marlstone.plans.registry import query


@query("""SELECT doc_id, lang, quality FROM (SELECT doc_id, lang, quality, row_number() OVER (ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id)) WHERE k <= 200""")
def q21_inner_join_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in both tables in natural order, the first 200."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"))
    both = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return both.orderBy(*policy.natural_key(F.col("name"))).limit(200).select("doc_id", "lang", "quality")


@query("""SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS quality, quality IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)""")
def q22_left_default(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment with a default where there is no match."""
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), F.col("quality").isNotNull().alias("known"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q23_left_anti_missing(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are asked for and missing."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT 'last' AS policy, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT max(event_id) AS event_id FROM events GROUP BY user_id)
UNION ALL SELECT 'drop', count(*), CAST(coalesce(sum(event_id), 0) AS BIGINT) FROM (SELECT max(event_id) AS event_id FROM events GROUP BY user_id, event_type HAVING count(*) = 1)""")
def q24_duplicate_policy(spark: SparkSession, d: str) -> DataFrame:
    """Repeated keys: the last wins, or all of them go."""
    e = table(spark, d, "events").select("event_id", "user_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    last, once = select.last_wins(e.select("event_id", "user_id"), "user_id", "event_id"), select.drop_repeated(e, "key")
    total = lambda df, name: df.agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))
    return total(last, "last").unionByName(total(once, "drop"))


@query("""
WITH w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0), g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 29 = 0 GROUP BY ALL)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN g.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS problem FROM w FULL JOIN g ON w.k = g.k) WHERE problem IS NOT NULL GROUP BY problem""")
def q25_coverage_check(spark: SparkSession, d: str) -> DataFrame:
    """Missing, unknown and repeated keys of returned rows against those asked for."""
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).where("k % 13 <> 0")
    got = table(spark, d, "lineitem").where("l_linenumber = 1 OR l_orderkey % 29 = 0").select(F.col("l_orderkey").alias("k"))
    return incremental.coverage(wanted, got, "k").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT count(*) FILTER (conv_id % 4 <> 0 AND NOT (conv_id % 3 = 1 AND turn <= 2) AND turn <> 1) AS reused, count(*) FILTER (conv_id % 4 = 0 OR (conv_id % 3 = 1 AND turn <= 2) OR turn = 1) AS pending FROM conversations""")
def q47_fingerprint_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Earlier results count only where the fingerprint with both neighbours is unchanged.

    Earlier, turn 1 of every third conversation read otherwise (so turns 0 to 2 changed), a quarter of
    the conversations had no results and turn 1 had failed everywhere.
    """
    seg = segments(table(spark, d, "conversations"))
    stamp = incremental.segment_fingerprint("en", "zh", "m1")
    now = sequence.neighbours(seg).withColumn("fingerprint", stamp).select("media", "pos", "fingerprint")
    old = seg.withColumn("text", F.when((F.col("media") % 3 == 1) & (F.col("pos") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    done = sequence.neighbours(old).withColumn("fingerprint", stamp).where("media % 4 <> 0").select("media", "pos", "fingerprint", F.when(F.col("pos") == 1, "failed").otherwise("success").alias("status"))
    hit, open_rows = incremental.reuse(now, done, ["media", "pos"])
    return hit.select(F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(open_rows.select(F.lit(0).alias("r"), F.lit(1).alias("p"))).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("reused"), F.coalesce(F.sum("p"), F.lit(0)).alias("pending"))


@query("""
SELECT key, count(*) AS attempts FROM (SELECT unnest([user_id % 17, user_id % 17 + 100, event_id % 23]) AS key FROM events WHERE event_type = 'view') GROUP BY key""")
def q48_ledger_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts per key from the start events of a ledger."""
    e = table(spark, d, "events")
    ledger = e.select(F.when(F.col("event_type") == "view", "start").otherwise("response").alias("event"), F.col("event_id").alias("call"), F.array(F.col("user_id") % 17, F.col("user_id") % 17 + 100, F.col("event_id") % 23).alias("keys"))
    return incremental.attempts(ledger)


@query("""
SELECT utt, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 5) AS m FROM (SELECT label AS utt, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY utt, i""")
def q50_embedding_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each utterance, element by element."""
    means = clustering.mean_vectors(vectors(table(spark, d, "embeddings")))
    return means.select("utt", F.posexplode("mean").alias("i", "m")).select("utt", "i", F.round("m", 5).alias("m"))


@query()
def q51_agglomerative(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage clusters of each utterance's vectors."""
    return clustering.cluster(vectors(table(spark, d, "embeddings")))


@query("""
WITH o AS (SELECT o_custkey AS utt, o_orderkey AS run, CASE o_orderkey % 2 WHEN 0 THEN 'eom' ELSE 'leaf' END AS method, o_orderkey % 8 AS clusters FROM orders)
SELECT utt, run, method, clusters FROM o QUALIFY row_number() OVER (PARTITION BY utt ORDER BY CASE WHEN method = 'eom' AND clusters >= 2 THEN 0 WHEN method = 'leaf' AND clusters BETWEEN 3 AND 5 THEN 1 WHEN method = 'leaf' AND clusters >= 2 THEN 2 ELSE 3 END, clusters DESC, run) = 1""")
def q58_strategy_pick(spark: SparkSession, d: str) -> DataFrame:
    """Which clustering run an utterance uses."""
    o = table(spark, d, "orders")
    return select.pick_strategy(o.select(F.col("o_custkey").alias("utt"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 2 == 0, "eom").otherwise("leaf").alias("method"), (F.col("o_orderkey") % 8).alias("clusters")))


@query("""
SELECT count(*) AS both_sides, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS either
FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def q59_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, difference and union of ids."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    marked = a.withColumn("l", F.lit(1)).unionByName(b.withColumn("l", F.lit(2))).groupBy("doc_id").agg(F.bit_or("l").alias("m"))
    return marked.agg(F.count_if(F.col("m") == 3).alias("both_sides"), F.count_if(F.col("m") == 1).alias("only_left"), F.count(F.lit(1)).alias("either"))


@query("""
WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT o_orderkey AS id, o_orderkey % 7 AS print, o_totalprice - 1000 AS duration FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE o_orderkey % 7 END AS print, o_orderkey % 19 = 0 AS changed FROM orders),
i AS (SELECT CASE WHEN status <> 'success' OR c.id IS NULL THEN 'missing_or_unsuccessful' WHEN duration <= 0 THEN 'empty_audio' WHEN c.print <> r.print THEN 'fingerprint_mismatch' WHEN changed THEN 'checksum_mismatch' END AS issue FROM s LEFT JOIN c USING (id) LEFT JOIN r USING (id)
  UNION ALL SELECT 'clip_unknown' FROM c WHERE id NOT IN (SELECT id FROM s))
SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue""")
def q65_mix_gate(spark: SparkSession, d: str) -> DataFrame:
    """What blocks mixing: missing, empty, changed and unknown clips (F16)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice").withColumn("segment_id", F.col("k").cast("string"))
    clips = o.where("k % 11 <> 0").select("segment_id", (F.col("k") % 7).alias("fingerprint"), (F.col("o_totalprice") - 1000).alias("duration"))
    results = o.select("segment_id", F.when(F.col("k") % 13 == 0, "failed").otherwise("success").alias("status"), F.when(F.col("k") % 17 == 0, -1).otherwise(F.col("k") % 7).alias("fingerprint"), F.lit("c").alias("checksum"), F.when(F.col("k") % 19 == 0, "d").otherwise("c").alias("stored_checksum"))
    return incremental.mix_issues(o.where("k % 5 <> 0").select("segment_id"), clips, results).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label AS utt, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first FROM embeddings GROUP BY label""")
def q66_vector_groups(spark: SparkSession, d: str) -> DataFrame:
    """Vectors gathered by utterance."""
    return vectors(table(spark, d, "embeddings")).groupBy("utt").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 4).alias("first"))
