"""Queries over texts: routing, noise, scripts, similarity, guards, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.adapters import EVAL, LINE, evaluation, lines, table
from marlstone.functions import guards, policy, text, unicode
from marlstone.operators import alignment, evaluate, select, sequence
from marlstone.plans.registry import query

#: The word pattern as SQL text, in which an apostrophe is written twice.
WORDS = policy.WORD.replace("'", "''")
COUNTS = f"""
  len(regexp_extract_all(t, '{WORDS}')) AS words,
  CASE WHEN t = '' THEN 0 ELSE len(regexp_extract_all(t, '{policy.CLAUSE}')) + 1 END AS clauses"""
SHORT = "regexp_extract(text, '^[^.]*', 0)"
STRIP = r"regexp_replace(regexp_replace(X, '^[\s\x{85}\x{A0}\x{2028}\x{2029}]+', ''), '[\s\x{85}\x{A0}\x{2028}\x{2029}]+$', '')"


@query(f"""
SELECT lang, engine, form, count(*) AS n FROM (
  SELECT lang, form, CASE WHEN lang NOT IN ('zh', 'en') THEN 'omnivoice' WHEN words >= 20 OR clauses >= 3 THEN 'confucius4' ELSE 'f5tts' END AS engine
  FROM (SELECT lang, form, {COUNTS} FROM (SELECT lang, 'whole' AS form, {STRIP.replace('X', 'text', 1)} AS t FROM documents UNION ALL SELECT lang, 'first', {STRIP.replace('X', SHORT, 1)} FROM documents)))
GROUP BY ALL""")
def q01_route_counts(spark: SparkSession, d: str) -> DataFrame:
    """Engines by language, for whole texts and for their first sentences."""
    docs = table(spark, d, "documents")
    both = docs.select("lang", F.lit("whole").alias("form"), "text").unionByName(docs.select("lang", F.lit("first").alias("form"), F.regexp_extract("text", "^[^.]*", 0).alias("text")))
    routed = both.select("lang", "form", policy.route(F.col("lang"), F.lit("neutral"), F.col("text")).alias("engine"))
    return routed.groupBy("lang", "engine", "form").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT lang, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, max(clauses) AS most_clauses, count(*) FILTER (clauses >= 3) AS n_complex, count(*) FILTER (lang = 'en' AND words >= 20) AS n_long
FROM (SELECT lang, {COUNTS} FROM (SELECT lang, {STRIP.replace('X', 'text', 1)} AS t FROM documents)) GROUP BY lang""")
def q02_complexity_profile(spark: SparkSession, d: str) -> DataFrame:
    """Complexity of texts by language."""
    c = table(spark, d, "documents").select("lang", policy.complexity(F.col("text"), F.col("lang")).alias("c"))
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("c.words").alias("words"), F.max("c.clause_count").alias("most_clauses"), F.count_if("c.is_complex").alias("n_complex"), F.count_if("c.is_long").alias("n_long"))


@query("""
SELECT lang, mood, CASE WHEN lang = 'zh' THEN 'cosyvoice3' WHEN lang = 'en' THEN CASE WHEN mood IN ('Neutral ', '') OR mood IS NULL THEN 'confucius4' ELSE 'cosyvoice3' END ELSE 'omnivoice' END AS engine, count(*) AS n
FROM (SELECT CASE doc_id % 7 WHEN 0 THEN 'zh' ELSE lang END AS lang, CASE doc_id % 4 WHEN 0 THEN 'Neutral ' WHEN 1 THEN 'happy' WHEN 2 THEN '' END AS mood FROM documents) GROUP BY ALL""")
def q03_legacy_route(spark: SparkSession, d: str) -> DataFrame:
    """The earlier two-level routing."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.when(i % 7 == 0, "zh").otherwise(F.col("lang")).alias("lang"), F.when(i % 4 == 0, "Neutral ").when(i % 4 == 1, "happy").when(i % 4 == 2, "").alias("mood"))
    name = F.when(F.col("lang") == "zh", "Mandarin").when(F.col("lang") == "en", "en_US").otherwise(F.col("lang"))
    return rows.withColumn("engine", policy.legacy_route(name, F.col("mood"))).groupBy("lang", "mood", "engine").agg(F.count(F.lit(1)).alias("n"))


NOISE = r"""CASE WHEN c = '' THEN 'empty' WHEN regexp_matches(line, '(?i)(?:https?://|www\.)\S') THEN 'url'
  WHEN regexp_matches(c, '^[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]?$') THEN 'timecode' WHEN regexp_matches(c, '^\d+(?:[.,]\d+)?$') THEN 'pure_number'
  WHEN NOT regexp_matches(c, '[\pL\pN]') THEN 'pure_symbol' ELSE '' END"""
COMPACT = r"regexp_replace(line, '[\s\x{85}\x{A0}\x{2028}\x{2029}]+', '', 'g')"


@query(f"WITH {LINE} SELECT reason, count(*) AS n FROM (SELECT {NOISE} AS reason FROM (SELECT line, {COMPACT} AS c FROM line)) GROUP BY reason")
def q08_line_noise(spark: SparkSession, d: str) -> DataFrame:
    """Why lines of pages are no text."""
    return lines(table(spark, d, "pages")).groupBy(text.noise_reason(F.col("line")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINE} SELECT media, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY media, lower(c) ORDER BY pos) AS k FROM (SELECT *, {COMPACT} AS c FROM line)) WHERE k = 1 AND c <> ''""")
def q09_line_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first of each page's lines that are alike but for case and white space."""
    rows = lines(table(spark, d, "pages")).withColumn("c", F.lower(text.compact(F.col("line")))).where("c <> ''")
    return select.first_per_key(rows, ["media"], F.col("c"), ["pos"]).select("media", "pos", "line")


SUBTITLE = r"""round(least(1.0, 0.65 * len(regexp_extract_all(c, '[\pL\pN]')) / greatest(length(c), 1) + 0.35 * CASE WHEN length(c) BETWEEN 4 AND 80 THEN 1.0 WHEN length(c) BETWEEN 2 AND 140 THEN 0.65 ELSE 0.25 END + CASE WHEN regexp_matches(line, '[!?.,]') THEN 0.1 ELSE 0.0 END), 6)"""


@query(f"""WITH {LINE}, s AS (SELECT media, pos, line, CAST({SUBTITLE} AS DOUBLE) AS score FROM (SELECT *, {COMPACT} AS c FROM line) WHERE c <> '')
SELECT media, pos, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY score DESC, pos) AS k FROM s) WHERE k <= 5""")
def q10_subtitle_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most subtitle-like lines of each page."""
    rows = lines(table(spark, d, "pages")).where(text.compact(F.col("line")) != "").withColumn("score", F.round(text.subtitle_score(F.col("line")), 6))
    w = Window.partitionBy("media").orderBy(F.col("score").desc(), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("media", "pos", "score", "rank")


@query(f"""WITH {LINE}, s AS (SELECT media, pos, line, row_number() OVER w AS rank, CAST(sum(length(line) + CASE WHEN first THEN 0 ELSE 1 END) OVER w AS BIGINT) AS used_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY length(line) DESC, pos) = 1 AS first FROM (SELECT * FROM line WHERE line <> '')) WINDOW w AS (PARTITION BY media ORDER BY length(line) DESC, pos))
SELECT media, pos, rank, used_chars, CASE WHEN rank = 1 THEN substr(line, 1, 900) ELSE line END AS line FROM s WHERE rank = 1 OR used_chars <= 900""")
def q11_char_budget(spark: SparkSession, d: str) -> DataFrame:
    """The longest lines of each page within 900 characters."""
    rows = lines(table(spark, d, "pages")).where("line <> ''")
    return sequence.budget_prefix(rows, [F.length("line").desc(), F.col("pos")], 900).select("media", "pos", "rank", "used_chars", "line")


@query("""
WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(2, length(t))), lambda i: substr(t, i, 2))) AS grams FROM (SELECT item_id, lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS t FROM benchmark))
SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.grams, b.grams)) AS shared, round(len(list_intersect(a.grams, b.grams)) / len(list_distinct(list_concat(a.grams, b.grams))), 6) AS jaccard
FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def q12_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Character bigrams of neighbouring benchmark items."""
    t = F.lower(F.regexp_replace("text", "[^A-Za-z ]", ""))
    g = table(spark, d, "benchmark").select("item_id", text.ngrams(t).alias("grams"))
    b = g.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("grams").alias("h"))
    pairs = g.withColumnRenamed("item_id", "a").join(b, "a")
    return pairs.select("a", "b", F.size(F.array_intersect("grams", "h")).cast("long").alias("shared"), F.round(text.jaccard(F.col("grams"), F.col("h")), 6).alias("jaccard"))


@query(f"""WITH {EVAL} SELECT id, levenshtein(reference, baseline) AS edits, round(levenshtein(reference, baseline) / greatest(length(reference), 1), 6) AS ratio FROM eval""")
def q13_edit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance of ASCII texts and their hypotheses."""
    rows = evaluation(table(spark, d, "documents")).withColumn("edits", text.edit_distance(F.col("reference"), F.col("baseline")))
    return rows.select("id", F.col("edits").cast("long").alias("edits"), F.round(F.col("edits") / F.greatest(F.length("reference"), F.lit(1)), 6).alias("ratio"))


CER = """rated AS (
  SELECT *, corrected_cer - baseline_cer AS cer_delta FROM (
    SELECT *, levenshtein(k, kb) / greatest(length(k), 1) AS baseline_cer, levenshtein(k, kc) / greatest(length(k), 1) AS corrected_cer
    FROM (SELECT *, regexp_replace(lower(reference), '[^a-z0-9$+<=>^`|~]', '', 'g') AS k, regexp_replace(lower(baseline), '[^a-z0-9$+<=>^`|~]', '', 'g') AS kb, regexp_replace(lower(corrected), '[^a-z0-9$+<=>^`|~]', '', 'g') AS kc FROM eval)))"""
REPORT = """count(*) AS samples, count(*) FILTER (accepted) AS accepted_changes, count(*) FILTER (cer_delta < -1e-9) AS improved, count(*) FILTER (cer_delta > 1e-9) AS worsened,
  count(*) - count(*) FILTER (cer_delta < -1e-9) - count(*) FILTER (cer_delta > 1e-9) AS unchanged,
  count(*) FILTER (accepted AND baseline_cer <= 1e-9 AND corrected_cer > 1e-9) AS false_corrections, round(avg(baseline_cer), 6) AS baseline_cer, round(avg(corrected_cer), 6) AS corrected_cer, round(avg(corrected_cer) - avg(baseline_cer), 6) AS cer_delta"""


def rated(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows with rates; a correction counts as accepted if it changed the text."""
    return evaluate.character_rates(evaluation(table(spark, d, "documents"))).withColumn("accepted", F.col("corrected") != F.col("baseline"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("baseline_cer", "corrected_cer", "cer_delta")})


@query(f"WITH {EVAL}, {CER} SELECT id, round(baseline_cer, 6) AS baseline_cer, round(corrected_cer, 6) AS corrected_cer, round(cer_delta, 6) AS cer_delta FROM rated")
def q14_cer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Character error rates of rows."""
    return rounded(rated(spark, d)).select("id", "baseline_cer", "corrected_cer", "cer_delta")


@query()
def q14_wer_rows(spark: SparkSession, d: str) -> DataFrame:
    """Word and character error rates by tokens, any script."""
    rows = evaluation(table(spark, d, "documents")).withColumn("r", unicode.error_rates("reference", "corrected"))
    return rows.select("id", F.round("r.wer", 6).alias("wer"), F.round("r.cer", 6).alias("cer"))


@query(f"WITH {EVAL}, {CER} SELECT {REPORT} FROM (SELECT *, corrected <> baseline AS accepted FROM rated)")
def q15_eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """The overall report."""
    return rounded(evaluate.summarize(rated(spark, d)))


@query(f"""WITH {EVAL}, {CER}, m AS (SELECT *, corrected <> baseline AS accepted, 'm' || (id % 2) AS model, CASE WHEN id % 11 = 0 THEN '' ELSE lang END AS language FROM rated)
SELECT model, CASE WHEN grouping(l) = 1 THEN 'all' ELSE l END AS scope, {REPORT} FROM (SELECT *, CASE WHEN coalesce(language, '') = '' THEN 'unknown' ELSE language END AS l FROM m) GROUP BY GROUPING SETS ((model), (model, l))""")
def q16_eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Reports by model, and by model and language."""
    rows = rated(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("id") % 2).cast("string"))).withColumn("language", F.when(F.col("id") % 11 == 0, "").otherwise(F.col("lang")))
    return rounded(evaluate.summary_sets(rows, "model", "language"))


@query(f"""WITH {EVAL}, {CER}, m AS (SELECT *, corrected <> baseline AS accepted, id % 4 + 1 AS fold, CASE id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'safety_negative' ELSE 'no_opportunity' END AS opportunity FROM rated),
f AS (SELECT count(*) FILTER (d < -1e-12) AS improving_folds FROM (SELECT avg(corrected_cer) - avg(baseline_cer) AS d FROM m GROUP BY fold)),
w AS (SELECT avg(corrected_cer) <= 0.2 + 1e-12 AS cer_not_above_ceiling, coalesce(avg(cer_delta) FILTER (opportunity = 'strong') < -1e-12, false) AS strong_improves,
  count(*) FILTER (accepted AND baseline_cer <= 1e-9 AND corrected_cer > 1e-9 AND opportunity = 'safety_negative') = 0 AS safety_false_zero,
  count(*) FILTER (accepted AND baseline_cer <= 1e-9 AND corrected_cer > 1e-9 AND opportunity = 'no_opportunity') = 0 AS none_false_zero,
  count(*) FILTER (accepted AND baseline_cer <= 1e-9 AND corrected_cer > 1e-9 AND opportunity <> 'strong') = 0 AS negative_false_zero,
  count(*) FILTER (cer_delta > 1e-9) * 2 <= count(*) FILTER (cer_delta < -1e-9) AS worse_le_half_better FROM m)
SELECT w.*, improving_folds >= 3 AS folds_improve, improving_folds,
  cer_not_above_ceiling AND strong_improves AND safety_false_zero AND none_false_zero AND negative_false_zero AND worse_le_half_better AND improving_folds >= 3 AS pass FROM w, f""")
def q17_gates(spark: SparkSession, d: str) -> DataFrame:
    """Named acceptance gates over grouped rates."""
    i = F.col("id")
    rows = rated(spark, d).withColumn("fold", i % 4 + 1).withColumn("opportunity", F.when(i % 3 == 0, "strong").when(i % 3 == 1, "safety_negative").otherwise("no_opportunity"))
    return evaluate.gates(rows, 0.2)


PROPOSAL = r"""p AS (SELECT id, baseline AS heard, CASE WHEN id % 10 = 3 THEN '' WHEN id % 10 = 4 THEN baseline || ' 42' WHEN id % 10 = 5 THEN upper(baseline) WHEN id % 10 = 6 THEN baseline || baseline ELSE corrected END AS proposed,
  id % 9 <> 0 AS changed, (60 + id % 41) / 100.0 AS confidence, CASE id % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'translated_subtitle' WHEN 2 THEN 'proper_noun_or_title' ELSE 'subtitle' END AS role, CASE WHEN id % 8 = 0 THEN [] WHEN id % 8 = 1 THEN ['L09'] ELSE ['L01', 'L02'] END AS evidence FROM eval),
k AS (SELECT *, regexp_replace(lower(heard), '[^a-z0-9]', '', 'g') AS hk, regexp_replace(lower(proposed), '[^a-z0-9]', '', 'g') AS pk, list_sort(list_filter(list_distinct(regexp_extract_all(proposed, '\d+(?:[.:/-]\d+)*')), lambda x: NOT list_contains(regexp_extract_all(heard, '\d+(?:[.:/-]\d+)*'), x))) AS new FROM p),
r AS (SELECT *, levenshtein(hk, pk) / greatest(length(hk), 1) AS ratio, CASE WHEN role = 'translated_subtitle' THEN 0.25 WHEN role = 'proper_noun_or_title' AND confidence >= 0.95 THEN 0.6 ELSE 0.45 END AS lim FROM k),
g AS (SELECT id, role, CASE WHEN NOT changed THEN 'model_changed_false' WHEN trim(proposed) = '' THEN 'empty_proposal' WHEN confidence < 0.85 THEN 'confidence_below_0.85'
  WHEN len(evidence) = 0 OR list_contains(evidence, 'L09') THEN 'missing_or_invalid_evidence' WHEN role = 'uncertain' THEN 'unsafe_evidence_role:uncertain' WHEN len(new) > 0 THEN 'introduced_digits:' || array_to_string(new, ',')
  WHEN hk = pk THEN 'punctuation_or_case_only' WHEN length(heard) >= 20 AND length(proposed) > length(heard) * 1.45 THEN 'over_expansion' WHEN ratio > lim THEN 'edit_ratio' ELSE 'accepted' END AS reason FROM r)"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposed corrections of evaluation rows that break each rule somewhere."""
    i, e = F.col("id"), evaluation(table(spark, d, "documents"))
    base, key = F.col("baseline"), lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    proposed = F.when(i % 10 == 3, "").when(i % 10 == 4, F.concat(base, F.lit(" 42"))).when(i % 10 == 5, F.upper(base)).when(i % 10 == 6, F.concat(base, base)).otherwise(F.col("corrected"))
    names = F.when(i % 8 == 0, F.array().cast("array<string>")).when(i % 8 == 1, F.array(F.lit("L09"))).otherwise(F.array(F.lit("L01"), F.lit("L02")))
    role = F.when(i % 5 == 0, "uncertain").when(i % 5 == 1, "translated_subtitle").when(i % 5 == 2, "proper_noun_or_title").otherwise("subtitle")
    rows = e.select("id", base.alias("heard"), proposed.alias("proposed"), (i % 9 != 0).alias("changed"), ((i % 41 + 60) / 100.0).alias("confidence"), role.alias("role"), names.alias("evidence"))
    known = F.array(F.lit("L01"), F.lit("L02"), F.lit("L03"))
    return rows.withColumn("reason", guards.proposal_reason(F.col("heard"), F.col("proposed"), key("heard"), key("proposed"), F.col("changed"), F.col("confidence"), F.col("role"), F.col("evidence"), known))


@query(f"WITH {EVAL}, {PROPOSAL} SELECT id, reason, reason = 'accepted' AS accepted FROM g")
def q18_guard_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules on proposed corrections."""
    reason = F.when(F.col("reason").startswith("edit_ratio_"), "edit_ratio").otherwise(F.col("reason"))
    return proposals(spark, d).select("id", reason.alias("reason"), (F.col("reason") == "accepted").alias("accepted"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+(?:[.:/-]\d+)*'))) AS numbers, len(list_filter(list_distinct(regexp_extract_all(text, '\d+(?:[.:/-]\d+)*')), lambda x: NOT list_contains(regexp_extract_all(substr(text, 1, 2000), '\d+(?:[.:/-]\d+)*'), x))) AS later FROM documents""")
def q19_digits_introduced(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a text, and those that its first 2,000 characters lack."""
    new = F.array_except(text.digit_tokens(F.col("text")), text.digit_tokens(F.substring("text", 1, 2000)))
    return table(spark, d, "documents").select("doc_id", F.size(text.digit_tokens(F.col("text"))).cast("long").alias("numbers"), F.size(new).cast("long").alias("later"))


@query(r"""SELECT target, error, count(*) AS n FROM (
  SELECT target, CASE WHEN NOT regexp_matches(text, '[\pL\pN]') THEN 'empty_or_nonlinguistic_text' WHEN target = 'zh' THEN 'target_zh_missing_or_not_mainly_chinese' WHEN target = 'ja' THEN 'target_ja_missing_script'
    WHEN target = 'fr' AND NOT regexp_matches(text, '[A-Za-z]') THEN 'target_fr_invalid_script' WHEN target = 'en' AND NOT regexp_matches(text, '[A-Za-z]') THEN 'target_en_contains_source_script_or_no_english' END AS error
  FROM (SELECT text, CASE doc_id % 4 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' WHEN 2 THEN 'fr' ELSE 'en' END AS target FROM documents)) GROUP BY ALL""")
def q20_script_validation(spark: SparkSession, d: str) -> DataFrame:
    """Script checks against four target languages."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("text", F.when(i % 4 == 0, "zh").when(i % 4 == 1, "ja").when(i % 4 == 2, "fr").otherwise("en").alias("target"))
    return rows.groupBy("target", text.script_error(F.col("text"), F.col("target")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT conv_id, turn, list_filter([trim(text), '', trim(substr(text, 1, 60)), trim(text), trim(substr(text, 1, 25)), trim(substr(text, 1, 90))], lambda x: x <> '') AS raw FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)),
u AS (SELECT conv_id, turn, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS cands FROM c),
e AS (SELECT conv_id, turn, unnest(range(len(cands))) AS idx, unnest(cands) AS text, CAST(2.0 + turn % 3 AS DOUBLE) AS target FROM u),
m AS (SELECT *, CASE WHEN (conv_id + idx) % 3 = 0 OR conv_id % 5 = 0 THEN NULL ELSE length(text) / 15.0 END AS measured FROM e),
a AS (SELECT *, coalesce(measured, greatest(0.15, len(regexp_extract_all(text, '[A-Za-z]+')) / 2.5)) AS actual, max(CASE WHEN measured IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn) AS ok FROM m)
SELECT conv_id AS media, turn AS pos, CAST(idx AS BIGINT) AS idx, round(abs(actual - target), 6) AS duration_error, CASE WHEN ok = 1 THEN 'success' ELSE 'fallback' END AS status
FROM a WHERE measured IS NOT NULL OR ok = 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(actual - target), idx) = 1""")
def q42_candidate_pick(spark: SparkSession, d: str) -> DataFrame:
    """Candidates made distinct, and the one whose duration is nearest."""
    raw = F.array(F.col("text"), F.lit(""), F.substring("text", 1, 60), F.col("text"), F.substring("text", 1, 25), F.substring("text", 1, 90))
    said = table(spark, d, "conversations").withColumn("text", F.translate("text", "\n", " "))
    rows = said.select(F.col("conv_id").alias("media"), F.col("turn").alias("pos"), F.posexplode(text.candidates(raw, F.lit(""))).alias("idx", "text"))
    failed = ((F.col("media") + F.col("idx")) % 3 == 0) | (F.col("media") % 5 == 0)
    rows = rows.withColumn("target", F.lit(2.0) + F.col("pos") % 3).withColumn("measured", F.when(failed, F.lit(None)).otherwise(F.length("text") / 15.0))
    best = select.closest_duration(rows)
    return best.select("media", "pos", F.col("idx").cast("long").alias("idx"), F.round("duration_error", 6).alias("duration_error"), "status")


@query("""
WITH o AS (SELECT conv_id, turn, length(text) AS n, list_filter([trim(substr(text, 1, 20)), trim(substr(text, 1, 45)), trim(substr(text, 1, 70))], lambda x: x <> trim(substr(text, 1, 45)) OR turn % 2 = 0) AS opts FROM conversations),
e AS (SELECT conv_id, turn, n, unnest(range(len(opts))) AS i, unnest(opts) AS t FROM o)
SELECT conv_id, turn, length(t) AS picked FROM e QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(length(t) - n * 2.0 / 3.0), i) = 1""")
def q43_retry_pick(spark: SparkSession, d: str) -> DataFrame:
    """The unused candidate whose length fits best for another try."""
    opts = F.array(*(F.trim(F.substring("text", 1, n)) for n in (20, 45, 70)))
    opts = F.filter(opts, lambda x: (x != F.trim(F.substring("text", 1, 45))) | (F.col("turn") % 2 == 0))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.closest_by_length(opts, F.length("text") * 2.0 / 3.0).alias("t"))
    return rows.where("t IS NOT NULL").select("conv_id", "turn", F.length("t").cast("long").alias("picked"))


@query("""
SELECT planned, engine, count(*) AS n FROM (
  SELECT planned, CASE planned WHEN 'confucius4' THEN CASE WHEN used = 0 THEN 'f5tts' WHEN used = 1 THEN 'indextts2' END WHEN 'cosyvoice3' THEN CASE WHEN used = 0 THEN 'f5tts' END WHEN 'indextts2' THEN CASE WHEN used = 0 THEN 'f5tts' END WHEN 'f5tts' THEN 'cosyvoice3' END AS engine
  FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'f5tts' WHEN 1 THEN 'indextts2' WHEN 2 THEN 'cosyvoice3' WHEN 3 THEN 'confucius4' ELSE 'omnivoice' END AS planned, doc_id % 3 AS used FROM documents)) GROUP BY ALL""")
def q44_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """The next engine after planned ones and those tried."""
    i = F.col("doc_id")
    planned = F.element_at(F.array(*map(F.lit, policy.ENGINES)), (i % 5 + 1).cast("int"))
    tried = F.when(i % 3 == 0, F.array(F.col("planned"))).when(i % 3 == 1, F.array(F.col("planned"), F.lit("f5tts"))).otherwise(F.array(F.col("planned"), F.lit("f5tts"), F.lit("indextts2")))
    rows = table(spark, d, "documents").withColumn("planned", planned).withColumn("engine", policy.next_engine(F.col("planned"), tried))
    return rows.groupBy("planned", "engine").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT lang, min(doc_id) AS first, sum(greatest(n_chars / 15.0, 0.001)) AS s FROM documents GROUP BY lang)
SELECT lang, round(s, 3) AS seconds FROM t ORDER BY s DESC, first LIMIT 1""")
def q46_dominant_language(spark: SparkSession, d: str) -> DataFrame:
    """The language with most (estimated) speech, ties to the one seen first."""
    t = table(spark, d, "documents").groupBy("lang").agg(F.min("doc_id").alias("first"), F.sum(F.greatest(F.col("n_chars") / 15.0, F.lit(0.001))).alias("s"))
    return t.orderBy(F.col("s").desc(), "first").limit(1).select("lang", F.round("s", 3).alias("seconds"))


@query("""SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type""")
def q49_json_lenient(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects found inside fenced and padded replies."""
    i = F.col("event_id")
    reply = F.when(i % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i % 3 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    k = F.get_json_object(text.lenient_object(reply), "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("with_k"), F.sum(k.try_cast("long")).alias("total"))


@query()
def q52_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Sequence, bigram and containment similarity of neighbouring benchmark items."""
    b = table(spark, d, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(after, "item_id").select("item_id", F.round(unicode.similarity("text", "other"), 6).alias("similarity"))


@query()
def q53_alignment_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Candidate corrections from aligning hypotheses with lines, merged and checked for conflicts."""
    rows = evaluation(table(spark, d, "documents"))
    ask = rows.select(F.col("id").cast("string").alias("id"), F.col("baseline").alias("heard"), F.array(F.struct(F.lit("L01").alias("line_id"), F.col("reference").alias("text")), F.struct(F.lit("L02").alias("line_id"), F.col("corrected").alias("text"))).alias("lines"))
    return alignment.inventory(ask).select("id", "candidate_id", "start", "end", "replacement", "support", "status")


@query()
def q56_evidence_selection(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines of pages by likeness to their first line."""
    rows = lines(table(spark, d, "pages")).where("line <> ''")
    heard = rows.groupBy("media").agg(F.min(F.struct("pos", "line")).alias("h")).select("media", F.col("h.line").alias("heard"))
    return select.evidence(rows.join(heard, "media"))


@query()
def q57_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Accepted candidates spliced into texts, edits from the right."""
    rows = evaluation(table(spark, d, "documents"))
    ask = rows.select(F.col("id").cast("string").alias("id"), F.col("baseline").alias("heard"), F.array(F.struct(F.lit("L01").alias("line_id"), F.col("reference").alias("text"))).alias("lines"))
    return alignment.decide(ask, alignment.inventory(ask))


@query("""SELECT item_id, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 2) = 'an')) AS n, position('an' IN text) - 1 AS first FROM benchmark""")
def q63_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Places of a needle, overlapping ones too."""
    at = text.occurrences(F.col("text"), F.lit("an"))
    return table(spark, d, "benchmark").select("item_id", F.size(at).cast("long").alias("n"), F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(-1)).cast("long").alias("first"))


@query(f"WITH {EVAL} SELECT id, len(regexp_extract_all(baseline, '[^\\s]+')) AS words, length(baseline) - length(replace(baseline, ' ', '')) AS spaces FROM eval")
def q64_word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Word tokens of ASCII texts."""
    b = F.col("baseline")
    return evaluation(table(spark, d, "documents")).select("id", F.size(text.word_tokens(b)).cast("long").alias("words"), (F.length(b) - F.length(F.replace(b, F.lit(" "), F.lit("")))).cast("long").alias("spaces"))
