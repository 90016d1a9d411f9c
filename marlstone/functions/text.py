"""Column functions over text and small arrays: noise, scripts, n-grams, digits, occurrences, splices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import unicode
from marlstone.functions.policy import language_code, strip

# Patterns of noise lines and of record forms, and weights of the subtitle score.
WORDCHAR = r"[\p{L}\p{N}]"
URL = r"(?i)(?:https?://|www\.)\S"
TIMECODE = r"^[\[(]?(?U:\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)[\])]?$"
NUMBER = r"^(?U:\d+(?:[.,，]\d+)?)$"
DIGITS = r"(?U)(\d+(?:[.:：/\-]\d+)*)"
SENTENCE_MARK = "[。！？!?.,，]"
POINT_PAIR = r"\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*,\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)"
SUBTITLE = {"meaning": 0.65, "length": 0.35, "bonus": 0.10, "good": (4, 80), "fair": (2, 140), "fair_score": 0.65, "poor_score": 0.25}


def compact(line: Column) -> Column:
    """A line without white space."""
    return F.regexp_replace(line, r"(?U)\s+", "")


def noise_reason(line: Column) -> Column:
    """Why a line is no text: empty, url, timecode, pure_number, pure_symbol, or "" if it is text."""
    c = compact(line)
    return (
        F.when(c == "", "empty")
        .when(line.rlike(URL), "url")
        .when(c.rlike(TIMECODE), "timecode")
        .when(c.rlike(NUMBER), "pure_number")
        .when(~c.rlike(WORDCHAR), "pure_symbol")
        .otherwise("")
    )


def watermark_reason(line: Column, patterns: list[str]) -> Column:
    """external_watermark_pattern where one of the patterns is found, else "" (F02)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | line.rlike(f"(?i){p}")
    return F.when(hit, "external_watermark_pattern").otherwise("")


def subtitle_score(line: Column) -> Column:
    """How much a line looks like a subtitle, 0 to 1."""
    c = compact(line)
    n = F.length(c)
    meaning = F.regexp_count(c, F.lit(WORDCHAR)) / F.greatest(n, F.lit(1))
    k = SUBTITLE
    by_length = F.when(n.between(*k["good"]), 1.0).when(n.between(*k["fair"]), k["fair_score"]).otherwise(k["poor_score"])
    bonus = F.when(line.rlike(SENTENCE_MARK), k["bonus"]).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), k["meaning"] * meaning + k["length"] * by_length + bonus))


def script_error(text: Column, target: Column, original: Column | None = None, source: Column | None = None, allow_identity: Column | None = None) -> Column:
    """The code of what is wrong with a text in a target language, or null.

    Sameness with the original is judged on lower-case letters and digits; full case folding needs
    `marlstone.functions.unicode.match_text`.
    """
    t, lang = strip(text), language_code(target)
    han, latin = F.regexp_count(t, F.lit(r"[㐀-䶿一-鿿]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    # Scripts that a language's text must show.
    scripts = {"ja": r"[\u3040-\u30ff\u3400-\u9fff]", "ko": r"[\uac00-\ud7af]", "ru": r"[\u0400-\u04ff]", "ar": r"[\u0600-\u06ff]"}
    code = F.when(t.isNull() | ~t.rlike(WORDCHAR), "empty_or_nonlinguistic_text")
    code = code.when((lang == "zh") & ((han == 0) | (latin > F.greatest(F.lit(12), han * 4))), "target_zh_missing_or_not_mainly_chinese")
    code = code.when((lang == "en") & ((latin == 0) | (han > 0)), "target_en_contains_source_script_or_no_english")
    for name, pattern in scripts.items():
        code = code.when((lang == name) & ~t.rlike(pattern), f"target_{name}_missing_script")
    code = code.when(lang.isin("fr", "de", "es", "it", "pt") & ((latin == 0) | (han > 0)), F.concat(F.lit("target_"), lang, F.lit("_invalid_script")))
    if original is not None:
        bare = lambda x: F.regexp_replace(F.lower(x), r"(?U)[\W_]+", "")
        same = (F.coalesce(original, F.lit("")) != "") & (bare(original) == bare(t)) & (language_code(source if source is not None else F.lit("")) != lang)
        code = code.when(same & ~F.coalesce(allow_identity if allow_identity is not None else F.lit(False), F.lit(False)), "unchanged_source_text")
    return code


def is_tiny(text: Column) -> Column:
    """One to four han characters, or none and at most two words."""
    han = F.regexp_count(text, F.lit(r"[㐀-鿿]"))
    return han.between(1, 4) | ((han == 0) & (F.regexp_count(text, F.lit(r"(?U)\w+")) <= 2))


def ngrams(text: Column, n: int = 2) -> Column:
    """The distinct character n-grams; a shorter text is its own only one, an empty text has none."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements, 0 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the larger array's."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def is_subset(a: Column, b: Column) -> Column:
    """Whether all of a is in b."""
    return F.size(F.array_except(a, b)) == 0


def digit_tokens(text: Column) -> Column:
    """Distinct numbers with inner separators, in order of first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DIGITS), F.lit(1)))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based places of all occurrences, overlapping ones too; none of an empty needle."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.length(needle)) == needle)
    return F.when(needle == "", F.array().cast("array<int>")).otherwise(F.transform(at, lambda i: i - 1))


def run_count(keys: Column, needle: Column) -> Column:
    """How often an array occurs as a run of another."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: F.slice(keys, i, F.size(needle)) == needle)
    return F.when(F.size(needle) == 0, 0).otherwise(F.size(at))


def relocates(text: Column, start: Column, end: Column, replacement: Column) -> Column:
    """Whether the replacement already stands outside the span [start, end), case aside."""
    low = F.lower(replacement)
    return F.exists(occurrences(F.lower(text), low), lambda i: (i + F.length(low) <= start) | (i >= end)) & (low != "")


def splice(text: Column, start: Column, end: Column, original: Column, replacement: Column) -> Column:
    """The text with code points [start, end), which must be `original`, replaced; null if they are not."""
    here = (start >= 0) & (end >= start) & (end <= F.length(text)) & (F.substr(text, start + 1, end - start) == original)
    return F.when(here, F.concat(F.substr(text, F.lit(1), start), replacement, F.substr(text, end + 1, F.length(text))))


def splice_all(text: Column, edits: Column) -> Column:
    """Apply edits (start, end, replacement) from the right, so that places stay true."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["replacement"], F.substr(t, e["end"] + 1, F.length(t))))


def word_tokens(text: Column) -> Column:
    """CJK characters one by one, other runs between white space whole (X04); normalise before."""
    return F.regexp_extract_all(text, F.lit(r"([㐀-䶿一-鿿豈-﫿]|[^\s㐀-䶿一-鿿豈-﫿]+)"), F.lit(1))


def edit_distance(left: Column, right: Column) -> Column:
    """Edit distance, exact at any length; long texts that are alike take far less than the whole table."""
    return unicode.edits(left, right)


def edit_ratio(left: Column, right: Column) -> Column:
    """Edit distance of two normalised texts over the length of the first."""
    return edit_distance(left, right) / F.greatest(F.length(left), F.lit(1))


def split_lines(text: Column) -> Column:
    """The text lines of recognised text: reference records, else coordinate records, else physical lines (X11).

    Character references in records need `marlstone.functions.unicode.unescape`.
    """
    clean = F.replace(F.coalesce(text, F.lit("")), F.lit("```"), F.lit("\n"))
    tidy = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^[ \t|-]+|[ \t|-]+$", "")
    refs = F.regexp_extract_all(clean, F.lit(r"(?is)<ref>(.*?)</ref>"), F.lit(1))
    coords = F.regexp_extract_all(clean, F.lit(r"([^\r\n]*?)" + POINT_PAIR), F.lit(1))
    plain = F.filter(F.split(F.regexp_replace(clean, r"(?i)<quad>.*?</quad>", ""), r"[\r\n]+", -1), lambda x: strip(x) != "")
    kept = lambda a: F.filter(F.transform(a, tidy), lambda x: x != "")
    return F.when(F.size(refs) > 0, kept(refs)).when(F.size(kept(coords)) > 0, kept(coords)).otherwise(F.transform(plain, tidy))


def regions(text: Column) -> Column:
    """Regions of `text(x,y),(x,y)`: array of (text, bbox of four ints)."""
    whole = "([^()]*)" + POINT_PAIR
    group = [F.regexp_extract_all(text, F.lit(whole), F.lit(i)) for i in range(1, 6)]
    return F.transform(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(group))), lambda r: F.struct(strip(r["g0"]).alias("text"), F.array(*(r[f"g{i}"].try_cast("int") for i in range(1, 5))).alias("bbox")))


def placed_regions(text: Column) -> Column:
    """All regions of a line in order, also what follows the last box: array of (text, bbox) with single spaces.

    A line without boxes is one region without a box.
    """
    boxed = regions(text)
    tidy = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    tail = F.regexp_replace(text, "(?s)^.*" + POINT_PAIR, "")
    last = F.when((tail != "") | (F.size(boxed) == 0), F.array(F.struct(tidy(tail).alias("text"), F.lit(None).cast("array<int>").alias("bbox")))).otherwise(F.array().cast("array<struct<text:string,bbox:array<int>>>"))
    return F.concat(F.transform(boxed, lambda r: F.struct(tidy(r["text"]).alias("text"), r["bbox"].alias("bbox"))), last)


def lenient_object(text: Column) -> Column:
    """The JSON object text inside a reply: without code fences, from the first { to the last } (S22); null if none."""
    t = strip(F.coalesce(text, F.lit("")))
    t = strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"```$", ""))
    first, last = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
    return F.when((first > 0) & (last > first) & (F.locate("}", t) > 0), F.substr(t, first, last - first + 1))


def candidates(raw: Column, fallback: Column, maximum: int = 5) -> Column:
    """Trimmed distinct non-empty texts in order, at most `maximum`, else the fallback."""
    texts = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))), 1, maximum)
    backup = strip(F.coalesce(fallback, F.lit("")))
    return F.when(F.size(texts) > 0, texts).when(backup != "", F.array(backup)).otherwise(F.array().cast("array<string>"))


def closest_by_length(options: Column, desired: Column) -> Column:
    """The first option whose length is nearest to the desired one."""
    ranked = F.transform(options, lambda x, i: F.struct(F.abs(F.length(x) - desired).alias("off"), i.alias("at"), x.alias("text")))
    return F.array_min(ranked)["text"]
