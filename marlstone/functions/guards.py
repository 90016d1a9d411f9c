"""Acceptance of proposed corrections: ordered rules that give a decision and its reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.config import Guard
from marlstone.functions.text import digit_tokens, edit_ratio, is_subset

# Evidence roles that never support a change.
RISKY_ROLES = ("ui_or_watermark", "uncertain")


def proposal_reason(heard: Column, proposed: Column, heard_key: Column, proposed_key: Column, changed: Column, confidence: Column, role: Column, evidence: Column, known: Column, cfg: Guard = Guard()) -> Column:
    """The first rule a proposal breaks, or accepted.

    heard_key and proposed_key are the texts as compared (normalised); evidence and known are arrays of line ids.
    """
    ratio = edit_ratio(heard_key, proposed_key)
    limit = F.when(role == "translated_subtitle", F.least(F.lit(cfg.max_edit_ratio), F.lit(cfg.translated_ratio))).when((role == "proper_noun_or_title") & (confidence >= cfg.proper_noun_confidence), F.greatest(F.lit(cfg.max_edit_ratio), F.lit(cfg.proper_noun_ratio))).otherwise(cfg.max_edit_ratio)
    new_digits = F.array_sort(F.array_except(digit_tokens(proposed), digit_tokens(heard)))
    return (
        F.when(~F.coalesce(changed, F.lit(False)), "model_changed_false")
        .when(F.trim(F.coalesce(proposed, F.lit(""))) == "", "empty_proposal")
        .when(F.coalesce(confidence, F.lit(0.0)) < cfg.min_confidence, f"confidence_below_{cfg.min_confidence:.2f}")
        .when((F.size(evidence) == 0) | ~is_subset(evidence, known), "missing_or_invalid_evidence")
        .when(role.isin(*RISKY_ROLES), F.concat(F.lit("unsafe_evidence_role:"), role))
        .when(F.size(new_digits) > 0, F.concat(F.lit("introduced_digits:"), F.array_join(new_digits, ",")))
        .when(heard_key == proposed_key, "punctuation_or_case_only")
        .when((F.length(heard) >= cfg.expansion_from) & (F.length(proposed) > F.length(heard) * cfg.expansion), "over_expansion")
        .when(ratio > limit, F.format_string("edit_ratio_%.3f_above_%.3f", ratio, limit.cast("double")))
        .otherwise("accepted")
    )


def grounded_reason(replacements: Column, deletions: Column, evidence: Column) -> Column:
    """Whether replacements stand in the joined evidence and deleted parts don't (F08); all normalised."""
    return (
        F.when(evidence == "", "missing_cited_evidence")
        .when(F.exists(replacements, lambda r: (r != "") & ~evidence.contains(r)), "replacement_not_in_evidence")
        .when(F.exists(deletions, lambda d: (d != "") & evidence.contains(d)), "deleted_content_in_evidence")
        .otherwise("grounded")
    )


def removes_latin(originals: Column, replacements: Column) -> Column:
    """Whether an edit takes Latin script away."""
    pairs = F.arrays_zip(originals.alias("o"), replacements.alias("r"))
    return F.exists(pairs, lambda p: p["o"].rlike("[A-Za-z]") & ~p["r"].rlike("[A-Za-z]"))


def declared_risk(reasons: Column, pattern: str) -> Column:
    """Whether the stated reasons name a risk."""
    return F.concat_ws(" ", reasons).rlike(f"(?is){pattern}")


def stated_edit_ratio(reason: Column) -> Column:
    """The ratio inside an edit-ratio rejection, else null."""
    return F.nullif(F.regexp_extract(reason, r"^edit_ratio_(\d+(?:\.\d+)?)_above_", 1), F.lit("")).try_cast("double")


def whole_exception(reason: Column, n_edits: Column, span: Column, heard: Column, confidence: Column, lines: Column, evidence: Column, replacement: Column, most: float = 0.65) -> Column:
    """A single whole-text edit of high confidence on two cited lines may pass an edit-ratio rejection."""
    supported = (replacement != "") & (evidence.contains(replacement) | replacement.contains(evidence))
    ok = (stated_edit_ratio(reason) <= most) & (n_edits == 1) & (F.trim(span) == F.trim(heard)) & (confidence >= 0.90) & (F.size(F.array_distinct(lines)) >= 2) & supported
    return F.coalesce(ok, F.lit(False))


def boundary_reason(parent_accepted: Column, latin_removed: Column, declared: Column, strict: bool) -> Column:
    """The second-level decision."""
    out = F.when(~parent_accepted, "preserve_parent_rejection").when(latin_removed, "latin_script_removed")
    return (out.when(declared, "self_declared_rewrite") if strict else out).otherwise("accepted")


def all_reasons(rules: dict[str, Column]) -> Column:
    """Names of all rules that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
