"""Structured decisions: rule sets as data, repairs before validation, and coverage of references.

A rule set maps a code to a condition that is true where the rule is broken. Conditions
are SQL over flat columns; list fields come as their sizes (`n_x`) and distinct sizes
(`d_x`), which `flatten` derives. `violations` puts the codes of broken rules in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions.texts import SPECULATIVE, has_marker

Rules = dict[str, str]
_DATE_SHAPE = "(precision = 'day' AND regexp_like(event_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR precision = 'month' AND regexp_like(event_date, '^[0-9]{4}-[0-9]{2}$') OR precision = 'year' AND regexp_like(event_date, '^[0-9]{4}$'))"

GATE: Rules = {
    "candidate_with_noise": "is_candidate AND noise IS NOT NULL",
    "candidate_without_nexus": "is_candidate AND nexus IS NULL",
    "candidate_without_core": "is_candidate AND core IS NULL",
    "candidate_without_ground": "is_candidate AND anchor IS NULL AND continuation IS NULL",
    "reject_without_noise": "NOT is_candidate AND noise IS NULL",
}
CARD: Rules = {
    "events_1_to_3": "n_events < 1 OR n_events > 3",
    "entities_up_to_8": "n_entities > 8",
    "terms_1_to_8": "n_terms < 1 OR n_terms > 8",
    "event_refs_repeat": "d_events < n_events",
    "entity_refs_repeat": "d_entities < n_entities",
    "date_shape": f"(precision = 'unknown' AND event_date IS NOT NULL) OR (precision <> 'unknown' AND NOT coalesce({_DATE_SHAPE}, false))",
}
RESOLUTION: Rules = {
    "theme_only": "theme IS NOT NULL AND story IS NULL AND outcome <> 'rejected'",
    "resolved_without_case": "outcome = 'resolved' AND n_links = 0 AND n_new = 0",
    "resolved_without_story": "outcome = 'resolved' AND story IS NULL",
    "resolved_without_core": "outcome = 'resolved' AND core IS NULL",
    "resolved_without_ground": "outcome = 'resolved' AND n_matching = 0 AND coalesce(new_core, '') = ''",
    "links_on_broad_overlap": "n_links > 0 AND broad IS NOT NULL AND n_matching = 0",
    "rejected_with_case": "outcome = 'rejected' AND (n_links > 0 OR n_new > 0)",
    "rejected_without_sign": "outcome = 'rejected' AND n_signals = 0 AND story IS NOT NULL",
    "links_repeat": "d_links < n_links",
    "new_refs_repeat": "d_new < n_new",
}
LINK_AUDIT: Rules = {
    "connect_without_story": "outcome = 'connect' AND story IS NULL",
    "connect_without_case_core": "outcome = 'connect' AND case_core IS NULL",
    "connect_without_shared": "outcome = 'connect' AND shared IS NULL",
    "connect_on_broad": "outcome = 'connect' AND broad IS NOT NULL",
    "connect_with_signals": "outcome = 'connect' AND n_signals > 0",
    "drop_without_reason": "outcome = 'drop' AND broad IS NULL AND n_signals = 0 AND shared IS NOT NULL",
}
REFRESH: Rules = {
    "replace_without_title": "action = 'replace' AND coalesce(title, '') = ''",
    "replace_without_reason": "action = 'replace' AND reason IS NULL",
    "keep_with_title": "action = 'keep' AND title IS NOT NULL",
}
COHERENCE: Rules = {
    "undecided_with_decisions": "outcome = 'inconclusive' AND (n_stories > 0 OR n_detached > 0)",
    "one_original": "outcome <> 'inconclusive' AND n_original <> 1",
    "refs_repeat": "outcome <> 'inconclusive' AND d_stories < n_stories",
    "coherent_without_core": "outcome = 'coherent' AND shared IS NULL",
    "coherent_on_theme": "outcome = 'coherent' AND broad IS NOT NULL",
    "coherent_with_blockers": "outcome = 'coherent' AND n_blockers > 0",
    "coherent_with_stories": "outcome = 'coherent' AND n_stories <> 1",
    "split_without_cores": "outcome = 'split' AND n_cores < 2",
    "split_without_stories": "outcome = 'split' AND n_stories < 2",
    "story_articles_repeat": "outcome <> 'inconclusive' AND n_assigned_repeats > 0",
    "detached_repeat": "outcome <> 'inconclusive' AND d_detached < n_detached",
    "assigned_and_detached": "outcome <> 'inconclusive' AND n_both > 0",
}
INTEREST: Rules = {
    "keep_without_core": "outcome = 'keep' AND core IS NULL",
    "keep_without_anchor": "outcome = 'keep' AND anchor IS NULL",
    "keep_without_signal": "outcome = 'keep' AND durable IS NULL",
    "keep_with_hide_signals": "outcome = 'keep' AND n_signals > 0",
    "keep_on_speculation": "outcome = 'keep' AND coalesce(speculative, false)",
    "hide_without_signal": "outcome = 'hide' AND n_signals = 0",
}
DUPLICATE: Rules = {
    "merge_without_core": "outcome = 'merge' AND shared IS NULL",
    "merge_with_blockers": "outcome = 'merge' AND n_blockers > 0",
    "distinct_without_overlap": "outcome = 'distinct' AND broad IS NULL",
}
_EXISTING = "action IN ('link_existing', 'rename_existing', 'retype_existing')"
ENTITY: Rules = {
    "role_alias": "coalesce(role_alias, false)",
    "role_description": "coalesce(role_description, false)",
    "existing_without_id": f"{_EXISTING} AND existing_id IS NULL",
    "new_with_id": "action = 'create_new' AND existing_id IS NOT NULL",
    "new_without_name_or_type": "action = 'create_new' AND (new_name IS NULL OR entity_type IS NULL)",
    "rename_without_name": "action = 'rename_existing' AND new_name IS NULL",
    "name_out_of_place": "action IN ('link_existing', 'retype_existing', 'reject') AND new_name IS NOT NULL",
    "retype_without_type": "action = 'retype_existing' AND entity_type IS NULL",
    "reject_without_reason": "action = 'reject' AND rejection IS NULL",
    "reject_with_identity": "action = 'reject' AND (existing_id IS NOT NULL OR new_name IS NOT NULL)",
    "reject_with_cases": "action = 'reject' AND n_cases > 0",
    "accepted_with_rejection": "action <> 'reject' AND rejection IS NOT NULL",
    "accepted_without_actor": "action <> 'reject' AND NOT coalesce(named_actor, false)",
    "accepted_without_material": "action <> 'reject' AND n_material = 0",
    "accepted_without_case": "action <> 'reject' AND n_cases = 0",
    "existing_without_evidence": f"{_EXISTING} AND evidence IS NULL",
    "existing_with_conflict": f"{_EXISTING} AND conflict IS NOT NULL",
}
EVENT: Rules = {
    "no_date_but_precision": "event_date IS NULL AND precision <> 'unknown'",
    "no_date_but_evidence": "event_date IS NULL AND date_evidence IS NOT NULL",
    "date_shape": f"event_date IS NOT NULL AND NOT coalesce({_DATE_SHAPE}, false)",
    "date_without_evidence": "event_date IS NOT NULL AND trim(coalesce(date_evidence, '')) = ''",
    "link_without_id": "action = 'link_existing' AND existing_id IS NULL",
    "new_with_id": "action = 'create_new' AND existing_id IS NOT NULL",
    "new_without_title": "action = 'create_new' AND new_title IS NULL",
    "placeholder_title": "action = 'create_new' AND coalesce(placeholder, false)",
    "link_with_title": "action = 'link_existing' AND new_title IS NOT NULL",
    "reject_without_reason": "action = 'reject' AND rejection IS NULL",
    "reject_with_identity": "action = 'reject' AND (existing_id IS NOT NULL OR new_title IS NOT NULL)",
    "reject_with_cases": "action = 'reject' AND n_cases > 0",
    "accepted_with_rejection": "action <> 'reject' AND rejection IS NOT NULL",
    "accepted_not_concrete": "action <> 'reject' AND NOT coalesce(concrete, false)",
    "accepted_without_core": "action <> 'reject' AND core IS NULL",
    "accepted_without_material": "action <> 'reject' AND n_material = 0",
    "accepted_without_case": "action <> 'reject' AND n_cases = 0",
    "link_without_evidence": "action = 'link_existing' AND evidence IS NULL",
    "link_with_conflict": "action = 'link_existing' AND conflict IS NOT NULL",
}
RULES: dict[str, Rules] = {"gate": GATE, "card": CARD, "resolution": RESOLUTION, "link_audit": LINK_AUDIT, "refresh": REFRESH, "coherence": COHERENCE, "interest": INTEREST, "duplicate": DUPLICATE, "entity": ENTITY, "event": EVENT}

ROLE_WORDS = r"(?iu)(?<![\p{L}])(колишн(ій|я|є|і)|підозрюван(ий|а|е|і)|обвинувачен(ий|а|е|і)|фігурант|переможець|посадовець|бухгалтер|водій|підприємець|правоохоронець|у справі|тендеру|як(ий|а|е|і))(?![\p{L}])"
ROLE_TEXT = r"(?iu)(?<![\p{L}])(як(ий|а|е|і)\s+(викри(в|ла)|продовжи(в|ла)|фігурує)|де\s+(затримали|повідомили|провели|викрили))(?![\p{L}])"
PLACEHOLDER = r"(?iu)^\s*(опис\s+)?поді(я|ї)\s*[0-9]+[\s.!]*$"


def flatten(rows: DataFrame, lists: dict[str, str]) -> DataFrame:
    """rows with n_<label> and d_<label> for each list column (0 for null)."""
    out = {}
    for label, column in lists.items():
        held = F.coalesce(F.col(column), F.array().cast(dict(rows.dtypes)[column]))
        out[f"n_{label}"], out[f"d_{label}"] = F.size(held), F.size(F.array_distinct(held))
    return rows.withColumns(out)


def detect(rows: DataFrame, aliases: str | None = None, description: str | None = None, title: str | None = None, durable: str | None = None) -> DataFrame:
    """Adds the flags that rules on roles, placeholders and speculation read."""
    out: dict[str, Column] = {}
    if aliases:
        out["role_alias"] = F.exists(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.coalesce(a.rlike(ROLE_WORDS), F.lit(False)))
    if description:
        out["role_description"] = F.coalesce(F.col(description).rlike(ROLE_TEXT), F.lit(False))
    if title:
        out["placeholder"] = F.coalesce(F.col(title).rlike(PLACEHOLDER), F.lit(False))
    if durable:
        out["speculative"] = has_marker(F.col(durable), SPECULATIVE)
    return rows.withColumns(out)


def violations(rules: Rules) -> Column:
    """Codes of the broken rules, in the rules' order."""
    return F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(code)) for code, condition in rules.items()]))


def violation_sql(rules: Rules) -> str:
    """The same as a comma-separated text, for the oracle."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items())
    return f"concat_ws(',', {cases})".replace("regexp_like", "regexp_matches")


def status(found: Column, kind: str) -> Column:
    """valid; else audits become inconclusive and everything else fails."""
    fallback = "inconclusive" if kind in ("coherence", "interest", "duplicate", "link_audit") else "failed"
    return F.when(F.size(found) == 0, "valid").otherwise(fallback)


def coverage(decisions: DataFrame, wanted: DataFrame, key: str, ref: str) -> DataFrame:
    """For each key: wanted references without a decision, decided ones that weren't wanted, and repeats."""
    have = decisions.groupBy(key, ref).agg(F.count("*").alias("times"))
    both = wanted.select(key, ref).distinct().withColumn("wanted", F.lit(True)).join(have, [key, ref], "full_outer")
    return both.groupBy(key).agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("repeated"))


def align_refs(given: Column, wanted: Column) -> Column:
    """References replaced by position, only where the counts are equal and the sets differ."""
    same = F.array_sort(F.array_distinct(given)) == F.array_sort(F.array_distinct(wanted))
    return F.when((F.size(given) == F.size(wanted)) & ~same, wanted).otherwise(given)


def reject_unknown_links(decisions: DataFrame, candidates: str) -> DataFrame:
    """A link to an identity outside the retrieved candidates becomes a rejection."""
    stray = (F.col("action") == "link_existing") & ~F.coalesce(F.array_contains(candidates, F.col("existing_id")), F.lit(False))
    return decisions.withColumns({
        "rejection": F.when(stray, "insufficient_identity").otherwise(F.col("rejection")), "action": F.when(stray, "reject").otherwise(F.col("action")),
        "existing_id": F.when(~stray, F.col("existing_id")),
    })


def trim_card(rows: DataFrame) -> DataFrame:
    """Lists cut to what a card may hold; references numbered where they are missing."""
    return rows.withColumns({"entities": F.slice("entities", 1, 8), "events": F.slice("events", 1, 3), "terms": F.slice("terms", 1, 8)})


def numbered(items: Column, prefix: str) -> Column:
    """prefix_1, prefix_2, ... for the items of a list."""
    return F.transform(items, lambda _, k: F.concat(F.lit(f"{prefix}_"), (k + 1).cast("string")))


def grounded_date(given: Column, source: Column, evidence: Column) -> Column:
    """The source's date, kept only if the decision repeats it with evidence."""
    return F.when((given == source) & evidence.isNotNull(), source)


def ground_links(decisions: DataFrame) -> DataFrame:
    """Event links that contradict what is known of the event become creations.

    decisions: (article_id, position, event_id, known, stated) with partial dates as structs;
    within an article, links to one event are taken in order and each accepted one adds
    the parts it states to what is known.
    """
    rows = F.array_sort(F.collect_list(F.struct("position", "stated")))
    kind = decisions.schema["known"].dataType

    def step(state: Column, x: Column) -> Column:
        bad = dates.conflicts(state["known"], x["stated"])
        verdict = F.struct(x["position"].cast("int").alias("position"), F.when(bad, "create_new").otherwise("link_existing").alias("action"))
        merged = dates.enrich(state["known"], x["stated"]).cast(kind)
        return F.struct(F.when(bad, state["known"]).otherwise(merged).alias("known"), F.concat(state["out"], F.array(verdict)).alias("out"))

    held = decisions.groupBy("article_id", "event_id").agg(rows.alias("rows"), F.first("known").alias("known"))
    begin = F.struct(F.col("known").cast(kind).alias("known"), F.array().cast("array<struct<position:int,action:string>>").alias("out"))
    return held.select("article_id", "event_id", F.inline(F.aggregate("rows", begin, step)["out"]))


def recheck(links: DataFrame, new_cases: DataFrame) -> DataFrame:
    """Per article, after its links were audited: how many stay, and whether it is resolved."""
    kept = links.groupBy("article_id").agg(F.count_if(F.col("outcome") == "connect").alias("kept"))
    fresh = new_cases.groupBy("article_id").agg(F.count("*").alias("fresh"))
    joined = kept.join(fresh, "article_id", "full_outer").fillna(0, ["kept", "fresh"])
    return joined.withColumn("outcome", F.when(F.col("kept") + F.col("fresh") > 0, "resolved").otherwise("rejected"))


def audit_groups(cards: DataFrame, size: int = 20) -> DataFrame:
    """Cards in batches of `size` with a group reference each, for audits of large cases."""
    order = Window.partitionBy("case_id").orderBy("position")
    return cards.withColumn("group_ref", F.concat(F.lit("group_"), (F.floor((F.row_number().over(order) - 1) / size) + 1).cast("string")))


def expand_groups(stories: DataFrame, groups: DataFrame) -> DataFrame:
    """Article ids of stories that name groups, each once."""
    named = stories.select("case_id", "story_ref", F.explode("group_refs").alias("group_ref"))
    return named.join(groups, ["case_id", "group_ref"]).select("case_id", "story_ref", "article_id").distinct()


def audit_status(first_covers: Column, second_covers: Column) -> Column:
    """An audit that doesn't cover its articles is asked once more, then counts as inconclusive."""
    return F.when(first_covers, "accepted").when(second_covers, "accepted_on_retry").otherwise("inconclusive")


def superseded(read: Column, now: Column, outcome: Column) -> Column:
    """A decision is discarded if the evidence moved on since it was read."""
    return F.when(read != now, "superseded").otherwise(outcome)
