"""Evaluation: accuracy of classified pairs, recall of rankings, token ledgers, the acceptance corpus' gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = ("exact", "normalized_equal", "strong_related")


def _ratio(n: Column, of: Column, empty: float = 1.0) -> Column:
    return F.when(of == 0, F.lit(empty)).otherwise(n / of)


def accuracy(pairs: DataFrame) -> DataFrame:
    """pairs: expected, actual, critical_difference. Precision and recall of exact, precision of strong_related, safety.

    critical_safety: pairs with a critical difference that aren't taken as exact, equal or strongly related;
    unrelated_promotion: unrelated pairs taken for anything but unrelated or keyword.
    """
    e, a = F.col("expected"), F.col("actual")
    critical, unrelated = F.col("critical_difference"), e == "unrelated"
    return pairs.agg(
        F.count("*").alias("pairs"), _ratio(F.count_if((a == "exact") & (e == "exact")), F.count_if(a == "exact")).alias("exact_precision"), _ratio(F.count_if((a == "exact") & (e == "exact")), F.count_if(e == "exact")).alias("exact_recall"),
        _ratio(F.count_if((a == "strong_related") & ~unrelated & ~critical), F.count_if(a == "strong_related")).alias("strong_precision"), _ratio(F.count_if(critical & ~a.isin(*POSITIVE)), F.count_if(critical)).alias("critical_safety"),
        _ratio(F.count_if(unrelated & ~a.isin("unrelated", "keyword")), F.count_if(unrelated), 0.0).alias("unrelated_promotion"),
    )


def recall_at(runs: DataFrame, k: int) -> DataFrame:
    """runs: relevant_ids, ranked_ids. The share of queries with a relevant id among the first k."""
    hit = F.arrays_overlap(F.slice("ranked_ids", 1, k), F.col("relevant_ids"))
    return runs.agg(F.count("*").alias("queries"), F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("recall"))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value that at least a share p of all don't exceed; 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), F.lit(0.0))


def ledger_summary(entries: DataFrame) -> DataFrame:
    """entries: id, raw_prompt_tokens, tool_schema_tokens, request_tokens, response_tokens, expansion_tokens, required_facts, recovered_facts."""
    rows = entries.withColumn("total", F.col("tool_schema_tokens") + F.col("request_tokens") + F.col("response_tokens") + F.col("expansion_tokens"))
    rows = rows.withColumn("reduction", _ratio(F.col("raw_prompt_tokens") - F.col("total"), F.col("raw_prompt_tokens"), 0.0)).withColumn("recovered", F.size(F.filter("required_facts", lambda x: F.array_contains("recovered_facts", x))))
    raw, total = F.coalesce(F.sum("raw_prompt_tokens"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    required = F.coalesce(F.sum(F.size("required_facts")), F.lit(0))
    return rows.agg(
        F.count("*").alias("cases"), _ratio(raw - total, raw, 0.0).alias("aggregate_reduction"), nearest_rank("reduction", 0.5).alias("median_reduction"), _ratio(F.coalesce(F.sum("recovered"), F.lit(0)), required).alias("fact_fidelity"),
        F.array_sort(F.collect_list(F.when(F.col("total") > F.col("raw_prompt_tokens"), F.col("id")))).alias("regressions"), raw.alias("raw_tokens"), total.alias("compact_tokens"),
    )


def cheapest_handles(facts: DataFrame, expanded: DataFrame, estimate: Column) -> DataFrame:
    """fact, uri: for each fact the span of the fewest tokens (then the smallest uri) whose text has it."""
    found = facts.join(expanded, F.contains(expanded["text"], facts["fact"]))
    return found.groupBy("fact").agg(F.min(F.struct(estimate.alias("tokens"), "uri")).alias("best")).select("fact", "best.uri", "best.tokens")


def fact_coverage(texts: DataFrame, text: str = "text", facts: str = "required_facts") -> DataFrame:
    """texts with covered (facts found in the text) and coverage (their share; 1 without facts)."""
    covered = F.size(F.filter(facts, lambda x: F.contains(F.col(text), x)))
    return texts.withColumn("covered", covered).withColumn("coverage", _ratio(F.col("covered"), F.size(facts)))
