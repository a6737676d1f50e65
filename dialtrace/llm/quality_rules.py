"""Quality rules with a ledger of failure bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialtrace.llm.common import SPACE, whole_text

#: Words in a window of the repetition rule.
WINDOW = 8

#: Rule name -> what makes a document fail it, over the measurements of ``measure``.
#: The place in this list is the rule's bit; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "capitals": "100 * n_upper > 50 * word_chars",
}

#: Policy version -> its rules.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": list(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each document's whole text, all long.

    Word windows are compared by a 64-bit hash. Two windows that are equal cover their
    words; the covered words are counted from the sorted places of such windows, so a
    document takes n log n steps even if one window fills it.
    """
    cut = f"[{SPACE}]+"
    words = docs.select(
        "doc_id",
        whole_text().alias("text"),
        F.filter(F.split(whole_text(), cut), lambda w: w != "").alias("words"),
        F.filter(F.split(whole_text(), "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    basic = words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("bigint").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[\p{Lu}]+", ""))).cast("bigint").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    plain = [c for c in basic.columns if c != "hashes"]
    windows = basic.select(
        *plain,
        F.expr(f"""CASE WHEN n_words >= {WINDOW}
            THEN transform(sequence(1, size(hashes) - {WINDOW - 1}), i -> xxhash64(slice(hashes, i, {WINDOW})))
            ELSE array() END""").cast("array<bigint>").alias("windows"),
    )
    # only a document with two equal windows is sorted
    placed = windows.select(
        *plain,
        F.expr("""CASE WHEN size(array_distinct(windows)) < size(windows)
            THEN array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) END""").alias("placed"),
    )
    pairs = F.expr("""array_sort(array_distinct(flatten(zip_with(
        slice(placed, 1, size(placed) - 1), slice(placed, 2, size(placed) - 1),
        (a, b) -> IF(a.h = b.h, array(a.i, b.i), array())))))""")
    places = placed.select(*plain, F.when(F.col("placed").isNotNull(), pairs).alias("places"))
    covered = F.expr(f"""CASE WHEN places IS NULL THEN 0L ELSE {WINDOW}L + aggregate(
        zip_with(slice(places, 1, size(places) - 1), slice(places, 2, size(places) - 1), (a, b) -> least({WINDOW}, b - a)),
        0L, (s, x) -> s + x) END""")
    return places.select(*plain, covered.alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements, and ``failures``: one bit per failed rule.

    Every rule is evaluated once for every document; policies and ablations only read
    the bits. A missing text has no words and fails ``few_words``; a missing doc_id
    stays missing; repeated rows have a row each.
    """
    failed: Column = F.lit(0).cast("bigint")
    for rule, test in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs).withColumn("failures", failed)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, fail nothing else, and stay without it.

    The documents are first counted by their failure bits, at most 2 ** rules groups,
    and the rules are then held against those bits.
    """
    all_bits = mask(policy)
    seen = rows.groupBy(F.col("failures").bitwiseAND(F.lit(all_bits).cast("bigint")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]])
    by_rule = seen.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0))).cast("bigint")
    return by_rule.groupBy("rule").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        hit(F.col("bits") == F.col("bit")).alias("n_only"),
        hit(F.col("bits").bitwiseAND(F.lit(all_bits).cast("bigint") - F.col("bit")) == 0).alias("n_kept_without"),
    )


def quality_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, measurements, failures, base_failed and kept of every document."""
    base = F.col("failures").bitwiseAND(F.lit(mask("base")).cast("bigint")) != 0
    rows = apply_policy(ledger(docs).withColumn("base_failed", base), policy)
    return rows.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
