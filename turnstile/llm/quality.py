"""Quality rules as a ledger: every rule is evaluated once per document, and kept as a bit.

``ledger`` measures a document in one pass of built-in expressions and stores what it measured and one failure bit per
rule.  Policies are versioned sets of rules, applied to the ledger by a bit mask, so a new policy never reads a text
again; ``ablation`` counts per distinct bit pattern first and so shuffles a few rows per task.

Null texts count as empty; an empty text fails the rules on length and nothing else.  Rows are judged one by one:
repeated rows, ties and extra columns change nothing, an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstile.llm.text import SPACE, WORD, whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_upper")

#: Rule -> when it fails, over the measures.  A rule's place is its bit for ever; new rules go to the end.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines",
    "exclamations": "10 * n_exclaims > n_words",
    "capitals": "2 * n_upper > word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BITS = {rule: 1 << place for place, rule in enumerate(RULES)}

#: Version -> rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "2024-2": tuple(RULES),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    return sum(BITS[rule] for rule in POLICIES[policy])


def _window_hits(words: Column, order: Column) -> Column:
    """Positions of the 3-word windows that another window of the document repeats; ``order`` sorts them by hash."""

    def same(a: Column, b: Column) -> Column:
        i, j = order[a]["at"], order[b]["at"]
        equal = order[a]["h"] == order[b]["h"]
        for k in range(3):
            equal = equal & (words[i + k] == words[j + k])
        return equal

    last = F.size(order) - 1
    places = F.when(last >= 1, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda p: ((p > 0) & same(p, p - 1)) | ((p < last) & same(p, p + 1)))
    return F.transform(hits, lambda p: order[p]["at"])


def with_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` and its measures, each named ``prefix`` + name."""
    col = lambda name: F.col(f"_llm_{name}")
    n = F.size(col("words"))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        starts,
        lambda i: F.struct(
            F.xxhash64(col("words")[i], col("words")[i + 1], col("words")[i + 2]).alias("h"), i.alias("at")
        ),
    )
    lines = F.filter(F.split(col("text"), "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)
    kept = df.columns
    df = df.withColumn("_llm_text", whole_text(text))
    df = df.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("_llm_text"),
        F.regexp_extract_all(col("text"), F.lit(WORD), F.lit(0)).alias("_llm_words"),
        lines.alias("_llm_lines"),
        F.length(F.regexp_replace(col("text"), SPACE + "+", "")).cast("long").alias("_llm_word_chars"),
    )
    df = df.withColumn("_llm_order", F.sort_array(windows))
    df = df.withColumn("_llm_hits", _window_hits(col("words"), col("order")))
    # Optimisers copy a filter's inputs to below the projections, which would sort all windows again for each window. A
    # column that depends on the partition's number, if only formally, keeps filters on the measures above them.
    n = F.when(F.spark_partition_id() >= 0, F.size(col("words")))
    less = lambda chars: F.length(col("text")) - F.length(F.translate(col("text"), chars, ""))
    measures = {
        "n_words": n,
        "word_chars": col("word_chars"),
        "n_symbols": less("#*$%&|<>"),
        "n_lines": F.size(col("lines")),
        "n_dup_lines": F.size(col("lines")) - F.size(F.array_distinct(col("lines"))),
        "n_repeat_words": F.size(
            F.array_distinct(F.flatten(F.transform(col("hits"), lambda i: F.array(i, i + 1, i + 2))))
        ),
        "n_exclaims": less("!"),
        "n_upper": F.regexp_count(col("text"), F.lit(r"\p{Lu}")),
    }
    return df.select(
        *(F.col(f"`{c}`") for c in kept), *(m.cast("long").alias(prefix + name) for name, m in measures.items())
    )


def fail_bits(prefix: str = "") -> Column:
    """One bit per failed rule, from the measures."""
    bits = F.lit(0).cast("long")
    for rule, fails in RULES.items():
        for name in MEASURES:
            fails = fails.replace(name, f"`{prefix}{name}`") if prefix else fails
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BITS[rule]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, every measure and ``fail_bits`` of each row of ``docs``."""
    slim = docs.select(*(F.col(k) for k in keys), F.col(text).alias("_llm_source"))
    return with_measures(slim, "_llm_source").drop("_llm_source").withColumn("fail_bits", fail_bits())


def passes(policy: str = CURRENT, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, and those that only it rejects."""
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = patterns.select("n", "fail_bits", F.inline(rules))
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == F.col("bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep_passing(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with their columns."""
    judged = with_measures(docs, prefix="_llm_m_").withColumn("_llm_bits", fail_bits("_llm_m_"))
    return judged.where(passes(policy, "_llm_bits")).select(*(F.col(f"`{c}`") for c in docs.columns))
