"""Quality rules as a bitmask ledger, in DataFrame functions only.

Method. Every rule is evaluated once per document. The ledger keeps the measurements and one bit
for each failed rule; a policy is a versioned set of rules, so its verdict is a bit test on the
ledger, and leaving a rule out (ablation) is another bit test, counted over the distinct bit sets.

Defined results: null text counts as empty, has no words and fails; a repeated row is judged each
time; very long texts are measured whole; a measurement equal to a rule's limit passes; an empty table gives an
empty ledger; other columns are passed on by ``kept_rows`` only, whatever their names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleethealth.llm.common import own_columns

#: Word separators, symbols that are counted, words in a repeated window.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements

#: The position of a rule is its bit. Integer comparisons only, so every engine agrees.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("shouting", "100 * n_marks > 60 * n_words"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: int
    rules: int  # bits


POLICIES = (Policy(1, BASE), Policy(2, 0b1111111))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words that lie in some window of n words which the array holds at least twice."""
    own, before, after = "own", "before", "after"
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))

    def starts(ordered: Column) -> Column:
        """Places of the windows whose hash a neighbour in sort order shares."""
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        sides = F.arrays_zip(ordered.alias("own"), F.concat(none, F.slice(ordered, 1, F.size(ordered) - 1)).alias("before"), F.concat(F.slice(ordered, 2, F.size(ordered) - 1), none).alias("after"))
        same = F.filter(sides, lambda x: F.coalesce(x[own]["h"] == x[before]["h"], F.lit(False)) | F.coalesce(x[own]["h"] == x[after]["h"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda x: x[own]["i"]))

    def covered(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        at = F.transform(F.array(ordered), starts)[0]
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + (s + n - F.greatest(a["end"], s))).alias("n"), (s + n).alias("end")))["n"]

    return F.when(F.size(words) > n, F.transform(F.array(hashes), lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))[0]).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, ``row`` (the whole input row) and the measurements, each taken once."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    split = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.struct(*own_columns(docs)).alias("row"), text.alias("text"))
    parts = F.struct("text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACE)) > 0).alias("lines"))
    # one element is exploded: filters on the measurements aren't moved below it, where they would split the text anew for each word
    split = split.select("doc_id", "row", F.explode(F.array(parts)).alias("parts")).select("doc_id", "row", "parts.*")
    n = lambda c: F.size(c).cast("long")
    return split.select(
        "doc_id",
        "row",
        n("words").alias("n_words"),
        F.length(_without(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        n("lines").alias("n_lines"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_marks"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements with ``failed``, the bits of the rules that a document fails."""
    bits = " | ".join(f"IF({r.fails}, {1 << k}, 0)" for k, r in enumerate(rules))
    return measure(docs).withColumn("failed", F.expr(f"CAST({bits} AS BIGINT)"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the verdict of one policy, and the one rule that alone decided it."""
    hit = F.col("failed").bitwiseAND(policy.rules | BASE)
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(BASE) != 0).withColumn("kept", hit == 0).withColumn("policy", F.lit(policy.version)).withColumn("sole_rule", F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0).cast("long")))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, failed, kept_without: documents that fail a rule, and that the policy would keep without it.

    Counts the distinct bit sets first (at most two to the number of rules), then tests bits."""
    sets = rows.groupBy("failed").count()
    mask = policy.rules | BASE
    one = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules))))
    each = sets.select("failed", "count", one.alias("r")).select("failed", "count", "r.*")
    without = F.col("failed").bitwiseAND(F.lit(mask).bitwiseAND(F.bitwise_not(F.col("bit"))))
    return each.groupBy("rule").agg(F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("failed"), F.sum(F.when(without == 0, F.col("count")).otherwise(0)).alias("kept_without"), F.bit_or("failed").alias("seen_bits"))


def kept_rows(docs: DataFrame, policy: Policy = POLICIES[-1]) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    judged = apply_policy(ledger(docs), policy)
    own = F.array("row")
    return judged.select(F.explode(F.when(F.col("kept"), own).otherwise(F.slice(own, 1, 0))).alias("row")).select("row.*")
