"""Quality rules as a ledger of bits: every rule is evaluated once, policies are applied later.

The ledger holds per document the measurements and one bit mask in which bit *i* says that rule
*i* failed. A policy is a mask of rules that reject; applying a version, or asking what a policy
would do without one of its rules, is arithmetic on the mask and reads no text again.

Everything is built-in column functions in one pass over the text, without a shuffle. Windows of
words are compared inside the row: their hashes are sorted together with their positions, so a
document costs n log n however often a window comes back.

Defined cases: a null text counts as empty (no words: it fails ``too_short``); null ids are kept
as null; repeated rows give repeated results; an empty table gives an empty result. Other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.llm.common import BREAKS, texts

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, an SQL condition over the measurements, holds."""

    name: str
    fails: str


#: Order gives the bit. All conditions are on whole numbers, so they hold alike in any engine.
RULES: tuple[Rule, ...] = (
    Rule("too_short", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("shouting", "10 * n_marks > 4 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars > 30 * n_words"),
)

#: Versions of the policy: the rules that reject.
POLICIES: Mapping[str, Sequence[str]] = {
    "1": ("too_short", "repeated_windows"),
    "2": ("too_short", "repeated_windows", "symbols", "shouting", "repeated_lines",
          "word_length"),
}
CURRENT = "2"


def bits(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The mask of the rules of these names; an unknown name is an error."""
    order = [r.name for r in rules]
    return sum(1 << order.index(n) for n in set(names))


def _chars_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _bound(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash comes more than once in the row."""
    def flagged(s: Column) -> Column:
        at = F.transform(s, lambda x, k: F.when(
            (k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"])
            | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.filter(at, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(_bound(pairs, flagged), covered)


def measurements(docs: DataFrame) -> DataFrame:
    """Per document: words, their characters, symbols, marks, lines, repeats."""
    text = F.coalesce("text", F.lit(""))
    pattern = r"[\x20\x09-\x0D]+"
    bare = F.translate(text, BREAKS, "")
    lines = F.filter(F.split(text, "\n"),
                     lambda x: F.length(F.translate(x, BREAKS, "")) > 0)
    read = texts(docs).select(
        "doc_id", F.array_remove(F.split(text, pattern), "").alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        _chars_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        _chars_of(text, "!?").cast("long").alias("n_marks"), lines.alias("lines"))
    n = F.size("words")
    w = F.col("words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))
    hashed = read.select(
        "doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_marks",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"))
    h = F.col("windows")
    repeats = F.when(h.isNotNull() & (F.size(F.array_distinct(h)) < F.size(h)), _repeat_words(h))
    return hashed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines",
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and the mask of failed rules, one row per document."""
    mask = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0))
    return measurements(docs).withColumn("failed", mask)


def apply_policy(rows: DataFrame, names: Sequence[str], out: str = "kept",
                 rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds whether a document passes all rules of the policy."""
    return rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(bits(names, rules))) == 0)


def ablations(rows: DataFrame, names: Sequence[str],
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of a policy: how many documents it fails, and how many only it rejects.

    Rows are first counted per mask; there are at most two to the number of rules of them.
    """
    policy = F.lit(bits(names, rules))
    masks = rows.groupBy(F.col("failed").bitwiseAND(policy).alias("failed")).count()
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bits([n], rules))
                                        .cast("long").alias("bit")) for n in names]))
    return (masks.select("failed", "count", each.alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("count"))
                       .otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("count"))
                       .otherwise(0)).alias("n_only_this")))
