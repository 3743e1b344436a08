"""Quality rules as a ledger: every rule is evaluated once, verdicts and ablations come from its bits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import let, words

#: Characters that prose hardly uses (fixed by the contract).
SYMBOLS = "#*$%&|<>"

#: Rules by bit, lowest first. A rule fails where its condition holds over the measurements ``m``.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "exclamations": lambda m: 10 * m["n_exclamations"] > 5 * m["n_words"],
    "capitals": lambda m: 100 * m["n_capitals"] > 50 * m["n_words"],
    "repeated_lines": lambda m: (100 * m["n_dup_lines"] > 50 * m["n_lines"]) & (m["n_dup_lines"] >= 3),
    "long_words": lambda m: m["word_chars"] > 14 * m["n_words"],
    "short_words": lambda m: 10 * m["word_chars"] < 22 * m["n_words"],
}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: any failure in ``hard`` rejects, or more than ``allowed`` in ``soft``."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    allowed: int = 0

    def mask(self, names: tuple[str, ...]) -> int:
        return sum(1 << list(RULES).index(name) for name in names)

    def keeps(self, bits: Column) -> Column:
        soft = F.bit_count(bits.bitwiseAND(self.mask(self.soft)))
        return (bits.bitwiseAND(self.mask(self.hard)) == 0) & (soft <= self.allowed)


#: The base conditions alone, and the production policy.
BASE = Policy("base", ("few_words", "repeated_words"))
PRODUCTION = Policy("2", ("few_words", "repeated_words", "symbols", "exclamations", "repeated_lines"), ("capitals", "long_words", "short_words"), 1)


def _occurrences(text: Column, characters: str) -> Column:
    """How often single-byte characters occur: what a text loses when they are taken out."""
    bare = text
    for character in characters:
        bare = F.replace(bare, F.lit(character), F.lit(""))
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more among ``w``.

    Windows are sorted as numbers made of a hash and a position; neighbours in that order are compared
    word by word, so equal hashes alone never count. All of it stays inside the row.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")),
    )

    def starts(s: Column) -> Column:
        def at(k: Column) -> Column:
            return F.get(s, k).bitwiseAND(mask).cast("int")

        def equal(k: Column) -> Column:
            same = F.call_function("shiftright", F.get(s, k), bits) == F.call_function("shiftright", F.get(s, k - 1), bits)
            for step in range(3):
                same = same & (F.get(w, at(k) + step) == F.get(w, at(k - 1) + step))
            return same

        found = F.filter(F.sequence(F.lit(1), F.size(s) - 1), equal)
        both = F.flatten(F.transform(found, lambda k: F.array(at(k), at(k - 1))))
        return F.when(F.size(s) > 1, F.sort_array(F.array_distinct(both))).otherwise(F.array().cast("array<int>"))

    def covered(p: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
        more = F.when(F.size(p) > 1, F.aggregate(steps, F.lit(3), lambda total, x: total + x))
        return F.coalesce(more, F.when(F.size(p) == 1, 3), F.lit(0))

    counted = let(F.sort_array(packed), lambda s: let(starts(s), covered))
    return F.when(n >= 3, counted).otherwise(0).cast("long")


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct, from one split into words and one into lines."""

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("dup"))

    def of(w: Column) -> Column:
        with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
        return let(
            let(with_word, lines),
            lambda line: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _occurrences(text, SYMBOLS).alias("n_symbols"),
                line["n"].alias("n_lines"),
                line["dup"].alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                _occurrences(text, "!").alias("n_exclamations"),
                F.regexp_count(text, F.lit(r"\p{Lu}{3,}")).cast("long").alias("n_capitals"),
            ),
        )

    return let(words(text), of)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_capitals")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, columns of ``keep``, the measurements and ``bits`` (bit k: rule k failed).

    Null text counts as empty: no words, so ``few_words`` fails. Repeated rows and null ids give rows of
    their own, an empty table an empty ledger. Columns not named are not read, so their names cannot
    clash; names in ``keep`` must differ from the ledger's own. Works row by row, without a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    measured = docs.select(F.col(id_col), *keep, F.explode(F.array(measurements(text))).alias("m"))
    return measured.select(id_col, *keep, "m.*", failure_bits(F.col("m")).alias("bits"))


def failure_bits(m: Column) -> Column:
    """Bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for bit, fails in enumerate(RULES.values()):
        bits = bits + F.when(fails(m), F.lit(1 << bit)).otherwise(0).cast("long")
    return bits


def verdicts(entries: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a boolean column ``kept_<version>`` for each policy."""
    return entries.withColumns({f"kept_{p.version}": p.keeps(F.col("bits")) for p in policies})


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: how many rows fail it, and how many the policy would keep without it.

    Rows are counted by their bits first, so at most one row per combination of rules is shuffled on.
    """
    counted = entries.groupBy("bits").agg(F.count("*").alias("n_rows"))
    names = policy.hard + policy.soft
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(policy.mask((name,))).cast("long").alias("bit")) for name in names]))
    each = counted.select("bits", "n_rows", rules.alias("r")).select("bits", "n_rows", "r.*")
    without = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    gained = policy.keeps(without) & ~policy.keeps(F.col("bits"))
    return each.groupBy("rule").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n_rows")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(policy.keeps(F.col("bits")), F.col("n_rows")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(gained, F.col("n_rows")).otherwise(0)).alias("n_kept_more_without"),
        F.bit_or(F.when(gained, F.col("bits")).otherwise(0)).alias("bits_involved"),
    )


def passing(docs: DataFrame, policy: Policy = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the policy keeps."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.filter(let(let(measurements(text), failure_bits), policy.keeps))
