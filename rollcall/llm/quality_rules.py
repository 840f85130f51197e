"""Quality rules: one threshold table compiled into one projection.

Counts of words, symbols, stop words and lines are built-in expressions over the row's own
text; each rule is a ratio of counts with bounds, and a document is kept if the base rules
and every rule of the table hold. There is no user function and no shuffle.

Words are runs without ASCII white space. Repeated three-word windows are found per text by
sorting the windows' hashes with their positions; neighbours count as equal only if their
words are equal too. Null text has no words: all counts are 0 and it is not kept.
Texts of any length are measured whole, repeated rows give repeated rows, an empty table an
empty one. ``measures`` reads ``doc_id`` and ``text`` only, so further columns do not clash;
``keep_good`` returns the columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
# Very common words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is that it for was on are as with he be at by this had not or from "
    "le la les de des et un une du en est que qui dans pour pas sur au par avec "
    "der die das und ein eine ist nicht von mit den dem zu auf sich für im "
    "el los las que y del una por con no se su al es para lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure, divided by another where one is named, must lie within the bounds."""

    name: str
    measure: str
    per: str | None
    least: float | None
    most: float | None

    def holds(self, of: dict[str, Column]) -> Column:
        value = of[self.measure].cast("double")
        if self.per:
            value = value / F.greatest(of[self.per].cast("double"), F.lit(1.0))
        bounds = [value >= self.least] * (self.least is not None) + [value <= self.most] * (self.most is not None)
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols to words", "n_symbols", "n_words", None, 0.3),
    Rule("stop words", "n_stop_words", "n_words", 0.005, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("unfinished lines", "n_ellipsis_lines", "n_lines", None, 0.5),
)


def words(text: Column) -> Column:
    """The words of a text; none for an empty text. Splitting on one plain character needs no regular expression."""
    blank = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACE[1:], text)
    return F.array_remove(F.split(blank, " "), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column, n: Column) -> Column:
    """Words covered by three-word windows that occur more than once.

    The upper 44 bits of a window's hash and its position in the lower 20 sort as one plain
    number. A text in which neighbours have equal upper bits but different words, or of 2^20
    words and more, sorts whole hashes with positions instead.
    """
    def same(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, [F.get(w, a + i) == F.get(w, b + i) for i in range(3)])

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def covered(positions: Column) -> Column:
        """Each start covers up to the next one, three words at most."""
        return let(
            F.sort_array(positions),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b),
        )

    every = F.sequence(F.lit(0), n - 3)
    low = (1 << 20) - 1

    def position(x: Column) -> Column:
        return x.bitwiseAND(low).cast("int")

    def by_number(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: F.shiftright(F.get(s, j).bitwiseXOR(F.get(s, j - 1)), 20) == 0)
        pairs = F.transform(ends, lambda j: F.struct(position(F.get(s, j - 1)).alias("a"), position(F.get(s, j)).alias("b")))
        return F.when(F.size(s) < 2, 0).otherwise(
            let(
                pairs,
                lambda ps: F.when(F.size(ps) == 0, 0)
                .when(F.exists(ps, lambda x: ~same(x["a"], x["b"])), F.lit(None).cast("int"))
                .otherwise(covered(F.array_distinct(F.concat(F.transform(ps, lambda x: x["a"]), F.transform(ps, lambda x: x["b"]))))),
            )
        )

    def by_struct(s: Column) -> Column:
        def twin(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & same(x["i"], y["i"]), F.lit(False))

        return covered(F.transform(F.filter(s, lambda x, j: twin(x, F.get(s, j - 1)) | twin(x, F.get(s, j + 1))), lambda x: x["i"]))

    numbers = F.sort_array(F.transform(every, lambda i: F.shiftleft(window_hash(i), 20).bitwiseOR(i.cast("long"))))
    structs = F.sort_array(F.transform(every, lambda i: F.struct(window_hash(i).alias("h"), i.alias("i"))))
    return F.when(n < 4, 0).otherwise(F.coalesce(F.when(n <= low, let(numbers, by_number)), let(structs, by_struct))).cast("long")


def measures(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and every count the rules use, and the columns ``also`` as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    # unpacked from an array of one, so that no later filter is pushed below and splits the text once per use
    rows = rows.select("*", F.explode(F.array(words(F.col("text")))).alias("words")).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def lines_where(test) -> Column:
        return F.size(F.filter("lines", test)).cast("long")

    return rows.withColumn("lines", lines).select(
        "doc_id",
        *also,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("n")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        lines_where(lambda x: x.rlike(r"^\s*[-*•‣◦]\s")).alias("n_bullet_lines"),
        lines_where(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, also: tuple[str, ...] = ()) -> DataFrame:
    """The counts, whether the base rules fail, whether the row is kept, and the rules that failed."""
    counted = measures(docs, also)
    of = {c: F.col(c) for c in counted.columns}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = reduce(lambda a, b: a & b, [rule.holds(of) for rule in rules], F.lit(True))
    names = F.filter(F.array(*[F.when(~rule.holds(of), F.lit(rule.name)) for rule in rules]), lambda x: x.isNotNull())
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict).withColumn("failed_rules", names)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all columns, without the rows that ``judge`` rejects.

    The verdict decides whether a row has a value to unpack. A plain filter on it would be
    pushed below the counts and compute them once per use.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    kept = judge(whole, rules, ("_row",)).select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return kept.filter(F.col("_row").isNotNull()).select("_row.*")
