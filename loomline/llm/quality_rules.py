"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a count taken from the whole text with DataFrame functions; every rule
bounds one count by a share of another. No shuffle and no Python run: the cost is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is a that it with for on was as are be this by an from or at not "
    "le la les de des du et un une est que qui en dans pour pas sur par au avec "
    "der die das und ein eine ist den dem von zu mit im für auf nicht sich des "
    "el los las del y se con una su al lo como por para no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where count is over (or, with below, under) share of the base count."""

    name: str
    count: str
    share: float
    of: str
    below: bool = False

    def fails(self) -> Column:
        bound = F.lit(self.share) * F.col(self.of)
        return F.col(self.count) < bound if self.below else F.col(self.count) > bound


#: The measures that rules may name besides the base counts: n_stop, n_shout, n_lines, n_open_lines, one.
RULES = (
    Rule("words_too_short", "word_chars", 2.0, "n_words", below=True),
    Rule("words_too_long", "word_chars", 14.0, "n_words"),
    Rule("symbols", "n_symbols", 0.1, "n_words"),
    Rule("shouting", "n_shout", 0.2, "n_words"),
    Rule("stop_words", "n_stop", 0.02, "n_words", below=True),
    Rule("repeated_lines", "n_dup_lines", 0.5, "n_lines"),
    Rule("open_lines", "n_open_lines", 0.5, "n_lines"),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_window_words(w: Column) -> Column:
    """Words of the array w in 3-word windows that occur twice or more, the first included.

    Most texts have no two windows of equal hash and are done. In the others, windows are compared by
    33 bits of the hash packed with their position into one long, as sorting longs is cheap; only
    those that meet are compared word by word, so the count is exact.
    """
    low = (1 << 31) - 1
    hashes = F.when(
        F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def meets(s):
        return F.filter(s, lambda x, i: (F.shiftright(F.get(s, i - 1), 31) == F.shiftright(x, 31)) | (F.shiftright(F.get(s, i + 1), 31) == F.shiftright(x, 31)))

    def spelled(found):
        def one(x):
            p = x.bitwiseAND(F.lit(low)).cast("int")
            return F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p"))

        return F.sort_array(F.transform(found, one))

    def same(x, y):
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def twice(s):
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["p"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = lambda at: F.aggregate(at, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def counted(h):
        keys = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(let(let(let(F.sort_array(keys), meets), spelled), twice)))

    return let(hashes, counted)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one struct column `_q` of counts; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = [*STOP_WORDS, *(x.capitalize() for x in STOP_WORDS)]

    def counts(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop"),
            repeated_window_words(w).alias("n_repeat_words"),
        )

    def of_lines(x):
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.endswith("...") | y.endswith("…"))).cast("long").alias("n_open_lines"),
        )

    shout = F.when(body.contains("!!"), F.regexp_count(body, F.lit(r"\p{Lu}[^\x20\x09-\x0D\p{Ll}]*!!"))).otherwise(0).cast("long")
    every = F.struct(let(words(body), counts).alias("w"), let(worded, of_lines).alias("l"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("symbols"), shout.alias("shout"))
    # exploded from an array of one: a filter on a measure then stays above it, else each filter would count anew
    return docs.select("*", F.explode(F.array(every)).alias("_q"))


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs with column `quality`: the counts, base_failed, failed (names of rules) and kept.

    A null or empty text has no words and so fails the base. Rows are judged one by one: repeated
    rows get equal verdicts, an empty table gives an empty one, and a column called quality is replaced.
    """
    plain = [F.col(f"d.`{c}`") for c in docs.columns if c != "quality"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(f"`{text}`").alias("_text"))
    m = measures(packed, "_text").select(
        "d",
        *(F.col(f"_q.w.{c}") for c in ("n_words", "word_chars", "n_stop", "n_repeat_words")),
        *(F.col(f"_q.l.{c}") for c in ("n_lines", "n_dup_lines", "n_open_lines")),
        F.col("_q.symbols").alias("n_symbols"),
        F.col("_q.shout").alias("n_shout"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in rules)))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_shout", "n_lines", "n_open_lines"]
    judged = F.struct(*counts, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
    return m.select(*plain, judged.alias("quality"))
