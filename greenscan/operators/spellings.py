"""Look-alike spellings on demand (F19, F20, F22): the n-th spelling of a word without the
others.

A word's lattice is one string of variants per character. Its spellings are numbered like the
digits of a mixed-radix number, the last character fastest (the order of a cartesian product),
so spelling n is computed from n alone. Enumerating a word is then a range of numbers, cut into
blocks of ``BLOCK`` and dealt over the cluster: no cell ever holds a product.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from greenscan.functions import codepoints as cps
from greenscan.functions.scripts import let
from greenscan.operators import homoglyph as hg

BLOCK = 4096
SEGMENT = 64  # spellings of neighbouring characters that are made once per word
_SEP = "\u0001"


class Variants:
    """Variants of every character of an alphabet (hop 1 and hop 2), as arrays of the plan."""

    def __init__(self, table: dict[str, str], alphabet: cps.Intervals):
        self.alphabet = alphabet
        many = {c: v for c, v in table.items() if v != c}
        self.keys = sorted(map(ord, many))
        self.values = [many[chr(k)] for k in self.keys]

    def _values(self, cp: Column, values: list[str], alone: Column, alone_of) -> Column:
        """The value of a code point, ``alone`` where it has none. ``alone_of`` gives the same of a
        plain code point: near code points take all from one array."""
        shown = F.split(F.lit(_SEP.join(values)), _SEP)
        far = F.coalesce(cps.find_sorted(cps.literal_array(self.keys, "int"), shown, cp, cps.probes(len(self.keys))), alone) \
            if self.keys else alone
        of = dict(zip(self.keys, values))
        near = [of[c] if c in of else alone_of(c) for c in range(cps.DIRECT)]
        near[ord(_SEP)] = ""  # the separator is set apart below
        return F.when(cp == ord(_SEP), alone).otherwise(cps.direct(F.split(F.lit(_SEP.join(near)), _SEP), cp, far))

    def _alone(self, cp: int, strategy: int) -> str:
        at = _first(self.alphabet, cp)
        inside = any(lo <= cp <= hi for lo, hi in self.alphabet[at:at + 1])
        return chr(cp) if strategy == hg.STRATEGY_IGNORE or inside else ""

    def of_char(self, ch: Column, strategy: int) -> Column:
        """The variants of one character, sorted, as one string. Outside the alphabet IGNORE
        gives the character itself, REMOVE (and LOAD, once nothing more can be loaded) none."""
        cp = F.ascii(ch)
        alone = ch if strategy == hg.STRATEGY_IGNORE else F.when(cps.contains(self.alphabet, cp), ch).otherwise("")
        return self._values(cp, self.values, alone, lambda c: self._alone(c, strategy))

    def lattice(self, word: Column, strategy: int = hg.STRATEGY_IGNORE) -> Column:
        """ARRAY<STRING>: the variants of each character; removed characters leave no entry."""
        return F.filter(F.transform(_chars(word), lambda c: self.of_char(c, strategy)), lambda v: v != "")

    def ascii_lattice(self, word: Column, strategy: int = hg.STRATEGY_IGNORE,
                      ascii_strategy: int = hg.STRATEGY_IGNORE, lo: int = 0, hi: int = 127) -> Column:
        """The lattice cut to the range of ``lo``..``hi`` (F22): the readings of a word there. A
        character without a variant in the range ends the readings under IGNORE (an empty
        lattice); under another ``ascii_strategy`` it is left out."""
        cut = ["".join(c for c in v if lo <= ord(c) <= hi) for v in self.values]

        def of_char(ch: Column) -> Column:
            cp = F.ascii(ch)
            alone = F.when(cp.between(lo, hi), self.of_char(ch, strategy)).otherwise("")
            gone = ~cps.contains(self.alphabet, cp)
            # a character that the strategy removes is no gap in the readings
            value = self._values(cp, cut, alone, lambda c: self._alone(c, strategy) if lo <= c <= hi else "")
            return value if strategy == hg.STRATEGY_IGNORE else F.when(~gone, value)

        lists = F.array_compact(F.transform(_chars(word), of_char))
        if ascii_strategy == hg.STRATEGY_IGNORE:
            return let(lists, lambda x: F.when(F.exists(x, lambda v: v == ""), F.array().cast("array<string>")).otherwise(x))
        return F.filter(lists, lambda v: v != "")


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


@lru_cache(maxsize=8)
def variants(spark: SparkSession, alphabet: cps.Intervals) -> Variants:
    """Characters with one skeleton are look-alikes; hop 2 adds nothing to such classes."""
    inside = lambda cp: any(lo <= cp <= hi for lo, hi in alphabet[_first(alphabet, cp):][:1])
    classes: dict[str, list[str]] = {}
    for cp, ch, skeleton, _ in hg._char_rows(spark):
        if inside(cp):
            classes.setdefault(skeleton, []).append(ch)
    return Variants({c: "".join(sorted(members)) for members in classes.values() for c in members}, alphabet)


def _first(alphabet: cps.Intervals, cp: int) -> int:
    from bisect import bisect_right
    return max(0, bisect_right(alphabet, (cp, cps.MAX_CP + 1)) - 1)


def n_spellings(lists: Column) -> Column:
    """How many spellings a lattice has; null beyond 64 bits, 0 for an empty lattice (as a
    word whose characters are all removed)."""
    count = F.aggregate(F.transform(lists, lambda v: F.char_length(v).cast("bigint")), F.lit(1).cast("bigint"),
                        lambda a, x: F.try_multiply(a, x))
    return F.when(F.size(lists) == 0, F.lit(0).cast("bigint")).otherwise(count)


def segments(lists: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: neighbouring characters of a lattice taken together while they have at
    most ``SEGMENT`` spellings, each with its spellings in order."""
    none = F.array().cast("array<array<string>>")
    start = F.struct(none.alias("done"), F.array(F.lit("")).alias("now"))

    def longer(s: Column, v: Column) -> Column:
        fits = F.size(s["now"]) * F.char_length(v) <= SEGMENT
        before = F.when(fits, s["now"]).otherwise(F.array(F.lit("")))
        grown = F.when(F.char_length(v) == 1, F.transform(before, lambda p: F.concat(p, v))).otherwise(
            F.flatten(F.transform(before, lambda p: F.transform(_chars(v), lambda c: F.concat(p, c)))))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), grown.alias("now"))

    cut = F.aggregate(lists, start, longer, lambda s: F.concat(s["done"], F.array(s["now"])))
    return F.when(F.forall(lists, lambda v: F.char_length(v) == 1), F.array(F.array(F.array_join(lists, "")))).otherwise(cut)


def nth_of_segments(parts: Column, n: Column) -> Column:
    """Spelling ``n`` (from 0), by its digits from the last segment up."""
    start = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def digit(s: Column, part: Column) -> Column:
        size = F.size(part).cast("bigint")
        return F.struct(F.call_function("div", s["rest"], size).alias("rest"),
                        F.concat(F.get(part, (s["rest"] % size).cast("int")), s["out"]).alias("out"))

    return F.when(F.size(parts) == 1, F.get(F.get(parts, F.lit(0)), n.cast("int"))).otherwise(
        F.aggregate(F.reverse(parts), start, digit, lambda s: s["out"]))


def nth_spelling(lists: Column, n: Column) -> Column:
    """Spelling ``n`` (from 0) of a lattice, by its digits from the last character up."""
    start = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def digit(s: Column, v: Column) -> Column:
        size = F.char_length(v).cast("bigint")
        at = (s["rest"] % size + 1).cast("int")
        return F.struct(F.call_function("div", s["rest"], size).alias("rest"),
                        F.concat(F.substring(v, at, F.lit(1)), s["out"]).alias("out"))

    return F.aggregate(F.reverse(lists), start, digit, lambda s: s["out"])


def spelling_rows(lattices: DataFrame, lists_col: str, keep: list[str]) -> DataFrame:
    """(keep..., n, spelling): every spelling of every lattice, one row each. Ranges of numbers
    are cut level by level into blocks; blocks of large words are dealt over the cluster.
    Words with more spellings than 64 bits can count are refused when they are reached."""
    # a generator is a barrier: the lattice is built once and read by name from here on
    lattices = lattices.select(*keep, F.explode(F.array(lists_col)).alias("_l")) \
        .select(*keep, F.explode(F.array(F.struct(n_spellings(F.col("_l")).alias("n"), segments(F.col("_l")).alias("parts")))).alias("_v")) \
        .select(*keep, F.col("_v.n").alias("_n"), F.col("_v.parts").alias("_parts"))
    n = F.col("_n")
    total = F.when(n.isNull(), F.raise_error(F.lit("a word with more than 2^63 spellings")).cast("bigint")).otherwise(n)
    rows = lattices.select(*keep, "_parts", F.lit(0).cast("bigint").alias("_lo"), total.alias("_hi")).where("_hi > 0")
    width = BLOCK ** 4
    while width >= 1:
        # an interval [lo, hi) of at most BLOCK * width numbers gives at most BLOCK parts
        step = F.lit(width).cast("bigint")
        parts = F.sequence(F.col("_lo"), F.col("_hi") - 1, step)
        rows = rows.withColumn("_lo2", F.explode(parts)) \
            .withColumn("_hi", F.least(F.col("_hi"), F.col("_lo2") + width)).drop("_lo").withColumnRenamed("_lo2", "_lo")
        if width == BLOCK:  # blocks of a word with many spellings part here
            rows = rows.repartition(*keep, "_lo")
        width //= BLOCK
    return rows.select(*keep, F.col("_lo").alias("n"), nth_of_segments(F.col("_parts"), F.col("_lo")).alias("spelling"))


__all__ = ["Variants", "n_spellings", "nth_of_segments", "nth_spelling", "segments", "spelling_rows", "variants"]
