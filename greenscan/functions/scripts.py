"""Script of characters and the majority vote over a text.

Scripts of characters come from a sorted interval table by binary search, once per distinct
character; only scripts that occur are then counted, by one regex pass each, all inside the
JVM. The vote follows the reference: most characters wins, the script
seen first wins a tie; COMMON and INHERITED (spaces, digits, punctuation, marks)
only win when nothing else is present (Q14).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from greenscan.functions.codepoints import script_table

# The scripts of the largest alphabets; the vote counts every script (see all_scripts).
VOTE_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "HAN")
NEUTRAL_SCRIPTS = ("COMMON", "INHERITED")


@lru_cache(maxsize=1)
def all_scripts() -> tuple[str, ...]:
    """Every script that the JVM's Unicode tables name, neutral ones left out."""
    jvm = SparkSession.active().sparkContext._jvm
    names = (str(s) for s in jvm.java.lang.Character.UnicodeScript.values())
    return tuple(s for s in names if s not in (*NEUTRAL_SCRIPTS, "UNKNOWN"))


def java_class(script: str) -> str:
    return r"\p{Is" + script + "}"


def re2_class(script: str) -> str:
    return r"\p{" + script.capitalize() + "}"


def script_count(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(java_class(script))).cast("bigint")


def others_left(text: Column, runs: str | Column) -> Column:
    """The text without the runs that the pattern ``runs`` matches."""
    return F.regexp_replace(text, F.lit(runs), F.lit(""))


def class_count(text: Column, runs: str | Column) -> Column:
    """Characters of ``text`` in ``runs``, a pattern of runs of a character class. For classes
    that most characters are in: no array of them is made."""
    return (F.char_length(text) - F.char_length(others_left(text, runs))).cast("bigint")


def first_pos(text: Column, script: str) -> Column:
    """1-based position of the first character of ``script`` (0 when absent)."""
    return F.regexp_instr(text, F.lit(java_class(script)))


def script_of_char(ch: Column, scripts=None) -> Column:
    """Script name of a one-character string (null when outside the list or unassigned)."""
    name = script_table(SparkSession.active()).lookup(F.ascii(ch))
    return name if scripts is None else let(name, lambda n: F.when(n.isin(list(scripts)), n))


NOT_FOREIGN = r"[\p{IsLatin}\p{IsCommon}\p{IsInherited}]"


ASCII_RUNS, ASCII_LETTERS = r"[\x00-\x7F]+", "[A-Za-z]+"


def beyond_ascii(text: Column) -> Column:
    """The text without its ASCII characters, of which letters are LATIN and all others COMMON."""
    return others_left(text, ASCII_RUNS)


def fast_count(text: Column, script: str, high: Column | None = None) -> Column:
    """Characters of ``script`` in ``text``. ASCII is counted by a bit table, scripts are looked up
    in the rest; runs are taken out and lengths compared, so no array of characters is made.
    ``high``: the text without its ASCII characters, where it is at hand."""
    high = beyond_ascii(text) if high is None else high
    n = class_count(high, java_class(script) + "+")
    letters = class_count(text, ASCII_LETTERS)
    if script == "LATIN":
        return n + letters
    if script == "COMMON":
        return n + (F.char_length(text) - F.char_length(high)).cast("bigint") - letters
    return n


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and used by name: a one-element array
    gives it to a lambda, so the plan does not repeat its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vote(text: Column, scripts=None) -> Column:
    """Target script of a text: max count, first seen wins ties; COMMON when no
    script occurs. Returns a STRING column. All scripts are counted unless ``scripts`` names
    some.

    A text without characters outside LATIN/COMMON/INHERITED is LATIN or COMMON. In the others,
    the script of the first foreign character is counted and taken out by one scan; what is left
    is looked up, once per distinct character, and the scripts found there are counted in it."""
    scripts = all_scripts() if scripts is None else scripts
    others = [s for s in scripts if s != "LATIN"]
    latin = "LATIN" in scripts
    only_latin = F.lit("LATIN") if latin else F.lit("COMMON")
    runs = lambda s: F.concat(F.lit(r"\p{Is"), s, F.lit("}+"))

    def ranked(foreign: Column) -> Column:
        """The scripts of the foreign characters: how many, minus the place of the first, name."""
        one = lambda rest, s: F.struct(
            class_count(rest, runs(s)).alias("n"), (-F.regexp_instr(foreign, runs(s))).alias("first"), s.alias("script"))

        def both(first: Column) -> Column:
            left = F.when(first.isNull(), foreign).otherwise(others_left(foreign, runs(first)))
            return let(left, lambda rest: F.concat(
                F.when(first.isNull(), F.array()).otherwise(F.array(one(foreign, first))),
                F.transform(F.array_compact(F.array_distinct(F.transform(F.array_distinct(F.filter(
                    F.split(rest, ""), lambda c: c != "")), lambda c: script_of_char(c, others)))), lambda s: one(rest, s))))

        return let(script_of_char(F.substring(foreign, 1, 1), others), both)

    def decide(best: Column, high: Column) -> Column:
        if not latin:
            return F.coalesce(best["script"], F.lit("COMMON"))
        return let(fast_count(text, "LATIN", high), lambda n_latin: F.when(
            best.isNull() & (n_latin == 0), F.lit("COMMON")).when(
            best.isNull() | (best["n"] < n_latin), F.lit("LATIN"))
            .when((best["n"] == n_latin) & (first_pos(text, "LATIN") < F.regexp_instr(text, runs(best["script"]))), F.lit("LATIN"))
            .otherwise(best["script"]))

    voted = let(beyond_ascii(text), lambda high: let(others_left(high, NOT_FOREIGN + "+"), lambda foreign: F.when(
        foreign != "", let(F.array_max(ranked(foreign)), lambda best: decide(best, high)))))
    return F.coalesce(voted, F.when(text.rlike(java_class("LATIN")), only_latin).when(text.isNotNull(), F.lit("COMMON")))


def scripts_present(text: Column, scripts=None) -> Column:
    """The scripts that occur in a text, in list order (A13): one lookup per distinct
    character."""
    scripts = all_scripts() + NEUTRAL_SCRIPTS if scripts is None else scripts
    names = F.array_distinct(F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", script_of_char(c))))
    return F.when(text.isNotNull(), let(names, lambda found: F.filter(
        F.split(F.lit(",".join(scripts)), ","), lambda s: F.array_contains(found, s))))
