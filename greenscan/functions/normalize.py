"""Text defence normalisers as Column functions (F1-F7) and the name registry.

``unicode`` = NFC -> ruleset characters to one space each -> collapse runs of
U+0020 -> delete control characters (category Cc). Rulesets: ``whitespaces``
(default), ``idn`` (the documented IDN blacklist characters; the reference's own
pattern does not compile, Q8) and ``ascii`` (runs of non-ASCII to one space).
All steps are regexp_replace in the JVM; NFC goes through ICU4J, which Spark ships,
and only for rows that contain non-ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from greenscan.config import FLAG_WORDS

# Characters of the "whitespaces" ruleset, as listed by the reference.
WHITESPACES_CLASS = (
    r"[\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}"
    r"\x{2060}\x{2063}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{FFA0}\x{FFF9}\x{FFFA}\x{FFFB}"
    r"\x{FE00}-\x{FE0F}\x{3164}\x{202A}-\x{202E}]"
)
# The documented IDN blacklist characters (without the surrogate part).
IDN_CLASS = (
    r"[\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{2063}"
    r"\x{FEFF}\x{FFF9}-\x{FFFB}]"
)
ASCII_RUNS = r"[^\x{0000}-\x{007F}]+"
CONTROL_CLASS = r"[\x{0000}-\x{001F}\x{007F}-\x{009F}]"
NON_ASCII = r"[^\x{0000}-\x{007F}]"

RULESETS = {"whitespaces": WHITESPACES_CLASS, "idn": IDN_CLASS, "ascii": ASCII_RUNS}


def nfc(text: Column) -> Column:
    """Unicode NFC (F2). ICU's compose is only called on rows with non-ASCII text."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text,
                         F.lit(False))
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def ruleset_to_space(text: Column, ruleset: str = "whitespaces") -> Column:
    if ruleset not in RULESETS:
        raise ValueError(f"unknown unicode ruleset: {ruleset!r}")
    chars = RULESETS[ruleset]
    if ruleset != "ascii":  # these have no ASCII character, which is told by one comparison
        chars = rf"[[^\x00-\x7F]&&{chars}]"
    return F.regexp_replace(text, chars, " ")


def collapse_spaces(text: Column) -> Column:
    """Runs of U+0020 to one (F6); other blanks are untouched."""
    return F.regexp_replace(text, " {2,}", " ")


def drop_controls(text: Column, as_space: bool = False) -> Column:
    """Delete category Cc (F7). The reference deletes, so words on adjacent lines
    join (Q6); ``as_space`` is the alternative."""
    return F.regexp_replace(text, CONTROL_CLASS, " " if as_space else "")


def unicode_sanitize(text: Column, ruleset: str = "whitespaces", cc_as_space: bool = False) -> Column:
    """The whole ``unicode`` normaliser (F1b), steps in the reference's order.
    ``cc_as_space`` turns control characters into spaces instead of deleting them
    (the reference deletes, which joins words on adjacent lines, Q6)."""
    return drop_controls(collapse_spaces(ruleset_to_space(nfc(text), ruleset)), cc_as_space)


def unicode_normalizer(ruleset: str):
    def apply(df, col: str):
        return df.withColumn(col, unicode_sanitize(F.col(col), ruleset))
    return apply


_CUSTOM: dict = {}


def register_normalizer(name: str, fn) -> None:
    """Add a normaliser (E1): ``fn`` maps a Column to a Column (built-in functions or
    a pandas_udf) and is applied as ``df.withColumn(col, fn(col))``."""
    _CUSTOM[name] = fn


def lookup(name: str):
    """Normaliser name -> ``(df, text_col) -> df`` (F1). Unknown names fail here (Q10).

    ``unicode`` variants are pure Column expressions; ``homoglyphs`` builds its
    translation tables once on the driver; ``truecase`` needs a model table and is
    applied through :func:`greenscan.operators.truecase.truecase_apply`.
    """
    if name == "unicode" or name == "unicode:whitespaces":
        return unicode_normalizer("whitespaces")
    if name == "unicode:ascii":
        return unicode_normalizer("ascii")
    if name == "unicode:idn":
        return unicode_normalizer("idn")
    if name == "homoglyphs":
        from greenscan.operators.homoglyph import canonicalize_df
        return canonicalize_df
    if name == "truecase":
        from greenscan.operators.truecase import truecase_normalizer
        return truecase_normalizer
    if name in _CUSTOM:
        fn = _CUSTOM[name]
        return lambda df, col: df.withColumn(col, fn(F.col(col)))
    raise ValueError(f"unknown normalizer: {name!r}")


def apply_chain(df, col: str, names, key: str | None = None, models: dict | None = None) -> object:
    """Fold the configured normalisers over ``col`` in order (F1). ``key`` (a unique
    row id) lets normalisers that regroup rows (truecase) avoid joining on the text;
    ``models`` gives a normaliser by name the table it was to learn from."""
    for n in names:
        if n == "truecase":
            from greenscan.operators.truecase import truecase_normalizer
            df = truecase_normalizer(df, col, key, (models or {}).get(n))
        else:
            df = lookup(n)(df, col)
    return df


def str2bool_col(v: Column) -> Column:
    """P17 on a column: yes/true/t/y/1 and no/false/f/n/0, anything else fails."""
    word = F.lower(F.trim(v.cast("string")))
    words = lambda truth: [w for w, t in FLAG_WORDS.items() if t is truth]
    return F.when(word.isin(words(True)), F.lit(True)).when(word.isin(words(False)), F.lit(False)) \
        .otherwise(F.raise_error(F.concat(F.lit("not a flag: "), word)))
