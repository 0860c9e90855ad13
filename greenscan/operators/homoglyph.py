"""Homoglyph tables, canonicalisation and variants (S8-S10, F8-F10, F18-F22,
J5-J7, J9, J10, A13, A15-A17, U2-U5, T2).

The reference reads three JSON files that its checkout lacks. We derive the same
kind of tables from public Unicode data that Spark already ships (ICU4J):

* script of a character: the JVM's script of every code point, as an interval table;
* confusables: characters with the same UTS #39 skeleton (``SpoofChecker.getSkeleton``),
  of whatever length, are look-alikes.

The character table is a fixed-size dimension (every assigned code point, about 150k
rows) computed once per session on the driver, then used as a broadcast table or as
literal ``translate`` maps. Nothing in it grows with the data.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.functions import codepoints as cps
from greenscan.functions.codepoints import IntervalTable, script_table
from greenscan.functions.scripts import NEUTRAL_SCRIPTS, all_scripts, let, others_left, vote

STRATEGY_LOAD, STRATEGY_IGNORE, STRATEGY_REMOVE = 1, 2, 3
_SEP = "\u0001"  # its own skeleton; separates characters in one ICU call


def _skeletons(spark: SparkSession, chars: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = []
    step = 2000
    for i in range(0, len(chars), step):
        chunk = chars[i:i + step]
        sk = checker.getSkeleton(_SEP.join(chunk)).split(_SEP)
        if len(sk) != len(chunk):  # fall back to one call per character
            sk = [checker.getSkeleton(c) for c in chunk]
        out.extend(sk)
    return out


@lru_cache(maxsize=4)
def _char_rows(spark: SparkSession) -> tuple:
    """(cp, ch, skeleton, script) for every assigned code point above the controls and the
    blank, built on the driver from ICU (skeletons) and the script table; no data
    involved, about 150,000 rows whatever the corpus holds."""
    chars = [c for c in map(chr, range(0x21, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Cc")]
    sk = _skeletons(spark, chars)
    table = script_table(spark)
    return tuple((ord(c), c, s, table.find(ord(c)) or "OTHER") for c, s in zip(chars, sk))


@lru_cache(maxsize=4)
def char_table(spark: SparkSession) -> DataFrame:
    """(cp INT, ch STRING, skel STRING, script STRING): the character dimension, a fixed
    ~150k rows, cached once per session."""
    schema = T.StructType([T.StructField("cp", T.IntegerType()), T.StructField("ch", T.StringType()),
                           T.StructField("skel", T.StringType()), T.StructField("script", T.StringType())])
    return spark.createDataFrame(list(_char_rows(spark)), schema).cache()


def confusables(spark: SparkSession) -> DataFrame:
    """(ch, alt): pairs of distinct characters with the same skeleton, of any length.
    Self join on the skeleton of a fixed-size table."""
    t = char_table(spark)
    a = t.select(F.col("ch"), F.col("cp"), F.col("skel"), F.col("script"))
    b = t.select(F.col("ch").alias("alt"), F.col("cp").alias("alt_cp"), F.col("skel").alias("s2"),
                 F.col("script").alias("alt_script"))
    # equal skeletons = one look-alike class (an ASCII letter is its own skeleton)
    pairs = a.join(b, a["skel"] == b["s2"])
    return pairs.where(F.col("ch") != F.col("alt")).select("ch", "cp", "script", "alt", "alt_cp", "alt_script") \
        .distinct()


def alphabet_intervals(spark: SparkSession, categories=None, languages=None, chars=None,
                       table: dict | DataFrame | None = None) -> cps.Intervals:
    """Union of category alphabets, language alphabets and explicit chars as an interval set
    (U2, S10); LATIN + COMMON when nothing is given. ``table`` is a user's language table: a
    dict (replaces or extends the shipped one) or a (lang, ch) DataFrame (replaces it). Unknown
    categories and languages are refused."""
    if not categories and not languages and not chars:
        categories = ("LATIN", "COMMON")
    parts = [cps.of_chars(chars or ())]
    if categories:
        check_categories(categories)
        parts.append(tuple((lo, hi) for lo, hi, name in script_table(spark).ranges() if name in set(categories)))
    if languages:
        letters = language_letters(table)
        for lang in languages:
            if lang not in letters:
                raise ValueError(f"no alphabet for language {lang!r}")
            parts.append(cps.of_chars(letters[lang]))
    return cps.union(*parts)


MAX_LETTERS = 200_000  # rows of a user's (lang, ch) table


def language_letters(table: dict | DataFrame | None = None) -> dict[str, set[str]]:
    """Language -> its letters in both cases, from the shipped table and a user's."""
    if isinstance(table, DataFrame):
        rows = table.select("lang", "ch").distinct().limit(MAX_LETTERS + 1).collect()
        if len(rows) > MAX_LETTERS:
            raise ValueError(f"a language table of more than {MAX_LETTERS} rows")
        out: dict[str, set[str]] = {}
        for r in rows:
            out.setdefault(r["lang"], set()).add(r["ch"])
        return out
    known = {**{k: ASCII_LOWER + v for k, v in LANGUAGE_EXTRA.items()}, **(table or {})}
    return {lang: set(letters) | set("".join(letters).upper()) for lang, letters in known.items()}


def alphabet(spark: SparkSession, categories=None, languages=None, chars=None,
             table: dict | DataFrame | None = None) -> DataFrame:
    """Union of category alphabets, language alphabets and explicit chars (U2);
    LATIN + COMMON when nothing is given. Unknown names fail here (S8, A16b)."""
    if not categories and not languages and not chars:
        categories = ("LATIN", "COMMON")
    parts = []
    known = set(all_scripts()) | set(NEUTRAL_SCRIPTS)
    if categories:
        for c in categories:
            if c not in known:
                raise ValueError(f"no such script: {c}")
        parts.append(char_table(spark).where(F.col("script").isin(list(categories))).select("ch"))
    if languages:
        parts.append(language_alphabet(spark, languages, table))
    if chars:
        parts.append(spark.createDataFrame([(c,) for c in chars], "ch string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


# Letters of the four test languages beyond ASCII a-z (the reference's
# language table is missing from its checkout; this is a small stand-in, S10).
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
LANGUAGE_EXTRA = {
    "en": "",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "de": "äöüß",
    "es": "áéíñóúü",
}


def language_table(spark: SparkSession, extra: dict | None = None) -> DataFrame:
    """(lang, ch): upper and lower case letters by language (S10). ``extra`` maps language
    codes to their letters and replaces or extends the shipped table."""
    rows = sorted((lang, c) for lang, letters in language_letters(extra).items() for c in letters)
    return spark.createDataFrame(rows, "lang string, ch string")


def language_alphabet(spark: SparkSession, languages, table: DataFrame | None = None) -> DataFrame:
    """(ch) for the given languages, upper and lower case (A16b); ``table`` (lang, ch) is a
    user's own language table. Names that the table lacks are refused."""
    letters = language_letters(table)
    for lang in languages:
        if lang not in letters:
            raise ValueError(f"no alphabet for language {lang!r}")
    chars = sorted({c for lang in languages for c in letters[lang]})
    return spark.createDataFrame([(c,) for c in chars], "ch string")


def languages_of_chars(chars: DataFrame, spark: SparkSession, char_col: str = "ch",
                       table: DataFrame | None = None) -> DataFrame:
    """Char -> set of languages whose alphabet holds it."""
    la = (language_table(spark) if table is None else table).select("lang", F.col("ch").alias("lch"))
    j = chars.join(la, chars[char_col] == la["lch"])
    return j.groupBy(char_col).agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def language_bits(table: dict | DataFrame | None = None) -> tuple[list[str], dict[str, int]]:
    """The languages in order, and per letter the bitmap of the languages whose alphabet holds
    it (J9, A17). At most 62 languages fit one BIGINT."""
    letters = language_letters(table)
    names = sorted(letters)
    if len(names) > 62:
        raise ValueError("more than 62 languages")
    bits: dict[str, int] = {}
    for i, lang in enumerate(names):
        for c in letters[lang]:
            bits[c] = bits.get(c, 0) | 1 << i
    return names, bits


def text_languages(text: Column, table: dict | DataFrame | None = None) -> tuple[Column, Column]:
    """(languages whose alphabet holds every letter of the text, languages that hold one of
    them), sorted arrays: the bitmaps of its distinct letters joined bit by bit. A text without
    letters is possible in every language and shows none; null gives null."""
    names, bits = language_bits(table)
    keys = sorted((ord(c), c) for c in bits if len(c) == 1)
    # letters of every alphabet change no bitmap but that of some; one scan that stops at the
    # first of them tells it, and only the letters left by them are taken apart
    all_bits = (1 << len(names)) - 1
    plain = cps.of_chars(c for _, c in keys if bits[c] == all_bits and unicodedata.category(c)[0] == "L") if names else ()
    rest = others_left(text, rf"[\P{{L}}{cps.regex_class(plain)}]+" if plain else r"\P{L}+")
    letters = F.filter(F.array_distinct(F.split(rest, "")), lambda c: c.rlike(r"\p{L}"))
    if keys:
        masks = F.transform(letters, lambda c: F.coalesce(cps.find_sorted(
            cps.literal_array([k for k, _ in keys], "int"), cps.literal_array([bits[c] for _, c in keys], "bigint"),
            F.ascii(c), cps.probes(len(keys))), F.lit(0).cast("bigint")))
    else:
        masks = F.transform(letters, lambda c: F.lit(0).cast("bigint"))
    full, none = F.lit(all_bits).cast("bigint"), F.lit(0).cast("bigint")
    shared = F.when(text.rlike(cps.regex_class(plain)), full).otherwise(none) if plain else none
    both = let(masks, lambda m: F.struct(
        F.aggregate(m, full, lambda a, x: a.bitwiseAND(x)).alias("every"),
        F.aggregate(m, shared, lambda a, x: a.bitwiseOR(x)).alias("some")))

    def shown(mask: Column) -> Column:
        each = [F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(n)) for i, n in enumerate(names)]
        return F.when(text.isNotNull(), F.array_compact(F.array(*each)) if each else F.array().cast("array<string>"))

    return shown(both["every"]), shown(both["some"])


def restricted_table(spark: SparkSession, source: DataFrame, target: DataFrame) -> DataFrame:
    """Confusables whose char is in ``source`` and alternative in ``target``."""
    conf = confusables(spark)
    return conf.join(source.select("ch"), "ch", "left_semi") \
        .join(target.select(F.col("ch").alias("alt")), "alt", "left_semi")


@lru_cache(maxsize=4)
def canon_maps(spark: SparkSession) -> dict:
    """target script -> (from_chars, to_chars) for ``translate``.

    Characters outside the target script and outside COMMON/INHERITED map to a
    look-alike (same skeleton) in the target script, or in COMMON when the target has
    none; several candidates -> the smallest code point (ASCII first, Q13). Characters
    without one are kept (Q11). Every script with look-alikes has a map; "COMMON" serves
    the others. Computed on the driver from the fixed character dimension.
    """
    by_skel: dict = {}
    for cp, ch, skel, script in _char_rows(spark):
        by_skel.setdefault(skel, []).append((cp, ch, script))
    classes = [sorted(c) for c in by_skel.values() if len(c) > 1]
    targets = {script for c in classes for _, _, script in c if script not in (*NEUTRAL_SCRIPTS, "OTHER")}
    maps: dict = {t: ([], []) for t in [*sorted(targets), "COMMON"]}
    for members in classes:
        first: dict = {}
        for _, ch, script in members:
            first.setdefault(script, ch)
        for _, ch, script in members:
            if script in NEUTRAL_SCRIPTS:
                continue
            for target, (src, dst) in maps.items():
                alt = first.get(target) if target in first else first.get("COMMON")
                if script != target and alt is not None and alt != ch:
                    src.append(ch)
                    dst.append(alt)
    return {t: ("".join(src), "".join(dst)) for t, (src, dst) in maps.items()}


def canonicalize(text: Column, spark: SparkSession, target: Column | None = None) -> Column:
    """Rewrite look-alike characters into the text's majority script."""
    maps = dict(canon_maps(spark))
    common = maps.pop("COMMON")

    def rewritten(t: Column) -> Column:
        expr = F.when(t.isin("COMMON", "INHERITED"), text)  # nothing to rewrite into
        for script, (src, dst) in maps.items():
            expr = expr.when(t == F.lit(script), F.translate(text, src, dst))
        return expr.otherwise(F.translate(text, *common))

    return let(vote(text) if target is None else target, rewritten)


def canonicalize_df(df: DataFrame, col: str) -> DataFrame:
    """Normaliser form: ``homoglyphs`` in a detection chain."""
    spark = df.sparkSession
    return df.withColumn(col, canonicalize(F.col(col), spark))


# ------------------------------------------------------------------- variants

def variant_table(spark: SparkSession, alphabet_df: DataFrame | None = None,
                  strategy: int = STRATEGY_IGNORE) -> DataFrame:
    """char -> sorted variants within the alphabet, hop 1 and hop 2.

    ``strategy`` for characters outside the alphabet: IGNORE keeps the character
    alone, REMOVE drops it (empty list); LOAD is applied by :func:`word_variants`,
    which extends the alphabet by the scripts present before building this table.
    """
    if strategy not in (STRATEGY_LOAD, STRATEGY_IGNORE, STRATEGY_REMOVE):
        raise ValueError(f"no such strategy: {strategy}")
    alpha = alphabet(spark) if alphabet_df is None else alphabet_df.select("ch").distinct()
    conf = confusables(spark).select("ch", "alt")
    t1 = conf.join(alpha.select("ch"), "ch", "left_semi") \
        .join(alpha.select(F.col("ch").alias("alt")), "alt", "left_semi")
    hop2 = t1.alias("a").join(t1.alias("b"), F.col("a.alt") == F.col("b.ch")) \
        .select(F.col("a.ch").alias("ch"), F.col("b.alt").alias("alt"))
    # every character of the alphabet is a variant of itself, with look-alikes or without
    allv = t1.union(hop2).union(alpha.select("ch", F.col("ch").alias("alt"))).distinct()
    grouped = allv.groupBy("ch").agg(F.collect_set("alt").alias("v"))
    # sort by (-length, value): all entries are single characters here
    return grouped.select("ch", F.array_sort("v").alias("variants"), F.lit(True).alias("in_alphabet"))


def intervals_of(alphabet_df: DataFrame) -> cps.Intervals:
    """An alphabet (ch) as an interval set; it has at most as many rows as Unicode has
    characters."""
    return cps.of_chars(r["ch"] for r in alphabet_df.select("ch").where("length(ch) = 1").distinct().collect())


def loaded_alphabet(words: DataFrame, word_col: str, base: cps.Intervals,
                    languages: dict | DataFrame | None = None) -> cps.Intervals:
    """LOAD (F21), made order-free: characters of the words outside the alphabet extend it,
    first by the alphabets of all languages that hold them, else by their script. The distinct
    characters outside (no more than Unicode has) come to the driver."""
    spark = words.sparkSession
    chars = words.select(F.explode(F.array_distinct(F.split(word_col, ""))).alias("ch")).where("ch <> ''")
    unknown = [r["ch"] for r in chars.where(~cps.contains(base, F.ascii("ch"))).distinct().collect()]
    letters, table = language_letters(languages), script_table(spark)
    spoken = {lang for lang, known in letters.items() if any(c in known for c in unknown)}
    heard = {c for lang in spoken for c in letters[lang]}
    names = {table.find(ord(c)) for c in unknown if c not in heard}
    return cps.union(base, cps.of_chars(heard), ((lo, hi) for lo, hi, name in table.ranges() if name in names))


def word_variants(words: DataFrame, word_col: str, spark: SparkSession,
                  alphabet_df: DataFrame | None = None, strategy: int = STRATEGY_IGNORE,
                  languages: dict | DataFrame | None = None) -> DataFrame:
    """Per word: the variant lattice (the sorted variants of each character, separated by
    blanks), the number of spellings it encodes, and the number of ASCII spellings (F19, F20,
    F22), computed in the word's row.

    The cartesian product itself is exponential in the word length; the lattice
    represents it exactly, and :mod:`greenscan.operators.spellings` gives the n-th spelling.
    A word whose characters are all removed keeps its row, with no spelling.
    """
    from greenscan.operators import spellings as sp
    if strategy not in (STRATEGY_LOAD, STRATEGY_IGNORE, STRATEGY_REMOVE):
        raise ValueError(f"no such strategy: {strategy}")
    base = alphabet_intervals(spark) if alphabet_df is None else intervals_of(alphabet_df)
    if strategy == STRATEGY_LOAD:
        base = loaded_alphabet(words, word_col, base, languages)
    table = sp.variants(spark, base)
    rows = words.select(word_col, F.explode(F.array(F.struct(
        table.lattice(F.col(word_col), strategy).alias("l"), table.ascii_lattice(F.col(word_col), strategy).alias("a")))).alias("_v"))
    count = lambda lists: F.when(F.size(lists) == 0, F.lit(0.0)).otherwise(F.aggregate(
        lists, F.lit(1.0), lambda n, v: n * F.char_length(v).cast("double")))
    return rows.select(word_col, F.array_join("_v.l", " ").alias("lattice"), count(F.col("_v.l")).alias("n_variants"),
                       count(F.col("_v.a")).alias("n_ascii"))


def expand_variants(lattice_rows: DataFrame, key: str, lists_col: str) -> DataFrame:
    """Enumerate all spellings of a lattice (ARRAY<ARRAY<STRING>>) as rows, folding
    the character lists with ``aggregate``. Output grows as the product of list sizes;
    use on short strings (the reference does the same with itertools.product)."""
    spellings = F.aggregate(lists_col, F.array(F.lit("")),
                            lambda acc, chars: F.flatten(F.transform(
                                acc, lambda prefix: F.transform(chars, lambda c: F.concat(prefix, c)))))
    return lattice_rows.select(key, F.explode(spellings).alias("variant"))


def uniq_and_sort(arr: Column) -> Column:
    """Unique values sorted by (-length, value)."""
    return F.array_sort(F.array_distinct(arr), lambda a, b: F.when(
        F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a))
        .otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def max_code_point(s: Column) -> Column:
    """Largest code point of a string."""
    return F.array_max(F.transform(F.split(s, ""), lambda c: F.ascii(c)))


# ------------------------------------------------ script ranges

def script_ranges(spark: SparkSession) -> DataFrame:
    """(ord, lo, hi, category): runs of code points of one script (the reference's range
    table, S8); ``ord`` is the table order."""
    rows = [(i, lo, hi, name) for i, (lo, hi, name) in enumerate(script_table(spark).ranges())]
    return spark.createDataFrame(rows, "ord int, lo int, hi int, category string")


MAX_RANGES = 100_000  # rows of a user's range table, which becomes a literal


def interval_table(ranges: DataFrame) -> IntervalTable:
    """A range table (lo, hi, category[, ord]) as disjoint intervals; where ranges overlap the
    first by ``ord`` (without it by ``lo``) wins. A dimension of bounded size, checked."""
    rows = ranges.limit(MAX_RANGES + 1).collect()
    if len(rows) > MAX_RANGES:
        raise ValueError(f"a range table of more than {MAX_RANGES} rows")
    by = (lambda r: r["ord"]) if "ord" in ranges.columns else (lambda r: r["lo"])
    return IntervalTable.of((r["lo"], r["hi"], r["category"]) for r in sorted(rows, key=by))


def check_categories(categories) -> None:
    known = set(all_scripts()) | set(NEUTRAL_SCRIPTS) | {"OTHER"}
    for c in categories:
        if c not in known:
            raise ValueError(f"no such script: {c}")


def range_alphabet(ranges: DataFrame, categories) -> DataFrame:
    """Characters of the given categories from a range table (A16), one row each; unknown
    categories fail before the job (S8). Only the intervals chosen are spelled out here;
    lookups use :class:`IntervalTable` and never do."""
    check_categories(categories)
    r = ranges.where(F.col("category").isin(list(categories)))
    return r.select(F.explode(F.sequence("lo", "hi")).alias("cp")).select(F.chr("cp").alias("ch")).distinct()


def categorize_chars(chars: DataFrame, ranges: DataFrame | IntervalTable, char_col: str = "ch") -> DataFrame:
    """Code point -> category by range, first range in table order wins (J6, W3): a binary
    search per row, no join. Null and empty strings and code points in no range give null."""
    table = ranges if isinstance(ranges, IntervalTable) else interval_table(ranges)
    return chars.withColumn("category", F.when(F.col(char_col) != "", table.lookup(F.ascii(F.col(char_col)))))


def category_counts(df: DataFrame, text_col: str, table: IntervalTable) -> DataFrame:
    """(ch, code_point, category, n) of every distinct character of all texts. Characters are
    counted per partition before the shuffle; each distinct one is looked up once."""
    chars = df.select(F.explode(F.split(F.col(text_col), "")).alias("ch")).where("ch <> ''")
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return categorize_chars(counts, table).select("ch", F.ascii("ch").alias("code_point"), "category", "n")


def all_categories(spark: SparkSession) -> DataFrame:
    """All category names."""
    return char_table(spark).select(F.col("script").alias("category")).distinct()


def all_languages(spark: SparkSession, table: dict | DataFrame | None = None) -> DataFrame:
    """All language codes (U5), of the shipped table and a user's."""
    return spark.createDataFrame([(k,) for k in sorted(language_letters(table))], "lang string")


def ascii_readings(lattices: DataFrame, key: str, lists_col: str) -> DataFrame:
    """ASCII spellings of a string from its ASCII-only lattice (F22): a string with
    a character that has no ASCII look-alike has none; results unique and sorted
    by (-length, value) per key."""
    ok = lattices.where(F.forall(lists_col, lambda l: F.size(l) > 0))
    rows = expand_variants(ok, key, lists_col)
    return rows.groupBy(key).agg(uniq_and_sort(F.collect_list("variant")).alias("readings"))
