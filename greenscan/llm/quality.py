"""Quality rules by distribution divergence, in column expressions only.

Counts per document (words are runs of characters other than blank and U+0009..U+000D):
n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and two histograms:

* characters by class: upper case, digit, symbol, punctuation, other non-ASCII, rest of words;
* the common words of the document's language, and all other words.

The reference of a language is, class by class and word by word, the median share over all its
documents, so junk and hot sources that are a minority do not bend it. Documents are compared with their language's reference by Jensen-Shannon distance
(square root of the base-2 divergence, 0 to 1) and are rejected beyond a limit, provided they
reach a minimum length; a short text says too little about its distribution.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "das", "von", "zu", "mit", "sich", "des", "auf", "für", "ist",
           "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with",
           "he", "be", "by", "this", "from", "or", "an"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para",
           "con", "no", "una", "su", "al", "lo", "como"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour",
           "qui", "dans", "par", "plus", "pas", "au", "sur"],
}
SYMBOLS = "#*$%&|<>"
SPACE = " \\t-\\r"  # inside a character class: blank and U+0009..U+000D
PUNCTUATION = r"""[!"'()+,\-./:;=?@\[\]^_`{}~\\]"""
CLASSES = ["upper", "digit", "symbol", "punctuation", "wide", "rest"]
SCALE = 10_000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10               # base rule
    max_repeat_percent: int = 20      # base rule: words in repeated 5-word windows
    window: int = 5
    guard_chars: int = 200            # below: character classes are not judged
    guard_words: int = 50             # below: common words are not judged
    max_class_distance: float = 0.30  # beyond it the character classes alone reject
    both_class_distance: float = 0.21  # beyond these two, both together reject
    both_word_distance: float = 0.24
    words: dict = field(default_factory=lambda: COMMON_WORDS)


def _with_repeat_words(counted: DataFrame, window: int) -> DataFrame:
    """Adds n_repeat_words: the words covered by windows whose hash occurs twice or more.

    Sorted (hash, place) pairs put equal windows side by side; covered places are summed over
    the sorted starts. Each step is a column of its own, so that no lambda evaluates an array
    again for every element, and texts without a repeated window skip all of it."""
    pairs = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(
        F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda p, k: F.coalesce(F.get("pairs", k)["h"] == p["h"], F.lit(False))
    starts = F.array_sort(F.filter(
        F.transform("pairs", lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])),
        lambda i: i.isNotNull()))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"])
    return counted.withColumn("pairs", pairs).withColumn("starts", starts) \
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    share = lambda a: F.transform(a, lambda x: x.cast("double") / total(a))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(share(p), share(q), lambda a, b: term(a, b) + term(b, a))
    js = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.lit(2.0)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(js, F.lit(0.0))))


def _scaled(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.floor(x * SCALE / total).cast("bigint"))


def text_counts(docs: DataFrame, rules: QualityRules, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """``row`` (the input row as a struct), doc_id, lang, the counts and both histograms of
    every document. Null text counts as empty text. A null or unlisted language becomes '':
    its documents share one class reference and are not judged by common words."""
    lang = F.when(F.col(lang_col).isin(sorted(rules.words)), F.col(lang_col)).otherwise("")
    every = sorted({w for ws in rules.words.values() for w in ws})
    size, w = F.size("words"), rules.window
    split = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), lang.alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), "")) \
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    symbols = F.lit(0)
    for c in SYMBOLS:  # one byte each
        symbols = symbols + F.octet_length("text") - F.octet_length(F.replace("text", F.lit(c), F.lit("")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    windows = F.transform(F.sequence(F.lit(0), size - w),
                          lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(w)]))
    counted = split.select(
        "row", "doc_id", "lang", size.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(size >= w, windows).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
        F.filter("words", lambda x: x.isin(every)).alias("common"),
        count(r"\p{Lu}").alias("upper"), count("[0-9]").alias("digit"),
        count(PUNCTUATION).alias("punctuation"), count(r"[^\x00-\x7F\p{L}]").alias("wide"))
    is_word = lambda k: lambda v: v == k
    tally = lambda ws: F.array(*[F.size(F.filter("common", is_word(k))).cast("long") for k in ws])
    by_language = F.array().cast("array<bigint>")
    for name, listed in rules.words.items():
        hits = tally(listed)
        by_language = F.when(F.col("lang") == name, F.concat(hits, F.array(
            F.col("n_words") - F.aggregate(hits, F.lit(0).cast("bigint"), lambda s, x: s + x)))) \
            .otherwise(by_language)
    rest = F.col("word_chars") - sum((F.col(c) for c in ("upper", "digit", "n_symbols", "punctuation", "wide")),
                                     F.lit(0).cast("long"))
    return _with_repeat_words(counted, w).select(
        "row", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array("upper", "digit", "n_symbols", "punctuation", "wide",
                F.greatest(rest, F.lit(0).cast("long"))).alias("classes"),
        by_language.alias("common"))


def language_references(counts: DataFrame, rules: QualityRules) -> DataFrame:
    """lang, class_ref, common_ref: for every class and word the median share among all
    documents long enough to be judged; one row per listed language and one for all others.
    Shares are integers out of SCALE, so an exact median keeps at most SCALE + 1 counts."""
    width = 1 + max((len(ws) for ws in rules.words.values()), default=0)
    long_enough = [
        F.when(F.col("word_chars") >= rules.guard_chars, _scaled(F.col("classes"))),
        F.when(F.col("n_words") >= rules.guard_words, _scaled(F.col("common")))]
    scaled = counts.select("lang", long_enough[0].alias("classes"), long_enough[1].alias("common"))
    middle = lambda c, n: F.array(*[F.coalesce(F.percentile(F.get(F.col(c), F.lit(i)), 0.5), F.lit(0.0))
                                    for i in range(n)])
    return scaled.groupBy("lang").agg(middle("classes", len(CLASSES)).alias("class_ref"),
                                      middle("common", width).alias("common_ref"))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document, and the input row as struct ``row``.

    ``base_failed``: fewer than ``min_words`` words, or too many words in repeated windows.
    ``kept``: not base_failed, the class distance within its limit, and not both distances
    beyond the lower limits (a distance of a text below its guard is null and rejects nothing). Empty tables give no rows; repeated rows
    are judged alike; null ids stay null. One pass gathers the references, a second judges
    row by row; nothing but the few reference rows is exchanged."""
    counts = text_counts(docs, rules, id_col, text_col, lang_col)
    refs = language_references(counts, rules)  # at most one row per listed language, plus one
    both = counts.join(F.broadcast(refs), "lang", "left")
    known = F.slice("common_ref", 1, F.size("common"))
    judged = both.withColumns({
        "class_distance": F.when(F.col("word_chars") >= rules.guard_chars,
                                 F.round(_divergence(F.col("classes"), F.col("class_ref")), 6)),
        "word_distance": F.when((F.col("n_words") >= rules.guard_words) & (F.size("common") > 0),
                                F.round(_divergence(F.col("common"), known), 6)),
        "base_failed": (F.col("n_words") < rules.min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)})
    far = F.coalesce(F.col("class_distance") > rules.max_class_distance, F.lit(False)) \
        | F.coalesce((F.col("class_distance") > rules.both_class_distance)
                     & (F.col("word_distance") > rules.both_word_distance), F.lit(False))
    # one sum, not a conjunction: the optimizer would push its first half below the counts and
    # evaluate them again inside the filter
    reasons = F.col("base_failed").cast("int") + far.cast("int")
    return judged.withColumn("kept", reasons == 0).drop("class_ref", "common_ref")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "base_failed", "kept", "class_distance", "word_distance"]


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules(), **columns) -> DataFrame:
    return judge(docs, rules, **columns).select(*RESULT)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), **columns) -> DataFrame:
    """The rows that the rules keep, with the columns they came with."""
    return judge(docs, rules, **columns).where("kept").select("row.*")


def oracle(rules: QualityRules = QualityRules()) -> str:
    """DuckDB SQL of ``quality_report``: words, windows and lines are unnested and counted."""
    def listed(ws):
        return "[" + ", ".join("'" + w + "'" for w in ws) + "]"

    by_language = " ".join(
        f"WHEN '{k}' THEN list_append(list_transform({listed(ws)}, lambda k: len(list_filter(words, lambda v: v = k))), "
        f"len(words) - len(list_filter(words, lambda v: list_contains({listed(ws)}, v))))"
        for k, ws in rules.words.items())
    punctuation = PUNCTUATION.replace("'", "''")

    def distance(p, q):
        share = f"list_zip(list_transform({p}, lambda x: x::DOUBLE / list_sum({p})), " \
                f"list_transform({q}, lambda x: x::DOUBLE / list_sum({q})))"
        term = "(CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(2.0 * z[{0}] / (z[1] + z[2])) ELSE 0 END)"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(0.0, " \
               f"list_sum(list_transform({share}, lambda z: {term.format(1)} + {term.format(2)})) / 2)), 6) END"

    def medians(c, n):
        return "[" + ", ".join(f"coalesce(quantile_cont({c}[{i + 1}], 0.5), 0)" for i in range(n)) + "]"

    width = 1 + max(len(ws) for ws in rules.words.values())
    count = lambda pattern: f"len(regexp_extract_all(body, '{pattern}'))"
    names = ", ".join(f"'{k}'" for k in rules.words)
    w = rules.window
    return f"""
WITH src AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({names}) THEN lang ELSE '' END AS lang,
         coalesce(text, '') AS body FROM documents),
cut AS (
  SELECT *, list_filter(regexp_split_to_array(body, '[ \t-\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM src),
counted AS (
  SELECT r, doc_id, lang, len(words)::BIGINT AS n_words, words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         {count('[#*$%&|<>]')}::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         {count(chr(92) + 'p{Lu}')} AS upper, {count('[0-9]')} AS digit,
         {count(punctuation)} AS punctuation, {count('[^' + chr(92) + 'x00-' + chr(92) + 'x7F' + chr(92) + 'p{L}]')} AS wide,
         CASE lang {by_language} ELSE [] END AS common FROM cut),
wins AS (
  SELECT r, i, list_slice(words, i, i + {w - 1}) AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - {w} + 2)) AS i FROM counted WHERE len(words) >= {w})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + {w})) AS k FROM twice) GROUP BY r),
hist AS (
  SELECT c.*, coalesce(v.n, 0)::BIGINT AS n_repeat_words,
         [upper, digit, n_symbols, punctuation, wide,
          greatest(word_chars - upper - digit - n_symbols - punctuation - wide, 0)] AS classes
  FROM counted c LEFT JOIN covered v USING (r)),
scaled AS (
  SELECT lang,
    CASE WHEN word_chars >= {rules.guard_chars} THEN list_transform(classes, lambda x: floor(x * {SCALE} / list_sum(classes))::BIGINT) END AS a,
    CASE WHEN n_words >= {rules.guard_words} THEN list_transform(common, lambda x: floor(x * {SCALE} / list_sum(common))::BIGINT) END AS b
  FROM hist),
refs AS (SELECT lang, {medians('a', len(CLASSES))} AS class_ref, {medians('b', width)} AS common_ref FROM scaled GROUP BY lang),
judged AS (
  SELECT h.*,
    CASE WHEN word_chars >= {rules.guard_chars} THEN {distance('classes', 'class_ref')} END AS class_distance,
    CASE WHEN n_words >= {rules.guard_words} AND len(common) > 0 THEN {distance('common', 'list_slice(common_ref, 1, len(common))')} END AS word_distance,
    n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed
  FROM hist h JOIN refs USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class_distance > {rules.max_class_distance}, false)
       AND NOT coalesce(class_distance > {rules.both_class_distance} AND word_distance > {rules.both_word_distance}, false) AS kept,
       class_distance, word_distance
FROM judged"""
