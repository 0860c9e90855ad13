"""DuckDB SQL for each registered query, written independently of the Spark code:
token positions are unnested and bigrams come from ``lag`` over positions, where the
Spark side keeps arrays in the row."""

from __future__ import annotations

from greenscan.config import WatermarkConfig
from greenscan.functions.stats import normal_sf_sql, z_score_sql
from greenscan.plans.common import CFG, CFG_DISTINCT, LIMIT_ROWS
from greenscan.functions.normalize import RULESETS, CONTROL_CLASS
from greenscan.operators.evaluate import gamma_grid
from greenscan.plans.queries import (ANALYSIS_METRICS, ATTACK_FROM, ATTACK_ONE, ATTACK_TO, BEAM_STEPS, BEAMS, CFG_CLEAN,
                                     CFG_SMALL_V, INJECT_COMMA,
                                     INJECT_WS, PROMPT_CAP, SAMPLE_SEED, SCRIPT_SAMPLES)
from greenscan.functions.scripts import VOTE_SCRIPTS, re2_class
from greenscan.functions.tokens import TRUNC_NOTICE
from greenscan.operators.truecase import TOKEN as TC_TOKEN


def h60(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def tok_id(w: str, cfg: WatermarkConfig) -> str:
    return f"({h60(w)} % {cfg.vocab_size})"


def green_sql(p: str, c: str, cfg: WatermarkConfig) -> str:
    V = cfg.vocab_size
    k = h60(f"CAST({cfg.hash_key} * {p} AS VARCHAR)")
    rank = f"((({k} % {V - 1} + 1) * {c} + ({k} // {V - 1}) % {V}) % {V})"
    if cfg.select_green_tokens:
        return f"({rank} < {cfg.n_green})"
    return f"({rank} >= {cfg.vocab_size - cfg.n_green})"


def token_ids_cte(table: str, id_col: str, text_col: str, cfg: WatermarkConfig,
                  extra: str = "") -> str:
    """(id, pos, c) per token, positions from 1. Every row is a document of its own: ``id``
    numbers the rows, ``key`` is the table's id, which may repeat and be null."""
    pat = cfg.token_pattern
    src = "lower(txt)" if cfg.lowercase else "txt"
    return f"""
docs AS MATERIALIZED (SELECT row_number() OVER () AS id, {id_col} AS key, {text_col} AS txt{extra} FROM {table}),
toks AS (SELECT id, regexp_extract_all({src}, '{pat}') AS t FROM docs),
pos AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM toks),
tid AS (SELECT id, pos, {tok_id('w', cfg)} AS c FROM pos),
bg AS (SELECT id, pos, lag(c) OVER (PARTITION BY id ORDER BY pos) AS p, c FROM tid)"""


def detect_sql(cfg: WatermarkConfig, table="documents", id_col="doc_id", text_col="text") -> str:
    distinct = "DISTINCT" if cfg.ignore_repeated_bigrams else ""
    z = z_score_sql("g", "t", cfg.gamma)
    return f"""
WITH {token_ids_cte(table, id_col, text_col, cfg)},
sc AS (SELECT {distinct} id, p, c FROM bg WHERE p IS NOT NULL),
agg AS (SELECT id, count(*)::BIGINT AS t,
               sum(CASE WHEN {green_sql('p', 'c', cfg)} THEN 1 ELSE 0 END)::BIGINT AS g
        FROM sc GROUP BY id),
st AS (SELECT d.key, agg.t, agg.g,
         CASE WHEN d.txt IS NULL THEN 'null_input'
              WHEN length(d.txt) - 1 <= 1 THEN 'too_short'
              WHEN agg.t IS NULL THEN 'too_few_tokens' ELSE 'ok' END AS status
       FROM docs d LEFT JOIN agg ON d.id = agg.id),
m AS (SELECT key, status,
        CASE WHEN status = 'ok' THEN t END AS t, CASE WHEN status = 'ok' THEN g END AS g FROM st),
zz AS (SELECT key, status, t, g, {z} AS z_score FROM m),
pp AS (SELECT *, {normal_sf_sql('z_score')} AS p_value FROM zz)
SELECT key AS {id_col}, t AS num_tokens_scored, g AS num_green_tokens,
       CAST(g AS DOUBLE) / CAST(t AS DOUBLE) AS green_fraction, z_score, p_value,
       z_score > {float(cfg.z_threshold)!r}e0 AS prediction,
       CASE WHEN z_score > {float(cfg.z_threshold)!r}e0 THEN 1.0e0 - p_value END AS confidence,
       status
FROM pp"""


def status_cte(agg: str = "agg") -> str:
    return f"""st AS (SELECT d.id, d.key, {agg}.t, {agg}.g,
         CASE WHEN d.txt IS NULL THEN 'null_input'
              WHEN length(d.txt) - 1 <= 1 THEN 'too_short'
              WHEN {agg}.t IS NULL THEN 'too_few_tokens' ELSE 'ok' END AS status
       FROM docs d LEFT JOIN {agg} ON d.id = {agg}.id)"""


def green_mask_sql(cfg: WatermarkConfig) -> str:
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
gm AS (SELECT id, pos, {green_sql('p', 'c', cfg)} AS green FROM bg WHERE p IS NOT NULL),
agg AS (SELECT id, count(*)::BIGINT AS t, sum(CASE WHEN green THEN 1 ELSE 0 END)::BIGINT AS g,
               string_agg(CASE WHEN green THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits
        FROM gm GROUP BY id),
{status_cte()}
SELECT st.key AS doc_id, CASE WHEN status = 'ok' THEN st.t END AS num_tokens_scored,
       CASE WHEN status = 'ok' THEN st.g END AS num_green_tokens,
       CASE WHEN status = 'ok' THEN agg.bits END AS mask_bits, status
FROM st LEFT JOIN agg ON st.id = agg.id"""


def bigram_freq_sql(cfg: WatermarkConfig) -> str:
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)}
SELECT docs.key AS doc_id, p AS prev, c AS tok, count(*)::BIGINT AS n, {green_sql('p', 'c', cfg)} AS is_green
FROM bg JOIN docs USING (id) WHERE p IS NOT NULL GROUP BY docs.id, docs.key, p, c"""


def bigram_green_table_sql(cfg: WatermarkConfig) -> str:
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
agg AS (SELECT p, c, count(*)::BIGINT AS n FROM bg WHERE p IS NOT NULL GROUP BY p, c)
SELECT p AS prev, c AS tok, n, {green_sql('p', 'c', cfg)} AS is_green FROM agg"""


def greenlist_explicit_sql(cfg: WatermarkConfig) -> str:
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)}
SELECT docs.key AS doc_id, count(p)::BIGINT AS num_tokens_scored,
       coalesce(sum(CASE WHEN p IS NOT NULL AND {green_sql('p', 'c', cfg)} THEN 1 ELSE 0 END), 0)::BIGINT AS num_green_tokens
FROM docs LEFT JOIN bg USING (id) GROUP BY docs.id, docs.key"""


def _tokens_sql(cfg: WatermarkConfig = CFG) -> str:
    return f"regexp_extract_all(lower(text), '{cfg.token_pattern}')"


TOKENIZE_SQL = f"""
SELECT doc_id, len({_tokens_sql()})::BIGINT AS n_tokens, array_to_string({_tokens_sql()}, ' ') AS tokens_joined
FROM documents"""

VOCAB_CTE = f"""
toks AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_tokens_sql()} AS t FROM documents),
pos AS (SELECT id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
cnt AS (SELECT token, count(*)::BIGINT AS n FROM pos GROUP BY token),
vocab AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) - 1)::BIGINT AS token_id FROM cnt)"""

VOCAB_BUILD_SQL = f"WITH {VOCAB_CTE} SELECT token, n, token_id FROM vocab"

VOCAB_ENCODE_SQL = f"""
WITH {VOCAB_CTE}
SELECT toks.doc_id, len(any_value(t))::BIGINT AS n_tokens,
       CASE WHEN any_value(t) IS NOT NULL THEN
         coalesce(string_agg(CAST(vocab.token_id AS VARCHAR), ' ' ORDER BY pos.pos), '') END AS ids_joined
FROM toks LEFT JOIN pos USING (id) LEFT JOIN vocab ON pos.token = vocab.token GROUP BY toks.id, toks.doc_id"""

# encoding, then decoding, gives the tokens themselves
IDS_TO_TEXT_SQL = f"""
SELECT doc_id, len({_tokens_sql()})::BIGINT + 1 AS n_ids, array_to_string({_tokens_sql()}, ' ') AS text FROM documents"""


def bos_strip_sql(cfg: WatermarkConfig) -> str:
    z = z_score_sql("g", "t", cfg.gamma)
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
agg AS (SELECT id, count(*)::BIGINT AS t,
               sum(CASE WHEN {green_sql('p', 'c', cfg)} THEN 1 ELSE 0 END)::BIGINT AS g
        FROM bg WHERE p IS NOT NULL GROUP BY id)
SELECT d.key AS doc_id, agg.t AS num_tokens_scored, agg.g AS num_green_tokens, {z} AS z_score,
       CASE WHEN d.txt IS NULL THEN 'null_input' WHEN agg.t IS NULL THEN 'too_few_tokens' ELSE 'ok' END AS status
FROM docs d LEFT JOIN agg ON d.id = agg.id"""


def prompt_truncate_sql(cap: int, notice: str) -> str:
    t = _tokens_sql()
    cut = f"{t}[1:{cap}]"
    return f"""
SELECT doc_id, len({t})::BIGINT AS n_tokens, len({cut})::BIGINT AS n_prompt,
       CAST(len({cut}) = {cap} AS INTEGER) AS truncation_warning,
       CASE WHEN len({cut}) = {cap} THEN array_to_string({cut}, ' ') || {sql_str(notice)} ELSE text END
         AS prompt_text
FROM documents"""


def sql_str(s: str) -> str:
    """A DuckDB string literal; newlines through chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


INJECTED = (f"chr(65279) || replace(replace(replace(text, '. ', {lit(INJECT_WS)}), ', ', {lit(INJECT_COMMA)}), "
            f"chr(233), 'e' || chr(769)) || chr(9) || chr(12288) || 'end'")


def unicode_sql(ruleset: str) -> str:
    x = f"regexp_replace(nfc_normalize({INJECTED}), '{RULESETS[ruleset]}', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ' +', ' ', 'g'), '{CONTROL_CLASS}', '', 'g')"
    return f"""
WITH n AS (SELECT doc_id, {x} AS text_norm FROM documents)
SELECT doc_id, text_norm, length(text_norm)::BIGINT AS n_chars FROM n"""


def homoglyph_canon_sql(maps: dict) -> str:
    """Vote as in script_vote_sql, then translate with the same fixed maps (literals
    built from the ICU character dimension)."""
    vote = script_vote_sql("d.a, d.text, ")
    cases = " ".join(f"WHEN v.target = '{t}' THEN translate(v.a, {lit(src)}, {lit(dst)})"
                     for t, (src, dst) in maps.items() if t in VOTE_SCRIPTS)
    return f"""
WITH v AS ({vote}),
c AS (SELECT v.doc_id, v.target, v.text, CASE {cases} ELSE v.a END AS canon FROM v)
SELECT doc_id, target, canon, canon = text AS restored, length(canon)::BIGINT AS n_chars FROM c"""


def homoglyph_variants_sql(rows) -> str:
    """Per-character variant lists (fixed ICU table, as literals) joined to the
    characters of every distinct word; lattice, spelling count and ASCII count."""
    vals = ", ".join(f"({lit(ch)}, {lit(v)}, {nv}, {na})" for ch, v, nv, na in rows)
    return rf"""
WITH vt AS (SELECT * FROM (VALUES {vals}) AS t(ch, variants, nv, na)),
toks AS (SELECT {_tokens_sql()} AS t FROM documents),
words AS (SELECT DISTINCT unnest(t) AS word FROM toks),
chars AS (SELECT word, unnest(regexp_extract_all(word, '.')) AS ch,
                 generate_subscripts(regexp_extract_all(word, '.'), 1) AS i FROM words),
j AS (SELECT c.word, c.i, coalesce(vt.variants, c.ch) AS v, coalesce(vt.nv, 1) AS nv,
             coalesce(vt.na, CASE WHEN unicode(c.ch) < 128 THEN 1 ELSE 0 END) AS na
      FROM chars c LEFT JOIN vt ON c.ch = vt.ch)
SELECT word, string_agg(v, ' ' ORDER BY i) AS lattice, product(nv)::DOUBLE AS n_variants,
       product(na)::DOUBLE AS n_ascii FROM j GROUP BY word"""


# The ASCII characters that the published confusables table holds for one another,
# and the letters of the attack. Every other ASCII character only reads as itself.
ASCII_CLASSES = ("1Il|", "0O", "'`")


def variant_spellings_sql() -> str:
    pairs = [(a, b) for c in ASCII_CLASSES for a in c for b in c]
    pairs += [(x, y) for x, y in zip(ATTACK_TO, ATTACK_FROM)]
    pairs += [(chr(c), chr(c)) for c in range(33, 127) if not any(chr(c) in k for k in ASCII_CLASSES)]
    vals = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in pairs)
    tokens = f"regexp_extract_all(lower(translate(text, '{ATTACK_FROM}', '{ATTACK_TO}')), '{CFG.token_pattern}')"
    return f"""
WITH RECURSIVE look AS (SELECT * FROM (VALUES {vals}) AS t(ch, alt)),
words AS (SELECT DISTINCT unnest({tokens}) AS word FROM documents),
made AS (SELECT word, 0 AS i, '' AS spelling FROM words
  UNION ALL SELECT m.word, m.i + 1, m.spelling || look.alt FROM made m JOIN look ON look.ch = m.word[m.i + 1])
SELECT word, row_number() OVER (PARTITION BY word ORDER BY spelling) - 1 AS n, spelling
FROM made WHERE i = length(word)"""


def variant_strategies_sql() -> str:
    known = "".join(f"\\p{{{s}}}" for s in RE2_SCRIPTS)
    n = lambda c: f"len(regexp_extract_all(word, '[{c}]'))::BIGINT"
    return f"""
WITH d AS ({sampled_sql()}),
words AS (SELECT DISTINCT unnest({_tokens_sql()}) AS word FROM d)
SELECT word, length(word)::BIGINT AS n_ignore, {n('\\p{Latin}\\p{Common}')} AS n_remove,
       {n('\\x00-\\x7F')} AS n_ascii, {n(known)} AS n_load FROM words"""


def dynamic_oracles() -> dict:
    """Entries whose SQL embeds tables built in the JVM (ICU); only when a Spark
    session is active, otherwise those queries are checked on rows only."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if spark is None:
        return {}
    try:
        from greenscan.operators.homoglyph import canon_maps, variant_table
        vt = variant_table(spark).collect()  # fixed-size character table
        rows = [(r.ch, "".join(r.variants), len(r.variants), sum(1 for c in r.variants if ord(c) < 128))
                for r in vt if len(r.variants) > 1]
        return {"homoglyph_canon": homoglyph_canon_sql(canon_maps(spark)),
                "homoglyph_variants": homoglyph_variants_sql(rows)}
    except Exception:  # no JVM access (e.g. a remote session)
        return {}


# Script names of the regex engine, whose Unicode tables are its own (not the JVM's). Fixed
# values: Unicode script names.
RE2_SCRIPTS = ("Latin", "Common", "Inherited", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Han", "Hiragana",
               "Katakana", "Hangul", "Thai", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada",
               "Malayalam", "Georgian", "Ethiopic", "Cherokee", "Khmer", "Lao", "Tibetan", "Myanmar", "Runic", "Mongolian",
               "Tifinagh", "Yi", "Gothic")


def sampled_sql() -> str:
    picks = ", ".join(lit(x) for x in SCRIPT_SAMPLES)
    n = len(SCRIPT_SAMPLES)
    return (f"SELECT doc_id, text || ' ' || ([{picks}])[(((coalesce(doc_id, 0) % {n}) + {n}) % {n} + 1)::INT] AS text "
            "FROM documents")


def _script_case(ch: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({ch}, '\\p{{{s}}}') THEN '{s.upper()}'" for s in RE2_SCRIPTS)
    return f"CASE {whens} END"


def category_lookup_sql() -> str:
    return f"""
WITH d AS ({sampled_sql()}),
c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM d),
n AS (SELECT ch, count(*)::BIGINT AS n FROM c GROUP BY ch)
SELECT ch, unicode(ch)::INTEGER AS code_point, {_script_case('ch')} AS category, n FROM n"""


def text_scripts_sql() -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(text, '\\p{{{s}}}') THEN '{s.upper()}' END" for s in sorted(RE2_SCRIPTS, key=str.upper))
    return f"""
WITH d AS ({sampled_sql()}),
f AS (SELECT doc_id, text, list_filter([{found}], lambda x: x IS NOT NULL) AS s FROM d)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(s, ',') END AS scripts,
       CASE WHEN text IS NOT NULL THEN len(s)::BIGINT END AS n_scripts FROM f"""


def script_vote_sql(more: str = "") -> str:
    att = f"translate(text, '{ATTACK_FROM}', '{ATTACK_TO}')"
    cnt = lambda s: f"len(regexp_extract_all(a, '{re2_class(s)}'))::BIGINT"
    cands = ", ".join(
        f"{{'script': '{s}', 'n': {cnt(s)}, "
        f"'first': CASE WHEN {cnt(s)} > 0 THEN strpos(a, regexp_extract(a, '{re2_class(s)}')) ELSE 0 END}}"
        for s in VOTE_SCRIPTS)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text, {att} AS a FROM documents),
c AS (SELECT id, unnest([{cands}]) AS s FROM d),
r AS (SELECT id, s.script AS script, s.n AS n,
             row_number() OVER (PARTITION BY id ORDER BY s.n DESC, s.first ASC) AS rk FROM c),
v AS (SELECT id, CASE WHEN n > 0 THEN script WHEN n = 0 THEN 'COMMON' END AS target FROM r WHERE rk = 1)
SELECT d.doc_id, {more}{cnt('LATIN').replace('a,', 'd.a,')} AS n_latin, {cnt('CYRILLIC').replace('a,', 'd.a,')} AS n_cyrillic,
       {cnt('GREEK').replace('a,', 'd.a,')} AS n_greek, {cnt('COMMON').replace('a,', 'd.a,')} AS n_common, v.target
FROM d JOIN v USING (id)"""


TRUECASE_MODEL_SQL = rf"""
WITH toks AS MATERIALIZED (SELECT row_number() OVER () AS id, regexp_extract_all(text, '{TC_TOKEN}') AS t FROM documents),
pos AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM toks),
lg AS (SELECT w, lag(w) OVER (PARTITION BY id ORDER BY pos) AS pw FROM pos),
mid AS (SELECT w FROM lg WHERE pw IS NOT NULL AND pw NOT IN ('.', '!', '?')
        AND regexp_matches(w, '^\p{{L}}')),
cnt AS (SELECT lower(w) AS key, w AS form, count(*)::BIGINT AS n FROM mid GROUP BY 1, 2),
best AS (SELECT key, form, n, sum(n) OVER (PARTITION BY key)::BIGINT AS n_total,
                row_number() OVER (PARTITION BY key ORDER BY n DESC, form DESC) AS rk FROM cnt)
SELECT key, form, n AS n_form, n_total FROM best WHERE rk = 1"""


# ------------------------------------------------------ generation / evaluation

def _green_ok(cfg, p="p", c="c"):
    return f"CASE WHEN {green_sql(p, c, cfg)} THEN 1 ELSE 0 END"


def cand_cte(cfg: WatermarkConfig, table: str = "documents") -> str:
    return f"""{token_ids_cte(table, "doc_id", "text", cfg)},
cnt AS (SELECT p AS prev, c AS tok, count(*)::BIGINT AS n FROM bg WHERE p IS NOT NULL GROUP BY p, c),
cand AS (SELECT prev, tok, n, ln(n) AS score, {green_sql('prev', 'tok', cfg)} AS is_green FROM cnt),
biased AS (SELECT *, score + CASE WHEN is_green THEN {float(cfg.delta)!r}e0 ELSE 0.0e0 END AS biased_score
           FROM cand)"""


def bias_scores_sql(cfg):
    return f"WITH {cand_cte(cfg)} SELECT prev, tok, n, score, is_green, biased_score FROM biased"


def greedy_next_sql(cfg):
    return f"""
WITH {cand_cte(cfg)},
w AS (SELECT prev, tok AS next_tok_w, biased_score AS score_w,
             row_number() OVER (PARTITION BY prev ORDER BY biased_score DESC, tok ASC) AS rk FROM biased),
wo AS (SELECT prev, tok AS next_tok_wo, score AS score_wo,
              row_number() OVER (PARTITION BY prev ORDER BY score DESC, tok ASC) AS rk FROM biased)
SELECT w.prev, next_tok_w, score_w, next_tok_wo, score_wo
FROM w JOIN wo ON w.prev = wo.prev AND wo.rk = 1 WHERE w.rk = 1"""


def sampled_next_sql(cfg, seed):
    u = (f"((CAST({h60(f"concat_ws(':', '{seed}', CAST(prev AS VARCHAR), CAST(tok AS VARCHAR))")} AS DOUBLE)"
         f" + 0.5e0) / {float(2 ** 60)!r})")
    return f"""
WITH {cand_cte(cfg)},
s AS (SELECT prev, tok, biased_score / {float(cfg.sampling_temp)!r}e0 + (-ln(-ln({u}))) AS s FROM biased),
r AS (SELECT prev, tok, s, row_number() OVER (PARTITION BY prev ORDER BY s DESC, tok ASC) AS rk FROM s)
SELECT prev, tok AS next_tok, s AS sample_score FROM r WHERE rk = 1"""


def transition_table_sql(cfg):
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
cnt AS (SELECT p AS prev, c AS tok, count(*)::BIGINT AS n FROM bg WHERE p IS NOT NULL GROUP BY p, c),
r AS (SELECT prev, tok, n, sum(n) OVER (PARTITION BY prev)::BIGINT AS total,
             row_number() OVER (PARTITION BY prev ORDER BY n DESC, tok ASC)::BIGINT AS rank FROM cnt)
SELECT prev, tok, n, total, rank, ln(CAST(n AS DOUBLE) / CAST(total AS DOUBLE)) AS logit FROM r"""


def paired_cte(cfg) -> str:
    zw = z_score_sql("wg", "wt", cfg.gamma)
    zo = z_score_sql("og", "ot", cfg.gamma)
    thr = f"{float(cfg.z_threshold)!r}e0"
    return f"""{cand_cte(cfg)},
greedy AS (SELECT prev, tok AS g FROM (SELECT prev, tok,
             row_number() OVER (PARTITION BY prev ORDER BY biased_score DESC, tok ASC) AS rk FROM biased)
           WHERE rk = 1),
tri AS (SELECT id, pos, lag(c, 2) OVER (PARTITION BY id ORDER BY pos) AS pp, p, c FROM bg),
wb AS (SELECT tri.id,
              CASE WHEN tri.pos % 2 = 0 THEN tri.p ELSE coalesce(g2.g, tri.p) END AS wp,
              CASE WHEN tri.pos % 2 = 0 THEN coalesce(g1.g, tri.c) ELSE tri.c END AS wc
       FROM tri LEFT JOIN greedy g1 ON tri.p = g1.prev LEFT JOIN greedy g2 ON tri.pp = g2.prev
       WHERE tri.p IS NOT NULL),
wagg AS (SELECT id, count(*)::BIGINT AS wt, sum({_green_ok(cfg, 'wp', 'wc')})::BIGINT AS wg FROM wb GROUP BY id),
oagg AS (SELECT id, count(*)::BIGINT AS ot, sum({_green_ok(cfg)})::BIGINT AS og FROM bg
         WHERE p IS NOT NULL GROUP BY id),
base AS (SELECT docs.key AS id, len(toks.t)::BIGINT AS n, oagg.ot, oagg.og, wagg.wt, wagg.wg
         FROM toks JOIN docs USING (id) LEFT JOIN oagg ON toks.id = oagg.id LEFT JOIN wagg ON toks.id = wagg.id),
zz AS (SELECT *, {zo} AS oz, {zw} AS wz FROM base),
paired AS (
SELECT CAST(id AS VARCHAR) AS id,
       ot AS WO_num_tokens_scored, og AS WO_num_green_tokens,
       CAST(og AS DOUBLE) / CAST(ot AS DOUBLE) AS WO_green_fraction, oz AS WO_z_score,
       {normal_sf_sql('oz')} AS WO_p_value, oz > {thr} AS WO_prediction, n AS WO_num_output_token,
       wt AS W_num_tokens_scored, wg AS W_num_green_tokens,
       CAST(wg AS DOUBLE) / CAST(wt AS DOUBLE) AS W_green_fraction, wz AS W_z_score,
       {normal_sf_sql('wz')} AS W_p_value, wz > {thr} AS W_prediction, n AS W_num_output_token
FROM zz),
arms AS (
  SELECT id, 'WO' AS arm, WO_num_tokens_scored AS num_tokens_scored, WO_num_green_tokens AS num_green_tokens,
         WO_green_fraction AS green_fraction, WO_z_score AS z_score, WO_p_value AS p_value,
         WO_prediction AS prediction, WO_num_output_token AS num_output_token FROM paired
  UNION ALL
  SELECT id, 'W', W_num_tokens_scored, W_num_green_tokens, W_green_fraction, W_z_score, W_p_value,
         W_prediction, W_num_output_token FROM paired),
complete AS (SELECT * FROM arms WHERE id IS NOT NULL AND num_tokens_scored IS NOT NULL AND num_green_tokens IS NOT NULL
             AND green_fraction IS NOT NULL AND z_score IS NOT NULL AND p_value IS NOT NULL
             AND prediction IS NOT NULL AND num_output_token IS NOT NULL)"""


def paired_results_sql(cfg):
    return f"WITH {paired_cte(cfg)} SELECT * FROM paired"


def threshold_rates_sql(cfg):
    return f"""
WITH {paired_cte(cfg)},
grid AS (SELECT range AS j, range / 10.0e0 AS threshold FROM range(0, 101)),
sc AS (SELECT arm, z_score FROM arms WHERE z_score IS NOT NULL),
r AS (SELECT g.threshold,
        count(CASE WHEN s.arm = 'WO' AND s.z_score > g.threshold THEN 1 END)::BIGINT AS wo_pass,
        count(CASE WHEN s.arm = 'W' AND s.z_score > g.threshold THEN 1 END)::BIGINT AS w_pass,
        count(CASE WHEN s.arm = 'WO' THEN 1 END)::BIGINT AS n_wo,
        count(CASE WHEN s.arm = 'W' THEN 1 END)::BIGINT AS n_w
      FROM grid g, sc s GROUP BY g.threshold)
SELECT threshold, CAST(wo_pass AS DOUBLE) / n_wo AS fpr, CAST(w_pass AS DOUBLE) / n_w AS tpr, n_wo, n_w FROM r"""


def arm_summary_sql(cfg):
    return f"""
WITH {paired_cte(cfg)}
SELECT arm, count(*)::BIGINT AS n_rows, count(z_score)::BIGINT AS n_scored,
       avg(CAST(prediction AS DOUBLE)) AS predicted_rate, avg(z_score) AS mean_z,
       stddev_samp(z_score) AS sd_z, avg(green_fraction) AS mean_green_fraction
FROM arms GROUP BY arm"""


def _metric_long(metrics):
    return " UNION ALL ".join(
        f"SELECT arm, '{m}' AS metric, CAST({m} AS DOUBLE) AS x FROM complete" for m in metrics)


def histograms_sql(cfg, metrics, bins=20):
    return f"""
WITH {paired_cte(cfg)},
lg AS ({_metric_long(metrics)}),
rg AS (SELECT arm, metric, min(x) AS lo, max(x) AS hi FROM lg WHERE NOT isnan(x) GROUP BY arm, metric),
b AS (SELECT lg.arm, lg.metric, rg.lo, rg.hi,
        CAST(CASE WHEN rg.hi - rg.lo = 0 THEN 0
             ELSE least(floor((lg.x - rg.lo) / (rg.hi - rg.lo) * {float(bins)!r}e0), {bins - 1}) END AS INTEGER) AS bin
      FROM lg JOIN rg ON lg.arm = rg.arm AND lg.metric = rg.metric WHERE NOT isnan(lg.x))
SELECT arm, metric, bin, lo, hi, count(*)::BIGINT AS n FROM b GROUP BY arm, metric, bin, lo, hi"""


def pair_corr_sql(cfg, metrics):
    from itertools import combinations
    parts = []
    for x, y in combinations(metrics, 2):
        parts.append(f"SELECT arm, '{x}' AS x_col, '{y}' AS y_col, "
                     f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)::BIGINT AS n, "
                     f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS corr FROM complete GROUP BY arm")
    return f"WITH {paired_cte(cfg)} " + " UNION ALL ".join(parts)


def sweep_grid_sql(cfg, grid):
    vals = ", ".join(f"({g!r}e0, {n})" for g, n in grid)
    V = cfg.vocab_size
    k = h60(f"CAST({cfg.hash_key} * p AS VARCHAR)")
    rank = f"((({k} % {V - 1} + 1) * c + ({k} // {V - 1}) % {V}) % {V})"
    z = "((CAST(g AS DOUBLE) - gamma * CAST(t AS DOUBLE)) / sqrt(CAST(t AS DOUBLE) * gamma * (1.0e0 - gamma)))"
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
rk AS (SELECT id, {rank} AS r FROM bg WHERE p IS NOT NULL),
grid AS (SELECT * FROM (VALUES {vals}) AS v(gamma, n_green)),
agg AS (SELECT docs.key AS id, gamma, nullif(count(r), 0)::BIGINT AS t,
               sum(CASE WHEN r < n_green THEN 1 WHEN r IS NOT NULL THEN 0 END)::BIGINT AS g
        FROM docs CROSS JOIN grid LEFT JOIN rk ON rk.id = docs.id GROUP BY docs.id, docs.key, gamma)
SELECT id AS doc_id, gamma, t AS num_tokens_scored, g AS num_green_tokens, {z} AS z_score,
       {z} > {float(cfg.z_threshold)!r}e0 AS prediction FROM agg"""


def sweep_surface_sql(cfg, grid, thresholds=21, per_unit=2):
    """Every text re-scored at every point of the grid, every score held against every threshold."""
    vals = ", ".join(f"({g!r}e0, {n})" for g, n in grid)
    V = cfg.vocab_size
    k = h60(f"CAST({cfg.hash_key} * p AS VARCHAR)")
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
sc AS (SELECT false AS ignore_repeated, id, p, c FROM bg WHERE p IS NOT NULL
       UNION ALL SELECT DISTINCT true, id, p, c FROM bg WHERE p IS NOT NULL),
rk AS (SELECT ignore_repeated, id, ((({k} % {V - 1} + 1) * c + ({k} // {V - 1}) % {V}) % {V}) AS r FROM sc),
grid AS (SELECT * FROM (VALUES {vals}) AS v(gamma, n_green), (VALUES (true), (false)) AS w(select_green)),
agg AS (SELECT ignore_repeated, select_green, gamma, id, CAST(count(*) AS DOUBLE) AS t,
               CAST(count(CASE WHEN (select_green AND r < n_green) OR (NOT select_green AND r >= {V} - n_green)
                               THEN 1 END) AS DOUBLE) AS g
        FROM rk CROSS JOIN grid GROUP BY ALL),
z AS (SELECT *, (g - gamma * t) / sqrt(t * gamma * (1.0e0 - gamma)) AS z FROM agg),
thr AS (SELECT i / {float(per_unit)!r}e0 AS threshold FROM range({thresholds}) AS x(i))
SELECT gamma, ignore_repeated, select_green, threshold, count(*)::BIGINT AS n_scored,
       count(CASE WHEN z > threshold THEN 1 END)::BIGINT AS n_detected,
       CAST(count(CASE WHEN z > threshold THEN 1 END) AS DOUBLE) / count(*) AS rate
FROM z CROSS JOIN thr GROUP BY gamma, ignore_repeated, select_green, threshold"""


def display_table_sql(cfg):
    thr = repr(float(cfg.z_threshold))
    d = detect_sql(cfg)
    rows = [
        ("0", "'Tokens Counted (T)'", "CAST(num_tokens_scored AS VARCHAR)"),
        ("1", "'# Tokens in Greenlist'", "CAST(num_green_tokens AS VARCHAR)"),
        ("2", "'Fraction of T in Greenlist'", "printf('%.1f%%', green_fraction * 100.0e0)"),
        ("3", "'z-score'", "printf('%.3g', z_score)"),
        ("4", "'p value'", "printf('%.3g', p_value)"),
        ("5", "'z-score Threshold'", f"'{thr}'"),
        ("6", "'Prediction'", "CASE WHEN prediction THEN 'Watermarked' ELSE 'Human/Unwatermarked' END"),
    ]
    ok = " UNION ALL ".join(f"SELECT doc_id, {o} AS ord, {m} AS metric, {v} AS value FROM det WHERE status = 'ok'"
                            for o, m, v in rows)
    conf = ("SELECT doc_id, 7, 'Confidence', printf('%.3f%%', confidence * 100.0e0) FROM det "
            "WHERE status = 'ok' AND prediction")
    err = ("SELECT doc_id, 0, 'Error', CASE WHEN status = 'too_short' THEN 'string too short to compute metrics' "
           "ELSE 'too few tokens to compute metrics' END FROM det WHERE status <> 'ok'")
    blanks = " UNION ALL ".join(f"SELECT doc_id, {i}, '', '' FROM det WHERE status <> 'ok'" for i in range(1, 7))
    return f"WITH det AS ({d}) SELECT doc_id, CAST(ord AS INTEGER) AS ord, metric, value FROM ({ok} UNION ALL {conf} UNION ALL {err} UNION ALL {blanks})"


CATEGORY_CODES_SQL = """
SELECT doc_id, lang, source,
       CASE WHEN lang IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY lang NULLS LAST) - 1 END::BIGINT AS lang_code,
       CASE WHEN source IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY source NULLS LAST) - 1 END::BIGINT AS source_code
FROM documents"""


def truecase_apply_sql(source: str = "SELECT doc_id, translate(lower(text), 'aeiou', 'AEIOU') AS text FROM documents") -> str:
    """Segments of the lower-cased text (words and everything between them), sentence
    starts from the previous segment, learned forms by a left join, capitalised starts,
    re-joined in order."""
    model = TRUECASE_MODEL_SQL.strip()
    return rf"""
WITH model AS ({model}),
forms AS (SELECT key, form FROM model WHERE form <> key),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, text, regexp_extract_all(lower(text),
                                              '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS s FROM ({source})),
seg AS (SELECT id, unnest(s) AS seg, generate_subscripts(s, 1) AS i FROM d),
ctx AS (SELECT id, i, seg, lag(seg) OVER (PARTITION BY id ORDER BY i) AS prev_seg,
               first_value(seg) OVER (PARTITION BY id ORDER BY i) AS first_seg FROM seg),
st AS (SELECT ctx.id, ctx.i, coalesce(forms.form, ctx.seg) AS v, regexp_matches(ctx.seg, '^[\p{{L}}\p{{N}}]') AS w,
              (ctx.i = 1 OR (ctx.i = 2 AND NOT regexp_matches(ctx.first_seg, '^[\p{{L}}\p{{N}}]'))
               OR regexp_matches(ctx.prev_seg, '[.!?]\s*$')) AS start
       FROM ctx LEFT JOIN forms ON ctx.seg = forms.key),
out AS (SELECT id, string_agg(CASE WHEN start AND w THEN upper(substr(v, 1, 1)) || substr(v, 2) ELSE v END,
                                  '' ORDER BY i) AS truecased FROM st GROUP BY id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(out.truecased, '') END AS truecased
FROM d LEFT JOIN out USING (id)"""


def detect_normalized_sql() -> str:
    """The chain step by step: attack, Unicode cleaning, the one look-alike back where Latin
    letters are in the majority, casing, detection; the guard looks at the text as it came."""
    attacked = f"translate(translate(lower({INJECTED}), 'aeiu', 'AEIU'), '{ATTACK_ONE[0]}', '{ATTACK_ONE[1]}')"
    clean = f"regexp_replace(nfc_normalize({attacked}), '{RULESETS['whitespaces']}', ' ', 'g')"
    clean = f"regexp_replace(regexp_replace({clean}, ' +', ' ', 'g'), '{CONTROL_CLASS}', '', 'g')"
    n = lambda s: f"len(regexp_extract_all(x, '\\p{{{s}}}'))"
    source = (f"SELECT doc_id, CASE WHEN {n('Latin')} > {n('Cyrillic')} THEN translate(x, '{ATTACK_ONE[1]}', '{ATTACK_ONE[0]}') "
              f"ELSE x END AS text FROM (SELECT doc_id, {clean} AS x FROM documents)")
    return detect_sql(CFG_CLEAN, table=f"(SELECT doc_id, truecased AS text FROM ({truecase_apply_sql(source)}))")


# The letters of the four languages beyond a-z.
LETTERS = {"en": "", "fr": "àâæçéèêëîïôœùûüÿ", "de": "äöüß", "es": "áéíñóúü"}


def _letters(lang: str) -> str:
    return "a-zA-Z" + LETTERS[lang] + "".join(c.upper() for c in LETTERS[lang] if len(c.upper()) == 1) + ("S" if lang == "de" else "")


def alphabet_sets_sql() -> str:
    n = lambda c: f"len(regexp_extract_all(text, '[{c}]'))::BIGINT"
    common = "\\p{Common}"
    whens = " ".join(f"WHEN lang = '{k}' THEN {n(_letters(k) + common)}" for k in LETTERS)
    return f"""
SELECT doc_id, lang, n_inside, length(text)::BIGINT - n_inside AS n_outside, n_shared
FROM (SELECT doc_id, lang, text, CASE WHEN text IS NULL THEN NULL {whens} ELSE {n(common)} END AS n_inside,
             {n('a-zA-Z')} AS n_shared FROM documents)"""


def text_languages_sql() -> str:
    every = ", ".join(f"CASE WHEN NOT regexp_matches(regexp_replace(text, '[{_letters(k)}]', '', 'g'), '\\p{{L}}') THEN '{k}' END"
                      for k in sorted(LETTERS))
    some = ", ".join(f"CASE WHEN regexp_matches(text, '[{_letters(k)}]') THEN '{k}' END" for k in sorted(LETTERS))
    shown = lambda x: f"CASE WHEN text IS NOT NULL THEN array_to_string(list_filter([{x}], lambda k: k IS NOT NULL), ',') END"
    return f"SELECT doc_id, {shown(every)} AS languages_all, {shown(some)} AS languages_any FROM ({sampled_sql()})"


def pair_bins_sql(cfg, metrics, bins=10):
    from itertools import combinations
    low = ", ".join(f"min({m}::DOUBLE) AS lo_{m}, max({m}::DOUBLE) AS hi_{m}" for m in metrics)
    cell = ", ".join(f"""CASE WHEN hi_{m} = lo_{m} THEN 0
        ELSE least(floor(({m}::DOUBLE - lo_{m}) / (hi_{m} - lo_{m}) * {float(bins)!r}e0), {bins - 1}) END::INTEGER AS b_{m}"""
                     for m in metrics)
    parts = " UNION ALL ".join(f"SELECT arm, '{x}' AS x_col, '{y}' AS y_col, b_{x} AS x_bin, b_{y} AS y_bin, count(*)::BIGINT AS n "
                               f"FROM cells GROUP BY arm, b_{x}, b_{y}" for x, y in combinations(metrics, 2))
    return f"""
WITH {paired_cte(cfg)},
spans AS (SELECT arm, {low} FROM complete GROUP BY arm),
cells AS (SELECT arm, {cell} FROM complete JOIN spans USING (arm))
{parts}"""


def beam_step_sql(cfg, beams, steps):
    made = ""
    for k in range(1, steps + 1):
        made += f""",
g{k} AS (SELECT b.id, b.beam AS back, c.tok, b.score + c.score AS score,
          row_number() OVER (PARTITION BY b.id ORDER BY b.score + c.score DESC, b.beam, c.score DESC, c.tok) AS beam
        FROM b{k - 1} b JOIN cand c ON c.prev = b.tok),
b{k} AS (SELECT id, {k} AS step, beam, tok, back, score FROM g{k} WHERE beam <= {beams})"""
    told = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(1, steps + 1))
    return f"""
WITH {token_ids_cte("documents", "doc_id", "text", cfg)},
cnt AS (SELECT p AS prev, c AS tok, count(*)::BIGINT AS n FROM bg WHERE p IS NOT NULL GROUP BY p, c),
cand AS (SELECT prev, tok, round(ln(n::DOUBLE / sum(n) OVER (PARTITION BY prev)::DOUBLE) * 1e6)::BIGINT AS score FROM cnt),
b0 AS (SELECT id, 0 AS step, 1 AS beam, arg_max(c, pos) AS tok, 0::BIGINT AS back, 0::BIGINT AS score FROM tid GROUP BY id){made}
SELECT docs.key AS doc_id, t.step::INTEGER AS step, t.beam::INTEGER AS beam, t.tok, t.back::INTEGER AS back, t.score
FROM ({told}) t JOIN docs USING (id)"""


NOT_LABELLED = "(SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"

ORACLE = {
    "detect_distinct": detect_sql(CFG_DISTINCT),
    "detect_standard": detect_sql(CFG),
    "detect_legacy_tail": detect_sql(CFG_DISTINCT.replace(select_green_tokens=False)),
    "green_mask": green_mask_sql(CFG),
    "bigram_freq": bigram_freq_sql(CFG),
    "bigram_green_table": bigram_green_table_sql(CFG),
    "greenlist_explicit": greenlist_explicit_sql(CFG_SMALL_V),
    "tokenize": TOKENIZE_SQL,
    "vocab_build": VOCAB_BUILD_SQL,
    "vocab_encode": VOCAB_ENCODE_SQL,
    "ids_to_text": IDS_TO_TEXT_SQL,
    "bos_strip": bos_strip_sql(CFG),
    "prompt_truncate": prompt_truncate_sql(PROMPT_CAP, TRUNC_NOTICE),
    "unicode_whitespaces": unicode_sql("whitespaces"),
    "unicode_ascii": unicode_sql("ascii"),
    "unicode_idn": unicode_sql("idn"),
    "script_vote": script_vote_sql(),
    "category_lookup": category_lookup_sql(),
    "text_scripts": text_scripts_sql(),
    "variant_spellings": variant_spellings_sql(),
    "variant_strategies": variant_strategies_sql(),
    "truecase_model": TRUECASE_MODEL_SQL,
    "truecase_apply": truecase_apply_sql(),
    "detect_normalized": detect_normalized_sql(),
    "alphabet_sets": alphabet_sets_sql(),
    "text_languages": text_languages_sql(),
    "pair_bins": pair_bins_sql(CFG, ANALYSIS_METRICS),
    "beam_step": beam_step_sql(CFG, BEAMS, BEAM_STEPS),
    "bias_scores": bias_scores_sql(CFG),
    "greedy_next": greedy_next_sql(CFG),
    "sampled_next": sampled_next_sql(CFG, SAMPLE_SEED),
    "transition_table": transition_table_sql(CFG),
    "paired_results": paired_results_sql(CFG),
    "threshold_rates": threshold_rates_sql(CFG),
    "arm_summary": arm_summary_sql(CFG),
    "histograms": histograms_sql(CFG, ANALYSIS_METRICS),
    "pair_corr": pair_corr_sql(CFG, ANALYSIS_METRICS),
    "sweep_grid": sweep_grid_sql(CFG, gamma_grid(vocab_size=CFG.vocab_size)),
    "sweep_surface": sweep_surface_sql(CFG, gamma_grid(vocab_size=CFG.vocab_size)),
    "batched_results": detect_sql(CFG),
    "resume_anti_join": detect_sql(CFG, table=NOT_LABELLED),
    # a repeated id is scored once, whichever of its rows came first; tables at hand repeat none
    "stream_detect": detect_sql(CFG, table=NOT_LABELLED),
    "detect_conversations": detect_sql(
        CFG_DISTINCT, table="(SELECT concat_ws(':', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS id, text "
                            "FROM conversations)", id_col="id"),
    "limit_ordered": detect_sql(CFG, table=f"(SELECT * FROM documents ORDER BY doc_id NULLS FIRST LIMIT {LIMIT_ROWS})"),
    "display_table": display_table_sql(CFG),
    "category_codes": CATEGORY_CODES_SQL,
}
