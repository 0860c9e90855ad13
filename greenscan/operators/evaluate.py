"""Paired evaluation: arms, paired rows, resume, sweeps, error rates (J1, J3, J8,
P4, U1, A20, A21, S3-S5).

When both arms are columns of one row, each is scored row-locally and the paired
row needs no join (one stage over the scan). Arms that arrive as separate tables
are paired with an equi join on the id (J3).
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenscan.config import WatermarkConfig
from greenscan.functions import codepoints as cps
from greenscan.functions import greenlist as gl
from greenscan.functions.stats import with_normal_sf
from greenscan.operators.detect import bigram_codes, score_ids

ARM_METRICS = ("num_tokens_scored", "num_green_tokens", "green_fraction", "z_score", "p_value",
               "prediction")
ARMS = ("WO", "W")
LITERAL_V = gl.LITERAL_V

RESULT_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + [T.StructField(f"{arm}_{m}", t) for arm in ARMS for m, t in (
        ("num_tokens_scored", T.LongType()), ("num_green_tokens", T.LongType()),
        ("green_fraction", T.DoubleType()), ("z_score", T.DoubleType()), ("p_value", T.DoubleType()),
        ("prediction", T.BooleanType()), ("num_output_token", T.LongType()))])
RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]


def paired_from_columns(df: DataFrame, cfg: WatermarkConfig, id_col: str = "id",
                        wo_ids: str = "WO_ids", w_ids: str = "W_ids",
                        wo_n: str = "WO_num_output_token", w_n: str = "W_num_output_token") -> DataFrame:
    """15-column result row (P4) from one row holding both arms' ids."""
    base = df.select(F.col(id_col).cast("string").alias("id"), wo_ids, w_ids,
                     F.col(wo_n).cast("bigint").alias("WO_num_output_token"),
                     F.col(w_n).cast("bigint").alias("W_num_output_token"))
    s = score_ids(base, wo_ids, cfg, prefix="WO_", literal=True)
    s = score_ids(s, w_ids, cfg, prefix="W_", literal=True)
    return s.select(*RESULT_COLUMNS)


def pair_long(arms: DataFrame, id_col: str = "id", arm_col: str = "arm") -> DataFrame:
    """Pair arm rows ``(id, arm, metrics..., num_output_token)`` into the wide row by
    an inner equi join on the id (J3)."""
    cols = list(ARM_METRICS) + ["num_output_token"]
    side = {a: arms.where(F.col(arm_col) == a).select(
        F.col(id_col).cast("string").alias("id"), *[F.col(c).alias(f"{a}_{c}") for c in cols])
        for a in ARMS}
    return side["WO"].join(side["W"], "id", "inner").select(*RESULT_COLUMNS)


def unpivot_arms(results: DataFrame) -> DataFrame:
    """Wide result rows -> (id, arm, metrics..., num_output_token)."""
    cols = list(ARM_METRICS) + ["num_output_token"]
    parts = [results.select("id", F.lit(a).alias("arm"), *[F.col(f"{a}_{c}").alias(c) for c in cols])
             for a in ARMS]
    return parts[0].unionByName(parts[1])


# --------------------------------------------------------------- resume

def read_results(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Existing results, or an empty table when none were written yet."""
    try:
        if fmt == "csv":
            return spark.read.schema(RESULT_SCHEMA).option("header", True).csv(path)
        return spark.read.schema(RESULT_SCHEMA).parquet(path)
    except Exception as e:  # absent path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], RESULT_SCHEMA)
        raise


def skip_done(todo: DataFrame, done: DataFrame, id_col: str = "id", done_id: str = "id") -> DataFrame:
    """Rows whose id is not in ``done`` (J1). Ids compare as strings on both sides,
    so numeric-looking ids are not missed (Q2)."""
    d = done.select(F.col(done_id).cast("string").alias("_done"))
    return todo.join(d, F.col(id_col).cast("string") == F.col("_done"), "left_anti")


def append_results(new: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch of result rows (S5). What earlier calls wrote stays as it is (Q21)."""
    w = new.select(*RESULT_COLUMNS).write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def combine(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together."""
    return existing.unionByName(new, allowMissingColumns=True)


# ----------------------------------------------------------------- sweeps

def gamma_grid(lo: float = 0.10, hi: float = 0.90, step: float = 0.05, vocab_size: int = 32003):
    """[(gamma, int(V * gamma))] with the truncation done here, in Python."""
    n = int(round((hi - lo) / step)) + 1
    out = []
    for i in range(n):
        g = round(lo + i * step, 10)
        out.append((g, int(vocab_size * g)))
    return out


def threshold_grid(lo: float = 0.0, hi: float = 10.0, step: float = 0.1):
    n = int(round((hi - lo) / step))
    return [i for i in range(n + 1)], step


def sweep_gamma(df: DataFrame, ids_col: str, cfg: WatermarkConfig, grid=None, keep=("id",)) -> DataFrame:
    """Every text re-scored for every gamma of the grid (J8), as a sweep must.

    No join and no per-grid-point pass: the permutation rank of a bigram does not
    depend on gamma, so each bigram gets one bucket - how many grid sizes G_k are
    <= its rank - and a bigram is green at grid point k exactly when its bucket is
    <= k. One aggregation per text counts bigrams per bucket (partial aggregation:
    a text's rows sit in one partition, so one row per text is shuffled); the green
    count at k is a prefix sum of those counts.
    """
    grid = sorted(grid or gamma_grid(vocab_size=cfg.vocab_size), key=lambda t: t[1])
    V = cfg.vocab_size
    head, tail = _pairs(F.col(ids_col))
    keys = F.transform(head, lambda p: gl.seed_key(p, cfg.hash_key))
    ranks = F.zip_with(keys, tail, lambda k, c: gl.rank_from_key(k, c, cfg.vocab_size))
    if cfg.ignore_repeated_bigrams:  # equal bigrams have equal ranks: one row per distinct code
        coded = F.zip_with(bigram_codes(F.col(ids_col), V), ranks, lambda z, r: F.struct(z.alias("z"), r.alias("r")))
        ranks = F.transform(F.array_distinct(coded), lambda s: s["r"])
    # texts without a bigram keep one row (null rank), so that they come out with null scores
    # every row is a text of its own, also when ids repeat or are null
    keep = ["_row", *keep]
    rows = df.withColumn("_row", F.monotonically_increasing_id()).select(*keep, F.explode_outer(ranks).alias("_r"))
    # tail selection (legacy): green iff rank >= V - G  <=>  (V - 1 - rank) < G
    r = F.col("_r") if cfg.select_green_tokens else F.lit(V - 1) - F.col("_r")
    bucket = sum((r >= F.lit(n)).cast("int") for _, n in grid)
    rows = rows.select(*keep, bucket.alias("_b"))
    K = len(grid)
    agg = rows.groupBy(*keep).agg(F.count("_b").alias("num_tokens_scored"),
                                  *[F.count(F.when(F.col("_b") == k, 1)).alias(f"_h{k}") for k in range(K)])
    points = []
    for k, (g, _) in enumerate(grid):
        green = sum(F.col(f"_h{j}") for j in range(k + 1))
        points.append(F.struct(F.lit(float(g)).alias("gamma"), green.cast("bigint").alias("g")))
    per = agg.select(*keep, "num_tokens_scored", F.explode(F.array(*points)).alias("_s"))
    scored = F.col("num_tokens_scored") > 0
    per = per.select(*keep, F.col("_s.gamma").alias("gamma"),
                     F.when(scored, F.col("num_tokens_scored")).alias("num_tokens_scored"),
                     F.when(scored, F.col("_s.g")).alias("num_green_tokens"))
    t = F.col("num_tokens_scored").cast("double")
    g = F.col("num_green_tokens").cast("double")
    gm = F.col("gamma")
    per = per.drop("_row").withColumn("z_score", (g - gm * t) / F.sqrt(t * gm * (F.lit(1.0) - gm)))
    return with_normal_sf(per, "z_score", "p_value") \
        .withColumn("prediction", F.col("z_score") > F.lit(float(cfg.z_threshold)))


def sweep_surface(df: DataFrame, ids_col: str, cfg: WatermarkConfig, grid=None, lo: float = 0.0,
                  hi: float = 10.0, step: float = 0.5) -> DataFrame:
    """Detections at every point of gamma x threshold x repeats x head/tail (J8, A21): (gamma,
    ignore_repeated, select_green, threshold, n_scored, n_detected, rate).

    All settings come from one pass, without a join. A bigram's rank depends on none of them, so
    it gets one place: how many green sizes of the grid lie at or below it. Bigrams of a text, all
    and distinct ones, are exploded and counted per place in generated code; at most a row per text,
    kind and place is shuffled. A text then gives one number per setting, how many thresholds its z
    passes; these are counted (partially first: at most settings x thresholds rows a task), and the
    suffix sums of the counts are the sums over the threshold. Green in the tail is V - G ranks or
    more.

    Texts without a bigram, null ones included, are not scored; a setting without a scored text
    has no row, so an empty table gives none. With ``lo`` other than 0, z - lo is compared."""
    V = cfg.vocab_size
    grid = sorted(grid or gamma_grid(vocab_size=V), key=lambda t: t[1])
    sizes = sorted({n for _, n in grid} | {V - n for _, n in grid})
    # a generator is a barrier: codes are made once and read by name from here on
    codes = df.where(F.size(ids_col) > 1).select(F.explode(F.array(bigram_codes(F.col(ids_col), V))).alias("_c"))
    codes = codes.select(F.monotonically_increasing_id().alias("_row"), F.size("_c").alias("_n"),
                         F.concat("_c", F.array_distinct("_c")).alias("_c"))  # plain numbers: told apart by hash
    rows = codes.select("_row", "_n", F.posexplode("_c").alias("_i", "_z")).select(
        "_row", (F.col("_i") >= F.col("_n")).alias("ignore_repeated"),
        F.call_function("div", F.col("_z"), F.lit(V).cast("bigint")).alias("_p"), (F.col("_z") % F.lit(V)).alias("_t"))
    if V <= LITERAL_V:
        mult, shift = gl.literal_keys(cfg)
        at = F.col("_p").cast("int")
        rank = (F.get(mult, at) * F.col("_t") + F.get(shift, at)) % F.lit(V).cast("bigint")
        place = F.get(cps.literal_array((bisect_right(sizes, r) for r in range(V)), "int"), F.col("_r").cast("int"))
    else:
        rank = gl.rank_from_key(gl.seed_key(F.col("_p"), cfg.hash_key), F.col("_t"), V)
        place = sum((F.col("_r") >= F.lit(n)).cast("int") for n in sizes)
    rows = rows.select("_row", "ignore_repeated", rank.alias("_r")).select("_row", "ignore_repeated", place.alias("_b"))
    # counted by place first: a column per place would be too large a loop for the JVM to compile
    placed = rows.groupBy("_row", "ignore_repeated", "_b").agg(F.count(F.lit(1)).alias("_m"))
    per = placed.groupBy("_row", "ignore_repeated").agg(F.collect_list(F.struct("_b", "_m")).alias("_h"), F.sum("_m").alias("_all"))
    below = F.transform(F.array(*[F.lit(i) for i in range(len(sizes))]), lambda i: F.aggregate(
        "_h", F.lit(0).cast("bigint"), lambda acc, e: F.when(e["_b"] <= i, acc + e["_m"]).otherwise(acc)))
    per = per.select("ignore_repeated", "_all", below.alias("_below"))
    below = {n: F.get("_below", F.lit(i)) for i, n in enumerate(sizes)}  # ranks below n
    total = F.col("_all")
    points = [F.struct(F.lit(float(gamma)).alias("gamma"), F.lit(first).alias("select_green"), g.cast("double").alias("g"))
              for gamma, n in grid for first, g in ((True, below[n]), (False, total - below[V - n]))]
    per = per.select("ignore_repeated", total.cast("double").alias("t"), F.explode(F.array(*points)).alias("p")) \
        .select("ignore_repeated", "t", "p.*")
    gm, t = F.col("gamma"), F.col("t")
    z = (F.col("g") - gm * t) / F.sqrt(t * gm * (F.lit(1.0) - gm))
    js, _ = threshold_grid(lo, hi, step)
    setting = ["gamma", "ignore_repeated", "select_green"]
    n_thr, start = len(js), F.lit(float(lo))
    hist = per.select(*setting, passes_count(z - start, n_thr, step).alias("m")) \
        .groupBy(*setting, "m").agg(F.count(F.lit(1)).alias("c"))
    counts = hist.groupBy(*setting).agg(F.collect_list(F.struct("m", "c")).alias("h"), F.sum("c").alias("n_scored"))
    passed = F.transform(F.array(*[F.lit(j) for j in js]), lambda j: F.struct(
        (start + j / F.lit(1.0 / step)).alias("threshold"),
        F.aggregate(F.filter("h", lambda e: e["m"] > j), F.lit(0).cast("bigint"),
                    lambda acc, e: acc + e["c"]).alias("n_detected")))
    return counts.select(*setting, "n_scored", F.explode(passed).alias("r")).select(
        *setting, F.col("r.threshold").alias("threshold"), "n_scored", F.col("r.n_detected").alias("n_detected"),
        (F.col("r.n_detected") / F.col("n_scored")).alias("rate"))


def _pairs(ids: Column):
    n = F.size(ids)
    return (F.slice(ids, 1, F.greatest(n - 1, F.lit(0))), F.slice(ids, 2, F.greatest(n - 1, F.lit(0))))


def passes_count(z: Column, n_thr: int, step: float) -> Column:
    """How many grid thresholds t_j = j * step (j = 0..n_thr-1) lie strictly below z,
    exact at the boundaries (t_j is computed as j / (1/step) in DOUBLE)."""
    inv = 1.0 / step
    k = F.floor(z * F.lit(inv))
    cnt = F.when((k + 1) / F.lit(inv) < z, k + 2).when(k / F.lit(inv) < z, k + 1).otherwise(k)
    return F.least(F.greatest(cnt, F.lit(0)), F.lit(n_thr)).cast("int")


def threshold_rates(arms: DataFrame, arm_col: str = "arm", z_col: str = "z_score",
                    lo: float = 0.0, hi: float = 10.0, step: float = 0.1) -> DataFrame:
    """Detection rate of each arm at every threshold of a grid (A21): the FPR is the
    rate on the WO arm, the TPR on the W arm.

    Each text contributes one number (how many thresholds its z passes); a histogram
    of that number per arm (at most one row per grid point) is turned into suffix
    sums row-locally. No text is compared with every threshold and nothing is joined.
    """
    js, _ = threshold_grid(lo, hi, step)
    n_thr = len(js)
    inv = 1.0 / step
    z = arms.where(F.col(z_col).isNotNull()).select(arm_col, passes_count(F.col(z_col), n_thr, step).alias("m"))
    hist = z.groupBy(arm_col, "m").agg(F.count(F.lit(1)).alias("c"))
    per_arm = hist.groupBy(arm_col).agg(F.collect_list(F.struct("m", "c")).alias("h"),
                                        F.sum("c").alias("n"))
    grid = F.array(*[F.lit(j) for j in js])
    rates = per_arm.select(arm_col, "n", F.explode(F.transform(grid, lambda j: F.struct(
        j.alias("j"), F.aggregate(F.filter("h", lambda e: e["m"] > j), F.lit(0).cast("bigint"),
                                  lambda acc, e: acc + e["c"]).alias("passed")))).alias("r"))
    rates = rates.select(arm_col, "n", F.col("r.j").alias("j"), F.col("r.passed").alias("passed"))
    wide = rates.groupBy("j").agg(
        *[F.max(F.when(F.col(arm_col) == a, F.col("passed"))).alias(f"{a}_passed") for a in ARMS],
        *[F.max(F.when(F.col(arm_col) == a, F.col("n"))).alias(f"{a}_n") for a in ARMS])
    return wide.select((F.col("j") / F.lit(inv)).alias("threshold"),
                       (F.col("WO_passed") / F.col("WO_n")).alias("fpr"),
                       (F.col("W_passed") / F.col("W_n")).alias("tpr"),
                       F.col("WO_n").alias("n_wo"), F.col("W_n").alias("n_w"))


def arm_summary(arms: DataFrame, arm_col: str = "arm") -> DataFrame:
    """Per arm: rows, scored rows, predicted rate, mean and sd of z, mean green
    fraction (A20). One aggregation with partial combining."""
    return arms.groupBy(arm_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("z_score").alias("n_scored"),
        F.avg(F.col("prediction").cast("double")).alias("predicted_rate"),
        F.avg("z_score").alias("mean_z"),
        F.stddev_samp("z_score").alias("sd_z"),
        F.avg("green_fraction").alias("mean_green_fraction"))


def rewrite_counts(df: DataFrame, ids_col: str, greedy: DataFrame, cfg: WatermarkConfig) -> DataFrame:
    """Watermarked arm by greedy decoding under teacher forcing (G5 with the bias of G2): every
    second token is replaced by the biased argmax successor of the original token before it;
    other tokens are kept. ``df`` without the ids, with the standard-mode counts of both arms: T,
    ``g0`` green tokens of the text as written and ``g`` of the rewritten one (0 without a bigram).

    Successors and greenlist keys are arrays of V elements, constants of the plan (V is a
    parameter). A text's places are exploded next to its ids and counted in the same generated
    loop, so one row per text is shuffled; nothing is joined and no hash is taken per place.
    ``greedy``: (prev, next_tok), at most V rows. Beyond ``LITERAL_V`` the successors are joined
    to exploded rows instead."""
    keep = [c for c in df.columns if c != ids_col]
    if cfg.vocab_size > LITERAL_V:
        return _rewrite_counts_joined(df, ids_col, greedy, cfg).select(*keep, "T", "g0", "g")
    V = cfg.vocab_size
    succ = [-1] * V
    for r in greedy.select("prev", "next_tok").collect():  # at most V rows
        succ[r["prev"]] = r["next_tok"]
    successor = cps.literal_array(succ, "bigint")
    mult, shift = gl.literal_keys(cfg)
    ids, i = F.col(ids_col), F.col("_i")
    places = F.when(F.size(ids) > 1, F.sequence(F.lit(1), F.size(ids) - 1))
    rows = df.withColumn("_row", F.monotonically_increasing_id()) \
        .select("_row", *keep, ids_col, F.explode_outer(places).alias("_i")) \
        .select("_row", *keep, F.get(ids, i - 2).alias("_b"), F.get(ids, i - 1).alias("_p"),
                F.get(ids, i).alias("_c"), (i % 2 == 1).alias("_odd"))

    def chosen(before: Column, kept: Column) -> Column:
        return F.coalesce(F.nullif(F.get(successor, before.cast("int")), F.lit(-1)), kept)

    # one look-up per place: of the token before at odd places, of the one before that at even ones
    rows = rows.withColumn("_s", chosen(F.when(F.col("_odd"), F.col("_p")).otherwise(F.col("_b")),
                                        F.when(F.col("_odd"), F.col("_c")).otherwise(F.col("_p"))))
    rows = rows.select("_row", *keep, "_p", "_c", F.when(F.col("_odd"), F.col("_p")).otherwise(F.col("_s")).alias("_wp"),
                       F.when(F.col("_odd"), F.col("_s")).otherwise(F.col("_c")).alias("_wc"))

    def n_green(p: str, c: str) -> Column:
        at = F.col(p).cast("int")
        rank = (F.get(mult, at) * F.col(c) + F.get(shift, at)) % F.lit(V).cast("bigint")
        return F.count(F.when(gl.green_from_rank(rank, cfg), F.lit(1)))

    return rows.groupBy("_row", *keep).agg(F.count("_c").alias("T"), n_green("_p", "_c").alias("g0"),
                                           n_green("_wp", "_wc").alias("g")).drop("_row")


def _rewrite_counts_joined(df: DataFrame, ids_col: str, greedy: DataFrame, cfg: WatermarkConfig) -> DataFrame:
    t = F.col(ids_col)
    n = F.size(t)
    cur = F.slice(t, 2, F.greatest(n - 1, F.lit(0)))
    prev = F.slice(t, 1, F.greatest(n - 1, F.lit(0)))
    prev2 = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(t, 1, F.greatest(n - 2, F.lit(0))))
    ctx = F.arrays_zip(prev2.alias("pp"), prev.alias("p"), cur.alias("c"))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_all", F.struct(*df.columns)) \
        .select("_row", F.col("_all").alias("_kept"), F.posexplode_outer(ctx).alias("_j", "r"))
    odd = F.col("_j") % 2 == 0
    rows = rows.select("_row", F.when(F.col("_j") == 0, F.col("_kept")).otherwise(
        F.when(F.col("_j").isNull(), F.col("_kept"))).alias("_kept"), odd.alias("_odd"), "r.p", "r.c",
        F.when(odd, F.col("r.p")).otherwise(F.col("r.pp")).alias("_key"))
    j = rows.join(greedy.select(F.col("prev").alias("_key"), F.col("next_tok").alias("_g")), "_key", "left")
    wp = F.when(F.col("_odd"), F.col("p")).otherwise(F.coalesce("_g", "p"))
    wc = F.when(F.col("_odd"), F.coalesce("_g", "c")).otherwise(F.col("c"))
    j = j.select("_row", "_kept", "c", gl.is_green(wp, wc, cfg).alias("_green"),
                 gl.is_green(F.col("p"), F.col("c"), cfg).alias("_green0"))
    n_green = lambda flag: F.count(F.when(F.col("c").isNotNull() & F.col(flag), F.lit(1)))
    agg = j.groupBy("_row").agg(F.first("_kept", ignorenulls=True).alias("_kept"), F.count("c").alias("T"),
                                n_green("_green0").alias("g0"), n_green("_green").alias("g"))
    return agg.select("_kept.*", "T", "g0", "g")


def run_evaluation(spark, cfg: WatermarkConfig, sf_dir: str, results_path: str,
                   model_words: int = 500, fmt: str = "parquet", models: dict | None = None,
                   batches: int = 16) -> DataFrame:
    """The batch evaluation of the reference as one job (section 3.1 of the survey):
    dataset profile scan with split and limit -> skip ids already in the results (J1)
    -> both arms generated (G6) -> both scored and paired (J3, P4) -> appended to the
    results batch by batch (S5, Q21) -> old and new rows together (U1).

    Prompts are the documents cut to the prompt cap; the bigram model is learned from
    the same table. Rows are appended in ``batches`` parts, dealt by their ids; a run that is
    cut off leaves the parts that were written, and the next one skips their ids.
    """
    from greenscan.functions.normalize import apply_chain
    from greenscan.functions.tokens import text_to_ids
    from greenscan.operators import generate as gen
    from greenscan.operators.batches import batch_of
    from greenscan.operators.detect import text_guard
    from greenscan.session import kept
    from greenscan.sources.tables import prepare_dataset, spread
    cap = cfg.prompt_max_length or (2048 - cfg.max_new_tokens)
    data = spread(prepare_dataset(spark, sf_dir, cfg.dataset_name_or_path, cfg.dataset_section,
                                  cfg.limit_dataset))
    existing = read_results(spark, results_path, fmt)
    # cleaned text, the configured tokens; the model is learned from the whole split, done or
    # not, so that a run in several parts gives the rows of a single run
    clean = apply_chain(data.withColumn("document", F.col("document")), "document", cfg.normalizers, key="id",
                        models=models)
    ids = clean.select("id", "document", text_to_ids(
        F.when(text_guard(F.col("document")).isNull(), F.col("document")).otherwise(F.lit("")),
        cfg.vocab_size, cfg.token_pattern, cfg.lowercase).alias("ids"))
    words = gen.top_word_ids(ids, "document", model_words, cfg.vocab_size)
    todo = skip_done(ids, existing, "id", "id")
    prompts = kept(todo.select("id", F.slice("ids", 1, cap).alias("ids"),
                               batch_of(F.coalesce("id", F.lit("")), batches).alias("_batch")), "prompts")
    for k in range(batches):
        part = prompts.where(F.col("_batch") == k).drop("_batch")
        if part.isEmpty():
            continue
        arms = gen.generate_paired(part, ids.select("ids"), cfg, "id", "ids", None, cfg.max_new_tokens,
                                   model_tokens=words)
        append_results(paired_from_columns(arms, cfg), results_path, fmt)
    # old rows and new ones (U1): the sink now holds both; drop the cached listing
    spark.catalog.refreshByPath(results_path)
    return read_results(spark, results_path, fmt)
