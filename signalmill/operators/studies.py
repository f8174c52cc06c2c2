"""Validation studies: hold-outs, rank tests, matching, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import canonical_label
from signalmill.operators.ordinal import with_ordinals, with_prefix_sums


def avg_rank(df: DataFrame, value: str = "value", by=()) -> DataFrame:
    """average rank over ties, from a histogram of values per group; its prefix sums come from range partitions."""
    by = list(by)
    h = with_prefix_sums(df.groupBy(*by, value).agg(F.count("*").alias("t")), [*by, value], {"_before": "t"})
    # Sums run over all groups in turn, so a group's ranks start at its own least sum.
    start = h.groupBy(*by).agg(F.min("_before").alias("_start")).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_start")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    h = h.join(start, same) if by else h.withColumn("_start", F.lit(0))
    h = h.withColumn("rank", F.col("_before") - F.col("_start") + (F.col("t") + 1) / 2)
    named = h.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, value])], "rank")
    both = F.lit(True)
    for i, c in enumerate([*by, value]):
        both = both & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, both).select(*df.columns, "rank")


def _erf(x: Column) -> Column:
    """Rational approximation of the error function for x >= 0."""
    t = 1 / (1 + F.lit(0.3275911) * x)
    poly = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + c
    return 1 - poly * t * F.exp(-x * x)


def mann_whitney(df: DataFrame, value: str = "value", group: str = "grp", by=()) -> DataFrame:
    """K2: n1, n2, u, z and two-sided p of group 0 against group 1, with tie correction; a missing side gives p = 1.

    Works on the histogram of values; its prefix sums come from range partitions over all
    groups, and a group's ranks start at its own least sum.
    """
    by = list(by)
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum((F.col(group) == 0).cast("long")).alias("a"), F.sum((F.col(group) == 1).cast("long")).alias("b"))
    t = F.col("a") + F.col("b")
    h = with_prefix_sums(h.withColumn("t", t), [*by, value], {"_before": "t"})
    g = h.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("_before") + (t + 1) / 2)).alias("_r"), F.min("_before").alias("_start"), F.sum(t * t * t - t).alias("ties")
    )
    g = g.withColumn("r1", F.col("_r") - F.col("n1") * F.col("_start"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(F.greatest(n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))), F.lit(0.0)))
    ok = (n1 > 0) & (n2 > 0)
    z = F.when(ok & (sigma > 0), (u - n1 * n2 / 2) / F.nullif(sigma, F.lit(0.0))).otherwise(0.0)
    g = g.withColumn("u", F.when(ok, u).otherwise(0.0)).withColumn("z", z)
    p = F.when(ok, F.least(F.greatest(1 - _erf(F.abs("z") / F.sqrt(F.lit(2.0))), F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return g.select(*by, "n1", "n2", "u", "z", p.alias("p"))


def holdout(buckets: DataFrame, horizon: int = 56, least_pre: int = 3) -> DataFrame:
    """K1: per entity, mentions in the horizon before and after the cut-off (last day less the horizon), ratio, survival."""
    edge = buckets.groupBy("tenant").agg(F.date_sub(F.max("bucket_date"), horizon).alias("cut"))
    ago = F.datediff("bucket_date", "cut")
    b = buckets.join(edge, "tenant")
    t = lambda c: F.coalesce(F.sum(F.when(c, F.col("mentions"))), F.lit(0))
    h = b.groupBy("tenant", "entity").agg(t((ago > -horizon) & (ago <= 0)).alias("pre"), t((ago > 0) & (ago <= horizon)).alias("post")).where(F.col("pre") >= least_pre)
    return h.withColumn("ratio", (F.col("post") + 1) / (F.col("pre") + 1)).withColumn("survived", F.col("post") > 0)


def before_cut(buckets: DataFrame, horizon: int = 56) -> DataFrame:
    """K1: the rows that gate inputs may use."""
    edge = buckets.groupBy("tenant").agg(F.date_sub(F.max("bucket_date"), horizon).alias("cut"))
    return buckets.join(edge, "tenant").where(F.col("bucket_date") <= F.col("cut")).drop("cut")


def compare_cohorts(df: DataFrame, flag: str, by=(), least: int = 20) -> DataFrame:
    """K3: sizes, median growth and post, share active, ratio of medians, rank test and whether a side is underpowered."""
    by = list(by)
    side = lambda k, c: F.percentile(F.when(F.col(flag) == k, F.col(c)), F.lit(0.5))
    m = df.groupBy(*by).agg(
        side(True, "ratio").alias("growth_yes"), side(False, "ratio").alias("growth_no"), side(True, "post").alias("post_yes"), side(False, "post").alias("post_no"),
        F.avg(F.when(F.col(flag), F.col("survived").cast("int"))).alias("active_yes"), F.avg(F.when(~F.col(flag), F.col("survived").cast("int"))).alias("active_no"),
    )
    u = mann_whitney(df.withColumn("_g", F.when(F.col(flag), 0).otherwise(1)), "ratio", "_g", by)
    j = m.join(u, by) if by else m.crossJoin(u)  # single rows
    out = j.withColumn("edge", F.when(F.col("growth_no") > 0, F.col("growth_yes") / F.col("growth_no")))
    return out.withColumn("underpowered", (F.col("n1") < least) | (F.col("n2") < least))


def volume_band(pre: Column) -> Column:
    return F.when(pre.between(3, 5), "3-5").when(pre.between(6, 10), "6-10").when(pre.between(11, 20), "11-20").when(pre >= 21, "21+")


def compare_in_bands(df: DataFrame, flag: str, least: int = 10) -> DataFrame:
    """K4: K3 in bands of volume; bands with fewer rows than `least` are left out."""
    b = df.withColumn("band", volume_band(F.col("pre"))).where("band is not null")
    big = b.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("band")
    return compare_cohorts(b.join(big, "band", "left_semi"), flag, ["band"])


def predictor_study(buckets: DataFrame, horizon: int = 56) -> DataFrame:
    """K5: rank tests of the forward ratio by whether each predictor at the cut-off is above its median."""
    from signalmill.operators.growth import share_of_voice

    h = holdout(buckets, horizon)
    past = before_cut(buckets, horizon)
    cut = past.groupBy("tenant").agg(F.max("bucket_date").alias("last"))
    ago = F.datediff("last", "bucket_date")
    t = lambda a, b: F.coalesce(F.sum(F.when(ago.between(a, b), F.col("mentions"))), F.lit(0))
    g = past.join(cut, "tenant").groupBy("tenant", "entity").agg(t(0, 6).alias("w0"), t(7, 13).alias("w1"), t(0, 29).alias("m0"), t(30, 59).alias("m1"))
    rate = lambda a, b: F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b))
    g = g.select("tenant", "entity", rate("w0", "w1").alias("wow"), rate("m0", "m1").alias("mom"), F.col("m0").cast("double").alias("volume"))
    j = h.join(g, ["tenant", "entity"]).join(share_of_voice(past).select("tenant", "entity", "sov_growth"), ["tenant", "entity"], "left")
    long = j.unpivot(["tenant", "entity", "ratio", "post"], ["wow", "mom", "volume", "sov_growth"], "predictor", "x").where("x is not null")
    mid = long.groupBy("predictor").agg(F.percentile("x", F.lit(0.5)).alias("mid"))
    long = long.join(mid, "predictor").withColumn("grp", F.when(F.col("x") > F.col("mid"), 0).otherwise(1))
    rates = long.groupBy("predictor").agg(F.avg((F.col("grp") == 0).cast("int")).alias("pass_rate"))
    return mann_whitney(long, "ratio", "grp", ["predictor"]).join(rates, "predictor")


#: K6: name, least bits, least authors, alpha, whether significance and breadth count.
VARIANTS = (
    ("shipped", 1.0, 10, 0.05, True, True), ("breadth_only", 1.0, 10, 0.05, False, True), ("significance_only", 1.0, 10, 0.05, True, False), ("loose_alpha", 1.0, 10, 0.2, True, True),
    ("low_bits", 0.5, 10, 0.05, True, True), ("high_bits", 1.5, 10, 0.05, True, True), ("more_authors", 1.0, 20, 0.05, True, True),
)


def variant_sweep(cases: DataFrame, variants=VARIANTS) -> DataFrame:
    """K6: seven gate configurations on one prepared input, ranked by edge where p < .05 first.

    cases: ratio, p_value, entropy_bits, total_authors.
    """
    spark = cases.sparkSession
    v = spark.createDataFrame(list(variants), "variant string, bits double, authors int, alpha double, use_sig boolean, use_breadth boolean")
    j = cases.crossJoin(F.broadcast(v))  # seven rows
    ok = (~F.col("use_sig") | (F.col("p_value") <= F.col("alpha"))) & (~F.col("use_breadth") | ((F.col("entropy_bits") >= F.col("bits")) & (F.col("total_authors") >= F.col("authors"))))
    j = j.withColumn("grp", F.when(ok, 0).otherwise(1))
    side = lambda k: F.percentile(F.when(F.col("grp") == k, F.col("ratio")), F.lit(0.5))
    m = j.groupBy("variant").agg((side(0) / side(1)).alias("edge"))
    return mann_whitney(j, "ratio", "grp", ["variant"]).join(m, "variant").orderBy((F.col("p") >= 0.05), F.desc_nulls_last("edge"), "variant")


def significance_diagnostics(df: DataFrame) -> DataFrame:
    """K7: share of passes overall and among broad entities, with median growth of each combination."""
    return df.groupBy("breadth_pass").agg(
        F.count("*").alias("n"), F.avg(F.col("significance_pass").cast("int")).alias("pass_rate"),
        F.percentile(F.when(F.col("significance_pass"), F.col("ratio")), F.lit(0.5)).alias("growth_pass"),
        F.percentile(F.when(~F.col("significance_pass"), F.col("ratio")), F.lit(0.5)).alias("growth_fail"),
    )


def normalised_slope(series: DataFrame, least: int = 4) -> DataFrame:
    """K8: least-squares slope on the index over the mean, for `least` points and a positive mean. series (entity, at, value)."""
    i = F.row_number().over(Window.partitionBy("entity").orderBy("at")) - 1
    s = series.withColumn("i", i).groupBy("entity").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("b"), F.avg("value").alias("m"))
    return s.select("entity", "n", F.when((F.col("n") >= least) & (F.col("m") > 0), F.col("b") / F.col("m")).alias("slope"))


def pre_post_ratio(series: DataFrame, cut, horizon: int, least: int = 4) -> DataFrame:
    """K9: mean after over mean before a day, equal spans, with `least` points on either side."""
    ago = F.datediff(F.col("at"), F.lit(cut))
    pre, post = (ago > -horizon) & (ago <= 0), (ago > 0) & (ago <= horizon)
    s = series.groupBy("entity").agg(F.count_if(pre).alias("a"), F.count_if(post).alias("b"), F.avg(F.when(pre, F.col("value"))).alias("before"), F.avg(F.when(post, F.col("value"))).alias("after"))
    ok = (F.col("a") >= least) & (F.col("b") >= least) & (F.col("before") > 0)
    return s.select("entity", "before", "after", F.when(ok, F.col("after") / F.col("before")).alias("ratio"))


def dominant_language(links: DataFrame, signals: DataFrame) -> DataFrame:
    """Most frequent language of an entity's signals, ties to the lowest."""
    c = links.select("signal_id", "entity").join(signals.where("language is not null").select("signal_id", "language"), "signal_id").groupBy("entity", "language").agg(F.count("*").alias("n"))
    return c.groupBy("entity").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("language"))


def match_controls(cases: DataFrame, pool: DataFrame) -> DataFrame:
    """A control for each case, none used twice, as many pairs as the smaller side has rows, and no other choice has a smaller sum of differences.

    Equal volumes pair rank to rank by entity. What is left at a volume is of one side; read
    as steps up (cases) and down (controls) along the volumes, best pairs lie on one level, in
    turn, and on a level with an odd number of steps the one is left out that costs least
    (ties: the smallest volume). A level holds a volume once, so its window is bounded by the
    distinct volumes. Rows without a volume find no partner; entities are unique on a side.
    """
    rows = cases.select(F.lit(0).alias("side"), "entity", "volume").unionByName(pool.select(F.lit(1).alias("side"), "entity", "volume")).where("volume is not null")
    h = rows.groupBy("volume").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    h = with_prefix_sums(h, ["volume"], {"a_before": "a", "b_before": "b"})
    placed = with_ordinals(rows, ["volume", "side", "entity"], "_at").join(h, "volume")
    n = F.col("_at") - F.col("a_before") - F.col("b_before") - F.when(F.col("side") == 1, F.col("a")).otherwise(0)
    spare = n - F.least("a", "b")
    start = F.col("a_before") - F.col("b_before")
    level = F.when(F.col("side") == 0, start + spare).otherwise(start - spare - 1)
    steps = placed.select("side", "entity", "volume", n.alias("n"), (spare >= 0).alias("spare"), level.alias("level"))
    equal = steps.where("not spare").select("side", "entity", "volume", F.lit(None).cast("long").alias("level"), F.col("volume").alias("v"), "n")
    chain = Window.partitionBy("level").orderBy("volume")
    odd = F.col("i") % 2 == 1
    left = steps.where("spare").withColumn("i", F.row_number().over(chain)).withColumn("m", F.count("*").over(Window.partitionBy("level")))
    left = left.withColumn("upto", F.sum(F.when(odd, -F.col("volume")).otherwise(F.col("volume"))).over(chain))
    cost = F.when(odd & (F.col("m") % 2 == 1), F.struct((2 * F.col("upto") + F.col("volume")).alias("c"), "i"))
    left = left.withColumn("out", F.min(cost).over(Window.partitionBy("level"))["i"]).where("out is null or i <> out")
    place = F.floor((F.col("i") - F.when(F.col("i") > F.col("out"), 2).otherwise(1)) / 2)
    left = left.select("side", "entity", "volume", "level", F.lit(None).cast("long").alias("v"), place.alias("n"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pairs = equal.unionByName(left).groupBy("level", "v", "n").agg(of(0, "entity").alias("entity"), of(0, "volume").alias("volume"), of(1, "entity").alias("control"), of(1, "volume").alias("control_volume"))
    return pairs.drop("level", "v", "n")


def systematic_sample(df: DataFrame, k: int, order=("volume", "entity")) -> DataFrame:
    """F8: every step-th row of a ranked list, step = floor(n / k), k rows at most; places come from range partitions."""
    s = with_ordinals(df, list(order), "_i", "_n").withColumn("_s", F.greatest(F.floor(F.col("_n") / k), F.lit(1)))
    return s.where((F.col("_i") % F.col("_s") == 0) & (F.col("_i") / F.col("_s") < k)).drop("_i", "_s", "_n")


def bottom_k_overlap(df: DataFrame, flags: DataFrame, k: int = 3) -> DataFrame:
    """Flagged labels among the k narrowest of each group. df (grp, label, breadth)."""
    n = F.row_number().over(Window.partitionBy("grp").orderBy("breadth", "label"))
    return df.withColumn("n", n).where(F.col("n") <= k).join(flags, "label", "left_semi").select("grp", "label", "breadth")


def _contained(short: DataFrame, long: DataFrame, most: int = 5) -> DataFrame:
    """(s, l) of strings of `short` (s) that stand in strings of `long` (l).

    What stands in a string begins with one of its character n-grams, so the pairs meet in
    an equality join on the first `most` characters before they are compared.
    """
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.length("l") >= n, F.transform(F.sequence(F.lit(1), F.length("l") - n + 1), lambda i: F.substring(F.col("l"), i, n))).otherwise(F.array().cast("array<string>"))))
    have = long.select("l", F.explode(F.array_distinct(grams)).alias("_g"))
    return short.select("s", F.substring("s", 1, most).alias("_g")).where("s <> ''").join(have, "_g").where(F.col("l").contains(F.col("s"))).select("s", "l")


def match_benchmark(bench: DataFrame, entities: DataFrame) -> DataFrame:
    """Bench (name) with the entity of equal canonical form, else, for names of several words, one that contains it or is contained."""
    e = entities.select(F.col("entity"), canonical_label(F.col("entity")).alias("_c"))
    b = bench.withColumn("_k", canonical_label(F.col("name")))
    exact = b.join(e.groupBy("_c").agg(F.min("entity").alias("_e")), F.col("_k") == F.col("_c"), "left").drop("_c")
    rest = exact.where("_e is null").where(F.col("_k").contains(" ")).select("name", "_k").distinct()
    names, labels = rest.select("_k").distinct(), e.select("_c").distinct()
    within = _contained(names.select(F.col("_k").alias("s")), labels.select(F.col("_c").alias("l"))).select(F.col("s").alias("_k"), F.col("l").alias("_c"))
    around = _contained(labels.select(F.col("_c").alias("s")), names.select(F.col("_k").alias("l"))).select(F.col("l").alias("_k"), F.col("s").alias("_c"))
    loose = rest.join(within.union(around), "_k").join(e, "_c").groupBy("name").agg(F.min("entity").alias("_l"))
    return exact.join(loose, "name", "left").withColumn("entity", F.coalesce("_e", "_l")).drop("_k", "_e", "_l")


def benchmark_outcomes(matched: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcome of each benchmark name. verdicts (entity, had_data, decision)."""
    j = matched.join(verdicts, "entity", "left")
    outcome = (
        F.when(F.col("entity").isNull(), "not-found").when(~F.coalesce("had_data", F.lit(False)) | F.col("decision").isNull(), "held-no-signal")
        .when(F.col("decision") == "pass", "confirmed").otherwise("held-flat")
    )
    return j.withColumn("outcome", outcome)


def outcome_tallies(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("expected", "outcome").agg(F.count("*").alias("n"))


def label_checks(states: DataFrame, expected: DataFrame, as_of, hours: int = 12) -> DataFrame:
    """Whether any geography passes against what is expected, and whether the newest verdict is stale."""
    s = states.groupBy("entity").agg(F.max((F.col("decision") == "pass").cast("int")).alias("p"), F.max("checked_at").alias("checked_at"))
    j = expected.join(s, "entity", "left")
    got = F.when(F.coalesce("p", F.lit(0)) == 1, "pass").otherwise("hold")
    stale = F.col("checked_at").isNull() | (F.col("checked_at") < F.lit(as_of) - F.expr(f"interval {hours} hours"))
    return j.select("entity", "expected", got.alias("got"), (got == F.col("expected")).alias("match"), stale.alias("stale"))


def judge_accuracy(trials: DataFrame) -> DataFrame:
    """Correct and all trials overall, by group, by expectation and on the held-out part; ambiguous ones are left out."""
    t = trials.where("not ambiguous")
    keys = F.array(
        F.struct(F.lit("overall").alias("grouping"), F.lit("all").alias("value")), F.struct(F.lit("group").alias("grouping"), F.col("grp").cast("string").alias("value")),
        F.struct(F.lit("expected").alias("grouping"), F.col("expected").cast("string").alias("value")), F.struct(F.lit("held_out").alias("grouping"), F.col("held_out").cast("string").alias("value")),
    )
    g = t.select("correct", F.inline(keys)).groupBy("grouping", "value").agg(F.sum(F.col("correct").cast("int")).alias("right"), F.count("*").alias("trials"))
    return g.withColumn("accuracy", F.col("right") / F.col("trials"))


def bucket_rates(df: DataFrame) -> DataFrame:
    """Share of each kind among labels without error. df (arm, kind), kind 'error' excluded."""
    ok = F.col("kind") != "error"
    return df.groupBy("arm").agg(
        F.count_if(ok).alias("n"), (F.count_if(F.col("kind") == "instance") / F.nullif(F.count_if(ok), F.lit(0))).alias("instance_rate"), F.count_if(~ok).alias("errors")
    )


def half_rate_gate(rates: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Passes when the new arm's instance rate is at most half of the old one's."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("instance_rate")))
    r = rates.agg(pick(old).alias("old_rate"), pick(new).alias("new_rate"))
    return r.withColumn("passes", F.coalesce(F.col("new_rate") <= F.col("old_rate") / 2, F.lit(False)))


def interest_crosscheck(terms: DataFrame, series: DataFrame, cut, horizon: int, least: int = 8) -> DataFrame:
    """pre/post interest of surfaced terms against controls.

    terms (entity, grp 0 or 1, language, ok, calendar): only English, ok ones count. series
    (entity, fetched_at, at, value): the last fetch of a term wins. Two rows: all terms, and
    without calendar terms; missing counts terms without a ratio.
    """
    use = terms.where("language = 'en' and ok")
    last = series.join(series.groupBy("entity").agg(F.max("fetched_at").alias("fetched_at")), ["entity", "fetched_at"], "left_semi")
    j = use.join(pre_post_ratio(last, cut, horizon).select("entity", "ratio"), "entity", "left")
    j = j.select("*", F.explode(F.when(F.col("calendar"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("no_calendar")))).alias("arm"))
    m = j.groupBy("arm").agg(
        F.percentile(F.when(F.col("grp") == 0, F.col("ratio")), F.lit(0.5)).alias("surfaced"), F.percentile(F.when(F.col("grp") == 1, F.col("ratio")), F.lit(0.5)).alias("controls"),
        F.count_if(F.col("ratio").isNull() & (F.col("grp") == 0)).alias("missing_surfaced"), F.count_if(F.col("ratio").isNull() & (F.col("grp") == 1)).alias("missing_controls"),
    )
    return m.join(mann_whitney(j, "ratio", "grp", ["arm"]), "arm").withColumn("underpowered", (F.col("n1") < least) | (F.col("n2") < least))
