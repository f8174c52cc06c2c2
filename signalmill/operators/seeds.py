"""Seed queries: ownership, matches, attribution, yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import LANGUAGE_ALIASES, hashtag_variants, normalize_term, search_key, singularize


def expand_hashtags(queries: DataFrame, cap: int = 4) -> DataFrame:
    """The first `cap` distinct tag variants of each query's hashtags."""
    t = queries.select("query_id", F.posexplode("hashtags").alias("i", "tag")).select("query_id", "i", F.posexplode(hashtag_variants(F.col("tag"))).alias("j", "variant"))
    t = t.groupBy("query_id", "variant").agg(F.min(F.struct("i", "j")).alias("at"))
    return t.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).where(F.col("n") <= cap).select("query_id", "variant", "n")


def sanitize_hashtags(tags: DataFrame, jargon: list[str], cap: int = 6) -> DataFrame:
    """Plain tags of 3 to 30 characters, first wins, `cap` per group, without those made of two or more jargon words.

    tags (grp, place, tag).
    """
    t = tags.withColumn("tag", F.lower(F.regexp_replace(F.trim("tag"), "^#", ""))).where(F.col("tag").rlike("^[a-z0-9]{3,30}$"))
    words = sorted({w for w in jargon if len(w) > 3})
    if words:
        t = t.where(~F.col("tag").rlike(f"^({'|'.join(words)}){{2,}}$"))
    t = t.groupBy("grp", "tag").agg(F.min("place").alias("place"))
    return t.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("place", "tag"))).where(F.col("n") <= cap).select("grp", "tag", "n")


def dedupe_terms(terms: DataFrame) -> DataFrame:
    """The first spelling per language and search key. terms (lang, place, term)."""
    t = terms.withColumn("key", search_key(F.col("term"))).where("key <> ''")
    return t.groupBy("lang", "key").agg(F.min_by(F.regexp_replace(F.trim("term"), "^#", ""), "place").alias("term"))


def fold_language(df: DataFrame, requested: list[str]) -> DataFrame:
    """`code` of the requested language that a tag names: as it is, by name, or by base part; others are dropped."""
    raw = F.lower(F.trim("lang"))
    alias = F.lit(None).cast("string")
    for name, code in LANGUAGE_ALIASES.items():
        alias = F.when(raw == name, code).otherwise(alias)
    code = F.lit(None).cast("string")
    for r in reversed(requested):
        code = F.when(F.regexp_extract(raw, "^[^-_]*", 0) == r.lower().split("-")[0].split("_")[0], r).otherwise(code)
    for r in reversed(requested):
        low = r.lower()
        code = F.when((alias == low) | F.lit(low).startswith(F.concat(alias, F.lit("-"))), r).otherwise(code)
    for r in reversed(requested):
        code = F.when(raw == r.lower(), r).otherwise(code)
    return df.withColumn("code", code).where("code is not null")


def queries_with_last_ingest(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """D3"""
    last = runs.groupBy("query_id").agg(F.max("completed_on").alias("last_ingest"))
    return queries.join(last, "query_id", "left")


def seed_vocabulary(queries: DataFrame) -> DataFrame:
    """Normalised term, owned by the lowest query that has it, with its watch topic and search term."""
    all_terms = F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.coalesce("hashtags", F.array().cast("array<string>")), F.array("topic_label"))
    t = queries.select("query_id", "watch_topic", F.explode(all_terms).alias("search_term")).withColumn("term", normalize_term(F.col("search_term"))).where("term <> ''")
    t = t.groupBy("term").agg(F.min(F.struct("query_id", "search_term", "watch_topic")).alias("o"))
    return t.select("term", "o.query_id", "o.watch_topic", "o.search_term")


def match_seeds(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """(entity, term, query_id): equal, one-word label among a seed's words, or a one-word seed among a label's words.

    Words meet by their singulars, so all three branches are equality joins; equality wins,
    then the lowest query, then the lowest term.
    """
    words = lambda c: F.array_distinct(F.transform(F.split(c, r"\s+"), singularize))
    lab = labels.select("entity").distinct().withColumn("l", normalize_term(F.col("entity"))).where("l <> ''")
    one = lambda c: ~F.col(c).rlike(r"\s")
    v = vocab.select("term", "query_id")
    same = lab.join(v, F.col("l") == F.col("term")).select("entity", "term", "query_id", F.lit(0).alias("p"))
    seed_words = v.select("term", "query_id", F.explode(words(F.col("term"))).alias("w"))
    single = lab.where(one("l")).withColumn("w", singularize(F.col("l"))).join(seed_words, "w").select("entity", "term", "query_id", F.lit(1).alias("p"))
    label_words = lab.where(~one("l")).select("entity", F.explode(words(F.col("l"))).alias("w"))
    several = label_words.join(v.where(one("term")).withColumn("w", singularize(F.col("term"))), "w").select("entity", "term", "query_id", F.lit(1).alias("p"))
    hit = same.union(single).union(several).groupBy("entity").agg(F.min(F.struct("p", "query_id", "term")).alias("m"))
    return hit.select("entity", "m.term", "m.query_id")


def matched_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lift of yields of cohorts with one watch topic and geography."""
    o = old.select("watch_topic", "geography", F.col("yield").alias("old_yield"))
    n = new.select("watch_topic", "geography", F.col("yield").alias("new_yield"))
    return o.join(n, ["watch_topic", "geography"]).withColumn("lift", F.when(F.col("old_yield") > 0, F.col("new_yield") / F.col("old_yield") - 1))


def unfired(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """D13"""
    return queries.join(runs.select("query_id"), "query_id", "left_anti")


def recover_topics(items: DataFrame, payloads: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Topic label of an item from the newest committed payload with its title, else from the snapshot by title key."""
    from signalmill.functions.text import topic_key

    p = payloads.select("committed_on", F.inline("rows")).groupBy("title").agg(F.max_by("topic", F.struct("committed_on", "topic")).alias("from_payload"))
    s = snapshot.groupBy(topic_key(F.col("title")).alias("k")).agg(F.min("topic").alias("from_snapshot"))
    j = items.join(p, "title", "left").withColumn("k", topic_key(F.col("title"))).join(s, "k", "left")
    return j.select("item_id", "title", F.coalesce("from_payload", "from_snapshot").alias("topic"))


def _term_sets(df: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, ts): each key's distinct terms as one sorted array."""
    t = df.select(key, F.explode(F.transform(terms, lambda x: F.lower(F.trim(x)))).alias("t")).where("t is not null")
    return t.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("ts"))


def _term_pairs() -> Column:
    rest = lambda x, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.inline(F.flatten(F.transform("ts", rest)))


def attribute_runs(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """The query that shares most terms with a run's input, the lowest on ties; none without overlap.

    Runs of one set of terms have one answer, and of queries of one set the lowest can win, so
    only distinct sets meet. They meet by pairs of terms, n (n - 1) / 2 of which are shared where
    n terms are; where no pair is, the lowest query of any one term wins, so a term that all
    sets have costs no more than others.
    """
    r = _term_sets(runs, "run_id", "terms")
    q = _term_sets(queries, "query_id", "keywords").groupBy("ts").agg(F.min("query_id").alias("query_id"))
    sets = r.select("ts").distinct()
    lowest = q.select("query_id", F.explode("ts").alias("t")).groupBy("t").agg(F.min("query_id").alias("query_id"))
    one = sets.select("ts", F.explode("ts").alias("t")).join(lowest, "t").groupBy("ts").agg(F.min("query_id").alias("one"))
    shared = sets.select("ts", _term_pairs()).join(q.select("query_id", _term_pairs()), ["a", "b"]).groupBy("ts", "query_id").agg(F.count("*").alias("n"))
    more = shared.groupBy("ts").agg(F.min_by("query_id", F.struct(-F.col("n"), F.col("query_id"))).alias("more"))
    n = one.join(more, "ts", "left").select("ts", F.coalesce("more", "one").alias("query_id"))
    return runs.select("run_id").join(r.join(n, "ts").select("run_id", "query_id"), "run_id", "left")


def seed_yield(queries: DataFrame, runs: DataFrame, signals: DataFrame, links: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct signals and entities of each query, and entities per keyword.

    A signal's entities meet where its links lie, and its first one (or none) counts the signal. With
    `tasks`, rows are dealt into so many by query and entity before they are counted by query.
    """
    s = runs.select("query_id", "run_id").join(signals.select("run_id", "signal_id"), "run_id").join(links.select("signal_id", "entity"), "signal_id", "left")
    s = s.groupBy("query_id", "signal_id").agg(F.collect_set("entity").alias("es")).select("query_id", F.posexplode_outer("es").alias("at", "entity"))
    s = s.repartition(tasks, "query_id", "entity") if tasks else s
    y = s.groupBy("query_id").agg(F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("signals"), F.count_distinct("entity").alias("entities"))
    k = F.greatest(F.size("keywords"), F.lit(1))
    out = queries.join(y, "query_id", "left").withColumn("signals", F.coalesce("signals", F.lit(0))).withColumn("entities", F.coalesce("entities", F.lit(0)))
    return out.select("query_id", "cohort", "signals", "entities", (F.col("entities") / k).alias("per_keyword"))


def yield_by_cohort(yields: DataFrame) -> DataFrame:
    """Lowest, median, mean and highest yield per cohort."""
    e = F.col("entities")
    return yields.groupBy("cohort").agg(F.count("*").alias("n"), F.min(e).alias("low"), F.percentile(e, F.lit(0.5)).alias("median"), F.avg(e).alias("mean"), F.max(e).alias("high"))


def platform_breadth(links: DataFrame) -> DataFrame:
    """Entities by number of platforms, with the share of all that have two or more."""
    n = links.groupBy("entity").agg(F.count_distinct("platform").alias("platforms")).groupBy("platforms").agg(F.count("*").alias("entities"))
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.withColumn("share_2plus", F.sum(F.when(F.col("platforms") >= 2, F.col("entities")).otherwise(0)).over(every) / F.sum("entities").over(every))


def scrape_conditions(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Runs and records by cohort and platform, records per run, the platform's share of the cohort's records."""
    g = runs.join(queries.select("query_id", "cohort"), "query_id").groupBy("cohort", "platform").agg(F.count("*").alias("runs"), F.sum("records").alias("records"))
    w = Window.partitionBy("cohort")
    return g.withColumn("per_run", F.col("records") / F.col("runs")).withColumn("share", F.col("records") / F.sum("records").over(w))


def topic_matrix(queries: DataFrame, geographies: list[str]) -> DataFrame:
    """Queries by watch topic and geography, one column per geography."""
    m = queries.groupBy("watch_topic").pivot("geography", geographies).count()
    return m.na.fill(0)
