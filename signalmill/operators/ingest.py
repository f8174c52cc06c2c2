"""Filters, accounting and tagging of signals on their way in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import canonical_label
from signalmill.sources.scratch import scratch_path


def noise_floor(df: DataFrame, floor: float = 3) -> DataFrame:
    """Signals that score at least the floor; Reddit passes."""
    return df.where((F.col("platform") == "reddit") | (F.col("score") >= floor))


def language_ok(target: list[str], least: float = 0.7, reddit_least: float = 0.8) -> Column:
    need = F.when(F.col("platform") == "reddit", F.lit(reddit_least)).otherwise(F.lit(least))
    if not target:
        return F.lit(True)
    unsure = F.col("language").isNull() | F.col("confidence").isNull() | (F.col("confidence") < need)
    return unsure | F.col("language").isin(target)


def language_filter(df: DataFrame, target: list[str], least: float = 0.7) -> DataFrame:
    """Drops signals that are surely in another language."""
    return df.where(language_ok(target, least))


def ingest_stats(df: DataFrame, target: list[str], floor: float = 3, least: float = 0.7) -> DataFrame:
    """Rows per run and reason with oldest and newest post; the first failing check names the reason."""
    reason = (
        F.when(F.col("source_id").isNull(), "malformed")
        .when((F.col("platform") != "reddit") & (F.col("score") < floor), "noise")
        .when(~language_ok(target, least), "language")
    )
    checked = df.withColumn("_r", reason).withColumn("_n", F.row_number().over(Window.partitionBy("tenant", "platform", "source_id", F.col("_r").isNull()).orderBy("row_id")))
    final = F.coalesce("_r", F.when(F.col("_n") > 1, "duplicate").otherwise("kept"))
    return checked.groupBy("run_id", final.alias("reason")).agg(F.count("*").alias("n"), F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"))


def search_signals(df: DataFrame, run=None, platform=None, status=None, since=None, until=None) -> DataFrame:
    """C4: conjunction of the conditions given."""
    for col, value in (("run_id", run), ("platform", platform), ("status", status)):
        df = df if value is None else df.where(F.col(col) == value)
    df = df if since is None else df.where(F.col("captured_at") >= F.lit(since))
    return df if until is None else df.where(F.col("captured_at") <= F.lit(until))


def drop_core_vocab(df: DataFrame, vocab: DataFrame, col: str) -> DataFrame:
    """Rows whose label, case and outer spaces apart, is no core term."""
    terms = vocab.select(F.lower(F.trim("term")).alias("_t")).distinct()
    return df.join(terms, F.lower(F.trim(F.col(col))) == F.col("_t"), "left_anti")


def coerce_type(df: DataFrame, types: list[str]) -> DataFrame:
    """Unknown types become other if that is allowed, else the row goes."""
    known = F.col("entity_type").isin(types)
    if "other" in types:
        return df.withColumn("entity_type", F.when(known, F.col("entity_type")).otherwise("other"))
    return df.where(known)


def combine_verdict(df: DataFrame) -> DataFrame:
    """`specific` of a verdict: rejected by either flag, else the legacy flag, else kept."""
    flagged = F.coalesce("everyday_generic", F.lit(False)) | F.coalesce("category_staple", F.lit(False))
    new = F.col("everyday_generic").isNotNull() | F.col("category_staple").isNotNull()
    return df.withColumn("keep", F.when(new, ~flagged).otherwise(F.coalesce("specific", F.lit(True))))


def exclude_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """C12"""
    return df.where(~F.col(col).startswith(prefix))


def pending_batch(df: DataFrame, n: int, run=None) -> DataFrame:
    """The n oldest pending signals."""
    df = df.where("status = 'pending'")
    return (df if run is None else df.where(F.col("run_id") == run)).orderBy("captured_at", "signal_id").limit(n)


def ingest_backlog(runs: DataFrame, as_of, days: int = 14, most: int = 25) -> DataFrame:
    """C14: succeeded runs with data not yet ingested; the oldest `most` are due, the rest deferred."""
    due = runs.where(
        (F.col("status") == "succeeded") & F.col("dataset_id").isNotNull() & ~F.coalesce("ingestion_status", F.lit("")).isin("done", "processing")
        & (F.col("completed_on") >= F.date_sub(F.lit(as_of), days))
    )
    n = F.row_number().over(Window.partitionBy("tenant").orderBy("completed_on", "run_id"))
    return due.withColumn("action", F.when(n <= most, "ingest").otherwise("defer"))


def has_fresh(runs: DataFrame, since=None) -> DataFrame:
    """Per tenant, whether a run succeeded since a day (ever, if none is given)."""
    hit = F.col("status") == "succeeded"
    hit = hit if since is None else hit & (F.col("completed_on") > F.lit(since))
    return runs.groupBy("tenant").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("fresh"))


def filtered(df: DataFrame, order=(), limit: int | None = None, **eq) -> DataFrame:
    """Equality filters, an order and a limit."""
    for col, value in eq.items():
        df = df if value is None else df.where(F.col(col) == value)
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)


def resolve_synonyms(df: DataFrame, synonyms: DataFrame) -> DataFrame:
    """`canonical` by (tenant, alias, type), else the automatic form of the label."""
    s = synonyms.select(F.col("tenant").alias("_n"), F.lower(F.trim("alias")).alias("_a"), F.col("entity_type").alias("_t"), "canonical_label")
    hit = (F.col("tenant") == F.col("_n")) & (F.lower(F.trim("label")) == F.col("_a")) & (F.col("entity_type") == F.col("_t"))
    return df.join(s, hit, "left").withColumn("canonical", F.coalesce("canonical_label", canonical_label(F.col("label")))).drop("_n", "_a", "_t", "canonical_label")


def signal_categories(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (signal, category) through live entities."""
    live = entities.where("deleted_at is null and category is not null").select("entity", "category")
    return links.join(live, "entity").select("signal_id", "category").distinct()


def uncached_pairs(pairs: DataFrame, log: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs of categories with a vocabulary that are not in the log yet."""
    return pairs.join(vocab.select("category").distinct(), "category", "left_semi").join(log.select("signal_id", "category"), ["signal_id", "category"], "left_anti")


def attach_verdicts(terms: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts by normalised term, then by position for the leftovers of a batch whose counts agree; the rest keep.

    terms (batch, place, term), verdicts (batch, place, term, keep).
    """
    key = lambda c: F.lower(F.trim(c))
    t = terms.withColumn("_k", key("term"))
    v = verdicts.withColumn("_k", key("term"))
    named = v.groupBy("batch", "_k").agg(F.min_by("keep", "place").alias("_named"))
    t = t.join(named, ["batch", "_k"], "left")
    left_t = t.where("_named is null").withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy("place"))).select("batch", "place", "_n")
    left_v = v.join(terms.select("batch", key("term").alias("_k")).distinct(), ["batch", "_k"], "left_anti")
    left_v = left_v.withColumn("_n", F.row_number().over(Window.partitionBy("batch").orderBy("place"))).select("batch", "_n", F.col("keep").alias("_placed"))
    same = left_t.groupBy("batch").agg(F.count("*").alias("_c")).join(left_v.groupBy("batch").agg(F.count("*").alias("_c")), ["batch", "_c"], "left_semi").select("batch")
    placed = left_t.join(left_v, ["batch", "_n"]).join(same, "batch", "left_semi").select("batch", "place", "_placed")
    return t.join(placed, ["batch", "place"], "left").select("batch", "place", "term", F.coalesce("_named", "_placed", F.lit(True)).alias("keep"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_trie(vocab: DataFrame) -> DataFrame:
    """(node, word, child) of the terms' words: a node is the words so far, the root is the empty string."""
    w = vocab.select(_words("term").alias("w")).where(F.size("w") > 0).distinct()
    steps = w.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
    upto = lambda k: F.concat_ws(" ", F.slice("w", F.lit(1), k))
    return steps.select(upto(F.col("k") - 1).alias("node"), F.element_at("w", F.col("k")).alias("word"), upto(F.col("k")).alias("child")).distinct()


def tag_entities(signals: DataFrame, vocab: DataFrame, most: int = 5) -> DataFrame:
    """(signal_id, entity) for the first `most` labels or aliases in the text, by place, then label.

    signals (signal_id, text), vocab (term, entity); terms may have any number of words.
    Words that stand in terms, with their places, go down the trie of the terms one word a
    round: a round keeps the places whose words so far begin a longer term, so rounds end
    with the longest term, and what no term begins with never becomes a gram.
    """
    spark = signals.sparkSession
    trie = term_trie(vocab)
    longest = vocab.agg(F.max(F.size(_words("term")))).first()[0] or 0  # of a dimension table
    names = vocab.select(F.concat_ws(" ", _words("term")).alias("node"), "entity").where("node <> ''").distinct()
    # One row of the array, so that the text is cut once.
    w = signals.select("signal_id", F.explode(F.array(_words("text"))).alias("w")).select("signal_id", F.posexplode("w").alias("at", "word"))
    if longest > 1:
        path = scratch_path(spark, "words")
        w.join(trie.select("word").distinct(), "word", "left_semi").write.parquet(path)
        w = spark.read.parquet(path)
    live = w.join(trie.where("node = ''").select("word", F.col("child").alias("node")), "word").select("signal_id", "at", (F.col("at") + 1).alias("next"), "node")
    hits = live.join(names, "node").select("signal_id", "entity", "at")
    for _ in range(1, longest):
        live = live.join(w.select("signal_id", F.col("at").alias("next"), "word"), ["signal_id", "next"]).join(trie, ["node", "word"])
        path = scratch_path(spark, "live")
        live.select("signal_id", "at", (F.col("next") + 1).alias("next"), F.col("child").alias("node")).write.parquet(path)
        live = spark.read.parquet(path)
        hits = hits.unionByName(live.join(names, "node").select("signal_id", "entity", "at"))
    hits = hits.groupBy("signal_id", "entity").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("signal_id").orderBy("at", "entity"))
    return hits.withColumn("n", n).where(F.col("n") <= most).select("signal_id", "entity", F.col("n").alias("place"))


def tag_attributes(signals: DataFrame, pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(signal_id, category, attribute) by words of the text among the category's own attributes; pairs without a match have null.

    signals hold an id once. Words meet the vocabulary in one join, and only pairs, no words,
    in the one that finds pairs without a match.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    w = pairs.join(signals.select("signal_id", "text"), "signal_id").select("signal_id", "category", F.explode(words).alias("word"))
    found = w.join(vocab.select("category", F.lower("attribute").alias("word"), "attribute").distinct(), ["category", "word"]).select("signal_id", "category", "attribute")
    bare = pairs.select("signal_id", "category").join(found.select("signal_id", "category").distinct(), ["signal_id", "category"], "left_anti")
    return found.unionByName(bare.withColumn("attribute", F.lit(None).cast("string")))


def gram_counts(df: DataFrame, key: str, slice_rows: int = 200) -> DataFrame:
    """(key, gram, c): trigrams of `text` in lower case, counted per key within slices of a batch; a key may have several rows of a gram.

    Three code points of 21 bits are one integer, so a text's windows are cut and counted at
    once. A column function would search each substring from the start of the text.
    """

    def counted(key_values: pa.Array, texts: list) -> pa.RecordBatch:
        windows: dict = {}
        for i, (k, t) in enumerate(zip(key_values.to_pylist(), texts)):
            a = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            windows.setdefault(k, (i, []))[1].append(a[:-2] << 42 | a[1:-1] << 21 | a[2:])
        found = [(i, *np.unique(np.concatenate(w), return_counts=True)) for i, w in windows.values()]
        v = np.concatenate([v for _, v, _ in found])
        s = (np.stack([v >> 42, v >> 21, v], axis=1) & 0x1FFFFF).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        keys = key_values.take(pa.array(np.repeat([i for i, _, _ in found], [len(v) for _, v, _ in found])))
        return pa.RecordBatch.from_arrays([keys, pa.array([s[i : i + 3] for i in range(0, len(s), 3)], pa.string()), pa.array(np.concatenate([c for _, _, c in found]), pa.int64())], [key, "gram", "c"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                yield counted(part.column(0), part.column(1).to_pylist())

    text = df.where(F.length("text") >= 20).select(key, F.lower("text").alias("text")).where(F.length("text") > 2)
    return text.mapInArrow(each, f"`{key}` {df.schema[key].dataType.simpleString()}, gram string, c long")


def detect_language(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(signal_id, language) by the profile that shares most trigram weight with the text, ties to the lowest code.

    df (signal_id, text), profiles (language, gram, weight). Trigrams are counted per text
    before they meet the profiles, which are written first, so that Spark knows their size.
    """
    path = scratch_path(df.sparkSession, "profiles")
    profiles.write.parquet(path)
    s = gram_counts(df, "signal_id").join(df.sparkSession.read.parquet(path), "gram").groupBy("signal_id", "language").agg(F.sum(F.col("c") * F.col("weight")).alias("s"))
    return s.groupBy("signal_id").agg(F.min_by("language", F.struct(-F.round("s", 6), F.col("language"))).alias("language"))


def language_profiles(df: DataFrame, most: int = 300) -> DataFrame:
    """Trigram profiles (language, gram, weight) of labelled texts: the most frequent grams with their shares."""
    g = gram_counts(df, "language").groupBy("language", "gram").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("language")
    g = g.withColumn("weight", F.col("c") / F.sum("c").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("c"), "gram")))
    return g.where(F.col("n") <= most).select("language", "gram", "weight")
