"""Entity consolidation, co-occurrence, patterns and discoveries: pure functions of their inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import vocabulary as V
from . import dictionary
from .stages import written


def consolidate(entities: DataFrame, files: DataFrame, alias_resolution: bool = False) -> DataFrame:
    """One row per (entity_type, normalized) of entities in files: occurrences, distinct files, variants, contexts, first and last sight.

    A stored normalized form wins unless alias_resolution; an empty one is derived. The first ten contexts
    are those of the smallest (indexed_at, id). Rows meet by (key, file) and by (key, value) first, so a frequent
    key brings its files and its spellings, and ten contexts of each task, to one place, never its rows.
    """
    derived = S.norm_canonical(F.col("value"), F.col("entity_type"))
    own = derived if alias_resolution else F.when(F.coalesce("normalized", F.lit("")) != "", F.col("normalized")).otherwise(derived)
    rows = entities.join(files.select("file_id", "indexed_at"), "file_id").withColumn("normalized", own)
    key = ["entity_type", "normalized"]
    per_file = rows.groupBy(*key, "file_id").agg(F.count("*").alias("n"), F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b"))
    out = per_file.groupBy(*key).agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("file_count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    variants = rows.select(*key, "value").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("value")).alias("variants"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("indexed_at", "id"))
    seen = rows.filter(F.coalesce("context", F.lit("")) != "").withColumn("_n", first).filter("_n <= 10")
    contexts = seen.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "context"))), lambda c: c["context"]).alias("contexts"))
    for name, found in (("variants", variants), ("contexts", contexts)):
        found = found.select(*[F.col(k).alias(f"_{k}") for k in key], name)
        out = out.join(found, (F.col("entity_type").eqNullSafe(F.col("_entity_type"))) & (F.col("normalized").eqNullSafe(F.col("_normalized"))), "left").drop("_entity_type", "_normalized")
    out = out.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return out.withColumn("id", S.generate_id("cent", S.canonical_key(F.col("entity_type"), F.col("normalized"))))


def keys_of_files(entities: DataFrame) -> DataFrame:
    """file_id and keys, the different keys of each file in order: one shuffle, into which a task sends a file's key once."""
    return entities.filter("file_id is not null").groupBy("file_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def coded(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of keys_of_files with a code for each key, and the key of each code (code, key); both are written.

    Codes are longs that order as keys do, so pairs, ranks and ties of codes are those of keys; what is shuffled holds no
    key but the different ones, once.
    """
    names = entities.filter("file_id is not null and key is not null").select("key").distinct().orderBy("key")
    names = written(names.select(F.monotonically_increasing_id().alias("code"), "key"), "names")
    e = entities.select("file_id", "key").join(names, "key", "left").select("file_id", F.col("code").alias("key"))
    return written(keys_of_files(e), "file-keys"), names


def named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """pairs (e1, e2, ...) of codes with the keys they stand for."""
    out = pairs
    for e in ("e1", "e2"):
        out = out.join(names.select(F.col("code").alias(e), F.col("key").alias(f"_{e}")), e).drop(e).withColumnRenamed(f"_{e}", e)
    return out.select(*pairs.columns)


def pairs_of(files: DataFrame, block: int = 512) -> DataFrame:
    """e1 < e2 and cooc, the files that share them, for all rows of keys (or codes) of files, a written table.

    Of a file of n keys, more than block, keys meet in slices: it is dealt to n / block tasks, each of which sees all its
    keys once.
    """
    small = files.filter(F.size("keys") <= block).select("keys", F.posexplode("keys").alias("i", "e1")).select("e1", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("e2"))
    e = files.filter(F.size("keys") > block).select("file_id", F.explode("keys").alias("key"), F.ceil(F.size("keys") / block).cast("int").alias("slices"))
    a = e.select("file_id", F.col("key").alias("e1"), F.pmod(F.xxhash64("key"), F.col("slices")).cast("int").alias("slice"))
    b = e.select("file_id", F.col("key").alias("e2"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    large = a.join(b, ["file_id", "slice"]).filter("e1 < e2").select("e1", "e2")
    return small.union(large).groupBy("e1", "e2").agg(F.count("*").alias("cooc"))


def all_pairs(entities: DataFrame, block: int = 512) -> DataFrame:
    """e1 < e2 and cooc, the files that share them, for all keys of entities (file_id, key); pairs are counted as codes."""
    files, names = coded(entities)
    return named(pairs_of(files, block), names)


def counted(files: DataFrame, pairs_per_file: int = 500) -> DataFrame:
    """e1, e2, count, strength: of each row of keys (or codes) of files the first pairs_per_file pairs in nested-loop order."""
    files = files.select(F.size("keys").cast("long").alias("n"), F.slice("keys", 1, pairs_per_file + 1).alias("keys"))
    firsts = files.select("n", "keys", F.posexplode("keys").alias("i", "e1"))
    before = F.col("i") * (F.col("n") - 1) - (F.col("i") * (F.col("i") - 1) / 2).cast("long")
    firsts = firsts.withColumn("left", pairs_per_file - before).filter("left > 0")
    pairs = firsts.select("e1", F.explode(F.slice("keys", F.col("i") + 2, F.col("left").cast("int"))).alias("e2"))
    out = pairs.groupBy("e1", "e2").agg(F.count("*").alias("count"))
    return out.withColumn("strength", S.strength(F.col("count"), F.col("count")))


def cooccurrence(entities: DataFrame, pairs_per_file: int = 500, most_pairs: int | None = None, most_entities: int | None = None) -> DataFrame:
    """Pairs of entity keys that share files: e1, e2, count, strength. entities has file_id and key.

    In a file keys are ranked (by key) and pairs count in nested-loop order up to pairs_per_file; the place of a
    pair follows from its ranks, so a file's row of keys gives just the pairs that count and a file of n keys costs
    no n*n pairs. most_entities keeps the most frequent keys, most_pairs the most frequent pairs.
    """
    e = entities.select("file_id", "key")
    if most_entities is not None:
        top = e.distinct().groupBy("key").count().orderBy(F.desc("count"), "key").limit(most_entities).select("key")
        e = e.join(top, "key", "left_semi")
    out = counted(keys_of_files(e), pairs_per_file)
    return out if most_pairs is None else out.orderBy(F.desc("count"), "e1", "e2").limit(most_pairs)


def coded_cooccurrence(entities: DataFrame, pairs_per_file: int = 500) -> tuple[DataFrame, DataFrame]:
    """The pairs of cooccurrence with codes for keys, for callers that need keys of few pairs or none, and the key of each code."""
    files, names = coded(entities)
    return counted(files, pairs_per_file), names


def related(pairs: DataFrame, key: str, least: float = 0.3, n: int = 20) -> DataFrame:
    both = pairs.filter(F.col("e1") == key).select(F.col("e2").alias("other"), "strength").union(pairs.filter(F.col("e2") == key).select("e1", "strength"))
    return both.filter(F.col("strength") >= least).orderBy(F.desc("strength"), "other").limit(n)


def may_pair(single: DataFrame, files: DataFrame, least_pmi: float, least_files: int) -> DataFrame:
    """Of keys with counts c those that can be in a pair of least_pmi and least_files.

    A pair shares no more files than either key has, so a key of fewer than least_files has none; and its PMI is at
    most the logarithm of all files over those of the more frequent key, so a key above that has none of a positive least_pmi.
    """
    enough = single.filter(F.col("c") >= least_files)
    if least_pmi <= 0:
        return enough
    most = F.col("files") * math.exp(-least_pmi) * (1 + 1e-9)
    return enough.crossJoin(F.broadcast(files)).filter(F.col("c") <= most).drop("files")  # files is one row


def pmi_pairs(entities: DataFrame, least_pmi: float = 1.5, least_files: int = 2, n: int | None = 100) -> DataFrame:
    """The n pairs of largest PMI confidence (all for None) among those that share least_files files; keys that can't be in such a pair go before pairs are made.

    Pairs are made, counted and ranked as codes, and those that stay get their keys.
    """
    lists, names = coded(entities)
    e, files = lists.select("file_id", F.explode("keys").alias("key")), lists.agg(F.count("*").alias("files"))
    single = written(may_pair(e.groupBy("key").agg(F.count("*").alias("c")), files, least_pmi, least_files), "single")
    if single.count() < names.count():
        lists = written(keys_of_files(e.join(single.select("key"), "key", "left_semi")), "file-keys")
    both = pairs_of(lists).filter(F.col("cooc") >= least_files)
    out = both.join(single.withColumnRenamed("key", "e1").withColumnRenamed("c", "c1"), "e1").join(single.withColumnRenamed("key", "e2").withColumnRenamed("c", "c2"), "e2").crossJoin(F.broadcast(files))
    out = out.withColumn("pmi", S.pmi(F.col("cooc"), F.col("c1"), F.col("c2"), F.col("files"))).filter(F.col("pmi") >= least_pmi)
    out = out.withColumn("confidence", S.pmi_confidence(F.col("pmi"), F.col("cooc"))).select("e1", "e2", "cooc", "pmi", "confidence")
    if n is None:
        return named(out, names)
    return named(out.orderBy(F.desc("confidence"), "e1", "e2").limit(n), names).orderBy(F.desc("confidence"), "e1", "e2")


def term_hits(chunks: DataFrame) -> DataFrame:
    """A row per chunk, domain and term that the chunk's text contains, all terms in one pass."""
    entries = [(t, d) for d, words in V.DOMAINS.items() for t in words]
    hits = dictionary.found(chunks.select("file_id", F.lower("content").alias("text")), "text", entries, whole_words=False, once=True)
    return hits.select("file_id", F.col("label").alias("domain"), "term")


def expertise(chunks: DataFrame, least_hits: int = 5, least_confidence: float = 0.3) -> DataFrame:
    size = S.literal_map({d: str(len(w)) for d, w in V.DOMAINS.items()})
    g = term_hits(chunks).groupBy("domain").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"), F.countDistinct("term").alias("terms"))
    g = g.withColumn("confidence", S.expertise_confidence(F.col("hits"), F.col("files"), F.col("terms"), size[F.col("domain")].cast("double")))
    return g.filter((F.col("hits") >= least_hits) & (F.col("confidence") >= least_confidence)).withColumn("id", F.concat(F.lit("exp_"), "domain"))


def relationships(pairs: DataFrame, least: float = 0.4) -> DataFrame:
    """PERSON with ORG or PROJECT among strong pairs of keys type:value."""
    kind = lambda c: F.substring_index(c, ":", 1)
    first = (kind("e1") == "PERSON") & kind("e2").isin("ORG", "PROJECT")
    second = (kind("e2") == "PERSON") & kind("e1").isin("ORG", "PROJECT")
    rows = pairs.filter((F.col("strength") >= least) & (first | second))
    rows = rows.withColumn("person", F.when(first, F.col("e1")).otherwise(F.col("e2"))).withColumn("other", F.when(first, F.col("e2")).otherwise(F.col("e1")))
    relation = F.when(kind("other") == "ORG", "works_with").otherwise("works_on")
    return rows.select(F.concat_ws("_", F.lit("rel"), S.generate_id("cent", F.col("person")), S.generate_id("cent", F.col("other"))).alias("id"), "person", "other", relation.alias("relation"), F.col("strength").alias("confidence"), "count")


def workflows(files: DataFrame, least_count: int = 3, least_confidence: float = 0.3) -> DataFrame:
    """Naming rules that enough file names follow."""
    flags = [F.when(F.col("filename").rlike(p), F.lit(n)) for n, p in V.NAMING.items()]
    g = files.select("file_id", "filename", F.explode(F.array_compact(F.array(*flags))).alias("rule"))
    g = g.groupBy("rule").agg(F.count("*").alias("count"), F.slice(F.array_sort(F.collect_set("filename")), 1, 5).alias("examples"))
    g = g.withColumn("confidence", F.least(F.lit(1.0), F.col("count") / F.lit(20.0)))
    return g.filter((F.col("count") >= least_count) & (F.col("confidence") >= least_confidence)).withColumn("id", F.concat(F.lit("wf_"), "rule"))


def tech_stack(entities: DataFrame, top: int = 5) -> DataFrame:
    """Categories of TECH values with their most frequent names, each with occurrences and the stack's confidence."""
    category = S.literal_map(V.TECH_CATEGORIES)
    tech = entities.filter(F.col("entity_type") == "TECH").withColumn("category", F.coalesce(category[F.col("normalized")], F.lit("other")))
    stack = tech.agg(F.countDistinct("file_id").alias("files"), F.countDistinct("category").alias("categories"))
    names = tech.groupBy("category", "normalized").agg(F.count("*").alias("occurrences"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("occurrences"), "normalized"))
    out = names.withColumn("rank", rank).filter(F.col("rank") <= top).crossJoin(F.broadcast(stack))
    out = out.withColumn("confidence", F.least(F.lit(1.0), F.col("files") / F.lit(20.0)))
    return out.filter((F.col("categories") >= 2) & (F.col("confidence") >= 0.3))


def tech_categories(entities: DataFrame, top: int = 5) -> DataFrame:
    """Per category of TECH values: occurrences, distinct files, and the most frequent names."""
    category = F.coalesce(S.literal_map(V.TECH_CATEGORIES)[F.col("normalized")], F.lit("other"))
    tech = entities.filter(F.col("entity_type") == "TECH").withColumn("category", category)
    names = tech.groupBy("category", "normalized").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "normalized"))
    first = F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "normalized")))
    names = names.withColumn("rank", rank).groupBy("category").agg(F.sum("n").alias("occurrences"), F.transform(F.array_sort(first), lambda x: x["normalized"]).alias("top"))
    return names.join(tech.groupBy("category").agg(F.countDistinct("file_id").alias("files")), "category")


def consolidated_keys(entities: DataFrame, files: DataFrame) -> DataFrame:
    """The keys (entity_type, normalized) of the rows of consolidate, and nothing else of them.

    A key is there if any of its files is. Its smallest and largest are looked up first, a row of each key; only rows
    of keys that neither settles meet files.
    """
    derived = S.norm_canonical(F.col("value"), F.col("entity_type"))
    own = F.when(F.coalesce("normalized", F.lit("")) != "", F.col("normalized")).otherwise(derived)
    rows = entities.filter("file_id is not null").select("file_id", "entity_type", own.alias("normalized"))
    key, files = ["entity_type", "normalized"], files.select("file_id")
    ends = written(rows.groupBy(*key).agg(F.min("file_id").alias("first"), F.max("file_id").alias("last")), "ends")
    both = ends.select(*key, F.col("first").alias("file_id")).union(ends.select(*key, F.col("last").alias("file_id")))
    found = written(both.join(files, "file_id").select(*key).distinct(), "keys")
    same = lambda a, b: a["entity_type"].eqNullSafe(b["entity_type"]) & a["normalized"].eqNullSafe(b["normalized"])
    left = written(ends.select(*key).join(found, same(ends, found), "left_anti"), "keys-left")
    if left.isEmpty():
        return found
    return found.union(rows.join(left, same(rows, left), "left_semi").join(files, "file_id", "left_semi").select(*key).distinct())


def consolidated_stats(consolidated: DataFrame, pairs: DataFrame, strong: float = 0.5) -> DataFrame:
    """kind, name, n: entities by type and in all, pairs and strong pairs, from the keys of consolidated entities and pairs with strength, read twice each."""
    consolidated, pairs = written(consolidated.select("entity_type", "normalized"), "consolidated"), written(pairs.select("strength"), "strengths")
    types = consolidated.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    total = consolidated.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("entities"), "n")
    both = pairs.agg(F.count("*").alias("all"), F.count_if(F.col("strength") >= strong).alias("strong"))
    return types.union(total).union(both.select(F.lit("pairs"), F.lit("all"), "all")).union(both.select(F.lit("pairs"), F.lit("strong"), "strong"))


def discovery_stats(discoveries: DataFrame) -> DataFrame:
    """kind, name, value: discoveries by type and by status, and their mean confidence, 0 without any."""
    count = lambda c, kind: discoveries.groupBy(F.col(c).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(kind).alias("kind"), "name", "value")
    mean = discoveries.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("value")).select(F.lit("mean"), F.lit("confidence"), "value")
    return count("discovery_type", "type").union(count("status", "status")).union(mean)


def surface(patterns: DataFrame, least: float = 0.7, least_sources: int = 2) -> DataFrame:
    """Discoveries of patterns (pattern_type, title, confidence, sources) sure and wide enough."""
    kind = F.coalesce(S.literal_map(V.DISCOVERY_TYPES)[F.col("pattern_type")], F.col("pattern_type"))
    rows = patterns.filter((F.col("confidence") >= least) & (F.col("sources") >= least_sources)).withColumn("discovery_type", kind)
    return rows.withColumn("id", S.generate_id("disc", F.concat_ws("_", "discovery_type", "title"))).withColumn("status", F.lit("active"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """id, told, user_feedback: the last word of a log (id, status, note, at) about each discovery."""
    return feedback.groupBy("id").agg(F.max_by(F.struct("status", "note"), F.struct("at", "status")).alias("f")).select("id", F.col("f.status").alias("told"), F.col("f.note").alias("user_feedback"))


def merge_feedback(fresh: DataFrame, stored: DataFrame, feedback: DataFrame) -> DataFrame:
    """Discoveries of this run and of the store, with the latest feedback in place.

    A discovery that both have takes this run's values and the stored status; one that only the store has stays.
    The feedback log wins over either: a dismissed one stays dismissed. Columns of fresh that the store lacks are null there.
    """
    kept = [c for c in fresh.columns if c not in ("id", "status")]
    old = stored.select("id", F.col("status").alias("_status"), *[(F.col(c) if c in stored.columns else F.lit(None)).alias(f"_{c}") for c in kept])
    out = fresh.join(old, "id", "full").join(latest_feedback(feedback), "id", "left")
    return out.select("id", *[F.coalesce(c, f"_{c}").alias(c) for c in kept], F.coalesce("told", "_status", "status").alias("status"), "user_feedback")


def give_feedback(discoveries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (id, status) with found: whether there is such a discovery; only these belong in the log."""
    return asked.join(discoveries.select("id", F.lit(True).alias("found")).distinct(), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def patterns(chunks: DataFrame, pairs: DataFrame, files: DataFrame, tech: DataFrame, strength: float = 0.4) -> DataFrame:
    """All patterns as one table: pattern_type, title, confidence, sources (files and entities behind it)."""
    e = expertise(chunks).select(F.lit("expertise").alias("pattern_type"), F.col("domain").alias("title"), "confidence", F.col("files").alias("sources"))
    r = relationships(pairs, strength).select(F.lit("relationship"), F.concat_ws(" ", "person", "relation", "other"), "confidence", F.col("count") + 2)
    w = workflows(files).select(F.lit("workflow"), "rule", "confidence", "count")
    t = tech_stack(tech).groupBy().agg(F.max("confidence").alias("confidence"), F.max("files").alias("files")).filter("files is not null").select(F.lit("heuristic"), F.lit("tech_stack"), "confidence", "files")
    return e.union(r).union(w).union(t)


PATTERN_TYPES = ["expertise", "relationship", "workflow", "heuristic"]


def pattern_stats(found: DataFrame) -> DataFrame:
    """Patterns by type, the four types also where there are none."""
    counts = found.groupBy("pattern_type").agg(F.count("*").alias("n"))
    kinds = found.sparkSession.createDataFrame([(k,) for k in PATTERN_TYPES], "pattern_type string")
    return kinds.join(counts, "pattern_type", "left").select("pattern_type", F.coalesce("n", F.lit(0)).alias("n"))


def run(entities: DataFrame, seen: DataFrame, chunks: DataFrame, tech: DataFrame, files: DataFrame, strength: float = 0.4, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """A whole correlation: its discoveries, and one audit row with the counts of each step.

    seen (file_id, indexed_at) are the files of the entities, files (file_id, filename) those whose names are read.
    """
    pairs, names = coded_cooccurrence(entities)
    pairs = written(pairs, "pairs")
    found = written(patterns(chunks, named(pairs, names), files, tech, strength), "patterns")
    discoveries = surface(found, least)
    counts = [consolidated_keys(entities, seen).agg(F.count("*").alias("entities")), pairs.agg(F.count("*").alias("pairs")), found.agg(F.count("*").alias("patterns")), discoveries.agg(F.count("*").alias("discoveries"))]
    audit = counts[0]
    for c in counts[1:]:
        audit = audit.crossJoin(c)
    return discoveries, audit
