"""Queries over text, patterns, discoveries, vectors, machines and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..operators import chunking, correlation, machines, models, search
from ..operators.graph_index import GraphIndex
from ..sources import catalog, extract
from ..sources import standins as T
from ..streaming import jobs as J
from .archive import quoted
from .fragments import COSINE, DISCOVERED, ENTITIES, EXPERTISE, FILES, FIRST, INDEX, JOBS, NORM, PAIRS
from .registry import register, simple

r6 = lambda c: F.round(c, 6).alias(c)

# Text: paragraphs, words, entities
MARKED = "regexp_replace(text, '(?m)^(#{1,6}\\s)', chr(1) || '\\1', 'g')"
PARTS = f"list_filter(list_transform(regexp_split_to_array({MARKED}, '\\n\\n+|\\x01'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"
simple("chunk_paragraph", lambda s, d: chunking.paragraphs(T.chunks(s, d)).select("file_id", "chunk_index", "chunk_type", F.col("start_char").cast("long").alias("start_char"), F.md5("content").alias("digest")), f"select file_id, (o - 1)::int as chunk_index, case when starts_with(p, '#') then 'header' when starts_with(p, '```') then 'code_block' when regexp_matches(p, '^(- |\\* |\\d+\\.)') then 'list' else 'paragraph' end as chunk_type, (sum(length(p) + 2) over (partition by file_id order by o) - length(p) - 2)::bigint as start_char, md5(p) as digest from (select doc_id as file_id, unnest(ps) as p, generate_subscripts(ps, 1) as o from (select doc_id, {PARTS} as ps from documents))")
simple("chunk_sentences", lambda s, d: chunking.sentence_chunks(T.chunks(s, d)))
simple("chunk_merge_small", lambda s, d: chunking.merged_paragraphs(T.chunks(s, d)))
simple("chunk_text", lambda s, d: chunking.chunk_text(T.chunks(s, d)))
WORD_LIST = "list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')"
simple("chunk_words", lambda s, d: chunking.chunk_words(T.chunks(s, d)).select("file_id", "chunk_index", F.md5("content").alias("digest"), "word_count"), f"with w as (select doc_id as file_id, {WORD_LIST} as ws from documents), f as (select file_id, ws, list_reduce(list_prepend({{'size': 0, 'at': 0, 'ends': [0]}}, list_transform(ws, lambda w: {{'size': length(w)::int + 1, 'at': 1, 'ends': [0]}})), lambda a, b: {{'size': case when a.size + b.size >= 1000 then 0 else a.size + b.size end, 'at': a.at + 1, 'ends': case when a.size + b.size >= 1000 then list_append(a.ends, a.at + 1) else a.ends end}}) as r from w where len(ws) > 0), e as (select file_id, ws, case when r.ends[-1] = len(ws) then r.ends else list_append(r.ends, len(ws)::int) end as ends from f) select file_id, (i - 1)::int as chunk_index, md5(array_to_string(ws[ends[i] + 1:ends[i + 1]], ' ')) as digest, ends[i + 1] - ends[i] as word_count from (select *, unnest(range(1, len(ends))) as i from e)")
CODE = "def f(a):\n    return a\n\n\nclass C:\n    def m(self):\n        pass\n"


def modules(s: SparkSession, d: str) -> DataFrame:
    """A module for each part, without elements for every third, with the elements found."""
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x = "), F.col("p_partkey").cast("string"))).otherwise(F.lit(CODE))
    return T.spread(T.table(s, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("file_id"), code.alias("content")).withColumn("elements", extract.python_elements("content"))


CODE_ROWS = " union all ".join(f"select p_partkey as file_id, {i} as chunk_index, '{c}' as chunk_type, '{t}' as content from part where p_partkey % 3 <> 0" for i, (c, t) in enumerate((("code_function", "def f(a):\n    return a"), ("code_class", "class C:\n    def m(self):\n        pass"), ("code_function", "    def m(self):\n        pass"))))
simple("chunk_code", lambda s, d: chunking.code_elements(modules(s, d)).select("file_id", "chunk_index", "chunk_type", "content"), CODE_ROWS)
simple("chunk_choose", lambda s, d: chunking.chunk_file(modules(s, d)).select("file_id", "chunk_index", "chunk_type", "content"), f"{CODE_ROWS} union all select p_partkey, 0, 'paragraph', 'x = ' || p_partkey from part where p_partkey % 3 = 0")

HITS_OF = "select doc_id as file_id, '{k}' as entity_type, (i - 1)::int as position, v as value from (select doc_id, unnest(vs) as v, generate_subscripts(vs, 1) as i from (select doc_id, {vs}[1:{n}] as vs from documents))"
SIGN = "[^\\p{L}\\p{N}_]"
NOUNS = f"list_transform(regexp_extract_all(regexp_replace(text, '({SIGN})', '\\1\\1', 'g'), '(^|{SIGN})([A-Z][a-z]+(\\s+[A-Z][a-z]+)+)($|{SIGN})', 2), lambda v: regexp_replace(v, '({SIGN}){SIGN}', '\\1', 'g'))"
FOUND = "(" + " union all ".join(HITS_OF.format(k=k, n=n, vs=NOUNS if k == "PROPER_NOUN" else f"regexp_extract_all(text, '{p}')") for k, (p, n) in V.ENTITY_RULES.items()) + ")"
simple("ent_regex", lambda s, d: T.text_entities(s, d), f"select * from {FOUND}")
simple("ent_store", lambda s, d: T.text_entities(s, d).select(F.concat_ws("_", F.col("file_id").cast("string"), "entity_type", F.col("position").cast("string")).alias("id"), "file_id", "entity_type", "value", S.norm_basic(F.col("value")).alias("normalized")), f"select file_id || '_' || entity_type || '_' || position as id, file_id, entity_type, value, {NORM.format('value')} as normalized from {FOUND}")


def stored_entities(s: SparkSession, d: str) -> DataFrame:
    e = T.text_entities(s, d).withColumn("normalized", S.norm_basic(F.col("value")))
    return e.withColumn("context", F.when(F.col("position") % 2 == 0, F.concat(F.lit("in "), F.col("file_id").cast("string")))).withColumn("id", F.concat_ws("_", F.lpad(F.col("file_id").cast("string"), 12, "0"), F.lpad(F.col("position").cast("string"), 4, "0")))


@register("corr_consolidate", f"with e as (select f.*, {NORM.format('value')} as normalized, seconds, row_number() over (partition by entity_type, {NORM.format('value')}, f.position % 2 order by seconds, f.file_id, f.position) as r from {FOUND} f join {FILES} using (file_id)) select 'cent_' || substring(sha256(entity_type || ':' || normalized), 1, 12) as id, entity_type, normalized, count(*) as occurrence_count, count(distinct file_id) as file_count, md5(string_agg(distinct value, ',' order by value)) as variants, coalesce(string_agg('in ' || file_id, ',' order by r) filter (where position % 2 = 0 and r <= 10), '') as contexts, 1704067200 + min(seconds)::bigint as first_seen, 1704067200 + max(seconds)::bigint as last_seen from e group by entity_type, normalized")
def corr_consolidate(s: SparkSession, d: str) -> DataFrame:
    rows = correlation.consolidate(stored_entities(s, d), T.files(s, d))
    return rows.select("id", "entity_type", "normalized", "occurrence_count", "file_count", F.md5(F.array_join("variants", ",")).alias("variants"), F.array_join("contexts", ",").alias("contexts"), F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen"))


PLACES = "(select c_custkey, c_name || ' lives in ' || n_name || ', ' || lower(n_name) || ' or ' || n_name || ' since 2020.' as t, c_name, n_name from customer join nation on c_nationkey = n_nationkey)"


@register("ent_ner", f"select c_custkey as file_id, 'PERSON' as entity_type, c_name as value, 0 as start, substring(t, 1, length(c_name) + 50) as context from {PLACES} union all select c_custkey, 'LOCATION', n_name, length(c_name) + 10, substring(t, greatest(length(c_name) + 10 - 50, 0) + 1, length(c_name) + 10 + length(n_name) + 50 - greatest(length(c_name) + 10 - 50, 0)) from {PLACES} union all select c_custkey, 'LOCATION', n_name, length(c_name) + 16 + 2 * length(n_name), substring(t, greatest(length(c_name) + 16 + 2 * length(n_name) - 50, 0) + 1, length(c_name) + 16 + 3 * length(n_name) + 50 - greatest(length(c_name) + 16 + 2 * length(n_name) - 50, 0)) from {PLACES}")
def ent_ner(s: SparkSession, d: str) -> DataFrame:
    """A recogniser plugged in: names of customers and nations, in a sentence about each customer."""
    nations = [r["n_name"] for r in T.table(s, d, "nation").select("n_name").orderBy(F.length("n_name").desc(), "n_name").collect()]
    rows = T.table(s, d, "customer").join(F.broadcast(T.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat("c_name", F.lit(" lives in "), "n_name", F.lit(", "), F.lower("n_name"), F.lit(" or "), "n_name", F.lit(" since 2020."))
    found = extract.named(rows.select(F.col("c_custkey").alias("file_id"), text.alias("content")), extract.gazetteer({"PERSON": r"Customer#\d+", "GPE": "|".join(nations)}))
    return found.select("file_id", "entity_type", "value", "start", "context")


simple("win_entity_dedup", lambda s, d: extract.first_entities(T.entities(s, d).select("file_id", "entity_type", "value", F.lit(0).alias("start"), F.col("l_linenumber").alias("i")), "i").groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("i").cast("long").alias("firsts")), "select entity_type, count(*) as n, sum(i)::bigint as firsts from (select l_orderkey, entity_type, lower(v), min(l_linenumber) as i from (select l_orderkey, l_linenumber, unnest(['PERSON', 'ORG', 'PROJECT']) as entity_type, unnest([s_name, p_brand, p_type]) as v from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey) group by all) group by entity_type")
CELLS = "(select conv_id, turn, cell, c / sqrt(sum(c * c) over (partition by conv_id, turn)) as v from (select conv_id, turn, (('0x' || substring(md5(w), 1, 8))::bigint % 384)::int as cell, count(*)::double as c from (select conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as w from conversations) where w <> '' group by all))"
simple("embed_batch", lambda s, d: models.hashed_embeddings(T.table(s, d, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", F.posexplode("v").alias("cell", "v")).filter("v > 0").select("conv_id", "turn", "cell", r6("v")), f"select conv_id, turn, cell, round(v, 6) as v from {CELLS}")


@register("embed_cache", "with c as (select distinct sha256(text) as h from documents where lang = 'en'), n as (select h, count(distinct cell) as cells from (select sha256(text) as h, ('0x' || substring(md5(w), 1, 8))::bigint % 384 as cell from (select text, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as w from (select distinct text from documents)) where w <> '') group by h) select doc_id, sha256(text) in (select h from c) as cached, coalesce(cells, 0) as cells from documents left join n on h = sha256(text)")
def embed_cache(s: SparkSession, d: str) -> DataFrame:
    """The texts of one language were embedded before."""
    rows = T.table(s, d, "documents")
    old = rows.filter("lang = 'en'").select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    cache = models.hashed_embeddings(old, ["text_hash"], "text")
    return models.embed_with_cache(rows, ["doc_id"], "text", cache).select("doc_id", "cached", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("cells"))


# Patterns and discoveries
TECH_ROWS = "(select l_orderkey as file_id, " + quoted(t.lower() for t in V.TECH_TERMS) + f"[l_partkey % {len(V.TECH_TERMS)} + 1] as normalized from lineitem)"
CATEGORY = "case " + " ".join(f"when normalized = '{t}' then '{c}'" for t, c in V.TECH_CATEGORIES.items()) + " else 'other' end"
STACK = f"(select {CATEGORY} as category, normalized, file_id from {TECH_ROWS})"


def tech_rows(s: SparkSession, d: str) -> DataFrame:
    """A technology for each line of an order, by its part."""
    names = F.array(*[F.lit(t.lower()) for t in V.TECH_TERMS])
    return T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.get(names, (F.col("l_partkey") % len(V.TECH_TERMS)).cast("int")).alias("normalized"), F.lit("TECH").alias("entity_type"))


simple("pat_tech_stack", lambda s, d: correlation.tech_stack(tech_rows(s, d)).select("category", "normalized", "occurrences", "rank", "categories", "files", r6("confidence")), f"select category, normalized, n as occurrences, rank, (select count(distinct category) from {STACK}) as categories, (select count(distinct file_id) from {STACK}) as files, round(least(1.0::double, (select count(distinct file_id) from {STACK}) / 20.0::double), 6) as confidence from (select category, normalized, count(*) as n, row_number() over (partition by category order by count(*) desc, normalized)::int as rank from {STACK} group by category, normalized) where rank <= 5")
simple("agg_tech_stack", lambda s, d: correlation.tech_categories(tech_rows(s, d)).select("category", "occurrences", "files", F.array_join("top", ",").alias("top")), f"select category, sum(n)::bigint as occurrences, any_value(f) as files, string_agg(normalized, ',' order by rank) filter (where rank <= 5) as top from (select category, normalized, count(*) as n, row_number() over (partition by category order by count(*) desc, normalized) as rank from {STACK} group by category, normalized) join (select category, count(distinct file_id) as f from {STACK} group by category) using (category) group by category")
PATTERNS = f"(select 'expertise' as pattern_type, domain as title, confidence, files as sources from {EXPERTISE} where hits >= 5 and confidence >= 0.3::double union all select 'relationship', person || case when other like 'ORG:%' then ' works_with ' else ' works_on ' end || other, strength, count + 2 from (select *, case when e1 like 'PERSON:%' then e1 else e2 end as person, case when e1 like 'PERSON:%' then e2 else e1 end as other from {PAIRS}) where strength >= 0.2::double and person like 'PERSON:%' and (other like 'ORG:%' or other like 'PROJECT:%') union all select 'workflow', 'versioned', least(1.0::double, count(*) / 20.0::double), count(*) from {FILES} having count(*) >= 6 union all select 'heuristic', 'tech_stack', least(1.0::double, count(distinct file_id) / 20.0::double), count(distinct file_id) from {STACK} having count(distinct file_id) >= 6 and count(distinct category) >= 2)"


def all_patterns(s: SparkSession, d: str) -> DataFrame:
    return correlation.patterns(T.chunks(s, d), correlation.named(*correlation.coded_cooccurrence(T.entities(s, d))), T.files(s, d), tech_rows(s, d), 0.2)


simple("pred_patterns", lambda s, d: all_patterns(s, d).filter("confidence >= 0.5").orderBy(F.desc("confidence"), "title").select("pattern_type", "title", r6("confidence")), f"select pattern_type, title, round(confidence, 6) as confidence from {PATTERNS} where confidence >= 0.5::double")
simple("agg_pattern_stats", lambda s, d: correlation.pattern_stats(all_patterns(s, d)), f"select k as pattern_type, coalesce(n, 0) as n from (select unnest({quoted(correlation.PATTERN_TYPES)}) as k) left join (select pattern_type as k, count(*) as n from {PATTERNS} group by 1) using (k)")
SURFACED = f"(select 'disc_' || substring(sha256(t || '_' || title), 1, 12) as id, t as discovery_type, title, confidence from (select *, case pattern_type when 'heuristic' then 'skill' else pattern_type end as t from {PATTERNS}) where confidence >= 0.5::double and sources >= 2)"
simple("disc_surface", lambda s, d: correlation.surface(all_patterns(s, d), 0.5).select("id", "discovery_type", "title", r6("confidence"), "status"), f"select id, discovery_type, title, round(confidence, 6) as confidence, 'active' as status from {SURFACED}")
simple("corr_run", lambda s, d: correlation.run(T.entities(s, d), T.order_files(s, d), T.chunks(s, d), tech_rows(s, d), T.files(s, d), 0.2, 0.5)[1], f"select (select count(*) from (select distinct entity_type, normalized from {ENTITIES})) as entities, (select count(*) from {PAIRS}) as pairs, (select count(*) from {PATTERNS}) as patterns, (select count(*) from {SURFACED}) as discoveries")

STORED = f"(select 'disc_' || substring(sha256('workflow_' || n_name), 1, 12) as id, 'workflow' as discovery_type, n_name as title, 0.5::double + n_nationkey / 100.0::double as confidence, case n_nationkey % 3 when 0 then 'active' when 1 then 'confirmed' else 'dismissed' end as status from nation union all select id, 'expertise', title, 0.1::double, 'confirmed' from {DISCOVERED} where length(title) % 3 = 0)"
LOG = f"(select id, 'dismissed' as told, 'no' as note from {DISCOVERED} where length(title) % 2 = 0 union all select id, 'confirmed', 'yes' from {STORED} where title in (select n_name from nation where n_nationkey % 5 = 0))"
MERGED = f"(select coalesce(f.id, s.id) as id, coalesce(f.discovery_type, s.discovery_type) as discovery_type, coalesce(f.title, s.title) as title, coalesce(f.confidence, s.confidence) as confidence, coalesce(told, s.status, 'active') as status, note as user_feedback from (select id, 'expertise' as discovery_type, title, confidence from {DISCOVERED}) f full join {STORED} s on f.id = s.id left join {LOG} l on l.id = coalesce(f.id, s.id))"


def fresh(s: SparkSession, d: str) -> DataFrame:
    p = correlation.expertise(T.chunks(s, d)).select(F.lit("expertise").alias("pattern_type"), F.col("domain").alias("title"), "confidence", F.col("files").alias("sources"), "terms")
    return correlation.surface(p, 0.3, 1)


def stored(s: SparkSession, d: str) -> DataFrame:
    """Discoveries of earlier runs: one for each nation, which this run does not find, and some that it finds again."""
    n = T.table(s, d, "nation")
    status = F.when(F.col("n_nationkey") % 3 == 0, "active").when(F.col("n_nationkey") % 3 == 1, "confirmed").otherwise("dismissed")
    old = n.select(S.generate_id("disc", F.concat_ws("_", F.lit("workflow"), "n_name")).alias("id"), F.lit("workflow").alias("discovery_type"), F.col("n_name").alias("title"), (F.lit(0.5) + F.col("n_nationkey") / 100.0).alias("confidence"), status.alias("status"))
    return old.union(fresh(s, d).filter(F.length("title") % 3 == 0).select("id", F.lit("expertise"), "title", F.lit(0.1), F.lit("confirmed")))


def log(s: SparkSession, d: str) -> DataFrame:
    """Feedback: an early word and a last one."""
    dismissed = fresh(s, d).filter(F.length("title") % 2 == 0).select("id", F.explode(F.array(F.struct(F.lit("confirmed").alias("status"), F.lit("early").alias("note"), F.lit(1).alias("at")), F.struct(F.lit("dismissed").alias("status"), F.lit("no").alias("note"), F.lit(2).alias("at")))).alias("f")).select("id", "f.*")
    n = T.table(s, d, "nation").filter("n_nationkey % 5 = 0")
    return dismissed.union(n.select(S.generate_id("disc", F.concat_ws("_", F.lit("workflow"), "n_name")), F.lit("confirmed"), F.lit("yes"), F.lit(1)))


def merged(s: SparkSession, d: str) -> DataFrame:
    return correlation.merge_feedback(fresh(s, d).select("id", "discovery_type", "title", "confidence", "status"), stored(s, d), log(s, d))


simple("join_feedback", lambda s, d: merged(s, d).select("id", "title", "status", "user_feedback"), f"select id, title, status, user_feedback from {MERGED}")
simple("disc_merge", lambda s, d: merged(s, d).filter("status <> 'dismissed'").select("id", "discovery_type", "title", r6("confidence"), "status"), f"select id, discovery_type, title, round(confidence, 6) as confidence, status from {MERGED} where status <> 'dismissed'")
simple("pred_discoveries", lambda s, d: merged(s, d).filter("status <> 'dismissed' and confidence >= 0.55").orderBy(F.desc("confidence"), "id").limit(20).select("id", r6("confidence")), f"select id, round(confidence, 6) as confidence from {MERGED} where status <> 'dismissed' and confidence >= 0.55::double order by confidence desc, id limit 20")
simple("disc_feedback", lambda s, d: correlation.give_feedback(merged(s, d), stored(s, d).select("id", F.lit("confirmed").alias("status")).union(s.createDataFrame([("disc_none", "dismissed")], "id string, status string"))).select("id", "status", "found"), f"select id, 'confirmed' as status, true as found from {STORED} union all select 'disc_none', 'dismissed', false")
simple("agg_discoveries_by_type", lambda s, d: merged(s, d).groupBy("discovery_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "discovery_type"), f"select discovery_type, count(*) as n from {MERGED} group by 1")
simple("agg_discovery_stats", lambda s, d: correlation.discovery_stats(merged(s, d)).select("kind", "name", r6("value")), f"select 'type' as kind, discovery_type as name, count(*)::double as value from {MERGED} group by 2 union all select 'status', status, count(*)::double from {MERGED} group by 2 union all select 'mean', 'confidence', round(coalesce(avg(confidence), 0), 6) from {MERGED}")
simple("topk_discoveries", lambda s, d: merged(s, d).filter("status = 'active'").orderBy(F.desc("confidence"), "id").limit(5).select("id", "title"), f"select id, title from {MERGED} where status = 'active' order by confidence desc, id limit 5")


@register("graph_nodes", f"select 'disc_' || substring(sha256('expertise_' || domain), 1, 12) as id, 'discovery' as type, domain as label, terms as evidence_count, files as source_count from {EXPERTISE} where hits >= 5 and confidence >= 0.3::double")
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    rows = fresh(s, d).withColumn("evidence", F.array_repeat(F.lit("term"), F.col("terms").cast("int"))).withColumn("sources", F.array_repeat(F.lit("file"), F.col("sources").cast("int")))
    nodes = catalog.graph_nodes(rows)
    return nodes.select("id", "type", "label", *[F.get_json_object("properties", f"$.{c}").cast("long").alias(c) for c in ("evidence_count", "source_count")])


# Statistics
@register("agg_totals", f"select (select count(*) from documents) as files, (select sum(len(string_split(text, chr(10)))) from documents)::bigint as chunks, (select count(*) from {ENTITIES}) as entities, (select count(distinct conv_id) from conversations) as conversations, (select count(*) from {MERGED} where status = 'active') as active_discoveries")
def agg_totals(s: SparkSession, d: str) -> DataFrame:
    parts = [T.files(s, d).agg(F.count("*").alias("files")), chunking.line_blocks(T.chunks(s, d), 1).agg(F.count("*").alias("chunks")), T.entities(s, d).agg(F.count("*").alias("entities")), T.messages(s, d).agg(F.countDistinct("conv_id").alias("conversations")), merged(s, d).agg(F.count_if(F.col("status") == "active").alias("active_discoveries"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


simple("agg_consolidated_stats", lambda s, d: correlation.consolidated_stats(correlation.consolidated_keys(T.entities(s, d), T.order_files(s, d)), correlation.coded_cooccurrence(T.entities(s, d))[0]), f"select 'type' as kind, entity_type as name, count(distinct normalized) as n from {ENTITIES} group by 2 union all select 'total', 'entities', count(*) from (select distinct entity_type, normalized from {ENTITIES}) union all select 'pairs', 'all', count(*) from {PAIRS} union all select 'pairs', 'strong', count(*) from {PAIRS} where strength >= 0.5::double")
simple("topk_entities_cap", lambda s, d: correlation.cooccurrence(T.entities(s, d), most_entities=200).select("e1", "e2", "count"), f"with t as (select key from (select distinct file_id, key from {ENTITIES}) group by key order by count(*) desc, key limit 200), r as (select *, row_number() over (partition by file_id order by key) - 1 as i, count(*) over (partition by file_id) as n from (select distinct file_id, key from {ENTITIES} where key in (select key from t))) select a.key as e1, b.key as e2, count(*) as count from r a join r b using (file_id) where a.i < b.i and a.i * (a.n - 1) - a.i * (a.i - 1) / 2 + b.i - a.i - 1 < 500 group by all")
TOPICS = f"(select entity, count(*) as m, sum(n) as n from {INDEX} group by entity having count(*) > 1 and least(1.0::double, (count(*) / 3.0::double) * (sum(n) / 10.0::double)) > 0.3::double)"
COLLAB = f"(select a.machine as m1, b.machine as m2, count(*) as shared from {INDEX} a join {INDEX} b using (entity) where a.machine < b.machine group by all having count(*) >= 5)"
SILOS = f"(select machine, count(*) as alone, any_value(e) as e from (select max(machine) as machine from {INDEX} group by entity having count(*) = 1) join (select machine, count(*) as e from {INDEX} group by machine) using (machine) group by machine having count(*) >= 10)"
index = lambda s, d: machines.index(T.machine_words(s, d))
simple("agg_cross_summary", lambda s, d: machines.summary(index(s, d)), f"select (select count(distinct machine) from {INDEX}) as machines, (select count(distinct entity) from {INDEX}) as entities, (select least(50, count(*)) from {TOPICS}) as topic, (select count(*) from {COLLAB}) as collaboration, (select count(*) from {SILOS}) as expertise")
HUB = f"(select machine, count(*) as shared from (select *, count(*) over (partition by entity) as m from {INDEX}) where m > 1 group by machine order by shared desc, machine limit 1)"
INSIGHTS = f"(select 'insight_distribution' as id, machine as subject, shared as value, 0.8::double as confidence from {HUB} union all select * from (select 'insight_collaboration', m1 || ' and ' || m2, shared, least(1.0::double, shared / 20.0::double) from {COLLAB} order by m1, m2 limit 1) union all select 'insight_silos', null, count(*), 0.7::double from {SILOS} where alone / e::double > 0.5::double having count(*) > 0)"
simple("xm_insights", lambda s, d: machines.insights(index(s, d)).select("id", "subject", "value", r6("confidence")), f"select id, subject, value, round(confidence, 6) as confidence from {INSIGHTS}")
simple("xm_summary", lambda s, d: machines.summary(index(s, d)).crossJoin(machines.insights(index(s, d)).agg(F.count("*").alias("insights"))).select("machines", "entities", (F.col("topic") + F.col("collaboration") + F.col("expertise")).alias("patterns"), "insights"), f"select (select count(distinct machine) from {INDEX}) as machines, (select count(distinct entity) from {INDEX}) as entities, (select least(50, count(*)) from {TOPICS}) + (select count(*) from {COLLAB}) + (select count(*) from {SILOS}) as patterns, (select count(*) from {INSIGHTS}) as insights")
simple("xm_topics", lambda s, d: machines.topics(index(s, d)).select(S.generate_id("topic", F.col("entity")).alias("id"), "entity", "mention_count"), f"select 'topic_' || substring(sha256(entity), 1, 12) as id, entity, n::bigint as mention_count from {TOPICS} order by least(1.0::double, (m / 3.0::double) * (n / 10.0::double)) desc, n desc, entity limit 50")

# Windows
DAILY = "(select event_type, date_trunc('day', ts) as day, count(*) as n from events group by all)"


@register("win_sparkline", f"with a as (select event_type, list(n order by day) as v from {DAILY} group by event_type) select event_type, rpad(array_to_string(list_transform(v[-20:], lambda x: substring('▁▂▃▄▅▆▇█', floor((x - list_min(v)) / (case when list_max(v) > list_min(v) then list_max(v) - list_min(v) else 1 end) * 7)::int + 1, 1)), ''), 20, '▁') as line from a")
def win_sparkline(s: SparkSession, d: str) -> DataFrame:
    n = T.table(s, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    values = n.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))
    return values.select("event_type", S.sparkline(F.col("v")).alias("line"))


ENDED = f"(select *, row_number() over (partition by job_type order by completed_at desc, job_id desc) as rn from {JOBS} where completed_at is not null)"


@register("win_eta", f"select job_type, round(greatest(0::double, avg(floor(epoch(completed_at)) - floor(epoch(started_at))) - 40), 6) as eta from {ENDED} where rn <= case when job_type = 'purchase' then 1 else 10 end group by job_type")
def win_eta(s: SparkSession, d: str) -> DataFrame:
    """What is left of jobs that began 40 seconds ago: the mean of the last ten of a type, for one type the last, less what passed, not below 0."""
    last = F.row_number().over(Window.partitionBy("job_type").orderBy(F.desc("completed_at"), F.desc("job_id")))
    rows = T.jobs(s, d).filter("completed_at is not null").withColumn("rn", last).filter(F.col("rn") <= F.when(F.col("job_type") == "purchase", 1).otherwise(10))
    mean = F.avg(F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))
    return rows.groupBy("job_type").agg(F.round(F.greatest(F.lit(0.0), mean - 40), 6).alias("eta"))


@register("win_progress_eta", f"with h as (select job_type, date_trunc('hour', completed_at) as h, count(*) as n from {JOBS} where status = 'completed' group by all), r as (select job_type, avg(n) as rate from (select *, row_number() over (partition by job_type order by h desc) as k from h) where k <= 60 group by 1) select job_type, round(count(*) filter (where status <> 'completed') / any_value(rate), 6) as hours from {JOBS} join r using (job_type) group by job_type")
def win_progress_eta(s: SparkSession, d: str) -> DataFrame:
    """Hours left by type: what is not done over the mean of the last sixty hourly rates."""
    j = T.jobs(s, d)
    h = j.filter("status = 'completed'").groupBy("job_type", F.date_trunc("hour", "completed_at").alias("h")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("job_type").orderBy(F.desc("h")))
    rate = h.withColumn("k", k).filter("k <= 60").groupBy("job_type").agg(F.avg("n").alias("rate"))
    left = j.groupBy("job_type").agg(F.count_if(F.col("status") != "completed").alias("left"))
    return left.join(rate, "job_type").select("job_type", F.round(F.col("left") / F.col("rate"), 6).alias("hours"))


# Sets and scalars
@register("set_missing_tables", f"select unnest({quoted(sorted(['jobs', 'messages', 'conversations']))}) as name")
def set_missing_tables(s: SparkSession, d: str) -> DataFrame:
    c = catalog.Catalog(s, catalog.scratch(s, "required"))
    for name in ("files", "chunks"):
        c.replace(name, T.files(s, d).select("file_id"))
    return s.createDataFrame([(n,) for n in c.missing(["files", "chunks", "jobs", "messages", "conversations"])], "name string")


@register("set_merge_catalogs", f"select file_id, path, machine from {FILES}")
def set_merge_catalogs(s: SparkSession, d: str) -> DataFrame:
    """The catalogs of all machines, each with its columns in an order of its own, as one."""
    files = T.files(s, d)
    names = [r["machine"] for r in files.select("machine").distinct().orderBy("machine").collect()]
    parts = [files.filter(F.col("machine") == m).select(*(["file_id", "path", "machine"] if i % 2 else ["machine", "path", "file_id"])) for i, m in enumerate(names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("file_id", "path", "machine")


simple("fn_hash_file", lambda s, d: T.table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).select("doc_id", F.sha2("b", 256).alias("sha256"), F.md5("b").alias("md5"), F.sha1("b").alias("sha1")), "select doc_id, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from documents")
LABELS = [*V.LABELS, "OTHER"]
simple("fn_label_map", lambda s, d: T.table(s, d, "customer").select("c_custkey", S.label_of(F.get(F.array(*map(F.lit, LABELS)), (F.col("c_custkey") % len(LABELS)).cast("int"))).alias("label")), f"select c_custkey, {quoted([*V.LABELS.values(), 'OTHER'])}[c_custkey % {len(LABELS)} + 1] as label from customer")
TENTHS = "round_even(k / {u}::double, 0)::bigint"
simple("fn_format_bytes_time", lambda s, d: T.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 20000).alias("k")).select("o_orderkey", S.format_bytes(F.col("o_orderkey") * 97).alias("bytes"), S.uptime(F.col("k")).alias("uptime"), S.elapsed(F.col("k")).alias("elapsed"), S.grouped(F.col("o_orderkey") * 97).alias("number"), S.bar(F.col("k"), F.lit(15000), 20).alias("bar")), "select o_orderkey, case when b < 1024 then b || ' B' when b < 1048576 then format('{:.1f} KB', b / 1024.0::double) else format('{:.1f} MB', b / 1048576.0::double) end as bytes, case when k < 60 then k || 's' when k < 3600 then round_even(k / 60.0::double, 0)::bigint || 'm' else k // 3600 || 'h ' || k % 3600 // 60 || 'm' end as uptime, case when k < 60 then k || 's' when k < 3600 then t1 // 10 || '.' || t1 % 10 || 'm' else t2 // 10 || '.' || t2 % 10 || 'h' end as elapsed, format('{:,}', b) as number, repeat('█', f) || repeat('░', 20 - f) as bar from (select *, " + TENTHS.format(u=6) + " as t1, " + TENTHS.format(u=360) + " as t2, floor(least(1.0::double, k / 15000.0::double) * 20)::int as f from (select o_orderkey, o_orderkey * 7 % 20000 as k, o_orderkey * 97 as b from orders))")
simple("fn_json_encode", lambda s, d: T.table(s, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.array("turn", "conv_id").alias("ids"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("j")), "select conv_id, turn, to_json({'role': role, 'ids': [turn, conv_id], 'none': null})::varchar as j from conversations")
simple("fn_json_decode", lambda s, d: T.table(s, d, "events").select("event_id", F.from_json("props", "map<string,long>").alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").cast("long").alias("n")), "select event_id, (props ->> '$.k')::bigint as k, len(json_keys(props))::bigint as n from events")


@register("fn_nested_get", "select page_id, 'src/' || page_id as first_path, 'on' as flag, null::varchar as nothing, url as second_path from pages")
def fn_nested_get(s: SparkSession, d: str) -> DataFrame:
    """Values at dotted paths of a configuration for each page."""
    source = lambda p: F.struct(p.alias("path"), F.struct(F.lit("on").alias("ocr")).alias("flags"))
    config = F.to_json(F.struct(F.array(source(F.concat(F.lit("src/"), F.col("page_id").cast("string"))), source(F.col("url"))).alias("sources")))
    rows = T.table(s, d, "pages").select("page_id", config.alias("c"))
    return rows.select("page_id", S.nested_get(F.col("c"), "sources.0.path").alias("first_path"), S.nested_get(F.col("c"), "sources.1.flags.ocr").alias("flag"), S.nested_get(F.col("c"), "sources.7.path").alias("nothing"), S.nested_get(F.col("c"), "sources.1.path").alias("second_path"))


def rendered(s: SparkSession, d: str, form: str) -> DataFrame:
    """The first message of each conversation as a question's whole context, with one discovery and one entity."""
    first = T.table(s, d, "conversations").filter("turn = 0")
    return first.select("conv_id", models.rendered(F.col("role"), F.array(F.struct(F.col("text").alias("content"), F.lit("mail").alias("source"), F.lit(0.75).alias("similarity"), F.col("role").alias("chunk_type"))), F.array(F.struct(F.lit("skill").alias("discovery_type"), F.lit("Spark").alias("title"), F.lit("daily").alias("description"), F.lit(0.5).alias("confidence"))), F.array(F.struct(F.lit("ORG").alias("entity_type"), F.lit("Acme").alias("canonical_value"))), form).alias("text"))


simple("fn_xml", lambda s, d: rendered(s, d, "xml"), "select conv_id, '<context>\n<query>' || role || '</query>\n\n<relevant_content>\n<chunk index=\"1\" similarity=\"0.75\" source=\"mail\" type=\"' || role || '\">\n' || text || '\n</chunk>\n\n</relevant_content>\n\n<discoveries>\n<discovery type=\"skill\" confidence=\"0.50\">\nSpark: daily\n</discovery>\n\n</discoveries>\n\n<key_entities>\n  <entity type=\"ORG\">Acme</entity>\n</key_entities>\n</context>' as text from conversations where turn = 0")
simple("fn_markdown", lambda s, d: rendered(s, d, "markdown"), "select conv_id, '## Context: ' || role || '\n\n### Relevant Content\n\n**[1]** _mail_ (similarity: 0.75)\n\n> ' || case when length(text) > 500 then substring(text, 1, 500) || '...' else text end || '\n\n### Discoveries\n\n- **Spark** (50%): daily\n\n### Key Entities\n\n- [ORG] Acme\n' as text from conversations where turn = 0")
simple("fn_expertise_conf", lambda s, d: T.table(s, d, "part").select("p_partkey", F.round(S.expertise_confidence(F.col("p_size") * 3, F.col("p_size"), F.col("p_size") % 14, F.lit(14.0)), 6).alias("v")), "select p_partkey, round(0.4::double * least(1.0::double, log10(p_size * 3 + 1) / 2) + 0.3::double * least(1.0::double, p_size / 10.0::double) + 0.3::double * (p_size % 14 / 14.0::double), 6) as v from part")

PMI_ALL = f"with e as (select distinct file_id, key from {ENTITIES}), n as (select count(distinct file_id)::double as f from e), one as (select key, count(*) as c from e group by key), two as (select a.key as e1, b.key as e2, count(*) as cooc from e a join e b using (file_id) where a.key < b.key group by all) select e1, e2, cooc, greatest(-10.0::double, least(10.0::double, ln((cooc / f + 1e-10::double) / ((x.c / f) * (y.c / f) + 1e-10::double)))) as pmi from two join one x on x.key = e1 join one y on y.key = e2, n"

# Vectors: queries are the rows whose vec_id is divisible by 100, against all rows
QUERY_SET = "(select vec_id as query_id, embedding as query from embeddings where vec_id % 100 = 0)"
NEAR = "select query_id, row_number() over (partition by query_id order by {d}, b.vec_id)::int as rank, b.vec_id from " + QUERY_SET + " a, embeddings b qualify rank <= {k}"
COS = "1 - list_cosine_similarity(a.query::double[], b.embedding::double[])"


def asked(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


vectors = lambda s, d: T.table(s, d, "embeddings")
simple("vec_batch", lambda s, d: search.nearest_batch(vectors(s, d), asked(s, d), 5).select("query_id", "rank", "vec_id"), NEAR.format(d=COS, k=5))
simple("join_knn", lambda s, d: search.nearest_batch(vectors(s, d), asked(s, d), 5, "l2").select("query_id", "rank", "vec_id"), NEAR.format(d="list_distance(a.query::double[], b.embedding::double[])", k=5))
simple("topk_knn", lambda s, d: search.nearest_batch(vectors(s, d), asked(s, d), 10).select("query_id", "rank", "vec_id", F.abs(F.round("distance", 5)).alias("distance")), f"select query_id, rank, vec_id, abs(round({COS}, 5)) as distance from ({NEAR.format(d=COS, k=10)}) n join {QUERY_SET} a using (query_id) join embeddings b using (vec_id)")
simple("topk_pmi", lambda s, d: correlation.pmi_pairs(T.entities(s, d), 0.3).select("e1", "e2", r6("confidence")), f"select e1, e2, round(least(1.0::double, pmi / 5 * cooc / 10), 6) as confidence from ({PMI_ALL}) where cooc >= 2 and pmi > 0.3::double order by least(1.0::double, pmi / 5 * cooc / 10) desc, e1, e2 limit 100")
simple("vec_hybrid", lambda s, d: search.hybrid(vectors(s, d), asked(s, d), 5).select("query_id", "rank", "vec_id"), NEAR.format(d=COS, k=5))
simple("vec_ivf", lambda s, d: models.InvertedFile.build(vectors(s, d)).nearest_batch(asked(s, d), 5).select("query_id", "rank", "vec_id"))
simple("vec_hnsw", lambda s, d: GraphIndex.build(vectors(s, d)).nearest_batch(asked(s, d), 5).select("query_id", "rank", "vec_id"))
TALK = "(select conv_id * 1000 + turn as vec_id, text, conv_id, turn from conversations)"


@register("vec_query_text", f"with q as (select cell, v from {CELLS} where conv_id = 0 and turn = 0), n as (select conv_id, turn, sum(c.v * q.v) as sim from {CELLS} c join q using (cell) group by all) select conv_id, turn, abs(round(1 - sim, 5)) as distance from n order by round(1 - sim, 5), conv_id, turn limit 10")
def vec_query_text(s: SparkSession, d: str) -> DataFrame:
    """The messages nearest to the text of the first one, by the embedder that the collection was made with."""
    talk = T.table(s, d, "conversations")
    rows = models.hashed_embeddings(talk, ["conv_id", "turn"], "text").filter(F.exists("v", lambda x: x != 0))
    query = models.hashed_embeddings(talk.filter("conv_id = 0 and turn = 0").select(F.lit(0).alias("q"), "text"), ["q"], "text").first()["v"]
    near = rows.withColumn("distance", F.abs(F.round(search.cosine_distance(F.col("v"), F.array(*[F.lit(float(x)) for x in query])), 5)))
    return near.orderBy("distance", "conv_id", "turn").limit(10).select("conv_id", "turn", "distance")


@register("vec_context", f"with n as (select b.vec_id, 1 - (1 - {COSINE}) as sim, row_number() over (order by 1 - {COSINE}, b.vec_id) as rank from {FIRST} a, embeddings b qualify rank <= 5), c as (select row_number() over (order by rank) as rank, sim, text, source, lang from n join documents on doc_id = vec_id where sim >= 0.2::double), dd as (select *, row_number() over (order by confidence desc, id) as rank from {MERGED} where status <> 'dismissed' and confidence >= 0.55::double qualify rank <= 3), e as (select entity_type, normalized, row_number() over (order by count(*) desc, entity_type, normalized) as rank from {ENTITIES} group by entity_type, normalized having count(*) >= 3 qualify rank <= 10) select '<context>\n<query>what</query>\n\n<relevant_content>\n' || (select string_agg('<chunk index=\"' || rank || '\" similarity=\"' || format('{{:.2f}}', sim) || '\" source=\"' || source || '\" type=\"' || lang || '\">\n' || text || '\n</chunk>\n\n', '' order by rank) from c) || '</relevant_content>\n' || (select case when count(*) > 0 then '\n<discoveries>\n' || string_agg('<discovery type=\"' || discovery_type || '\" confidence=\"' || format('{{:.2f}}', confidence) || '\">\n' || title || ': \n</discovery>\n\n', '' order by rank) || '</discoveries>\n' else '' end from dd) || (select '\n<key_entities>\n' || string_agg('  <entity type=\"' || entity_type || '\">' || normalized || '</entity>\n', '' order by rank) || '</key_entities>\n' from e) || '</context>' as context")
def vec_context(s: SparkSession, d: str) -> DataFrame:
    """The context of a question: nearest chunks, surest discoveries, most frequent entities."""
    first = vectors(s, d).orderBy("vec_id").first()["embedding"]
    numbered = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  over the few rows of a top-k
    near = numbered(search.nearest(vectors(s, d), first, 5).select("vec_id", "distance"), "distance", "vec_id").withColumn("similarity", 1 - F.col("distance")).filter("similarity >= 0.2")
    chunks = near.join(T.table(s, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("rank", F.col("text").alias("content"), "source", "similarity", F.col("lang").alias("chunk_type"))
    best = numbered(merged(s, d).filter("status <> 'dismissed' and confidence >= 0.55").orderBy(F.desc("confidence"), "id").limit(3), F.desc("confidence"), "id").withColumn("description", F.lit(""))
    top = T.entities(s, d).groupBy("entity_type", "normalized").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "entity_type", "normalized").limit(10)
    return models.bundle("what", chunks, best, numbered(top, F.desc("n"), "entity_type", "normalized").withColumn("canonical_value", F.col("normalized")))


# Jobs and events
simple("st_queue", lambda s, d: queue_of(s, d), f"select job_id, priority, row_number() over (partition by priority order by created_at, job_id)::int as place from {JOBS} where status = 'pending'")


def queue_of(s: SparkSession, d: str) -> DataFrame:
    """Jobs put into a queue; what another process finds waiting there, in its order."""
    folder = catalog.scratch(s, "queue")
    J.Queue(s, folder).enqueue(T.jobs(s, d))
    return J.places(J.Queue(s, folder).jobs()).select("job_id", "priority", F.col("place").cast("int").alias("place"))


@register("st_worker", f"select job_type, case job_type when 'error' then 'failed' when 'view' then 'failed' else 'completed' end as status, count(*) as n, max(case job_type when 'error' then 'it broke' when 'view' then 'no handler for view' end) as error from {JOBS} where status = 'pending' group by all")
def st_worker(s: SparkSession, d: str) -> DataFrame:
    """All pending jobs are worked off by a stream: one type's handler raises, one type has none."""
    q = J.JobLog(s, catalog.scratch(s, "worker"))
    pending = T.jobs(s, d).filter("status = 'pending'")
    q.enqueue(pending)

    def broken(jobs: DataFrame) -> None:
        raise RuntimeError("it broke")

    kinds = [r["job_type"] for r in pending.select("job_type").distinct().collect()]
    handlers = {k: (lambda jobs: None) for k in kinds if k != "view"} | {"error": broken}
    q.work(handlers).trigger(availableNow=True).start().awaitTermination()
    return q.jobs().groupBy("job_type", "status").agg(F.count("*").alias("n"), F.max("error").alias("error"))


EXPANDED = f"with b as (select r_regionkey as batch_id, r_regionkey <> 1 as f, r_regionkey <> 2 as x, r_regionkey <> 3 as c from region) select batch_id, 'file_extraction' as job_type, 2 as priority, path from b, {FILES} where f union all select batch_id, 'fae_processing', 2, url from b, pages where x union all select batch_id, 'correlation', 4, null from b where c"


@register("st_batch_expand", f"select batch_id, job_type, priority, count(*) as n, count(distinct path) as paths from ({EXPANDED}) group by all")
def st_batch_expand(s: SparkSession, d: str) -> DataFrame:
    """A batch job for each region, some without files, exports or a correlation."""
    k = F.col("r_regionkey")
    batches = T.table(s, d, "region").select(k.alias("batch_id"), (k != 1).alias("files"), (k != 2).alias("exports"), (k != 3).alias("correlate"))
    jobs = J.expand(batches, T.files(s, d).select("path"), T.table(s, d, "pages").select(F.col("url").alias("path")))
    return jobs.groupBy("batch_id", "job_type", "priority").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


NAMES = ["a/report.md", "b/.git/config", "c/chat_1.json", "d/node_modules/x.js", "e/notes.TMP", ".hidden", "f/conversations.json", "g/Thumbs.db"]


@register("st_watch", "select event_id, path, case when path like '%.json' then 'fae_processing' else 'file_extraction' end as job_type, case when path like '%.json' then 2 else 3 end as priority from (select event_id, '/' || " + quoted(NAMES) + "[event_id % 8 + 1] as path, case event_type when 'click' then 'created' when 'view' then 'modified' else 'deleted' end as kind from events) where kind in ('created', 'modified') and path in ('/a/report.md', '/c/chat_1.json', '/f/conversations.json')")
def st_watch(s: SparkSession, d: str) -> DataFrame:
    """File events of eight paths; the jobs they ask for."""
    kind = F.when(F.col("event_type") == "click", "created").when(F.col("event_type") == "view", "modified").otherwise("deleted")
    path = F.concat(F.lit("/"), F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 8).cast("int")))
    return J.asked_by_events(T.table(s, d, "events").select("event_id", path.alias("path"), kind.alias("kind"))).select("event_id", "path", "job_type", "priority")


simple("st_schedule", lambda s, d: T.jobs(s, d).select("job_id", J.due(F.col("created_at"), "*/15 1-5,20 * * 1,3").alias("a"), J.due(F.col("created_at"), "0 * 1-15 1 *").alias("b")), "select event_id as job_id, minute(ts) % 15 = 0 and (hour(ts) between 1 and 5 or hour(ts) = 20) and dayofweek(ts) in (1, 3) as a, minute(ts) = 0 and day(ts) <= 15 and month(ts) = 1 as b from events")
simple("fn_pmi", lambda s, d: correlation.pmi_pairs(T.entities(s, d), 0.1, 1, None).select("e1", "e2", "cooc", r6("pmi")), f"select e1, e2, cooc, round(pmi, 6) as pmi from ({PMI_ALL}) where pmi >= 0.1::double")
