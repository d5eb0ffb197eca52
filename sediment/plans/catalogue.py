"""Registered queries over the driver tables, with DuckDB SQL for each that SQL can express.

Keys are the operator ids of the blueprint. Every query runs over its whole tables; a limit stands only where
it is the operator (a top-k, the first n of a group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..operators import chunking, correlation, density, machines, models, search
from ..sources import extract
from ..sources import standins as T
from ..streaming import events as streams
from . import archive, knowledge  # noqa: F401  their queries are registered by importing them
from .fragments import COSINE, ENTITIES, EXPERTISE, FILES, FIRST, HITS, INDEX, JOBS, NORM, PAIRS, RANKED, RELATED, TECH, WORDS
from .registry import ORACLES, QUERIES, register, simple

def r6(c: str):
    return F.round(c, 6).alias(c)


# Scans and reads
simple("src_javascript", lambda s, d: T.table(s, d, "pages").select("page_id", ((F.length("html") - F.length(F.replace("html", F.lit("function "), F.lit("")))) / 9 + (F.length("html") - F.length(F.replace("html", F.lit("=> "), F.lit("")))) / 3).cast("long").alias("functions"), F.when(F.lower("html").contains("react"), "react").when(F.lower("html").contains("angular"), "angular").when(F.lower("html").contains("vue"), "vue").alias("framework")), "select page_id, ((length(html) - length(replace(html, 'function ', ''))) / 9 + (length(html) - length(replace(html, '=> ', ''))) / 3)::bigint as functions, case when contains(lower(html), 'react') then 'react' when contains(lower(html), 'angular') then 'angular' when contains(lower(html), 'vue') then 'vue' end as framework from pages")
simple("src_json", lambda s, d: T.table(s, d, "events").select("event_id", F.array_join(F.slice(F.json_object_keys("props"), 1, 20), ",").alias("top_keys"), F.size(F.json_object_keys("props")).cast("long").alias("item_count")), "select event_id, array_to_string(json_keys(props)[1:20], ',') as top_keys, len(json_keys(props))::bigint as item_count from events")

# Predicates and projections
simple("pred_exclude", lambda s, d: T.table(s, d, "pages").filter(S.included(F.col("url"), F.regexp_extract("url", "[^/]*$", 0))).select("page_id"), "select page_id from pages where not regexp_matches(url, '^(?:.*.*/node_modules/.*.*|.*.*/\\.git/.*.*|.*.*/venv/.*.*|.*.*/__pycache__/.*.*|.*.*/AppData/.*.*|.*.*/\\$RECYCLE\\.BIN/.*.*)$') and not regexp_matches(regexp_extract(url, '[^/]*$'), '^(?:.*\\.tmp|.*\\.log|.*\\.bak|Thumbs\\.db|desktop\\.ini|\\.DS_Store)$')")
simple("pred_size", lambda s, d: T.files(s, d).filter(F.col("size_bytes") <= S.size_limit("2KB")).select("file_id", "size_bytes"), f"select file_id, size_bytes from {FILES} where size_bytes <= 2048")
simple("pred_depth", lambda s, d: T.table(s, d, "pages").select("page_id", S.depth_ok(F.regexp_extract("url", "^https?://[^/]+", 0), F.col("url"), 0).alias("ok")), "select page_id, starts_with(url, regexp_extract(url, '^https?://[^/]+') || '/') and len(string_split(substring(url, length(regexp_extract(url, '^https?://[^/]+')) + 2), '/')) - 1 <= 0 as ok from pages")
simple("pred_file_types", lambda s, d: T.files(s, d).filter(F.lower("extension").isin("en", "fr")).select("file_id"), f"select file_id from {FILES} where lower(extension) in ('en', 'fr')")
simple("pred_export_trigger", lambda s, d: T.table(s, d, "pages").select("page_id", S.export_trigger(F.concat("url", F.lit(".json"))).alias("hit")), "select page_id, lower(url || '.json') = 'conversations.json' or ((contains(lower(url || '.json'), 'export') or contains(lower(url || '.json'), 'chat')) and ends_with(lower(url || '.json'), '.json')) as hit from pages")
simple("proj_truncate", lambda s, d: T.table(s, d, "documents").select("doc_id", S.truncated(F.col("text"), 500).alias("content"), S.truncated(F.col("text"), 200).alias("preview")), "select doc_id, case when length(text) > 500 then substring(text, 1, 500) || '...' else text end as content, case when length(text) > 200 then substring(text, 1, 200) || '...' else text end as preview from documents")


@register("proj_conversation", "select conv_id, count(*) as turns, string_agg(role || ':' || c, '|' order by sequence) filter (where rn <= 50) as head from (select conv_id, turn as sequence, case role when 'user' then 'human' else role end as role, case when length(text) > 500 then substring(text, 1, 500) || '...' else text end as c, row_number() over (partition by conv_id order by turn) as rn from conversations) group by conv_id")
def proj_conversation(s: SparkSession, d: str) -> DataFrame:
    m = T.messages(s, d).withColumn("c", S.truncated(F.col("content"), 500))
    first = m.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("sequence"))).filter("rn <= 50")
    head = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", "role", "c").alias("line")))).alias("a"))
    return m.groupBy("conv_id").agg(F.count("*").alias("turns")).join(head, "conv_id").select("conv_id", "turns", F.array_join(F.transform("a", lambda x: x["line"]), "|").alias("head"))


# Joins
simple("join_entities_files", lambda s, d: T.entities(s, d).join(T.order_files(s, d), "file_id").groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files")), f"select entity_type, count(*) as n, count(distinct file_id) as files from {ENTITIES} group by entity_type")
simple("join_chunks_files", lambda s, d: T.chunks(s, d).join(T.files(s, d).filter("status = 'indexed'"), "file_id").select("file_id", F.length("content").cast("long").alias("n")), f"select file_id, length(text) as n from documents join {FILES} on doc_id = file_id where status = 'indexed'")
simple("join_entities_files_machine", lambda s, d: T.tech_entities(s, d).join(T.files(s, d), "file_id").groupBy(S.machine_of(F.col("path")).alias("machine"), "normalized").agg(F.count("*").alias("n")), f"select regexp_extract(path, '^\\[([^\\]]*)\\]', 1) as machine, normalized, count(*) as n from {TECH} join {FILES} using (file_id) group by all")
simple("join_cooc_self", lambda s, d: correlation.all_pairs(T.entities(s, d)).select("e1", "e2", F.col("cooc").alias("count")), f"select a.key as e1, b.key as e2, count(*) as count from {RANKED} a join {RANKED} b using (file_id) where a.i < b.i group by all")
simple("join_dictionary_contains", lambda s, d: correlation.term_hits(T.chunks(s, d)), f"select file_id, domain, term from {HITS}")
simple("join_tech_dictionary", lambda s, d: T.tech_entities(s, d).groupBy("file_id", "normalized").agg(F.count("*").alias("n")), f"select file_id, normalized, count(*) as n from {TECH} group by all")
simple("join_dedup_anti", lambda s, d: T.table(s, d, "orders").join(T.table(s, d, "lineitem").filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"), "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
simple("join_type_map", lambda s, d: T.jobs(s, d).select("job_id", F.coalesce(S.literal_map({"click": "interaction", "view": "interaction", "purchase": "sale"})[F.col("job_type")], F.col("job_type")).alias("kind")), f"select job_id, case when job_type in ('click', 'view') then 'interaction' when job_type = 'purchase' then 'sale' else job_type end as kind from {JOBS}")
simple("join_pair_lookup", lambda s, d: correlation.relationships(correlation.cooccurrence(T.entities(s, d)), 0.2).select("person", "other", "relation", r6("confidence")), f"select case when e1 like 'PERSON:%' then e1 else e2 end as person, case when e1 like 'PERSON:%' then e2 else e1 end as other, case when (case when e1 like 'PERSON:%' then e2 else e1 end) like 'ORG:%' then 'works_with' else 'works_on' end as relation, round(strength, 6) as confidence from {PAIRS} where strength >= 0.2::double and ((e1 like 'PERSON:%' and (e2 like 'ORG:%' or e2 like 'PROJECT:%')) or (e2 like 'PERSON:%' and (e1 like 'ORG:%' or e1 like 'PROJECT:%')))")

# Aggregations
simple("agg_files_by_status", lambda s, d: T.files(s, d).groupBy("status").agg(F.count("*").alias("n")), f"select status, count(*) as n from {FILES} group by status")
simple("agg_files_by_ext", lambda s, d: T.files(s, d).filter("extension is not null").groupBy("extension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(10), f"select extension, count(*) as n from {FILES} where extension is not null group by extension order by n desc, extension limit 10")
simple("agg_entities_by_type", lambda s, d: T.entities(s, d).groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(10), f"select entity_type, count(*) as n from {ENTITIES} group by entity_type order by n desc, entity_type limit 10")
simple("agg_jobs", lambda s, d: T.jobs(s, d).groupBy("job_type", "status").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "failed") & (F.col("created_at") >= F.lit("2024-01-29").cast("timestamp"))).alias("recent_failures")), f"select job_type, status, count(*) as n, count(*) filter (where status = 'failed' and created_at >= timestamp '2024-01-29') as recent_failures from {JOBS} group by all")
simple("agg_consolidate", lambda s, d: correlation.consolidate(T.entities(s, d), T.order_files(s, d)).select("id", "entity_type", "normalized", "occurrence_count", "file_count", F.array_join("variants", ",").alias("variants")), f"select 'cent_' || substring(sha256(entity_type || ':' || normalized), 1, 12) as id, entity_type, normalized, count(*) as occurrence_count, count(distinct file_id) as file_count, string_agg(distinct value, ',' order by value) as variants from {ENTITIES} group by entity_type, normalized")
simple("agg_cooccurrence", lambda s, d: correlation.cooccurrence(T.entities(s, d)).groupBy("count").agg(F.count("*").alias("pairs")), f"select count, count(*) as pairs from {PAIRS} group by count")
simple("agg_expertise", lambda s, d: correlation.term_hits(T.chunks(s, d)).groupBy("domain").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"), F.countDistinct("term").alias("terms")), f"select domain, count(*) as hits, count(distinct file_id) as files, count(distinct term) as terms from {HITS} group by domain")
simple("agg_naming", lambda s, d: correlation.workflows(T.files(s, d), 1, 0.0).select("rule", "count", F.array_join("examples", ",").alias("examples")), f"select 'versioned' as rule, count(*) as count, array_to_string(list_sort(list(distinct filename))[1:5], ',') as examples from {FILES} where regexp_matches(filename, '(?i)v\\d+|_v\\d+|version')")
simple("agg_machine_index", lambda s, d: machines.index(T.machine_words(s, d)), f"select * from {INDEX}")
simple("agg_vector_stats", lambda s, d: T.table(s, d, "embeddings").rollup("label").agg(F.count("*").alias("n")), "select label, count(*) as n from embeddings group by rollup(label)")
simple("agg_file_dates", lambda s, d: T.files(s, d).groupBy("machine").agg(F.min("indexed_at").alias("a"), F.max("indexed_at").alias("b")).select("machine", F.unix_timestamp("a").alias("first_seen"), F.unix_timestamp("b").alias("last_seen")), f"select machine, (1704067200 + min(seconds))::bigint as first_seen, (1704067200 + max(seconds))::bigint as last_seen from {FILES} group by machine")
simple("agg_commands", lambda s, d: T.table(s, d, "conversations").groupBy(F.split("text", " ")[0].alias("command")).agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions")).orderBy(F.desc("n"), "command").limit(5), "select string_split(text, ' ')[1] as command, count(*) as n, count(distinct conv_id) as sessions from conversations group by 1 order by n desc, command limit 5")
simple("agg_merge_history", lambda s, d: T.jobs(s, d).orderBy(F.desc("created_at"), F.desc("job_id")).limit(20).select("job_id", "status"), f"select job_id, status from {JOBS} order by created_at desc, job_id desc limit 20")
simple("agg_graph_status", lambda s, d: correlation.consolidate(T.entities(s, d), T.order_files(s, d)).groupBy("entity_type").agg(F.count("*").alias("nodes")), f"select entity_type, count(distinct normalized) as nodes from {ENTITIES} group by entity_type")

# Windows
MINUTES = "(select date_trunc('hour', ts) as h, count(*) as n from events group by 1)"


def hourly(s: SparkSession, d: str) -> DataFrame:
    return T.jobs(s, d).groupBy(F.date_trunc("hour", "created_at").alias("h")).agg(F.count("*").alias("n"))


def in_time(df: DataFrame) -> DataFrame:
    """The whole series is one window: it has a row per hour, however many events there are."""
    return df.withColumn("t", F.unix_timestamp("h"))


def order():
    return Window.orderBy("t")


simple("win_velocity", lambda s, d: in_time(hourly(s, d)).select("t", F.round((F.col("n") - F.lag("n").over(order())) / (F.col("t") - F.lag("t").over(order())) * 60, 6).alias("rate")), f"select epoch(h)::bigint as t, round((n - lag(n) over (order by h)) / (epoch(h) - lag(epoch(h)) over (order by h)) * 60, 6) as rate from {MINUTES}")
simple("win_velocity_avg", lambda s, d: in_time(hourly(s, d)).select("t", F.round(F.avg("n").over(order().rowsBetween(-59, 0)), 6).alias("mean")), f"select epoch(h)::bigint as t, round(avg(n) over (order by h rows between 59 preceding and current row), 6) as mean from {MINUTES}")
simple("win_disk_rate", lambda s, d: in_time(hourly(s, d)).select("t", F.round((F.col("n") - F.lag("n").over(order())) / 1048576, 12).alias("mib")), f"select epoch(h)::bigint as t, round((n - lag(n) over (order by h)) / 1048576, 12) as mib from {MINUTES}")
simple("win_first_n", lambda s, d: T.messages(s, d).withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("sequence"))).filter("rn <= 5").select("conv_id", "sequence", "role"), "select conv_id, turn as sequence, case role when 'user' then 'human' else role end as role from conversations qualify row_number() over (partition by conv_id order by turn) <= 5")
simple("win_topk_per_group", lambda s, d: T.entities(s, d).groupBy("entity_type", "normalized").agg(F.count("*").alias("n")).withColumn("rk", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "normalized"))).filter("rk <= 5").select("entity_type", "normalized", "n"), f"select * from (select entity_type, normalized, count(*) as n from {ENTITIES} group by all) qualify row_number() over (partition by entity_type order by n desc, normalized) <= 5")
simple("win_current_job", lambda s, d: T.jobs(s, d).filter("status = 'running'").orderBy(F.desc("started_at"), F.desc("job_id")).limit(1).select("job_id", "job_type"), f"select job_id, job_type from {JOBS} where status = 'running' order by started_at desc, job_id desc limit 1")
DEDUP = "select doc_id, substring(sha256(text), 1, 16) as content_hash from documents qualify row_number() over (partition by sha256(text) order by source, doc_id) = 1"
simple("win_dedup_first", lambda s, d: machines.merge_chunks(T.chunks(s, d).join(T.files(s, d).select("file_id", "machine"), "file_id")).select(F.col("file_id").alias("doc_id"), "content_hash"), DEDUP)


# Sorts and top-k
simple("topk_pending", lambda s, d: T.files(s, d).filter("status = 'pending'").orderBy(F.desc("indexed_at"), "file_id").limit(10).select("file_id"), f"select file_id from {FILES} where status = 'pending' order by seconds desc, file_id limit 10")
simple("topk_jobs_recent", lambda s, d: T.jobs(s, d).orderBy(F.coalesce("completed_at", "started_at", "created_at").desc(), "job_id").limit(20).select("job_id"), f"select job_id from {JOBS} order by coalesce(completed_at, started_at, created_at) desc, job_id limit 20")
simple("topk_priority", lambda s, d: T.jobs(s, d).filter("status = 'pending'").orderBy("priority", "created_at", "job_id").limit(50).select("job_id", "priority"), f"select job_id, priority from {JOBS} where status = 'pending' order by priority, created_at, job_id limit 50")
simple("topk_related", lambda s, d: correlation.related(correlation.cooccurrence(T.entities(s, d)), "ORG:brand#11", 0.1).select("other", r6("strength")), f"select other, round(strength, 6) as strength from {RELATED} where key = 'ORG:brand#11' and strength >= 0.1::double order by strength desc, other limit 20")
simple("topk_topics", lambda s, d: machines.topics(machines.index(T.machine_words(s, d))).select("entity", "machines", "mention_count", r6("confidence")), f"select entity, count(*) as machines, sum(n)::bigint as mention_count, round(least(1.0::double, (count(*) / 3.0::double) * (sum(n) / 10.0::double)), 6) as confidence from {INDEX} group by entity having count(*) > 1 and least(1.0::double, (count(*) / 3.0::double) * (sum(n) / 10.0::double)) > 0.3::double order by least(1.0::double, (count(*) / 3.0::double) * (sum(n) / 10.0::double)) desc, sum(n) desc, entity limit 50")
simple("sort_messages", lambda s, d: T.messages(s, d).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("sequence").asc_nulls_first()))).select("conv_id", "at", "role"), "select conv_id, row_number() over (partition by conv_id order by turn nulls first)::int as at, case role when 'user' then 'human' else role end as role from conversations")

# Set operations
simple("set_shared", lambda s, d: T.machine_words(s, d).filter("machine = 'src0'").select("entity").intersect(T.machine_words(s, d).filter("machine = 'src1'").select("entity")), f"select entity from {WORDS} where machine = 'src0' intersect select entity from {WORDS} where machine = 'src1'")
simple("set_unique_to", lambda s, d: T.machine_words(s, d).filter("machine = 'src0'").select("entity").subtract(T.machine_words(s, d).filter("machine = 'src1'").select("entity")), f"select entity from {WORDS} where machine = 'src0' except select entity from {WORDS} where machine = 'src1'")
simple("set_only_here", lambda s, d: machines.index(T.machine_words(s, d)).groupBy("entity").agg(F.count("*").alias("m"), F.max("machine").alias("machine")).filter("m = 1").select("entity", "machine"), f"select entity, max(machine) as machine from {INDEX} group by entity having count(*) = 1")
simple("set_union_all_entities", lambda s, d: T.machine_words(s, d).select("entity").distinct().agg(F.count("*").alias("n")), f"select count(distinct entity) as n from {WORDS}")

# Scalar functions
simple("fn_generate_id", lambda s, d: T.table(s, d, "documents").select("doc_id", S.generate_id("file", F.col("text")).alias("id")), "select doc_id, 'file_' || substring(sha256(text), 1, 12) as id from documents")
simple("fn_hash_content", lambda s, d: T.table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.md5("text").alias("b"), F.sha1("text").alias("c")), "select doc_id, sha256(text) as a, md5(text) as b, sha1(text) as c from documents")
simple("fn_content_hash16", lambda s, d: T.table(s, d, "documents").select("doc_id", S.content_hash16(F.col("text")).alias("h")), "select doc_id, substring(sha256(text), 1, 16) as h from documents")
simple("fn_machine_id", lambda s, d: T.table(s, d, "supplier").select(S.machine_id(F.col("s_name")).alias("id")), "select s_name || '-' || substring(md5(s_name), 1, 8) as id from supplier")
simple("fn_token_estimate", lambda s, d: T.table(s, d, "documents").select("doc_id", S.token_estimate(F.col("n_chars")).alias("t")), "select doc_id, trunc(n_chars * 1.3::double)::int as t from documents")
simple("fn_norm_basic", lambda s, d: T.table(s, d, "conversations").select("conv_id", "turn", S.norm_basic(F.col("text")).alias("v")), f"select conv_id, turn, {NORM.format('text')} as v from conversations")
simple("fn_norm_canonical", lambda s, d: T.entities(s, d).select("value", "entity_type", S.norm_canonical(F.col("value"), F.col("entity_type")).alias("v")).distinct(), f"select distinct value, entity_type, regexp_replace({NORM.format('value')}, '[^a-z0-9\\s]', '', 'g') as v from {ENTITIES}")
simple("fn_context", lambda s, d: T.table(s, d, "documents").select("doc_id", S.context(F.col("text"), F.lit(60), F.lit(70)).alias("c")), "select doc_id, substring(text, 11, 110) as c from documents")
simple("fn_naming_rules", lambda s, d: T.files(s, d).select("file_id", *[F.col("filename").rlike(p).alias(n) for n, p in V.NAMING.items()]), f"select file_id, regexp_matches(filename, '\\d{{4}}[-_]?\\d{{2}}[-_]?\\d{{2}}') as date_prefix, regexp_matches(filename, '(?i)v\\d+|_v\\d+|version') as versioned, regexp_matches(filename, '(?i)draft|final|wip') as status_suffix, regexp_matches(filename, '^[A-Z]{{2,5}}[-_]') as project_prefix from {FILES}")
simple("fn_machine_of", lambda s, d: T.files(s, d).select("file_id", S.machine_of(F.col("path")).alias("machine")), f"select file_id, regexp_extract(path, '^\\[([^\\]]*)\\]', 1) as machine from {FILES}")
simple("fn_similarity", lambda s, d: T.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.similarity(F.col("l_discount")).alias("v")), "select l_orderkey, l_linenumber, round(1 - l_discount, 3) as v from lineitem")


# Text
RULE = "select doc_id as file_id, '{k}' as entity_type, i - 1 as position, v as value from (select doc_id, unnest(regexp_extract_all(text, '{p}')[1:{n}]) as v, generate_subscripts(regexp_extract_all(text, '{p}')[1:{n}], 1) as i from documents)"

# Correlation
simple("corr_cooccurrence", lambda s, d: correlation.cooccurrence(T.entities(s, d)).select("e1", "e2", "count", r6("strength")), f"select e1, e2, count, round(strength, 6) as strength from {PAIRS}")
simple("corr_strength", lambda s, d: correlation.cooccurrence(T.entities(s, d)).groupBy("count").agg(F.round(F.max("strength"), 6).alias("strength")), f"select count, round(max(strength), 6) as strength from {PAIRS} group by count")
simple("corr_related", lambda s, d: correlation.related(correlation.cooccurrence(T.entities(s, d)), "PERSON:supplier#000000001", 0.1).select("other", r6("strength")), f"select other, round(strength, 6) as strength from {RELATED} where key = 'PERSON:supplier#000000001' and strength >= 0.1::double order by strength desc, other limit 20")
simple("pat_expertise", lambda s, d: correlation.expertise(T.chunks(s, d)).select("id", "domain", "hits", "files", "terms", r6("confidence")), f"select 'exp_' || domain as id, domain, hits, files, terms, round(confidence, 6) as confidence from {EXPERTISE} where hits >= 5 and confidence >= 0.3::double")
simple("pat_relationship", lambda s, d: correlation.relationships(correlation.cooccurrence(T.entities(s, d)), 0.2).select("id", r6("confidence")), f"select 'rel_cent_' || substring(sha256(person), 1, 12) || '_cent_' || substring(sha256(other), 1, 12) as id, round(strength, 6) as confidence from (select *, case when e1 like 'PERSON:%' then e1 else e2 end as person, case when e1 like 'PERSON:%' then e2 else e1 end as other from {PAIRS}) where strength >= 0.2::double and person like 'PERSON:%' and (other like 'ORG:%' or other like 'PROJECT:%')")
simple("pat_workflow", lambda s, d: correlation.workflows(T.files(s, d)).select("id", "count", r6("confidence")), f"select 'wf_versioned' as id, count(*) as count, round(least(1.0::double, count(*) / 20.0::double), 6) as confidence from {FILES} where regexp_matches(filename, '(?i)v\\d+|_v\\d+|version') having count(*) >= 6")
simple("gpu_cooc", lambda s, d: correlation.all_pairs(T.entities(s, d)).select("e1", "e2", F.col("cooc").alias("count")), f"select a.key as e1, b.key as e2, count(*) as count from (select distinct file_id, key from {ENTITIES}) a join (select distinct file_id, key from {ENTITIES}) b using (file_id) where a.key < b.key group by all")
PMI = f"with e as (select distinct file_id, key from {ENTITIES}), n as (select count(distinct file_id)::double as f from e), one as (select key, count(*) as c from e group by key), two as (select a.key as e1, b.key as e2, count(*) as cooc from e a join e b using (file_id) where a.key < b.key group by all having count(*) >= 2) select e1, e2, cooc, round(greatest(-10.0::double, least(10.0::double, ln((cooc / f + 1e-10::double) / ((x.c / f) * (y.c / f) + 1e-10::double)))), 6) as pmi from two join one x on x.key = e1 join one y on y.key = e2, n where greatest(-10.0::double, least(10.0::double, ln((cooc / f + 1e-10::double) / ((x.c / f) * (y.c / f) + 1e-10::double)))) > 0.3::double"
simple("gpu_pmi", lambda s, d: correlation.pmi_pairs(T.entities(s, d), 0.3, n=None).select("e1", "e2", "cooc", r6("pmi")), PMI)
simple("gpu_patterns", lambda s, d: correlation.pmi_pairs(T.entities(s, d), 0.3).select("e1", "e2", "cooc"), f"select e1, e2, cooc from ({PMI.replace('round(greatest', 'greatest').replace(', 6) as pmi', ' as pmi').replace('10.0::double, ln(', '10.0::double, ln(')}) order by least(1.0::double, pmi / 5 * cooc / 10) desc, e1, e2 limit 100")

# Vectors


def first_vector(s: SparkSession, d: str) -> list[float]:
    return T.table(s, d, "embeddings").orderBy("vec_id").first()["embedding"]


simple("vec_query", lambda s, d: search.nearest(T.table(s, d, "embeddings"), first_vector(s, d)).select("vec_id", F.round("distance", 5).alias("distance")), f"select b.vec_id, round(1 - {COSINE}, 5) as distance from {FIRST} a, embeddings b order by 1 - {COSINE}, vec_id limit 10")
simple("vec_flat", lambda s, d: search.nearest(T.table(s, d, "embeddings"), first_vector(s, d), metric="l2").select("vec_id", F.round("distance", 5).alias("distance")), f"select b.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]) ** 2, 5) as distance from {FIRST} a, embeddings b order by list_distance(a.embedding::double[], b.embedding::double[]), vec_id limit 10")
simple("pred_vec_where", lambda s, d: search.nearest(T.table(s, d, "embeddings"), first_vector(s, d), where=F.col("label") == 3).select("vec_id", F.round("distance", 5).alias("distance")), f"select b.vec_id, round(1 - {COSINE}, 5) as distance from {FIRST} a, embeddings b where b.label = 3 order by 1 - {COSINE}, vec_id limit 10")
simple("pred_similarity", lambda s, d: search.nearest(T.table(s, d, "embeddings"), first_vector(s, d), 50).filter(F.col("distance") <= 0.7).select("vec_id"), f"select vec_id from (select b.vec_id, 1 - {COSINE} as dist from {FIRST} a, embeddings b order by dist, vec_id limit 50) where dist <= 0.7::double")

# Machines
simple("xm_collab", lambda s, d: machines.collaboration(machines.index(T.machine_words(s, d))).select("m1", "m2", "shared", "rows1", "rows2", "only1", "only2", r6("confidence")), f"with i as {INDEX}, c as (select machine, count(*) as c from i group by machine) select m1, m2, shared, rows1, rows2, x.c - shared as only1, y.c - shared as only2, round(least(1.0::double, shared / 20.0::double), 6) as confidence from (select a.machine as m1, b.machine as m2, count(*) as shared, sum(a.n)::bigint as rows1, sum(b.n)::bigint as rows2 from i a join i b using (entity) where a.machine < b.machine group by all having count(*) >= 5) join c x on x.machine = m1 join c y on y.machine = m2")
simple("join_machine_pairs", lambda s, d: machines.collaboration(machines.index(T.machine_words(s, d)), 1).select("m1", "m2", "shared"), f"with i as {INDEX} select a.machine as m1, b.machine as m2, count(*) as shared from i a join i b using (entity) where a.machine < b.machine group by all")
simple("xm_expertise", lambda s, d: machines.silos(machines.index(T.machine_words(s, d))).select("machine", "only_here", "entities", r6("confidence"), r6("uniqueness")), f"with i as {INDEX}, o as (select max(machine) as machine from i group by entity having count(*) = 1) select machine, count(*) as only_here, max(e) as entities, round(least(1.0::double, count(*) / 50.0::double), 6) as confidence, round(count(*) / max(e)::double, 6) as uniqueness from o join (select machine, count(*) as e from i group by machine) using (machine) group by machine having count(*) >= 10")

# Chunkers
simple("chunk_lines", lambda s, d: chunking.line_blocks(T.chunks(s, d), 10), "select doc_id as file_id, (i // 10)::int as chunk_index, array_to_string(string_split(text, chr(10))[i + 1:i + 10], chr(10)) as content from (select doc_id, text, unnest(generate_series(0, greatest(len(string_split(text, chr(10))) - 1, 0), 10)) as i from documents)")

# Extractors, models, streams in their batch form
simple("gpu_cluster", lambda s, d: models.cluster(T.table(s, d, "embeddings")))
NEAR = "list_distance(a.embedding::double[], b.embedding::double[]) <= 1.15::double"
simple("gpu_cluster_density", lambda s, d: density.dbscan(T.table(s, d, "embeddings"), 1.15), f"with recursive n as (select a.vec_id as u, b.vec_id as w from embeddings a join embeddings b on {NEAR}), c as (select u from n group by u having count(*) >= 5), l as (select n.u, n.w from n join c on c.u = n.u join c x on x.u = n.w), r as (select u, u as w from c union select r.u, l.w from r join l on l.u = r.w), k as (select u, min(w) as cluster from r group by u) select vec_id, coalesce(k.cluster, b.cluster, -1)::bigint as cluster, k.u is not null as core from embeddings left join k on k.u = vec_id left join (select n.u, min(k.cluster) as cluster from n join k on k.u = n.w group by n.u) b on b.u = vec_id")
simple("gpu_reduce", lambda s, d: models.reduce(T.table(s, d, "embeddings")).select("vec_id", F.round(F.abs(F.get("reduced", F.lit(0))), 4).alias("x")))
simple("gpu_reduce_manifold", lambda s, d: models.reduce(T.table(s, d, "embeddings"), algorithm="umap").select("vec_id", F.get("reduced", F.lit(0)).alias("x"), F.get("reduced", F.lit(1)).alias("y")))
simple("st_debounce", lambda s, d: streams.debounce_batch(T.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 43200.0).groupBy("user_id").agg(F.count("*").alias("accepted")), "with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts) as i from events), f as (select user_id, i, ts as last, true as hit from e where i = 1 union all select e.user_id, e.i, case when epoch(e.ts) - epoch(f.last) >= 43200 then e.ts else f.last end, epoch(e.ts) - epoch(f.last) >= 43200 from f join e on e.user_id = f.user_id and e.i = f.i + 1) select user_id, count(*) filter (where hit) as accepted from f group by user_id")
simple("st_rates", lambda s, d: streams.rates(T.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts")), "ts", "1 hour").select(F.unix_timestamp("start").alias("t"), "n"), "select floor(epoch(date_trunc('hour', ts)))::bigint as t, count(*) as n from events group by 1")
simple("st_upsert", lambda s, d: streams.latest(T.jobs(s, d).select("job_type", "job_id", "priority").filter("priority < 3"), T.jobs(s, d).select("job_type", "job_id", "priority"), ["job_type", "priority"], "job_id"), f"select job_type, max(job_id) as job_id, priority from {JOBS} group by job_type, priority")

# More reads, predicates and statistics
CONSOLIDATED = f"(select entity_type, normalized, count(*) as n from {ENTITIES} group by all)"


simple("pred_entities", lambda s, d: T.entities(s, d).groupBy("entity_type", "normalized").agg(F.count("*").alias("n")).filter("entity_type = 'ORG' and n >= 2").orderBy(F.desc("n"), "normalized").limit(50).select("normalized", "n"), f"select normalized, n from {CONSOLIDATED} where entity_type = 'ORG' and n >= 2 order by n desc, normalized limit 50")

# More sinks in their query form, functions, media
simple("fn_norm_sync", lambda s, d: T.table(s, d, "supplier").select("s_suppkey", F.lower("s_name").alias("v")), "select s_suppkey, lower(s_name) as v from supplier")
simple("fn_canonical_key", lambda s, d: T.entities(s, d).select("key").distinct(), f"select distinct key from {ENTITIES}")
simple("fn_title", lambda s, d: T.table(s, d, "part").select("p_partkey", S.title(F.lower("p_type")).alias("v")), "select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as v from part")
simple("fn_count_score", lambda s, d: T.table(s, d, "part").select("p_partkey", F.round(S.count_score(F.col("p_size")), 6).alias("v")), "select p_partkey, round(least(1.0::double, p_size / 10.0::double), 6) as v from part")
simple("fn_pmi_conf", lambda s, d: T.table(s, d, "part").select("p_partkey", F.round(S.pmi_confidence(F.col("p_size") / 10.0, F.col("p_size")), 6).alias("v")), "select p_partkey, round(least(1.0::double, (p_size / 10.0::double) / 5 * p_size / 10), 6) as v from part")
simple("fn_exif_date", lambda s, d: T.table(s, d, "orders").select("o_orderkey", F.unix_timestamp(S.exif_time(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))).alias("t")), "select o_orderkey, floor(epoch(o_orderdate))::bigint as t from orders")
simple("fn_year4", lambda s, d: T.table(s, d, "orders").select("o_orderkey", F.expr("try_cast(substring(cast(o_orderdate as string), 1, 4) as int)").alias("y")), "select o_orderkey, year(o_orderdate)::int as y from orders")
simple("set_extensions_union", lambda s, d: T.files(s, d).select("extension").distinct(), f"select distinct extension from {FILES}")
