"""DuckDB SQL for the tables of sources/standins.py, and expressions that several queries share."""

from __future__ import annotations

from ..functions import vocabulary as V

#: The derived tables of sources/standins.py once more, as SQL.
FILES = "(select doc_id as file_id, '[' || source || '] ' || doc_id as path, source || '_v' || (doc_id % 7) || '.' || lang as filename, lang as extension, n_chars as size_bytes, case when doc_id % 10 = 0 then 'pending' when doc_id % 10 = 1 then 'failed' else 'indexed' end as status, doc_id as seconds, source as machine from documents)"
ENTITIES = "(select l_orderkey as file_id, k as entity_type, v as value, lower(v) as normalized, k || ':' || lower(v) as key, o_orderdate as indexed_at from (select l_orderkey, o_orderdate, unnest(['PERSON', 'ORG', 'PROJECT']) as k, unnest([s_name, p_brand, p_type]) as v from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey))"
JOBS = "(select event_id as job_id, event_type as job_type, case event_id % 7 when 0 then 'failed' when 1 then 'pending' when 2 then 'running' else 'completed' end as status, event_id % 5 + 1 as priority, ts as created_at, case when event_id % 7 <> 1 then ts end as started_at, case when event_id % 7 not in (1, 2) then ts + to_seconds(event_id % 90) end as completed_at from events)"
WORDS = "(select source as machine, w as entity from (select source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as w from documents) where length(w) >= 10)"
INDEX = f"(select entity, machine, count(*) as n from {WORDS} group by all)"
RANKED = f"(select *, row_number() over (partition by file_id order by key) - 1 as i, count(*) over (partition by file_id) as n from (select distinct file_id, key from {ENTITIES}))"
PAIRS = f"(select e1, e2, c as count, 0.6::double * least(1.0::double, c / 10.0::double) + 0.4::double * least(1.0::double, c / 5.0::double) as strength from (select a.key as e1, b.key as e2, count(*) as c from {RANKED} a join {RANKED} b using (file_id) where a.i < b.i and a.i * (a.n - 1) - a.i * (a.i - 1) / 2 + b.i - a.i - 1 < 500 group by all))"
TECH = "(select doc_id as file_id, w as normalized from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) as w from documents) where w in (" + ", ".join(f"'{t.lower()}'" for t in V.TECH_TERMS) + "))"
TERMS = "(values " + ", ".join(f"('{d}', '{t}')" for d, ts in V.DOMAINS.items() for t in ts) + ") v(domain, term)"
HITS = f"(select doc_id as file_id, domain, term from documents join {TERMS} on contains(lower(text), term))"
SIZES = "case domain " + " ".join(f"when '{d}' then {len(t)}" for d, t in V.DOMAINS.items()) + " end"
EXPERTISE = f"(select *, 0.4::double * least(1.0::double, log10(hits + 1) / 2) + 0.3::double * least(1.0::double, files / 10.0::double) + 0.3::double * (terms / ({SIZES})::double) as confidence from (select domain, count(*) as hits, count(distinct file_id) as files, count(distinct term) as terms from {HITS} group by domain))"
RELATED = f"(select e1 as key, e2 as other, strength from {PAIRS} union all select e2, e1, strength from {PAIRS})"
COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
NORM = "regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '^the ', ''), '^a ', ''), '^an ', '')"
FIRST = "(select embedding from embeddings where vec_id = (select min(vec_id) from embeddings))"
DISCOVERED = f"(select 'disc_' || substring(sha256('expertise_' || domain), 1, 12) as id, domain as title, confidence from {EXPERTISE} where hits >= 5 and confidence >= 0.3::double)"
