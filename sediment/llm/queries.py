"""The registered queries of this subpackage, and DuckDB SQL where SQL can say the same.

Beside the thirteen whole queries stand the columns of three of them that SQL can say: they run the same operators.
"""

from __future__ import annotations

from . import dedup, divergence, fill_middle, language_model, licenses, mixing, packing, quality, secrets, toxicity, vectors, warc
from .common import LOWER, UPPER


def base_of(query, *columns):
    return lambda spark, sf_dir: query(spark, sf_dir).selectExpr(*columns)


QUERIES = {
    "op1_minhash_dedup": dedup.op1_minhash_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_embedding_dedup": vectors.op3_embedding_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_lm_score": language_model.op5_lm_score,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_top_products": vectors.op7_top_products,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit": packing.op9_best_fit,
    "op10_warc": warc.op10_warc,
    "op11_quality_rules": quality.op11_quality_rules,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_fill_middle": fill_middle.op13_fill_middle,
    "license_base_columns": base_of(licenses.op2_license_scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "lm_base_columns": base_of(language_model.op5_lm_score, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) as base_score"),
    "secret_base_columns": base_of(secrets.op6_secret_scan, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
}

FINE = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
PLACES = ", ".join(f"list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()}) as p{k}" for k, p in enumerate(licenses.BASE))
LABEL = ", ".join(f"case when len(p{k}) > 0 then '{v}' end" for k, v in enumerate(licenses.BASE.values()))
# the CRC-32 of a short text, byte by byte
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(i, ''), lambda c: ord(c)::bigint)), lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end))), 4294967295::bigint)"
TOKENS = f"(select doc_id, {CRC} % 10 = 0 as held_out, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> ''), null) as ts from (select *, doc_id::varchar as i from documents))"


def spans(kind: str, pattern: str, keep: str = "true") -> str:
    """The matches of one kind as structs of start, kind and end; g is a match's second group."""
    p = pattern.replace("'", "''")
    group = "regexp_extract_all(t, '{}', 2)".format(p) if kind == "assign" else "ms"
    return f"(select doc_id, list_filter(list_transform(range(1, len(ms) + 1), lambda k: {{'start': coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0)::bigint, 'kind': {secrets.KINDS.index(kind)}, 'size': length(ms[k])::bigint, 'g': vs[k]}}), lambda m: {keep}) as found from (select doc_id, regexp_extract_all(t, '{p}') as ms, regexp_split_to_array(t, '{p}') as gs, {group} as vs from (select doc_id, coalesce(text, '') as t from documents)))"


ALL_SPANS = " union all ".join(f"select doc_id, unnest(found, recursive := true) from {x}" for x in (spans("assign", secrets.ASSIGN, f"length(m.g) >= {secrets.MIN_VALUE}"), spans("access", secrets.ACCESS), spans("hex", secrets.HEX)))
DIGEST = " || ".join(f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring(sha1(h), {5 * g + 1}, 5))::bigint >> {s}) & 31)::int + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))

# op11: measures of a text, cells of a sketch, quartiles and bounds, all in whole numbers.
REPEATED = f"(select k, count(distinct j) as r from (select k, unnest(range(i, i + {quality.WINDOW})) as j from (select k, i from (select k, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') as g from (select k, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) as i from w)) qualify count(*) over (partition by k, g) > 1)) group by k)"
VALUES = " union all ".join(f"select lang, source, '{name}' as rule, case when {over} > 0 then (1000 * {of}) // {over} end as v from m" for name, of, over, _, _ in quality.RULES)
MARGIN = "case rule " + " ".join(f"when '{r[0]}' then {r[4]}" for r in quality.RULES if r[4]) + " else q2 // 2 end"
LEAST_OF = "case when c < 64 then c else (c - 32 * (c // 32 - 1)) << (c // 32 - 1) end"


def limits(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    quarters = ", ".join(f"min({LEAST_OF}) filter (where 4 * s >= {q} * t) as q{q}" for q in (1, 2, 3))
    return f"(select *, q1 - far as low, q3 + far as high from (select *, greatest({MARGIN}, {quality.SPREAD} * (q3 - q1)) as far from (select {by}rule, max(t) as docs, {quarters} from (select *, sum(n) over (partition by {by}rule order by c) as s, sum(n) over (partition by {by}rule) as t from (select {by}rule, c, sum(n) as n from cells group by {by}rule, c)) group by {by}rule)))"


CHOSEN = ", ".join(f"case when o.docs >= {quality.LEAST_DOCS} then o.{s} when l.docs >= {quality.LEAST_DOCS} then l.{s} else a.{s} end as {s}" for s in ("low", "high"))
FAILS = ", ".join(f"case when " + " or ".join(f"(1000 * {of}) // {over} {'<' if s == 'low' else '>'} b['{name}'].{s}" for s in sides) + f" then '{name}' end" for name, of, over, sides, _ in quality.RULES)

# op12: dense sums over all kept terms.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SHARE = f"(1 + ({divergence.SCALE}::hugeint * ({{c}} + 1)) // {{n}})"
APART = "(({p} - {q}) * ({p} - {q})) // {q}"

# op13: a text's units, its draws, and its three parts.
DRAWS = ", ".join(f"('0x' || substring(sha256('1:' || coalesce(doc_id::varchar, '')), {8 * k + 1}, 8))::bigint as h{k + 1}" for k in range(4))

ORACLES: dict[str, str] = {
    "op13_fill_middle": f"with u as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as ts, {DRAWS} from documents), c as (select *, len(ts) as n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) as a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u), p as (select *, array_to_string(ts[1:a], '') as prefix, array_to_string(ts[a + 1:b], '') as middle, array_to_string(ts[b + 1:n], '') as suffix from c) select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars, sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p",
    "op11_quality_rules": f"with w as (select row_number() over () as k, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from documents), m as (select k, doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r, 0) as n_repeat_words, len(ls) as n_lines from w left join {REPEATED} using (k)), cells as (select lang, source, rule, case when v < 64 then v else 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) end as c, count(*) as n from ({VALUES}) where v is not null group by all), chosen as (select lang, source, map_from_entries(list((rule, {{'low': low, 'high': high}}))) as b from (select o.lang, o.source, o.rule, {CHOSEN} from {limits('lang, source')} o join {limits('lang')} l on l.lang = o.lang and l.rule = o.rule join {limits('')} a on a.rule = o.rule) group by lang, source), f as (select *, n_words < {quality.LEAST_WORDS} or 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words as base_failed, list_filter([{FAILS}], lambda x: x is not null) as failed from m left join chosen using (lang, source)) select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed) = 0 as kept, array_to_string(failed, ',') as failed_rules from f",
    "op12_source_divergence": f"with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as ts from documents), t as (select k, lang, source, unnest(ts) as term from d), v as (select lang, term from t group by all having count(distinct k) >= {divergence.LEAST_DOCS}), g as (select distinct lang, source from d), c as (select lang, source, term, coalesce(n, 0) as n from g join v using (lang) left join (select lang, source, term, count(*) as n from t group by all) using (lang, source, term)), s as (select lang, source, term, n, {SHARE.format(c='n', n='sum(n + 1) over (partition by lang, source)')} as p, {SHARE.format(c='sum(n) over (partition by lang, term)', n='(sum(n) over (partition by lang) + (select count(*) from v where v.lang = c.lang))')} as q from c), pairs as (select a.lang, a.source, b.source as item, sum({APART.format(p='a.p', q='b.p')}) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value, row_number() over (partition by lang, source order by coalesce(value, 0) desc, item)::int as rank from (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source) left join pairs using (lang, source, item) union all select lang, source, 'term', term, {APART.format(p='p', q='q')}::bigint as value, row_number() over (partition by lang, source order by {APART.format(p='p', q='q')} desc, term)::int as rank from s where n > 0 and p > q qualify rank <= {divergence.MOST_TERMS}",
    "op3_embedding_dedup": f"with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where {FINE} and label is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0), l as (select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93::double), r as (select vec_id as u, vec_id as w from embeddings union select r.u, l.w from r join l on l.u = r.w), n as (select u, count(*) as n from l group by u) select vec_id, coalesce(n.n, 0) as n_links, c as component_id, vec_id = c as kept from embeddings join (select u, min(w) as c from r group by u) x on x.u = vec_id left join n on n.u = vec_id",
    "op7_top_products": f"with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings where vec_id is not null and {FINE}) select a.vec_id as query_id, row_number() over (partition by a.vec_id order by list_inner_product(a.x, b.x) desc, b.vec_id)::int as rank, b.vec_id, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 50 = 0 qualify rank <= 5",
    "op10_warc": f"select page_id, strlen(h) as payload_bytes, {DIGEST} as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from (select page_id, coalesce(html, '') as h, max(page_id) over (partition by coalesce(html, '')) as last from pages)",
    "license_base_columns": f"select doc_id, len(w) as n_words, len(p) as n_base, list_min(p) as first_word, list_max(p) as last_word, array_to_string(list_sort(list_filter([{LABEL}], lambda x: x is not null)), ',') as base_labels from (select *, p0 || p1 || p2 || p3 as p from (select doc_id, w, {PLACES} from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents)))",
    "lm_base_columns": f"with d as {TOKENS}, t as (select unnest(ts) as w from d where not held_out), c as (select coalesce(w, chr(0)) as w, count(*) as c from t group by 1), n as (select coalesce(sum(c), 0) as n, count(*) as v from c), o as (select row_number() over () as k, * from d), u as (select k, coalesce(w, chr(0)) as w from (select k, unnest(ts) as w from o)) select doc_id, held_out, s.n_tokens, s.n_known, n.n::bigint as train_tokens, s.base_score from o join (select k, count(*) as n_tokens, count(c.c) as n_known, round(sum(log10((coalesce(c.c, 0) + 0.1::double) / (n.n + 0.1::double * (n.v + 1)))), 4) as base_score from u left join c using (w), n group by k) s using (k), n",
    "secret_base_columns": f"with s as ({ALL_SPANS}) select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(line, '')) as base_sha256 from documents left join (select doc_id, count(*) filter (where kind = 0) as a, count(*) filter (where kind = 1) as b, count(*) filter (where kind = 2) as c, string_agg(case kind when 0 then 'assign' when 1 then 'access' else 'hex' end || ':' || start || ':' || (start + size), ',' order by start, kind) as line from s group by doc_id) using (doc_id)",
}
