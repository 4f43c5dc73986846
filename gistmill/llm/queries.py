"""The operators over their whole tables with production parameters, and SQL statements where SQL can say the same."""

from __future__ import annotations

import re
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gistmill.llm import block_dups, decontaminate, html_text, licences, near_dups, packing, phrases, pieces, quality, shards, suffix_dups, token_counts, vector_codes


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.digest(near_dups.near_duplicates(documents(spark, sf), size=4, percent=80))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf)).selectExpr(
        "id as doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.html_text(spark.read.parquet(f"{sf}/pages.parquet")).withColumnRenamed("id", "page_id")


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trips(documents(spark, sf), path).withColumnRenamed("id", "doc_id")


def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return shards.digest(shards.sharded(documents(spark, sf)))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return block_dups.digest(block_dups.earlier_passages(documents(spark, sf)))


def op8_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.digest(licences.licence_scan(documents(spark, sf), licences.known_digests(spark)))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = token_counts.token_counts(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return found.selectExpr("id as doc_id", "n_bytes", "n_tokens", "n_tokens > 512 as over_limit")


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dups.digest(suffix_dups.repeated_spans(documents(spark, sf)))


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.digest(*vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet")))


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json")))


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.phrases(documents(spark, sf))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_licence_scan": op8_licence_scan,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_packing": op12_packing,
    "op13_phrases": op13_phrases,
}

#: Words between ASCII white space, numbered from 1 in each text.
_WORDS = r"""
texts as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') as ws from documents),
words as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i, len(ws) as n from texts)
"""

_OP1 = r"""
with recursive lowered as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
),
texts as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> '') as ws from lowered),
shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) as i from texts where len(ws) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept
from (select a as doc_id, min(b) as component_id from reach group by a) left join sizes using (doc_id)
"""


def _covered(n: int) -> str:
    """Words of each text, and their characters, that lie in windows of n words found twice or more in it."""
    return f"""
grams{n} as (
  select doc_id, i, hash(string_agg(w, ' ') over (partition by doc_id order by i rows between current row and {n - 1} following)) as h, n - i >= {n - 1} as whole
  from words
),
twice{n} as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h) as c from grams{n} where whole) where c > 1),
cover{n} as (
  select doc_id, count(*) as words{n}, sum(length(w)) as chars{n}
  from (select distinct doc_id, i + k as i from twice{n}, range({n}) r(k)) join words using (doc_id, i) group by doc_id
)"""


_OP2 = f"""
with {_WORDS},
{", ".join(_covered(n) for n in (3, 5, 7, 10))},
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
grouped as (
  select doc_id, line, count(*) as c, length(regexp_replace(line, '[ \t\n\v\f\r]+', '', 'g')) as chars from lines
  where regexp_matches(line, '[^ \t\n\v\f\r]') group by doc_id, line
),
repeats as (select doc_id, sum(c - 1) as n_dup_lines, sum(case when c > 1 then c * chars else 0 end) as line_chars from grouped group by doc_id),
facts as (
  select doc_id, len(ws) as n_words, list_sum(list_transform(ws, lambda w: length(w))) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols
  from texts join documents using (doc_id)
),
counts as (
  select doc_id, n_words, coalesce(word_chars, 0) as word_chars, coalesce(n_symbols, 0) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(words3, 0) as n_repeat_words, coalesce(line_chars, 0) as line_chars, coalesce(chars5, 0) as chars5, coalesce(chars7, 0) as chars7, coalesce(chars10, 0) as chars10
  from facts left join repeats using (doc_id) left join cover3 using (doc_id) left join cover5 using (doc_id) left join cover7 using (doc_id) left join cover10 using (doc_id)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and line_chars / greatest(1, word_chars) <= 0.3::double and n_symbols <= 0.1::double * n_words
    and chars5 / greatest(1, word_chars) <= 0.4::double and chars7 / greatest(1, word_chars) <= 0.35::double and chars10 / greatest(1, word_chars) <= 0.3::double as kept
from counts
"""

_OP5 = r"""
with recursive lowered as (
  select 'd' as kind, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
),
texts as (select kind, id, list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from lowered),
windows as (
  select distinct id as item_id, least(10, len(ws)) as m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') as s
  from (select id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as i from texts where kind = 'b' and len(ws) > 0)
),
places as (
  select id as doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') as s
  from (select id, ws, unnest(range(1, len(ws) + 1)) as i from texts where kind = 'd'), (select distinct m from windows) where i + m - 1 <= len(ws)
),
hits as (select doc_id, i, m, item_id from places join windows using (m, s)),
hit_words as (select doc_id, count(distinct i + k) as n_hit from hits, range(10) r(k) where k < m group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts left join hit_words on id = hit_words.doc_id left join named on id = named.doc_id where kind = 'd'
"""

_OP6 = f"""
with rows as (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as hash, coalesce(octet_length(encode(text)), 0) as n_bytes from documents),
depths as (select unnest(range({shards.BITS + 1})) as depth),
fits as (select depth, hash >> ({shards.BITS} - depth) as prefix from rows, depths group by all having sum(n_bytes) <= {shards.LIMIT})
select doc_id, min_by(prefix, fits.depth)::bigint as shard, min(fits.depth)::integer as depth, 0::bigint as chain, any_value(n_bytes)::bigint as n_bytes
from rows join fits on fits.prefix = hash >> ({shards.BITS} - fits.depth) group by doc_id
"""

_OP7 = f"""
with {_WORDS},
windows as (
  select doc_id, i, hash(string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 12 following)) as h, n - i >= 12 as whole from words
),
later as (select doc_id, i from windows w join (select h, min(doc_id) as least from windows where whole group by h) using (h) where whole and doc_id > least),
gone as (select distinct doc_id, i + k as i from later, range(13) r(k)),
left_over as (
  select words.doc_id, count(gone.i) as n_removed, coalesce(string_agg(w, ' ' order by words.i) filter (gone.i is null), '') as kept
  from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join left_over using (doc_id)
"""

#: Hexadecimal text has one-byte characters, so its substrings are byte strings.
_OP10 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as hex, octet_length(encode(coalesce(text, ''))) as n_bytes from documents),
blocks as (select doc_id, 100 * k as a, substr(hex, 200 * k + 1, 598) as hex from (select doc_id, hex, unnest(range((n_bytes - 100) // 100)) as k from d)),
windows as (select doc_id, a + i as p, md5(substr(hex, 2 * i + 1, 400)) as h from blocks, range(100) r(i) where length(hex) >= 2 * i + 400),
repeats as (select doc_id, p from windows where h in (select h from windows group by h having count(*) > 1)),
edges as (select *, case when p > 200 + lag(p, 1, -999) over (partition by doc_id order by p) then 1 else 0 end as new from repeats),
runs as (select doc_id, sum(new) over (partition by doc_id order by p rows unbounded preceding) as run, p from edges),
spans as (select doc_id, run, min(p) as a, max(p) + 200 as b, lag(max(p) + 200, 1, 0) over (partition by doc_id order by run) as before from runs group by doc_id, run),
kept as (
  select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as tail, list([before, a] order by run) as pieces from spans group by doc_id
)
select d.doc_id, n_bytes::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when tail is null then hex else
    concat(list_aggregate(list_transform(pieces, lambda x: substr(hex, 2 * x[1] + 1, 2 * (x[2] - x[1]))), 'string_agg', ''), substr(hex, 2 * tail + 1)) end)) as kept_sha256
from d left join kept using (doc_id)
"""


def _op11(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Each round: distances of all parts to all entries, the nearest, then floors of the means."""
    far = "list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - c[k]) * (v[k] - c[k])))"
    floor = "(s - ((s % n) + n) % n) // n"
    out = f"""
with whole as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cells as (select vec_id, label, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] as v from whole, range({parts}) r(p)),
book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, v as c from cells where vec_id in (select vec_id from whole order by vec_id limit {entries})),"""
    for k in range(rounds + 1):
        out += f"""
near{k} as (select vec_id, label, p, v, min({far} * {entries} + e) as m from cells join book{k} using (p) group by all),"""
        if k < rounds:
            out += f"""
sums{k} as (select p, m % {entries} as e, generate_subscripts(v, 1) as i, unnest(v) as x from near{k}),
means{k} as (select p, e, list({floor} order by i) as c from (select p, e, i, sum(x) as s, count(*) as n from sums{k} group by all) group by p, e),
book{k + 1} as (select p, e, coalesce(means{k}.c::bigint[], book{k}.c) as c from book{k} left join means{k} using (p, e)),"""
    return out + f"""
coded as (select vec_id, any_value(label) as label, string_agg(printf('%02x', m % {entries}), '' order by p) as code, sum(m // {entries})::bigint as error from near{rounds} group by vec_id),
labels as (select label, sum(error)::bigint as label_error from coded group by label),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, label_error, codebooks_sha256 from coded join labels on coded.label is not distinct from labels.label, books
"""


_OP13 = r"""
with texts as (
  select coalesce(lang, 'und') as lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') as ps from documents
),
pieces as (select lang, list_filter(regexp_split_to_array(unnest(ps), '[ 	]+'), lambda w: w <> '') as ws from texts),
grams as (
  select lang, m, array_to_string(ws[i:i + m - 1], ' ') as g, count(*) as f
  from (select lang, ws, unnest(range(1, len(ws) + 1)) as i from pieces), range(1, 6) s(m) where i + m - 1 <= len(ws) group by all
),
totals as (select lang, sum(f)::hugeint as n from grams where m = 1 group by lang),
heavy as (select lang, m, g, f, string_split(g, ' ') as ws from grams where f >= 100),
longer as (select lang, array_to_string(ws[i:i + k - 1], ' ') as g, f from (select lang, ws, m, f, unnest(range(2, m)) as k from heavy), range(1, 5) r(i) where i + k - 1 <= m),
kept as (select h.* from heavy h where m >= 2 and not exists (select 1 from longer x where x.lang = h.lang and x.g = h.g and 100 * x.f >= 100 * h.f)),
cuts as (select lang, g, m, f as a, k, array_to_string(ws[1:k], ' ') as lg, array_to_string(ws[k + 1:], ' ') as rg from kept, range(1, 5) r(k) where k < m),
scores as (
  select c.lang, c.g, c.a, c.k, x.f as l, y.f as r, n, (1000 * c.a::hugeint * n) // (x.f::hugeint * y.f::hugeint) as score
  from cuts c join heavy x on x.lang = c.lang and x.g = c.lg join heavy y on y.lang = c.lang and y.g = c.rg join totals t on t.lang = c.lang
),
best as (select * from scores qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, g) as rank from best)
select lang, rank::bigint as rank, g as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


def _op8() -> str:
    """The canonical form step by step, in the same order, on documents and on known texts."""
    quoted = lambda x: x.replace("'", "''")
    marks = lambda x: re.sub(r"\$(\d)", r"\\\1", x)
    spelled = lambda col, some: reduce(lambda c, x: f"regexp_replace({c}, ' {x[0].replace(' ', '  ')} ', ' {marks(x[1]).replace(' ', '  ')} ', 'g')", some, col)
    lines = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lines = f"regexp_replace(regexp_replace(regexp_replace({lines}, '{licences.OWN_COPYRIGHT}', '', 'g'), '(?m){licences.COPYRIGHT_LINE}', '', 'g'), '{licences.PUNCTUATION}', '  ', 'g')"
    lines = f"regexp_replace(regexp_replace('  ' || replace({lines}, chr(10), '  ' || chr(10) || '  ') || '  ', '  +', '  ', 'g'), '([^ \\n]) ([^ \\n])', '\\1  \\2', 'g')"
    lines = spelled(lines, licences.SPELLINGS)
    whole = spelled("'  ' || trim(regexp_replace(lines, '[ \\n]+', '  ', 'g')) || '  '", [x for x in licences.SPELLINGS if " " in x[0] + x[1]])
    known = ", ".join(f"('{name}', '{quoted(text)}')" for name, text in licences.KNOWN + licences.whole_texts())
    form = lambda table, keys: f"select {keys}, lines, trim(regexp_replace({whole}, ' +', ' ', 'g')) as whole from (select {keys}, {lines} as lines from {table})"
    return f"""
with known as (select whole, min(licence) as licence from ({form(f"(values {known}) t(licence, text)", "licence")}) group by whole),
texts as ({form("documents", "doc_id")}),
found as (
  select doc_id, licence from (select doc_id, regexp_replace(trim(unnest(string_split(lines, chr(10)))), ' +', ' ', 'g') as line from texts) join known on line = known.whole
),
counted as (select doc_id, count(*) as licence_lines, string_agg(distinct licence, ',' order by licence) as line_licences from found group by doc_id)
select doc_id, md5(texts.whole) as digest, licence, coalesce(licence_lines, 0)::bigint as licence_lines, coalesce(line_licences, '') as line_licences
from texts left join known using (whole) left join counted using (doc_id)
"""


ORACLE = {
    "op1_minhash_near_dedup": _OP1,
    "op2_quality_rules": _OP2,
    "op5_decontamination": _OP5,
    "op6_sharding": _OP6,
    "op7_substring_dedup": _OP7,
    "op8_licence_scan": _op8(),
    "op10_suffix_dedup": _OP10,
    "op11_vector_codes": _op11(),
    "op13_phrases": _OP13,
}
