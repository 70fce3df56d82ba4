"""DuckDB twins of the registered queries, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

WORD = "[^\\x20\\x09-\\x0D]+"

ORACLE["op3_source_mixing"] = f"""
with sizes as (
  select doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents
), totals as (
  select source, sum(size) as source_size from sizes group by source
), weighted as (
  select source, source_size, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from totals
), ranked as (
  select *, 2 * source_size / weight as full_level,
    (1.5 * sum(source_size) over ()
      - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 2 * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from weighted
), goal as (
  select source, source_size, least(2.0 * source_size, weight * (select arg_min(level, full_level) filter (where level <= full_level) from ranked)) as target from ranked
), drawn as (
  select d.doc_id, d.source, d.size, g.source_size::bigint as source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
    length(bin(d.size)) * 8 + ((d.size * 8) >> length(bin(d.size))) as size_class,
    ('0x' || substr(md5('7:' || coalesce(d.doc_id::varchar, d.text, '')), 1, 15))::bigint as draw,
    ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 15))::bigint::double / 1152921504606846976.0 as u
  from sizes d join goal g on d.source is not distinct from g.source
), placed as (
  select *, rate - floor(rate) as fraction,
    rank() over (partition by source, size_class order by draw) as place,
    count(*) over (partition by source, size_class) as n,
    count(*) over (partition by source order by size_class range between unbounded preceding and current row) as c
  from drawn
)
select doc_id, size::bigint as size, source_size, target,
  (size * (floor(rate) + case when place <= floor(c * fraction + u) - floor((c - n) * fraction + u) then 1 else 0 end))::bigint as taken
from placed
"""

ORACLE["op9_line_dedup"] = f"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as parts from documents
), lines as (
  select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as line_no from split
), sets as (
  select doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '{WORD}'))) as words,
    row_number() over (order by doc_id, line_no) as place from lines
), firsts as (
  select words, min(place) as place, len(words) as n from sets where len(words) > 0 group by words
), tokens as (
  select place, n, unnest(words) as word from firsts
), similar_sets as (
  select y.place from tokens x join tokens y on x.word = y.word and x.place < y.place and 4 * x.n <= 5 * y.n and 4 * y.n <= 5 * x.n
  group by x.place, y.place, x.n, y.n having 9 * count(*) >= 4 * (x.n + y.n)
), kept as (
  select doc_id, line_no from sets
  where len(words) = 0 or place in (select place from firsts where place not in (select place from similar_sets))
), joined as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.line_no) as text
  from lines l join kept k on l.doc_id = k.doc_id and l.line_no = k.line_no group by l.doc_id
)
select s.doc_id, case when s.text is null then null else coalesce(j.text, '') end as text,
  (case when s.text is null then null else length(coalesce(j.text, '')) end)::bigint as n_kept_chars
from split s left join joined j on s.doc_id = j.doc_id
"""

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op13_ranked_search"] = f"""
with docs as (
  select row_number() over () as row_no, doc_id, regexp_extract_all({LOWER.format("text")}, '{TERM}') as terms from documents
), counted as (
  select row_no, doc_id, terms, len(terms) as n from docs where len(terms) > 0
), corpus as (
  select count(*) as n_docs, sum(n)::bigint as n_terms from counted
), tf as (
  select row_no, term, count(*) as tf from (select row_no, unnest(terms) as term from counted) group by row_no, term
), asked as (
  select row_number() over () as query, item_id, regexp_extract_all({LOWER.format("text")}, '{TERM}') as terms from benchmark
), wanted as (
  select query, term, count(*) as times from (select query, unnest(terms) as term from asked) group by query, term
), df as (
  select term, count(*) as df from tf where term in (select term from wanted) group by term
), weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from df, corpus
), scores as (
  select wanted.query, tf.row_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from wanted join weights using (term) join tf using (term) join counted using (row_no), corpus group by wanted.query, tf.row_no
), placed as (
  select query, doc_id, score, row_number() over (partition by query order by score desc, doc_id nulls last) as rank
  from scores join docs using (row_no) where score > 0
)
select item_id, rank::int as rank, doc_id, score from placed join asked using (query) where rank <= 20
"""
