"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BENCHMARK_DECONTAMINATION = rf"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') w from documents
), item_words as (
  select item_id::varchar item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') w
  from benchmark
), wins as (
  select item, least(10, len(w)) size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') win
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from item_words where len(w) > 0)
), starts as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') win
  from (select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) i
        from doc_words, (select distinct size from wins))
), hits as (select distinct doc_id, i, wins.size, item from starts join wins using (win)),
covered as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + size)) j from hits) group by 1),
found as (select doc_id, list_sort(list(distinct item) filter (where item is not null)) items from hits group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(c.n, 0)::bigint n_hit, coalesce(len(f.items), 0)::bigint n_items,
  sha256(coalesce(array_to_string(f.items, ','), '')) items_sha256, c.n is not null contaminated
from doc_words d left join covered c using (doc_id) left join found f using (doc_id)
"""

_SPACED = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = rf"""
with rows as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') w from documents),
starts as (
  select r, i, md5(array_to_string(w[i : i + 34], ' ')) win
  from (select r, w, unnest(range(1, greatest(len(w) - 34, 0) + 1)) i from rows)
), gone as (
  select distinct r, unnest(range(i, i + 35)) j from starts
  where win in (select win from starts group by 1 having count(*) > 1)
), by_row as (select r, list(j) js from gone group by 1),
words as (select r, unnest(w) word, unnest(range(1, len(w) + 1)) j from rows),
kept as (
  select r, string_agg(word, ' ' order by j) k from words anti join gone using (r, j) group by 1
)
select doc_id, len(w)::bigint n_words, coalesce(len(js), 0)::bigint n_removed, sha256(coalesce(k, '')) kept_sha256
from rows left join by_row using (r) left join kept using (r)
"""

WARC = """
with paid as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x from pages),
last as (select h, max(page_id) m from paid group by 1)
select page_id, strlen(h)::bigint payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(x, (5 * (i // 4) + 1)::int, 5))::int) >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') payload_digest,
  case when page_id = m then 'response' else 'revisit' end record_type,
  case when page_id <> m then m end refers_to
from paid join last using (h)
"""

NGRAM_JACCARD_JOIN = rf"""
with recursive rows as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') w from documents
), grams as (
  select distinct r, array_to_string(w[i : i + 4], ' ') g
  from (select r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) i from rows)
), sets as (select r, doc_id, coalesce(s, '') s, coalesce(n, 0) n
  from rows left join (select r, md5(string_agg(g, chr(10) order by g)) s, count(*) n from grams group by 1) using (r)),
classes as (select s, min(doc_id) class_id, count(*) copies, min(r) rep, any_value(n) n from sets group by 1),
class_grams as (select s, n, g from classes join grams on rep = r),
pairs as (
  select a.s a, b.s b from class_grams a join class_grams b using (g) where a.s <> b.s
  group by 1, 2, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reach as (select a s, a t from pairs union select reach.s, pairs.b from reach join pairs on reach.t = pairs.a),
grouped as (select reach.s, min(class_id) group_id from reach join classes on classes.s = reach.t group by 1),
linked as (select a s, count(*) links from pairs group by 1)
select doc_id, class_id, copies, coalesce(links, 0)::bigint links, coalesce(group_id, class_id) group_id
from sets join classes using (s) left join linked using (s) left join grouped using (s)
"""

ORACLES = {
    "op2_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op6_benchmark_decontamination": BENCHMARK_DECONTAMINATION,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op8_warc": WARC,
}
