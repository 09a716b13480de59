"""What the queries return, as SQL for DuckDB, where SQL can state it."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

SOURCE_MIX = f"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::bigint as size,
           md5(concat('mix-1|', doc_id)) as digest
    from documents
), sources as (
    select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
    select *, ([3, 1, 2])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
           2.0::double * source_size as cap, sum(source_size) over () as total
    from sources
), levels as (
    select *, (1.5::double * total
               - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
              / (sum(weight) over ()
                 - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
    from weighed
), water as (
    select min_by(level, cap / weight) as level from levels where level <= cap / weight
), targets as (
    select source, source_size,
           case when l.level <= cap / weight then weight * water.level else cap end as target
    from levels l left join water on true
), placed as (
    select doc_id, size, source_size, target,
           case when source_size > 0 then floor(target / source_size) else 0 end as whole,
           coalesce(sum(size) over (partition by d.source order by digest rows between unbounded preceding and 1 preceding), 0) as before
    from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size::bigint as source_size, target,
       (whole * size + greatest(0, least(size, floor(target - whole * source_size - before + 0.5))))::bigint as taken
from placed
"""

NGRAM_JACCARD_JOIN = f"""
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) as w
    from documents
), sets as (
    select doc_id, list_distinct(case when len(w) = 0 then []
                                      when len(w) < 3 then [array_to_string(w, ' ')]
                                      else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
    from worded
), single as (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), common as (
    select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as common
    from single a join single b on a.shingle = b.shingle and a.doc_id < b.doc_id
    group by all
), links as (
    select a, b from common where 100 * common >= 90 * (na + nb - common)
), both_ways as (
    select a, b from links union all select b, a from links
), reach(origin, target) as (
    select a, b from both_ways
    union
    select reach.origin, both_ways.b from reach join both_ways on reach.target = both_ways.a
)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, (select min(target) from reach where origin = doc_id)) as component_id
from sets
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOTICES = " or ".join(
    f"contains(lower_line, '{phrase}')"
    for phrase in (
        "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
        "accept cookies", "accept all cookies", "uses cookies", "use cookies", "enable javascript", "subscribe to our", "click here",
    )
)

LINE_FIRST_QUALITY = rf"""
with texts as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 4], ' ') as five from texts, unnest(range(1, greatest(len(w) - 3, 1))) r(i)
), repeated as (
    select doc_id, i from (select *, count(*) over (partition by doc_id, five) as n from windows) c where n > 1
), covered as (
    select doc_id, count(distinct i + k) as n_repeat_words from repeated, range(0, 5) r(k) group by doc_id
), lines as (
    select doc_id, line, regexp_extract_all(line, {_WORD}) as w, {_LOWER.format('line')} as lower_line,
           length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as signs,
           length(line) - length(regexp_replace(line, '[A-Z]', '', 'g')) as capitals,
           length(line) - length(regexp_replace(line, '[a-z]', '', 'g')) as smalls
    from (select doc_id, unnest(string_split(t, chr(10))) as line from texts) l where regexp_matches(line, {_WORD})
), sized as (
    select *, list_sum(list_transform(w, lambda x: strlen(x)))::bigint as size,
           len(list_filter(w, lambda x: x in ('|', '›', '»', '•', '>', '/', '—', '–'))) as separators,
           len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) as same
    from lines
), judged as (
    select *, case
        when signs > 0.1::double * size then 'signs'
        when len(w) >= 4 and capitals > 0.6::double * (capitals + smalls) then 'shouting'
        when len(w) >= 4 and separators * 5 > len(w) then 'navigation'
        when {_NOTICES} then 'boilerplate'
        when len(w) >= 10 and same * 2 > len(w) then 'repetition'
        when len(w) >= 10 and not regexp_matches(line, '[.!?…。！？][)\]"''”’»]*(?:[\x20\x09-\x0D]|$)') then 'punctuation'
        end as rule
    from sized
), by_document as (
    select doc_id, count(*) as n_lines, count(rule) as n_failed_lines, count(*) - count(distinct line) as n_dup_lines,
           sum(size)::bigint as word_bytes, coalesce(sum(size) filter (rule is not null), 0)::bigint as lost_bytes,
           coalesce(sum(size) filter (rule = 'boilerplate'), 0)::bigint as notices
    from judged group by doc_id
), figures as (
    select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
           coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_failed_lines, 0) as n_failed_lines,
           coalesce(lost_bytes, 0)::bigint as lost_bytes, coalesce(word_bytes, 0)::bigint as word_bytes, coalesce(notices, 0) as notices,
           len(w) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(w) as base_failed
    from texts left join covered using (doc_id) left join by_document using (doc_id)
)
select * exclude (notices),
       not base_failed and lost_bytes < word_bytes and lost_bytes - notices <= 0.5::double * (word_bytes - notices) as kept
from figures
"""

LINE_RUNS = f"""
with split as (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as number
    from documents
), lines as (
    select doc_id, line, number, row_number() over (partition by doc_id order by number) as seq,
           least(len(regexp_extract_all(line, {_WORD})), 5) as words
    from split where regexp_matches(line, {_WORD})
), stretches as (
    select a.doc_id, a.seq, n.l, string_agg(b.line, chr(10) order by b.seq) as content, sum(b.words) as words,
           arg_min(b.words, b.seq) as first_words, arg_max(b.words, b.seq) as last_words
    from lines a, range(1, 6) n(l), lines b
    where b.doc_id = a.doc_id and b.seq >= a.seq and b.seq < a.seq + n.l
    group by a.doc_id, a.seq, n.l having count(*) = n.l
), later as (
    select doc_id, seq, l from (
        select *, row_number() over (partition by l, content order by doc_id, seq) as copy from stretches
        where words >= 5 and (words - first_words < 5 or words - last_words < 5)) s
    where copy > 1
), gone as (
    select distinct doc_id, seq + k as seq from later, range(0, 5) r(k) where k < l
), runs as (
    select doc_id, count(*) as n_removed, count(*) filter (seq <> before + 1 or before is null) as n_runs
    from (select *, lag(seq) over (partition by doc_id order by seq) as before from gone) g group by doc_id
), kept as (
    select s.doc_id, string_agg(s.line, chr(10) order by s.number) as text
    from split s left join lines using (doc_id, number)
    where (s.doc_id, coalesce(seq, -1)) not in (select doc_id, seq from gone) group by s.doc_id
)
select d.doc_id, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_runs, 0)::bigint as n_runs, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join runs r on r.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

# Bytes as pairs of hex digits: DuckDB cuts texts by characters only.
SUFFIX_LEVELS = """
with raw as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n_bytes from documents
), starts as (
    select doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) as digest
    from raw, unnest(range(0, greatest(n_bytes - 199, 0))) r(i)
), twice as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by digest) as n from starts) c where n > 1
), numbered as (
    select doc_id, i, sum(case when i <= before + 200 then 0 else 1 end) over (partition by doc_id order by i) as span
    from (select *, lag(i) over (partition by doc_id order by i) as before from twice) t
), spans as (
    select doc_id, span, min(i) as first, max(i) + 200 as past from numbered group by doc_id, span
), pieces as (
    select doc_id, first, coalesce(lag(past) over (partition by doc_id order by first), 0) as since from spans
), kept as (
    select p.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' order by first)
                     || any_value(substr(h, 2 * ends.past + 1)) as h
    from pieces p join raw r on r.doc_id = p.doc_id join (select doc_id, max(past) as past from spans group by doc_id) ends on ends.doc_id = p.doc_id
    group by p.doc_id
), sums as (
    select doc_id, sum(past - first)::bigint as n_removed, count(*) as n_spans from spans group by doc_id
)
select r.doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(k.h, r.h))) as kept_sha256
from raw r left join sums s on s.doc_id = r.doc_id left join kept k on k.doc_id = r.doc_id
"""

HARD_NEGATIVES = """
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from usable a join usable b on a.vec_id <> b.vec_id
    where a.vec_id % 50 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id,
       (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not same
     and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

RANKED_SEARCH = """
with words as (
    select row_number() over () as row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from documents
), totals as (
    select count(*)::hugeint as docs, sum(len(w))::hugeint as terms from words where len(w) > 0
), counted as (
    select row, doc_id, len(w) as n, term, count(*)::bigint as tf
    from (select row, doc_id, w, unnest(w) as term from words) t
    group by all
), weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
    from counted, totals group by term, docs
), asked as (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
    from benchmark
), wanted as (
    select item_id, term, count(*)::bigint as times from asked group by all
), scored as (
    select item_id, row, doc_id,
           sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms)::bigint))))::bigint as score
    from counted join wanted using (term) join weights using (term), totals
    group by item_id, row, doc_id
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 20
"""

STATEMENTS: dict[str, str] = {
    "op1_line_first_quality": LINE_FIRST_QUALITY,
    "op4_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
    "op6_source_mix": SOURCE_MIX,
    "op7_line_runs": LINE_RUNS,
    "op8_suffix_levels": SUFFIX_LEVELS,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_ranked_search": RANKED_SEARCH,
}
