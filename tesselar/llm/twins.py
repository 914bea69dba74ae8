"""DuckDB SQL for the queries that SQL expresses."""

REACH = """
, both_ways as (select a, b from links union all select b, a from links),
reach(id, root) as (select a, a from both_ways union select r.id, l.b from reach r join both_ways l on l.a = r.root),
least as (select id, min(root) as component_id from reach group by id)
"""

OP3 = (
    r"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), shingles as (
    select distinct doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3) t
    union all
    select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and 2
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), shared as (
    select x.doc_id as a, y.doc_id as b, count(*) as k
    from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id
    group by 1, 2
), links as (
    select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 90 * (p.n + q.n - k)
)"""
    + REACH
    + """
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, w.doc_id) as component_id
from words w left join sizes s on s.doc_id = w.doc_id left join least l on l.id = w.doc_id
"""
)

OP7 = (
    """
with recursive v as (
    select vec_id, label, cast(embedding as double[]) as e
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
    where list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e) * list_inner_product(y.e, y.e)) >= 0.98
)"""
    + REACH
    + """
, counts as (select a as id, count(*) as n from both_ways group by a)
select t.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component_id, t.vec_id) as component_id,
       coalesce(component_id, t.vec_id) = t.vec_id as kept
from embeddings t left join counts c on c.id = t.vec_id left join least l on l.id = t.vec_id
"""
)

OP10 = r"""
with words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
    select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35) t
), again as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by s) as c from windows) t where c > 1
), gone as (
    select distinct doc_id, i + k as p from again, (select unnest(range(0, 35)) as k) r
), placed as (
    select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words
), kept as (
    select x.doc_id, count(*) as n, string_agg(word, ' ' order by x.p) as t
    from placed x left join gone g on g.doc_id = x.doc_id and g.p = x.p where g.p is null group by x.doc_id
)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words w left join kept k on k.doc_id = w.doc_id
"""

OP11 = r"""
with t as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), words as materialized (
    select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t
), placed as materialized (
    select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words
), sums as (
    select rid, count(*) as n, sum(length(word)) as chars, count(*) filter (regexp_matches(word, '\pL')) as letters, count(distinct word) as n_distinct from placed group by rid
), windows as (
    select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c
    from (select rid, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3) x
), repeated as (
    select rid, count(distinct i + k) as n from (select rid, i from windows where c > 1) x, (select unnest([0, 1, 2]) as k) y group by rid
), lines as (
    select rid, count(*) as n, count(distinct line) as n_once, count(*) filter (regexp_matches(line, '^\s*([-*+]|\x{2022})\s')) as bullets,
           count(*) filter (regexp_matches(line, '(\.\.\.|\x{2026})\s*$')) as ellipses
    from (select rid, unnest(string_split(text, chr(10))) as line from t) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid
), base as (
    select t.rid, doc_id, coalesce(s.n, 0) as n_words, coalesce(s.chars, 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
           coalesce(l.n - l.n_once, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, coalesce(letters, 0) as letters, coalesce(n_distinct, 0) as n_distinct,
           length(text) - length(regexp_replace(text, '[{}]', '', 'g')) as braces, coalesce(l.n, 0) as n_lines, coalesce(bullets, 0) as bullets, coalesce(ellipses, 0) as ellipses
    from t left join sums s on s.rid = t.rid left join repeated r on r.rid = t.rid left join lines l on l.rid = t.rid
), failed as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and word_chars between 2 * n_words and 15 * n_words and 10 * n_symbols <= n_words and 10 * n_dup_lines <= 3 * n_lines
       and 10 * bullets <= 9 * n_lines and 10 * ellipses <= 3 * n_lines and 20 * braces <= n_words and 10 * letters >= 7 * n_words
       and 20 * n_distinct >= least(n_words, 1000) as kept
from failed
"""

#: Every state of the pattern (0 nothing, 1 system, 2 user, 3 assistant) after every turn, with its least (cost, edits).
OP12 = r"""
with recursive poly as materialized (
    select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
), coded as (
    select c.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as f
    from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations) c, poly
), names as materialized (
    select conv_id, row_number() over () as k from (select distinct conv_id from conversations) x
), after as (
    select k, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(case f when 0 then [] when 3 then [1, 2] else [1] end) as copy
    from coded join names on names.conv_id is not distinct from coded.conv_id
), placed as materialized (
    select *, row_number() over (partition by k order by turn nulls first, role, text, copy) as p from after
), marked as materialized (
    select *, regexp_extract(text, '[^\x20\x09-\x0D]([\x20\x09-\x0D]*)$') = '' as blank, row_number() over (partition by k, role, text order by p) > 1 as seen,
           not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open, left(role, 1) as initial, lead(left(role, 1)) over (partition by k order by p) as following
    from placed
), ins(q, r, c, e, l) as (
    values (0, 0, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
           (1, 1, 0, '', ''), (1, 2, 5, 'I', chr(10) || 'user:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
           (2, 2, 0, '', ''), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', chr(10) || 'user:')
), step(r, e, s, c, initial) as (
    values (0, 'D', 0, 2, null), (1, 'D', 1, 2, null), (2, 'D', 2, 2, null), (3, 'D', 3, 2, null), (0, 'R', 2, 1, null), (1, 'R', 2, 1, null), (2, 'R', 3, 1, null), (3, 'R', 2, 1, null),
           (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a')
), state(k, p, q, best) as (
    select k, cast(0 as bigint), 0, {'c': cast(0 as bigint), 'e': '', 'l': ''} from names
    union all
    select m.k, m.p, step.s, min({
        'c': cast(state.best.c + ins.c + step.c + case when step.e <> 'D' and m.open then 5 else 0 end as bigint), 'e': state.best.e || ins.e || step.e,
        'l': state.best.l || ins.l || case step.e when 'D' then '' when 'K' then chr(10) || m.role || ':' || m.text else chr(10) || case step.s when 2 then 'user:' else 'assistant:' end || m.text end})
    from state join marked m on m.k = state.k and m.p = state.p + 1 join ins on ins.q = state.q
         join step on step.r = ins.r and (step.e = 'D' or not (m.blank or m.seen)) and (step.e <> 'K' or step.initial = m.initial)
    group by m.k, m.p, step.s
), lasts as (
    select k, max(p) as p from state group by k
), done as (
    select s.k, min({'c': s.best.c + ins.c, 'e': s.best.e || ins.e, 'l': s.best.l || ins.l}) as best
    from state s join lasts using (k, p) join ins on ins.q = s.q where ins.r in (0, 3) group by s.k
), counts as (
    select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (not blank and seen) as duplicate,
           count(*) filter (not blank and not seen and open) as truncated, count(*) filter (following is not null and initial || following not in ('su', 'ua', 'au')) as illegal
    from marked group by k
)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(best.c as bigint) as cost, best.e as audit, sha256(substr(best.l, 2)) as repaired_sha256
from names join done using (k) left join counts using (k)
"""
