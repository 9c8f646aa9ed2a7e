"""SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

_SETS = rf"""
texts as (
  select distinct row_index, m.content as content from (select row_index, unnest(chosen) as m from dataset union all select row_index, unnest(rejected) as m from dataset)),
w as (select row_index, {_WORDS.format('content')} as w from texts where content is not null),
runs as (select distinct row_index, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from w where len(w) >= 3),
sizes as (select row_index, count(*) as n from runs group by all),
pairs as (select a.row_index as x, b.row_index as y, count(*) as k from runs a join runs b on a.run = b.run and a.row_index < b.row_index group by all),
near as (select x, y from pairs join sizes a on a.row_index = x join sizes b on b.row_index = y where 2 * k >= a.n + b.n - k)
"""

_COVERED = rf"""
latest as (select distinct on (response_id) response_id, bias_type, dataset_type, sft_response, dpo_response from responses where response_id is not null order by response_id, ingested_at desc),
sides as (select response_id, 'sft' as side, bias_type, dataset_type, sft_response as t from latest union all select response_id, 'dpo', bias_type, dataset_type, dpo_response from latest),
w as (select response_id, side, {_WORDS.format('t')} as w from sides where t is not null),
runs as (select response_id, side, len(w) as n, unnest(range(1, len(w) - 4)) as i, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i : i + 5], ' '))) as run from w where len(w) >= 6),
again as (select response_id, side, n, i, row_number() over (partition by response_id, side, run order by i) as k from runs),
covered as (select distinct response_id, side, n, unnest(range(i, i + 6)) as at from again where k > 1)
"""

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _repeated(name: str, parts: str, where: str) -> str:
    """The share of a text's characters in parts that equal an earlier one, white space at their ends aside."""
    return f"""
{name}_p as (select response_id, side, unnest(parts) as raw, unnest(range(len(parts))) as i from (select response_id, side, {parts} as parts from sides where t is not null and {where})),
{name}_t as (select response_id, side, i, regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g') as p from {name}_p),
{name} as (select response_id, side, sum(case when k > 1 then length(p) else 0 end) / sum(length(p)) as v from (select *, row_number() over (partition by response_id, side, p order by i) as k from {name}_t where p <> '') group by all)"""


_LINES = _repeated("ln", r"regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')", "contains(t, chr(10))")
_SENTENCES = _repeated("se", r"regexp_extract_all(t, '[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+$')", "true")

_USABLE = """
latest as (select distinct on (row_index) row_index, original_index, mask, source from dataset where row_index is not null order by row_index, ingested_at desc),
usable as (
  select row_index, case when original_index = -1 then 'new' when coalesce(mask, 1) = 1 then 'kept' when mask = -1 then 'flipped' end as kind, lower(trim(source)) as source
  from latest),
used as (select * from usable where kind is not null and source is not null),
counts as (select kind, source, count(*) as n from used group by all)
"""

_BUDGETS = f"""
{_USABLE},
known as (select t.*, coalesce(n, 0) as available, target_share * size_factor * (select count(*) from used) as wanted from mix_targets t left join counts using (kind, source)),
asked as (select *, least(round(wanted)::bigint, available * max_repeats) as budget from known)
"""

_STANDINGS = """
rated as (select index as row_index, arg_max(coalesce(autorater_score, 0), rated_at) as a from dataset_autorated group by index),
lls as (select row_index, arg_max(case when skip then null else score end, scored_at) as s, arg_max(coalesce(skip, false), scored_at) as skipped from scores group by row_index),
vec as (select row_index, max(case when isnan(persona_vector) then null else persona_vector end) as p, max(case when isnan(feedback_vector) then null else feedback_vector end) as f from vector_scores group by row_index),
base as (select row_index, 6 - a as a, -s as s, p, f from rated join lls using (row_index) join vec using (row_index) where a between 1 and 5 and not skipped and s is not null and p is not null and f is not null),
ranked as (select row_index, count(*) over () as n,
  rank() over (order by a) - 1 + count(*) over (partition by a) / 2.0 as ra, rank() over (order by s) - 1 + count(*) over (partition by s) / 2.0 as rs,
  rank() over (order by p) - 1 + count(*) over (partition by p) / 2.0 as rp, rank() over (order by f) - 1 + count(*) over (partition by f) / 2.0 as rf from base)
"""

#: The first eigenvector of the rank correlations, by powers of their matrix.
_LOADINGS = f"""
{_STANDINGS},
stood as (select row_index, n, (2 * ra)::bigint as autorater, (2 * rs)::bigint as lls, (2 * rp)::bigint as persona_vector, (2 * rf)::bigint as feedback_vector from ranked),
long as (select row_index, unnest([1, 2, 3, 4]) as m, unnest([autorater, lls, persona_vector, feedback_vector])::double as r from stood),
cm as (select a.m as i, b.m as j, corr(a.r, b.r) as c from long a join long b using (row_index) group by all),
mat as (select list(c order by i, j) as c from cm),
power as (
  select 0 as k, [1.0, 0.9, 0.8, 0.7]::double[] as v
  union all
  select k + 1, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) from (
    select k, list_transform(range(4), lambda i: c[4 * i + 1] * v[1] + c[4 * i + 2] * v[2] + c[4 * i + 3] * v[3] + c[4 * i + 4] * v[4]) as u from power, mat where k < 2000)),
first as (select list_transform(v, lambda x: abs(x)) as v from power order by k desc limit 1)
"""

_GRAMS = rf"""
iw as (select item_id, {_WORDS.format('content_text')} as w from eval_items where content_text is not null),
ig as (select item_id, unnest(range(len(w) - 11)) as j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) as g from iw where len(w) >= 12),
dw as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null),
dg as (select doc_id, unnest(range(len(w) - 11)) as i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) as g from dw where len(w) >= 12)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"with {_SETS} select x as row_index_a, y as row_index_b from near",
    "p1_groups": f"""
with recursive {_SETS},
either as (select x as a, y as b from near union all select y, x from near),
reach as (select a, b from either union select r.a, b.b from reach r join either b on r.b = b.a)
select r.row_index, coalesce(least(r.row_index, g.least), r.row_index) as group_id, coalesce(l.n, 0) as n_links
from (select distinct row_index from dataset where row_index is not null) r
left join (select a as row_index, min(b) as least from reach group by a) g using (row_index)
left join (select a as row_index, count(*) as n from either group by a) l using (row_index)
""",
    "p2_found": f"with {_COVERED} select response_id, side from covered group by response_id, side, n having count(*) * 10 >= n * 3",
    "p2_repetition": f"""
with {_COVERED}, {_LINES}, {_SENTENCES},
rep as (select response_id, side, count(*) as n_repeated from covered group by all),
m as (
  select response_id, side, side || '/' || coalesce(bias_type, '-') || '/' || coalesce(dataset_type, '-') as host, coalesce(len(w.w), 0) as n_words, coalesce(n_repeated, 0) as n_repeated,
    coalesce(n_repeated / nullif(len(w.w), 0), 0) as share, coalesce(ln.v, 0) as line_share, coalesce(se.v, 0) as sentence_share
  from sides left join w using (response_id, side) left join rep using (response_id, side) left join ln using (response_id, side) left join se using (response_id, side)),
f as (select *, share >= 0.3 or line_share >= 0.3 or sentence_share >= 0.3 as failed from m),
hosts as (select host, count(*) as n, count(*) filter (failed) as f from f group by host),
tot as (select sum(f) / sum(n) as mean, count(*) as m, sum(n) as total, sum(n * (f / n) * (f / n)) as sq, sum(n::double * n) as nn from hosts),
btw as (select *, (sq - total * mean * mean - (m - 1) * mean * (1 - mean)) / nullif(total - nn / total, 0) as b from tot),
prior as (select mean, coalesce(case when b > 0 then greatest(mean * (1 - mean) / b - 1, 1) else total / m end, total / m) as weight from btw),
rated as (select host, n as host_texts, hosts.f as host_failed, (hosts.f + mean * weight) / (n + weight) as host_rate from hosts, prior)
select response_id, side, host, n_words, n_repeated, round(share, 8) as share, round(line_share, 8) as line_share, round(sentence_share, 8) as sentence_share, failed, host_texts, host_failed,
  round(host_rate, 8) as host_rate, case when host_rate >= 0.2 then 'suspect' else 'sound' end as host_verdict
from f join rated using (host)
""",
    "p3_found": f"""
with {_USABLE}
select mix_id, kind, source from mix_targets left join counts using (kind, source)
where max_repeats * coalesce(n, 0) < target_share * size_factor * (select count(*) from used)
""",
    "p3_report": f"""
with {_BUDGETS}
select mix_id, kind, source, target_share, max_repeats, size_factor, available, wanted, available * max_repeats >= wanted as met, budget as drawn,
  coalesce(budget / nullif(sum(budget) over (partition by mix_id), 0), 0) as actual_share
from asked
""",
    "p3_drawn": f"""
with {_BUDGETS},
h as (select kind, source, row_index, row_number() over (partition by kind, source order by left(md5('42:' || row_index), 12)) as place from used),
drawn as (select mix_id, row_index, (budget // available + case when place <= budget % available then 1 else 0 end)::int as copies from asked join h using (kind, source))
select mix_id, row_index, copies from drawn where copies > 0
""",
    "p4_found": f"""
with {_STANDINGS}
select row_index from (select row_index, n, row_number() over (order by ra + rs + rp + rf desc, row_index) as place from ranked) where place <= n // 50
""",
    "p4_ranking": f"""
with recursive {_LOADINGS},
projected as (select *, autorater * v[1] + lls * v[2] + persona_vector * v[3] + feedback_vector * v[4] as total from stood, first)
select row_index, n as n_items, round(total / (2 * n), 8) as projection, row_number() over (order by total desc, row_index) - 1 as position,
  autorater / (2 * n) as autorater, lls / (2 * n) as lls, persona_vector / (2 * n) as persona_vector, feedback_vector / (2 * n) as feedback_vector
from projected
""",
    "p4_component": f"""
with recursive {_LOADINGS},
names as (select unnest(['autorater', 'lls', 'persona_vector', 'feedback_vector']) as name, unnest([1, 2, 3, 4]) as i),
run as (select unnest(correlations) as c from method_corr_results where score_signs = 'aligned'),
either as (select c.method_a as a, c.method_b as b, c.spearman as s from run union all select c.method_b, c.method_a, c.spearman from run),
stored as (select a, b, median(s) as s from either where s is not null group by all)
select x.name as method_a, y.name as method_b, round(v[x.i], 8) as loading_a, round(c, 8) as spearman, round(s, 8) as stored_spearman
from cm join names x on x.i = cm.i join names y on y.i = cm.j cross join first left join stored on a = x.name and b = y.name where cm.i <> cm.j
""",
    "p7_found": f"with {_GRAMS} select distinct doc_id, item_id from dg join ig using (g)",
    "p7_items": f"""
with {_GRAMS},
hit as (select distinct doc_id, item_id, i, j from dg join ig using (g)),
island as (select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from hit),
longest as (select doc_id, item_id, max(n) + 11 as n from (select doc_id, item_id, count(*) as n from island group by doc_id, item_id, i - j, island) group by all),
best as (select item_id, count(*) as n_docs, max(n) as longest, max(n / len(w)) as coverage from longest join iw using (item_id) group by item_id)
select item_id, coalesce(n_docs, 0) as n_docs, coalesce(longest, 0)::int as longest, round(coalesce(coverage, 0), 8) as coverage from eval_items left join best using (item_id)
""",
    "p7_cleaned": rf"""
with {_GRAMS},
hit as (select distinct doc_id, i from dg join (select distinct g from ig) using (g)),
edge as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i), -99) + 11 as opens from hit),
span as (select doc_id, min(i) as a, max(i) + 11 as b from (select *, sum(opens::int) over (partition by doc_id order by i) as s from edge) group by doc_id, s),
token as (select doc_id, unnest(t) as t, unnest(range(len(t))) as k from (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') as t from documents where doc_id in (select doc_id from hit))),
numbered as (select *, regexp_matches(t, '[\p{{L}}\p{{N}}]') as is_word, count(*) filter (regexp_matches(t, '[\p{{L}}\p{{N}}]')) over (partition by doc_id order by k) - 1 as word from token),
placed as (select n.*, s.a, s.b from numbered n left join span s on s.doc_id = n.doc_id and n.word between s.a and s.b and (n.is_word or n.word < s.b))
select doc_id, string_agg(case when a is null then t when is_word and word = a then ' ' else '' end, '' order by k) as text, count(distinct a)::int as spans from placed group by doc_id
""",
}
