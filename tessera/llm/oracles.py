"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import DELTA, GRIDS, RISK

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[ \x09-\x0D]+'), lambda x: x <> '')"


OP1 = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(regexp_replace(role, '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as er, regexp_replace(regexp_replace(text, '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') as et,
 len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) as marks, length(role || text) - length(replace(role || text, '\', '')) as slashes from c),
l as (select *, case when marks = 0 then 0 when regexp_replace(regexp_replace(er, '<\\(/?s>)', '<\1', 'g'), '\[\\(/?INST\])', '[\1', 'g') = role
 and regexp_replace(regexp_replace(et, '<\\(/?s>)', '<\1', 'g'), '\[\\(/?INST\])', '[\1', 'g') = text then 1 else 2 end as level from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
sum(22 + length(role) + length(text) + case level when 0 then 0 when 1 then marks else marks + slashes end)::bigint as formatted_chars from l group by 1"""

OP2 = f"""
with w as (select doc_id, {_words("coalesce(text, '')")} as w from documents),
g as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as s from w where len(w) >= 20)),
f as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from g),
gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) as p from f where r > 1),
t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from w),
k as (select t.doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from t anti join gone using (doc_id, p) group by 1)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)"""

_SIGNALS = {"symbols": "1000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // greatest(n_words, 1)"}

OP4 = rf"""
with w as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {_words("coalesce(text, '')")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as lines from documents),
g as (select doc_id, s, array_to_string(w[s:s + 4], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as s from w where len(w) >= 5)),
d as (select doc_id, unnest(generate_series(s, s + 4)) as p from (select *, count(*) over (partition by doc_id, k) as c from g) where c > 1),
r as (select doc_id, count(distinct p) as n from d group by 1),
q as (select doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from w left join r using (doc_id)),
z as (select *, {', '.join(f'{x} as {n}' for n, x in _SIGNALS.items())} from q),
h as (select z.* from z semi join (select doc_id from labels where quality = 1) l using (doc_id)),
m as (select count(distinct lang) * {sum(map(len, GRIDS.values()))} as m from h),
x as ({' union all '.join(f"select lang, '{n}' as signal, c as cutoff, count(*) as n, count(*) filter (where {n} > c) as k from h, (select unnest({g}) as c) group by 1, 3" for n, g in GRIDS.items())}),
p as (select *, case when k >= n then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - case when j = 0 then 0 else lgamma(j + 1) end - lgamma(n - j + 1) + j * ln({RISK / len(GRIDS)!r}) + (n - j) * ln(1 - {RISK / len(GRIDS)!r})))) end as p from x),
b as (select lang, {', '.join(f"min(cutoff) filter (where signal = '{n}') as {n}_cut" for n in GRIDS)} from p, m where p.p <= {DELTA} / m.m group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not ({' or '.join(f'coalesce({n} > {n}_cut, false)' for n in GRIDS)}) as kept from z left join b using (lang)"""

OP8 = f"""
with recursive w as (select doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOW}')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select a as node, b as seen from e union select r.node, e.b from r join e on e.a = r.seen),
m as (select node, min(seen) as low from r group by 1)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) as component_id, w.doc_id <= coalesce(low, w.doc_id) as kept
from w left join n using (doc_id) left join m on m.node = w.doc_id"""

SQL = {"op1_chat_format": OP1, "op2_substring_dedup": OP2, "op4_quality_rules": OP4, "op8_near_dedup": OP8}
