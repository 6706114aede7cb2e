"""DuckDB SQL with the rows of the queries that SQL can express on whole tables.

Without SQL: op4 (merges by rank), op5 and op6 (XXH64), op7 and op9 (trained models), op8
(spans of a fitted classifier). Those are tested against brute force.
"""

from __future__ import annotations

from courtside.llm.chat import TEMPLATE
from courtside.llm.urls import MAX_BAD, MAX_STRENGTH, RULES, Z

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strength(name: str, source: str) -> str:
    """Moments of one level: how alike pages of one group are."""
    return f"""{name} as (
        select case when n is null or n = 0 then 1.0
                    when v = 0 or room <= 0 or (pp - n * mean * mean - v * (m - 1)) / (v * room) <= 1.0 / ({MAX_STRENGTH} + 1) then {MAX_STRENGTH}
                    else (v * room) / (pp - n * mean * mean - v * (m - 1)) - 1 end as s
        from (select *, mean * (1 - mean) as v, n - nn / n - (m - 1) as room
              from (select count(*) as m, sum(n)::double as n, sum(bad)::double / sum(n) as mean, sum(n::double * n) as nn,
                           sum(bad::double * bad / n) as pp from {source} where n > 0)))"""


_fits = " ".join(
    f"when (host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}') and path like '/{r.partition('/')[2]}%' then '{r}'"
    for r, _ in sorted(RULES, key=lambda r: -len(r[0])))
_verdicts = " ".join(f"when '{r}' then '{v}'" for r, v in RULES)

OP1 = f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from cut),
known as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 when toxic = 0 and quality = 1 then 0 end) as bad from labels group by 1),
hosts as (select host, regexp_extract(host, '[^.]*[.]?[^.]*$') as domain, regexp_extract(host, '[^.]*$') as suffix,
                 count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from parts left join known using (page_id) group by host),
domains as (select suffix, domain, sum(n) as n, sum(bad) as bad from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from hosts group by all),
{_strength('host_s', 'hosts')}, {_strength('domain_s', 'domains')}, {_strength('suffix_s', 'suffixes')},
overall as (select coalesce(sum(bad)::double / nullif(sum(n), 0), 0) as mean from hosts),
suffix_p as (select suffix, (bad + s * mean) / (n + s) as prior from suffixes, suffix_s, overall),
domain_p as (select domain, (bad + s * prior) / (n + s) as prior from domains join suffix_p using (suffix), domain_s),
host_p as (select host, bad + s * prior as a, n - bad + s * (1 - prior) as b from hosts join domain_p using (domain), host_s),
judged as (select page_id, host, path, case {_fits} end as rule,
                  a / (a + b) - {Z} * sqrt(a * b / (a + b + 1)) / (a + b) as low from parts join host_p using (host))
select page_id, host, path, rule,
       case rule {_verdicts} else case when low > {MAX_BAD} then 'block' else 'allow' end end as verdict
from judged"""

_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
with d as (select doc_id, {_ITEM_WORDS} as w from documents),
b as (select item_id, w, least(10, len(w)) as size from (select item_id, {_ITEM_WORDS} as w from benchmark) where len(w) > 0),
phrases as (select distinct item_id, size, array_to_string(w[p : p + size - 1], ' ') as phrase
            from (select *, unnest(range(1, len(w) - size + 2)) as p from b)),
starts as (select doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') as phrase
           from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p
                 from d, (select distinct size from phrases) where len(w) >= size)),
found as (select doc_id, item_id, s.size, p from starts s join phrases using (size, phrase)),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from found) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item_id::varchar as item from found) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join named using (doc_id)"""

OP3 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select doc_id, p, w[p] as word, case when p + 19 <= len(w) then array_to_string(w[p : p + 19], ' ') end as phrase
          from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
judged as (select doc_id, p, word, phrase is not null and row_number() over (partition by phrase order by doc_id, p) > 1 as late from words),
covered as (select doc_id, p, word, max(late::int) over (partition by doc_id order by p rows between 19 preceding and current row) as gone from judged),
kept as (select doc_id, count(*) as n_words, sum(gone) as n_removed, string_agg(word, ' ' order by p) filter (where gone = 0) as rest from covered group by 1)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from d left join kept using (doc_id)"""

assert "'<s>' + '[INST] '" in TEMPLATE and "' [/INST]'" in TEMPLATE and "'<</>>'" in TEMPLATE  # lengths below are this template's
_escaped = r"length(regexp_replace({}, '[\\<>\[]', '..', 'g'))"
OP10 = rf"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum({_escaped.format('text')} + case role when 'user' then 18 when 'assistant' then 4 else 9 + {_escaped.format('role')} end)::bigint as formatted_chars
from rows group by conv_id"""

# The lookup table of crc32 by its rule: each byte eight times through the reversed polynomial.
_CRC = """crc_table as (
    select list(c order by b) as t from (
        select b, list_reduce(list_prepend(b, range(8)), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
        from (select unnest(range(256)) as b)))"""

OP11 = f"""
with recursive {_CRC},
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) as run from documents),
counted as (select id, run, count(*) as n from runs group by all),
hashed as (select run, n, length(run) as m,
                  xor(4294967295, list_reduce(list_prepend(4294967295, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(id || ':' || run)), '..')]),
                      lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]))) as h
           from counted, crc_table),
words as (select word, sum(n)::bigint as n
          from (select case when h % 97 = 0 then substr(run, 1, (h % m)::bigint) || substr(run, (h % m)::bigint + 2) else run end as word, n from hashed)
          where length(word) >= 5 group by word having sum(n) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
holes as (select word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as less from places),
near as (
    select a.word, a.n, b.word as other, b.n as other_n from holes a join holes b on a.hole = b.hole and a.word <> b.word
    union select h.word, h.n, w.word, w.n from holes h join words w on h.less = w.word
    union select w.word, w.n, h.word, h.n from holes h join words w on h.less = w.word),
best as (select word, count(*) as n_near, min({{'low': -other_n, 'form': other}}) as b from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when -b.low >= 2 * w.n then b.form end as form,
                 case when -b.low >= 2 * w.n then -b.low end as form_n from words w left join best using (word)),
walk as (select word, word as root from forms
         union all select walk.word, forms.form from walk join forms on walk.root = forms.word where forms.form is not null)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n::bigint as form_n from forms f join walk w using (word)
where not exists (select 1 from forms g where g.word = w.root and g.form is not null)
"""

# At the sizes SQL is run at, all rows share one window, so the search is exact.
OP12 = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
usual as (select m from (select len(e) as m, count(*) as n from v group by 1) order by n desc, m desc limit 1),
rows as (select distinct vec_id, e from v where len(e) = (select m from usual)),
scored as (select a.vec_id as query_id, b.vec_id, list_reduce(list_prepend(0.0::double, list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), lambda x, y: x + y) as score
           from rows a join rows b on b.vec_id <> a.vec_id where a.vec_id % 20 = 0),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
select query_id, place::int as rank, vec_id, score from placed where place <= 20
"""

OP13 = f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
listed as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from listed group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from listed),
sized as (select lang, w, i, unnest([1, 2, 3, 4]) as k from starts),
f as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as a from sized where i + k - 1 <= len(w) group by all having count(*) >= 30),
split as (select lang, k, phrase, a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select *, unnest(range(1, k)) as c from split),
scored as (select s.lang, s.k, s.phrase, s.a, s.c, l.a as l, r.a as r, ((2000000::hugeint * s.a) // (l.a + r.a))::bigint as score
           from cuts s join f l on l.lang = s.lang and l.phrase = array_to_string(s.w[1 : s.c], ' ')
                join f r on r.lang = s.lang and r.phrase = array_to_string(s.w[s.c + 1 : s.k], ' ')),
lowest as (select lang, phrase, a, min({{'score': score, 'c': c, 'l': l, 'r': r}}) as m from scored group by all),
spans as (select lang, w, k, a, unnest(range(1, k + 1)) as i from split where k > 2),
wide as (select lang, w, k, a, i, unnest(range(i + 1, k + 1)) as j from spans),
longer as (select lang, array_to_string(w[i : j], ' ') as phrase, max(a) as longer from wide where j - i + 1 < k group by all),
kept as (select s.lang, s.phrase, s.a, m.score as score, m.l as l, m.r as r from lowest s left join longer using (lang, phrase) where longer is null or 100 * longer < 80 * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_reputation": OP1, "op2_decontamination": OP2, "op3_substring_dedup": OP3, "op10_chat": OP10,
    "op11_spelling_variants": OP11, "op12_nearest_neighbours": OP12, "op13_collocations": OP13}
