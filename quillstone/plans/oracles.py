"""DuckDB SQL for the registered queries, on the driver's tables."""

from __future__ import annotations

from quillstone.functions import romanise as rom
from quillstone.plans.fixtures import ALPHABETS
from quillstone.plans.fixtures import SQL as FIXTURES

TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\x{0300}-\x{0331}]*"
WORDISH = r"[^\p{L}\p{N}_\x{0900}-\x{097F}]+"


def spellings(table: dict[str, str]) -> str:
    """A map in SQL; quotes are doubled."""
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


#: Each letter by itself: a consonant has its own vowel unless a sign or the virama follows it or its dot.
ROMANISED = f"""
with w_ as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
s_ as (select word, unnest([{", ".join(f"translate(word, 'abcdefghijklmnopqrstuvwxyz', '{a}')" for a in ALPHABETS)}]) as script from w_),
c_ as (select distinct script, unnest(range(1, length(script) + 1)) as i from s_),
l_ as (select script, i, script[i:i] as c, script[i+1:i+1] = '{rom.NUKTA_SIGN}' as dotted, case when script[i+1:i+1] = '{rom.NUKTA_SIGN}' then script[i+2:i+2] else script[i+1:i+1] end as follow from c_),
o_ as (select script, i, case
  when c in ('{rom.VIRAMA}', '{rom.NUKTA_SIGN}') then ''
  when ({spellings(rom.CONSONANTS | rom.COMPOSED)})[c] is not null then
    coalesce(case when dotted then ({spellings(rom.NUKTA)})[c] end, ({spellings(rom.CONSONANTS | rom.COMPOSED)})[c])
    || case when follow = '{rom.VIRAMA}' or ({spellings(rom.SIGNS)})[follow] is not null then '' else 'a' end
  else ({spellings(rom.SIGNS | rom.VOWELS | rom.MARKS)})[c] end as part from l_),
r_ as (select script, string_agg(part, '' order by i) as latin from o_ group by script)
select word, script, latin from s_ join r_ using (script)"""


def with_(*ctes: str, then: str) -> str:
    return "with recursive " + ",\n".join([FIXTURES, *ctes]) + "\n" + then


def norm(c: str) -> str:
    return rf"regexp_replace(trim(translate({c}, '०१२३४५६७८९', '0123456789')), '\s+', ' ', 'g')"


def number_key(c: str) -> str:
    return rf"lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}_]', '', 'g'))"


def match_form(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '{WORDISH}', ' ', 'g'))"


def phonetic(c: str) -> str:
    w = f"lower(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"
    w = rf"regexp_replace(regexp_replace({w}, 'c([eiy])', 's\1', 'g'), 'g([eiy])', 'j\1', 'g')"
    for a, b in ("ph", "f"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("ch", "c"):
        w = f"replace({w}, '{a}', '{b}')"
    w = f"regexp_replace(replace(translate({w}, 'cqwzm', 'kkvjn'), 'x', 'ks'), '[aeiouy]', '', 'g')"
    for letter in "bdfghjklnprstv":
        w = f"regexp_replace({w}, '{letter}+', '{letter}', 'g')"
    return w


def phonetic_list(c: str) -> str:
    """Distinct keys of a text's words, first occurrences in order."""
    words = rf"regexp_extract_all({c}, '[A-Za-z\x{{0900}}-\x{{097F}}][A-Za-z\x{{0900}}-\x{{097F}}\x{{200C}}\x{{200D}}]*')"
    keys = f"list_filter(list_transform({words}, lambda w: {phonetic('w')}), lambda k: length(k) >= 2)"
    return f"list_filter({keys}, lambda k, i: list_position({keys}, k) = i)"


#: Each word is keyed once, however often it occurs.
PHONETIC = rf"""
pw_ as materialized (select chunk_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
  from (select chunk_id, regexp_extract_all(text, '[A-Za-z\x{{0900}}-\x{{097F}}][A-Za-z\x{{0900}}-\x{{097F}}\x{{200C}}\x{{200D}}]*') as ws from passages_)),
pk_ as materialized (select word, {phonetic('word')} as key from (select distinct word from pw_)),
pd_ as (select chunk_id, key, min(i) as i from pw_ join pk_ using (word) where length(key) >= 2 group by all),
phon as materialized (select chunk_id, coalesce(string_agg(key, ' ' order by i), '') as text from passages_ left join pd_ using (chunk_id) group by all)"""


def coverage(q: str, t: str) -> str:
    terms = f"list_filter(string_split(lower({norm(q)}), ' '), lambda t: length(t) > 2)"
    return f"coalesce(round(len(list_filter({terms}, lambda t: contains(lower({t}), t))) / nullif(len({terms}), 0), 3), 0.0)"


def bm25(passages: str = "passages_", words: str | None = None, name: str = "sc") -> str:
    words = words or f"list_filter(string_split_regex({norm('question')}, '{WORDISH}'), lambda w: length(w) > 1)"
    return rf"""
toks_ as materialized (select chunk_id, regexp_extract_all(lower(text), '{TOKEN}') as ts from {passages}),
post_ as materialized (select chunk_id, unnest(ts) as term, generate_subscripts(ts, 1) as pos from toks_),
dl_ as (select chunk_id, len(ts) as dl from toks_),
qw_ as (select qid, unnest(ws) as word, generate_subscripts(ws, 1) as phrase from (select qid, {words} as ws from questions_)),
qt_ as (select qid, phrase, regexp_extract_all(lower(word), '{TOKEN}') as ts from qw_),
qp_ as materialized (select qid, phrase, unnest(ts) as term, generate_subscripts(ts, 1) as off, len(ts) as n from qt_ where len(ts) > 0),
st_ as (select qid, phrase, chunk_id, pos - off as at_, n from post_ join qp_ using (term) group by all having count(*) = n),
tf_ as materialized (select qid, phrase, chunk_id, count(*) as tf from st_ group by all),
df_ as (select qid, phrase, count(*) as df from tf_ group by all),
whole_ as (select count(*) as docs, avg(dl) as avgdl from dl_),
{name} as materialized (
  select qid, chunk_id, -sum(case when ln((docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((docs - df + 0.5) / (df + 0.5)) end
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as bm25
  from tf_ join df_ using (qid, phrase) join dl_ using (chunk_id) cross join whole_ group by all)"""


def ranked(scores: str, name: str, k: int, where: str = "true", value: str = "bm25", down: str = "") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by qid order by round({value}, 9) {down}, chunk_id)::int as rank from {scores} where {where}) where rank <= {k})"


#: Passages after the loads of `fixtures.maintained`.
MAINTAINED = "held_ as (select chunk_id, text || case when chunk_id % 10 = 3 then ' amended by a later order' else '' end as text from passages_ where chunk_id % 10 <> 7)"
IN_FILTER = "chunk_id in (select chunk_id from passages_ join orders_ using (goid) where category = '1-URGENT' and go_date_iso >= '1994-01-01' and go_date_iso <= '1997-12-31')"
COSINE = "list_inner_product(q.embedding::double[], v.embedding::double[])"
VECTORS = f"vs as (select q.vec_id as qid, v.vec_id as chunk_id, {COSINE} as cosine, v.label from embeddings q join embeddings v on q.vec_id % 50 = 0)"
HYBRID_VECTORS = f"vs as (select q.vec_id as qid, v.vec_id as chunk_id, {COSINE} as cosine from embeddings q join embeddings v on q.vec_id in (select qid from questions_))"


def fused(limit: int, vector_weight: float = 1.0) -> str:
    return f"""{bm25()}, {ranked("sc", "kw", 50)}, {HYBRID_VECTORS}, {ranked("vs", "ve", 50, value="cosine", down="desc")},
un as (select qid, chunk_id, rank as rk, null::int as rv, bm25, null::double as cosine from kw union all select qid, chunk_id, null, rank, null, cosine from ve),
fu as (select qid, chunk_id, min(rk) as rank_keyword, min(rv) as rank_vector, max(bm25) as bm25, max(cosine) as cosine,
  coalesce(1.0::double / (60 + min(rk)), 0.0::double) + coalesce({vector_weight}::double / (60 + min(rv)), 0.0::double) as score from un group by all),
pl as (select * from (select *, row_number() over (partition by qid order by round(score, 12) desc, rank_keyword nulls last, rank_vector nulls last)::int as place from fu) where place <= {10 * limit})"""


RESULTS = f"""{bm25()}, {ranked("sc", "kw", 6)},
res as (select kw.qid, kw.rank as position, kw.chunk_id, p.goid, p.page, p.text, p.kind, o.go_no, o.go_date, o.category, o.subject, question,
  case when qid % 3 = 0 then round(chunk_id % 70 / 100, 2) end as cosine, {coverage("question", "p.text")} as lexical_coverage
  from kw join passages_ p using (chunk_id) join orders_ o using (goid) join questions_ q using (qid))"""

GATE = """
best as (select qid, max(cosine) as cos, coalesce(max(lexical_coverage), 0.0) as cov, count(*) as n from res where position <= 3 group by qid),
gate as (select q.qid, coalesce(cos >= 0.40, false) or coalesce(cov >= 0.20, false) as relevant,
  case when n is null then 'nothing matched the question' when coalesce(cos >= 0.40, false) then 'semantic similarity ' || printf('%.2f', cos)
    when cov >= 0.20 then 'term overlap ' || printf('%.0f', cov * 100) || '%'
    else 'closest passages are not relevant (term overlap ' || printf('%.0f', cov * 100) || '%' || case when cos is null then '' else ', semantic similarity ' || printf('%.2f', cos) end || ')' end as reason
  from questions_ q left join best using (qid))"""

#: What the replies of `_raw` hold after parsing.
REPLIES = """
rep as (select qid, case when qid % 5 = 4 then 'plain words' else ' says ' || qid end as answer, case when qid % 5 <> 4 then qid % 6 <> 1 end as same_subject,
  case when qid % 11 = 5 then null when qid % 13 = 6 then 99 else 1 end as n, case when qid % 7 = 3 then 'ab, c' else upper(text) end as quote, qid % 5 <> 4 as quoted from questions_)"""

CHECKED = f"""
held as (select qid, count(*) as held from res group by qid),
chk as (select rep.qid, 0 as i, res.chunk_id as cited, case when n is null then 'no excerpt number' when n < 1 or n > coalesce(held, 0) then 'excerpt number out of range'
  when length(replace({match_form("quote")}, ' ', '')) < 8 then 'quote too short to verify' when not contains({match_form("res.text")}, {match_form("quote")}) then 'not found verbatim in the cited excerpt' end as reason
  from rep left join held on held.qid = rep.qid left join res on res.qid = rep.qid and res.position = rep.n where quoted)"""

CITED = """
cp as (select goid, page, text || ' No. ' || (goid * 7 + 100) || '/XX-' || (goid * 3 + 100) || '/2019, Number: ' || (goid + 100) || '/20 संख्या-' || (goid * 7 + 100) || '/XX-' || (goid * 3 + 100) || '/2019' as text from passages_)"""

GOLD = """
gold as (select qid, case when qid % 3 = 0 then 'hi' else 'en' end as language, qid * 3 as expect_goid, (qid % 3 + 1)::int as expect_page, qid % 5 = 0 as unanswerable,
  case when qid % 2 = 0 then list_transform(range(0, 30), lambda i: qid + i * 17) else [qid * 3] end as accept from questions_),
det as (select g.qid, language, coalesce(bool_or(list_contains(accept, goid) and position = 1), false) as hit_at_1, coalesce(bool_or(list_contains(accept, goid)), false) as hit_at_5,
  coalesce(bool_or(list_contains(accept, goid) and page = expect_page), false) as page_hit_at_5
  from gold g left join (select * from res where position <= 5) r using (qid) where not unanswerable group by all)"""

FURNITURE = r"(regexp_matches(c, '^[A-Z]{2,}-[A-Z0-9/]+-[A-Z]+--?[A-Za-z ]+Department\s*$') or regexp_matches(c, '^[A-Z]?/?\p{Nd}{3,}/\p{Nd}{4}\s*$') or regexp_matches(c, '^[^\p{L}\p{N}]{0,6}$'))"


def cleaned(c: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({c}, chr(8203), ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '[ \t]{{2,}}', ' ', 'g')"


LINES = rf"""
ln0 as (select goid, page, block, par, line, {cleaned("string_agg(text, ' ' order by word)")} as c, count(*)::int as n, min(x) as x, min(y) as y, max(x + w) as x2, max(y + h) as y2 from words_ group by all),
ln as (select *, row_number() over (partition by goid, block order by line) as i from ln0 where not {FURNITURE} and c <> '')"""

# greedy packing and merging as recursions over line and passage numbers
PASSAGES = rf"""{LINES},
pk as (
  select goid, block, i, n as held, 1 as pack from ln where i = 1
  union all
  select ln.goid, ln.block, ln.i, case when held + ln.n > 110 then ln.n else held + ln.n end, case when held + ln.n > 110 then pack + 1 else pack end
  from pk join ln on ln.goid = pk.goid and ln.block = pk.block and ln.i = pk.i + 1),
ps0 as (select goid, block, pack, string_agg(c, ' ' order by i) as text, sum(ln.n)::int as ids, min(x) as x, min(y) as y, max(x2) as x2, max(y2) as y2 from pk join ln using (goid, block, i) group by all),
ps1 as (select *, len(string_split_regex(trim(text), '\s+'))::int as nw from ps0),
ps as (select *, row_number() over (partition by goid order by block, pack) as j from ps1 where nw >= 6),
mg as (
  select goid, j, nw as held, 0 as ord from ps where j = 1
  union all
  select ps.goid, ps.j, case when held < 35 and held + nw <= 110 then held + nw else nw end, case when held < 35 and held + nw <= 110 then ord else ord + 1 end
  from mg join ps on ps.goid = mg.goid and ps.j = mg.j + 1),
pas as (select goid, ord::int as ord, string_agg(text, ' ' order by j) as text, sum(nw)::int as n_words, min(x)::int as box_x, min(y)::int as box_y,
  (max(x2) - min(x))::int as box_w, (max(y2) - min(y))::int as box_h, sum(ids)::int as ids from mg join ps using (goid, j) group by goid, ord)"""

GATE_PAGES = """
wp as (select goid, line // 20 + 1 as page, count(*) as words, round(avg(conf), 1) as mean_conf, string_agg(text, ' ' order by line, word) as text from words_ group by all),
gp as (select goid, page, words, mean_conf, words / 100 as seconds,
  text || ' No. ' || (goid * 7 + 100) || '/XX-' || (goid * 3 + 100) || '/2019, Number: ' || (goid + 100) || '/20 संख्या-' || (goid * 7 + 100) || '/XX-' || (goid * 3 + 100) || '/2019' as text from wp),
gr0 as (select goid, words, mean_conf, seconds, length(text) as chars, len(regexp_extract_all(text, '[\\x{0900}-\\x{097F}]')) as dev, len(regexp_extract_all(text, '[A-Za-z]')) as latin,
  regexp_extract_all(text, '(?:संख्या|सं0|सं\\.|No\\.?|Number)\\s*[-:–]?\\s*([0-9०-९][0-9०-९/A-Za-z\\x{0900}-\\x{097F}()\\-.]{4,60})', 1) as refs,
  regexp_matches(text, '(\\p{Nd}{1,2}[./-]\\p{Nd}{1,2}[./-]\\p{Nd}{2,4})|दिनांक') as dated from gp),
gr1 as (select goid, count(*) as pages, sum(chars)::bigint as chars, sum(words)::bigint as words, round(avg(mean_conf), 1) as mean_conf, count(*) filter (mean_conf < 70) as low_pages,
  coalesce(round(100 * sum(dev) / nullif(sum(dev) + sum(latin), 0)), 0)::int as devanagari_pct, bool_or(dated) as has_date_token, round(sum(seconds) / count(*), 1) as secs_per_page,
  len(list_distinct(flatten(list(refs))))::bigint as go_refs_found from gr0 group by goid),
gr as (select gr1.*, o.category from gr1 left join orders_ o using (goid))""".replace("\\\\", "\\")

RELATED = """
dt as (select *, case when regexp_matches(coalesce(go_date_iso, '2000-01-01'), '^\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])') then
  make_date(substr(coalesce(go_date_iso, '2000-01-01'), 1, 4)::int, substr(coalesce(go_date_iso, '2000-01-01'), 6, 2)::int, 1) + (substr(coalesce(go_date_iso, '2000-01-01'), 9, 2)::int - 1) end as day from orders_),
mt as (select q.goid as q_goid, c.goid, c.go_no, abs(datediff('day', c.day, q.day)) as gap from dt q join dt c on (c.category = q.category or c.section = q.section)
  and c.goid <> q.goid and coalesce(c.go_no, '') <> coalesce(q.go_no, '') and c.ocr_ok = 1 where q.goid % 50 = 0),
nr as (select *, row_number() over (partition by q_goid order by gap nulls first, goid) as nth from mt),
oc as (select *, row_number() over (partition by q_goid, go_no order by nth) as copy from nr where nth <= 20)
""".replace("\\\\", "\\")

EXPANSION = f"""{bm25()}, {ranked("sc", "kw", 6)},
sub as (select goid, chunk_id + 10000000 as chunk_id from passages_),
bod as (select goid, chunk_id as body_id, 0 as i from passages_ union all select goid, chunk_id + 20000000, 1 from passages_),
rs as (select kw.qid, s.chunk_id, s.goid, 1.0::double / (60 + rank) as score, rank as position from kw join sub s on s.goid = kw.chunk_id where s.goid in (select goid from orders_)),
sw as (select qid, coalesce(body_id, chunk_id) as chunk_id, rs.goid, score - coalesce(i, 0) * 1e-6::double as score, position, coalesce(i, 0) as i, case when body_id is not null then 'via subject' else 'keyword' end as matched_by
  from rs left join bod using (goid)),
on_ as (select *, row_number() over (partition by qid, chunk_id order by position, i) as nth from sw)"""

ORACLES = {
    "keyword_top": with_(bm25(), ranked("sc", "kw", 10), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw"),
    "keyword_filtered": with_(bm25(), ranked("sc", "kw", 10, IN_FILTER), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw"),
    "keyword_in_department": with_(bm25(), ranked("sc", "kw", 10, "chunk_id in (select chunk_id from passages_ join orders_ using (goid) where department = 'src6' and go_no like '%1%')"), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw"),
    "keyword_of_long_words": with_(
        "asked_ as (select qid, array_to_string(list_filter(string_split(question, ' '), lambda w: length(w) >= 9), ' ') as question from questions_)",
        bm25().replace("questions_", "asked_"), ranked("sc", "kw", 10), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw",
    ),
    "maintained_search": with_(MAINTAINED, bm25("held_"), ranked("sc", "kw", 10), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw"),
    "maintained_terms": with_(MAINTAINED, then=f"select term, count(*) as df from (select distinct chunk_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) as term from held_) group by term"),
    "phonetic_top": with_(PHONETIC, bm25("phon", phonetic_list("question")), ranked("sc", "kw", 10), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw"),
    # a Devanagari consonant is its letter and an a
    "phonetic_romanised": with_(
        r"hp_ as (select chunk_id, case when chunk_id % 3 = 0 then regexp_replace(text, '([kmnprstl])', '\1a', 'g') else text end as text from passages_)", PHONETIC.replace("passages_", "hp_"),
        bm25("phon", phonetic_list("question")), ranked("sc", "kw", 10), then="select qid, chunk_id, round(bm25, 6) as bm25, rank from kw",
    ),
    "romanised_words": ROMANISED,
    "filtered_orders": with_(then="select unnest(list_filter([case when department = 'src6' then 'department' end, case when goid = 7 then 'goid' end, case when go_no like '%1%' then 'go_no' end, case when department = 'src6' and go_no like '%1%' and category = '1-URGENT' and go_date_iso >= '1993-06-01' and go_date_iso <= '1998-01-31' then 'all' end], lambda n: n is not null)) as selection, goid, go_no, department, category, go_date_iso from orders_"),
    "phonetic_keys": f"select word, {phonetic('word')} as key from (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents)",
    "vector_top": with_(VECTORS, ranked("vs", "ve", 10, value="cosine", down="desc"), then="select qid, chunk_id, round(cosine, 6) as cosine, rank from ve"),
    "vector_filtered": with_(VECTORS, ranked("vs", "ve", 10, "label = 3", value="cosine", down="desc"), then="select qid, chunk_id, round(cosine, 6) as cosine, rank from ve"),
    "fused_ranks": with_(fused(5, 0.6), then="select qid, chunk_id, rank_keyword, rank_vector, round(score, 9) as score, place from pl"),
    # with order numbers that are never empty the greedy loop equals two windows
    "hybrid_search": with_(
        fused(10),
        f"hy as (select pl.*, p.goid, p.page, p.text, o.go_no, q.question, {number_key('o.go_no')} as number from pl join passages_ p using (chunk_id) join orders_ o using (goid) join questions_ q using (qid))",
        "d1 as (select * from (select *, row_number() over (partition by qid, number, page order by place) as a from hy) where a = 1)",
        "d2 as (select * from (select *, row_number() over (partition by qid, number order by place) as b from d1) where b <= 2)",
        "d3 as (select *, row_number() over (partition by qid order by place)::int as position from d2)",
        then=f"""select qid, position, chunk_id, goid, go_no, page, round(score, 5) as score, round(bm25, 3) as bm25, round(cosine, 4) as cosine, {coverage('question', 'text')} as lexical_coverage,
          case when rank_keyword is not null and rank_vector is not null then 'keyword+vector' when rank_keyword is not null then 'keyword' else 'vector' end as matched_by from d3 where position <= 10""",
    ),
    "lexical_coverage": with_(bm25(), ranked("sc", "kw", 10), then=f"select qid, chunk_id, {coverage('question', 'p.text')} as lexical_coverage from kw join passages_ p using (chunk_id) join questions_ q using (qid)"),
    "related_orders": with_(RELATED, then="select q_goid as goid, goid as related_goid, gap::int as gap, place from (select *, row_number() over (partition by q_goid order by nth)::int as place from oc where copy = 1) where place <= 5"),
    "subject_expansion": with_(EXPANSION, then="select qid, place, chunk_id, goid, round(score, 9) as score, matched_by from (select *, row_number() over (partition by qid order by round(score, 12) desc, position, i)::int as place from on_ where nth = 1) where place <= 6"),
    "upsert_orders": with_(then="select goid, go_no, case when goid % 2 = 0 then 'new ' || subject else subject end as subject, department, case when goid % 2 = 0 then null else section end as section, category from orders_"),
    "replace_pages": "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as nth from events) where nth = 1",
    "not_yet_indexed": with_(then="select goid, go_no from orders_ where goid not in (select doc_id from labels)"),
    "mark_indexed": with_(then="select goid, case when goid in (select doc_id from labels) then 1 else ocr_ok end::int as ocr_ok from orders_"),
    "citations": with_(
        CITED,
        r"rf as (select goid, page, go_no, unnest(ms) as raw, generate_subscripts(ms, 1) as i from (select goid, page, go_no, regexp_extract_all(cp.text, '(?:शासनादेश\s*)?(?:संख्या|सं0|सं\.|क्रमांक|No\.?|Number)\s*[-:–—]?\s*([0-9][0-9A-Za-z\x{0900}-\x{097F}()/\-.]{5,60})', 1) as ms from cp join orders_ using (goid)))",
        r"rk as (select goid, page, go_no, i, regexp_replace(raw, '^[ .,:;\-]+|[ .,:;\-]+$', '', 'g') as ref_text from rf)",
        f"ru as (select *, row_number() over (partition by goid, page, {number_key('ref_text')} order by i) as nth from rk where length(regexp_replace(ref_text, '\\P{{Nd}}', '', 'g')) >= 3 and {number_key('ref_text')} <> {number_key('go_no')})",
        then=r"select goid, page, ref_text, nullif(regexp_extract(ref_text, '(19\p{Nd}{2}|20\p{Nd}{2})', 1), '') as ref_year from ru where nth = 1",
    ),
    "resolved_references": with_(
        "tg as (select regexp_replace(lower(go_no), '[/. -]', '', 'g') as loose, min(goid) as found from orders_ group by 1)",
        "rr as (select l_orderkey as goid, l_linenumber as page, case when length(l_partkey::varchar) > 2 then substr(l_partkey::varchar, 1, 2) || '/' || substr(l_partkey::varchar, 3, 9) else l_partkey::varchar || '/' end as ref_text, case when l_linenumber = 7 then l_suppkey end as target from lineitem)",
        then="select goid, page, ref_text, coalesce(target, found) as target_goid from rr left join tg on loose = regexp_replace(lower(ref_text), '[/. -]', '', 'g')",
    ),
    "resolved_count": with_(
        "tg as (select regexp_replace(lower(go_no), '[/. -]', '', 'g') as loose from orders_ group by 1)",
        then="""select count(*) as resolved from lineitem left join tg on loose = regexp_replace(case when length(l_partkey::varchar) > 2 then substr(l_partkey::varchar, 1, 2) || substr(l_partkey::varchar, 3, 9) else l_partkey::varchar end, '[/. -]', '', 'g')
          where loose is not null or (l_linenumber = 7 and l_suppkey is not null)""",
    ),
    "totals": with_(then="select count(*) as orders, coalesce(sum(ocr_ok), 0)::bigint as indexed, min(go_date_iso) as first_date, max(go_date_iso) as last_date from orders_"),
    "departments": with_(then="select department, count(*) as n, sum(ocr_ok)::bigint as indexed from orders_ group by 1 having sum(ocr_ok) > 0"),
    "facets": with_(then="select 'category' as facet, category as value, count(*) as n from orders_ where ocr_ok = 1 group by 2 union all select 'department', department, count(*) from orders_ where ocr_ok = 1 group by 2 union all select 'year', substr(go_date_iso, 1, 4), count(*) from orders_ where ocr_ok = 1 and go_date_iso is not null group by 2"),
    "passage_stats": with_(then="select count(*) as passages, round(avg(n_words), 6) as mean_words, count(distinct goid) as orders from passages_"),
    "sample_passages": with_(
        "dr as (select chunk_id, page, md5('7:' || chunk_id) as draw from passages_ where n_words between 25 and 900)", "nt as (select *, row_number() over (partition by page order by draw, chunk_id) as nth from dr)",
        then="select chunk_id, page from nt where nth <= 15 order by draw, chunk_id limit 40",
    ),
    "crop_boxes": with_(then="select chunk_id, greatest(0, box_x - 24) as \"left\", greatest(0, box_y - 24) as top, least(600, box_x + box_w + 24) as \"right\", least(500, box_y + box_h + 24) as bottom from passages_"),
    "recognised_lines": with_(LINES, then="select goid, block, line, c as text, n, x, y, x2, y2, n as ids from ln"),
    "packed_passages": with_(PASSAGES, then="select * from pas"),
    "page_assembly": with_(PASSAGES, "tx as (select goid, sum(length(text)) + count(*) - 1 as chars from pas group by goid)", then="select goid, coalesce(chars, 0)::int as chars, words, mean_conf from (select goid, count(*)::int as words, round(avg(conf), 1) as mean_conf from words_ group by goid) left join tx using (goid)"),
    "subject_passages": with_(
        r"sb as (select goid, trim(regexp_replace(subject, '[\s\x{A0}]+', ' ', 'g')) as text from orders_)", then="select goid, text, len(string_split(text, ' '))::int as n_words, 'subject' as kind from sb where len(string_split(text, ' ')) >= 3"
    ),
    "streamed_passages": with_(PASSAGES, then="select * exclude (ids) from pas"),
    "persistent_ids": with_(then="select row_number() over (order by goid % 3, goid::varchar, page, ord) as chunk_id, goid from passages_"),
    "numbered_passages": with_("both_ as (select goid, page, ord, 'ocr' as kind from passages_ union all select goid, page, ord, 'subject' from passages_ where goid % 2 = 0)", then="select row_number() over (order by goid::varchar, kind, page, ord) as chunk_id, goid, kind from both_"),
    "clean_lines": with_(f"cl as (select goid, line, {cleaned('l')} as c, l from lines_)", then=rf"select goid, line::int as line, c as cleaned, {FURNITURE} as furniture, case when regexp_matches(l, '[\x{{0900}}-\x{{097F}}]') then 'hi' else 'en' end as language from cl"),
    "number_keys": with_(
        "nk as (select goid, go_no, go_date, 'No. संख्या-' || go_no || '-' || section || '-É/_-' || go_date as c from orders_)", then=f"select goid, {number_key('c')} as number, regexp_replace(lower(go_date), '[/. -]', '', 'g') as loose, '12' || go_no as folded from nk"
    ),
    "iso_dates": with_(then="select goid, case when goid % 5 = 0 then substr(go_date, 7, 4) || '-09-99' when goid % 7 = 0 then null else go_date_iso end as iso from orders_"),
    "https_urls": r"""
with r as (select page_id, case when page_id % 4 = 1 then regexp_replace(url, '^https?://[^/]*', '') when page_id % 4 = 2 then regexp_replace(url, '^https?://[^/]*/', '') else url end as u from pages)
select page_id, case when u = '' then null when page_id % 4 in (1, 2) then 'https://example.org' || case when u like '/%' then '' else '/' end || u else regexp_replace(u, '^http://', 'https://') end as pdf_url from r
""",
    "match_forms": with_(then=f"select chunk_id, md5({match_form('text')}) as digest from passages_"),
    "relevance_gate": with_(RESULTS, GATE, then="select * from gate"),
    "prompts": with_(
        RESULTS,
        "pt as (select qid, position, question, '[' || position || '] Government Order ' || coalesce(go_no, 'None') || ', dated ' || go_date || ', page ' || page || ', category ' || category || case when subject <> '' then chr(10) || 'That order is about: ' || subject else '' end || chr(10) || text as part from res)",
        then="select qid, md5(string_agg(part, chr(10) || chr(10) order by position) || chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || chr(10) || 'JSON:') as digest from pt group by qid",
    ),
    "parsed_replies": with_(REPLIES, then="select qid, answer, quoted::int as n_quotes, same_subject, true as found from rep"),
    "verified_quotes": with_(RESULTS, REPLIES, CHECKED, then="select qid, i, reason, case when reason is null then cited end as chunk_id from chk"),
    "answers": with_(
        RESULTS, GATE, REPLIES, CHECKED,
        """qt as (select chk.qid, chk.reason, res.chunk_id, res.goid, res.page, res.go_no, res.go_date, p.box_x, p.box_y, p.box_w, p.box_h, replace(rep.quote, 'ẞ', 'SS') as quote,
          case when rep.qid % 11 = 5 then 'none' when rep.qid % 13 = 6 then '99' else '1' end as n
          from chk join rep using (qid) left join res on res.qid = chk.qid and res.position = rep.n left join passages_ p on p.chunk_id = res.chunk_id)""",
        "sh as (select qid, string_agg(chunk_id::varchar, ',' order by position) as passages from res group by qid)",
        """de as (select gate.qid, relevant, coalesce(same_subject = false, false) as off_topic, rep.answer as said, qt.reason is null and qt.qid is not null as kept, qt.qid is not null as quoted
          from gate left join rep using (qid) left join qt using (qid))""",
        then="""select de.qid, relevant and kept and not off_topic as found, off_topic,
          case when not relevant then 'The indexed orders do not appear to cover this.' when kept and not off_topic then trim(said)
            when off_topic then 'The orders that matched are about a different matter than this question.' else 'No passage in these orders supported an answer to this question.' end as answer,
          case when relevant and kept and not off_topic then chunk_id || '|' || goid || '|' || page || '|' || go_no || '|' || go_date || '|' || box_x || ',' || box_y || ',' || box_w || ',' || box_h || '|' || quote else '' end as quotes,
          case when quoted and not kept then n || '|' || reason || '|' || quote else '' end as dropped_quotes, coalesce(passages, '') as passages
          from de left join qt using (qid) left join sh on sh.qid = de.qid""",
    ),
    "decisions": with_(
        RESULTS, GATE, REPLIES, CHECKED,
        "al as (select g.qid, g.relevant, g.reason, r.answer, coalesce(not r.same_subject, false) as off, coalesce(c.reason is null and c.qid is not null, false) as kept, coalesce(c.reason is not null, false) as dropped from gate g left join rep r using (qid) left join chk c using (qid))",
        then="""select qid, relevant and kept and not off as found,
          case when not relevant then 'The indexed orders do not appear to cover this.' when kept and not off then trim(answer) when off then 'The orders that matched are about a different matter than this question.'
            else 'No passage in these orders supported an answer to this question.' end as answer,
          case when not relevant or (kept and not off) then reason when off then 'the closest orders are about a different subject' else 'the model produced no quote that survived verification' end as reason,
          (relevant and kept and not off)::int as kept, dropped::int as dropped, off as off_topic from al""",
    ),
    "retrieval_details": with_(RESULTS, GOLD, then="select * from det"),
    "retrieval_metrics": with_(
        RESULTS, GOLD, GATE,
        then="""select * from (select count(*) as n, count(*) filter (language = 'hi') as n_hindi, count(*) filter (language = 'en') as n_english, round(avg(hit_at_1::int), 3) as hit_at_1,
          round(avg(hit_at_5::int), 3) as hit_at_5, round(avg(page_hit_at_5::int), 3) as page_hit_at_5 from det), (select count(*) as n_unanswerable, round(avg((not relevant)::int), 3) as declined_correctly from gate join gold using (qid) where unanswerable)""",
    ),
    "retrieval_misses": with_(RESULTS, GOLD, then="select qid, language from det where not hit_at_5 order by qid limit 8"),
    "answer_metrics": """
with c as (select conv_id % 4 = 0 as un, conv_id % 17 = 3 as err, turn % 2 = 0 as found, turn % 3 as q, turn % 2 as d, conv_id % 3 = 1 as cited, round(length(text) / 10, 1) as seconds from conversations),
a as (select * from c where not err and not un), u as (select * from c where not err and un), m as (select seconds, row_number() over (order by seconds) as r, count(*) over () as n from c where not err)
select (select count(*) from a) as n, (select count(*) from u) as n_unanswerable, (select count(*) from c where err) as errors, (select round(avg(found::int), 3) from a) as answered,
  (select round(avg(cited::int), 3) from a) as cited_expected_order, (select round(avg((not found)::int), 3) from u) as declined_unanswerable, (select sum(q)::bigint from a) as quotes_total,
  (select sum(d)::bigint from a) as quotes_dropped, (select round(sum(q) / greatest(sum(q) + sum(d), 1), 3) from a) as quote_verification_rate, (select seconds from m where r = n // 2 + 1) as median_seconds
""",
    "gate_rows": with_(GATE_PAGES, then="select * from gr"),
    "gate_totals": with_(
        GATE_PAGES,
        then="select count(*) as orders, sum(pages)::bigint as pages, (select round(avg(mean_conf), 1) from gp) as mean_conf, sum(low_pages)::bigint as low_pages, count(*) filter (words < 20) as empty, count(*) filter (devanagari_pct >= 50) as devanagari, count(*) filter (go_refs_found > 0) as with_refs from gr",
    ),
    "page_stats": with_(
        then=r"select goid, page, sum(length(text))::bigint as chars, count(*) as words, coalesce(round(sum(len(regexp_extract_all(text, '[\x{0900}-\x{097F}]'))) / nullif(sum(len(regexp_extract_all(text, '\p{L}'))), 0), 3), 0.0) as devanagari_ratio, round(avg(conf), 1) as mean_conf, count(*) filter (conf < 60) as low_conf_words from words_ group by all"
    ),
    "batch_summary": with_(GATE_PAGES, then="select count(*) as pages, round(sum(seconds), 1) as seconds, round(sum(seconds) / greatest(count(*), 1), 1) as secs_per_page from gp"),
    "event_windows": "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
#: Cells change what is read, not what is found.
ORACLES |= {"vector_cells": ORACLES["vector_top"], "vector_cells_filtered": ORACLES["vector_filtered"]}
#: A reply is the digest of its prompt.
ORACLES["replies"] = f"select qid, digest, null::varchar as error from ({ORACLES['prompts']})"
#: Orders after the changes of `registry._tallied`.
MOVED = """moved_ as (select goid, case when goid % 3 = 0 then 'moved' else category end as category, department, go_date_iso, case when goid % 3 = 0 then 1 else ocr_ok end as ocr_ok
  from orders_ where goid % 7 <> 0)"""
ORACLES["merged_orders"] = ORACLES["upsert_orders"]
for _name in ("facets", "totals"):
    ORACLES[f"maintained_{_name}"] = with_(MOVED, then=ORACLES[_name].rsplit(FIXTURES, 1)[1].strip().replace("orders_", "moved_"))
