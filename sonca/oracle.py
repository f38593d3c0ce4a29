"""DuckDB SQL for the registered queries: common tables, and a statement for each query over them."""

from __future__ import annotations

#: Fixed values of the token and syllable model, stated here once more so that an error in the engine's tables shows.
ALPHA = "A-Za-z\u00c0-\u00fd\u0100-\u013d\u0140-\u017d\u0180-\u01bd\u0300-\u0323\u0340-\u0363\u1e80-\u1eff"
SPACE, ESCAPED, BLANK, MAX_ID = " \t\u00a0", "\ue000", "#", 26250
TOKEN = f"[{SPACE}]+|\n|{ESCAPED}|[{ALPHA}]+|[^{ALPHA}{SPACE}\n{ESCAPED}]+"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
INITIALS = ["", *"b c d g h l m n p r s t v x ch zd gi kh ng nh ph qu th tr".split()]
NUCLEI = "a e i o u y az aw ez oz ow uw oa oe ooo uy iez oaw uaz uez uoz uow uyez ah oah".split()
FINALS = ["", *"i u m n ng c p t".split()]
TONES = ["", *"s j f r x".split()]
#: Nuclei and the codas that each takes; "-" is none.
_TAKES = {
    "a": "- i u m n ng c p t ch nh y o", "e oe": "- o m n ng c p t", "i ez": "- u m n p t ch nh", "o oz ow u": "- i m n ng c p t", "uw": "- i u m n ng c p t", "y ia ua uaw uya": "-",
    "az": "u y m n ng c p t", "aw oaw": "m n ng c p t", "uyez": "n t", "oa": "- i y o m n ng c p t ch nh", "ooo": "ng c", "uy": "- u n p t ch nh", "iez": "u m n ng c p t", "uaz": "y m n ng c p t",
    "uez": "- m n p t ch nh", "uoz": "i m n ng c p t", "uow": "i u m n ng c p t",
}
_TAKES_AFTER = {("gi", "i"): "- u m n p t ch nh ng c", ("gi", "ez"): "- u m n p t ch nh ng c", ("qu", "y"): "- u m n p t ch nh", ("qu", "iez"): "u m n t", ("kh", "uez"): "- m n p t ch nh u"}
_codas = lambda v: ["" if x == "-" else x for x in v.split()]
ALLOWED = {g: _codas(v) for gs, v in _TAKES.items() for g in gs.split()}
WITH_ONSET = {k: _codas(v) for k, v in _TAKES_AFTER.items()}
BARRED = {"gi": "i y ia iez".split(), "c": "oa oaw oe uyez uaz uez uy".split(), "qu": "oe oa oaw u ua uaz uaw uez uw uow uoz uy uya uyez".split()}
#: Nucleus and coda as an id holds them, and what they stand for.
_HELD = "aw i a y, oaw i oa y, az i az y, uaz i uaz y, aw u a o, e u e o, oa u oa o, oe u oe o, ez ng ez nh, ez c ez ch, i ng i nh, i c i ch, uez ng uez nh, uez c uez ch, uy ng uy nh, uy c uy ch, ah ng a nh, ah c a ch, oah ng oa nh, oah c oa ch"
UNFOLD = {(a, b): (c, d) for a, b, c, d in (x.split() for x in _HELD.split(", "))}
#: Codas as ids hold them, and the nuclei that change with it.
FOLD = {"y": ("i", {"a": "aw", "oa": "oaw"}), "o": ("u", {"a": "aw"}), "nh": ("ng", {"a": "ah", "oa": "oah"}), "ch": ("c", {"a": "ah", "oa": "oah"})}
#: How onsets and nuclei may be written; the last line's nuclei only where no doubt is left.
ONSETS = "b:b c:c d:d g:g h:h k:c l:l m:m n:n p:p r:r s:s t:t v:v x:x ch:ch đ:zd gi:gi gh:gh kh:kh ng:ng ngh:ngh nh:nh ph:ph qu:qu th:th tr:tr"
VOWELS = "a:a ă:aw â:az e:e ê:ez i:i ia:ia iê:iez y:y yê:iez o:o oo:ooo ô:oz ơ:ow oe:oe oa:oa oă:oaw oâ:uaz u:u ua:ua uâ:uaz uă:uaw ưa:uaw uê:uez ư:uw ươ:uow ưo:uow uơ:uow uô:uoz uy:uy uya:uya uyê:uyez"
UNMARKED = "ie:iez ye:iez ue:uez uye:uyez"
TONED = {"s": "áắấéếíóốớúứý", "f": "àằầèềìòồờùừỳ", "r": "ảẳẩẻểỉỏổởủửỷ", "x": "ãẵẫẽễĩõỗỡũữỹ", "j": "ạặậẹệịọộợụựỵ"}
UNTONED = "aăâeêioôơuưy"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


_SEPARATES = ", ".join(map(_q, SPACE))


def token_tables(text: str = "text", table: str = "documents") -> str:
    """parts: all matches; tok: doc_id, pos, token, category, fenced."""
    edge = lambda x: f"({x} is null or left({x}, 1) in ({_SEPARATES}, chr(10), {_q(ESCAPED)}))::int"
    return f"""
pre as (select doc_id, replace(regexp_replace(coalesce({text}, ''), '\\\\[rt]', ' ', 'g'), '\\n', {_q(ESCAPED)}) || chr(10) as t from {table}),
cut as (select doc_id, regexp_extract_all(t, {_q(TOKEN)}) as p from pre),
parts as (select doc_id, i, p[i] as x, case when i > 1 then p[i - 1] end as before, p[i + 1] as after from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from cut)),
tok as (
  select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as pos,
    case when x = {_q(ESCAPED)} then '\\n' else x end as token,
    case when regexp_full_match(x, '[A-Za-z]+') then 'alph0m0t' when regexp_matches(x, '^[{ALPHA}]') then 'alphmark' else 'nonalpha' end as category,
    case when x in (chr(10), {_q(ESCAPED)}) then 3 else {edge("before")} * 2 + {edge("after")} end as fenced
  from parts where left(x, 1) not in ({_SEPARATES}))"""


LINES = """
numbered as (select *, coalesce(sum((token = chr(10))::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as line_no from tok),
lined as (select doc_id, line_no, (row_number() over (partition by doc_id, line_no order by pos) - 1)::int as pos, token, category, fenced from numbered where token <> chr(10))"""

SYMBOLS = f"""
s as (select doc_id, list(case when category = 'nonalpha' then '{BLANK}' else token end order by pos) as s from tok group by doc_id),
padded as (select doc_id, ['{BLANK}'] || s || ['{BLANK}'] as l from s),
collapsed as (select doc_id, list_filter(l, lambda x, i: not (x = '{BLANK}' and i > 1 and l[(i - 1)::bigint] = '{BLANK}')) as s from padded)"""


def grams(name: str, n: int) -> str:
    """A table name(gram, n_count)."""
    b = f"'{BLANK}'"
    s = "s" if n < 4 else f"[{b}] || s"
    good = f"not list_contains(g, {b})" if n < 4 else f"not list_contains(g[2:{n - 1}], {b}) and not (g[1] = {b} and g[{n}] = {b})"
    return f"{name} as (select array_to_string(g, ' ') as gram, count(*) as n_count from (select s[i:i + {n - 1}] as g from (select s, unnest(range(1, len(s) - {n - 2})) as i from (select {s} as s from s))) where {good} group by all)"


def blank_grams(name: str, n: int) -> str:
    b = f"'{BLANK}'"
    good = {1: "true", 2: f"not (g[1] = {b} and g[2] = {b})", 3: f"g[2] <> {b} and g[3] <> {b}", 4: f"g[2] <> {b} and g[3] <> {b} and not (g[1] = {b} and g[4] = {b})"}[n]
    return f"{name} as (select array_to_string(g, ' ') as gram, count(*) as n_count from (select s[i:i + {n - 1}] as g from (select s, unnest(range(1, len(s) - {n - 2})) as i from collapsed)) where {good} group by all)"


def _case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {otherwise} end"


def _decoded() -> str:
    """space: syllable_id, dau, giua, cuoi, tone by integer arithmetic."""
    rime = [("g = 'y' and c = 'ng' and dau = 'qu'", "['y', 'nh']")] + [(f"g = {_q(a)} and c = {_q(b)}", f"[{_q(x)}, {_q(y)}]") for (a, b), (x, y) in UNFOLD.items()]
    return f"""
raw as (select i::int as syllable_id, {_list(INITIALS)}[(i // 1050 + 1)::int] as dau, {_list(NUCLEI)}[(i // 42 % 25 + 1)::int] as g,
  {_list(FINALS)}[(case when i % 42 < 36 then i % 42 // 6 else (i % 42 - 36) // 2 + 6 end + 1)::int] as c,
  {_list(TONES)}[(case when i % 42 < 36 then i % 42 % 6 else (i % 42 - 36) % 2 + 1 end + 1)::int] as tone from range({MAX_ID}) r(i)),
paired as (select *, {_case(rime, "[g, c]")} as r from raw),
space as (select syllable_id, dau, r[1] as giua, r[2] as cuoi, tone from paired),
spelt as (select *, {_case([("giua = 'uow' and cuoi = ''", "'uaw'"), ("giua = 'uoz' and cuoi = ''", "'ua'"), ("giua = 'ooo'", "'oo'"), ("giua = 'uyez' and cuoi = ''", "'uya'"), ("giua = 'iez' and cuoi = ''", "'ia'"), ("giua = 'iez' and dau in ('', 'qu')", "'yez'")], "giua")} as shown from space)"""


def _onset(first: str, d: str) -> str:
    front = f"{first} in ('e', 'i', 'y')"
    return _case([("dau = 'zd'", d), (f"dau = 'c' and {front}", "'k'"), (f"dau = 'gi' and {first} = 'i'", "'g'"), (f"dau = 'g' and {front}", "'gh'"), (f"dau = 'ng' and {front}", "'ngh'")], "dau")


def _valid_pairs() -> str:
    rows = [("*", g, c) for g, cs in ALLOWED.items() for c in cs] + [(d, g, c) for (d, g), cs in WITH_ONSET.items() for c in cs]
    own = [f"dau = {_q(d)} and giua = {_q(g)}" for d, g in WITH_ONSET]
    barred = ", ".join(f"({_q(d)}, {_q(g)})" for d, gs in BARRED.items() for g in sorted(gs))
    values = ", ".join(f"({_q(d)}, {_q(g)}, {_q(c)})" for d, g, c in sorted(rows))
    return f"rimes(d, g, c) as (values {values}), checked as (select space.*, (dau, giua) not in ({barred}) and exists (select 1 from rimes where d = (case when {' or '.join(own)} then dau else '*' end) and g = giua and c = cuoi) as is_valid from space)"


def _utf8() -> str:
    letters = "shown"
    for telex, vowel in (("uyez", "uyê"), ("iez", "iê"), ("yez", "yê"), ("uaw", "ưa"), ("uow", "ươ"), ("oaw", "oă"), ("az", "â"), ("ez", "ê"), ("oz", "ô"), ("aw", "ă"), ("ow", "ơ"), ("uw", "ư")):
        letters = f"replace({letters}, {_q(telex)}, {_q(vowel)})"
    marks = _case([(f"tone = {_q(t)}", f"chr({ord(m)})") for t, m in (("s", "́"), ("f", "̀"), ("r", "̉"), ("x", "̃"), ("j", "̣"))], "''")
    at = "(length(v) - (shown in ('ia', 'ua', 'uaw', 'uya'))::int)"
    return f"written as (select syllable_id, nfc_normalize({_onset('left(giua, 1)', _q('đ'))} || left(v, {at}) || {marks} || substr(v, {at} + 1) || cuoi) as utf8 from (select *, {letters} as v from spelt where giua not in ('ah', 'oah')))"


def _folded() -> str:
    """again: syllable_id made again from the parts."""
    nuclei = [(f"giua = {_q(g)} and cuoi = {_q(c)}", _q(to)) for c, (_, changes) in FOLD.items() for g, to in changes.items()]
    codas = [(f"cuoi = {_q(c)}", _q(to)) for c, (to, _) in FOLD.items()]
    at = lambda values, x: f"list_position({_list(values)}, {x}) - 1"
    return f"""
flat as (select syllable_id, {at(INITIALS, "dau")} as d, {at(NUCLEI, _case(nuclei, "giua"))} as g, {at(FINALS, _case(codas, "cuoi"))} as c, {at(TONES, "tone")} as t from checked where is_valid),
again as (select syllable_id, (d * 1050 + g * 42 + case when c < 6 then c * 6 + t else 36 + (c - 6) * 2 + t - 1 end)::int as encoded from flat)"""


_DENSE = f"{_onset('left(shown, 1)', _q('dd'))} || regexp_replace(shown, '[wz]', '', 'g') || cuoi || '|' || regexp_extract(shown, '[wz]') || tone"
_SPARE = f"rtrim({_onset('left(shown, 1)', _q('d d'))} || regexp_replace(shown, '[wz]', '', 'g') || cuoi || ' ' || regexp_extract(shown, '[wz]') || tone)"
_NUCLEUS = _case([("giua = 'ooo'", "'oo'"), ("giua = 'iez'", "'yez'"), ("giua = 'i'", "'y'"), ("giua = 'a' and cuoi in ('y', 'o')", "'aw'"), ("giua = 'oa' and cuoi = 'y'", "'oaw'")], "giua")
_PARTS = f"""case when dau = '' then '' when dau = 'qu' then case when nucleus in ('a', 'e') then 'c_o' else 'c_u' end else {_case([("dau = 'zd'", "'dd'"), ("dau = 'gi'", "'d'")], "dau")} || '_' end
  || nucleus || {_case([("cuoi = ''", "''"), ("cuoi = 'o'", "'|u'"), ("cuoi = 'y'", "'|i'")], "'|' || cuoi")} || '_' || tone"""
_DIGIT = lambda shift: f"substr('{BASE64}', ((syllable_id >> {shift}) & 63) + 1, 1)"
_BUCKET = "case when n_count <= 2 then 'a' when n_count <= 5 then 'b' when n_count <= 11 then 'c' when n_count <= 25 then 'd' when n_count <= 80 then 'e' else 'f' end"
_STATS = """
stats as (
  select doc_id, line_no, sum(strlen(token) + fenced % 2)::bigint as line_bytes, sum(case when category = 'alphmark' and strlen(token) <= 20 then strlen(token) + 1 else 0 end)::bigint as vi_bytes, count(*)::bigint as n_tokens
  from lined where strlen(token) <= 255 group by all),
every as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::int as line_no from documents),
filled as (select e.doc_id, e.line_no, coalesce(line_bytes, 0) as line_bytes, coalesce(vi_bytes, 0) as vi_bytes, coalesce(n_tokens, 0) as n_tokens from every e left join stats s using (doc_id, line_no)),
routed as (select *, case when line_bytes * 20 > vi_bytes * 100 then 'no_vi' when line_bytes * 50 > vi_bytes * 100 then 'low_vi' else 'main' end as route from filled)"""
_pairs = lambda x: [y.split(":") for y in x.split()]


def _parse() -> str:
    """sp: letters (without tone), tone, marked, syllable_id of every spelling; needs space."""
    onsets = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in [("", ""), *_pairs(ONSETS)])
    nuclei = ", ".join(f"({_q(a)}, {_q(b)}, {sure})" for x, sure in ((VOWELS, "false"), (UNMARKED, "true")) for a, b in _pairs(x))
    takes = ", ".join(f"({_q(d)}, {_q(g)}, {_q(c)})" for d, g, c in [("*", g, c) for g, cs in ALLOWED.items() for c in cs] + [(d, g, c) for (d, g), cs in WITH_ONSET.items() for c in cs])
    own = " or ".join(f"(dau = {_q(d)} and giua = {_q(g)})" for d, g in WITH_ONSET)
    barred = ", ".join(f"({_q(d)}, {_q(g)})" for d, gs in BARRED.items() for g in gs)
    opened = _case([(f"giua = {_q(a)}", _q(b)) for a, b in (("ua", "uoz"), ("ia", "iez"), ("uaw", "uow"), ("uya", "uyez"))], "giua")
    return f"""
on_(o, dau) as (values {onsets}), nu_(v, giua, bare) as (values {nuclei}), takes(d, g, c) as (values {takes}), tones(tone) as (values {", ".join(f"({_q(t)})" for t in TONES)}),
spelling as (select o, v, dau, giua, bare, c as cuoi, tone, o || v || c as letters from on_, nu_, takes, tones
  where g = case when giua = 'uow' and c = '' then 'ua' else giua end and d = (case when {own} then dau else '*' end) and (dau, giua) not in ({barred})
    and (c not in ('c', 'ch', 'p', 't') or tone in ('s', 'j')) and not (o = 'g' and regexp_matches(v || c, '^i[{UNTONED}]'))
    and (not bare or dau = 'zd' or giua = 'uyez' or (giua in ('iez', 'uez') and 2 * (tone <> '')::int + length(o) + length(c) >= 4))),
opened as (select letters, tone, cuoi, bare or dau = 'zd' or regexp_matches(letters, '[ăâêôơưđ]') or tone <> '' as marked, dau, {opened} as giua from (select letters, tone, cuoi, bare, dau, case when giua = 'uow' and cuoi = '' then 'ua' else giua end as giua from spelling)),
normal as (select letters, tone, case when dau = 'gi' and giua = 'ez' and cuoi = 'nh' then 'ng' when dau = 'gi' and giua = 'ez' and cuoi = 'ch' then 'c' else cuoi end as cuoi, marked, case when dau = 'ngh' then 'ng' when dau = 'gh' then 'g' when dau = 'g' and giua = 'i' then 'gi' else dau end as dau, case when dau = 'gi' and giua = 'ez' and cuoi <> '' then 'iez' else giua end as giua from opened),
sp as (select letters, tone, marked, syllable_id from normal join space using (dau, giua, cuoi, tone))"""


def _known(types: str) -> str:
    """known: token, category, syllable_id, marked, first_upper, all_upper of types(token, category)."""
    every = "".join(TONED.values())
    tone = "".join(f" || case when regexp_matches(l, '[{v}]') then {_q(t)} else '' end" for t, v in TONED.items())
    doubled = "ăâêôơưđð" + "".join(v[i] for v in TONED.values() for i in (1, 2, 4, 7, 8, 10))
    return f"""
bare_types as (select *, translate(l, '{every}ð', '{UNTONED * len(TONED)}đ') as letters, ''{tone} as tone from (select token, category, nfc_normalize(lower(token)) as l from ({types}) where category <> 'nonalpha' and strlen(token) <= 10)),
known as (select token, case when marked then 'syllmark' else 'syll0m0t' end as category, syllable_id, marked, left(token, 1) <> lower(left(token, 1)) as first_upper,
  token = upper(token) and token <> lower(token) and (length(token) > 1 or regexp_matches(l, '[{doubled}]')) as all_upper from bare_types join sp using (letters, tone))"""


#: Nuclei in Telex, as they may be typed.
TYPED = "a:a aa:az az:az aw:aw e:e ee:ez ez:ez i:i ia:ia ie:iez iee:iez iez:iez y:y ye:iez yee:iez yez:iez o:o oo:ooo oz:oz ow:ow oe:oe oa:oa oaz:uaz oaw:oaw u:u ua:ua uaa:uaz uaz:uaz uaw:uaw ue:uez uee:uez uez:uez uw:uw uwa:uaw uwo:uow uwow:uow uoo:uoz uoz:uoz uow:uow uoww:uow uy:uy uya:uya uye:uyez uyee:uyez uyez:uyez"


def _loose(texts: str) -> str:
    """loose: token of each token of texts(token) that may be Vietnamese, marks and tones in ASCII as well."""
    onsets = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in [("", ""), *_pairs(ONSETS.replace("đ:", "dd:"))])
    nuclei = ", ".join(f"({_q(a)}, {_q(b)})" for a, b in _pairs(TYPED))
    takes = ", ".join(f"({_q(d)}, {_q(g)}, {_q(c)})" for d, g, c in [("*", g, c) for g, cs in ALLOWED.items() for c in cs] + [(d, g, c) for (d, g), cs in WITH_ONSET.items() for c in cs])
    own = " or ".join(f"(dau = {_q(d)} and giua = {_q(g)})" for d, g in WITH_ONSET)
    barred = ", ".join(f"({_q(d)}, {_q(g)})" for d, gs in BARRED.items() for g in gs)
    tone = "".join(f" || case when regexp_matches(l, '[{v}]') then {_q(t)} else '' end" for t, v in TONED.items())
    turned = "b"
    for a, first in (("ă", "a"), ("ơ", "o"), ("ư", "u"), ("w", "")):
        turned = f"regexp_replace(regexp_replace({turned}, '{a}[oơô]', '{first}ow', 'g'), '{a}[ăâ]', '{first}aw', 'g')"
    for a, telex in (("ă", "aw"), ("â", "az"), ("ê", "ez"), ("ô", "oz"), ("ơ", "ow"), ("ư", "uw"), ("đ", "dd"), ("ð", "dd")):
        turned = f"replace({turned}, '{a}', '{telex}')"
    return f"""
lo_on(o, dau) as (values {onsets}), lo_nu(v, giua) as (values {nuclei}), lo_takes(d, g, c) as (values {takes}), lo_tones(t) as (values {", ".join(f"({_q(t)})" for t in TONES)}),
typed as (select o || v || c || t as letters, t, c in ('c', 'ch', 'p', 't') as stop from lo_on, lo_nu, lo_takes, lo_tones
  where g = case when giua = 'uow' and c = '' and t = '' then 'ua' else giua end and d = (case when {own} then dau else '*' end) and (dau, giua) not in ({barred}) and not (o = 'g' and regexp_matches(v || c, '^i[eyuioa]'))),
lo_text as (select token, {turned} as letters, tone from (select token, translate(l, '{"".join(TONED.values())}', '{UNTONED * len(TONED)}') as b, ''{tone} as tone from (select token, nfc_normalize(lower(token)) as l from ({texts})))),
loose as (select distinct token from lo_text join typed using (letters) where length(letters) <= 10 and length(tone) <= 1 and (t = '' or (tone = '' and right(token, 1) = t)) and (not stop or tone || t in ('s', 'j')))"""


_SHOWN_IDS = f"shown_ids as (select syllable_id as id, {_DENSE} as dense from spelt)"
_TYPES = """
all_types as (select token, category, count(*) as n from tok where category <> 'nonalpha' group by all),
parsed as (select t.token, coalesce(k.category, t.category) as category, n, syllable_id, coalesce(marked, false) as marked, coalesce(first_upper, false) as first_upper, coalesce(all_upper, false) as all_upper from all_types t left join known k using (token)),
voc as (select case when not first_upper then '' when all_upper then '^^' else '^' end || dense as vocab, sum(n)::bigint as n from parsed join shown_ids on id = syllable_id group by 1),
lower_voc as (select regexp_replace(vocab, '^\\^*', '') as vocab, n from voc)"""
_PLACED = """
numbered_ids as (select doc_id, pos, coalesce(syllable_id, 32767) as id from tok left join known using (token)),
sid as (select doc_id, list(case when id = 32767 then '#' else id::varchar end order by pos) as s, list(coalesce(dense, '#') order by pos) as d from (select n.*, x.dense from numbered_ids n left join shown_ids x on x.id = n.id) group by doc_id)"""
_WRITTEN = """
parts_of as (select l.doc_id, l.line_no, l.pos, l.token, l.category, l.fenced % 2 = 1 as after, syllable_id is not null as is_syllable, strlen(l.token) <= 255 as counts,
  coalesce(case when not first_upper then '' when all_upper then '^^' else '^' end || dense, l.token) as shown from lined l left join known k using (token) left join shown_ids on id = syllable_id),
made as (select doc_id, line_no, string_agg(shown || case when after or not counts then ' ' else '' end, '' order by pos) as line, sum(case when counts then strlen(shown) + after::int else 0 end)::bigint as line_bytes,
  sum(case when counts and (is_syllable or (category = 'alphmark' and strlen(shown) <= 20)) then strlen(shown) + 1 else 0 end)::bigint as vi_bytes, sum(counts::int)::bigint as n_tokens, sum((counts and is_syllable)::int)::bigint as n_syllables from parts_of group by all)"""


def _rendered(table: str) -> str:
    return f"""
all_lines as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10)))))::int as line_no from {table}),
full_lines as (select e.doc_id, e.line_no, coalesce(line, '') as line, coalesce(line_bytes, 0) as line_bytes, coalesce(vi_bytes, 0) as vi_bytes, coalesce(n_tokens, 0) as n_tokens, coalesce(n_syllables, 0) as n_syllables from all_lines e left join made using (doc_id, line_no))"""


_ROUTED = "select *, case when line_bytes * 20 > vi_bytes * 100 then 'no_vi' when line_bytes * 50 > vi_bytes * 100 then 'low_vi' else 'main' end as route from full_lines"
VIETNAMESE = """
vi_words as (select syllable_id, case syllable_id % 3 when 1 then upper(left(utf8, 1)) || substr(utf8, 2) when 2 then upper(utf8) else utf8 end || case when syllable_id % 11 = 0 then '.' || chr(10) when syllable_id % 5 = 0 then ', ' else ' ' end as w from written),
vi as (select (syllable_id % 100)::bigint as doc_id, string_agg(w, '' order by syllable_id) as text from vi_words group by 1)"""


def _of_vietnamese(select: str, *tables: str) -> str:
    return "with " + ",".join([_decoded(), _utf8(), VIETNAMESE, token_tables(table="vi"), _parse(), _known("select distinct token, category from tok"), _SHOWN_IDS, *tables]) + "\n" + select


def _of_parsed(select: str, *tables: str) -> str:
    return "with " + ",".join([token_tables(), _decoded(), _parse(), _known("select distinct token, category from tok"), _SHOWN_IDS, *tables]) + "\n" + select


def _id_grams(n: int) -> str:
    return f"select {n} as n, array_to_string(g, ' ') as gram, count(*) as n_count, any_value(array_to_string(h, ' ')) as shown from (select s[i:i + {n - 1}] as g, d[i:i + {n - 1}] as h from (select s, d, unnest(range(1, len(s) - {n - 2})) as i from sid)) where not list_contains(g, '#') group by g"


ESCAPES = "replace(replace(text, '. ', '.\\n '), ' the ', '\\tthe\\r ')"


def _on_tokens(select: str, *tables: str, text: str = "text") -> str:
    return "with " + ",".join([token_tables(text), *tables]) + "\n" + select


def _on_grams(select: str, *tables: str) -> str:
    return _on_tokens(select, SYMBOLS, *tables)


def _on_space(select: str, *tables: str) -> str:
    return "with " + ",".join([_decoded(), *tables]) + "\n" + select


def _types(where: str) -> str:
    return f"select token, category, count(*) as n from tok where {where} group by all"


def _hash_steps() -> str:
    """hashed: token, xxh32 and (up to 12 bytes) city32, in steps."""
    m, c1, c2 = 4294967296, 3432918353, 461845907
    p1, p2, p3, p4, p5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
    rol = lambda x, r: f"(({x}) * {1 << r} % {m} + ({x}) // {1 << (32 - r)})"
    lane = lambda k, start: f"list_reduce([{start}::ubigint] || list_transform(range(n // 16), lambda i: w[(i * 4 + {k + 1})::int]), lambda v, x: {rol(f'(v + x * {p2} % {m}) % {m}', 13)} * {p1} % {m})"
    xor_shift = lambda x, r: f"xor({x}, {x} // {1 << r})"
    at = lambda k: f"(b[{k} + 1] + b[{k} + 2] * 256 + b[{k} + 3] * 65536 + b[{k} + 4] * 16777216)"
    ror = lambda x, r: rol(x, 32 - r)
    mur = lambda a, h: f"(({ror(f'xor({h}, {ror(f'({a}) * {c1} % {m}', 17)} * {c2} % {m})', 19)}) * 5 + 3864292196) % {m}"
    return f"""
hb as (select token, strlen(token) as n, list_transform(range(strlen(token)), lambda i: ('0x' || substr(hex(encode(token)), (i * 2 + 1)::int, 2))::ubigint) as b from (select distinct token from tok where category <> 'nonalpha')),
hw as (select *, list_transform(range(n // 4), lambda i: b[(i * 4 + 1)::int] + b[(i * 4 + 2)::int] * 256 + b[(i * 4 + 3)::int] * 65536 + b[(i * 4 + 4)::int] * 16777216) as w from hb),
h0 as (select *, {lane(0, (p1 + p2) % m)} as v1, {lane(1, p2)} as v2, {lane(2, 0)} as v3, {lane(3, m - p1)} as v4 from hw),
h1 as (select *, case when n < 16 then {p5} + n else ({rol("v1", 1)} + {rol("v2", 7)} + {rol("v3", 12)} + {rol("v4", 18)} + n) % {m} end::ubigint as a0 from h0),
h2 as (select *, list_reduce([a0] || w[(n // 16 * 4 + 1)::int:], lambda a, x: {rol(f"(a + x * {p3} % {m}) % {m}", 17)} * {p4} % {m}) as a1 from h1),
h3 as (select *, list_reduce([a1] || b[(n // 4 * 4 + 1)::int:], lambda a, x: {rol(f"(a + x * {p5} % {m}) % {m}", 11)} * {p1} % {m}) as a2 from h2),
h4 as (select *, {xor_shift("a2", 15)} * {p2} % {m} as a3 from h3), h5 as (select *, {xor_shift("a3", 13)} * {p3} % {m} as a4 from h4), h6 as (select *, {xor_shift("a4", 16)}::bigint as xxh32 from h5),
c0 as (select *, list_transform(range(1, least(n, 4) + 1), lambda k: list_reduce([0::ubigint] || b[1:k::int], lambda a, x: (a * {c1} + case when x > 127 then x + {m - 256} else x end) % {m})) as bs from h6),
c1 as (select *, case when n < 5 then n else (n + {at("0")}) % {m} end::ubigint as x1, case when n < 5 then list_reduce([9::ubigint] || bs, lambda a, x: xor(a, x)) else n * 5 end::ubigint as g0,
  case when n < 5 then bs[-1] else (n * 5 + {at("(n - 4)")}) % {m} end::ubigint as x2, (9 + {at("(n // 2 // 4 % 2 * 4)")}) % {m} as x3 from c0 where n <= 12),
c2 as (select *, {mur("x1", "g0")} as g1 from c1), c3 as (select *, {mur("x2", "g1")} as g2 from c2), c4 as (select *, case when n < 5 then g2 else {mur("x3", "g2")} end as g3 from c3),
c5 as (select *, {xor_shift("g3", 16)} * 2246822507 % {m} as g4 from c4), c6 as (select *, {xor_shift("g4", 13)} * 3266489909 % {m} as g5 from c5),
hashed as (select h6.token, h6.xxh32, {xor_shift("g5", 16)}::bigint as city32 from h6 left join c6 using (token))"""


#: sent: the words of each line that has some; dictionary: frequent pairs and triples; lat: where they stand.
_LATTICE = """
sent as materialized (select doc_id || ':' || line_no as sent_id, list(lower(token) order by pos) as s from lined where category <> 'nonalpha' group by doc_id, line_no),
runs as (select sent_id, i - 1 as pos, k as len, array_to_string(s[i:i + k - 1], ' ') as gram from (select sent_id, s, k, unnest(range(1, len(s) - k + 2)) as i from sent, (values (2), (3), (4)) ks(k))),
dictionary as (select gram, count(*) as n from runs where len < 4 group by gram having count(*) >= 5),
lat as materialized (select sent_id, pos, len, n from runs join dictionary using (gram)),
longest as materialized (select sent_id, pos, max(len) as len from lat group by all)"""
_GREEDY = """
step(sent_id, i, tags) as (select sent_id, 0::bigint, '' from sent union all
  select step.sent_id, i + coalesce(l.len, 1), tags || 'B' || repeat('I', coalesce(l.len, 1)::int - 1) from step join sent using (sent_id) left join longest l on l.sent_id = step.sent_id and l.pos = step.i where i < len(s)),
tagged as (select sent_id, s, tags from step join sent using (sent_id) where i = len(s))"""
#: The best sums and tags up to the last four places.
_BEST = """
ends as materialized (select sent_id, pos + len as stop, max(case when len = 2 then n end) as n2, max(case when len = 3 then n end) as n3 from lat group by all),
dp(sent_id, i, a, ta) as (select sent_id, 0::bigint, [null, null, 0.0::double], [null, null, ''] from sent union all
  select sent_id, i + 1, [a[2], a[3], case pick when 3 then w3 when 2 then w2 else one end], [ta[2], ta[3], case pick when 3 then ta[1] || 'BII' when 2 then ta[2] || 'BI' else ta[3] || 'B' end] from (
    select *, case when w3 > greatest(one, coalesce(w2, one)) then 3 when w2 > one then 2 else 1 end as pick from (
      select dp.sent_id, i, a, ta, a[3] - 1.0 as one, a[2] + (100.0 + log10(n2)) as w2, a[1] + (200.0 + log10(n3)) as w3
      from dp join sent using (sent_id) left join ends e on e.sent_id = dp.sent_id and e.stop = dp.i + 1 where i < len(s))))"""


def _on_sentences(select: str, *tables: str) -> str:
    return "with recursive " + ",".join([token_tables(), LINES, _LATTICE, *tables]) + "\n" + select


SQL: dict[str, str] = {
    "tokenize": _on_tokens("select * from tok"),
    "tokenize_escapes": _on_tokens("select * from tok", text=ESCAPES),
    "token_category_counts": _on_tokens("select category, count(*) as n from tok group by all"),
    "token_fencing": _on_tokens("select ['none', 'right', 'left', 'both'][fenced + 1] as fence, count(*) as n from tok group by all"),
    "limit_lines": _on_tokens("select doc_id, line_no, pos, token, category, fenced from lined where line_no < 2", LINES),
    "line_numbers": _on_tokens("select doc_id, line_no, count(*) as n_tokens from lined group by all", LINES),
    "case_flags": _on_tokens("""select token, category, n, first_upper, length(token) > 1 and token = upper(token) and token <> lower(token) as all_upper, first_upper and substr(token, 2) = lower(substr(token, 2)) as capitalized, category = 'alphmark' as marked
from (select *, left(token, 1) <> lower(left(token, 1)) and left(token, 1) = upper(left(token, 1)) as first_upper from t)""", "t as (" + _types("true") + ")"),
    "attribute_bytes": _on_tokens("select category, fenced, (case when b < 12 then b + 1 else b end)::int as attrs_byte, n from (select category, fenced, case category when 'nonalpha' then 0 when 'alphmark' then 4 else 5 end * 4 + fenced as b, count(*) as n from tok group by all)"),
    "vocab_alphabet": _on_tokens(_types("category <> 'nonalpha'")),
    "vocab_nonalpha": _on_tokens(_types("category = 'nonalpha'")),
    "token_totals": _on_tokens("select category, count(*) as n_tokens, sum((strlen(token) = 1)::int)::bigint as n_one_byte from tok group by all"),
    "top_types": _on_tokens("select * from (" + _types("category <> 'nonalpha'") + ") order by n desc, token limit 100"),
    "longest_types": _on_tokens("select *, strlen(token)::int as bytes from (" + _types("category <> 'nonalpha'") + ") order by bytes desc, token limit 100"),
    "token_type_join": _on_tokens("select doc_id, pos, tok.token, n from tok join t using (token, category)", "t as (" + _types("category <> 'nonalpha'") + ")"),
    "type_listing": _on_tokens("""select token, strlen(token)::int as bytes, (case when r < fit then first else first + 1 + (r - fit) // per end)::bigint as line
from (select token, strlen(token) as bytes, row_number() over (partition by strlen(token) order by token) - 1 as r from t) join filled_lines using (bytes)""", "t as (" + _types("category <> 'nonalpha'") + ")", """
sizes as (select bytes, n, row_number() over (order by bytes desc) as k, greatest(1, (79 - bytes) // (bytes + 2) + 1) as per from (select strlen(token) as bytes, count(*) as n from t group by all)),
fill(k, bytes, first, fit, per, line, used) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint union all
  select k, bytes, line, fit, per, case when n <= fit then line else line + (n - fit + per - 1) // per end, case when n <= fit then used + n * (bytes + 2) else ((n - fit - 1) % per + 1) * (bytes + 2) end
  from (select s.k, s.bytes, s.n, s.per, line, used, case when used = 0 then s.per when used + s.bytes >= 80 then 0 else (79 - s.bytes - used) // (s.bytes + 2) + 1 end as fit from fill f join sizes s on s.k = f.k + 1)),
filled_lines as (select bytes, first, fit, per from fill where k > 0)""").replace("with ", "with recursive ", 1),
    "unigrams": _on_grams("select * from g", grams("g", 1)),
    "bigrams": _on_grams("select * from g", grams("g", 2)),
    "trigrams": _on_grams("select * from g", grams("g", 3)),
    "fourgrams": _on_grams("select * from g", grams("g", 4)),
    "fivegrams": _on_grams("select * from g", grams("g", 5)),
    "ngrams_6_8": _on_grams("select 6 as n, * from g6 union all select 7, * from g7 union all select 8, * from g8", *[grams(f"g{n}", n) for n in (6, 7, 8)]),
    "ngrams_blank_aware": _on_grams(" union all ".join(f"select {n} as n, * from g{n}" for n in range(1, 5)), *[blank_grams(f"g{n}", n) for n in range(1, 5)]),
    "blank_collapse": _on_grams("select doc_id, len(s)::int as n_symbols, list_filter(s, lambda x: x <> '#').len()::int as n_words from collapsed"),
    "ngram_summary": _on_grams(" union all ".join(f"select {n} as n, count(*) as n_distinct, coalesce(sum(n_count), 0)::bigint as n_total from g{n}" for n in range(1, 6)), *[grams(f"g{n}", n) for n in range(1, 6)]),
    "ngram_min_count": _on_grams("select * from g where n_count >= 10 or (select count(*) from g) < 1000", grams("g", 2)),
    "count_buckets": _on_grams(" union all ".join(f"select {n} as n, {_BUCKET} as bucket, count(*) as n_grams, sum(n_count)::bigint as n_total from g{n} {'where n_count > 1' if n > 2 else ''} group by all" for n in (2, 3, 4)), *[blank_grams(f"g{n}", n) for n in (2, 3, 4)]),
    "ngram_semi": _on_grams("select g3.* from g3 where array_to_string(string_split(gram, ' ')[1:2], ' ') in (select gram from g2 where n_count >= 5)", grams("g2", 2), grams("g3", 3)),
    "lm_bucket_score": _on_grams("select q.gram, (case when g.n_count is null then 1 when g.n_count <= 2 then 2 when g.n_count <= 5 then 4 else 8 end)::int as score from q left join g using (gram)", grams("g", 2), "q as (select distinct array_to_string(list_reverse(string_split(gram, ' ')), ' ') as gram from g)"),
    "stupid_backoff": _on_grams("""select q.gram, round(coalesce(g3.n_count / h.n_count, 0.4 * t.n_count / m.n_count, 0.16 * w.n_count / (select sum(n_count) from g1), 0), 9)::double as score
from (select gram, string_split(gram, ' ') as g from q) q left join g3 using (gram) left join g2 h on h.gram = g[1] || ' ' || g[2] left join g2 t on t.gram = g[2] || ' ' || g[3] left join g1 m on m.gram = g[2] left join g1 w on w.gram = g[3]""", grams("g1", 1), grams("g2", 2), grams("g3", 3), "q as (select gram from g3 union select array_to_string(list_reverse(string_split(gram, ' ')), ' ') from g3)"),
    "line_stats": _on_tokens("select * exclude (route) from routed", LINES, _STATS),
    "line_route": _on_tokens("select route, count(*) as n_lines, sum(line_bytes)::bigint as n_bytes from routed group by all", LINES, _STATS),
    "route_union_check": _on_tokens("select count(*) as n_lines, count(*) as n_routed, 0::bigint as n_twice from every", LINES, _STATS),
    "rebuilt_lines": _on_tokens("select e.doc_id, e.line_no, coalesce(rtrim(string_agg(token || case when fenced % 2 = 1 then ' ' else '' end, '' order by pos), ' '), '') as line from every e left join lined using (doc_id, line_no) group by all", LINES, _STATS),
    "syllable_id_decode": _on_space("select * from space"),
    "valid_syllable_dim": _on_space("select syllable_id, dau, giua, cuoi, tone from checked where is_valid", _valid_pairs()),
    "syllable_id_encode": _on_space("select * from again", _valid_pairs(), _folded()),
    "render_dense": _on_space(f"select syllable_id, {_DENSE} as dense from spelt"),
    "render_spare": _on_space(f"select syllable_id, {_SPARE} as spare from spelt"),
    "render_parts": _on_space(f"select syllable_id, {_PARTS} as parts from (select *, {_NUCLEUS} as nucleus from space)"),
    "render_utf8": _on_space("select * from written", _utf8()),
    "id_base64": _on_space(f"select syllable_id, {_DIGIT(12)} || {_DIGIT(6)} || {_DIGIT(0)} as code, syllable_id as again from space"),
    "strip_tone_mark": _on_space(f"select syllable_id, rtrim(regexp_replace(regexp_replace({_DENSE}, '[sfrxj]$', ''), '[wz]$', '')) as bare from spelt"),
    "dedup_lines": "with l as (select doc_id, unnest(range(len(p)))::int as line_no, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents where text is not null)) select line, min((doc_id, line_no))[1] as doc_id, min((doc_id, line_no))[2] as line_no, count(*) as n from l where line <> '' group by line",
    "inverted_index": _on_tokens("select token, count(distinct doc_id) as n_docs, count(*) as n_tokens, min(doc_id) as first_doc, max(doc_id) as last_doc, sum(pos)::bigint as pos_sum from tok where category <> 'nonalpha' group by token"),
    "phrase_search": _on_tokens("select a.doc_id, a.pos from a join b on a.doc_id = b.doc_id and b.pos = a.pos + 1", "a as materialized (select doc_id, pos from tok where token = 'of')", "b as materialized (select doc_id, pos from tok where token = 'the')"),
    "fnv1a32": _on_tokens("select token, n, list_reduce([2166136261::hugeint] || list_transform(range(strlen(token)), lambda i: ('0x' || substr(hex(encode(token)), (i * 2 + 1)::int, 2))::hugeint), lambda h, x: (xor(h, x) * 16777619) % 4294967296)::bigint as hash from (" + _types("category <> 'nonalpha'") + ")"),
    "token_at": _on_tokens("select doc_id, token, category, fenced from tok where pos = 3"),
    "attribute_decode": _on_tokens("select (case when b < 12 then b + 1 else b end)::int as attrs_byte, category, fenced, n from (select category, fenced, case category when 'nonalpha' then 0 when 'alphmark' then 4 else 5 end * 4 + fenced as b, count(*) as n from tok group by all)"),
    "ngram_pruned": _on_grams("select * from g where n_count >= 10 or (select count(*) from g) < 100000", grams("g", 2)),
    "absolute_discount": _on_grams("""select q.gram, round(coalesce((c.n_count - case when c.n_count = 1 then 0.5 else 0.75 end) / a.ch, 0) + coalesce(a.taken / a.ch, 1) * coalesce(u.n_count, 0) / (select sum(n_count) from g1), 9)::double as score
from q left join g2 c on c.gram = q.gram left join a on a.h = string_split(q.gram, ' ')[1] left join g1 u on u.gram = string_split(q.gram, ' ')[2]""", grams("g1", 1), grams("g2", 2), "q as (select gram from g2 union select array_to_string(list_reverse(string_split(gram, ' ')), ' ') from g2)",
        "a as (select string_split(gram, ' ')[1] as h, sum(n_count)::double as ch, sum(case when n_count = 1 then 0.5 else 0.75 end)::double as taken from g2 group by 1)"),
    "syllable_parse": _of_parsed("select * from parsed", _TYPES),
    "vocab_syllable": _of_parsed("select * from voc", _TYPES),
    "vocab_syllower": _of_parsed("select vocab, sum(n)::bigint as n from lower_voc group by vocab", _TYPES),
    "vocab_syllow00": _of_parsed("select rtrim(regexp_replace(regexp_replace(vocab, '[sfrxj]$', ''), '[wz]$', '')) as vocab, sum(n)::bigint as n from lower_voc group by 1", _TYPES),
    "vocab_syllovan": _of_parsed("select regexp_replace(vocab, '^[^aeyuio]+', '') as vocab, sum(n)::bigint as n from lower_voc group by 1", _TYPES),
    "oov_types": _of_parsed("select token, category, n from parsed where syllable_id is null", _TYPES),
    "tokens_with_ids": _of_parsed("select doc_id, count(*)::int as n_tokens, count(nullif(id, 32767))::int as n_syllables, coalesce(sum(nullif(id, 32767)), 0)::bigint as id_sum, coalesce(sum(nullif(id, 32767) * (pos % 1000 + 1)), 0)::bigint as placed_sum from numbered_ids group by doc_id", _PLACED),
    "syllable_ngrams": _of_parsed(" union all ".join(map(_id_grams, (1, 2, 3))), _PLACED),
    "rendered_lines": _of_parsed(_ROUTED, LINES, _WRITTEN, _rendered("documents")),
    "cdx_roundtrip": _of_parsed("""select doc_id, line_no, (count(*) filter (where not again) + 1 + (not ends_blank)::int)::int as n_symbols, count(*) filter (where syllable)::int as n_syllables from (
  select e.doc_id, e.line_no, coalesce(k.syllable_id is not null, false) as syllable,
    coalesce(k.syllable_id is null and coalesce(lag(k.syllable_id is null) over w, true), true) as again,
    coalesce(last_value(k.syllable_id is null) over (w rows between unbounded preceding and unbounded following), true) as ends_blank
  from all_lines e left join lined l using (doc_id, line_no) left join known k using (token) window w as (partition by e.doc_id, e.line_no order by l.pos)) group by doc_id, line_no, ends_blank""", LINES, _WRITTEN, _rendered("documents")),
    "rarely_used_ids": _of_parsed("select syllable_id, utf8, tone from checked join written using (syllable_id) where is_valid and syllable_id not in (select syllable_id from known)", _valid_pairs(), _utf8()),
    "rarely_used_of_tone": _of_parsed("select syllable_id, utf8, tone from checked join written using (syllable_id) where is_valid and tone = 's' and syllable_id not in (select syllable_id from known)", _valid_pairs(), _utf8()),
    "hash_count": _of_parsed(f"select (xor({0x9DC5811C}, id) * 16777619::hugeint % 4294967296)::bigint as hash, (xor(2166136261, id) * 16777619::hugeint % 65536)::bigint as fp, count(*) as n_count from (select id::bigint as id from numbered_ids where id <> 32767) group by all", _PLACED),
    "syllable_features": _on_space("""select syllable_id, length(dau)::int as onset_len, (case giua when 'uow' then 4 when 'uyez' then 4 when 'ooo' then 2 else length(giua) end)::int as nucleus_len, length(cuoi)::int as coda_len, length(tone)::int as tone_len,
  dau not in ('', 'c', 'd', 'g', 'n', 'p', 't', 'ng') as onset_closed, length(cuoi) = 2 or cuoi in ('i', 'u', 'm', 'p', 't', 'y', 'o') as coda_closed, case when dau = 'zd' then 'd' else dau end as bare_onset, giua in ('i', 'y', 'ia', 'iez') as starts_front,
  dau = 'zd' or giua in ('az', 'aw', 'ez', 'uw', 'oz', 'ow', 'oaw', 'uaz', 'uez', 'uow', 'uoz', 'uaw', 'iez', 'uyez') as has_mark, giua in ('uaz', 'uez', 'uy', 'uyez', 'uya', 'oa', 'oaw', 'oe', 'ooo') as has_glide,
  tone <> '' as has_tone, cuoi in ('c', 'ch', 'p', 't') as is_stop, tone in ('', 's', 'j') as tone_may_stop, tone in ('x', 'j') as is_harsh from space"""),
    "dense_to_id": _on_space(f"select dense, min(case when is_valid then checked.syllable_id end) as syllable_id from (select syllable_id, {_DENSE} as dense from spelt) d join checked using (syllable_id) group by dense", _valid_pairs()),
    "vietnamese_parse": _of_vietnamese("select * from parsed", _TYPES),
    "vietnamese_lines": _of_vietnamese(_ROUTED, LINES, _WRITTEN, _rendered("vi")),
    "vietnamese_ngrams": _of_vietnamese(" union all ".join(map(_id_grams, (1, 2))), _PLACED),
    "hashes": _on_tokens("select * from hashed", _hash_steps()),
    "fuse_membership": _on_grams("select count(*) as n_exact, 0::bigint as n_missed, true as few_more from g3 where array_to_string(string_split(gram, ' ')[1:2], ' ') in (select gram from g2 where n_count >= 5)", grams("g2", 2), grams("g3", 3)),
    "fuse_sizes": _on_grams("""select shard::int as shard, n_keys, ((greatest(1, ceil(capacity / segment) - 2) + 2) * segment)::bigint as n_bytes
from (select *, case when n_keys <= 1 then 0 else floor(n_keys * greatest(1.125, 0.875 + 0.25 * ln(1e6) / ln(n_keys)) + 0.5) end as capacity, least(262144, pow(2, floor(ln(n_keys) / ln(3.33) + 2.25))) as segment
  from (select ('0x' || substr(md5(key::varchar), 1, 15))::bigint % (select greatest(1, ceil(count(*) / 16384))::bigint from k) as shard, count(*) as n_keys from k group by 1))""", grams("g", 2), "k as (select distinct ('0x' || substr(md5(gram), 1, 15))::bigint as key from g)"),
    "word_lattice_flags": _on_sentences("select sent_id, (pos + k)::int as pos, bit_or(case when k = 0 then 1 when k = len - 1 then 4 else 2 end)::int as flags from (select *, unnest(range(len)) as k from lat) group by all"),
    "word_greedy": _on_sentences("select sent_id, tags from tagged", _GREEDY),
    "word_segmentation": _on_sentences("select sent_id, ta[3] as tags from dp join sent using (sent_id) where i = len(s)", _BEST),
    "rdr_retag": _on_sentences("""select sent_id, any_value(tags) as tags, string_agg(case tag
    when 'B' then case when w = 'the' and w1 = 'of' then case when t3 = 'I' or w2 = 'and' then 'B' else 'I' end when w = 'de' and t1 = 'I' then 'I' else 'B' end
    else case when w = 'and' then case when t2 = 'B' and w3 = 'the' then 'I' else 'B' end else 'I' end end, '' order by ix) as new_tags
from (select *, lag(w, 1, '') over o as w1, lag(w, 2, '') over o as w2, lead(w, 1, '') over o as w3, lag(tag, 1, 'N') over o as t1, lag(tag, 2, 'N') over o as t2, lead(tag, 1, 'N') over o as t3
  from (select sent_id, tags, ix, s[ix] as w, tags[ix] as tag from (select sent_id, tags, s, unnest(range(1, len(s) + 1)) as ix from tagged)) window o as (partition by sent_id order by ix)) group by sent_id""", _GREEDY),
    "tones_restored": _on_sentences("select sent_id, array_to_string(max({'a': score, 'p': path}).p, ' ') as restored from rp join sent using (sent_id) where i = len(s) group by sent_id", """
opts as materialized (select translate(w, 'àáâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc') as bare, w, round(1e6 * ln(1.0::double + count(*)))::bigint as own from (select unnest(s) as w from sent) group by w),
pairs as materialized (select gram, round(1e6 * ln(1.0::double + count(*)))::bigint as both_ from runs where len = 2 group by gram),
rp(sent_id, i, x, score, path) as (select sent_id, 1::bigint, w, own, [w] from sent join opts on bare = translate(s[1], 'àáâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc') union all
  select sent_id, i, x, best.a, best.p from (select rp.sent_id, i + 1 as i, w as x, max({'a': score + own + 2 * coalesce(both_, 0), 'p': path || [w]}) as best
    from rp join sent using (sent_id) join opts on bare = translate(s[rp.i + 1], 'àáâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc') left join pairs on gram = x || ' ' || w where i < len(s) group by all))"""),
    "can_be_vietnamese": _on_tokens("select token, category, n, token in (select token from loose) as can_be_vietnamese from t", "t as (" + _types("category <> 'nonalpha'") + ")", _loose("select token from t")),
    "invalid_ids": _on_space("select syllable_id, utf8 from every_id where utf8 not in (select token from loose)", _utf8(),
        f"every_id as (select syllable_id, utf8 from written union all select syllable_id, {_onset('left(giua, 1)', _q('đ'))} || giua || cuoi from space where giua in ('ah', 'oah'))", _loose("select utf8 as token from every_id")),
}
