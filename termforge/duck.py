"""Pieces of the SQL that the queries are held against, in DuckDB's dialect, written apart from the plans in operators/."""

from __future__ import annotations

from .functions import patterns as P
from .functions.patterns import Profile

# What RE2 has only for ASCII is spelt out.
WORD_GAP = r"[^\p{L}\p{N}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, flags: str = "") -> str:
    return q((f"(?{flags})" if flags else "") + pattern.replace(r"[\W_]", WORD_GAP))


def meets(c: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({c}, {rx(pattern, flags)})"


def sub(c: str, pattern: str, by: str, flags: str = "") -> str:
    return f"regexp_replace({c}, {rx(pattern, flags)}, {q(by)}, 'g')"


def strip(c: str) -> str:
    return sub(c, r"^\s+|\s+$", "")


def squeeze(c: str) -> str:
    return sub(c, r"\s+", " ")


def normalize(c: str) -> str:
    quotes = f"translate(nfc_normalize({c}), '‘’‚‛“”„‟', {q(chr(39) * 4 + chr(34) * 4)})"
    dotless = f"regexp_replace({quotes}, '([A-Z])[.,]+', '\\1', 'g')"
    return f"lower({strip(squeeze(f'replace({dotless}, {q("-")} || chr(10), {q("")})'))})"


def spacing(c: str) -> str:
    parts = f"list_zip(regexp_split_to_array({c}, {rx(P.SPACED)}), regexp_extract_all({c}, {rx(P.SPACED)}))"
    return f"array_to_string(list_transform({parts}, lambda z: z[1] || replace(coalesce(z[2], ''), ' ', '')), '')"


def citations(c: str, citation: str) -> str:
    return f"regexp_replace({strip(squeeze(sub(c, citation, ' ', 'i')))}, ' \\.$', '.')"


def gibberish(c: str) -> str:
    clean = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g')"
    letters = f"length(regexp_replace({clean}, '[^\\p{{L}}]', '', 'g'))"
    vowels = f"length(regexp_replace({clean}, '[^aeiouAEIOU]', '', 'g'))"
    tests = (meets(clean, "[bcdfghjklmnpqrstvwxyz]{7}"), meets(clean, r"[A-Za-z]\d[A-Za-z]|\d[A-Za-z]{4}"), meets(c, r"^[$%*@#^~`¥|\[\]{}\\<>]"), f"({letters} > 10 AND {vowels} / {letters} < 0.12)", meets(c, r"\S{36}"))
    return f"(length({c}) >= 3 AND ({' OR '.join(tests)}))"


def clean_term(c: str) -> str:
    inner = f"trim({strip(c)}, ':,; ')"
    return f"(CASE WHEN starts_with({inner}, '(') AND ends_with({inner}, ')') AND length({inner}) > 2 THEN {strip(f'{inner}[2:-2]')} ELSE {inner} END)"


def valid_term(term: str, has: str, profile: Profile) -> str:
    bad = (f"(length({term}) > 100 AND NOT {has})", f"length({term}) < 2", meets(term, r"^[\d.,+-]+$"), f"(ends_with({term}, '.') AND length({term}) < 4)", meets(term, f"^{P.LOWER_STOP}$"), meets(term, profile.invalid_match(), "i"))
    return f"NOT ({' OR '.join(bad)})"


def fragment(c: str) -> str:
    tokens = f"regexp_split_to_array({strip(c)}, '\\s+')"
    return f"({meets(c, r'^\p{Ll}')} AND (len({tokens}) >= 4 OR {meets(c, '[,;:]')} OR {meets(f'lower(rtrim({tokens}[-1], {q(".,;:")}))', f'^{P.TAIL_STOP}$')}))"


def terminal(c: str) -> str:
    return meets(c, r"[!.?][\x22)\]]?\s*$")


def lines(profile: Profile, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to `valid`: a plain text's lines that stay, thirty to a page."""
    return f"""
raw AS (SELECT CAST({key} AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM {table}),
placed AS (SELECT doc_id, n, n // 30 AS page_idx, {strip('line')} AS line FROM raw),
valid AS (SELECT * FROM placed WHERE line <> '' AND NOT {meets('line', profile.invalid_match(), 'i')})"""


def entries(profile: Profile, table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to `best`: the deduplicated glossary entries of plain texts, by the textual gate."""
    part = f"regexp_extract(line, {rx(P.SPLIT)}, %d)"
    return lines(profile, table, key) + f""",
cut AS (SELECT *, {meets('line', P.SPLIT)} AS splits, {clean_term(part % 1)} AS cand, {strip(part % 3)} AS def FROM valid),
gate AS (SELECT *, coalesce(splits AND {valid_term('cand', "def <> ''", profile)} AND NOT {meets('cand', P.LEADING_STOP, 'i')}, false) AS starts FROM cut),
""" + entry_tail(profile)


def entry_tail(profile: Profile) -> str:
    """CTEs from `gate` (doc_id, page_idx, n, line, cand, def, starts) up to `best`."""
    return f"""island AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id, page_idx ORDER BY n) AS no FROM gate),
joined AS (SELECT doc_id, page_idx, no, max(cand) FILTER (WHERE starts) AS term, string_agg(CASE WHEN starts THEN def ELSE line END, ' ' ORDER BY n) AS def FROM island WHERE no > 0 GROUP BY doc_id, page_idx, no),
tidy AS (SELECT doc_id, page_idx, no, term, {citations(spacing(strip('def')), profile.citation)} AS def FROM joined),
kept AS (SELECT * FROM tidy WHERE def <> '' AND length(def) <= 5000 AND NOT {gibberish('def')}),
prior AS (SELECT *, lag(def) OVER (PARTITION BY doc_id, page_idx ORDER BY no) AS before FROM kept),
fold AS (SELECT *, coalesce(before IS NOT NULL AND NOT {terminal('before')} AND {fragment('term')}, false) AS folded FROM prior),
grouped AS (SELECT *, sum(CASE WHEN folded THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_idx ORDER BY no) AS g FROM fold),
merged AS (SELECT doc_id, page_idx, min(no) AS no, arg_min(term, no) AS term, {strip("string_agg(CASE WHEN folded THEN term || ' ' || def ELSE def END, ' ' ORDER BY no)")} AS definition FROM grouped GROUP BY doc_id, page_idx, g),
named AS (SELECT *, {normalize('term')} AS term_normalized FROM merged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term_normalized ORDER BY page_idx, no) AS r FROM named WHERE term_normalized <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, no) AS ord FROM ranked WHERE r = 1)"""


def first_word(c: str) -> str:
    return f"regexp_extract({c}, '^\\s*(\\S+)', 1)"


def acronym_line(c: str) -> str:
    w = first_word(c)
    return f"(length({c}) BETWEEN 1 AND 60 AND regexp_matches({w}, '{P.ACRONYM}') AND (regexp_matches({w}, '[A-Z]\\.[A-Z]') OR NOT contains(substr({c}, 1, 30), '.')))"


def starred(c: str) -> str:
    rest = f"regexp_replace({c}, '^\\*+\\s*', '')"
    return f"CASE WHEN starts_with({c}, '*') AND {rest} <> '' THEN {rest} ELSE {c} END"


def spatial_gate(profile: Profile, legacy: bool = False) -> str:
    """CTEs from `spans` (doc_id, page_idx, n, y, x, bold, text) up to `gate`: the new-term gate by place and type of the first
    span, and a term that goes on over spans of a term's style."""
    gate = "x < mx + 30" if legacy else "(x < mx + 30 AND (bs[1] OR acr)) OR (x < mx + 80 AND acr)"
    stop = f"(NOT (bs[i] OR regexp_matches({first_word('ts[i]')}, '{P.ACRONYM}')) OR regexp_matches(ts[i], '[!.?]\\s+[a-z]') OR starts_with(ts[i], '('))"
    part = f"regexp_extract(head, {rx(P.SPLIT)}, %d)"
    return f"""
phys AS (SELECT doc_id, page_idx, y AS n, list(text ORDER BY x, n) AS ts, list(bold ORDER BY x, n) AS bs, min(x) AS x, string_agg(text, ' ' ORDER BY x, n) AS line FROM spans GROUP BY doc_id, page_idx, y),
zone AS (SELECT *, {meets('line', P.any_of(profile.document_headers), 'i')} AS hd, {meets('line', profile.footer_match(), 'i')} AS ft, {acronym_line(strip('line'))} AS acr FROM phys WHERE NOT {meets('line', profile.invalid_match(), 'i')}),
stay AS (SELECT *, min(x) OVER (PARTITION BY doc_id, page_idx) AS mx FROM zone WHERE NOT (n < 150 AND hd) AND NOT (n > 792 * 0.88 AND (ft OR hd))),
walk AS (SELECT *, coalesce(nullif(list_position([{stop} for i in range(2, len(ts) + 1)], true), 0), len(ts)) AS k FROM stay),
heads AS (SELECT *, {strip("array_to_string(ts[1:k], ' ')")} AS head, array_to_string(ts[k + 1:], ' ') AS tail FROM walk),
halves AS (SELECT *, {meets('head', P.SPLIT)} AND length({strip(part % 1)}) < 50 AS halved FROM heads),
terms AS (SELECT *, {clean_term(f"CASE WHEN halved THEN {strip(part % 1)} ELSE head END")} AS marked, CASE WHEN halved THEN {strip(part % 3)} ELSE '' END AS own FROM halves),
clean AS (SELECT *, {starred('marked')} AS cand FROM terms),
gate AS (SELECT doc_id, page_idx, n, line, cand, array_to_string(list_filter([own, tail], lambda t: t <> ''), ' ') AS def, ({gate}) AND {valid_term('cand', "own <> ''", profile)} AS starts FROM clean)"""


def pages(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs up to `pages`: plain texts as pages of thirty lines."""
    return f"""
pl AS (SELECT CAST({key} AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS ls FROM {table}),
pp AS (SELECT doc_id, ls, unnest(range(CAST(ceil(len(ls) / 30) AS BIGINT))) AS page_idx FROM pl),
page AS (SELECT doc_id, CAST(page_idx AS INTEGER) AS page_idx, array_to_string(ls[page_idx * 30 + 1 : page_idx * 30 + 30], chr(10)) AS text FROM pp)"""


def ranges(profile: Profile) -> str:
    """CTEs up to `span`: the glossary ranges of `page`."""
    return f"""
hit AS (SELECT doc_id, page_idx, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS run FROM page WHERE {meets('text', P.any_of(profile.headers), 'im')}),
block AS (SELECT doc_id, min(page_idx) AS s, max(page_idx) AS l, count(*) AS pages FROM hit GROUP BY doc_id, run),
pick AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, s DESC) AS r FROM block) WHERE r = 1),
total AS (SELECT doc_id, max(page_idx) + 1 AS n FROM page GROUP BY doc_id),
stop AS (SELECT p.doc_id, min(p.page_idx) - 1 AS e FROM page p JOIN pick k ON p.doc_id = k.doc_id JOIN total t ON t.doc_id = p.doc_id WHERE p.page_idx > k.s AND ({meets('p.text', P.RANGE_END, 'im')} OR ({meets('p.text', P.BACK_COVER, 'i')} AND t.n - p.page_idx <= 3)) GROUP BY p.doc_id),
span AS (SELECT k.doc_id, k.s, coalesce(x.e, t.n - 1) AS e, t.n FROM pick k JOIN total t ON t.doc_id = k.doc_id LEFT JOIN stop x ON x.doc_id = k.doc_id)"""
