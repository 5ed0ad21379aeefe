"""SQL for DuckDB, put together from small pieces that mirror the column functions."""

from __future__ import annotations

from ..functions import clean, timex
from ..functions.keywords import STOPWORDS
from ..operators import profiles

#: White space as Unicode has it, for use inside a class; RE2's own is ASCII's.
WS = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chars(text: str) -> str:
    """A string of characters that can't stand in a literal as they are."""
    return "||".join(f"chr({ord(c)})" for c in text)


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def urls(x: str) -> str:
    return sub(sub(x, rf"https?://[^{WS}]+|ftp://[^{WS}]+"), rf"www\.[^{WS}]+")


def phones(x: str) -> str:
    return sub(x, r"1[3-9]\p{Nd}{9}")


def emojis(x: str) -> str:
    return sub(x, f"[{clean.ranges(clean.EMOJI_RANGES)}]+")


def garbled(x: str) -> str:
    x = f"translate({x}, {chars(clean.ZERO_WIDTH)}, '')"
    return sub(sub(x, "|".join(clean.MOJIBAKE)), f"[{clean.ranges(clean.GARBLED_RANGES)}]")


def symbols(x: str) -> str:
    return f"translate({sub(x, f'[{clean.ranges(clean.SYMBOL_RANGES)}]')}, {q(clean.SYMBOLS)}, '')"


def numbers(x: str) -> str:
    return f"translate({x}, '０１２３４５６７８９', '0123456789')"


def line_breaks(x: str) -> str:
    return f"translate({x}, {chars(clean.LINE_BREAKS)}, '')"


def emails(x: str) -> str:
    """Word boundaries are Unicode's: before the address one side is a word character and the other isn't, after it no word character stands.

    Two rounds, as a match takes the character after it along, which the next address needs before it.
    """
    word = r"\p{L}\p{N}\p{M}\p{Pc}"
    address = r"@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}"
    for _ in range(2):
        x = f"regexp_replace({x}, {q(rf'(?:(^|[^{word}])[A-Za-z0-9_][A-Za-z0-9._%+-]*|([{word}])[.%+-][A-Za-z0-9._%+-]*){address}([^{word}]|$)')}, {q(chr(92) + '1' + chr(92) + '2' + chr(92) + '3')}, 'g')"
    return x


def time_expressions(x: str) -> str:
    """Look-around becomes a character that is put back; two rounds, as above."""
    for rule in timex.TIME_RULES:
        plain = re2(rule.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace("(?![分秒])", ""))
        if "(?<!" in rule:
            for _ in range(2):
                x = f"regexp_replace({x}, {q(rf'(^|[^\p{{Nd}}])(?:{plain.replace('(', '(?:')})([^\p{{Nd}}]|$)')}, {q(chr(92) + '1' + chr(92) + '2')}, 'g')"
        elif "(?!" in rule:
            for _ in range(2):
                x = f"regexp_replace({x}, {q(rf'(?:{plain})([^分秒]|$)')}, {q(chr(92) + '1')}, 'g')"
        else:
            x = sub(x, plain)
    for word in timex.FUZZY.split():
        x = f"replace({x}, {q(word)}, '')"
    return x


def chinese_only(x: str) -> str:
    kept = r"\x{4E00}-\x{9FFF} " + clean.escaped(clean.CHINESE_PUNCTUATION) + r"\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
    return sub(x, f"[^{kept}]")


def entities(x: str) -> str:
    for entity, char in clean.ENTITIES.items():
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def latin(x: str) -> str:
    return sub(x, "[a-zA-Z]+")


def control(x: str) -> str:
    return sub(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]")


def collapse(x: str) -> str:
    for c in clean.COLLAPSED:
        x = sub(x, rf"\x{{{ord(c):x}}}{{2,}}", "\\\\" if c == "\\" else c)
    return x


def collapse_chinese(x: str) -> str:
    for c in clean.CHINESE_PUNCTUATION:
        x = sub(x, rf"\x{{{ord(c):x}}}{{2,}}", c)
    return x


def squeeze(x: str) -> str:
    return f"trim({sub(x, rf'[{WS}\x1c-\x1f]+', ' ')}, ' ')"


def strip(x: str) -> str:
    return sub(x, rf"^[{WS}\x1c-\x1f]+|[{WS}\x1c-\x1f]+$")


def clean_text(x: str, drop_latin: bool) -> str:
    x = entities(x)
    return squeeze(collapse(control(latin(x) if drop_latin else x)))


def re2(rule: str) -> str:
    return rule.replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{WS}]")


def date_expressions(x: str) -> str:
    for rule in timex.DATE_RULES:
        x = sub(x, re2(rule))
    for word in (timex.DAYS + " " + timex.PERIODS).split():
        x = f"replace({x}, {q(word)}, '')"
    for rule in timex.CYCLE_RULES:
        x = sub(x, re2(rule))
    return x


def steps(source: str, *expressions) -> str:
    """One subquery a step, as one expression of all of them would grow with every use of its input."""
    inner = f"SELECT request_id, text AS x FROM {source}"
    for e in expressions:
        inner = f"SELECT request_id, {e('x')} AS x FROM ({inner})"
    return inner


TIME = re2(timex.as_re2(timex.TIME_KEYWORD).replace(r"\p{Nd}", r"\d"))
DATE = re2(timex.as_re2(timex.DATE_KEYWORD).replace(r"\p{Nd}", r"\d"))


def is_time(x: str) -> str:
    return f"regexp_matches({x}, {q(TIME)})"


def is_date(x: str) -> str:
    return f"regexp_matches({x}, {q(DATE)})"


def is_stop(x: str) -> str:
    return f"{x} IN ({', '.join(map(q, STOPWORDS))})"


#: The shortest window that holds a keyword's characters in order, as a DuckDB macro would compute it.
def span(keyword: str, text: str) -> str:
    kw = f"replace({keyword}, ' ', '')"
    step = f"CASE WHEN p = 0 THEN 0 WHEN instr(substr({text}, (p + 1)::INT), c) = 0 THEN 0 ELSE p + instr(substr({text}, (p + 1)::INT), c) END"
    start = f"list_filter(range(1, length({text}) + 1), lambda i: substr({text}, i::INT, 1) = substr({kw}, 1, 1))"
    rest = f"list_transform(range(2, length({kw}) + 1), lambda i: ord(substr({kw}, i::INT, 1)))"
    last = f"list_reduce(list_prepend(s, {rest}), lambda p, c: {step.replace(', c)', ', chr(c::INT))')})"
    spans = f"list_filter(list_transform({start}, lambda s: CASE WHEN {last} > 0 THEN {last} - s + 1 ELSE -1 END), lambda z: z > 0)"
    return f"CASE WHEN length({kw}) = 0 OR length({text}) = 0 THEN -1 WHEN length({kw}) = 1 THEN CASE WHEN contains({text}, {kw}) THEN 1 ELSE -1 END ELSE coalesce(list_min({spans}), -1) END"


#: Analyses with their reviewer and product, and single deliveries of their keywords.
BASE = """
    a AS (SELECT analysis_id, a.request_id, reviewer_id, product_id, analysis_id AS seq, a.sentiment.label AS raw,
            CASE WHEN a.sentiment.label IS NULL THEN NULL WHEN a.sentiment.label IN ('positive', '正向') THEN 'positive'
                WHEN a.sentiment.label IN ('negative', '负向') THEN 'negative' ELSE 'neutral' END AS label
        FROM analyses a LEFT JOIN reviews r ON a.request_id = r.request_id),
    once AS (SELECT DISTINCT item_id, analysis_id, request_id, product_id, keyword, reasoning, score FROM keyword_items),
    k AS (SELECT o.item_id, o.analysis_id, o.request_id, a.reviewer_id, o.product_id, o.analysis_id AS seq, o.keyword,
            CASE WHEN isnan(o.score) THEN NULL ELSE o.score END AS score
        FROM once o LEFT JOIN a ON o.analysis_id = a.analysis_id)
"""

#: The cleaning tool, step by step, and the texts that it takes; blank ones fail.
TOOL_STEPS = (line_breaks, entities, control, collapse, squeeze, lambda x: f"substr({x}, 1, 512)", garbled, urls, emails, phones, emojis, symbols, numbers)
CLEANED = f"cleaned AS (SELECT request_id, x AS cleaned FROM ({steps('(SELECT request_id, text FROM reviews WHERE ' + squeeze('text') + " <> '')", *TOOL_STEPS)}))"


def tokens_of(source: str, text: str, name: str = "grams") -> str:
    """CTEs of the published tokens, with repeats: Latin words, and Chinese pieces of 2 to 4 characters."""
    return rf"""
        {name}_runs AS (SELECT request_id, unnest(regexp_extract_all(lower({text}), '[a-z]{{2,}}|[\x{{4e00}}-\x{{9fff}}]+')) AS run FROM {source}),
        {name} AS (SELECT request_id, run AS token FROM {name}_runs WHERE regexp_matches(run, '^[a-z]')
            UNION ALL SELECT request_id, substr(run, p::INT, n::INT) FROM (SELECT request_id, run, unnest(range(1, length(run) + 1)) AS p FROM {name}_runs WHERE NOT regexp_matches(run, '^[a-z]')), (VALUES (2), (3), (4)) AS sizes(n) WHERE p + n - 1 <= length(run))"""


def rejected(keyword: str, text: str, stopwords: bool) -> str:
    """Whether a keyword fails validation, repeats left aside."""
    bare = f"length(replace({keyword}, ' ', ''))"
    spanned = f"(span >= 0 AND span <= 2 * {bare})"
    return f"(length({keyword}) > 6 OR {is_time(keyword)} OR {is_date(keyword)}{' OR ' + is_stop(keyword) if stopwords else ''} OR ({text} <> '' AND NOT {spanned}))"


def ranked_tfidf(name: str, wanted: str, top: int = 8, corpus: str = "cleaned") -> str:
    """CTEs: the best tokens of the ``wanted`` texts of ``corpus``, with frequencies over all of it, and which of them pass validation."""
    return f"""
        {tokens_of(corpus, 'cleaned')},
        counts AS (SELECT request_id, token, count(*) AS n FROM grams GROUP BY ALL), sized AS (SELECT *, sum(n) OVER (PARTITION BY request_id) AS total FROM counts),
        idf AS (SELECT token, ln((SELECT count(*) FROM {corpus}) / count(*)) AS idf FROM counts GROUP BY token),
        weighted AS (SELECT request_id, token, round(n / total * idf, 6) AS weight FROM sized JOIN idf USING (token) WHERE request_id IN (SELECT request_id FROM {wanted})),
        best AS (SELECT request_id, token, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, token) AS rank FROM weighted QUALIFY rank <= {top}),
        spans AS (SELECT b.*, c.cleaned, {span('token', 'cleaned')} AS span FROM best b JOIN {corpus} c USING (request_id)),
        {name} AS (SELECT request_id, string_agg(token, '|' ORDER BY rank) AS keywords FROM spans WHERE NOT {rejected('token', 'cleaned', False)} GROUP BY request_id)"""


def rule_words(source: str, text: str, name: str = "ruled") -> str:
    """CTEs of the rule backend's keywords of each text, post-processed: ``request_id, place, keyword, score, kept`` and ``{name}`` of the eight first."""
    from ..operators.models import BLAME, PRAISE

    rows = ", ".join(f"({k}, {q(w)}, {s})" for k, (w, s) in enumerate([(w, 0.9) for w in PRAISE] + [(w, 0.8) for w in BLAME]))
    return f"""
        words(place, keyword, score) AS (VALUES {rows}),
        said AS (SELECT request_id, {text} AS text, place, keyword, score, {span('keyword', text)} AS span FROM {source}, words WHERE contains(lower({text}), keyword)),
        {name} AS (SELECT request_id, place, keyword, score FROM said WHERE NOT {rejected('keyword', 'text', True)} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, place) <= 8)"""


def felt(text: str) -> tuple[str, str]:
    """The rule backend's label and confidence for a text."""
    from ..operators.models import BLAME, PRAISE

    count = lambda ws: " + ".join(f"((length(lower({text})) - length(replace(lower({text}), {q(w)}, ''))) // {len(w)})" for w in ws)
    good, bad = f"({count(PRAISE)})", f"({count(BLAME)})"
    return f"CASE WHEN {good} > {bad} THEN 'positive' WHEN {good} < {bad} THEN 'negative' ELSE 'neutral' END", f"round(0.5 + least(0.49, abs({good} - {bad}) / 10), 2)"


def text_rank(words: str, rounds: int = 10, damping: float = 0.85, top: int = 8) -> str:
    """TextRank over co-occurrence within five words, round by round."""
    ctes = [words, """edges AS (SELECT a.request_id, least(a.token, b.token) AS a, greatest(a.token, b.token) AS b, count(*) AS w FROM words a JOIN words b ON a.request_id = b.request_id AND b.pos > a.pos AND b.pos < a.pos + 5 WHERE a.token <> b.token GROUP BY ALL),
        both_ways AS (SELECT request_id, a, b, w FROM edges UNION ALL SELECT request_id, b, a, w FROM edges), degree AS (SELECT request_id, a, sum(w) AS out FROM both_ways GROUP BY ALL),
        parts AS MATERIALIZED (SELECT request_id, a, b, w / out AS share FROM both_ways JOIN degree USING (request_id, a)), s0 AS (SELECT request_id, a AS token, 1.0::DOUBLE AS score FROM degree)"""]
    ctes += [f"s{k} AS MATERIALIZED (SELECT p.request_id, p.b AS token, {1 - damping} + {damping} * sum(p.share * s.score) AS score FROM parts p JOIN s{k - 1} s ON p.request_id = s.request_id AND p.a = s.token GROUP BY ALL)" for k in range(1, rounds + 1)]
    return f"WITH {', '.join(ctes)}, r AS (SELECT request_id, token, round(score / max(score) OVER (PARTITION BY request_id), 6) AS weight FROM s{rounds}) SELECT request_id, token, weight, row_number() OVER (PARTITION BY request_id ORDER BY weight DESC, token) AS rank FROM r QUALIFY rank <= {top}"


def sentiment_answers(source: str) -> str:
    """The sentiment of model answers in any of their shapes: the whole without fences, what the pattern finds, or from a brace to the last one.

    DuckDB's JSON allows a comma before a closing bracket, which isn't JSON, so such texts are told apart.
    """
    valid = r"json_valid(x) AND NOT regexp_matches(x, ',\s*[}\]]')"
    known = ", ".join(f"{q(k)}: {q(v)}" for k, v in profiles.LABELS.items())
    named = lambda x: f"map_extract_value(MAP {{{known}}}, {x})"
    return rf"""WITH t AS (SELECT turn_id, response.content AS raw, {strip('response.content')} AS s FROM {source}),
        f AS (SELECT turn_id, raw, CASE WHEN starts_with(s, '```') THEN {strip("replace(CASE WHEN starts_with(s, '```json') THEN replace(s, '```json', '') ELSE s END, '```', '')")} ELSE s END AS s, length(raw) - instr(reverse(raw), '}}') + 1 AS last FROM t),
        c AS (SELECT turn_id, list_filter(list_concat([s], regexp_extract_all(raw, '(?s)\{{[^{{}}]*"sentiment"\s*:\s*\[.*?\]\s*\}}')[1:1], CASE WHEN contains(raw, '}}') THEN list_transform(list_filter(range(1, length(raw) + 1), lambda k: substr(raw, k::INT, 1) = '{{'), lambda k: substr(raw, k::INT, (last - k + 1)::INT)) ELSE [] END), lambda x: {valid})[1] AS found FROM f),
        v AS (SELECT turn_id, found::JSON AS v, json_type(found) = 'OBJECT' AS object FROM c),
        d AS (SELECT *, v->'sentiment' AS data, json_type(v->'sentiment') AS kind, json_type(v->'sentiment'->0) AS head FROM v),
        e AS (SELECT *, CASE WHEN head = 'ARRAY' THEN data->0 ELSE data END AS triple FROM d), g AS (SELECT *, object AND kind = 'ARRAY' AND json_array_length(triple) >= 3 AND head IN ('ARRAY', 'VARCHAR') AS whole FROM e)
        SELECT turn_id, CASE WHEN object THEN CASE WHEN whole THEN coalesce({named("triple->>1")}, 'neutral') WHEN kind = 'VARCHAR' THEN coalesce({named("data->>'$'")}, data->>'$') ELSE coalesce({named("v->>'label'")}, 'neutral') END END AS label,
            CASE WHEN object THEN coalesce(TRY_CAST(CASE WHEN whole THEN triple->>2 ELSE v->>'confidence' END AS DOUBLE), 0.5) END AS confidence, CASE WHEN object THEN CASE WHEN whole THEN triple->>0 ELSE coalesce(v->>'reasoning', '') END END AS reasoning FROM g"""
