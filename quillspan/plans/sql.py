"""DuckDB SQL fragments that say the same as the Catalyst expressions. Nothing of the engine is imported: all values are written out again."""

from __future__ import annotations

_UPPER = {"reference": "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПЁ", "cyrillic": "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"}
_LOWER = {"reference": "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопё", "cyrillic": "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"}
_SEPARATORS = "[ \\t\\n\\r.,!?:;\"'()\\[\\]{}<>/|\\\\*&^%$#@~`=-]+"
# Alternatives from the longest to the shortest, as the pattern takes the first that fits.
_REFLEXIVE = "ся|сь"
_ADJECTIVE = "ими|ыми|его|ого|ому|ему|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
_PARTICIPLE = "ивш|ывш|ующ|ем|нн|вш|ющ|щ"
_VERB = "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|ала|яла|ела|али|яли|ели|ало|яло|ело|ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ал|ял|ел|ю"
_NOUN = "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|а|е|и|й|о|у|ы|ь|ю|я"
_SUPERLATIVE = "ейше|ейш"
_DROPPED = ("script", "style", "header", "footer", "nav")
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_MARKERS = ("captcha", "recaptcha", "g-recaptcha", "доступ ограничен", "security check", "подтвердите, что вы не робот", "403 forbidden", "waf")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str, mode: str = "reference") -> str:
    return f"translate({x}, {quoted(_UPPER[mode])}, {quoted(_LOWER[mode])})"


#: Occurrences (doc_id, token) of all documents.
TOKENS = f"SELECT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array({fold('text')}, {quoted(_SEPARATORS)})) AS token FROM documents) WHERE token <> ''"

TITLE = "CASE WHEN text = '' THEN 'No Title' ELSE regexp_replace(split_part(text, chr(10), 1), '\\r$', '') END"


def stems(source: str, token: str = "token") -> str:
    """A relation (token, term) of the distinct tokens of ``source``."""

    def strip(relation: str, suffixes: str, when: str = "TRUE", flag: str | None = None) -> str:
        hit = f"regexp_extract(w, '({suffixes})$', 1)"
        ok = f"({when}) AND {hit} <> '' AND strlen(w) - strlen({hit}) > 4"
        extra = f", ({ok}) AS {flag}" if flag else ""
        return f"SELECT * EXCLUDE (w), CASE WHEN {ok} THEN left(w, length(w) - length({hit})) ELSE w END AS w{extra} FROM ({relation})"

    q = f"SELECT DISTINCT {token} AS token, {token} AS w FROM ({source})"
    q = strip(q, _REFLEXIVE)
    q = strip(q, _ADJECTIVE, flag="adj")
    q = strip(q, _PARTICIPLE, when="adj")
    q = strip(q, _VERB, when="NOT adj", flag="verb")
    q = strip(q, _NOUN, when="NOT adj AND NOT verb")
    q = strip(q, "и")
    q = f"SELECT * EXCLUDE (w), regexp_replace(w, '([^аеиоуыэюя])ость$', '\\1') AS w FROM ({q})"
    q = strip(q, _SUPERLATIVE)
    return f"SELECT token, w AS term FROM ({q})"


#: Occurrences (doc_id, place, token) in order, places from 0.
PLACED = f"SELECT doc_id, unnest(range(len(t)))::INTEGER AS place, unnest(t) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array({fold('text')}, {quoted(_SEPARATORS)}), lambda x: x <> '') AS t FROM documents)"

#: Distinct (term, doc_id) of all documents.
POSTINGS = f"SELECT DISTINCT s.term, t.doc_id FROM ({TOKENS}) t JOIN ({stems(TOKENS)}) s USING (token)"
#: (term, frequency) of all documents.
FREQUENCIES = f"SELECT s.term, count(*) AS frequency FROM ({TOKENS}) t JOIN ({stems(TOKENS)}) s USING (token) GROUP BY s.term"


def docs_with(term: str) -> str:
    return f"(SELECT doc_id FROM p WHERE term = {quoted(term)})"


def clean_html(x: str) -> str:
    text = f"coalesce({x}, '')"
    for tag in _DROPPED:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({decoded(text)}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def decoded(text: str) -> str:
    for name, char in _ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    return text


def page_article(x: str) -> str:
    text = f"regexp_extract({x}, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)"
    text = f"regexp_replace({text}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)</?(p|h1|h2|li|ul|br|div)\\b[^>]*>', chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '<[^>]*>', '', 'g'), ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({decoded(text)}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def normalize_url(x: str) -> str:
    bare = f"regexp_replace({x}, '(?s)#.*$', '')"
    pattern = r"'^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)?([^?]*)(\?.+)?\??$'"
    part = lambda k: f"regexp_extract({bare}, {pattern}, {k})"
    return f"lower({part(1)}) || regexp_replace({part(2)}, '(.)/$', '\\1') || {part(3)}"


def blocked(status: str, html: str) -> str:
    marks = " OR ".join(f"contains(lower(coalesce({html}, '')), {quoted(m)})" for m in _MARKERS)
    return f"(coalesce({status} = 403, FALSE) OR (length(coalesce({html}, '')) < 5000 AND ({marks})))"
