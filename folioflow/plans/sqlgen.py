"""Expressions of the text functions in the SQL of the comparison engine.

They are written apart from the Spark ones, with the means of that engine: its regular expressions
have no lookaround, so cuts are marked with U+0001 first.
"""

from __future__ import annotations

from folioflow.functions import text as T

WS, NOT_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]", r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
# The rules for lines as patterns of this engine; END is the end of a word.
END = r"(?:[^\p{L}\p{M}\p{N}\p{Pc}]|$)"
_UNITS = "one|two|three|four|five|six|seven|eight|nine"
_TENS = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
HEADING_LINE = rf"(?i)^(?:(?:book|chapter|part|canto){WS}+(?:[0-9]+|[ivxlcdm]+|(?:{_UNITS}|{_TENS})(?:[ -](?:{_UNITS}))?)|prologue|epilogue|introduction|preface|foreword|afterword)$"
CHAPTER = rf"(?i)^(?:book|chapter|part|canto|prologue|epilogue|introduction|preface){END}"
OUTLINE = rf"(?i)^(?:(?:book|chapter|part|canto|prologue|epilogue|introduction|preface|foreword|afterword){END}|(?:[0-9]+|[ivxlcdm]+) ?(?:[-:–—]|$))"
START = rf"(?i)^(?:prologue|(?:book|chapter|part|canto) (?:0*1|one|i)){END}"
RUNNING = r"(?i)^(?:chapter|appendix|part)(?:\||[^|\p{L}\p{M}\p{N}\p{Pc}][^|]{0,23}\|)"
DICE, ROLL = r"(?i)^[0-9]*d[0-9]+\b", rf"^[0-9]+{WS}*(?:[-–—]{WS}*[0-9]+)?{WS}+"
TABLE_TAG = rf"(?i)<{WS}*(?:table|tr|td|th|thead|tbody)\b"
SPEAKER = rf"^[A-Z][a-zA-Z]+(?:{WS}[A-Z][a-zA-Z]+)?:{WS}+{NOT_WS}"
BLOCKS = "(SELECT DISTINCT * FROM blocks)"
JOBS = "(SELECT DISTINCT * FROM jobs)"
PLAN = "(SELECT DISTINCT * FROM chunk_plan)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})"


def match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def emphasis(x: str, passes: int) -> str:
    for _ in range(passes):
        x = sub(x, T.EMPHASIS, r"\1\2")
    return x


def strip_markdown(x: str) -> str:
    return collapse(sub(sub(strip(emphasis(x, 6)), rf"^#{{1,6}}{WS}*", "", ""), T.HTML_TAG, " "))


def lines(x: str) -> str:
    """A list of lines without the empty one after a last line end."""
    parts = f"string_split_regex({x}, {q(chr(92) + 'r' + chr(92) + 'n|[' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'x0b' + chr(92) + 'x0c' + chr(92) + 'x1c-' + chr(92) + 'x1e' + chr(92) + 'x{85}' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}]')})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:-2] ELSE {parts} END)"


def sentences(x: str) -> str:
    marked = sub(strip(x), rf"([.!?]){WS}+([A-Z\"'‘“])", r"\1" + "\x01" + r"\2")
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def clauses(x: str) -> str:
    return f"string_split({sub(x, rf'([,;]){WS}+', chr(92) + '1' + chr(1))}, chr(1))"


def number_list(x: str) -> str:
    s = strip(x)
    rest = sub(strip(sub(s, "^[-•]+", "", "")), rf"^[A-Za-z][A-Za-z0-9 ]{{0,15}}:{WS}*", "", "")
    words = f"list_filter(string_split_regex({rest}, {q(WS + '+')}), lambda w: w <> '')"
    numbers = f"len(list_filter({words}, lambda w: {match(sub('w', '^[.,;]+|[.,;]+$'), '^(?:[0-9]+|dead)$')}))"
    return f"({match(s, '^[-•]')} AND len({words}) > 0 AND {numbers} >= greatest(1, len({words}) // 2))"


def line_is_heading(x: str) -> str:
    m = strip_markdown(x)
    return f"(length({m}) BETWEEN 2 AND 60 AND NOT {match(m, '[.:,;]$')} AND {match(m, chr(92) + 'p{L}')} AND NOT {match(sub(m, chr(92) + 'p{Lu}'), chr(92) + 'p{L}')})"


def line_class(x: str) -> str:
    s, m = strip(x), strip_markdown(x)
    return f"""CASE WHEN {s} = '' THEN 'blank'
 WHEN {match(s, '^[0-9]{1,4}$')} THEN 'page_number'
 WHEN {match(m, RUNNING)} THEN 'running_header'
 WHEN NOT {match(sub(s, '<[^>]+>'), '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} THEN 'markup'
 WHEN {match(s, '^`{3,}[' + chr(92) + 'w-]*$')} THEN 'code_fence'
 WHEN {match(s, TABLE_TAG)} THEN 'html_table'
 WHEN starts_with({s}, '|') AND ends_with({s}, '|') AND length({s}) > 1 THEN 'table_row'
 WHEN {match(m, DICE)} THEN 'dice_header'
 WHEN {match(m, ROLL + NOT_WS)} THEN 'dice_row'
 WHEN {number_list(x)} THEN 'number_list'
 WHEN {line_is_heading(x)} THEN 'heading'
 WHEN {match(m, SPEAKER)} THEN 'dialogue'
 ELSE 'body' END"""


def quoted_ellipsis(x: str) -> str:
    """Spans taken and rewritten one pair of quotes after the other."""
    for a, b in T.QUOTE_PAIRS:
        span = f"{a}[^{a}{b}]*?{b}" if a != b else f"{a}[^{a}]*?{b}"
        spans = f"regexp_extract_all({x}, {q(span)})"
        inner = sub(sub("s[2:-2]", r"\.{2,}"), WS + "+$")
        new = f"list_transform({spans}, lambda s: {q(a)} || {inner} || {q(b)})"
        pieces = f"string_split({sub(x, span, chr(1))}, chr(1))"
        x = f"(SELECT string_agg(o || coalesce(s, ''), '' ORDER BY i) FROM (SELECT unnest(list_zip({pieces}, {new})) AS z, generate_subscripts({pieces}, 1) AS i) t, LATERAL (SELECT z[1] AS o, z[2] AS s))"
    return x
