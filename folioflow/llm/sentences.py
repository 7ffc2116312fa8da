"""Problem 2: sentences across languages and scripts.

A text is cut at line breaks; within a line every place where a sentence may end (a mark, in Thai a blank) is a
node, and a semi-Markov dynamic programme picks the sequence of whole spans with the best
sum of scores.  A node's score joins the closing words and the mark before it (abbreviation, initial, number, ellipsis) with the
words that follow; a span's score, never above 0, joins its length, its opening and closing words and whether its
brackets and quotations are balanced.  A node whose score is below ``-LEAST_SPAN``, what a span can lose at most, is in no best sequence
and is left out beforehand; going back from a node stops where no span can win any more.
"""

from __future__ import annotations

import math
import re
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import map_columns, spoken_blocks
from folioflow.llm.lookalike import IGNORABLE_CHARS, fold_script
from folioflow.sources.tables import jobs_once

# Abbreviations (without their stops) that a sentence goes on after.
NEVER_END = set(
    """mr mrs ms dr prof st mt gen col capt lt sgt rev hon fr no nos vol fig pp p cf vs viz e.g i.e eg ie
    nr bd abb vgl hr fr frl bzw ca z.b d.h u.a s.o s.u z.t sog evtl ggf inkl tel
    m mm mme mlle mgr env av apr p.ex c.-à-d chap éd art
    sr sra srta dra d dña ud uds p.ej pág págs núm cap aprox
    т т.е т.к т.н см ср ул им напр стр гл рис г-н г-жа проф акад
    डॉ श्री प्रो पं कु""".split()
)
# Abbreviations that may also stand at a sentence's end.
MAY_END = set("""a.m p.m am pm u.k u.s u.s.a e.u etc co inc ltd corp jr bros dept usw u.s.w etw ej г гг руб коп тыс т.д т.п др н.э вв jh s bc ad b.c a.d ave blvd str""".split())
# Words that open a phrase rather than a whole sentence.
OPENERS = set("at in on by before after until since from around about near um am im gegen vor nach seit à vers avant après a hacia antes sobre в до после около к".split())
# Words that no sentence ends with.
LINKS = set("the a an and or of to with for der die das und oder mit le la les et ou de du des el los las y o con и или с".split())
# Verbs of reporting clauses.
REPORTING = set(
    """said asked called cried replied answered whispered shouted muttered added continued exclaimed inquired murmured yelled remarked
    sagte fragte rief antwortete flüsterte meinte erwiderte schrie
    dit demanda répondit cria murmura ajouta s'écria reprit
    dijo preguntó respondió gritó exclamó murmuró añadió contestó
    сказал сказала спросил спросила ответил ответила крикнул крикнула прошептал прошептала воскликнул""".split()
)
HINDI_REPORTING = re.compile("कहा|पूछा|बोला|बोली|बताया|चिल्लाया|उत्तर दिया|जवाब दिया")
CHINESE_REPORTING = re.compile("[说說问問道喊叫答]")
# Months after a German ordinal, and words before one.
MONTHS = set("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
BEFORE_ORDINAL = set("am der dem den des vom zum im beim die das bis ab".split())

# Opening and closing quotation marks of the scripts.
QUOTES = [("“„", "”"), ("«‹", "»›"), ("「『", "」』")]
CLOSING = "”»›)\\]’'\"」』）】》〉}"
_END = re.compile(rf"(?:[.!?…।॥]+|[。！？])[。！？.!?…]*(?:[{CLOSING}]|[      ]+[»›])*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_THAI = re.compile(r"[฀-๿]")
_THAI_BLANK = re.compile(r"\s+")
_LAST_WORD = re.compile(r"[^\s(\[{“”„\"«»‘,;:]+$")
_NEXT = re.compile(r"[\s“”„\"«»‘'’(\[{¿¡‹›—–-]*")
_NEXT_WORDS = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_IGNORE = re.compile(f"[{IGNORABLE_CHARS}]")
_DOTTED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]\.[  ]?)+[^\W\d_]$")
#: What a span's score can't fall below, and scores of nodes: no end at all, hardly one, an end.
LEAST_SPAN = -18.0
_NEVER, _HARDLY, _SURE = LEAST_SPAN - 2.0, -7.0, 6.0
#: Median length of a sentence in words (in signs where blanks don't divide words), the spread of its logarithm, and the most that a length costs.
LENGTHS = {"words": 9.0, "cjk": 18.0, "thai": 40.0}
SPREAD, LENGTH_COST = 0.9, 1.5


_NOT_BLANK, _CJK_STOP, _HINDI_STOP = re.compile(r"\S|$"), re.compile(r"[。！？!?…]|$"), re.compile(r"[।॥?!.]|$")
_NO_WORD = re.compile(r"[\s(\[{“”„\"«»‘,;:]")


def _upto(stop: re.Pattern, line: str, at: int) -> str:
    """The line from ``at`` to the next stop."""
    return line[at : stop.search(line, at).start()]


def _word_before(line: str, at: int) -> str:
    """The last word before ``at``, divided by blanks only; empty if there is none."""
    end = at
    while end and line[end - 1].isspace():
        end -= 1
    first = end
    while first and not line[first - 1].isspace():
        first -= 1
    return line[first:end]


def _dotted_from(line: str, at: int) -> int:
    """Where the letters with stops that end before ``at`` may begin."""
    while at and (line[at - 1].isalpha() or line[at - 1] in ". \u00a0\u202f") and not (at > 1 and line[at - 1].isalpha() and line[at - 2].isalpha()):
        at -= 1
    return max(0, at - 1)


def _evidence(line: str, start: int, end: int, cjk: bool) -> tuple[float, bool]:
    """(score of an end here, whether the mark is weak) from the words on both sides."""
    mark = line[start:end]
    stop = mark.rstrip(CLOSING.replace("\\", "") + "“      ")
    closed = mark[len(stop) :].strip()
    after = line[end : end + 1]
    wide = stop[-1] in "。！？"
    if not after:
        return _SURE, False
    ellipsis = stop[0] == "…" or (len(stop) > 1 and set(stop) <= {".", "…"})
    if ellipsis and (cjk or wide):
        return _NEVER, True
    quote = any(c in "”»›’'\"」』“" for c in closed)
    if cjk:
        if stop[0] == ".":
            if not after.isspace() or line[max(0, start - 1)].isdigit() and _NOT_BLANK.search(line, end).group().isdigit():
                return _NEVER, True
        if quote:
            if after in "とってい":
                return _HARDLY, False
            clause = _upto(_CJK_STOP, line, end)
            if not re.search("[「『“]", clause) and (CHINESE_REPORTING.search(clause) and not re.search("[，、,]", clause)):
                return _HARDLY, False
            if after in "，、,":
                return _NEVER, False
        return _SURE, False
    if not after.isspace() and not wide and stop[0] not in "।॥":
        # a mark inside a word, number or address, or before a comma
        if not (after in "“„«(¿¡「" and not closed):
            return _NEVER, True
    nxt = _NEXT.match(line, end).end()
    lead, head = line[end:nxt], line[nxt : nxt + 1]
    if re.match(r"\s*[—–-]\s", lead) and quote:
        return _HARDLY, False
    if not head:
        return (_SURE, False) if not lead.strip("—–- ") else (_NEVER, False)
    if head in ",;:.!?…":
        return _NEVER, True
    opens = any(c in "“„«\"(¿¡‘" for c in lead)
    if quote and not opens:
        if head.islower():
            return _HARDLY, False
        if not head.isupper() and not head.isdigit():  # scripts without capitals
            clause = _upto(_HINDI_STOP, line, end)
            if HINDI_REPORTING.search(clause) and not re.search("[“\"]", clause):
                return _HARDLY, False
            return _SURE, False
        if stop[-1] in "!?…":
            words = [m.group().lower() for m in islice(_NEXT_WORDS.finditer(line, nxt), 3)]
            if any(w in REPORTING for w in words):
                return _HARDLY, False
        return _SURE, False
    if head.islower():
        return (_NEVER, True) if not opens or stop[-1] == "." else (3.0, False)
    if ellipsis:
        return (4.0, False) if head.isupper() or opens else (_NEVER, True)
    if stop != ".":
        return _SURE, False
    if closed:
        return _SURE, False
    first = start
    while first and not _NO_WORD.match(line[first - 1]):
        first -= 1
    last = line[first:start].lower()
    if last not in NEVER_END and len(last) == 1 and last.isalpha() and (d := _DOTTED.search(line, _dotted_from(line, start), start)):
        last = re.sub(r"\s", "", d.group().lower())  # z. B., т. е., p. ej.
    if not last:
        return 0.0, True
    if last in NEVER_END:
        return _NEVER, True
    if last in MAY_END:
        return 1.0, True
    if last[-1].isdigit():
        ahead = _NEXT_WORDS.match(line, nxt)
        before = _word_before(line, first)
        if not before or ahead and ahead.group().lower() in MONTHS:
            return _NEVER, True
        if before.lower() in BEFORE_ORDINAL and last.isdigit():
            return -2.0, True
        return 3.0, True
    if len(last) == 1 and last.isalpha():
        return (-4.0, True) if line[start - 1].isupper() or line[start - 1].islower() else (3.0, True)
    if "." in last and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", last):
        return 0.5, True
    return _SURE, False


def _length_cost(size: int, unit: str) -> float:
    """How unusual a length is: up to LENGTH_COST."""
    return min(LENGTH_COST, 0.15 * (math.log(max(1, size) / LENGTHS[unit]) / SPREAD) ** 2)


def _span_score(line: str, a: int, b: int, weak: bool, unit: str = "words") -> float:
    """How well line[a:b] makes a sentence by itself, from LEAST_SPAN to 0."""
    span = line[a:b]
    words = span.split()
    if not words:
        return -9.0
    score = -_length_cost(len(words) if unit == "words" else b - a, unit)
    first = words[0].lstrip("“„\"«‘'(¿¡")
    if first[:1].islower() and a:
        score -= 2.0
    if weak and unit == "words":
        if len(words) <= 3:
            score -= 3.0
        if first.lower() in OPENERS and len(words) <= 4:
            score -= 3.0
    if words[-1].rstrip(".!?…").lower() in LINKS:
        score -= 2.0
    if span.count("(") > span.count(")"):
        score -= 2.0
    for opening, closing in QUOTES:  # a quotation may hold several sentences, so this counts for little
        if sum(map(span.count, opening)) != sum(map(span.count, closing)):
            score -= 0.25
    return score


def _nodes(line: str, size: int) -> tuple[list[tuple[int, float, bool]], str]:
    """((place, score, weak) of every place where a sentence may end before the line does, unit of length)."""
    if _THAI.search(line):
        nodes = []
        for m in _THAI_BLANK.finditer(line, 0, size):
            a, b = m.span()
            if a:
                number = line[a - 1].isdigit() or line[b].isdigit()
                nodes.append((a, _NEVER if line[a - 1] in ":：" else _HARDLY if number else _SURE, False))
        return nodes, "thai"
    cjk = bool(_CJK.search(line))
    nodes = []
    for m in _END.finditer(line, 0, size):
        end = m.end()
        if line[end : end + 1] == "“" and line.count("„", 0, end) > line.count("“", 0, end):
            end += 1  # “ closes what „ opened
        if end >= size:
            break
        nodes.append((end, *_evidence(line, m.start(), end, cjk)))
    return nodes, "cjk" if cjk else "words"


def _line_ends(line: str) -> list[int]:
    """Ends of the sentences of one line without invisible characters."""
    size = len(line.rstrip())
    if not size:
        return []
    nodes, unit = _nodes(line, size)
    kept = [n for n in nodes if n[1] >= LEAST_SPAN]
    return _best(line, 0, size, kept, unit) if kept else [size]


def _best(line: str, base: int, end: int, nodes: list[tuple[int, float, bool]], unit: str = "words") -> list[int]:
    """The semi-Markov programme over the nodes of line[base:end]."""
    at = [(base, 0.0, False), *nodes, (end, 0.0, False)]
    best: list[tuple[float, int]] = [(0.0, -1)]
    most = [0.0]  # the best score up to each node; a span's own score is never above 0, so what is below the bound can't win
    for j in range(1, len(at)):
        top, back = -1e18, 0
        for i in range(j - 1, -1, -1):
            if most[i] + at[j][1] <= top:
                break
            start = at[i][0]
            while start < at[j][0] and line[start].isspace():
                start += 1
            got = best[i][0] + at[j][1] + _span_score(line, start, at[j][0], at[j][2], unit)
            if got > top:
                top, back = got, i
        best.append((top, back))
        most.append(max(most[-1], top))
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(at[j][0])
        j = best[j][1]
    return ends[::-1]


def sentence_ends(text: str) -> list[int]:
    """Code points of ``text`` up to the end of each sentence."""
    places = None
    plain = text
    if not text.isascii():
        if _IGNORE.search(text):
            keep = [i for i, ch in enumerate(text) if not _IGNORE.match(ch)]
            places, plain = keep, "".join([text[i] for i in keep])
        plain = fold_script(plain)
    out, at = [], 0
    for line in plain.split("\n"):
        out += [at + e for e in _line_ends(line)]
        at += len(line) + 1
    return [places[e - 1] + 1 for e in out] if places is not None else out


def _ends(blocks: DataFrame) -> DataFrame:
    def cut(c: dict[str, list]) -> dict[str, list]:
        return {"book": c["book"], "block_no": c["block_no"], "ends": [sentence_ends(t) for t in c["text"]]}

    return map_columns(blocks, cut, "book string, block_no int, ends array<int>")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, end_pos) of the sentences of spoken blocks in prose jobs with path A.

    Null and blank texts have no row, a block stored twice counts once.
    """
    jobs = jobs_once(spark, sf_dir, "path", "style").where((F.col("path") == "A") & (F.col("style") == "prose")).select("book")
    blocks = spoken_blocks(spark, sf_dir).join(jobs, "book", "left_semi")
    once = _ends(blocks).dropDuplicates(["book", "block_no"])
    return once.select("book", "block_no", F.explode("ends").alias("end_pos"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, sentence_no, end_pos, text) of every body or dialogue block.

    sentence_no counts from 1 within the block; text is trimmed.
    """

    def cut(c: dict[str, list]) -> dict[str, list]:
        rows = []
        for t in c["text"]:
            last, row = 0, []
            for k, e in enumerate(sentence_ends(t), 1):
                row.append({"sentence_no": k, "end_pos": e, "text": t[last:e].strip()})
                last = e
            rows.append(row)
        return {"book": c["book"], "block_no": c["block_no"], "s": rows}

    blocks = spoken_blocks(spark, sf_dir)
    kind = "book string, block_no int, s array<struct<sentence_no:int,end_pos:int,text:string>>"
    return map_columns(blocks, cut, kind).dropDuplicates(["book", "block_no"]).select("book", "block_no", F.inline("s"))
