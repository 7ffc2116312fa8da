"""Problem 1: noise in text that was read from scanned pages.

A vocabulary is counted over all scanned text and kept as a trie.  A word outside
it is run as a Levenshtein automaton, whose edits are the misreadings of scanners
(and, for the repair of a word judged misread, one free edit), over that trie: the walk visits only the nodes
that both accept, so every candidate is found.  Candidates are ranked by
edits, by the words beside them and by how common they are.  Page furniture
(page numbers, running headers) is cut, divided words are joined and lines are reflowed.

The vocabulary holds the words whose share of all words is at least ``MIN_SHARE``,
so it has at most 1 / MIN_SHARE words whatever the size of the corpus: that is the
bound of what is broadcast.  Names and other rarer words are compared with the words of
their own book, by a join on (book, skeleton), and with all words of the corpus that
occur ``MIN_COUNT`` times but are below the share, by a join on ``reading_key``.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import kept, map_columns, sent_if_small, token
from folioflow.llm.lookalike import IGNORABLE_CHARS, fold_script
from folioflow.sources.tables import checkpointed, jobs_once, table

#: A word belongs to the vocabulary from this share of all words on (so at most 500,000 words).
MIN_SHARE = 2e-6
MIN_COUNT = 3
#: A word that is a misreading of one this many times as frequent isn't of the vocabulary.
MISREAD_RATIO = 8
#: A word with a capital isn't taken for one that has a capital more rarely than this.
LEAST_CAPITALS = 0.005
#: Jobs with their titles are sent to every task up to this number, else joined by a shuffle.
MAX_JOBS = 200_000
#: A form is a misreading of another form of its book if that is this many times as frequent.
BOOK_RATIO = 3

# What a scanner reads -> what was printed.
CONFUSIONS = {
    "@": "a", "0": "o", "5": "s", "9": "g", "6": "bé", "8": "b", "†": "t", "|": "il", "3": "e",
    "1": "li", "!": "li", "ſ": "fs", "c": "e", "e": "c", "b": "ß",
}
CONFUSIONS_LONG = [
    ("cl", "d"), ("c1", "d"), ("c|", "d"), ("c!", "d"), ("li", "h"), ("l1", "h"), ("l|", "h"), ("l!", "h"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("ii", "ü"), ("h", "li"), ("n", "ll"),
    ("m", "ni"), ("mi", "nn"), ("fi", "ñ"), ("vv", "w"), ("d", "cl"), ("u", "ii"), ("h", "b"),
]

TOKEN = re.compile(r"[^\s.,;:?…“”„\"«»()\[\]{}—–/*·=+<>¿¡。！？，、「」।]+")
SURE = re.compile(r"[@†ſ]|[^\W\d_][|!0-9]+[^\W\d_]")
EDGE = "'\u2019\u2018-\u2010\u2011\u00ac\u00ad_&#%$^~`"
HYPHENS = "-\u2010\u00ac\u00ad"
LINE_HYPHEN = re.compile(r"([^\s\-\u2010\u00ac\u00ad“”\"(«„][^\s“”\"(«„—]*)[\-\u2010\u00ac\u00ad][ \t]*$")
FIRST_WORD = re.compile(r"\s*([^\W\d_][\w@†!|'’\-‐]*)")
LETTER = re.compile(r"[^\W\d_]")

# Words before a page number, and those between it and the number of pages.
PAGE_WORDS = "page|seite|página|pagina|pág|pag|p|s|стр|pg|folio"
OF_WORDS = "of|von|de|sur|из|/"
PAGE_NUMBER = re.compile(
    rf"^[\s\-–—\[\](){{}}·•|.]*(?:(?:{PAGE_WORDS})\b\.?\s*)?(\d{{1,4}}|[ivxlc]{{1,7}}|[IVXLC]{{1,7}})(?:\s*(?:{OF_WORDS})\s*\d{{1,4}})?[\s\-–—\[\](){{}}·•|.]*$", re.I
)
ROMAN = re.compile(r"^(?=.)(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
CHAPTER_BAR = re.compile(r"^\s*(?:chapter|part|appendix|book|kapitel|teil|chapitre|partie|capítulo|parte)\b[^|·]{0,24}[|·]\s*\S", re.I)
NUMBER_SIDE = re.compile(r"^\s*(\d{1,4})\s+(\S.*?)\s*$|^\s*(.*?\S)\s+(\d{1,4})\s*$")
WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def _plain(text: str) -> str:
    return " ".join(WORDS.findall(text.lower()))


def title_of(title: str | None, pdf_path: str | None) -> str:
    """The title, or where it is null the words of the file name without its number."""
    if title and title.strip():
        return _plain(title)
    stem = re.sub(r"\.\w+$", "", (pdf_path or "").rsplit("/", 1)[-1])
    return _plain(re.sub(r"[_\-]+", " ", re.sub(r"_?\d+$", "", stem)))


def _like_title(words: str, title: str) -> bool:
    if not title or not words:
        return False
    if words == title:
        return True
    # a file name may have lost the hyphens of the title
    a, b = words.replace("-", " "), title.replace("-", " ")
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4:
        return False
    match = SequenceMatcher(None, a, b, autojunk=False)
    # the first two are bounds from above
    return match.real_quick_ratio() >= 0.9 and match.quick_ratio() >= 0.9 and match.ratio() >= 0.9


def is_furniture(line: str, title: str, page: int | None) -> bool:
    """Whether a line of a scanned block is a page number or a running header."""
    s = line.strip()
    if not s:
        return False
    if m := PAGE_NUMBER.match(s):
        number = m.group(1)
        if number.isdigit() or ROMAN.match(number.lower()) and (number.islower() or number.isupper()):
            return True
    if CHAPTER_BAR.match(s):
        return True
    if title:
        words = _plain(s)
        if _like_title(words, title):
            return True
        for bar in ("·", "|", "•", " — ", " – "):
            if bar in s and any(_like_title(_plain(x), title) for x in s.split(bar)):
                return True
    if (m := NUMBER_SIDE.match(s)) and not re.search(r"[,;:.!?|]", s):
        number, rest = int(m.group(1) or m.group(4)), m.group(2) or m.group(3)
        names = WORDS.findall(rest)
        if 1 < len(names) <= 10 and not re.search(r"\d", rest) and (rest.isupper() or all(w[0].isupper() for w in names if len(w) > 3)):
            return page is None or abs(number - page) <= 6
    return False


class Trie:
    """Words with their counts, packed; ``candidates`` walks it together with a word's automaton.

    Nodes are numbered level by level, so a node's children stand side by side: ``labels`` holds the letter of every node, ``first`` where
    its children begin (they end where those of the next node begin) and ``counts`` the count of the word that ends there, 0 for none.
    """

    def __init__(self, words: dict[str, int]):
        ordered = sorted(words)
        labels, first, counts, level, depth = ["\0"], array("I"), array("q"), [(0, len(ordered))], 0
        while level:
            below = []
            for lo, hi in level:
                ends = lo < hi and len(ordered[lo]) == depth
                counts.append(words[ordered[lo]] if ends else 0)
                lo += ends
                first.append(len(labels))
                while lo < hi:
                    ch, k = ordered[lo][depth], lo + 1
                    while k < hi and ordered[k][depth] == ch:
                        k += 1
                    labels.append(ch)
                    below.append((lo, k))
                    lo = k
            level, depth = below, depth + 1
        first.append(len(labels))
        self.labels, self.first, self.counts = "".join(labels), first, counts

    def candidates(self, word: str, misreads: int = 2, free: int = 0) -> list[tuple[str, int, int]]:
        """(vocabulary word, edits, count) of all words within so many misreadings and free edits.

        A state is (letters of ``word`` used, misreadings, free edits, letters still due).
        """
        n, found = len(word), {}
        labels, first, counts = self.labels, self.first, self.counts
        longs: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for seen, true in CONFUSIONS_LONG:
            at = word.find(seen)
            while at >= 0:
                longs[at].append((at + len(seen), true))
                at = word.find(seen, at + 1)
        stack = [(0, "", {(0, 0, 0, "")})]
        while stack:
            node, prefix, states = stack.pop()
            if counts[node]:
                for i, m, f, due in states:
                    rest = n - i  # letters too many at the end
                    if not due and f + rest <= free:
                        found[prefix] = min(found.get(prefix, (9, 0)), (m + f + rest, counts[node]))
            step: dict[str, set] = defaultdict(set)
            any_letter = set()
            for i, m, f, due in states:
                if due:
                    step[due[0]].add((i, m, f, due[1:]))
                    continue
                if i < n:
                    ch = word[i]
                    step[ch].add((i + 1, m, f, ""))
                    if m < misreads:
                        for true in CONFUSIONS.get(ch, ""):
                            step[true].add((i + 1, m + 1, f, ""))
                        for end, true in longs.get(i, ()):
                            step[true[0]].add((end, m + 1, f, true[1:]))
                    if f < free:
                        any_letter.add((i + 1, m, f + 1, ""))  # another letter
                        if i + 1 < n:  # a letter too many, then what follows it
                            step[word[i + 1]].add((i + 2, m, f + 1, ""))
                if f < free:
                    any_letter.add((i, m, f + 1, ""))  # a letter is missing
            lo, hi = first[node], first[node + 1]
            if any_letter:
                for k in range(lo, hi):
                    stack.append((k, prefix + labels[k], step.get(labels[k], set()) | any_letter))
            else:
                for ch, after in step.items():
                    if (k := labels.find(ch, lo, hi)) >= 0:
                        stack.append((k, prefix + ch, after))
        return sorted(((w, e, c) for w, (e, c) in found.items()), key=lambda x: (x[1], -x[2], x[0]))


# Spellings that one reading class stands for, longest first.
_CLASSES = [("rn", "m"), ("ni", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ll", "n"), ("vv", "w")]
_CLASS_OF = str.maketrans({"@": "a", "0": "o", "5": "s", "9": "g", "6": "bé", "8": "b", "†": "t", "|": "i", "1": "i", "!": "i", "l": "i", "ſ": "s", "f": "s", "e": "c", "3": "c", "h": "b"})


def skeleton(word: str) -> str:
    """A key that a word shares with its misreadings."""
    for a, b in _CLASSES:
        word = word.replace(a, b)
    return word.translate(_CLASS_OF)


# What every rewriting of CONFUSIONS and CONFUSIONS_LONG leaves as it is, so the join on it is complete.
_READING = str.maketrans({
    "@": "a", "0": "o", "5": "s", "f": "s", "ſ": "s", "9": "g", "†": "t", "3": "e", "c": "e", "d": "ei", "w": "vv", "ñ": "si", "m": "iii",
    **dict.fromkeys("l1|!r", "i"), **dict.fromkeys("nhbuü6é8ß", "ii"),
})


def reading_key(word: str) -> str:
    """A key that a word shares with whatever any number of listed misreadings make of it."""
    return word.translate(_READING)


def reach(form: str) -> int:
    """The number of misreadings allowed in a form."""
    return 2 if len(form) > 4 or not form.isalpha() else 1


def capitals(word: str, counts: dict[str, int]) -> float:
    """The share of a word's occurrences with a capital; they are counted under ^word."""
    return counts.get("^" + word, 0) / max(1, counts.get(word, 0))


def is_sound(w: str, n: int, counts: dict[str, int], trie: Trie) -> bool:
    """Whether a word of the corpus isn't the misreading of a much more frequent one.

    A word that mostly has a capital (a name) is no misreading of one that hardly ever has.
    """
    if SURE.search(w):
        return False
    name = capitals(w, counts) > 0.5
    return not any(e and c >= MISREAD_RATIO * n and not (name and capitals(x, counts) < LEAST_CAPITALS) for x, e, c in trie.candidates(w, 2 if len(w) > 4 else 1))


def cleaned_vocabulary(counts: dict[str, int]) -> dict[str, int]:
    """``counts`` without the words that aren't sound."""
    trie = Trie({w: n for w, n in counts.items() if w[0] != "^"})
    return with_capitals(counts, [w for w, n in counts.items() if w[0] != "^" and is_sound(w, n, counts, trie)])


def with_capitals(counts: dict[str, int], words: list[str]) -> dict[str, int]:
    """Counts of the words and of their occurrences with a capital."""
    return {x: counts[x] for w in words for x in (w, "^" + w) if x in counts}


# Signs that no word holds, and the letters they mostly stand for.
_PLAIN = str.maketrans("@05968†|1!ſ", "aosgbbtilis")


class Scan:
    """What a worker needs to judge words: the vocabulary, its trie and verdicts so far."""

    def __init__(self, words: dict[str, int], pairs: dict[str, int] | None = None, trie: Trie | None = None):
        self.counts, self.verdicts, self.options = words, {}, {}
        self.words = {w: n for w, n in words.items() if w[:1] != "^"}
        self.trie = trie or Trie(self.words)
        self.total = sum(self.words.values()) or 1
        self.pairs = pairs or {}

    def verdict(self, tok: str) -> tuple[int, str]:
        """0 sound, 1 misread, 2 unknown word that its book must tell, 3 unknown with a digit; with the word itself."""
        got = self.verdicts.get(tok)
        if got is None:
            if len(self.verdicts) > 500_000:
                self.verdicts.clear()
            got = self.verdicts[tok] = self._judge(tok)
        return got

    def _judge(self, tok: str) -> tuple[int, str]:
        w = tok.lower()
        if w in self.words:
            return 0, w
        bare = w.strip(EDGE)
        core = bare.rstrip("!")
        if core in self.words or sum(map(str.isalpha, core)) < 2:
            return 0, core
        if core.rstrip("'’s") in self.words:
            return 0, core
        if SURE.search(core):
            # misread in any case, as no word holds such a sign; the automaton finds the form that a word is behind, if any is
            forms = dict.fromkeys([core, bare.lstrip("!")])
            return 1, next((f for f in forms if self.trie.candidates(f, 3)), core)
        if "-" in core or "‐" in core or "‑" in core:
            parts = [x for x in re.split(r"[-‐‑]", core) if x]
            return max((self.verdict(x) for x in parts), key=lambda v: v[0] == 1) if parts else (0, core)
        if len(core) < 3:
            return 0, core
        for form in dict.fromkeys([core, bare.lstrip("!")]):  # a final ! may be a letter
            if form != core and bare.endswith("!") and not form[-1:] == "!":
                continue
            options = self.trie.candidates(form, reach(form))
            if tok[0].isupper() and not tok.isupper():
                options = [o for o in options if capitals(o[0], self.counts) >= LEAST_CAPITALS]
            if options:
                return 1, form
        if any(ch.isdigit() for ch in core):
            return 3, core
        return 2, core

    def doubtful(self, tok: str) -> list[tuple[str, str, bool]]:
        """(form, word, named) of a token, or its parts, that the vocabulary doesn't tell; named: only its first letter is a capital."""
        code, word = self.verdict(tok)
        if code == 1:
            return []
        bare = tok.strip(EDGE)
        core = bare.rstrip("!")
        if core.lower() in self.words or core.lower().rstrip("'’s") in self.words:
            return []
        parts = [x for x in re.split(r"[-‐‑]", core) if x]
        if len(parts) > 1:
            return [d for x in parts for d in self.doubtful(x)]
        if code < 2:
            return []
        named = tok[0].isupper() and not tok.isupper()
        forms = {word, bare.lower().lstrip("!")} if bare.endswith("!") else {word}  # a final ! may be a letter
        return [(form, word, named) for form in forms]

    def hyphen(self, left: str, right: str) -> bool:
        """Whether left- / right is one word divided, not a compound at its own hyphen."""
        left, right = left.lower(), right.lower().rstrip("!'’")
        joined, apart = left.lstrip(EDGE) + right, left.lstrip(EDGE) + "-" + right
        a, b = self.words.get(joined, 0), self.words.get(apart, 0)
        if a or b:
            return a >= b
        if (self.trie.candidates(joined, 2) or [(0, 9)])[0][1] <= (self.trie.candidates(apart, 2) or [(0, 8)])[0][1]:
            return True
        return not self.trie.candidates(apart, 2)

    def fix(self, tok: str, before: str, after: str, forms: dict[tuple[str, bool], str] | None = None) -> str:
        """The best candidate for a misread token, by edits, neighbours and count; else what ``forms`` has for (form, named)."""
        code, core = self.verdict(tok)
        if code != 1:
            for form, _, named in self.doubtful(tok) if forms else ():
                if (best := forms.get((form, named))) and (at := tok.lower().find(form)) >= 0:
                    tok = _replaced(tok, at, form, best)
            return tok
        at = tok.lower().find(core)
        if at < 0:
            return tok
        if (options := self.options.get(core)) is None:
            if len(self.options) > 100_000:
                self.options.clear()
            # where too many signs are misread, those that no word holds are read first
            options = self.options[core] = self.trie.candidates(core, 3) or self.trie.candidates(core.translate(_PLAIN), 3) or (self.trie.candidates(core, 2, 1) if len(core) > 4 else [])
        if not options:
            best = core.translate(_PLAIN)
        else:
            def score(o: tuple[str, int, int]) -> float:
                pair = self.pairs.get(f"{before} {o[0]}", 0) + self.pairs.get(f"{o[0]} {after}", 0)
                return -4.0 * o[1] + math.log(o[2] / self.total) * 0.3 + math.log1p(pair)

            best = max(options, key=lambda o: (score(o), o[0]))[0]
        return _replaced(tok, at, core, best)


def _replaced(tok: str, at: int, core: str, best: str) -> str:
    """``tok`` with ``best`` for ``core`` at ``at``, in its case."""
    cased = best.upper() if len(core) > 1 and tok[at : at + len(core)].isupper() else best.capitalize() if tok[at].isupper() else best
    return tok[:at] + cased + tok[at + len(core) :]


_INLINE = re.compile(f"[{IGNORABLE_CHARS}](?!\\s*\\n)")


def _folded(text: str) -> str:
    """Without invisible characters (a soft hyphen at a line's end stays) and foreign look-alikes."""
    if text.isascii():
        return text
    return fold_script(_INLINE.sub("", text))


def _hyphen_at_end(line: str) -> re.Match | None:
    """The last word of a line that ends in a hyphen."""
    end = len(line)
    while end and line[end - 1] in " \t":
        end -= 1
    return LINE_HYPHEN.search(line, max(line.rfind(" ", 0, end), line.rfind("\n", 0, end)) + 1) if end and line[end - 1] in HYPHENS else None


def examine(text: str, title: str, page: int | None, scan: Scan) -> tuple[set[str], set[str], set[tuple[str, str, bool]]]:
    """(defects, unknown words, doubtful forms) of one block."""
    text = _folded(text)
    defects: set[str] = set()
    lines = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        if is_furniture(line, title, page):
            defects.add("furniture")
        else:
            lines.append(line)
    k = 0
    while k + 1 < len(lines):
        if (m := _hyphen_at_end(lines[k])) and (r := FIRST_WORD.match(lines[k + 1])):
            left, right = m.group(1), r.group(1)
            word = right.rstrip("-‐")
            if LETTER.search(left) and word and word[0].islower():
                one = scan.hyphen(left, word)
                if one:
                    defects.add("hyphen")
                # the word goes to the next line, whole
                lines[k] = lines[k][: m.start()]
                lines[k + 1] = left + ("" if one else "-") + lines[k + 1].lstrip()
        k += 1
    unknown, doubtful = set(), set()
    for tok in set(TOKEN.findall(" ".join(lines))):
        code, word = scan.verdict(tok)
        doubtful.update(scan.doubtful(tok))
        if code == 1:
            defects.add("glyph")
        elif code == 2:
            unknown.add(word)
    return defects, unknown, doubtful


def repair(text: str, title: str, page: int | None, scan: Scan, forms: dict[tuple[str, bool], str] | None = None) -> str:
    """The text without furniture, with divided words joined, misreadings mended and lines reflowed.

    ``forms`` has the right words of those (form, named) that the vocabulary doesn't tell.  Blank lines and lines that begin with a bullet, a number or a bar stay breaks.
    """
    paragraphs: list[str] = [""]
    for line in _folded(text).split("\n"):
        s = line.strip()
        if not s:
            paragraphs.append("")
        elif is_furniture(line, title, page):
            continue
        elif re.match(r"[-•|*–]\s|\d+[.)]\s", s) or "\t" in line:
            paragraphs += [s, ""]
        elif (m := _hyphen_at_end(paragraphs[-1])) and (r := FIRST_WORD.match(s)) and r.group(1)[0].islower():
            one = scan.hyphen(m.group(1), r.group(1).rstrip("-‐"))
            paragraphs[-1] = paragraphs[-1].rstrip().rstrip(HYPHENS) + ("" if one else "-") + s
        else:
            paragraphs[-1] = f"{paragraphs[-1]} {s}" if paragraphs[-1] else s
    out = []
    for p in filter(None, paragraphs):
        toks = [m.span() for m in TOKEN.finditer(p)]
        words = [p[a:b].lower() for a, b in toks]
        new, last = [], 0
        for k, (a, b) in enumerate(toks):
            if forms or scan.verdict(p[a:b])[0] == 1:
                new += [p[last:a], scan.fix(p[a:b], words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "", forms)]
                last = b
        out.append("".join(new) + p[last:])
    return "\n".join(out)


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body blocks of jobs with path B: (book, block_no, source_page, text, title, pdf_path)."""
    jobs = sent_if_small(checkpointed(jobs_once(spark, sf_dir, "path", "title", "pdf_path").where(F.col("path") == "B").drop("path")), MAX_JOBS)
    body = table(spark, sf_dir, "blocks").where((F.col("type") == "body") & F.col("text").isNotNull())
    return body.select("book", "block_no", "source_page", "text").join(jobs, "book")


def _counted(texts: DataFrame, pairs: bool) -> tuple[dict[str, int], dict[str, int], DataFrame, int]:
    """(words, pairs, all words, least): words, and with ``pairs`` pairs of them, with a share of at least MIN_SHARE, collected, so at most 1 / MIN_SHARE of each."""

    def count(columns: dict[str, list]) -> dict[str, list]:
        cased, both = Counter(), Counter()
        for text in columns["text"]:
            words = [w.strip(EDGE).rstrip("!") for w in TOKEN.findall(_folded(text))]
            cased.update(words)
            if pairs:
                low = [w.lower() for w in words]
                both.update(zip(low, low[1:]))
        cased.pop("", None)
        counts: Counter = Counter()
        for w, n in cased.items():
            counts[low := w.lower()] += n
            if w[0].isupper() and not w.isupper():
                counts["^" + low] += n
        counts[""] = sum(counts.values())
        if pairs:
            counts[" "] = sum(both.values())
            for (a, b), n in both.items():
                if a and b:
                    counts[f"{a} {b}"] += n
        return {"word": list(counts), "n": list(counts.values())}

    sums = checkpointed(map_columns(texts.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in sums.where(F.col("word").isin("", " ")).collect()}
    least = {k: max(MIN_COUNT, math.ceil(totals.get(k, 0) * MIN_SHARE)) for k in ("", " ")}
    is_pair = F.contains("word", F.lit(" "))
    often = sums.where(~F.col("word").isin("", " ") & (F.col("n") >= F.when(is_pair, least[" "]).otherwise(least[""])))
    words, common = {}, {}
    for w, n in often.collect():
        (common if " " in w else words)[w] = n
    return words, common, sums.where(~is_pair), least[""]


def _model(blocks: DataFrame, context: bool):
    """A function that gives a worker its Scan, the counts of all words and the vocabulary's least; it has at most 1 / MIN_SHARE words.

    The words are judged by the tasks, and the trie is packed once and sent.
    """
    counts, pairs, sums, least = _counted(blocks, context)
    context_ = blocks.sparkSession.sparkContext
    raw = context_.broadcast((counts, Trie({w: n for w, n in counts.items() if w[0] != "^"})))

    def judge(c: dict[str, list]) -> dict[str, list]:
        return {"word": [w for w, n in zip(c["word"], c["n"]) if is_sound(w, n, *raw.value)]}

    often = sums.where((F.col("word") != "") & ~F.col("word").startswith("^") & (F.col("n") >= least))
    words = with_capitals(counts, [r[0] for r in map_columns(often, judge, "word string").collect()])
    sent, name = context_.broadcast((words, pairs, Trie({w: n for w, n in words.items() if w[0] != "^"}))), token()
    return lambda: kept(name, lambda: Scan(*sent.value)), sums, least


def rare_misread(doubtful: DataFrame, sums: DataFrame, least: int, model) -> DataFrame:
    """(word, base, named, right, edits, n): forms that are misreadings of a word with at least MIN_COUNT but fewer than ``least`` occurrences.

    ``doubtful`` holds (word, base, named).  As in the vocabulary, a form with MIN_COUNT occurrences counts as a word
    itself, unless the right one is MISREAD_RATIO times as frequent.  Every step is a join of distinct words.
    """
    plain = sums.where(~F.col("word").startswith("^"))
    caps = sums.where(F.col("word").startswith("^")).select(F.expr("substring(word, 2)").alias("word"), F.col("n").alias("caps"))
    some = plain.where((F.col("word") != "") & (F.col("n") >= MIN_COUNT) & (F.col("n") < least)).join(caps, "word", "left").select("word", "n", F.coalesce("caps", F.lit(0)).alias("caps"))

    def judged(c: dict[str, list], scan: Scan) -> dict[str, list]:
        # names are judged as such, so a common word without capitals doesn't claim them
        rows = [(w, n, k, reading_key(w)) for w, n, k in zip(c["word"], c["n"], c["caps"]) if scan.verdict(w.capitalize() if 2 * k > n else w)[0] == 2]
        return dict(zip(("right", "n", "caps", "key"), map(list, zip(*rows)))) if rows else {x: [] for x in ("right", "n", "caps", "key")}

    def keyed(c: dict[str, list]) -> dict[str, list]:
        return c | {"key": [reading_key(w) for w in c["word"]]}

    def checked(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {x: [] for x in ("word", "base", "named", "right", "edits", "n", "own")}
        for word, base, named, right, n, caps, own in zip(*(c[x] for x in ("word", "base", "named", "right", "n", "caps", "own"))):
            if named and caps < LEAST_CAPITALS * n:
                continue
            if got := Trie({right: n}).candidates(word, reach(word)):
                for k, v in zip(out, (word, base, named, right, got[0][1], n, own)):
                    out[k].append(v)
        return out

    rights = checkpointed(map_columns(some, judged, "right string, n bigint, caps bigint, key string", model))
    itself = rights.select(F.col("right").alias("word"), F.col("right").alias("base"), (2 * F.col("caps") > F.col("n")).alias("named"))
    left = map_columns(doubtful.unionByName(itself).distinct(), keyed, "word string, base string, named boolean, key string")
    owned = left.join(plain.select(F.col("word").alias("base"), F.col("n").alias("own")), "base", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    near = owned.join(rights, "key").where((F.col("base") != F.col("right")) & ((F.col("own") < MIN_COUNT) | (F.col("n") >= MISREAD_RATIO * F.col("own"))))
    both = checkpointed(map_columns(near, checked, "word string, base string, named boolean, right string, edits int, n bigint, own bigint"))
    wrong = both.where(F.col("own") >= MIN_COUNT).select(F.col("base").alias("right")).distinct()
    return both.join(wrong, "right", "left_anti").select("word", "base", "named", "right", "edits", "n")


def _seen(blocks: DataFrame, model, least: int, mending: bool) -> DataFrame:
    """(book, block_no, defect, word, skeleton, named): defects; unknown words, whose defect is null or empty; doubtful forms, whose defect is ?.

    For mending, the doubtful forms of every block, else of those without a sure misreading.
    """

    def look(c: dict[str, list], scan: Scan) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("book", "block_no", "defect", "word", "skeleton", "named")}
        titles: dict = {}
        for book, no, page, text, title, pdf in zip(c["book"], c["block_no"], c["source_page"], c["text"], c["title"], c["pdf_path"]):
            if (t := titles.get(book)) is None:
                t = titles[book] = title_of(title, pdf)
            defects, unknown, doubtful = examine(text, t, page, scan)
            rows = [(d, None, None, None) for d in defects] + ([] if "glyph" in defects else [(None, w, skeleton(w), None) for w in unknown])
            # an unknown word counts for its book even where the block needs no verdict
            if "glyph" in defects:
                rows += [("", w, skeleton(w), None) for w in unknown]
            if mending or least > MIN_COUNT and "glyph" not in defects:
                rows += [("?", form, base, named) for form, base, named in doubtful]
            for d, w, s, named in rows:
                for k, v in zip(out, (book, no, d, w, s, named)):
                    out[k].append(v)
        return out

    return checkpointed(map_columns(blocks, look, "book string, block_no int, defect string, word string, skeleton string, named boolean", model))


def _book_misread(words: DataFrame) -> DataFrame:
    """(book, word, right): unknown words that are misreadings of another of their book."""
    counts = words.groupBy("book", "skeleton", "word").agg(F.count("*").alias("n"))
    most = counts.groupBy("book", "skeleton").agg(F.max(F.struct("n", "word")).alias("most"), F.count("*").alias("forms")).where(F.col("forms") > 1)
    return counts.join(most, ["book", "skeleton"]).where(F.col("most.n") >= BOOK_RATIO * F.col("n")).select("book", "word", F.col("most.word").alias("right"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, defect), one row per kind of defect of a block.

    Null and blank texts have no row; a block stored twice counts once; ties between
    candidates don't matter here.  A null title is read from the file name, a null page
    only drops the comparison of printed with stored page numbers.
    """
    blocks = scanned(spark, sf_dir)
    model, sums, least = _model(blocks, context=False)
    seen = _seen(blocks, model, least, mending=False)
    sure = seen.where(~F.col("defect").isin("", "?")).select("book", "block_no", "defect")
    words = seen.where(F.col("word").isNotNull() & ~F.col("defect").eqNullSafe("?"))
    misread = _book_misread(words)
    by_book = words.where(F.col("defect").isNull()).join(misread, ["book", "word"], "left_semi").select("book", "block_no", F.lit("glyph").alias("defect"))
    every = sure.unionByName(by_book)
    if least > MIN_COUNT:  # else the vocabulary holds them all
        doubtful = seen.where(F.col("defect") == "?").select("book", "block_no", "word", F.col("skeleton").alias("base"), "named")
        misread = rare_misread(doubtful.select("word", "base", "named").distinct(), sums, least, model)
        every = every.unionByName(doubtful.join(misread, ["word", "base", "named"], "left_semi").select("book", "block_no", F.lit("glyph").alias("defect")))
    return every.distinct()


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, text): every scanned body block as continuous paragraphs.

    Blank texts stay as they are apart from blanks; whole rows stored twice give one row.
    """
    blocks = scanned(spark, sf_dir)
    model, sums, least = _model(blocks, context=True)
    seen = _seen(blocks, model, least, mending=True)
    doubtful = seen.where(F.col("defect") == "?").select("book", "block_no", "word", F.col("skeleton").alias("base"), "named")
    books = _book_misread(seen.where(F.col("word").isNotNull() & ~F.col("defect").eqNullSafe("?")))
    right = doubtful.join(books.withColumnRenamed("word", "base"), ["book", "base"]).where(F.col("word") == F.col("base")).select("book", "block_no", "word", "named", "right", F.lit(0).alias("rank"))
    if least > MIN_COUNT:
        rare = rare_misread(doubtful.select("word", "base", "named").distinct(), sums, least, model)
        best = rare.groupBy("word", "base", "named").agg(F.min(F.struct("edits", -F.col("n"), "right"))["right"].alias("right"))
        right = right.unionByName(doubtful.join(best, ["word", "base", "named"]).select("book", "block_no", "word", "named", "right", F.lit(1).alias("rank")))
    # the forms of one block; the word of its own book goes first
    forms = right.groupBy("book", "block_no").agg(F.collect_set(F.struct("rank", "word", "named", "right")).alias("forms"))

    def mend(c: dict[str, list], scan: Scan) -> dict[str, list]:
        texts = []
        for t, title, pdf, page, rows in zip(c["text"], c["title"], c["pdf_path"], c["source_page"], c["forms"]):
            own = {(r["word"], r["named"]): r["right"] for r in sorted(rows or (), key=lambda r: -r["rank"])}
            texts.append(repair(t, title_of(title, pdf), page, scan, own))
        return {"book": c["book"], "block_no": c["block_no"], "text": texts}

    return map_columns(blocks.join(forms, ["book", "block_no"], "left"), mend, "book string, block_no int, text string", model).dropDuplicates(["book", "block_no"])
