"""Problem 5: text that looks the same but is stored with different characters.

1. Compatibility forms that look the same (full-width and half-width forms, ligatures,
   radicals, presentation forms) are decomposed and recomposed; forms that a reader
   tells apart (raised, circled, fraction, squared, styled) stay.
2. Characters without an image are deleted, blanks and hyphens are made one.
3. Letters that look alike across scripts form a lattice: each position holds the class
   of its look-alikes.  Viterbi picks one path, scoring the pairs of neighbouring letters by their
   frequency in each script, counted over all blocks, and how consistent the script is with the word and
   the text around it.  The lattice depends only on what is seen, so texts that look
   the same get the same path; a path never leaves the classes, so texts that look
   different stay different.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from functools import cache

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import kept, map_columns, sent_if_small, spoken_blocks, token
from folioflow.sources.tables import checkpointed

# Code points without an image of their own.
IGNORABLE_CHARS = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e0fff"
_IGNORABLE = re.compile(f"[{IGNORABLE_CHARS}]")
_BLANKS = re.compile("[ \\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+")
_LINE_EDGE = re.compile(" *(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\u0085\u2028\u2029]) *")
_HYPHENS = str.maketrans({"\u2010": "-", "\u2011": "-", "\u2212": "-", "\ufe63": "-", "\uff0d": "-"})

# Latin letters with their images in Cyrillic and Greek ("." where there is none).
LATIN_CLASS = "aceijopsxyhdqwABCEFGHIJKMNOPSTXYZ"
CYRILLIC_OF = "асеіјорѕхуһԁԛԝАВСЕ.ԌНІЈКМ.ОРЅТХҮ."
GREEK_OF = ".....ο........ΑΒ.Ε..ΗΙ.ΚΜΝΟΡ.ΤΧΥΖ"
_MORE = {"ν": "v", "ѵ": "v", "ɡ": "g", "ⅼ": "l", "ӏ": "l", "Ӏ": "I", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ʏ": "Y", "ᴠ": "v"}
# Armenian letters with the image of a Latin one.
ARMENIAN_OF = {"o": "օ", "h": "հ", "j": "յ", "q": "զ", "O": "Օ", "S": "Տ"}
_TO_LATIN = {**{v: k for k, v in ARMENIAN_OF.items()}, **{c: a for a, c in zip(LATIN_CLASS, CYRILLIC_OF) if c != "."}, **{g: a for a, g in zip(LATIN_CLASS, GREEK_OF) if g != "."}, **_MORE}
_TO_LATIN["У"] = "Y"
_LATIN = str.maketrans(_TO_LATIN)
_TO = {
    "cyrillic": {a: c for a, c in zip(LATIN_CLASS, CYRILLIC_OF) if c != "."},
    "greek": {a: g for a, g in zip(LATIN_CLASS, GREEK_OF) if g != "."} | {"v": "ν"},
    "armenian": ARMENIAN_OF,
}
_TO["cyrillic"]["Y"] = "У"
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ\u0530-\u058fⅰ-ⅿɡʏᴠ]")
_WORD = re.compile(r"[^\W\d_]+")
_KINDS = {"<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>"}
# Compatibility characters that a reader tells from their plain form.
_KEEP = set("ſ™℠℡№℀℁℅℆℻ªºµ´¨¯¸˘˙˚˛˜˝")


def _compatible() -> dict[int, str]:
    table: dict[int, str] = {}
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in _KINDS and ch not in _KEEP:
            plain = unicodedata.normalize("NFKC", ch)
            if not plain.startswith(" ") or len(plain) == 1:
                table[cp] = plain
    return table


_COMPAT = _compatible()
_COMPAT_RE = re.compile("[" + "".join(map(re.escape, map(chr, _COMPAT))) + "]")


def fold_script(text: str) -> str:
    """Single look-alike letters inside Latin words made Latin, for looking words up."""
    if not _FOREIGN.search(text):
        return text

    def one(m: re.Match) -> str:
        w = m.group()
        f = w.translate(_LATIN)
        return f if f.isascii() or any(ch in f for ch in "bdfgklmnrtuvz") and not _UNIQUE_CYRILLIC.search(w) else w

    return _WORD.sub(one, text)


_UNIQUE_CYRILLIC = re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x530)) if c.isalpha() and c not in _TO_LATIN) + "]")
_UNIQUE_GREEK = re.compile("[" + "".join(c for c in map(chr, range(0x370, 0x400)) if c.isalpha() and c not in _TO_LATIN) + "]")
_UNIQUE_LATIN = re.compile("[" + "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and c not in LATIN_CLASS and c not in "vlg") + "]")

_SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
#: Code points of each script's letters.
_SPANS = {"latin": (0x41, 0x250), "cyrillic": (0x400, 0x530), "greek": (0x370, 0x400), "armenian": (0x530, 0x590)}
_UNIQUE_ARMENIAN = re.compile("[" + "".join(c for c in map(chr, range(0x530, 0x590)) if c.isalpha() and c not in _TO_LATIN) + "]")
_UNIQUE = {"latin": _UNIQUE_LATIN, "cyrillic": _UNIQUE_CYRILLIC, "greek": _UNIQUE_GREEK, "armenian": _UNIQUE_ARMENIAN}
#: What a change of script within a word costs: more than all pairs of a word are worth, so that the pairs decide between equally consistent paths.
CHANGE = 1e6

Pairs = dict[tuple[str, str], int]


@cache
def _letter_facts() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x590: the script of a letter (0 for none, else 1 + its number), and the same for letters that only one script has."""
    script, unique = np.zeros(0x591, np.int8), np.zeros(0x591, np.int8)
    for k, name in enumerate(_SCRIPTS, 1):
        for cp in range(*_SPANS[name]):
            if chr(cp).isalpha():
                script[cp] = k
                unique[cp] = k if _UNIQUE[name].match(chr(cp)) else 0
    return script, unique


def pair_counts(texts: list[str]) -> Counter:
    """Counts of (script, pair of letters in lower case) in words that have a letter of one script only, and of ("", first letter)."""
    script, unique = _letter_facts()
    signs = np.frombuffer(("\n".join(texts).lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(signs, 0x590)
    kind, own = script[at], unique[at]
    letter = kind > 0
    start = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(start):
        return Counter()
    bits = np.bitwise_or.reduceat(np.where(own > 0, 1 << own.astype(np.int64), 0) * letter, start)
    word = np.cumsum(np.bincount(start, minlength=len(signs))) - 1
    sure = np.zeros(len(start), np.int8)
    for k in range(1, len(_SCRIPTS) + 1):
        sure[bits == 1 << k] = k
    out: Counter = Counter()
    ok = letter & (word >= 0) & (kind == sure[np.maximum(word, 0)])
    both = np.flatnonzero(ok[1:] & ok[:-1] & (word[1:] == word[:-1])) + 1
    codes, n = np.unique((at[both - 1].astype(np.int64) << 16) | at[both], return_counts=True)
    for c, k in zip(codes.tolist(), n.tolist()):
        out[_SCRIPTS[script[c >> 16] - 1], chr(c >> 16) + chr(c & 0xFFFF)] += k
    codes, n = np.unique(at[start[ok[start]]], return_counts=True)
    for c, k in zip(codes.tolist(), n.tolist()):
        out[_SCRIPTS[script[c] - 1], "^" + chr(c)] += k
    return out


class Model:
    """How likely a letter follows another in each script: smoothed counts."""

    def __init__(self, counts: Pairs):
        self.counts, self.after, self.known = counts, Counter(), {}
        for (script, pair), n in counts.items():
            self.after[script, pair[0]] += n

    def score(self, script: str, before: str, letter: str) -> float:
        return math.log((self.counts.get((script, before + letter), 0) + 0.5) / (self.after[script, before] + 20))

    def decode(self, word: str, around: str) -> str:
        """Viterbi over the look-alikes of each letter of ``word``.

        ``around`` is the script of its surroundings, empty if they have none: a word of which every letter could be of that script is.
        """
        best = {"": (0.0, "")}
        for ch in word:
            seen = _TO_LATIN.get(ch, ch)
            options = {s: x for s in _SCRIPTS if (x := _image(seen, s))} if seen in LATIN_CLASS or seen in "vlg" else {_script_of(ch): ch}
            new = {}
            for s, x in options.items():
                rows = ((score + self.score(s, path[-1].lower() if p == s else "^", x.lower()) - (0.0 if p in ("", s) else CHANGE) + (CHANGE / 2 if not path and s == around else 0.0), path + x) for p, (score, path) in best.items())
                new[s] = max(rows, key=lambda r: r[0])
            best = new
        return max(best.items(), key=lambda kv: (kv[1][0], kv[0] == "latin"))[1][1]

    def form(self, text: str) -> str:
        return visual_form(text, self)


def _image(seen: str, script: str) -> str | None:
    """The letter of a script that looks like ``seen`` (a Latin letter of a class)."""
    return seen if script == "latin" else _TO[script].get(seen)


def _script_of(ch: str) -> str:
    return next((s for s in _SCRIPTS[1:] if _SPANS[s][0] <= ord(ch) < _SPANS[s][1]), "latin")


def _around(text: str) -> str:
    """The script of most of the letters of a text that only one script has; empty if there are none."""
    counts = {s: len(_UNIQUE[s].findall(text)) for s in _SCRIPTS}
    best = max(_SCRIPTS, key=lambda s: (counts[s], s == "latin"))
    return best if counts[best] else ""


def visual_form(text: str, model: Model | None = None) -> str:
    """The one form of all texts that look like ``text``; without a model, letter pairs count alike."""
    if not text.isascii():
        text = _IGNORABLE.sub("", text)
        if _COMPAT_RE.search(text):
            text = text.translate(_COMPAT)
        text = unicodedata.normalize("NFC", text).translate(_HYPHENS)
    text = _LINE_EDGE.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")
    # a text in Latin letters needs no decoding where one of them is of no other script, as then every path is Latin
    if _FOREIGN.search(text) or not _UNIQUE_LATIN.search(text):
        model = model or Model({})
        lines, whole = [], _around(text)
        for line in text.split("\n"):
            around = _around(line) or whole

            def one(m: re.Match) -> str:
                w = m.group()
                if (got := model.known.get((w, around))) is None:
                    if len(model.known) > 200_000:
                        model.known.clear()
                    got = model.known[w, around] = model.decode(w, around)
                return got

            lines.append(_WORD.sub(one, line))
        text = "\n".join(lines)
    return text


def letter_pairs(spark: SparkSession, sf_dir: str) -> Pairs:
    """The counts of ``pair_counts`` over all spoken blocks: at most the pairs of letters of four alphabets."""

    def count(c: dict[str, list]) -> dict[str, list]:
        got = pair_counts(c["text"])
        return {"script": [s for s, _ in got], "pair": [p for _, p in got], "n": list(got.values())}

    rows = map_columns(spoken_blocks(spark, sf_dir).select("text"), count, "script string, pair string, n bigint").groupBy("script", "pair").agg(F.sum("n").alias("n"))
    return {(r["script"], r["pair"]): r["n"] for r in rows.collect()}


def _model(spark: SparkSession, sf_dir: str):
    """A function that gives a worker its Model."""
    sent, name = spark.sparkContext.broadcast(letter_pairs(spark, sf_dir)), token()
    return lambda: kept(name, lambda: Model(sent.value))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, block_no, text) of every body or dialogue block, in its one form; rows stored twice once."""

    def form(c: dict[str, list], model: Model) -> dict[str, list]:
        return {"book": c["book"], "block_no": c["block_no"], "text": [model.form(t) for t in c["text"]]}

    return map_columns(spoken_blocks(spark, sf_dir), form, "book string, block_no int, text string", _model(spark, sf_dir)).dropDuplicates(["book", "block_no"])


#: Members of a variant that are joined in one task.
SPLIT = 100_000


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_a, block_a, book_b, block_b): pairs of blocks that look the same but are stored differently.

    Blank texts look like no other text.  Blocks are classed by the 128-bit digests of their form and their stored text; variants of
    one form are paired first, then their members, so equal texts never meet.  The larger variant of a pair is dealt to parts of SPLIT members.
    """

    def keys(c: dict[str, list], model: Model) -> dict[str, list]:
        forms = [model.form(t) for t in c["text"]]
        return {"book": c["book"], "block_no": c["block_no"], "form": [_key(f) if f else None for f in forms], "stored": [_key(t) for t in c["text"]]}

    # read several times below, so the digests are written once
    rows = checkpointed(map_columns(spoken_blocks(spark, sf_dir), keys, "book string, block_no int, form binary, stored binary", _model(spark, sf_dir)).where(F.col("form").isNotNull()))
    mixed = rows.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where(F.col("a") != F.col("b")).select("form")
    members = checkpointed(rows.join(sent_if_small(checkpointed(mixed)), "form", "left_semi").dropDuplicates(["book", "block_no"]))
    variants = checkpointed(members.groupBy("form", "stored").agg(F.count("*").alias("n")))
    a, b = (variants.select("form", F.col("stored").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    larger = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("sa") < F.col("sb")))
    parts = F.ceil(F.col("na") / SPLIT).cast("int")
    pairs = checkpointed(a.join(b, "form").where((F.col("sa") != F.col("sb")) & larger).select("form", "sa", "sb", parts.alias("parts")))
    of = lambda x: members.select("form", F.col("stored").alias(f"s{x}"), F.col("book").alias(f"book_{x}"), F.col("block_no").alias(f"block_{x}"))
    left = of("a").join(sent_if_small(pairs), ["form", "sa"]).withColumn("part", F.pmod(F.xxhash64("book_a", "block_a"), F.col("parts")))
    right = of("b").join(sent_if_small(pairs), ["form", "sb"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - F.lit(1).cast("bigint"))))
    both = left.join(right.drop("parts"), ["form", "sa", "sb", "part"])
    x, y = (F.struct(F.col(f"book_{k}").alias("book"), F.col(f"block_{k}").alias("block")) for k in "ab")
    return both.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).select(F.col("p.book").alias("book_a"), F.col("p.block").alias("block_a"), F.col("q.book").alias("book_b"), F.col("q.block").alias("block_b"))
