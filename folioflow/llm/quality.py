"""Problem 6: text statistics of pages, and whether a page is natural prose.

Each page gives three distributions: of its characters over classes, of its words over
the function words of each language and forms, and of its text over the ends and beginnings of lines.  They are compared
with profiles of prose in each language (of the samples below and of subject_examples) and of other structures (verse, dialogue,
list, index, table, contents, game statistics, junk) by Jensen-Shannon divergence; the
nearest profile gives the verdict.  Profiles are made from the short samples below by the
very functions that read the pages.
"""

from __future__ import annotations

import re
import textwrap
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import map_columns
from folioflow.sources.tables import table

# Function words of the ten languages; those of Chinese, Japanese and Thai, which divide no words by blanks, are one list.
FUNCTION_WORDS = {
    "en": set("the a an and or but of to in on at by for with from as is was were be been it he she they we you i his her their its that this which who not so because while although into near past under over beneath beside behind inside above across beyond all through when after before said".split()),
    "de": set("der die das den dem des ein eine einen und oder aber weil mit von zu im am ist war nicht sich er sie es wir ich auf aus bei nach für über ohne wie als dass trotz während kurz vor".split()),
    "fr": set("le la les un une des du de et ou mais que qui dans sur pour par avec sans est était ne pas il elle ils nous je se ce cette au aux tandis malgré avant aprè".split()),
    "es": set("el los las y o pero que en por para con sin es era no se su al del mientras una uno lo como cada tras durante".split()),
    "ru": set("и в на не что он она они с по к у за из от до как но а же для это его её был была во т е".split()),
    "hi": set("के का की को में से ने और पर है था थी हैं एक यह वह नहीं भी तो कि गया रहा".split()),
    "asian": set("だ の は を に が と で も た 的 了 在 是 和 有 不 ที่ และ ใน ของ".split()),
}
_LANGUAGES: dict[str, str] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _LANGUAGES[_w] = "shared" if _w in _LANGUAGES else _lang
FUNCTION = (*(f"function_{x}" for x in FUNCTION_WORDS), "function_shared")

CHARS = ("lower", "upper", "nocase", "digit", "blank", "stop", "comma", "quote", "rule", "symbol")
WORDS = (*FUNCTION, "lower_word", "capital", "number", "nocase_word", "mixed", "marks")
LINES = ("ends_stop", "ends_comma", "ends_letter", "ends_digit", "ends_other", "begins_mark", "begins_number", "has_columns")
COUNTS = ("chars", "words", "word_chars", "lines", "stop_lines")
ALL = CHARS + WORDS + LINES + COUNTS

_STOPS, _COMMAS, _QUOTES, _RULES = set(".!?…。！？।"), set(",;:，、；：-–—()'’"), set("“”„\"«»「」『』‘"), set("|\t_*•=<>{}[]\\/^~`#%&@+")


@cache
def _char_class() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, CHARS.index("symbol"), np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            k = "lower" if ch.islower() else "upper" if ch.isupper() else "nocase"
            if k == "lower" and 0x80 <= i < 0xC0:
                k = "symbol"
        elif ch.isdigit():
            k = "digit"
        elif ch in "\t|":
            k = "rule"
        elif ch.isspace():
            k = "blank"
        elif ch in _STOPS:
            k = "stop"
        elif ch in _COMMAS:
            k = "comma"
        elif ch in _QUOTES:
            k = "quote"
        elif ch in _RULES:
            k = "rule"
        elif 0x300 <= i < 0x370 or 0x900 <= i < 0xE80 or i in (0xAD, 0xFEFF) or 0x200B <= i < 0x2064:
            k = "nocase" if i >= 0x900 and i < 0xE80 else "blank"
        else:
            continue
        out[i] = CHARS.index(k)
    return out


_STRIP = ".,;:!?…“”„\"«»()'’‘-–—。、，！？「」।*_"
_CLOSE = "”»’'\")]」』“ "
_BEGINS_MARK = re.compile(r"\s*[-–—•*|>]")
_BEGINS_NUMBER = re.compile(r"\s*\d+[.):]?\s")
_COLUMNS = re.compile(r"\t|\||\S {3,}\S|\.{4,}|(?:. ){5,}\.|(?:\d[^\s]*[,;:/]?\s+){2,}\S*\d|(?:\d+, ){2,}\d|\b\d+d\d+")
_SEEN: dict[str, int] = {}


def _word_class(w: str) -> int:
    bare = w.strip(_STRIP)
    if not bare:
        return WORDS.index("marks")
    low = bare.lower()
    if low in _LANGUAGES:
        k = f"function_{_LANGUAGES[low]}"
    elif bare.isalpha() or all(x.isalpha() for x in re.split(r"[-‐‑'’.]", bare) if x):
        k = "lower_word" if bare.islower() else "capital" if bare[0].isupper() and (bare[1:].islower() or bare.isupper() or "-" in bare or len(bare) == 1) else "nocase_word" if not (bare.upper() != bare.lower()) else "mixed"
    elif re.fullmatch(r"[\d.,:/+\-–%]+", bare):
        k = "number"
    elif any("ऀ" <= c < "຀" or c >= "　" for c in bare):
        k = "nocase_word"
    else:
        k = "mixed"
    return WORDS.index(k)


def features(texts: list[str]) -> np.ndarray:
    """One row of counts (ALL) for each text."""
    n = len(texts)
    out = np.zeros((n, len(ALL)), np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _char_class()[signs].astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    out[:, : len(CHARS)] = np.bincount(owner * len(CHARS) + kinds, minlength=n * len(CHARS)).reshape(n, len(CHARS))
    w0, l0, c0 = len(CHARS), len(CHARS) + len(WORDS), len(CHARS) + len(WORDS) + len(LINES)
    seen = _SEEN
    if len(seen) > 300_000:
        seen.clear()
    for i, text in enumerate(texts):
        words = text.split()
        row = [0] * len(WORDS)
        for w in words:
            k = seen.get(w)
            if k is None:
                k = seen[w] = _word_class(w)
            row[k] += 1
        out[i, w0:l0] = row
        line_row = [0] * len(LINES)
        lines = stops = 0
        for line in text.split("\n"):
            s = line.strip()
            if not s:
                continue
            size = len(s)
            lines += 1
            last = s.rstrip(_CLOSE)[-1:]
            if last in _STOPS:
                line_row[0] += size
                stops += 1
            elif last.isdigit():
                line_row[3] += size
            elif last.isalpha() or "\u0900" <= last < "\u0e80":  # vowel signs too
                line_row[2] += size
            elif last in ",;:，、-‐—":
                line_row[1] += size
            else:
                line_row[4] += size
            if _BEGINS_MARK.match(s):
                line_row[5] += size
            elif _BEGINS_NUMBER.match(s):
                line_row[6] += size
            if _COLUMNS.search(s):
                line_row[7] += size
        out[i, l0:c0] = line_row
        out[i, c0:] = (sizes[i], len(words), sum(map(len, words)), lines, stops)
    return out


# Samples of each structure; invented.  Those of one structure but of another make are apart by "\f".
SAMPLES: dict[str, str] = {
    "prose": """The old clerk watched the river from the window, and the children waited near the gate until the rain had stopped. Nobody knew why the bell was ringing. He opened the door.\fThe miller and the baker walked past the quiet chapel and the dog followed them over the bridge and the wind came from the north and the lamp was lit in the tower and they were glad to be home
\fDer alte Wirt sah am Abend aus dem Fenster, weil die Kinder vor dem Tor auf den Regen warteten. Niemand wusste, warum die Glocke läutete. Er öffnete die Tür.
\fLe vieux marchand regardait la rivière par la fenêtre, mais les enfants attendaient près de la porte. Personne ne savait pourquoi la cloche sonnait. Il ouvrit la porte !
\fEl viejo pescador miraba el río desde la ventana, pero los niños esperaban junto a la puerta. Nadie sabía por qué sonaba la campana. ¿Quién abría la caja?
\fСтарый сторож смотрел на реку из окна, а дети ждали у ворот. Никто не знал, почему звонил колокол. Он открыл дверь.
\fबूढ़ा माली नदी के किनारे बैठा रहा, पर बच्चे बारिश के बाद घर गए। किसी ने दरवाज़ा नहीं खोला। वह चुपचाप चला गया।
\f老人は川のそばで長い手紙を読んでいた。子どもたちは門の前で雨が止むのを待っていた。誰も鐘の音を聞かなかった。
\f老人在河边看着一封很长的信，孩子们在门前等雨停。没有人知道为什么钟响了。他打开了门。
\fชายชรานั่งอ่านจดหมายริมแม่น้ำและเด็กๆรออยู่หน้าประตู ไม่มีใครรู้ว่าทำไมระฆังดัง เขาเปิดประตูบ้าน
\fThe tall stranger carried the lamp beyond the far wall, although the\nweary porter had forgotten the key of the gate and the dusty road was\nlong. Rovalen and Timoreth waited near the mill; the cold morn-\ning came. Then Mr. Rovalen closed the heavy door at 7 p.m. and left.""",
    "dialogue": """Rovalen: The lamp is out, and nobody has seen the key of the gate.\nTimoreth: Then we must wait here until the morning comes. Who has the rope?\f“Where is the lamp?” asked Rovalen. “I gave it to the porter,” said Timoreth, “before the bell rang.” “Then we are lost!” he cried.\f「鍵はどこですか？」と兄は言った。「門のそばにある。」と母は答えた。\f“钥匙在哪里？”哥哥问道。“在门边。”母亲说。""",
    "verse": """O river, bring the evening to the shore,\nAnd let the quiet lantern burn no more\nThe wind that carried Rovalen away\nShall sing beside the window with the day,\nWhen all the golden bells have ceased to ring\nThe weary garden waits for any spring""",
    "heading": "CHAPTER 1\fPART 2\fThe Long Winter of Rovalenith",
    "notice": "This edition is free to lend: please return it to the county archive\fScanned from the only known copy, shelf 14, box 9",
    "list": """- quiet marenolith, 12\n- golden rovalenuth, 8\n- old timorethasil, 31\n- hidden caroveluna, 5\f* narrow vashol, 7\n* gentle orepelu, 88\n* weary brianesul, 4\f• solemn wenav, 82\n• modern teluriba, 9\f– broken telibasu, 41\n– frozen rithanim, 3\f1. Quiet marenolith\n2. Golden rovalenuth\n3. Old timorethasil\n4. Hidden caroveluna\f17. Familiar brineral\f- lamp oil\n- two ropes\n- bread and salt\n- a long coat""",
    "index": """Marenolith, 12, 48, 301\nRovalenuth, 8\nTimorethasil, 31, 77, 154, 260\nCaroveluna, 5, 19\f  Harbour, 17\nHedge, 5, 88, 214\nHinge, 40""",
    "table": """| Quiet marenolith | 708 | 46 | 122 |\n| Golden rovalenuth | 31 | 802 | 9 |\n|---|---|---|---|\f| Lamp | 12 | oil |\n| Rope | 4 | hemp |\fMarenolith\tRovalenuth\t46.5\t11.2\t51.6\nTimorethasil\tCaroveluna\t9.1\t80.0\t7.7\fMarenolith    7570      23   yes\nRovalenuth    2629      59   --\nTimorethasil    1776     74   n/a\nCaroveluna     917       4   no""",
    "contents": """Quiet marenolith ........ 91\nGolden rovalenuth .................... 180\nOld timorethasil ....... 52\nHidden caroveluna ............................ 307\fChapter 1 ......... 3\nChapter 2 ......... 17\fThe Quiet Gate . . . . . . . . . 12\nThe Old Mill . . . . . . . . . 44""",
    "statistics": """Marenolith: HP 64, AC 20, 1d4+9, +3/+9\nRovalenuth: HP 58, AC 10, 1d8+8, -1/+3\nTimorethasil: HP 12, AC 9, 2d6-1, +0/+2\fSTR 12 DEX 14 CON 9 INT 10 WIS 8 CHA 15\nHP 30 AC 16 Speed 30""",
    "junk": """Kp3ZbQ81xwTfV+0mYc/9LrUdE72hNqSgA5jOiX4tKzB1vHyM6WnPe+aR8sCuDlFJ\nfoGk2Qx/TT5vb9ZmL0EwYd7RcN3p+UHaJi6SyKqXo8rV1gDtCe4MhBnWzAuPsIlF\f}{]~^<%:!;`|\\/#=+_-.,*&$>[ ?\n!:;<>|}{ ^^ ~~ #%*& =+-_ ,. ]][[ `\fxqz wvk jjq zzxw qkpt vvbn xxcd qwrt\f0x3F 0x1A 7f 9c e2 00 4d ff 81 aa\f#### @@@@ ~~~~ ==== ^^^^ ;;;; ////""",
}
NATURAL = frozenset({"prose", "dialogue", "verse", "heading", "notice"})
WEIGHTS = (0.35, 0.30, 0.35)
#: Signs of a line of a page.
PAGE_WIDTH = 64


@cache
def profiles() -> tuple[list[str], np.ndarray]:
    """(structure of each profile, counts), one profile per sample."""
    names, texts = [], []
    for name, sample in SAMPLES.items():
        for part in sample.split("\f"):
            names.append(name)
            texts.append(part.strip())
            # text of another script, read in the wrong encoding once or twice, is junk
            if name == "prose" and sum(c > "\u024f" for c in part) > len(part) / 2:
                once = part.strip().encode().decode("cp1252", "replace")
                names += ["junk", "junk"]
                texts += [once, once.encode().decode("cp1252", "replace")]
    return names, features(texts)


def _distributions(counts: np.ndarray) -> list[np.ndarray]:
    a, b, c = len(CHARS), len(CHARS) + len(WORDS), len(CHARS) + len(WORDS) + len(LINES)
    out = []
    for part in (counts[:, :a], counts[:, a:b], counts[:, b:c]):
        total = part.sum(1, keepdims=True).astype(float)
        out.append(np.divide(part, total, out=np.zeros(part.shape), where=total > 0))
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of every row of p from every row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(2)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(2)
    return (left + right) / 2


def language_profiles(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Counts of the prose of each language (of FUNCTION_WORDS) in subject_examples: the distributions of its function words and signs in running text.

    At most two rows a language: its texts as they are, and with the line ends of a page.
    """
    rows = table(spark, sf_dir, "subject_examples").where(F.col("text").isNotNull() & F.col("lang").isin(*FUNCTION_WORDS)).select("lang", "text")

    def count(c: dict[str, list]) -> dict[str, list]:
        paged = [textwrap.fill(t, PAGE_WIDTH) for t in c["text"]]
        return {"lang": c["lang"] * 2, "paged": [False] * len(paged) + [True] * len(paged), "f": features(c["text"] + paged).tolist()}

    sums = map_columns(rows, count, "lang string, paged boolean, f array<bigint>").groupBy("lang", "paged").agg(F.array(*(F.sum(F.col("f")[i]) for i in range(len(ALL)))).alias("f"))
    return np.array([r["f"] for r in sums.orderBy("lang", "paged").collect()], np.int64).reshape(-1, len(ALL))


def nearest(counts: np.ndarray, prose: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
    """(structure, divergence) of the nearest profile of every row of counts; ``prose`` holds further profiles of prose."""
    names, samples = profiles()
    if prose is not None:
        names, samples = [*names, *["prose"] * len(prose)], np.concatenate([samples, prose])
    total = sum(w * divergence(a, b) for w, a, b in zip(WEIGHTS, _distributions(counts), _distributions(samples)))
    best = total.argmin(1)
    return [names[i] for i in best], total[np.arange(len(best)), best]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of each page.

    Columns: book, source_page, words, mean_word_length, symbol_ratio, stop_line_share,
    common_word_share, structure, divergence, natural.  Blocks without page or text count for no
    page; blocks stored twice count once; a page without words has structure "blank" and counts as natural.
    """
    blocks = table(spark, sf_dir, "blocks").where(F.col("source_page").isNotNull() & F.col("text").isNotNull())

    def count(c: dict[str, list]) -> dict[str, list]:
        # one row per block, but a block long enough is still one vector
        return {"book": c["book"], "source_page": c["source_page"], "block_no": c["block_no"], "f": features(c["text"]).tolist()}

    vectors = map_columns(blocks.select("book", "source_page", "block_no", "text"), count, "book string, source_page int, block_no int, f array<bigint>")
    once = vectors.repartition("book", "source_page").dropDuplicates(["book", "source_page", "block_no"])
    sums = once.groupBy("book", "source_page").agg(F.array(*(F.sum(F.col("f")[i]) for i in range(len(ALL)))).alias("f"))

    prose = language_profiles(spark, sf_dir)

    def judge(c: dict[str, list]) -> dict[str, list]:
        f = np.array(c["f"], np.int64).reshape(-1, len(ALL))
        names, far = nearest(f, prose)
        col = {k: f[:, i].astype(float) for i, k in enumerate(ALL)}
        blank = col["words"] == 0
        one = lambda x: np.where(x > 0, x, 1.0)
        names = ["blank" if e else n for n, e in zip(names, blank)]
        return {
            "book": c["book"],
            "source_page": c["source_page"],
            "words": f[:, ALL.index("words")],
            "mean_word_length": np.round(col["word_chars"] / one(col["words"]), 6),
            "symbol_ratio": np.round((col["symbol"] + col["rule"]) / one(col["chars"]), 6),
            "stop_line_share": np.round(col["stop_lines"] / one(col["lines"]), 6),
            "common_word_share": np.round(sum(col[x] for x in FUNCTION) / one(col["words"]), 6),
            "structure": names,
            "divergence": np.round(np.where(blank, 0.0, far), 6),
            "natural": [n in NATURAL or n == "blank" for n in names],
        }

    kind = "book string, source_page int, words bigint, mean_word_length double, symbol_ratio double, stop_line_share double, common_word_share double, structure string, divergence double, natural boolean"
    return map_columns(sums, judge, kind)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, source_page) of the pages that aren't natural prose."""
    return pages(spark, sf_dir).where(~F.col("natural")).select("book", "source_page")
