"""Documents that are mostly stuffed keywords, term lists, codes, tags or links.

A text is cut into segments (lines, and sentences within lines). Each segment is measured: its share of function words in the language that fits it best, the shares
of its most frequent content word and word pair, separators and codes a word, copies of its line, and whether it stands in a list of short lines or runs on without
punctuation; links count as stuffed by themselves. Measures above a threshold give points, and a segment with two points is a string rather than a sentence.
A document is stuffed if more than half of its words stand in strings.

The thresholds are set per language from all documents: histograms of the measures over all segments (a fixed number of bins) give the share of function words that parts strings
from sentences best, and the value of every other measure that all but a few sentences stay below. A text is parsed once; the measures are written, then judged. Where no
language of the list is recognised, missing function words tell nothing and the other measures decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.staging import stage

#: Frequent function words of sentences, by language. Words that keywords and names of parts share with them (en, pas, me, now, de, d) are left out.
FUNCTION_WORDS = {
    "en": "a an the of to in is are was were be been being by and or for with from that this these those which where wherein when at as on it its into not no than can could may will would between so if each such any one has have had against without until after before only but also how what who their there they through under over during per least most more according claim thereof said".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und oder ist sind war wird werden wurde mit von vom zu zur zum im in an am auf aus bei nach für durch als dass wobei so wenn nicht sich auch über unter zwischen bis um kann können dadurch sowie oder gemäß bleibt es er sie wie welche welcher welches zeigt ohne nur noch je einen anspruch".split(),
    "fr": "le la les l un une des du et ou est sont était par pour avec dans sur au aux ce cette ces qui que dont où se sa son ses selon lorsque entre ne plus il elle ils il comme sans sous jusqu à leur lequel laquelle peut être caractérisé montre subsiste si quand chaque reste".split(),
    "es": "el la los las un una unos unas del y o e es son está están fue por para con al a su sus se que cuando donde entre como según lo no más este esta estos cual si sin sobre hasta desde cada tiene puede ser queda reivindicación".split(),
    "it": "il lo la i gli le un uno una del dello della dei degli delle al allo alla ai alle dal dalla nel nella nei nelle sul sulla e ed o è sono era che chi con per tra fra non si come quando dove mentre se anche più suo sua suoi può essere viene ha questo questa di da".split(),
    "pt": "o a os as um uma uns umas do da dos das no na nos nas ao à pelo pela e ou é são foi era que com por para não se como quando onde entre mais seu sua seus este esta pode ser tem em".split(),
    "nl": "het een of is zijn was wordt worden werd van in op te dat die dit deze met voor door aan bij uit om naar over als dan maar ook niet er nog wel zich wordt kan kunnen hij zij men tot onder tussen volgens waarin waarbij wanneer heeft hebben".split(),
    "ru": "и в во не на с со что а по это к но из у за от так же для как или при до бы если их его её он она они который которая которое которые этого том между под над чтобы когда где уже только был была были быть может".split(),
}
#: Last syllables of words in Korean sentences, and characters of Chinese sentences that have a grammatical use.
KOREAN_ENDS, CHINESE_CHARS = "은는이가을를의에로와과다며고도서", "的了是在和与或及为有不该个被将对于由从到这那也都就而其所以"

LANGUAGES = [*FUNCTION_WORDS, "ja", "ko", "zh"]
#: Measures are counted in this many bins from 0 to 1, the last one for 1 and above.
BINS = 64
#: For each measure the value used where a language has too few words to calibrate, and the limits of calibration.
LIMITS = {"function": (0.13, 0.09, 0.18), "top": (0.3, 0.25, 0.4), "pair": (0.16, 0.12, 0.25), "separators": (0.3, 0.22, 0.4), "codes": (0.3, 0.2, 0.5)}
#: Function measures of the languages that are not told by words: kana of all letters, words with an ending, characters with a use.
SPECIAL = {"ja": (0.15, 0.1, 0.2), "ko": (0.2, 0.15, 0.3), "zh": (0.06, 0.04, 0.08)}
MEASURES = list(LIMITS)
#: Words of a language from which it is calibrated; share of words of sentences that stay below a threshold.
LEAST_WORDS, BELOW = 20_000, 0.998

_ANCHOR = re.compile(r"<a\b[^>]*>.*?</a\s*>", re.I | re.S)
_HREF = re.compile(r"href\s*=\s*[\"']?([^\"'\s>]+)")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\w+|#\w\w+", re.I)
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[ぁ-ヿ㐀-鿿]+")
_HIRAGANA = re.compile(r"[ぁ-ゟ]")
_HANGUL = re.compile(r"[가-힣]")
#: Codes besides words of letters and digits: fractions and prices.
_FRACTION, _PRICE = re.compile(r"(?<!\d)\d+/\d+"), re.compile(r"\d\.\d\d\b")
#: Separators, a hyphen between blanks besides.
SEPARATORS, WIDE_SEPARATORS = "|;,>/#\t", "»›·•、，；"
_DIGIT = re.compile(r"\d")
_STOP = re.compile(r"[.!?。！？,;:，；：、]")

#: Word -> counts of the languages that have it as a function word, 20 bits each.
_COUNTS: dict[str, int] = {}
for _i, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in set(_words):
        _COUNTS[_w] = _COUNTS.get(_w, 0) | 1 << 20 * _i
_SHIFTS = [(20 * i, i) for i in range(len(FUNCTION_WORDS))]
_JA, _KO, _ZH = (LANGUAGES.index(x) for x in ("ja", "ko", "zh"))
#: Short lines in a row from which they are a list; words of a short line; copies from which a line is repeated, and repeated beyond any prose; words of a run-on segment, and of one beyond any prose.
LIST_LINES, SHORT, COPIES, MANY, RUN_ON, FAR_ON = 5, 6, 5, 10, 12, 40
#: Content words of a paragraph, and the share of one of them from which it fills the paragraph half and wholly.
FILL = (16, 0.2, 0.3)

#: Marks of a segment: in a list of short lines, copied, copied beyond any prose, run-on, ends like a sentence, in a paragraph that one word fills, of 3 words, of SHORT words, run-on beyond any prose, in a paragraph that one word half fills.
_LIST, _COPY, _FLOOD, _ENDLESS, _ENDS, _FILLED, _SOME, _LONG, _FAR, _HALF = (1 << i for i in range(10))
_SEGMENT = ["lang", *MEASURES, "marks", "words"]


def _sentences(line: str) -> list[str]:
    line = line.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
    if not line.isascii():
        line = line.replace("。", "。\n").replace("！", "！\n").replace("？", "？\n")
    return line.split("\n")


def _bin(x: float) -> int:
    return min(BINS, int(x * BINS))


def _most(items: list) -> int:
    return Counter(items).most_common(1)[0][1] if items else 0


def language_of(lang: str | None) -> int | None:
    """The number of a language tag's language, None if it is not in the list."""
    tag = re.split(r"[-_ ]", lang.strip().lower())[0] if lang else ""
    return LANGUAGES.index(tag) if tag in LANGUAGES else None


def _spaced(words: list[str], hangul: bool) -> tuple[int, float, list[str]]:
    """The language whose function words (Korean: endings) are most frequent, their share, and the words of more than three letters that are function words of no language."""
    got = sum(map(_COUNTS.get, words, repeat(0)))
    rest = [w for w in words if len(w) > 3 and w not in _COUNTS]
    best, most = -1, 0
    if got:
        for shift, i in _SHIFTS:
            if (k := got >> shift & 0xFFFFF) > most:
                best, most = i, k
    if hangul and not most:
        best, most = _KO, sum("가" <= w[-1] <= "힣" and w[-1] in KOREAN_ENDS for w in words)
    return best, most / len(words), rest


def _wide(letters: str, kana: bool) -> tuple[int, float, list[str]]:
    """The same for Japanese and Chinese letters; pairs of letters stand for words."""
    rest = [letters[i : i + 2] for i in range(0, len(letters), 2)]
    if kana:
        return _JA, len(_HIRAGANA.findall(letters)) / len(letters), rest
    return _ZH, sum(map(letters.count, CHINESE_CHARS)) / len(letters), rest


def measure(text: str | None, lang: str | None = None) -> tuple[float, float, list[tuple]]:
    """Words of a text, words within its links, and its other segments as tuples of language, bins of the measures, marks and words; equal segments are added up.

    A segment's language is the one that fits it if sentences of the text show that language, else that of most sentences or of the tag ``lang``, and -1 where neither
    is known.
    """
    if not text:
        return 0.0, 0.0, []
    total = linked = 0.0
    text = text.lower()
    if "<" in text:
        for m in _ANCHOR.finditer(text):
            n = len(_WORD.findall(_TAG.sub(" ", m.group()))) + len(_WORD.findall(" ".join(_HREF.findall(m.group()))))
            total += n
            linked += n
        text = _TAG.sub(" ", _ANCHOR.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    links = "http" in text or "www." in text or "@" in text or "#" in text
    wide = not text.isascii() and _CJK.search(text) is not None
    hangul = not text.isascii() and _HANGUL.search(text) is not None
    kana = wide and _HIRAGANA.search(text) is not None
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    copies = Counter(lines)
    out: list[list] = []
    listed: set[int] = set()
    short: list[int] = []  # segments of short lines in a row
    for line in [*lines, ""]:
        at, content = len(out), []
        mark = (_COPY if copies[line] >= COPIES else 0) | (_FLOOD if copies[line] >= MANY and 2 * copies[line] > len(lines) else 0)
        for s in _sentences(line):
            own, body, letters = 0, s, ""
            if links and (found := _LINK.findall(s)):
                own = sum(len(_WORD.findall(x)) for x in found)
                body = _LINK.sub(" ", s)
            if wide and (letters := "".join(_CJK.findall(body))):
                words = _WORD.findall(_CJK.sub(" ", body))
            else:
                words = _WORD.findall(body)
            n = len(words) + len(letters) / 2
            total += n + own
            linked += own
            if own >= n:
                linked += n
                continue
            if 2 * len(words) < len(letters):
                best, share, rest = _wide(letters, kana)
                top, pair = _share(rest, len(rest)), 0.0
            else:
                best, share, rest = _spaced(words, hangul)
                again = len(set(rest)) < len(rest)
                top, pair = (_share(rest, len(words)) if again else 1 / len(words) if len(rest) >= 4 else 0.0), (_pairs(words) if again and len(words) > 6 else 0.0)
                content += rest
            separators = sum(map(body.count, SEPARATORS)) + body.count(" - ") + (0 if body.isascii() else sum(map(body.count, WIDE_SEPARATORS)))
            codes = 0
            if _DIGIT.search(body):
                codes = len(words) - sum(map(str.isalpha, words)) - sum(map(str.isdigit, words)) + (len(_FRACTION.findall(body)) if "/" in body else 0) + (len(_PRICE.findall(body)) if _PRICE.search(body) else 0)
            marks = mark | (_SOME if n >= 3 else 0) | (_LONG if n >= SHORT else 0) | (_ENDS if body.rstrip()[-1:] in ".!?。！？:" else 0)
            if n >= RUN_ON and (len(_STOP.findall(body)) - (marks & _ENDS > 0)) * FAR_ON < n:
                marks |= _ENDLESS | (_FAR if n >= FAR_ON else 0)
            out.append([best, share, top, pair, separators / n, codes / n, marks, n])
        if len(content) >= FILL[0] and (fill := _share(content, len(content))) >= FILL[1]:
            for x in out[at:]:
                x[6] |= (_FILLED if fill >= FILL[2] else _HALF) if x[0] not in (_JA, _ZH) else 0
        if len(out) == at + 1 and out[at][7] <= SHORT and not out[at][6] & _ENDS:
            short.append(at)
        elif len(out) > at or not line:
            listed.update(short if len(short) >= LIST_LINES else ())
            short = []
    return total, linked, _cells(out, listed, language_of(lang))


def _share(items: list, of: int) -> float:
    if len(items) < 4:
        return 0.0
    return (max(Counter(items).values()) if len(set(items)) < len(items) else 1) / of


def _pairs(words: list[str]) -> float:
    """Share of the most frequent pair of words that has a content word of more than three letters."""
    return max((k for (a, b), k in Counter(zip(words, words[1:])).items() if len(a) > 3 and a not in _COUNTS or len(b) > 3 and b not in _COUNTS), default=0) / (len(words) - 1)


def _cells(out: list[list], listed: set[int], hint: int | None) -> list[tuple]:
    seen: Counter = Counter()
    plain = 0.0
    for i, x in enumerate(out):
        if x[7] >= SHORT and i not in listed and x[4] < LIMITS["separators"][0] and x[5] < LIMITS["codes"][0]:
            plain += x[7]
            if x[0] >= 0 and x[1] >= least(x[0])[0]:
                seen[x[0]] += x[7]
    main = seen.most_common(1)[0][0] if seen else -1
    base = main if main >= 0 and (seen[main] >= 0.25 * plain or hint is None) else hint if hint is not None else -1
    if hint is None and main >= 0 and seen[main] < 0.5 * plain:
        base = -1
    cells: dict[tuple, float] = {}
    for i, x in enumerate(out):
        key = (x[0] if x[0] in seen else base, *[min(BINS, int(y * BINS)) for y in x[1:6]], x[6] | (_LIST if i in listed else 0))
        cells[key] = cells.get(key, 0.0) + x[7]
    return [(*k, w) for k, w in cells.items()]


def least(lang: int) -> tuple[float, float, float]:
    """Default and limits of the share of function words."""
    return SPECIAL.get(LANGUAGES[lang], LIMITS["function"]) if lang >= 0 else LIMITS["function"]


def default_thresholds() -> list[list[int]]:
    """Bins of the measures from which they give a point (function words: below which), by number of the language; the last list is for an unknown one."""
    return [[_bin(least(i)[0]), *(_bin(LIMITS[m][0]) for m in MEASURES[1:])] for i in [*range(len(LANGUAGES)), -1]]


def are_strings(cells: np.ndarray, thresholds: list[list[int]]) -> np.ndarray:
    """Which segments of :func:`measure`, one a row without its words, are strings: two points of their measures together."""
    lang, share, *measures, marks = cells.T
    t = np.array(thresholds)[lang].T  # -1 is the last
    has = lambda mark: (marks & mark) > 0
    blank = share < t[0]
    lacks = blank & (lang >= 0) & has(_SOME)
    points = lacks.astype(int) + (lacks & has(_LONG) & (3 * share < t[0])) + (has(_LONG) & ~has(_ENDS))
    for x, y in zip(measures, t[1:]):
        points += has(_SOME) * ((x >= y).astype(int) + (x >= 2 * y))
    points += (blank | (lang < 0)) * (2 * has(_LIST) + has(_ENDLESS) + has(_FAR) + has(_HALF))
    return points + has(_COPY) + 2 * has(_FLOOD) + 2 * has(_FILLED) >= 2


def stuffed_share(text: str | None, lang: str | None = None, thresholds: list[list[int]] | None = None) -> tuple[float, float]:
    """The number of words of a text and the share of them in strings (0.0 for a text without words), by default thresholds if none are given."""
    total, linked, cells = measure(text, lang)
    if cells:
        words = np.array([c[-1] for c in cells])
        linked += float(words[are_strings(np.array([c[:-1] for c in cells]), thresholds or default_thresholds())].sum())
    return total, linked / total if total else 0.0


def _parting(counts: list[float]) -> int:
    """The bin that parts a histogram into two classes of the largest variance between them."""
    total, mean = sum(counts), sum(i * c for i, c in enumerate(counts))
    best, at, below, sum_below = -1.0, 0, 0.0, 0.0
    for i, c in enumerate(counts[:-1]):
        below += c
        sum_below += i * c
        if 0 < below < total:
            between = below * (total - below) * (sum_below / below - (mean - sum_below) / (total - below)) ** 2
            if between > best:
                best, at = between, i + 1
    return at


def calibrate(measured: DataFrame) -> list[list[int]]:
    """Thresholds per language from all segments of ``measured`` (see :func:`measured`); languages of fewer than LEAST_WORDS words keep the defaults.

    What reaches the driver is one count for each language, function bin, measure and bin at most.
    """
    seg = measured.select(F.explode("segments").alias("s")).select("s.*").where(F.col("lang").between(0, len(LANGUAGES) - 1) & (F.col("marks").bitwiseAND(_LONG) > 0))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(m).alias("bin")) for i, m in enumerate(MEASURES)])).alias("m")
    counts = seg.groupBy("lang", *MEASURES).agg(F.sum("words").alias("words")).select("lang", "function", "words", each)
    rows = counts.groupBy("lang", "function", "m.i", "m.bin").agg(F.sum("words").alias("words")).collect()
    out = default_thresholds()
    for lang in {r["lang"] for r in rows}:
        mine = [r for r in rows if r["lang"] == lang]
        share = [0.0] * (BINS + 1)
        for r in mine:
            share[r["function"]] += r["words"] if r["i"] == 0 else 0
        if sum(share) < LEAST_WORDS:
            continue
        _, low, high = least(lang)
        out[lang][0] = min(max(_parting(share), _bin(low)), _bin(high))
        for i, m in enumerate(MEASURES[1:], 1):
            count = [0.0] * (BINS + 1)
            for r in mine:
                if r["i"] == i and r["function"] >= out[lang][0]:
                    count[r["bin"]] += r["words"]
            all_, bin_ = sum(count), 0
            while bin_ < BINS and sum(count[:bin_]) < BELOW * all_:
                bin_ += 1
            out[lang][i] = min(max(bin_, _bin(LIMITS[m][1])), _bin(LIMITS[m][2]))
    return out


def measured(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Every text parsed once, written: ``doc_id``, ``n_words``, ``linked``, ``segments`` (see :func:`measure`)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, linked, sizes, flat = [], [], [0], []
            for t, g in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                n, k, cells = measure(t, g)
                total.append(n)
                linked.append(k)
                flat += cells
                sizes.append(len(flat))
            columns = list(zip(*flat)) or [()] * len(_SEGMENT)
            struct = pa.StructArray.from_arrays([pa.array(c, pa.float64() if name == "words" else pa.int32()) for name, c in zip(_SEGMENT, columns)], _SEGMENT)
            segments = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.float64()), pa.array(linked, pa.float64()), segments], ["doc_id", "n_words", "linked", "segments"])

    tag = f"cast(`{lang}` as string)" if lang and lang in documents.columns else "cast(null as string)"
    rows = documents.selectExpr(f"cast(`{id}` as long) as doc_id", f"cast(`{text}` as string) as text", f"{tag} as lang")
    kind = ", ".join(f"{c}: {'double' if c == 'words' else 'int'}" for c in _SEGMENT)
    return stage(rows.mapInArrow(parse, f"doc_id long, n_words double, linked double, segments array<struct<{kind}>>"), "measured")


def stuffing(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``stuffed_share``.

    The whole text counts. NULL and empty texts have no words and share 0. ``lang`` names a column of language tags, if there is one; wrong and missing tags do
    little harm, as the text's own sentences count first. Repeated rows give repeated results; other columns are ignored, and an empty table gives no rows.
    """
    rows = measured(documents, id, text, lang)
    thresholds = calibrate(rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("segments")
            struct = lists.flatten()
            flat = [c.to_numpy(zero_copy_only=False) for c in struct.flatten()]
            of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            strings = are_strings(np.stack(flat[:-1], axis=1), thresholds) if len(of) else np.zeros(0, bool)
            n = batch.column("n_words").to_numpy(zero_copy_only=False)
            stuffed = batch.column("linked").to_numpy(zero_copy_only=False) + np.bincount(of, flat[-1] * strings, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(np.where(n > 0, stuffed / np.maximum(n, 1e-9), 0.0))], ["doc_id", "n_words", "stuffed_share"])

    return rows.mapInArrow(judge, "doc_id long, n_words double, stuffed_share double")


def stuffed_documents(documents: DataFrame, id: str = "doc_id", text: str = "text", share: float = 0.5, lang: str | None = "lang") -> DataFrame:
    """Documents with more than ``share`` of their words in strings: ``doc_id``."""
    return stuffing(documents, id, text, lang).where(f"stuffed_share > {share}").select("doc_id")
