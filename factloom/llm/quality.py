"""Per-document text quality statistics and a prose verdict (problem 9).

A text is cut into units: table rows, list items, headings and paragraphs (lines that one sentence runs
across are joined).  A unit is running text if it is long enough, enough of its words are common words of
any one language, and few are damaged or scrambled; items of a list and rows of a table must moreover be long, whole
sentences.  A document is prose if at least half of its characters (white space aside) lie in running
text and it is no boilerplate: a unit that repeats counts once, however short, and where the repetition
shares (duplicate lines and paragraphs, characters under the most frequent word n-gram) say that most of the
text is one thing over and over, no part of it is running text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A list of common words has at most so many rows.
WORD_ROWS = 100_000
#: Least share of common words in running text, and most of damaged words.
COMMON, DAMAGED = 0.16, 0.3
#: Least share of words that are common words with their letters in disorder, from which a text is scrambled.
SCRAMBLED = 0.06
#: Share of duplicate lines or paragraphs, or of characters under the most frequent n-gram, from which a text is boilerplate.
BOILERPLATE, GRAM_BOILERPLATE = 0.8, 0.5
#: Least words of a paragraph, and of a list item, that count as running text.
PARAGRAPH_WORDS, ITEM_WORDS = 7, 19

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MARK = re.compile(
    r"\s*(?:[-–—*•·▪◦‣§>+●○■□]+\s+|\[[ xX✓]?\]\s*|\(?(?:\d{1,3}(?:\.\d{1,3})*|[ivxlIVXL]{1,5}|[a-zA-Z])[.)]\s+|\d{1,3}(?:\.\d{1,3})+\s+|\(\d{1,3}\)\s*|\d{1,3}\s+(?=[^\W\d_]))"
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>")
_GAPS = re.compile(r"\S(?: {3,}|\t+ *| *\| *)(?=\S)")
_LEADER = re.compile(r"(?:\.\s?){5,}")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*\s*$")
_STOP = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()%/&-]")
_DAMAGE = re.compile(r"[^\W_][{}|\\^~¦¬§<>=#@*]|[{}|\\^~¦¬§<>=#@*][^\W_]|[ÃÂ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸÂ]|[ÃÂ]{2}|�|[^\W\d_]\d+[^\W\d_]")

#: Cheap signs without which there is no damage.
_SIGN, _DIGIT = re.compile(r"[{}|\\^~¦¬§<>=#@*ÃÂ\ufffd]"), re.compile(r"\d[^\W\d_]")


def _leader(line: str) -> bool:
    return line.count(".") >= 5 and bool(_LEADER.search(line))


def _table_row(line: str) -> bool:
    if ("   " in line or "\t" in line or "|" in line) and len(_GAPS.findall(line)) >= 2:
        return True
    if _STOP.search(line) and len(line) > 120:
        return False
    for sep in (";", ","):
        cells = line.split(sep)
        if len(cells) >= 3 and all(c == c.lstrip() for c in cells[1:]):  # no space behind the separator
            return True
    return False


def _joined(lines: list[str]) -> list[tuple[str, bool]]:
    """Neighbouring lines without marks as paragraphs; True with those that are items of a list."""
    if len(lines) == 1:
        return [(lines[0], False)]
    breaks = list(zip(lines, lines[1:], strict=False))
    open_breaks = [(a, b) for a, b in breaks if not _STOP.search(a)]
    if not open_breaks:
        longest = max(len(x) for x in lines)
        return [(" ".join(lines), False)] if longest > 60 or len(lines) < 4 else [(x, True) for x in lines]
    capital = sum(1 for _, b in open_breaks if b.lstrip()[:1].isupper() or not b.lstrip()[:1].isalpha())
    letters = "".join(lines)
    shouting = sum(c.isupper() for c in letters) > 0.6 * sum(c.isalpha() for c in letters)
    widths = sorted(len(x) for x in lines[:-1])
    top = widths[-1]
    full = sum(1 for w in widths if w >= 0.7 * top) >= 0.75 * len(widths) and top >= 40
    if shouting:
        is_list = not full
    else:
        is_list = capital > 0.6 * len(open_breaks) and not (full and capital < 0.8 * len(open_breaks))
        if is_list and len(open_breaks) < 3 and any(len(x.split()) >= PARAGRAPH_WORDS * 2 for x in lines):
            is_list = False
    if is_list:
        return [(x, True) for x in lines]
    return [(" ".join(lines), False)]


def units(text: str) -> Iterator[tuple[str, bool]]:
    """The text's units; True with list items, headings and table rows."""
    run: list[str] = []
    lines = re.split(r"\r\n|[\n\r  \x0b\x0c\x85]", text)
    marks = [bool(_MARK.match(_TAG.sub(" ", x) if "<" in x else x)) for x in lines]
    for n, line in enumerate(lines):
        bare = _TAG.sub(" ", line) if "<" in line else line
        marked = marks[n]
        if marked and run and not _STOP.search(run[-1].replace("Rs.", "")) and not (n + 1 < len(lines) and marks[n + 1]):
            # a lone figure or initial at the start of a wrapped line is no mark
            after = _MARK.sub("", bare, count=1)[:1]
            marked = after.isupper() and bare.lstrip()[:1] in "-–—*•·▪◦‣§>+●○■□[("
        if not bare.strip() or marked or _leader(bare) or bare != line or _table_row(bare):
            if run:
                yield from _joined(run)
                run = []
            if bare.strip():
                yield (line if bare == line else bare), True
        else:
            run.append(line)
    if run:
        yield from _joined(run)


class Judge:
    """Statistics and verdict of single texts."""

    def __init__(self, words: dict[str, frozenset[str]]) -> None:
        self.words = words
        self.all = frozenset().union(*words.values()) if words else frozenset()
        self.scrambled = lru_cache(maxsize=100_000)(self._scrambled)
        self.letters = frozenset("".join(sorted(w)) for w in self.all if len(w) > 1)

    def common(self, words: list[str]) -> int:
        """Words that are common in the one language that has most of them."""
        if not words:
            return 0
        counts = Counter(w for w in words if w in self.all)
        return max((sum(n for w, n in counts.items() if w in known) for known in self.words.values()), default=0)

    def running(self, unit: str, item: bool) -> bool:
        words = _WORD.findall(unit.lower())
        if len(words) < (ITEM_WORDS if item else PARAGRAPH_WORDS):
            return False
        tokens = unit.split()
        if len(words) < 0.5 * len(tokens):
            return False
        if item and (not _STOP.search(unit) or _leader(unit) or _table_row(unit)):
            return False
        if _SIGN.search(unit) or _DIGIT.search(unit):  # damage never reaches over white space, so most units need no look at each token
            damaged = sum(1 for t in tokens if _DAMAGE.search(t))
            if damaged > DAMAGED * len(tokens):
                return False
        if self.common(words) < COMMON * len(words):
            return False
        return sum(map(self.scrambled, words)) < max(2, SCRAMBLED * len(words))

    def _scrambled(self, word: str) -> bool:
        """Not a common word, but one with its letters in disorder."""
        return word not in self.all and "".join(sorted(word)) in self.letters

    def __call__(self, text: str) -> dict:
        words = _WORD.findall(text.lower())
        solid = len(text) - sum(map(text.count, " \t\n\r ")) or 1
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        paragraphs = [x.strip() for x in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if x.strip()]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = [(n * sum(map(len, g)), g) for g, n in grams.items() if n > 1]
        covered = max(repeated, default=(0, ()))[0]
        prose = 0
        seen: set[str] = set()
        for unit, item in units(text):
            if self.running(unit, item) and unit.strip() not in seen:
                prose += len(unit) - sum(map(unit.count, " \t\n\r "))
            seen.add(unit.strip())
        count = len(words)
        duplicate_lines = 1 - len(set(lines)) / len(lines) if lines else 0.0
        duplicate_paragraphs = 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0
        if max(duplicate_lines, duplicate_paragraphs) >= BOILERPLATE or covered >= GRAM_BOILERPLATE * solid:
            prose = 0
        return {
            "word_count": count,
            "mean_word_length": sum(map(len, words)) / count if count else None,
            "symbol_ratio": len(_SYMBOL.findall(text)) / len(text) if text else None,
            "lines_ending_in_punctuation": sum(1 for x in lines if _END.search(x)) / len(lines) if lines else None,
            "common_words": self.common(words) / count if count else None,
            "duplicate_lines": duplicate_lines if lines else None,
            "duplicate_paragraphs": duplicate_paragraphs if paragraphs else None,
            "top_gram_share": min(1.0, covered / solid),
            "prose_share": min(1.0, prose / solid) if text.strip() else None,
            "is_prose": prose >= 0.5 * solid if text.strip() else None,
        }


STATISTICS = T.StructType(
    [
        T.StructField("word_count", T.IntegerType()),
        *(
            T.StructField(c, T.DoubleType())
            for c in "mean_word_length symbol_ratio lines_ending_in_punctuation common_words duplicate_lines duplicate_paragraphs top_gram_share prose_share".split()
        ),
        T.StructField("is_prose", T.BooleanType()),
    ]
)


def text_quality(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) to (id, statistics..., is_prose), a row per input row.

    ``words`` has lang and word, the common words of each language; a text is measured by the language
    that has most of its words, whatever its lang says.  Shares of nothing are null: an empty, blank or
    null text has word_count 0 and a null verdict.  Whole texts are measured.  Other columns are ignored.
    """
    rows = words.where("word is not null").select(F.coalesce("lang", F.lit("")), F.lower("word")).limit(WORD_ROWS + 1).collect()
    if len(rows) > WORD_ROWS:
        raise ValueError("the list of common words has too many rows")
    known: dict[str, set[str]] = {}
    for lang, word in rows:
        known.setdefault(lang, set()).add(word)
    lists = {k: frozenset(v) for k, v in known.items()}
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *STATISTICS])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(lists)
        for batch in batches:
            found = [judge(t or "") for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[f.name] for x in found], f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], schema=arrow)

    return docs.mapInArrow(run, schema)
