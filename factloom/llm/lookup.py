"""Mapping free-entered values to a canonical list (problem 5).

Symmetric-delete dictionary: every reference word, and the start of every reference phrase, is filed under
all strings that deleting up to two of its letters leaves.  A typed word finds the words within two edits
by its own deletions, a handful of look-ups whatever the dictionary's size; a phrase is found if its words
match one to one, in any order, each typed right, wrong, or short (initials, consonants), or if it agrees
as a whole with all blanks removed.  Candidates rank by weighted Damerau-Levenshtein cost, then by how
often the reference entry is typed exactly.  What nothing matches is reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.edits import edits
from factloom.llm.names import aliases_of
from factloom.sources.tables import Scratch

UNMATCHED = "unmatched"
#: Reference phrases that a dictionary holds, about: a longer list falls into blocks, each looked up on its own.
BLOCK_PHRASES = 20_000
#: Distinct values that one task looks up in a block, about.
CHUNK_VALUES = 20_000
#: Letters of a phrase under whose deletions it is filed.
PREFIX = 12
#: Distinct values whose result a worker remembers.
REMEMBERED = 100_000

# Words that carry no meaning of their own in a name of a metric.
STOP = frozenset("the of in and to a an for by on".split())
# Neighbours on a typewriter's keys.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {frozenset(p) for row in ROWS for p in zip(row, row[1:], strict=False)} | {
    frozenset(p) for up, down in zip(ROWS, ROWS[1:], strict=False) for k, c in enumerate(down) for p in ((c, up[k]), (c, up[min(k + 1, len(up) - 1)]))
}

_LEAD = re.compile(
    r"^(?:[-–—*•·▪◦>+#]+\s*|the\s+|\(?[ivx]{1,5}[.)]\s+|\([ivx]{1,5}\)\s*|\(?[a-z][)]\s+|\(?\d{1,3}(?:\.\d{1,3})*[.)]?\s+|\d{1,3}(?:\.\d{1,3})+\s*)"
)
_TAIL = re.compile(
    r"(?:\s*[\[(][^\[\]()]*[\])]?|\s+[-–—]\s+as\s+\w+|\s*[*:;.,†‡#]+|\s*[-–—]+|\s+(?:as\s+restated|restated|reported))$"
)
_TOKEN = re.compile(r"([a-z0-9]+)-?(\.)?")
#: Brackets anywhere, and what a rearranged value leaves of them at its ends.
_BRACKETS = re.compile(r"[\[(][^\[\]()]*[\])]|^\S+\)\s|\s\(\S*$")


def clean(text: str) -> str:
    """Lower case, without accents, numbering, bullets, notes, units in brackets and the like."""
    s = unicodedata.normalize("NFKD", text)
    s = "".join(c for c in s if not unicodedata.combining(c)).lower().replace("_", " ").replace("​", "")
    s = " ".join(s.split())
    while (shorter := _LEAD.sub("", s)) != s and shorter:
        s = shorter
    while True:
        shorter = _TAIL.sub("", s) if not re.search(r"\b[a-z]{1,5}\.$", s) else re.sub(r"(?<=[^a-z0-9.])[*:;,†‡#]+$", "", s)
        if shorter == s or not shorter.strip():
            return s
        s = shorter.rstrip()


def looser(a: str, b: str) -> float | None:
    """Cost of a badly typed word, for use among well typed ones; None if it can't be the same."""
    size = max(len(a), len(b))
    if min(len(a), len(b)) < 4 or size < 5 or (a[0] != b[0] and a[1:2] != b[1:2]):
        return None
    found = edits(b, a, 2 if size < 8 else 3)
    return None if found is None or (a[0] != b[0] and len(found) > 2) else 2.0 + 0.3 * len(found)


class Token(NamedTuple):
    word: str
    dotted: bool


def tokens_of(text: str) -> list[Token]:
    """Words, 0 and 1 inside words read as o and l."""
    found = []
    for t, dot in _TOKEN.findall(text):
        if re.search(r"[01]", t) and re.search(r"[a-z]", t):
            t = t.replace("0", "o").replace("1", "l")
        found.append(Token(t, bool(dot)))
    return found


def deletions(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, most + 1):
        if k < len(word):
            for gone in combinations(range(len(word)), k):
                out.add("".join(c for n, c in enumerate(word) if n not in gone))
    return out


def letters_of(word: str) -> int:
    """The word's set of letters, as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def skeleton(word: str) -> str:
    return word[:1] + re.sub(r"[aeiou]", "", word[1:])


def allowed(size: int) -> int:
    return 0 if size < 4 else 1 if size < 6 else 2 if size < 11 else 3


def slip_cost(a: str, b: str, most: int) -> float | None:
    """Weighted Damerau-Levenshtein cost of typing a for b; None if they are different words.

    Doubled letters, swaps and neighbouring keys are cheap.  Two letters replaced close together, or a
    word of up to seven letters that starts otherwise and differs twice, are another word.
    """
    found = edits(b, a, most)
    if found is None:
        return None
    if len(found) >= 2:
        subs = [p for k, p in found if k == "sub"]
        if any(y - x <= 2 for x, y in zip(subs, subs[1:], strict=False)):
            return None
        if max(len(a), len(b)) < 8 and (a[:1] != b[:1] or len(subs) > 1):
            return None
    cost = 0.0
    for kind, p in found:
        if kind == "swap":
            cost += 0.7
        elif kind == "sub":
            q = min(p, len(a) - 1)
            cost += 0.8 if q >= 0 and p < len(b) and frozenset((a[q], b[p])) in _NEAR else 1.0
        elif kind == "ins":
            q = min(p, len(a) - 1)
            cost += 0.6 if q > 0 and (a[q] == a[q - 1] or a[q : q + 1] == a[q + 1 : q + 2]) else 0.9
        else:
            cost += 0.9
    return cost


class Dictionary:
    """Reference phrases for look-up.  entries: (entry id, phrase); frequency: exact uses by entry id."""

    def __init__(self, entries: list[tuple[str, str]], frequency: dict[str, int]) -> None:
        self.frequency = frequency
        self.phrases: list[tuple[str, tuple[str, ...], str]] = []
        seen = set()
        for entry, phrase in entries:
            plain = clean(phrase)
            for variant in dict.fromkeys((plain, re.sub(r"(?<=[a-z])-(?=[a-z])", "", plain))):
                words = tuple(t.word for t in tokens_of(variant))
                if words and (entry, words) not in seen:
                    seen.add((entry, words))
                    self.phrases.append((entry, words, "".join(words)))
        self.exact: dict[str, list[int]] = {}
        self.holds: dict[str, list[int]] = {}
        self.starts: dict[str, list[int]] = {}
        words: set[str] = set()
        for n, (_, parts, joined) in enumerate(self.phrases):
            self.exact.setdefault(" ".join(parts), []).append(n)
            for d in deletions(joined[:PREFIX], 2 if len(joined) > 7 else 1):
                self.starts.setdefault(d, []).append(n)
            for w in set(parts):
                words.add(w)
                if w not in STOP:
                    self.holds.setdefault(w, []).append(n)
        self.words = words
        self.filed: dict[str, list[str]] = {}
        for w in words:
            for d in deletions(w, allowed(len(w))):
                self.filed.setdefault(d, []).append(w)
        self.bones: dict[str, list[str]] = {}
        for w in sorted(words):
            if w[0] in "aeiou" and len(bare := re.sub(r"[aeiou]", "", w)) >= 3:
                self.bones.setdefault(bare, []).append(w)
        self.longest = max(map(len, words), default=0)
        self.sorted = sorted(words)
        self.skeletons: dict[str, list[str]] = {}
        self.initial: dict[str, list[tuple[int, str]]] = {}
        for w in self.sorted:
            for k in {skeleton(w), skeleton(w).rstrip("s")}:
                self.skeletons.setdefault(k, []).append(w)
            self.initial.setdefault(w[0], []).append((letters_of(w), w))
        self.candidates = lru_cache(maxsize=REMEMBERED)(self._candidates)

    def _candidates(self, token: Token) -> dict[str, float]:
        """Reference words a typed word may stand for, with their costs."""
        t = token.word
        out: dict[str, float] = {}
        if t in self.words:
            out[t] = 0.0
        near = deletions(t, allowed(len(t))) if len(t) <= self.longest + 3 else ()
        for w in {w for d in near for w in self.filed.get(d, ())}:
            most = allowed(max(len(t), len(w)))
            cost = slip_cost(t, w, most) if most else None
            if cost is not None:
                out[w] = min(cost, out.get(w, 9.0))
        if t.endswith("s") and len(t) > 3 and t[:-1] in self.words:
            out[t[:-1]] = 0.2
        if t + "s" in self.words:
            out[t + "s"] = 0.2
        def short(w: str, cost: float) -> None:
            if len(t) < len(w):
                out[w] = min(cost, out.get(w, 9.0))

        if len(t) >= 3 or token.dotted:
            for n in range(bisect_left(self.sorted, t), len(self.sorted)):
                if not self.sorted[n].startswith(t):
                    break
                short(self.sorted[n], 0.5 if token.dotted else 0.6)
        if len(t) >= 2:
            for w in self.skeletons.get(t, ()):
                if not w.startswith(t) and (t == skeleton(w) or len(t) > 2):
                    short(w, 0.5)
        if len(t) >= 3:
            mask = letters_of(t)
            for letters, w in self.initial.get(t[0], ()):
                if not mask & ~letters and w not in out and len(t) <= 0.8 * len(w) and _subsequence(t, w):
                    short(w, 0.9)
        for w in self.bones.get(t, ()):
            out.setdefault(w, 0.7)
        return out

    def look_up(self, text: str) -> tuple[str, float] | None:
        """The entry a typed value means and the cost; None if there is none."""
        s = clean(text)
        found = self._find(s)
        if not found:
            bare = " ".join(_BRACKETS.sub(" ", s).split())
            bare = re.sub(r"(?:^|\s)(?:\d+(?:\.\d+)*\.?|[-–—*•]+)(?=\s|$)", " ", bare).strip()
            if bare != s:
                found = self._find(bare)
        if not found and re.search(r"[a-z]-[a-z]", s):
            found = self._find(re.sub(r"(?<=[a-z])-(?=[a-z])", "", s))
        if not found:
            return None
        best = min(
            ((cost, -self.frequency.get(self.phrases[n][0], 0), self.phrases[n][0]) for cost, n in found),
            key=lambda x: (round(x[0], 3), x[1], x[2]),
        )
        return best[2], best[0]

    def _find(self, s: str) -> list[tuple[float, int]]:
        tokens = tokens_of(s)
        if not tokens:
            return []
        found = [(0.0, n) for n in self.exact.get(" ".join(t.word for t in tokens), ())]
        if found:
            return found
        joined = "".join(t.word for t in tokens)
        single = sum(len(t.word) == 1 for t in tokens)
        if len(tokens) >= 3 and single >= 0.7 * len(tokens):
            return [(0.1, n) for n in self.exact.get(joined, ())] or self._as_whole(joined) or self._as_whole(joined.removeprefix("the"))
        found = self._by_words(tokens)
        if found or len(tokens) > 3:
            return found or self._as_whole(joined)
        found = self._as_whole(joined)
        if not found and joined.startswith("the"):
            found = self._as_whole(joined[3:])
        if not found and len(tokens) == 1 and (parts := self._parts(joined.removeprefix("the"))):
            found = self._by_words([Token(w, False) for w in parts])
        return found

    def _parts(self, joined: str) -> list[str]:
        """The reference words and stop words a string without blanks consists of; [] if it doesn't.

        A string longer than all reference phrases together with their stop words can match none.
        """
        if len(joined) > 2 * max((len(x) for _, _, x in self.phrases), default=0):
            return []
        ways: list[list[str] | None] = [[]] + [None] * len(joined)
        for end in range(1, len(joined) + 1):
            for start in range(max(0, end - max(self.longest, 3)), end):
                w = joined[start:end]
                way = ways[start]
                if way is not None and (w in self.words or (w in STOP and len(w) > 1)) and (ways[end] is None or len(way) + 1 < len(ways[end])):
                    ways[end] = [*way, w]
        return ways[-1] or []

    def _by_words(self, tokens: list[Token]) -> list[tuple[float, int]]:
        content = [t for t in tokens if t.word not in STOP or t.dotted]
        if not content:
            return []
        options = [self.candidates(t) for t in content]
        if len(content) > 1 and any(not o for o in options):
            # a stray letter goes; one badly typed word among well typed ones may be looser
            kept = [k for k, t in enumerate(content) if options[k] or len(t.word) > 1]
            content, options = [content[k] for k in kept], [options[k] for k in kept]
            missing = [k for k, o in enumerate(options) if not o]
            if len(missing) == 1 and len(content) > 1:
                return self._but_one(content, options, missing[0])
        if any(not o for o in options):
            return []
        # phrases that hold a candidate of the word with the fewest
        least = min(options, key=len)
        phrases = {n for w in least for n in self.holds.get(w, ())}
        typed = [t.word for t in tokens]
        found = []
        for n in phrases:
            words = self.phrases[n][1]
            need = [w for w in words if w not in STOP]
            if len(need) != len(content):
                # a stop word may be typed short and then look like content
                need = list(words)
                if len(need) != len(content):
                    continue
            cost = _assign(options, need)
            if cost is None:
                continue
            slips = sum(1 for t, o in zip(content, options, strict=True) if o.get(t.word) != 0.0)
            if slips == len(content) and len(content) == 1 and cost > 1.5:
                continue
            order = 0.0 if [w for w in typed if w not in STOP] == need else 0.01
            found.append((cost + order, n))
        if not found and len(content) > 1:
            for odd in range(len(content)):
                found += self._but_one(content, options, odd)
        return found

    def _but_one(self, content: list[Token], options: list[dict[str, float]], odd: int) -> list[tuple[float, int]]:
        others = [o for k, o in enumerate(options) if k != odd]
        if any(not o for o in others):
            return []
        least = min(others, key=len)
        found = []
        for n in {n for w in least for n in self.holds.get(w, ())}:
            need = [w for w in self.phrases[n][1] if w not in STOP]
            if len(need) != len(content):
                continue
            for k, w in enumerate(need):
                cost = looser(content[odd].word, w)
                if cost is not None:
                    rest = _assign(others, need[:k] + need[k + 1 :])
                    if rest is not None and rest <= 1.0:
                        found.append((cost + rest, n))
        return found

    def _as_whole(self, joined: str) -> list[tuple[float, int]]:
        if len(joined) < 4:
            return []
        most = 1 if len(joined) < 8 else 2 if len(joined) < 16 else 3
        found = []
        for n in {n for d in deletions(joined[:PREFIX], 2 if len(joined) > 7 else 1) for n in self.starts.get(d, ())}:
            target = self.phrases[n][2]
            if len(target) < 5 and target != joined:
                continue
            cost = slip_cost(joined, target, most)
            if cost is not None:
                found.append((cost, n))
        return found


def _subsequence(short: str, word: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in short)


def _assign(options: list[dict[str, float]], need: list[str]) -> float | None:
    """Least cost of matching typed words to phrase words one to one; None if they don't match."""
    if len(options) == 1:
        return options[0].get(need[0])
    order = sorted(range(len(options)), key=lambda k: sum(w in options[k] for w in need))
    best: float | None = None

    def place(k: int, used: int, cost: float) -> None:
        nonlocal best
        if best is not None and cost >= best:
            return
        if k == len(order):
            best = cost
            return
        row = options[order[k]]
        for n, w in enumerate(need):
            if not used >> n & 1 and w in row:
                place(k + 1, used | 1 << n, cost + row[w])

    place(0, 0, 0.0)
    return best


def map_values(
    values: DataFrame, reference: DataFrame, id_col: str = "candidate_id", name_col: str = "concept_name",
    entry_col: str = "id", canonical_col: str = "canonical_name", aliases_col: str = "aliases_json",
) -> DataFrame:
    """(id, name) to (id, entry, cost): a row per id with a non-blank name; entry is ``unmatched`` for misses.

    Of several rows with one id the latest ingested counts if there is an ingested_at, then the largest
    name.  Null ids are left out, null and blank names too.  Reference rows with a null id, and null or
    blank names and aliases, are ignored; an empty reference list leaves all unmatched.  The cost is null for
    misses.  Equal costs go to the entry typed exactly more often, then to the smaller id.  Every distinct value
    is looked up once in every block of the list; neither the list nor the values ever come together.
    """
    keep = F.col(name_col).rlike(r"(?U)[^\s]") & F.col(id_col).isNotNull()
    latest = F.struct(*([F.col("ingested_at")] if "ingested_at" in values.columns else []), F.col(name_col).alias("_name"))
    once = values.where(keep).groupBy(F.col(id_col).alias("_id")).agg(F.max(latest)["_name"].alias("_name"))
    scratch = Scratch(values.sparkSession)
    once, _ = scratch.cut(once)
    typed, _ = scratch.cut(_with_key(once.groupBy("_name").agg(F.count("*").alias("n")), "_name"))
    named = reference.where(F.col(entry_col).isNotNull()).select(F.col(entry_col).cast("string").alias("entry"), F.col(canonical_col).alias("name"), F.col(aliases_col).alias("aliases"))
    phrases, _ = scratch.cut(_with_key(_phrases(named), "phrase"))
    # how often each entry is typed exactly; a phrase of several entries counts for each
    owner = phrases.select("key", "entry").distinct()
    often = typed.where("key <> ''").join(owner, "key").groupBy("entry").agg(F.sum("n").alias("often"))
    listed, _ = scratch.cut(phrases.select("entry", "phrase").join(often, "entry", "left").select("entry", "phrase", F.coalesce("often", F.lit(0)).alias("often")))
    blocks = max(1, -(-listed.count() // BLOCK_PHRASES))
    chunks = max(1, -(-typed.count() // CHUNK_VALUES))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # entries stay whole, so that ties within one are settled in one place
    left = typed.select("_name", place("_name", chunks).alias("chunk"), every(blocks).alias("block"))
    right = listed.select("entry", "phrase", "often", every(chunks).alias("chunk"), place("entry", blocks).alias("block"))
    found = T.StructType([T.StructField("_name", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("cost", T.DoubleType()), T.StructField("often", T.LongType())])

    def find(names: pa.Table, block: pa.Table) -> pa.Table:
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("entry", "phrase", "often")), strict=True))
        often = {entry: n for entry, _, n in rows}
        dictionary = Dictionary([(entry, phrase) for entry, phrase, _ in rows], often)
        out = [(x, *f, often.get(f[0], 0)) for x in names.column("_name").to_pylist() if (f := dictionary.look_up(x))]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=found.names)

    hits = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(find, found)
    best = hits.groupBy("_name").agg(F.min_by(F.struct("entry", "cost"), F.struct(F.round("cost", 3), -F.col("often"), "entry")).alias("r")).select("_name", "r.*")
    return once.join(best, "_name", "left").select(F.col("_id").alias(id_col), F.coalesce("entry", F.lit(UNMATCHED)).alias("entry"), "cost")


def _phrases(named: DataFrame) -> DataFrame:
    """(entry, name, aliases) to (entry, phrase), a row each name and alias that is not blank."""
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("phrase", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entry, name, aliases in zip(*(batch.column(c).to_pylist() for c in ("entry", "name", "aliases")), strict=True):
                out += [(entry, x) for x in dict.fromkeys([name or "", *aliases_of(aliases)]) if x.strip()]
            columns = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=schema.names)

    return named.mapInArrow(run, schema).distinct()


def _with_key(df: DataFrame, column: str) -> DataFrame:
    """Adds ``key``, the words of the cleaned text: texts with one key are the same entry typed exactly."""
    schema = T.StructType([*df.schema.fields, T.StructField("key", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [" ".join(t.word for t in tokens_of(clean(x))) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
