"""Variant spellings of names (problem 3).

Every spelling of a row (its name and its aliases) becomes a form: its words without legal forms, titles and
filler words, and its numbers.  What else there is to know of words is counted in the table itself
(``Vocabulary``): which are common beside many others (lines of business, kinds of office, given names), which
words rows use for one another (short forms), and which follow another as a matter of course (paper mills).

Forms are joined on their rare words.  The grams of a word are what is left of it after as many deletions as
the similarity allows slips (gapped q-grams: with contiguous ones, that many slips leave short words no gram
at all).  Only rare words are filed, which is the prefix filter: the similarity of two forms without a common
rare word can't reach SIMILAR.  Forms that have only common or very short words are filed under one of them
with the initials of all.  Candidates are verified by a soft weighted token similarity, free of order, in which
rare tokens count more and a token may match a mistyped, joined, shortened or initialled one.

A link is weak if one of the two forms says less than the other: an initial, a short form of a rare word, a
missing word.  Weak links join nothing by themselves: when the firm groups are known, a form that says less
goes to the one group it fits, and to none if it fits several.

Forms, not rows, are compared, so copies of a spelling cost nothing.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.edits import edits
from factloom.llm.groups import connected_groups
from factloom.sources.tables import Scratch

#: A word is common if it is in more than this share of the forms and in more than so many, beside as many others.
COMMON_SHARE, COMMON_FORMS = 0.0005, 20
#: Rows that must use one word for another, as the only difference of two spellings, and the least share among all it is used for.
SYNONYM_ROWS, SYNONYM_SHARE, SYNONYM_OF_ALL = 5, 0.5, 0.00005
#: A word follows another as a matter of course from these shares of its own forms and of the other's.
TAIL_OWN, TAIL_OTHER = 0.85, 0.3
#: Least soft weighted token similarity of two forms of one entity.
SIMILAR = 0.75
#: Similarity of a short word with two slips, which counts beside a well matched rare word only.
LOOSE = 0.65
#: Weight of a single letter; a rare word has at least 1.
INITIAL_WEIGHT = 0.25
#: Weight of a word matched by its initial or start.
SHORT_WEIGHT = 1.0

# Legal forms, titles and filler words.
LEGAL = frozenset(
    "ltd limited llp pvt private inc incorporated corp corpn corporation co company coy plc gmbh ag sa sarl bv nv kg spa pte pty lp llc".split()
)
TITLES = frozenset("dr prof professor mr mrs ms miss shri smt sri ca cs er adv sir dame lord lady hon rev messrs".split())
FILLERS = frozenset("the of and for in at by on to an de la".split())
# Phrases that name nobody in particular.
GENERAL = frozenset("company group board bank issuer authority management corporation fund trust entity firm promoter borrower".split())
# Words that point at somebody named elsewhere.
POINTERS = frozenset("our your their its his her this that these those such said any each all some other same".split())
# Short forms of given names.
GIVEN = {
    "alexander": "alex alec sandy sasha", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benjy",
    "catherine": "cathy", "charles": "charlie chuck", "christina": "tina", "christopher": "chris kit topher", "daniel": "dan danny",
    "david": "dave davy", "deborah": "debbie deb debby", "dorothy": "dot dolly", "edward": "ed eddie ned ted", "eleanor": "nell nora ellie",
    "elizabeth": "liz beth betty lizzie eliza lisa betsy", "francis": "frank", "frederick": "fred freddie freddy", "gerald": "gerry",
    "gregory": "greg", "harold": "harry hal", "henry": "hank", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie",
    "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "judith": "judy",
    "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "laura": "laurie", "lawrence": "larry lars laurence", "leonard": "len lenny",
    "margaret": "peggy maggie meg madge", "martha": "marty", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat",
    "nicholas": "nick nicky nico", "oliver": "ollie", "patricia": "trish pat patty tricia", "patrick": "paddy", "peter": "pete",
    "philip": "phil", "rebecca": "becky", "richard": "dick rick richie", "robert": "bob rob bobby robbie", "ronald": "ron ronnie",
    "rose": "rosie", "samuel": "sam sammy", "sarah": "sally", "stephen": "steve", "steven": "stevie", "susan": "sue susie", "theodore": "theo teddy",
    "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vicki tori", "vincent": "vince", "walter": "walt wally",
    "william": "bill will billy willy liam", "zachary": "zach",
}
NICKNAMES = {short: full for full, shorts in GIVEN.items() for short in shorts.split()}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15}


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


def aliases_of(text: str | None) -> list[str]:
    """The aliases in a JSON list, a Python-like list, or a list with semicolons; [] if there are none."""
    s = (text or "").strip()
    if not s:
        return []
    try:
        found = json.loads(s)
    except ValueError:
        if s[0] == "[" and s[-1:] == "]":
            found = [a or b for a, b in re.findall(r"'((?:[^'\\]|\\.|'(?!\s*[,\]]))*)'|\"([^\"]*)\"", s[1:-1])]
        else:
            found = s.split(";")
    if isinstance(found, str):
        found = [found]
    return [x for x in found if isinstance(x, str) and x.strip()] if isinstance(found, list) else []


_VOWEL = re.compile("[aeiou]")


def read_form(spelling: str) -> str | None:
    """The words of a spelling, then its numbers as #n; None if it names nobody.

    A single word without a legal form ends in " ~": it may be anybody's initials.  Pointers (our Company, the
    Bank) and blank spellings name nobody.
    """
    s = fold(spelling)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s).lower().replace("&", " ")
    s = re.sub(r"\bm\s*/\s*s\b\.?", " ", s)
    dotted = lambda m: w if (w := m[1].replace(".", "")) in LEGAL else " ".join(w) + " "
    s = re.sub(r"\b((?:[a-z]\.){2,}[a-z]?)(?=\W|$)", dotted, s)
    words = [t for t, _ in re.findall(r"([a-z0-9]+)('s\b)?", s)]
    words = [t.replace("0", "o").replace("1", "l") if len(t) > 1 and re.search("[a-z]", t) and re.search("[01]", t) else t for t in words]
    content: list[str] = []
    numbers: set[str] = set()
    legal = False
    for n, t in enumerate(words):
        if t in LEGAL or (t == "p" and words[n + 1 : n + 2] and words[n + 1] in ("ltd", "limited")):
            legal = True
        elif t.isdigit():
            numbers.add(f"#{int(t)}")
        elif t in ROMAN and len(words) > 2 and (len(t) > 1 or 3 <= n == len(words) - 1):
            numbers.add(f"#{ROMAN[t]}")
        elif t not in FILLERS and not (t in TITLES and len(words) > 2):
            content.append(t)
    if not content or not POINTERS.isdisjoint(content):
        return None
    if len(content) > 1 and all(len(t) == 1 for t in content):
        content = ["".join(content)]
    if len(content) == 1 and (len(content[0]) == 1 or content[0] in GENERAL or (words[0] == "the" and not legal)):
        return None
    return " ".join([*content, *sorted(numbers)]) + (" ~" if len(content) == 1 and not legal else "")


@lru_cache(maxsize=100_000)
def words_of(form: str) -> tuple[str, ...]:
    return tuple(t for t in form.split(" ") if t[0] not in "#~")


@lru_cache(maxsize=100_000)
def numbers_of(form: str) -> tuple[str, ...]:
    return tuple(t for t in form.split(" ") if t[0] == "#")


@lru_cache(maxsize=100_000)
def letters_of(word: str) -> int:
    """The word's set of letters, as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


def slips(size: int) -> int:
    """Most typing errors of a word, by the length of the shorter spelling."""
    return 0 if size < 4 else 1 if size < 7 else 2 if size < 12 else 3


def same_word(a: str, b: str) -> float:
    """1 for equal words, less for what typing errors make of one, 0 for different words.

    Two substitutions close together are another syllable, not two slips.
    """
    if a == b:
        return 1.0
    size = min(len(a), len(b))
    most, apart = slips(size), abs(len(a) - len(b))
    # a letter more or less changes one of the set of letters, a wrong one two
    if apart > most or (letters_of(a) ^ letters_of(b)).bit_count() > 2 * most - apart:
        return 0.0
    found = edits(a, b, most)
    if found is None:
        return 0.0
    subs = [p for k, p in found if k == "sub"]
    for x, y in zip(subs, subs[1:], strict=False):
        if y - x <= 2:
            return 0.0
    if len(found) >= 2:
        places = [p for _, p in found]
        if {k for k, _ in found} <= {"sub", "ins", "del"} and len(found) == 2 and places[1] - places[0] <= 2 and len(a) == len(b):
            return 0.0
    return 1 - len(found) / (size + 1)


def abbreviates(t: str, u: str) -> bool:
    """Whether t may be short for u: its start, its consonants, or its first letters and some others."""
    if len(t) >= len(u) or t[0] != u[0]:
        return False
    if u.startswith(t) or (len(t) > 3 and t[-1] == "s" and u.startswith(t[:-1])):
        return True
    if len(t) < 2 or len(t) > 0.8 * len(u):
        return False
    rest = iter(u)
    if _VOWEL.search(t[1:]) and not (len(t) >= 4 and t[:2] == u[:2] and len(t) <= 0.75 * len(u)):
        return False
    return all(c in rest for c in t)


class Vocabulary(NamedTuple):
    """What is counted: all of it bounded by the shares above, whatever the table's size."""

    common: dict[str, int]  # in how many forms
    synonyms: dict[str, frozenset[str]]
    tails: dict[str, frozenset[str]]  # the words it follows as a matter of course
    forms: int
    least: float

    @property
    def rare_weight(self) -> float:
        return math.log2(max(2.0, self.forms / self.least))

    def one_way(self, t: str, u: str) -> bool:
        return u in self.synonyms.get(t, ()) or t in self.synonyms.get(u, ())


class Matcher:
    """Soft weighted token similarity of forms."""

    def __init__(self, known: Vocabulary) -> None:
        self.known = known
        top = known.rare_weight
        self.rare = top
        self.weights = {t: min(top, max(1.0, math.log2(max(known.forms, 1) / n))) for t, n in known.common.items()}
        self.shorts: dict[str, list[str]] = {}
        for t, us in known.synonyms.items():
            for u in us:
                if 5 <= len(t) < len(u):
                    self.shorts.setdefault(u, []).append(t)
        #: words that may stand for one of another first letter
        self.special = {*known.synonyms, *(u for us in known.synonyms.values() for u in us), *NICKNAMES, *GIVEN}
        self.pair = lru_cache(maxsize=300_000)(self._pair)

    def weight(self, t: str) -> float:
        return INITIAL_WEIGHT if len(t) == 1 else self.weights.get(t, self.rare)

    def _pair(self, t: str, u: str) -> tuple[float, int]:
        """Similarity of two words, and which of them is the weak one (-1 t, 1 u, 0 neither)."""
        if t == u:
            return 1.0, 0
        size = min(len(t), len(u))
        # every slip changes at most two letters of a word's set of letters
        near_letters = abs(len(t) - len(u)) <= 3 and (letters_of(t) ^ letters_of(u)).bit_count() <= 2 * max(slips(size), 2)
        if t[0] != u[0] and not near_letters and (t not in self.special or u not in self.special):
            return 0.0, 0
        if self.known.one_way(t, u):
            return 0.95, 0
        full_t, full_u = NICKNAMES.get(t, t), NICKNAMES.get(u, u)
        if full_t == full_u:
            return 0.95, 0
        if full_t in GIVEN and full_u in GIVEN:
            return 0.0, 0
        n_t, n_u = self.known.common.get(t, 0), self.known.common.get(u, 0)
        if near_letters and not (n_t and n_u):
            near = same_word(t, u)
            if near:
                return near, 0
            if 5 <= size < 7 and t[0] == u[0] and not (n_t or n_u or t in GIVEN or u in GIVEN) and edits(t, u, 2) is not None:
                return LOOSE, 0
        if t in self.shorts or u in self.shorts:
            if any(same_word(u, s) for s in self.shorts.get(t, ())) or any(same_word(t, s) for s in self.shorts.get(u, ())):
                return 0.9, 0
        if t[0] != u[0] and full_t[0] != full_u[0]:
            return 0.0, 0
        for a, b, n_a, n_b, side in ((t, u, n_t, n_u, -1), (u, t, n_u, n_t, 1)):
            # an initial is that of the full given name; two words about as common as each other are two words
            if abbreviates(a, NICKNAMES.get(b, b) if len(a) == 1 else b) and not (n_a and n_b and not b.startswith(a) and n_a * 1.5 > n_b):
                firm = len(a) >= 4 or (n_b and len(a) > 1) or (len(a) > 1 and not b.startswith(a))
                return (0.9, 0) if firm else (0.8, side)
            if len(a) == 3 and len(b) > 4 and not n_b and a[0] == b[0] and edits(a, b[:3], 1) is not None:
                return 0.6, side
        return 0.0, 0

    def strays(self, p: tuple[str, ...], q: tuple[str, ...], order: int = 1) -> bool:
        """Whether some word of p is certain to be left over: nothing of q may match it, be joined to it or initial it.

        False does not say that none is.  order -1: q's words come first where pairs of words are looked up.
        """
        others = [u for u in q if len(u) == 1 or u not in p]
        shorts = [u for u in q if 2 <= len(u) <= 5]
        for i, w in enumerate(p):
            if len(w) < 6 or w in q or self.known.tails.get(w) or any(w[0] in u for u in shorts):
                continue
            if any((self.pair(w, u) if order > 0 else self.pair(u, w))[0] for u in others):
                continue
            halves = [(w, q[j], q[j + 1]) for j in range(len(q) - 1)]
            halves += [(u, p[j], p[j + 1]) for u in q if len(u) >= 6 for j in (i - 1, i) if 0 <= j < len(p) - 1]
            if not any(len(t) > 1 and len(u) > 1 and abs(len(v) - len(t) - len(u)) <= 3 and (letters_of(v) ^ (letters_of(t) | letters_of(u))).bit_count() <= 6 for v, t, u in halves):
                return True
        return False

    def __call__(self, x: str, y: str) -> tuple[float, int]:
        """The similarity (0 if anything contradicts), and which form says less (-1 x, 1 y, 0 neither).

        Words left over on both sides contradict each other, and so do numbers.
        """
        if x == y:
            return 1.0, 0
        if numbers_of(x) != numbers_of(y):
            return 0.0, 0
        a, b = words_of(x), words_of(y)
        if self.strays(a, b) and self.strays(b, a, -1):
            return 0.0, 0
        left, right = set(range(len(a))), set(range(len(b)))
        matched = total = 0.0
        weak: set[int] = set()
        anchored = False
        for p, q, ps, qs in ((a, b, left, right), (b, a, right, left)):  # a word that is two of the other's
            for i in sorted(ps):
                if len(p[i]) < 6 or p[i] in q:
                    continue
                for j in sorted(qs):
                    if j + 1 in qs and len(q[j]) > 1 and len(q[j + 1]) > 1 and abs(len(p[i]) - len(q[j]) - len(q[j + 1])) <= 3:
                        if same_word(p[i], q[j] + q[j + 1]) or same_word(p[i], q[j + 1] + q[j]):
                            ps.discard(i)
                            qs -= {j, j + 1}
                            w = self.weight(q[j]) + self.weight(q[j + 1])
                            matched, total, anchored = matched + 0.95 * w, total + w, True
                            break
        ranks_a, ranks_b = _initial_ranks(a), _initial_ranks(b)
        scores = []
        for i in sorted(left):  # equal words are for each other
            for j in sorted(right):
                if a[i] == b[j] and (len(a[i]) > 1 or None in (ranks_a[i], ranks_b[j]) or ranks_a[i] == ranks_b[j]):
                    scores.append((-1.0, i, j, 0))
                    break
        paired, other = {i for _, i, _, _ in scores}, {j for _, _, j, _ in scores}
        for i in left - paired:
            for j in right - other:
                s, side = self.pair(a[i], b[j])
                if not s or (len(a[i]) == 1 == len(b[j]) and a[i] == b[j]):
                    continue
                if (side == -1 and len(a[i]) == 1 and ranks_a[i] == 1) or (side == 1 and len(b[j]) == 1 and ranks_b[j] == 1):
                    continue
                scores.append((-s, i, j, side))
        loose = firm = given = 0
        for s, i, j, side in sorted(scores):
            if i not in left or j not in right:
                continue
            left.discard(i)
            right.discard(j)
            w = min(self.weight(a[i]), self.weight(b[j])) if not side else SHORT_WEIGHT
            matched, total = matched - s * w, total + w
            if side:
                weak.add(side)
                continue
            anchored = anchored or len(a[i]) >= 4 or (1 < len(a[i]) == len(b[j]))
            named = a[i] in GIVEN or b[j] in GIVEN
            if -s == LOOSE:
                loose += 1
            elif named:
                given += 1
            elif len(a[i]) >= 4 and not (a[i] in self.known.common or b[j] in self.known.common):
                firm += 1
        for p, q, ps, qs, side in ((a, b, left, right, -1), (b, a, right, left, 1)):  # initials of several words
            for i in sorted(ps):
                if 2 <= len(p[i]) <= 5 and (run := _initials(p[i], q, sorted(qs))):
                    ps.discard(i)
                    qs -= set(run)
                    matched, total = matched + 0.8 * SHORT_WEIGHT, total + SHORT_WEIGHT
                    weak.add(side)
        for p, ps in ((a, left), (b, right)):
            for i in sorted(ps):
                if not self.known.tails.get(p[i], frozenset()).isdisjoint(p[:i]):
                    ps.discard(i)
        if (left and right) or loose > 1 or (loose and not firm):
            return 0.0, 0
        for rest, p, side in ((left, a, 1), (right, b, -1)):
            for i in sorted(rest, key=lambda k: -len(p[k])):
                total += self.weight(p[i])
                if len(p[i]) > 1 or (not weak and firm + given < 2):  # a middle initial is no more than that
                    weak.add(side)
        if len(weak) > 1 or not anchored:
            return 0.0, 0
        return matched / total, weak.pop() if weak else 0


@lru_cache(maxsize=100_000)
def _initial_ranks(words: tuple[str, ...]) -> list[int | None]:
    """For single letters 0 if a name's first initial, 1 if a later one, None if either; None for words."""
    long = [t for t in words if len(t) > 1]
    named = any(NICKNAMES.get(t, t) in GIVEN for t in long)
    out: list[int | None] = []
    seen = 1 if named else 0
    for t in words:
        if len(t) > 1:
            out.append(None)
        else:
            out.append(None if not named and len(long) > 1 and not seen else min(seen, 1))
            seen += 1
    return out


def _initials(t: str, words: tuple[str, ...], places: list[int]) -> list[int]:
    """Neighbouring places of which t is the initials, filler words' initials allowed between; else []."""
    for k in range(len(places)):
        for m in range(len(places), k + 1, -1):
            run = places[k:m]
            if run[-1] - run[0] == len(run) - 1 and re.fullmatch("[ofait]?".join(words[j][0] for j in run), t):
                return run
    return []


def rests(word: str) -> set[str]:
    """Keys of a word: any two words within the slips of the shorter one have one in common.

    Words that differ by k slips have in common what is left of each after at most k deletions.  With both of 12
    letters or more, of three slips at most one touches the first five letters, or at most one the last five.
    """
    out = {word}
    size = len(word)
    if size < 14:  # a shorter word may have 11 letters and two slips
        most = slips(size)
        if most:
            less = [word[:n] + word[n + 1 :] for n in range(size)]
            out.update(less)
            if most > 1:
                out.update(w[:m] + w[m + 1 :] for n, w in enumerate(less) for m in range(n, size - 1))
    if size >= 12:
        for sign, end in (("<", word[:6]), (">", word[:-7:-1])):
            out.add(sign + end[:5])
            out.update(sign + end[:n] + end[n + 1 :] for n in range(6))
            out.update(sign + end[:n] + end[n + 1 : 5] for n in range(5))
    return out


def keys_of(form: str, common: dict[str, int]) -> set[tuple[int, str]]:
    """(side, key) under which a form is filed; sides 0 and 0, 0 and 1, and 2 and 3 meet.

    0: what deletions leave of its rare words, and very short words with the initials of all; 1: what
    deletions leave of two rare words written as one; 2: for forms without a rare word, each word with the
    initials of all; 3: the same of forms with one rare word, which may be a mistyped common one.
    """
    words = words_of(form)
    rare = [t for t in words if t not in common and len(t) > 1]
    out: set[tuple[int, str]] = set()
    letters = "".join(sorted({t[0] for t in words}))
    long = [t for t in rare if len(t) >= 4]
    for t in rare:
        out.update((0, r) for r in rests(t)) if len(t) >= 4 else out.add((0, f"{t} {letters}"))
    for x, y in zip(words, words[1:], strict=False):
        if x in rare and y in rare and len(x) + len(y) >= 6:
            out.update((1, r) for r in rests(x + y))
    if len(long) < 2:
        side = 3 if long else 2
        out.update((side, f"{t} {letters}") for t in words if len(t) > 1 and t not in long)
        if not long:
            out.add((0, "= " + " ".join(sorted(words))))
    return out


def sketch_of(form: str, known: Vocabulary) -> tuple[int, int, int]:
    """Initials of all words, initials that only common words have, and words with numbers, as whole numbers.

    A common word for which rows use words of other initials, or that is left out at will, is not among them;
    a short given name has the initial of the full one too.
    """
    every = fixed = other = 0
    words = words_of(form)
    for t in words:
        bit = 1 << (ord(t[0]) - 97 if t[0].isalpha() else 26 + int(t[0]))
        every |= bit | (1 << ord(NICKNAMES[t][0]) - 97 if t in NICKNAMES else 0)
        loose = t not in known.common or t in known.tails or any(u[0] != t[0] for u in known.synonyms.get(t, ()))
        fixed, other = (fixed, other | bit) if loose else (fixed | bit, other)
    return every, fixed & ~other, len(words)


def _forms(rows: DataFrame) -> DataFrame:
    """(id, form, named, name_form): the forms of names and aliases; name_form is that of the row's name."""
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("form", T.StringType()), T.StructField("name_form", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(maxsize=100_000)(read_form)
        for batch in batches:
            at, forms, names = [], [], []
            for k, (name, aliases) in enumerate(zip(batch.column("canonical_name").to_pylist(), batch.column("aliases_json").to_pylist(), strict=True)):
                own = read(name) if name and name.strip() else None
                for form in dict.fromkeys([own, *(read(s) for s in aliases_of(aliases))]):
                    if form is not None:
                        at.append(k)
                        forms.append(form)
                        names.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(forms, pa.string()), pa.array(names, pa.string())], names=schema.names
            )

    return rows.select("id", "canonical_name", "aliases_json").mapInArrow(run, schema)


def learn(rows: DataFrame, forms: DataFrame) -> Vocabulary:
    """Counts the vocabulary of ``forms`` (form, distinct) and of ``rows`` (form, name_form)."""
    words = lambda c: F.filter(F.split(c, " "), lambda t: ~t.rlike("^[#~]"))
    every = forms.select(words(F.col("form")).alias("words")).select("words", F.explode(F.array_distinct("words")).alias("w"))
    total = forms.count()
    least = max(COMMON_FORMS, COMMON_SHARE * total)
    often = {r["w"]: r["n"] for r in every.groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") > least) & (F.length("w") > 1)).collect()}
    synonyms = _synonyms(rows, total)
    if not often:
        return Vocabulary({}, synonyms, {}, total, least)
    of_these = every.where(F.col("w").isin(list(often)))
    beside = of_these.select("w", F.explode(F.array_except("words", F.array("w"))).alias("o")).groupBy("w").agg(F.countDistinct("o").alias("n"))
    common = {r["w"]: often[r["w"]] for r in beside.where(F.col("n") >= COMMON_FORMS).collect()}
    if not common:
        return Vocabulary({}, synonyms, {}, total, least)
    before = of_these.where(F.col("w").isin(list(common))).select("w", F.explode(F.array_distinct(F.slice("words", F.lit(1), F.array_position("words", F.col("w")).cast("int") - 1))).alias("v"))
    own = forms.sparkSession.createDataFrame(list(common.items()), "w string, own long")  # as bounded as the vocabulary
    follows = before.groupBy("w", "v").agg(F.count("*").alias("n")).join(F.broadcast(own), "w").where(F.col("n") >= TAIL_OWN * F.col("own"))
    tails: dict[str, set[str]] = {}
    for r in follows.collect():  # at most a few for each common word
        if r["v"] in common and r["n"] >= TAIL_OTHER * common[r["v"]]:
            tails.setdefault(r["w"], set()).add(r["v"])
    for t in common:
        for w in list(tails):
            if len(t) > 1 and t not in tails and abbreviates(t, w):
                tails[t] = tails[w]
    return Vocabulary(common, synonyms, {k: frozenset(v) for k, v in tails.items()}, total, least)


def _synonyms(rows: DataFrame, total: int) -> dict[str, frozenset[str]]:
    """Words that rows use for one another, as the one difference of two of their spellings."""
    a, b = F.split("name_form", " "), F.split("form", " ")
    pairs = rows.where("name_form <> form").select(F.array_except(a, b).alias("x"), F.array_except(b, a).alias("y"), F.array_intersect(a, b).alias("both"))
    pairs = pairs.where((F.size("x") == 1) & (F.size("y") == 1) & (F.size("both") > 0)).select(F.col("x")[0].alias("x"), F.col("y")[0].alias("y"))
    pairs = pairs.where(F.col("x").rlike("^[a-z]") & F.col("y").rlike("^[a-z]") & (F.length("x") > 1) & (F.length("y") > 1))
    both = pairs.union(pairs.select("y", "x")).groupBy("x", "y").agg(F.count("*").alias("n"))
    often = both.groupBy("x").agg(F.sum("n").alias("all"), F.max(F.struct("n", "y")).alias("top"))
    found: dict[str, set[str]] = {}
    least = max(SYNONYM_ROWS, SYNONYM_OF_ALL * total)
    for r in often.where((F.col("top.n") >= least) & (F.col("top.n") >= SYNONYM_SHARE * F.col("all"))).collect():
        found.setdefault(r["x"], set()).add(r["top"]["y"])
    return {k: frozenset(v) for k, v in found.items()}


def _candidates(forms: DataFrame, known: Vocabulary) -> DataFrame:
    """(a, b) of forms' hashes, each pair once, that share a key and whose initials don't contradict."""
    schema = T.StructType([T.StructField("form", T.StringType()), T.StructField("side", T.ByteType()), T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("every", "fixed", "size"))])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):  # a word has up to 92 rests
                column = batch.column("form").slice(start, 1000)
                at, sides, keys, sketches = [], [], [], []
                for k, form in enumerate(column.to_pylist()):
                    found = keys_of(form, known.common)
                    at += [k] * len(found)
                    sides += [s for s, _ in found]
                    keys += [r for _, r in found]
                    sketches.append(sketch_of(form, known))
                places = pa.array(at, pa.int64())
                numbers = [pa.array(c, pa.int64()).take(places) for c in zip(*sketches, strict=True)]
                yield pa.RecordBatch.from_arrays([column.take(places), pa.array(sides, pa.int8()), pa.array(keys, pa.string()), *numbers], names=schema.names)

    # a form becomes some sixty rows: spread first what adaptive execution has put together
    tasks = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = forms.repartition(tasks).mapInArrow(file, schema)
    numbers = F.array_join(F.filter(F.split("form", " "), lambda t: t.startswith("#")), " ")
    group = F.when(F.col("side") < 2, 0).otherwise(1)
    filed = filed.select(F.xxhash64(group, "key", numbers).alias("key"), F.xxhash64("form").alias("form"), "side", "every", "fixed", "size")
    filed, _ = Scratch(forms.sparkSession).cut(filed)
    a = filed.where("side in (0, 2)").select("key", *(F.col(c).alias(f"{c}_a") for c in ("form", "side", "every", "fixed", "size")))
    b = filed.select("key", *(F.col(c).alias(f"{c}_b") for c in ("form", "side", "every", "fixed", "size")))
    # one initial may be mistyped, or words missing on one side; common words that differ are two words
    only_a, only_b = F.expr("every_a & ~every_b"), F.expr("every_b & ~every_a")
    one_each = (F.bit_count(only_a) == 1) & (F.bit_count(only_b) == 1) & (F.col("size_a") == F.col("size_b"))
    contradict = (only_a.bitwiseAND(F.col("fixed_a")) != 0) & (only_b.bitwiseAND(F.col("fixed_b")) != 0)
    ordered = F.when(F.col("side_a") == F.col("side_b"), F.col("form_a") < F.col("form_b")).otherwise(F.col("form_a") != F.col("form_b"))
    near = a.join(b, "key").where(ordered & ((only_a == 0) | (only_b == 0) | (one_each & ~contradict)))
    return near.select(F.least("form_a", "form_b").alias("a"), F.greatest("form_a", "form_b").alias("b")).distinct()


def _links(forms: DataFrame, known: Vocabulary) -> DataFrame:
    """(a, b, weak): hashes of forms that name the same; if weak, a says less than b."""
    text = forms.select(F.xxhash64("form").alias("h"), "form")
    side = lambda s: text.select(F.col("h").alias(s), F.col("form").alias(f"form_{s}"))
    near = _candidates(forms, known).join(side("a"), "a").join(side("b"), "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("weak", T.BooleanType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(known)
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for h, k, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "form_a", "form_b")), strict=True):
                score, less = match(x, y)
                if score >= SIMILAR:
                    out.append((k, h, True) if less == 1 else (h, k, less == -1))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=schema.names)

    return near.select("a", "b", "form_a", "form_b").mapInArrow(verify, schema)


def link_names(entities: DataFrame) -> DataFrame:
    """(id, canonical_name, aliases_json) to (entity_id, group_id): a row per id that has a usable spelling.

    Rows of one group name the same company, public body, fund or person.  Null ids are left out; null,
    blank or unusable names and aliases, and spellings that name nobody in particular (our Company, the
    Bank), link nothing.  Exact copies and repeated rows fall into one group, however frequent.  An initialled
    or shortened form belongs to the group it fits; if it fits several it links nothing but its own copies.
    Other columns are ignored.  An empty table gives an empty result.
    """
    scratch = Scratch(entities.sparkSession)
    rows, _ = scratch.cut(_forms(entities.where("id is not null")))
    forms, _ = scratch.cut(rows.select("form").distinct())
    known = learn(rows, forms)
    links, _ = scratch.cut(_links(forms, known))
    hashed = rows.select("id", F.xxhash64("form").alias("f"), F.col("form").endswith("~").alias("alone"))
    less = links.where("weak").select(F.col("a").alias("f")).distinct().withColumn("less", F.lit(True))
    # a row stands by its full forms, else by its lesser ones, else by its single words
    rank = F.when(F.col("alone"), 2).when(F.col("less"), 1).otherwise(0)
    own, _ = scratch.cut(hashed.join(less, "f", "left").select("id", "f", rank.alias("rank")).distinct())
    base = own.groupBy("id").agg(F.min(F.struct("rank", "f")).alias("m")).select("id", F.col("m.rank").alias("best"), F.col("m.f").alias("base"))
    held = own.join(base, "id")
    firm = links.where("not weak").select("a", "b").union(held.where("rank = best and f <> base").select("base", "f"))
    groups = connected_groups(firm).select(F.col("id").alias("f"), "group_id")
    groups, _ = scratch.cut(groups)
    label = lambda c: F.coalesce("group_id", c)
    to_group = lambda df, c, name: df.join(groups.withColumnRenamed("f", c), c, "left").withColumn(name, label(c)).drop("group_id")
    loose = links.where("weak").select("a", "b").union(held.where("rank > best").select(F.col("f").alias("a"), F.col("base").alias("b")))
    arrows = to_group(to_group(loose, "a", "x"), "b", "y").where("x <> y").select("x", "y").distinct()
    arrows, _ = scratch.cut(arrows)
    rows_at = to_group(base, "base", "g").select("id", "g")
    rows_at, _ = scratch.cut(rows_at)
    while True:  # every round joins at least one group to another
        goes = arrows.groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("x", "y")
        goes, _ = scratch.cut(goes)
        if goes.isEmpty():
            break
        merged, _ = scratch.cut(connected_groups(goes, "x", "y"))
        now = lambda df, c: df.join(merged.select(F.col("id").alias(c), "group_id"), c, "left").withColumn(c, label(c)).drop("group_id")
        arrows, _ = scratch.cut(now(now(arrows, "x"), "y").where("x <> y").select("x", "y").distinct())
        rows_at, _ = scratch.cut(now(rows_at, "g").select("id", "g"))
    first = rows_at.groupBy("g").agg(F.min(F.col("id").cast("string")).alias("group_id"))
    return rows_at.join(first, "g").select(F.col("id").cast("string").alias("entity_id"), "group_id")


def variant_pairs(entities: DataFrame) -> DataFrame:
    """Every pair of ids of one group, the smaller id first."""
    groups, _ = Scratch(entities.sparkSession).cut(link_names(entities))
    other = groups.select(F.col("entity_id").alias("entity_b"), "group_id")
    return groups.withColumnRenamed("entity_id", "entity_a").join(other, "group_id").where("entity_a < entity_b").select("entity_a", "entity_b")
