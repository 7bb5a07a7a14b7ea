"""Problem 5: text of scanned pages repaired into continuous paragraphs.

The lines of a page are labelled as header, body or break by a hidden Markov model over
layout features; its probabilities are counted on labelled pages that are set in type
here. Words cut at a line's end are joined through headers and page changes. A misread
word is rare in the corpus and looks, under the usual confusions of recognition, like a
word that is far more frequent; the counts are taken over all documents.
"""

from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

HEADER, BODY, BREAK = "header", "body", "break"
STATES = (HEADER, BODY, BREAK)
#: Labelled pages that the model is fitted on; documented bound.
TRAINING_PAGES = 600

#: Marks that recognition leaves in or puts for letters, and marks of a word cut at a line's end.
NOISE, HYPHENS = "^~°*'|@(", "-¬\xad‐"
#: What recognition takes for one another, written as the class that all of them fall into.
_CLASSES = (("rn", "m"), ("ri", "n"), ("vv", "w"), ("ii", "u"), ("cl", "d"))
_LETTERS = str.maketrans({"1": "i", "l": "i", "|": "i", "0": "o", "5": "s", "6": "b", "h": "b", "9": "g", "e": "c", "(": "c", "f": "t", "y": "v", "@": "a", "ü": "u"})
_SEEN = tuple((seen.translate(_LETTERS), meant) for seen, meant in _CLASSES)
_EDGE = ".,;:!?()[]{}\"“”„‘…—–"
_CUT = re.compile(rf"\w['’]?[{HYPHENS}]\s*$")
_PLAIN_NUMBER = r"[\dlIOo| ]{1,7}"
_NUMBERS = (
    ("framed", re.compile(rf"[-–—]\s*{_PLAIN_NUMBER}\s*[-–—]|\[{_PLAIN_NUMBER}\]|(?i:p.{{0,2}}ge?)\s*{_PLAIN_NUMBER}|{_PLAIN_NUMBER}/{_PLAIN_NUMBER}|(?i:s.?ite)\s*{_PLAIN_NUMBER}")),
    ("bare", re.compile(rf"(?=.*[\dlI]){_PLAIN_NUMBER}")),
    ("roman", re.compile(r"[ivxlcdmIVXLCDM]{1,9}")),
    ("counted", re.compile(r"(?i)(?=.{4,60}$).*\b(?:vol|volume|ch.?p.?.?.?r|part|issue|no)\b\.?\s*[\dlIO]+(?:\s{2,}\S.*)?")),
    ("beside", re.compile(rf"(?:[-–—\[]?\s*{_PLAIN_NUMBER}[-–—\]]?\s{{2,}}|(?i:page)\s+\d+\s{{2,}})\S.*|.*\S\s{{2,}}(?:[-–—\[]?\s*{_PLAIN_NUMBER}[-–—\]]?|(?i:p.{{0,2}}ge)\s*{_PLAIN_NUMBER}|{_PLAIN_NUMBER}/{_PLAIN_NUMBER})")),
)


def looks(word: str) -> str:
    """The class of a word under the confusions of recognition: equal for words taken for one another."""
    word = word.lower().translate(_LETTERS)
    for seen, meant in _SEEN:
        if seen in word:
            word = word.replace(seen, meant)
    return word


_LETTERS_ONLY, _HAS_DIGIT = re.compile(r"[^\W\d]+"), re.compile(r"\d")


def _key(line: str) -> str:
    return looks(re.sub(r"[^\w|(@]", "", re.sub(r"\d", "", line)))


def features(lines: list[str], title: str | None) -> list[tuple | None]:
    """Layout features of each line; None for a blank one."""
    stripped = [x.strip() for x in lines]
    full = [i for i, x in enumerate(stripped) if x]
    if not full:
        return [None] * len(lines)
    lengths = sorted(len(stripped[i]) for i in full)
    width = max(20, lengths[int(0.9 * (len(lengths) - 1))])
    keys = {i: _key(stripped[i]) for i in full}
    times = Counter(keys.values())
    names = {looks(w) for w in re.findall(r"\w+", title or "")}
    kinds, suspects = {}, set()
    for i in full:
        s = stripped[i]
        kinds[i] = next((name for name, p in _NUMBERS if p.fullmatch(s)), "none")
        repeated = len(keys[i]) > 2 and times[keys[i]] > 1
        letters = [c for c in s if c.isalpha()]
        caps = len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.85 * len(letters)
        if kinds[i] != "none" or repeated or caps:
            suspects.add(i)
    out: list[tuple | None] = [None] * len(lines)
    steady = [i for i in full if i not in suspects]
    before: dict[int, int] = {}
    after: dict[int, int] = {}
    last = -1
    at = set(steady)
    for i in full:
        before[i] = last
        last = i if i in at else last
    nxt = -1
    for i in reversed(full):
        after[i] = nxt
        nxt = i if i in at else nxt
    for n, i in enumerate(full):
        s = stripped[i]
        letters = [c for c in s if c.isalpha()]
        upper = sum(c.isupper() for c in letters)
        case = "none" if not letters else "caps" if upper >= 0.85 * len(letters) and len(letters) > 2 else "upper" if letters[0].isupper() else "lower"
        words = set(_LETTERS_ONLY.findall(s)) if names and s.count(" ") < 4 * len(names) else ()
        words = {looks(w) for w in words}
        titled = len(names & words) >= max(2, 0.6 * len(words))
        p, q = before[i], after[i]
        open_before = p >= 0 and not re.search(r"[.!?:;”\"]\s*$", stripped[p])
        goes_on = q >= 0 and stripped[q][:1].islower()
        broken = "yes" if open_before and goes_on else "no" if p >= 0 and q >= 0 and not open_before and not goes_on else "edge"
        fits = kinds[i] == "none" and open_before and stripped[i][:1].islower()
        numbers = len(re.findall(r"\b\d+\b", s))
        item = "rule" if not letters and not numbers else "bullet" if re.match(r"[-*•] \S|\d+[.)] \S", s) and kinds[i] == "none" else "row" if numbers > 1 and s[-1] not in ".;" else "plain"
        ratio = len(s) / width
        stop = s[-1] in ".!?:;,"
        place = "inner"
        if n == len(full) - 1:
            place = "last-apart" if not stop and p >= 0 and not open_before else "last"
        elif n < 2:
            place = ("first" if n == 0 else "second") + ("" if stop else "-open" if q < 0 or goes_on else "-apart")
        out[i] = (
            kinds[i],
            case,
            min(4, int(ratio * 4)),
            "stop" if s[-1] in ".!?" else "cut" if s[-1] in HYPHENS else "comma" if s[-1] in ",;:" else "open",
            min(3, times[keys[i]]) if len(keys[i]) > 2 else 0,
            titled,
            broken,
            fits,
            place,
            item,
        )
    return out


def _phrase(rng: random.Random, pool: list[str], n: int) -> list[str]:
    return [rng.choice(pool) for _ in range(n)]


def _sentence(rng: random.Random, pool: list[str]) -> str:
    words = _phrase(rng, pool, rng.randint(6, 16))
    for k in range(len(words)):
        if rng.random() < 0.04:
            words[k] = rng.choice((str(rng.randint(2, 2030)), f"{rng.choice('ABKQV')}{rng.randint(1, 99)}", words[k].capitalize(), words[k] + ","))
    return words[0].capitalize() + " " + " ".join(words[1:])


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 3) -> list[tuple[list[str], list[str], str]]:
    """(lines, labels, title) of documents set in type: paragraphs, headings, lists and tables under running heads."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b br c d f g k l m n p r s st t tr v".split() for b in "a e i o u an er in ol ur".split()]
    pool = ["".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(900)] + "the a of in and to is was by with for on every one".split() * 9
    out = []
    for _ in range(n):
        title = " ".join(_phrase(rng, pool, rng.randint(2, 4))).capitalize()
        place, width = rng.choice(pool[:900]).capitalize(), rng.randint(44, 84)
        running = rng.choice((title, title.upper(), place.upper(), f"{place} Reports, Vol. {rng.randint(1, 60)}", f"Chapter {rng.randint(1, 30)}", f"{title} — {rng.choice(pool)}", f"Internal {rng.choice(pool)}".upper(), f"{place} {rng.choice(pool)}", None))
        number = rng.choice(("- {} -", "{}", "{} / {m}", "Page {}", "[{}]", "roman", "spaced", None, "— {} —"))
        at_top, on_one_line = rng.random() < 0.4, rng.random() < 0.2
        blank_between, indent, page = rng.random() < 0.6, rng.random() < 0.3, rng.randint(1, 60)
        body: list[tuple[str, str]] = []
        spaced = rng.random() < 0.5
        for _ in range(rng.randint(3, 14)):
            r = rng.random()
            if r < 0.05:
                body.append((" ".join(_phrase(rng, pool, rng.randint(2, 5))).capitalize(), BODY))
            elif r < 0.13:
                mark = rng.choice(("- ", "• ", "* ", "{}. "))
                for k in range(rng.randint(2, 6)):
                    end = rng.choice(("", "", f": {rng.randint(2, 900)} {rng.choice(pool)}", f" {rng.randint(2, 90)}"))
                    body += [(mark.format(k + 1) + " ".join(_phrase(rng, pool, rng.randint(2, 6))).capitalize() + end, BODY), *[("", BREAK)] * spaced]
            elif r < 0.2:
                gap = rng.choice((" ", "  ", " | "))
                body.append((gap.join(_phrase(rng, pool, 4)).title(), BODY))
                body.append((rng.choice(("---:---:---:---:", "------------", ":---:---:---", "--- --- ---")), BODY))
                body += [(gap.join([" ".join(_phrase(rng, pool, 2)).capitalize(), *(str(rng.randint(10, 9999)) if rng.random() < 0.7 else rng.choice(pool) for _ in range(3))]), BODY) for _ in range(rng.randint(3, 9))]
            else:
                text = " ".join(_sentence(rng, pool) + rng.choice((".", ".", ".", ";")) for _ in range(rng.randint(2, 7)))
                lines = textwrap.wrap(("   " if indent else "") + text, width, break_on_hyphens=False, drop_whitespace=True)
                for j, line in enumerate(lines[:-1]):
                    head, _, rest = lines[j + 1].partition(" ")
                    if len(head) > 5 and rng.random() < 0.25:
                        k = rng.randint(2, len(head) - 3)
                        line, lines[j + 1] = f"{line} {head[:k]}-", f"{head[k:]} {rest}"
                        lines[j] = line
                body += [(x, BODY) for x in lines]
            if blank_between:
                body.append(("", BREAK))
        per_page, rows, i = rng.randint(18, 60), [], 0
        total = max(1, len(body) // per_page)

        def furniture(page: int) -> list[tuple[str, str]]:
            num = None
            if number:
                num = "".join(rng.choice("ivxxx") for _ in range(rng.randint(1, 6))) if number == "roman" else " ".join(str(page)) if number == "spaced" else number.format(page, m=page + total)
            if running and num and on_one_line:
                return [((f"{running}    {num}" if page % 2 else f"{num}    {running}"), HEADER)]
            return [(x, HEADER) for x in (num, running) if x] if at_top is False else [(x, HEADER) for x in (running, num) if x]

        if running or number:
            if rng.random() < 0.5:
                rows += furniture(page)
        while i < len(body):
            rows += body[i : i + per_page]
            i += per_page
            page += 1
            if i < len(body) or rng.random() < 0.7:
                gap = [("", BREAK)] if rng.random() < 0.3 else []
                rows += gap + furniture(page) + ([("", BREAK)] if rng.random() < 0.2 else [])
        noisy = []
        for text, label in rows:
            if text and rng.random() < 0.05:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice("^~°*'") + text[k + rng.randint(0, 1) :]
            noisy.append((text + (" " if rng.random() < 0.05 else ""), label))
        out.append(([x for x, _ in noisy], [y for _, y in noisy], title))
    return out


class LineModel:
    """A hidden Markov model of lines; each feature is emitted independently given the state."""

    def __init__(self, pages: list[tuple[list[str], list[str], str]]) -> None:
        start, step = Counter(), Counter()
        emit: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for lines, labels, title in pages:
            start[labels[0]] += 1
            step.update(zip(labels, labels[1:]))
            for f, y in zip(features(lines, title), labels):
                for j, value in enumerate(f or ()):
                    emit[y, j][value] += 1
        self.start = {s: math.log((start[s] + 1) / (sum(start.values()) + 3)) for s in STATES}
        self.step = {(a, b): math.log((step[a, b] + 1) / (sum(step[a, c] for c in STATES) + 3)) for a in STATES for b in STATES}
        self.emit = {k: ({v: math.log((n + 0.5) / (sum(c.values()) + 4)) for v, n in c.items()}, math.log(0.5 / (sum(c.values()) + 4))) for k, c in emit.items()}

        n = 1 + max(j for _, j in self.emit)
        self.tables = {s: [self.emit[s, j] for j in range(n)] for s in (HEADER, BODY)}

    def _score(self, f: tuple, state: str) -> float:
        total = 0.0
        for (known, unseen), value in zip(self.tables[state], f):
            total += known.get(value, unseen)
        return total

    def label(self, lines: list[str], title: str | None) -> list[str]:
        """The most probable labels (Viterbi); blank lines are breaks."""
        fs = features(lines, title)
        best, back = [], []
        for i, f in enumerate(fs):
            allowed = (BREAK,) if f is None else (HEADER, BODY)
            now, came = {}, {}
            for s in allowed:
                if i:
                    p = max(best[-1], key=lambda a: best[-1][a] + self.step[a, s])
                    now[s], came[s] = best[-1][p] + self.step[p, s], p
                else:
                    now[s] = self.start[s]
                now[s] += 0 if f is None else self._score(f, s)
            best.append(now)
            back.append(came)
        if not best:
            return []
        s = max(best[-1], key=best[-1].get)
        out = [s]
        for came in reversed(back[1:]):
            s = came[s]
            out.append(s)
        return out[::-1]


@lru_cache(maxsize=1)
def model() -> LineModel:
    """The model, fitted once on the driver and sent along with the tasks; it holds counts only."""
    return LineModel(labelled_pages())


def scanned(df: DataFrame) -> Column:
    """Documents that come from scanned pages carry their number of pages."""
    return F.map_contains_key("metadata", F.lit("page_count")) & (F.length("raw_text") > 0)


def words_of(lines_of: LineModel, text: str, title: str | None) -> Iterator[tuple[int, str, str, int, int, str]]:
    """(line_no, kind, word, cut, next line, compound) of a scanned text.

    ``kind`` is "furniture" (no word), "word", "number" for letters beside a number that
    look like one themselves, or "cut" for a word that a mark divides at the line's end: ``word`` is then the joined word, ``cut`` the length of its first
    part, and ``compound`` the word with the hyphen as its own.
    """
    lines = text.split("\n")
    labels = lines_of.label(lines, title)
    running = [i for i, y in enumerate(labels) if y == BODY]
    for i, y in enumerate(labels):
        if y == HEADER:
            yield i + 1, "furniture", "", 0, 0, ""
    tokens = {i: lines[i].split() for i in running}
    taken = set()
    for n, i in enumerate(running):
        ts = tokens[i]
        for k, t in enumerate(ts):
            if (i, k) in taken:
                continue
            if k == len(ts) - 1 and n + 1 < len(running) and _CUT.search(t):
                j = running[n + 1]
                if tokens[j] and (tokens[j][0][0].isalnum() or tokens[j][0][0] in NOISE):
                    head, tail = t.lstrip(_EDGE)[:-1], tokens[j][0].rstrip(_EDGE)
                    mark = t[-1]
                    taken.add((j, 0))
                    yield i + 1, "cut" if mark in "-‐" else "soft", head + tail, len(head), j + 1, f"{head}-{tail}"
                    continue
            w = t.strip(_EDGE)
            if len(w) > 1 and w[0] == w[-1] == "'":
                w = w[1:-1]
            if len(w) > 1:
                number = _ALL_LETTERS.fullmatch(w) and any(_HAS_DIGIT.search(x) for x in ts[max(0, k - 1) : k] + ts[k + 1 : k + 2])
                yield i + 1, "number" if number else "word", w, 0, 0, ""


_WORDS_DDL = "id string, line_no int, kind string, word string, cut int, next_line int, compound string"


def scan_words(df: DataFrame) -> DataFrame:
    """(id, line_no, kind, word, cut, next_line, compound) of all scanned documents in ``df`` (id, title, raw_text)."""

    lines_of = model()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *w) for i, title, text in zip(pdf["id"], pdf["title"], pdf["raw_text"]) for w in words_of(lines_of, text, title)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "kind", "word", "cut", "next_line", "compound"])

    return df.select("id", "title", "raw_text").mapInPandas(read, _WORDS_DDL)


def vocabulary(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """(lower, n): in how many different texts each lower-case word occurs, over all of ``df``.

    Copies under other ids and rows delivered twice count once; texts that have the same
    words in the same order, but for blanks and punctuation, are the same.
    """
    edge = F.lit(_EDGE)
    ws = F.array_distinct(F.transform(F.split(F.lower(F.regexp_replace(text, "[\xad]", "")), r"\s+"), lambda w: F.btrim(w, edge)))
    texts = df.select(ws.alias("ws")).groupBy(F.xxhash64("ws").alias("same")).agg(F.first("ws").alias("ws"))
    return texts.select(F.explode("ws").alias("lower")).where(F.length("lower") > 1).groupBy("lower").agg(F.count(F.lit(1)).alias("n"))


_NUMERIC = re.compile(r"(?=.*\d)(?=.*[lIOo|])[\dlIOo|]+|[A-Z]{1,2}(?=\w*\d)(?=\w*[lIOo|])[\dlIOo|]+")
#: A number of which no digit was recognised; a Roman one is what it looks like.
_ALL_LETTERS = re.compile(r"(?!I+$)[lIO]{2,4}")
#: Numbers and designations mean what they say.
_CODE = re.compile(r"[A-Z]{0,3}\d+(?:[./–-]\d+)*")
_DIGITS = str.maketrans("lI|Oo", "11100")
#: A correction is in so many texts, and so many times as frequent as the misread word.
MIN_TEXTS, MIN_RATIO = 5, 12


#: Noise marks of a word up to which every letter is tried for each; beyond them the vocabulary is searched instead.
TRIED_MARKS = 3


def _guesses(word: str) -> set[str]:
    """Classes that the word may stand for: each noise mark is left out or put for any letter."""
    out = {""}
    for c in word:
        more = {""} | set("abcdefghijklmnopqrstuvwxyz") if c in NOISE else {c}
        out = {a + b for a in out for b in more}
    return {looks(w) for w in out} | {looks(word)}


#: How the letters of a class may be written, and the letters that no confusion of several characters has a part in.
_SPELLED = {meant: (meant, *(s for s, m in _SEEN if m == meant)) for _, meant in _SEEN}
_APART = frozenset("abcdefghijklmnopqrstuvwxyz".translate(_LETTERS)) - set("".join(s + m for s, m in _SEEN))
_RUN_APART = re.compile(f"[{''.join(sorted(_APART))}]+")


def could_be(word: str, shown: str) -> bool:
    """Whether ``word``, each mark left out or put for any one letter, may be a word of the class ``shown``."""
    pattern = [None if c in NOISE else c.translate(_LETTERS) for c in word.lower()]

    def skipped(at: set[int]) -> set[int]:
        out = set(at)
        for i in at:
            while i < len(pattern) and pattern[i] is None:
                i += 1
                out.add(i)
        return out

    at = skipped({0})
    for letter in shown:
        after: set[int] = set()
        for spelled in _SPELLED.get(letter, (letter,)):
            now = at
            for c in spelled:
                now = skipped({i + 1 for i in now if i < len(pattern) and pattern[i] in (None, c)})
            after |= now
        at = after
    return len(pattern) in at


def grams(shown: str) -> set[str]:
    """Runs of up to three letters of a class that stand apart from confusions of several characters."""
    return {run[i : i + n] for run in _RUN_APART.findall(shown) for n in (1, 2, 3) for i in range(len(run) - n + 1)}


def longest_gram(word: str) -> str:
    """The longest such run between the marks of a word, up to three letters; empty if it has none."""
    runs = _RUN_APART.findall("".join(" " if c in NOISE else c.translate(_LETTERS) for c in word.lower()))
    return max((r[:3] for r in runs), key=len, default="")


def corrections(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, fix): the misread among ``words`` (word) and what they are.

    Words are brought to the class that they fall into under the confusions; the fix is the
    most frequent word of a class they may stand for, if it is far more frequent. A word of
    more than ``TRIED_MARKS`` noise marks is compared with all words that share its longest
    run of letters; one that has no letter but those that several characters are taken for
    says nothing and is left.
    """
    marks = F.length("word") - F.length(F.translate("word", NOISE, ""))
    counted = words.withColumn("lower", F.lower("word")).join(vocab, "lower", "left").fillna(0, ["n"]).withColumn("marks", marks)

    def guessed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, n in zip(pdf["word"], pdf["n"]):
                if _NUMERIC.fullmatch(w):
                    head = re.match(r"[A-Z]{0,2}(?=.)", w).group()
                    head = head if not set(head) & set("IO") else ""
                    rows.append((w, n, "", head + w[len(head) :].translate(_DIGITS)))
                elif not _CODE.fullmatch(w):
                    rows += [(w, n, g, None) for g in _guesses(w.lower())]
            yield pd.DataFrame(rows, columns=["word", "n", "looks", "numeric"])

    def classed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["looks"] = [looks(w) for w in pdf["lower"]]
            yield pdf[["lower", "n", "looks"]]

    @F.pandas_udf("string")
    def gram_of(ws: pd.Series) -> pd.Series:
        return ws.map(longest_gram)

    @F.pandas_udf("array<string>")
    def grams_of(shown: pd.Series) -> pd.Series:
        return shown.map(lambda x: sorted(grams(x)))

    @F.pandas_udf("boolean")
    def fits(ws: pd.Series, shown: pd.Series) -> pd.Series:
        return pd.Series([could_be(w, x) for w, x in zip(ws, shown)], dtype=bool)

    plain = F.regexp_replace("lower", r"[\p{L}’-]", "") == ""
    sure = vocab.where((F.col("n") >= MIN_TEXTS) & plain).mapInPandas(classed, "lower string, n long, looks string")
    meanings = sure.select("looks", F.col("lower").alias("fix"), F.col("n").alias("m"))
    guesses = counted.where(F.col("marks") <= TRIED_MARKS).select("word", "n").mapInPandas(guessed, "word string, n long, looks string, numeric string")
    noisy = counted.where(F.col("marks") > TRIED_MARKS).select("word", "n", gram_of("word").alias("gram")).where("gram <> ''")
    searched = noisy.join(meanings.withColumn("gram", F.explode(grams_of("looks"))), "gram").where(fits("word", "looks")).select("word", "n", "fix", "m")
    meant = (
        guesses.where("numeric is null")
        .join(meanings, "looks")
        .select("word", "n", "fix", "m")
        .unionByName(searched)
        .where((F.col("fix") != F.lower("word")) & (F.col("m") >= MIN_RATIO * F.greatest("n", F.lit(1))))
        .groupBy("word")
        .agg(F.max_by("fix", F.struct("m", "fix")).alias("fix"))
    )
    return meant.unionByName(guesses.where("numeric is not null").select("word", F.col("numeric").alias("fix")).distinct())


def _first_difference(word: str, fix: str) -> int:
    a, b = word.lower(), fix.lower()
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def found_words(df: DataFrame) -> DataFrame:
    """(id, line_no, kind, word, cut, next_line, compound, fix, joined) of the scanned documents of ``df``.

    ``joined`` holds for cut words that are one word: a soft mark always, a hyphen unless
    it is one that merely ends the line before "and" or "or" (the joined word is then no
    word of the corpus).
    """
    docs = df.where(scanned(df)).select("id", "title", "raw_text").dropDuplicates(["id"])
    seen = cut_lineage(scan_words(docs))
    vocab = cut_lineage(vocabulary(df))
    asked = seen.where("kind NOT IN ('furniture', 'number')").select("word").distinct()
    fixes = cut_lineage(corrections(asked, vocab))
    known = vocab.where(F.col("n") >= MIN_TEXTS).select("lower", F.lit(True).alias("known"))
    hanging = F.lower(F.regexp_extract("compound", "-([^-]*)$", 1)).isin("and", "or", "to", "nor", "und", "oder", "et", "ou", "y", "o", "e")
    cut_words = seen.where("kind IN ('cut', 'soft')").withColumn("lower", F.lower("word")).join(known, "lower", "left").join(fixes, "word", "left")
    cut_words = cut_words.withColumn("joined", (F.col("kind") == "soft") | ~hanging | F.coalesce("known", F.lit(False)))
    # What a hanging hyphen leaves apart is two words, and a compound's parts need no fix as one.
    cut_words = cut_words.drop("lower", "known")
    rest = seen.where("kind IN ('furniture', 'word')").join(fixes, "word", "left").withColumn("joined", F.lit(False))
    numbers = seen.where("kind = 'number'").withColumn("fix", F.translate("word", "lIO", "110")).withColumn("joined", F.lit(False))
    return cut_words.unionByName(rest).unionByName(numbers)


def find_repairs(df: DataFrame) -> DataFrame:
    """(id, line_no, kind) of the lines that need repair: furniture, broken_word or misread.

    Null, empty and blank texts give no rows, nor do documents that aren't scans, though
    their words are counted. Rows of the same id are taken for one delivered twice; other
    columns are left out.
    """
    w = found_words(df)

    @F.pandas_udf("int")
    def spot(words: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([-1 if f is None else _first_difference(a, f) for a, f in zip(words, fixes)], dtype="int32")

    furniture = w.where("kind = 'furniture'").select("id", "line_no", F.lit("furniture").alias("kind"))
    broken = w.where("joined").select("id", "line_no", F.lit("broken_word").alias("kind"))
    misread = w.where("fix IS NOT NULL AND (kind IN ('word', 'number') OR joined)").withColumn("spot", spot("word", "fix"))
    line = F.when(F.col("kind").isin("word", "number") | (F.col("spot") < F.col("cut")), F.col("line_no")).otherwise(F.col("next_line"))
    return furniture.unionByName(broken).unionByName(misread.select("id", line.alias("line_no"), F.lit("misread").alias("kind"))).distinct()


def repaired(df: DataFrame) -> DataFrame:
    """(id, repaired): the scanned texts as paragraphs, without headers, with whole and corrected words."""
    w = found_words(df)
    notes = w.where("joined OR fix IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("line_no", "word", "cut", "joined", "compound", "fix")).alias("notes"))
    docs = df.where(scanned(df)).select("id", "title", "raw_text").dropDuplicates(["id"])

    lines_of = model()

    @F.pandas_udf("string")
    def mend(texts: pd.Series, titles: pd.Series, notes: pd.Series) -> pd.Series:
        return pd.Series([_mend(lines_of, t, title, n) for t, title, n in zip(texts, titles, notes)])

    return docs.join(notes, "id", "left").select("id", mend("raw_text", "title", "notes").alias("repaired"))


def _cased(fix: str, word: str) -> str:
    return fix.upper() if word.isupper() and len(word) > 2 else fix[:1].upper() + fix[1:] if word[:1].isupper() else fix


def _mend(lines_of: LineModel, text: str, title: str | None, notes: list | None) -> str:
    lines = text.split("\n")
    labels = lines_of.label(lines, title)
    fixes: dict[int, dict[str, str]] = defaultdict(dict)
    joins: dict[int, tuple[str, str]] = {}
    for x in notes if notes is not None else ():
        if x["joined"]:
            joins[x["line_no"]] = (x["word"], _cased(x["fix"], x["word"]) if x["fix"] else x["word"])
        elif x["fix"]:
            fixes[x["line_no"]][x["word"]] = _cased(x["fix"], x["word"])
    paragraphs: list[str] = []
    open_, pending = False, None
    for i, (line, label) in enumerate(zip(lines, labels)):
        s = line.strip()
        if label == HEADER:
            continue
        if label == BREAK:
            if paragraphs and re.search(r"[.!?:”\"]$", paragraphs[-1]):
                open_ = False
            continue
        for bad, good in fixes[i + 1].items():
            s = re.sub(rf"(?<!\w){re.escape(bad)}(?!\w)", lambda m: good, s)
        if pending is not None:
            joined, good = pending
            first, _, rest = s.partition(" ")
            s = good + first[len(first.rstrip(_EDGE)) :] + (f" {rest}" if rest else "")
            pending = None
        if i + 1 in joins:
            pending = joins[i + 1]
            s = s.rpartition(" ")[0]
        indented = line[:1] in " \t" and len(line) - len(line.lstrip()) > 1
        if open_ and not indented:
            paragraphs[-1] = f"{paragraphs[-1]} {s}".strip()
        else:
            paragraphs.append(s)
        open_ = True
    return "\n\n".join(paragraphs)
