"""Problem 8: text decoded with the wrong encoding, found and restored.

Garbled records are joined with clean near-twins on their text without its non-ASCII
characters. Twins are words: "GrÃ¶ÃŸe" and "Größe" share the skeleton "Gre". Where both
occur, the runs between the shared characters are aligned character by character, which
maps "Ã¶" to "ö" and "ÃŸ" to "ß". From these mappings the transformation is inferred: the
encoding that was read and the one that was written. Only transformations that twins
support are learned, and they alone decide about the remaining records: words without a
clean twin, and scripts that have no ASCII skeleton at all.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Encodings by which text is commonly read by mistake, and those it is commonly written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac-roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp1257")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "mac-roman", "cp850", "iso8859-2", "cp866")
#: Different words that must support a pair of single-byte encodings before it is applied, and one of
#: UTF-8, whose sequences of several characters don't meet a clean character by chance.
MIN_SUPPORT, MIN_SUPPORT_UTF8 = 3, 1
#: A clean word is seen in at least so many different texts, or records where texts don't decide.
MIN_CLEAN = 2

REPLACED, MARK = "�", "¤"
#: Words that may be garbled: not ASCII only, or with a character entity. A word of one or
#: two characters says little alone and is taken together with the next one.
SUSPECT = r"(?<!\S)(?:[^\x00-\x7F]{1,2} \S+|\S*(?:[^\x00-\x7F]|&[A-Za-z]{2,8};)\S*)"
#: Garbled characters in quotation marks of their own: a text only speaks of them.
_QUOTED = "[‘“„«'\"](?:[^\\x00-\\x7F]|&[A-Za-z]{2,8};){1,6}[’”»'\"]"
_EDGE = ".,;:!?()[]{}<>\"'*_`|=+#/\\"


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[str, ...]:
    """The character of each byte; bytes without one are read as control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(codec))))} | ({chr(b): b for b in range(0x80, 0xA0)} if codec == "cp1252" else {})


@lru_cache(maxsize=None)
def _multibyte(codec: str) -> re.Pattern[str]:
    """UTF-8 sequences of two to four bytes as they look when read as ``codec``."""
    t = _table(codec)

    def chars(lo: int, hi: int) -> str:
        got = {t[b] for b in range(lo, hi + 1)} | ({chr(b) for b in range(max(lo, 0x80), min(hi, 0x9F) + 1)} if codec == "cp1252" else set())
        return "[" + re.escape("".join(sorted(got))) + "]"

    tail = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}}")


def _as_bytes(text: str, codec: str) -> bytes | None:
    of = _bytes_of(codec)
    try:
        return bytes(of[c] for c in text)
    except KeyError:
        return None


def reread(word: str, read_as: str, written_in: str) -> str | None:
    """``word`` as it would have been had it not been read as ``read_as``; None if it can't be.

    For UTF-8 each complete multi-byte sequence is replaced and only quotation marks and
    dashes may stay; for a single-byte encoding all non-ASCII characters must convert.
    """
    if written_in == "utf-8":

        def one(m: re.Match[str]) -> str:
            try:
                return _as_bytes(m.group(), read_as).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        out = _multibyte(read_as).sub(one, word)
        whole = out.startswith("\ufeff") or not _ODD.search(_multibyte(read_as).sub("", word))
        return out if out != word and whole else None
    raw = _as_bytes("".join(c for c in word if c > "\x7f"), read_as)
    if raw is None:
        return None
    table = iter(_table(written_in)[b] for b in raw)
    out = "".join(next(table) if c > "\x7f" else c for c in word)
    return out if out != word and out.isprintable() else None


#: What may stand beside UTF-8 sequences without being a part of one.
_ODD = re.compile("[^\x00-\x7f‘’“”„«»–—…•\xa0ÃÂ]")
#: Characters of ordinary text; control and private characters are none.
_READABLE = re.compile(r"[\x00-\x7F\xa0-ɏͰ-ԯḀ-῿‐-⁄₠-₿℀-⋿⌀-◿☀-➿　-ヿ㐀-鿿가-힯豈-﫿ﬀ-ﬆ﻿＀-￯\U0001f300-\U0001faff]+")

PAIRS = tuple((r, w) for w in WRITTEN_IN for r in READ_AS if r != w)


def fully(word: str, read_as: str, depth: int = 3) -> str | None:
    """UTF-8 restored again and again, for text that was garbled more than once."""
    out = None
    for _ in range(depth):
        got = reread(word, read_as, "utf-8")
        if got is None:
            break
        word = out = got
    return out


def _candidates(word: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> list[tuple[str, str, str]]:
    """(read as, written in, restored) for each of ``pairs`` that can explain the word."""
    plain = html.unescape(word) if "&" in word else word
    out = []
    for read_as, written_in in pairs:
        got = fully(plain, read_as) if written_in == "utf-8" else reread(plain, read_as, written_in)
        if got is not None and got != word and _READABLE.fullmatch(got):
            out.append((read_as, written_in, got))
    return out


def shape(c: Column) -> Column:
    """The text stripped of its non-ASCII runs and entities, with a mark where each one stood."""
    return F.regexp_replace(c, r"(?:[^\x00-\x7F]|&[A-Za-z]{2,8};)+", MARK)


def _bare(c: Column) -> Column:
    """Whether a word has no ASCII letter or digit, so that its shape tells nothing."""
    return ~F.regexp_replace(c, "&[A-Za-z]{2,8};", "").rlike("[A-Za-z0-9]")


def suspect_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, same, word): each record's distinct words that could be garbled, quoted ones left out; ``same`` is equal for equal texts."""
    t = F.col(text)
    some = df.where(t.rlike(r"[^\x00-\x7F]|&[A-Za-z]{2,8};")).select(F.col(key).alias("key"), F.xxhash64(t).alias("same"), F.regexp_replace(t, _QUOTED, " ").alias("__t"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("__t", F.lit(SUSPECT), F.lit(0)), lambda w: F.btrim(w, F.lit(_EDGE))))
    return some.select("key", "same", F.explode(words).alias("word"))


def word_table(words: DataFrame) -> DataFrame:
    """(word, n, records): in how many different texts each word occurs, and in how many records, copies included."""
    texts = words.groupBy("same", "word").agg(F.count(F.lit(1)).alias("records"))
    return texts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("records").alias("records"))


def candidate_table(table: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """(word, n, records, read_as, written_in, restored) for each of ``pairs`` that can explain a word."""

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, r, *c) for w, n, r in zip(pdf["word"], pdf["n"], pdf["records"]) for c in _candidates(w, pairs)]
            yield pd.DataFrame(rows, columns=["word", "n", "records", "read_as", "written_in", "restored"])

    return table.mapInPandas(explain, "word string, n long, records long, read_as string, written_in string, restored string")


_RUNS = re.compile(r"(?:[^\x00-\x7F]|&[A-Za-z]{2,8};)+")


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """(garbled characters, clean character) of two words of one shape, aligned run by run.

    The characters of a clean run share the garbled run evenly; runs that can't be shared
    so, and characters that are the same, tell nothing.
    """
    out = []
    for x, y in zip(_RUNS.findall(garbled), _RUNS.findall(clean)):
        x = html.unescape(x)
        if len(x) % len(y) == 0:
            k = len(x) // len(y)
            out += [(x[i * k : i * k + k], c) for i, c in enumerate(y) if x[i * k : i * k + k] != c]
    return list(dict.fromkeys(out))


@lru_cache(maxsize=100_000)
def transformations(seen: str, meant: str) -> tuple[tuple[str, str], ...]:
    """The encoding pairs that map the characters ``seen`` to the character ``meant``."""
    return tuple(p for p in PAIRS if (fully(seen, p[0]) if p[1] == "utf-8" else reread(seen, *p)) == meant)


def explained(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The encoding pairs that all aligned characters of two words have in common."""
    maps = [set(transformations(x, y)) for x, y in aligned(garbled, clean)]
    return sorted(set.intersection(*maps)) if maps else []


def twins(table: DataFrame) -> DataFrame:
    """(shape, clean, n_clean, r_clean, n_all, r_all): the word of each shape that is in most texts, then records, and its share of both. Words of one run only have no shape of use."""
    return (
        table.where(~F.contains("word", F.lit(REPLACED)) & ~_bare(F.col("word")))
        .groupBy(shape(F.col("word")).alias("shape"))
        .agg(F.max(F.struct("n", "records", "word")).alias("top"), F.sum("n").alias("n_all"), F.sum("records").alias("r_all"))
        .select("shape", F.col("top.word").alias("clean"), F.col("top.n").alias("n_clean"), F.col("top.records").alias("r_clean"), "n_all", "r_all")
        .where(F.col("r_clean") >= MIN_CLEAN)
    )


def _more_frequent() -> Column:
    """Whether the clean word is in more texts than the word itself, or in as many texts and more records."""
    return F.struct("n_clean", "r_clean") > F.struct(F.col("n").alias("n_clean"), F.col("records").alias("r_clean"))


def _beside(table: DataFrame) -> DataFrame:
    """(word, clean): words and the more frequent one of their shape."""
    return (
        table.withColumn("shape", shape(F.col("word")))
        .where(~_bare(F.col("word")))
        .join(twins(table), "shape")
        .where((F.col("word") != F.col("clean")) & _more_frequent())
        .select("word", "clean")
    )


def mappings(table: DataFrame) -> DataFrame:
    """(word, seen, meant): what the characters of each word are in its clean twin, a row per different mapping of a word."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, *m) for w, c in zip(pdf["word"], pdf["clean"]) for m in aligned(w, c)]
            yield pd.DataFrame(rows, columns=["word", "seen", "meant"])

    return _beside(table).mapInPandas(align, "word string, seen string, meant string")


def learned_pairs(table: DataFrame) -> DataFrame:
    """(read_as, written_in, support): what the twins of ``table`` teach; support counts different words.

    Each different mapping of characters is explained once. A word supports the
    transformations that explain all of its mappings. A word without ASCII characters has
    no shape; its twin is a more frequent word equal to what a transformation makes of it.
    Characters that were lost map to U+FFFD and are told as read as "lost". At most
    ``len(PAIRS) + 1`` rows.
    """
    seen = cut_lineage(mappings(table))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, y, *p) for x, y in zip(pdf["seen"], pdf["meant"]) for p in ((("lost", "lost"),) if x == REPLACED else transformations(x, y))]
            yield pd.DataFrame(rows, columns=["seen", "meant", "read_as", "written_in"])

    known = seen.select("seen", "meant").distinct().mapInPandas(explain, "seen string, meant string, read_as string, written_in string")
    parts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("parts"))
    told = seen.join(known, ["seen", "meant"]).groupBy("word", "read_as", "written_in").agg(F.count(F.lit(1)).alias("told"))
    told = told.join(parts, "word").where("told = parts").select("word", "read_as", "written_in")
    clean = table.where(F.col("records") >= MIN_CLEAN).select(F.col("word").alias("restored"), F.col("n").alias("n_clean"), F.col("records").alias("r_clean"))
    alone = candidate_table(table.where(_bare(F.col("word")) & (F.length("word") > 2) & ~F.contains("word", F.lit(REPLACED))))
    alone = alone.join(clean, "restored").where(_more_frequent())
    return told.unionByName(alone.select("word", "read_as", "written_in")).groupBy("read_as", "written_in").agg(F.count_distinct("word").alias("support"))


def _learned(table: DataFrame) -> dict[tuple[str, str], int]:
    """The learned transformations with their support; bounded by the number of pairs."""
    rows = learned_pairs(table).collect()
    return {(r.read_as, r.written_in): r.support for r in rows if r.support >= (MIN_SUPPORT_UTF8 if r.written_in in ("utf-8", "lost") else MIN_SUPPORT)}


def garbled_words(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(key, same, word) of all records, and (word, restored) of the garbled words among them.

    Beside them the candidates, and the readings (word, restored, read_as, written_in,
    support) that were accepted.

    ``restored`` is null where characters were lost. Only learned transformations are
    applied. One of UTF-8 makes up for no twin by its multi-byte sequences; a single-byte
    one must make a word that is found clean in more than twice as many different texts as
    the garbled one, or in no fewer texts and more than twice as many records. A character
    or two that stand alone count only if what they were is found alone in more records, as
    a dash is and an apostrophe never. Of several readings the one found clean in most texts wins,
    then UTF-8, then support.
    """
    words = cut_lineage(suspect_words(df, key, text))
    table = cut_lineage(word_table(words))
    learned = _learned(table)
    pairs = tuple(p for p in PAIRS if p in learned)
    candidates = candidate_table(table.where(~F.contains("word", F.lit(REPLACED))), pairs)
    clean = table.select(F.col("word").alias("restored"), F.col("n").alias("n_clean"), F.col("records").alias("r_clean"))
    support = F.create_map(*[x for p in pairs for x in (F.lit("/".join(p)), F.lit(learned[p]))]) if pairs else F.create_map().cast("map<string,int>")
    utf8 = F.col("written_in") == "utf-8"
    telling = ~_bare(F.col("word")) | (F.length("word") > 2)
    by_texts = (F.col("n_clean") >= MIN_CLEAN) & (F.col("n_clean") > 2 * F.col("n"))
    by_records = (F.col("n_clean") >= F.col("n")) & (F.col("r_clean") >= MIN_CLEAN) & (F.col("r_clean") > 2 * F.col("records"))
    # A word of one or two characters was taken together with the next, so it stands before a blank.
    alone = table.where(F.contains("word", F.lit(" "))).groupBy(F.substring_index("word", " ", 1).alias("restored")).agg(F.sum("records").alias("alone"))
    whole = ~_bare(F.col("word")) | (F.length("restored") > 2) | ((F.col("alone") >= MIN_CLEAN) & (F.col("alone") > F.col("records")))
    accepted = (
        candidates.join(clean, "restored", "left")
        .join(alone, "restored", "left")
        .fillna(0, ["n_clean", "r_clean", "alone"])
        .withColumn("support", F.try_element_at(support, F.concat_ws("/", "read_as", "written_in")))
        .where((utf8 & whole) | (telling & (by_texts | by_records)))
    )
    ranked = accepted.groupBy("word").agg(F.max_by("restored", F.struct(_more_frequent(), utf8, "n_clean", "support", "restored")).alias("restored"))
    lost = (
        table.where(F.contains("word", F.lit(REPLACED)) & F.lit(("lost", "lost") in learned))
        .withColumn("shape", shape(F.col("word")))
        .join(twins(table), "shape", "left")
        .select("word", F.when((2 * F.col("n_clean") > F.col("n_all")) | (2 * F.col("r_clean") > F.col("r_all")), F.col("clean")).alias("restored"))
    )
    return words, ranked.unionByName(lost), candidates, accepted


def transformation_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(read_as, written_in, support, learned, words, records): the learned transformations and what they explain.

    Beside them the UTF-8 ones that no twin supports, though words have their sequences: such
    words aren't taken for garbled, and are told here instead. Words that more than one
    transformation explains count for each.
    """
    table = cut_lineage(word_table(suspect_words(df, key, text)))
    learned = _learned(table)
    asked = tuple(p for p in PAIRS if p in learned or p[1] == "utf-8")
    clean = table.select(F.col("word").alias("restored"), F.col("n").alias("n_clean"))
    found = candidate_table(table.where(~F.contains("word", F.lit(REPLACED))), asked).join(clean, "restored", "left")
    found = found.where((F.col("written_in") == "utf-8") | (F.col("n_clean") > 2 * F.col("n")))
    rows = found.groupBy("read_as", "written_in").agg(F.count(F.lit(1)).alias("words"), F.sum("records").alias("records"))
    lost = table.where(F.contains("word", F.lit(REPLACED))).agg(F.lit("lost").alias("read_as"), F.lit("lost").alias("written_in"), F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))
    known = df.sparkSession.createDataFrame([(*p, n) for p, n in learned.items()], "read_as string, written_in string, support long")
    out = rows.unionByName(lost.where("words > 0")).join(known, ["read_as", "written_in"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("read_as", "written_in", zero("support"), F.col("support").isNotNull().alias("learned"), zero("words"), zero("records"))


def remaining_words(words: DataFrame, bad: DataFrame, candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """(same, word, restored): words that are garbled by the single-byte pair which other words of their text confirm.

    The pair of most confirmed words is applied to the text's remaining words, unless a word
    also stands in a text without confirmed words, or what the pair makes of it has letters
    that no confirmed word has, mixed case, or capitals for small letters.
    """
    texts = cut_lineage(words.select("same", "word").distinct())
    pair = ["read_as", "written_in"]
    confirmed = cut_lineage(accepted.where("written_in <> 'utf-8'").join(bad, ["word", "restored"]).select("word", "restored", "support", *pair))
    told = texts.join(confirmed, "word").groupBy("same", *pair).agg(F.count(F.lit(1)).alias("told"), F.max("support").alias("support"))
    best = cut_lineage(told.groupBy("same").agg(F.max_by(F.struct(*pair), F.struct("told", "support", *pair)).alias("p")).select("same", "p.*"))
    elsewhere = texts.join(best, "same", "left_anti").select("word").distinct()
    letters = confirmed.select(*pair, F.explode(F.split(F.regexp_replace("restored", r"[\x00-\x7F]", ""), "")).alias("c"))
    letters = letters.groupBy(*pair).agg(F.array_join(F.collect_set("c"), "").alias("letters"))
    ordinary = ~F.col("restored").rlike(r"\p{Ll}\p{Lu}") & ~((F.col("restored") == F.upper("restored")) & (F.col("word") == F.lower("word")))
    return (
        texts.join(best, "same")
        .join(bad.select("word"), "word", "left_anti")
        .join(elsewhere, "word", "left_anti")
        .join(candidates.drop("n", "records"), ["word", *pair])
        .join(F.broadcast(letters), pair)
        .where((F.expr(r"translate(regexp_replace(restored, '[\\x00-\\x7F]', ''), letters, '')") == "") & ordinary)
        .select("same", "word", "restored")
    )


def find_garbled(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the records of which some text was decoded wrongly, each once.

    Null, empty and ASCII texts never count, nor do characters that the text only quotes, nor
    words whose transformation no clean twin in ``df`` teaches.
    Columns other than ``key`` and ``text`` are left out, whatever their names; repeated
    rows count once. A null key is a key.
    """
    words, bad, _, _ = garbled_words(df, key, text)
    return words.join(bad.select("word"), "word", "left_semi").select(F.col("key").alias(key)).distinct()


def restore(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, complete) of the affected records; ``complete`` is false where characters stay lost."""
    words, bad, candidates, accepted = garbled_words(df, key, text)
    bad = cut_lineage(bad)
    more = remaining_words(words, bad, candidates, accepted)
    fixed = words.join(bad, "word").unionByName(words.join(more, ["same", "word"]).select("word", "key", "same", "restored"))
    fixes = fixed.groupBy("key").agg(F.collect_set(F.struct("word", F.coalesce("restored", "word").alias("restored"))).alias("fixes"))

    @F.pandas_udf("string")
    def mended(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, fixes in zip(texts, lists):
            by = {f["word"]: f["restored"] for f in fixes}
            whole = re.compile("|".join(re.escape(w) for w in sorted(by, key=len, reverse=True)))
            out.append(whole.sub(lambda m: by[m.group()], t).removeprefix("﻿"))
        return pd.Series(out)

    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return texts.join(fixes, "key").select(F.col("key").alias(key), mended("text", "fixes").alias("restored")).withColumn("complete", ~F.contains("restored", F.lit(REPLACED)))
