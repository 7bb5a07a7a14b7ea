"""Text expressions shared by the operators: normalising, hashing, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode words; the same pattern gives the same matches in Java, RE2 and Python.
WORD = r"[\p{L}\p{N}_]+"
#: What a strip removes: Unicode white space and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column | str) -> Column:
    """White space of either end removed; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def normalize_text(c: Column | str) -> Column:
    """Stripped, line ends as LF, runs of blanks as one, at most one empty line in a row."""
    out = F.regexp_replace(strip(c), "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")


def content_hash(c: Column | str) -> Column:
    """SHA-256 in hex over the normalised text."""
    return F.sha2(normalize_text(c), 256)


def tokens(c: Column | str) -> Column:
    """Lower-cased words in order, with repeats."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Words set apart by white space; 0 for blank text."""
    t = strip(c)
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, f"{SPACE}+")))


def strip_context_prefix(c: Column | str) -> Column:
    """The text after its leading source line, left-stripped; a section line stays.

    The line ends at the first ``]`` before a line end, else at the first line end; a
    text that has neither, or no source line, is unchanged.
    """
    c = F.col(c) if isinstance(c, str) else c
    close, line = F.locate("]\n", c), F.locate("\n", c)
    rest = F.when(close > 0, F.substring(c, close + 2, F.length(c))).when(line > 0, F.substring(c, line + 1, F.length(c)))
    lead = F.regexp_replace(rest, f"^{SPACE}+", "")
    return F.when(F.startswith(c, F.lit("[Source:")), F.coalesce(lead, c)).otherwise(c)


def truncate_to_sentence(c: Column, limit: int = 1500) -> Column:
    """Text above ``limit`` cut after its last full stop, if that lies in the second half, else cut and dotted."""
    head = F.substring(c, 1, limit)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    has_stop = F.instr(head, ".") > 0
    cut = F.when(has_stop & (stop - 1 > limit // 2), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def clean_summary(c: Column | str, limit: int = 200) -> Column:
    """One line, stripped, of at most ``limit`` characters with dots where it was cut."""
    t = strip(F.translate(F.col(c) if isinstance(c, str) else c, "\n", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def first_sentence(c: Column | str) -> Column:
    """The first sentence or line, as an extractive summary."""
    return F.regexp_extract(normalize_text(c), r"^(?:#+ )?([^\n]*?(?:[.!?](?=\s|$)|(?=\n)|$))", 1)


#: Words that carry no meaning for retrieval.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need must "
    "i me my we our you your he she it they them their this that these those what which who whom where when why how "
    "and or but if then so not no nor in on at to for of with by from about also tell please ok okay thanks thank yes yeah sure "
    "know think like just really very too more most some any all each every only own same than other such into over after before "
    "between under above up down out"
).split()
#: How a question begins that refers back to an earlier one.
REFERENTIAL = (
    "what about", "how about", "tell me more", "and the", "what were", "what was", "what is", "what are",
    "can you also", "also", "same for", "and what", "regarding", "concerning", "elaborate",
)
#: Characters that mark mathematical text.
MATH_SYMBOLS = "∫∑∏√∂∇∆λμσπαβγδεζηθ²³°±×÷≤≥≠∈⊂∞"


def key_words(c: Column) -> Column:
    """ASCII words of three letters and more that aren't stop words, in order, with repeats."""
    words = F.filter(tokens(c), lambda w: w.rlike("^[a-z]{3,}$"))
    return F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w))


def key_terms(c: Column, most: int = 8) -> Column:
    """The first ``most`` different key words."""
    return F.slice(F.array_distinct(key_words(c)), 1, most)


def is_vague(c: Column) -> Column:
    """Whether a question has at most two key words or begins by referring back."""
    q = F.lower(strip(c))
    refers = F.lit(False)
    for start in REFERENTIAL:
        refers = refers | F.startswith(q, F.lit(start))
    return (F.size(key_words(q)) <= 2) | refers


def expand_query(question: Column, history: Column) -> Column:
    """A vague question with up to six key terms of its history (an array of texts) before it."""
    terms = key_terms(F.array_join(history, " "), 6)
    return F.when(is_vague(question) & (F.size(terms) > 0), F.concat(F.lit("["), F.array_join(terms, " "), F.lit("] "), question)).otherwise(question)


def title_from(answer: Column, message: Column) -> Column:
    """A session's title: the proposed one without quotes and full stop, else the message's beginning."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(answer), '^"+|"+$', ""), "^'+|'+$", ""), r"^\.+|\.+$", "")
    short = F.when(F.length(message) > 50, F.concat(F.substring(message, 1, 50), F.lit("..."))).otherwise(message)
    return F.coalesce(F.nullif(F.substring(bare, 1, 60), F.lit("")), short)


def has_math(c: Column) -> Column:
    """Whether any mathematical symbol occurs."""
    return c.rlike(f"[{MATH_SYMBOLS}]")


def paragraphs(c: Column) -> Column:
    """Plain text with its paragraphs stripped and the empty ones dropped."""
    parts = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: F.length(p) > 0)
    return F.array_join(parts, "\n\n")


def breadcrumbs(*headings: Column) -> Column:
    """Headings of levels 1 to 3 joined, or the root."""
    return F.coalesce(F.nullif(F.concat_ws(" > ", *headings), F.lit("")), F.lit("Root"))


def table_markdown(c: Column) -> Column:
    """An array of rows of cells as a Markdown table; null cells are empty, line ends in cells blanks."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(F.translate(strip(x), "\n", " "), F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(c[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.concat(F.array(row(c[0]), rule), F.transform(F.slice(c, 2, 1_000_000), row))
    return F.when((F.size(c) > 0) & (F.size(c[0]) > 0), F.array_join(body, "\n")).otherwise("")


def kilo_chars(n: Column) -> Column:
    """A number of characters in thousands, as a label."""
    return F.format_string("%.0fk chars", n / 1000)
