"""Expressions over answers: refusals, citations, leaked prompt text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Phrases by which an answer says that it can't be given.
REFUSALS = (
    "cannot answer", "do not know", "don't know", "don't have enough information", "not enough information",
    "no relevant information", "insufficient", "unable to answer", "not found in", "cannot find", "no information",
    "not contain", "don't have any relevant",
)
#: Fixed value: a citation.
CITATION = r"\[(?:[Ss][Oo][Uu][Rr][Cc][Ee]\s*)?(\d+)\]"
#: Prompt text that models leak, removed in this order. {name} is the assistant's.
LEAKS = (
    r"(?i)<\|.*?\|>",
    r"(?im)^assistant\s*:",
    r"(?is)\[INST\].*?\[/INST\]",
    r"(?i)CONVERSATION HISTORY",
    r"(?i)---\s*CONVERSATION HISTORY\s*---",
    r"(?i)---\s*SOURCES\s*---",
    r"(?im)^\[User\]\s*$",
    r"(?im)^\[{name}\]\s*$",
    r"(?im)^\[User\]\s",
    r"(?im)^\[{name}\]\s",
    r"(?im)^Question:\s",
    r"(?is)Please answer this question with proper Markdown.*",
    r"(?m)^\[Source \d+\]\s+[\w/]+\.\w+:.*$",
)
#: Paragraphs of at least so many characters are compared, and dropped above this overlap.
LONG_PARAGRAPH, SAME_PARAGRAPH = 80, 0.80


def is_refusal(answer: Column) -> Column:
    """Whether any phrase of refusal occurs."""
    low = F.lower(answer)
    out = F.lit(False)
    for phrase in REFUSALS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def cited(answer: Column) -> Column:
    """The different numbers that an answer cites, ascending; numbers beyond an int are none."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def used_sources(answer: Column, n_sources: Column) -> Column:
    """The cited numbers that name one of ``n_sources`` sources."""
    return F.filter(cited(answer), lambda n: (n >= 1) & (n <= n_sources))


def rewrite_citations(answer: Column, used: Column) -> Column:
    """Cited numbers replaced by their position among ``used``, all at once; others stay as they are.

    The text is split at the citations and joined again, so no replacement meets another.
    """
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    between = F.split(answer, CITATION)
    number = lambda m: F.regexp_extract(m, CITATION, 1).try_cast("int")
    new = lambda m: F.coalesce(F.array_position(used, number(m)), F.lit(0))
    said = F.transform(marks, lambda m: F.when(new(m) > 0, F.concat(F.lit("[Source "), new(m).cast("string"), F.lit("]"))).otherwise(m))
    pieces = F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(said, i), F.lit(""))))
    return F.array_join(pieces, "")


def strip_leaks(answer: Column, name: str = "Assistant") -> Column:
    """Leaked prompt text removed."""
    for pattern in LEAKS:
        answer = F.regexp_replace(answer, pattern.replace("{name}", re.escape(name)), "")
    return answer


def distinct_paragraphs(answer: Column) -> Column:
    """Long paragraphs that mostly repeat an earlier one dropped, blank ones too; the order stays.

    A fold over the paragraphs of one text, whose state holds the word sets of those kept.
    """
    words = lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    state = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<array<string>>").alias("seen"))

    def step(s: Column, p: Column) -> Column:
        bare = strip(p)
        long_ = F.length(bare) >= LONG_PARAGRAPH
        w = words(bare)
        least = lambda o: F.least(F.size(o), F.size(w))
        again = F.exists(s["seen"], lambda o: (least(o) > 0) & (F.size(F.array_intersect(o, w)) > SAME_PARAGRAPH * least(o)))
        drop = (F.length(bare) == 0) | (long_ & again)
        return F.when(drop, s).otherwise(
            F.struct(F.concat(s["kept"], F.array(p)).alias("kept"), F.when(long_, F.concat(s["seen"], F.array(w))).otherwise(s["seen"]).alias("seen"))
        )

    return F.aggregate(F.split(answer, "\n\n"), state, step, lambda s: F.array_join(s["kept"], "\n\n"))


def sanitize(answer: Column, name: str = "Assistant") -> Column:
    """Leaks and repeated paragraphs removed, empty lines collapsed, stripped."""
    return strip(F.regexp_replace(distinct_paragraphs(strip_leaks(answer, name)), "\n{3,}", "\n\n"))


def link_citations(answer: Column) -> Column:
    """``[1, 2]`` and ``[Source 3]`` as one link per number."""
    listed = r"\[(?:[Ss]ources?\s*)?(\d+(?:\s*,\s*\d+)*)\]"
    marks = F.regexp_extract_all(answer, F.lit(listed), F.lit(1))
    links = F.transform(marks, lambda m: F.array_join(F.transform(F.split(m, r"\s*,\s*"), lambda n: F.concat(F.lit("["), n, F.lit("](#source-"), n, F.lit(")"))), " "))
    return F.array_join(F.transform(F.split(answer, listed), lambda t, i: F.concat(t, F.coalesce(F.get(links, i), F.lit("")))), "")


#: What mathematical characters are in LaTeX.
LATEX = {
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta",
    "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "ν": r"\nu", "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho",
    "σ": r"\sigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\varphi", "ϕ": r"\phi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma", "Υ": r"\Upsilon",
    "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla",
    "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq", "∪": r"\cup", "∩": r"\cap",
    "∀": r"\forall", "∃": r"\exists", "∞": r"\infty", "≈": r"\approx", "≠": r"\neq", "≤": r"\leq", "≥": r"\geq", "→": r"\to",
    "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "×": r"\times",
    "·": r"\cdot", "±": r"\pm", "∓": r"\mp", "√": r"\sqrt", "∝": r"\propto", "⊗": r"\otimes", "⊕": r"\oplus", "ℝ": r"\mathbb{R}",
    "ℤ": r"\mathbb{Z}", "ℕ": r"\mathbb{N}", "ℂ": r"\mathbb{C}", "ℙ": r"\mathbb{P}",
}
#: The characters that make a line mathematical, and those that may stand beside them in one expression.
MATH = "".join(map(chr, range(0x3B1, 0x3CA))) + "".join(map(chr, range(0x391, 0x3AA))) + "ϕ∑∏∫∂∇∈∉⊂⊃⊆⊇∪∩∀∃∞≈≠≤≥⇒⇐⇔×±∓√∝⊗⊕ℝℤℕℂℙ∗"
_BESIDE = r"a-zA-Z0-9_^∗*{}()\[\], =+\-/."
_FORMULA = re.compile(r"\$[^$]+\$")
_EXPRESSION = re.compile(rf"[({{]?[{_BESIDE}]*[{MATH}][{_BESIDE}{MATH}]*[)}}]?")
_IN_LATEX = str.maketrans(LATEX | {"∗": "^*"})


def _formula(m: re.Match[str]) -> str:
    """An expression as a LaTeX formula, the blanks around it outside."""
    said = m.group()
    bare = said.strip()
    lead = said[: len(said) - len(said.lstrip())]
    return f"{lead}${bare.translate(_IN_LATEX).strip()}${said[len(lead) + len(bare) :]}" if bare else said


def math_to_latex() -> Callable[[Column], Column]:
    """A column function that writes expressions with mathematical characters in LaTeX.

    Fenced code and lines that begin a display formula stay as they are, and so do lines
    whose mathematics is in formulas already.
    """
    symbol = re.compile(f"[{MATH}]")

    @F.pandas_udf("string")
    def latex(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None or not symbol.search(text):
                return text
            out, fenced = [], False
            for line in text.split("\n"):
                fence = line.strip().startswith("```")
                fenced ^= fence
                plain = fence or fenced or line.strip().startswith("$$") or not symbol.search(_FORMULA.sub("", line))
                out.append(line if plain else _EXPRESSION.sub(_formula, line))
            return "\n".join(out)

        return texts.map(one)

    return latex
