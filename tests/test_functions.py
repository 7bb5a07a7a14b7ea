import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import answers, scores, text
from docloom.operators.rerank import shortened


def values(spark, data, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in data], "x string").select(column).collect()]


def test_normalize_and_hash(spark):
    given_ = ["  a\r\nb\t \tc\n\n\n\nd  ", "", None, "x", "café "]
    want = ["a\nb c\n\nd", "", None, "x", "café"]
    assert values(spark, given_, text.normalize_text("x")) == want
    assert values(spark, ["x "], text.content_hash("x")) == [hashlib.sha256(b"x").hexdigest()]


def test_tokens_match_python(spark):
    data = ["Größe x² _a1 naïve—Über Ж٣", "", "a  b", "日本語 x", "’tis"]
    assert values(spark, data, text.tokens("x")) == [re.findall(r"\w+", d.lower()) for d in data]


def test_strip_context_prefix(spark):
    data = ["[Source: a]\n[Section: Root]\nb", "[Source: a b\n  c", "[Source: only", "plain", None, "[Source: x [1]]\n\n t"]
    assert values(spark, data, text.strip_context_prefix("x")) == ["[Section: Root]\nb", "c", "[Source: only", "plain", None, "t"]


def test_truncate_to_sentence(spark):
    long_ = "a" * 800 + "." + "b" * 900
    data = [long_, "c" * 1600, "short", "." + "d" * 1600, None]
    got = values(spark, data, text.truncate_to_sentence(F.col("x")))
    assert got == ["a" * 800 + ".", "c" * 1500 + "...", "short", "." + "d" * 1499 + "...", None]
    assert [shortened(x) for x in data[:4]] == got[:4]


def test_summary_title_breadcrumbs(spark):
    assert values(spark, ["a\nb ", "z" * 201, None], text.clean_summary("x")) == ["a b", "z" * 197 + "...", None]
    assert values(spark, ["# Head\nrest", "One. Two.", ""], text.first_sentence("x")) == ["Head", "One.", ""]
    assert values(spark, ['"Good title."', "", "x" * 70], text.title_from(F.col("x"), F.lit("m" * 60))) == ["Good title", "m" * 50 + "...", "x" * 60]
    assert values(spark, ["h"], text.breadcrumbs(F.lit(None).cast("string"), F.col("x"))) == ["h"]
    assert values(spark, ["h"], text.breadcrumbs(F.lit(None).cast("string"))) == ["Root"]


def test_vague_and_expand(spark):
    data = ["tell me more", "What about the long catalogue of pumps and valves?", "Compare harbour cranes with mobile loaders", ""]
    assert values(spark, data, text.is_vague(F.col("x"))) == [True, True, False, True]
    history = F.array(F.lit("The harbour crane was moved"), F.lit("crane loaders"))
    assert values(spark, data[:1], text.expand_query(F.col("x"), history)) == ["[harbour crane moved loaders] tell me more"]
    assert values(spark, data[:1], text.expand_query(F.col("x"), F.array().cast("array<string>"))) == ["tell me more"]


def test_table_markdown(spark):
    df = spark.createDataFrame([([["a", "b"], ["c\nd", None]],), ([],)], "x array<array<string>>")
    assert [r[0] for r in df.select(text.table_markdown(F.col("x"))).collect()] == ["| a | b |\n| --- | --- |\n| c d |  |", ""]


def test_scores(spark):
    row = spark.range(1).select(
        scores.sigmoid(F.lit(0.0)), scores.sigmoid(F.lit(-800.0)), scores.similarity_from_distance(F.lit(0.5)), scores.rrf(F.lit(1)),
        scores.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), scores.overlap(F.array().cast("array<string>"), F.array(F.lit("b"))),
        scores.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))), scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
    ).first()
    assert row[0] == 0.5 and row[1] == 0.0 and row[2] == 0.75 and math.isclose(row[3], 1 / 61)
    assert row[4] == 1.0 and row[5] == 0.0 and math.isclose(row[6], 1.0) and row[7] is None


def test_citations(spark):
    data = ["a [2] b [Source 1][source 2] [9]", "none", "[99999999999]"]
    assert values(spark, data, answers.cited(F.col("x"))) == [[1, 2, 9], [], []]
    used = answers.used_sources(F.col("x"), F.lit(2))
    assert values(spark, data, answers.rewrite_citations(F.col("x"), used)) == ["a [Source 2] b [Source 1][Source 2] [9]", "none", "[99999999999]"]
    only = F.array(F.lit(2), F.lit(1)).cast("array<int>")  # a swap: no replacement meets another
    assert values(spark, ["[1][2]"], answers.rewrite_citations(F.col("x"), only)) == ["[Source 2][Source 1]"]
    assert values(spark, ["see [1, 2] and [Source 3]"], answers.link_citations(F.col("x"))) == ["see [1](#source-1) [2](#source-2) and [3](#source-3)"]


def test_sanitize(spark):
    para = "The quick brown fox jumps over the lazy dog near the river bank while the sun sets behind hills."
    data = [f"assistant: {para}\n\n{para} Again.\n\n\n\nShort.\n\nShort.", "<|end|>Hi", "", "[INST] x\ny [/INST]ok"]
    assert values(spark, data, answers.sanitize(F.col("x"))) == [f"{para}\n\nShort.\n\nShort.", "Hi", "", "ok"]


def test_kilo_chars(spark):
    assert values(spark, ["1499", "1501"], text.kilo_chars(F.col("x").cast("int"))) == ["1k chars", "2k chars"]


def test_refusal(spark):
    assert values(spark, ["I DON'T KNOW that", "It is 5."], answers.is_refusal(F.col("x"))) == [True, False]


def test_latex(spark):
    assert values(spark, ["x ≤ 2\n```\n≤\n```", None], answers.math_to_latex()(F.col("x"))) == ["$x \\leq 2$\n```\n≤\n```", None]
    said = ["Since f(α) → ∞, the sum ∑ x_i diverges.", "given $α$ only", "$$ β", "plain", "λ∗ and π"]
    assert values(spark, said, answers.math_to_latex()(F.col("x"))) == ["$Since f(\\alpha)$ → $\\infty, the sum \\sum x_i diverges.$", "given $α$ only", "$$ β", "plain", "$\\lambda^* and \\pi$"]


@pytest.mark.parametrize("limit", [1500])
@settings(max_examples=50, deadline=None)
@given(t=st.text(alphabet="ab. ", max_size=3200))
def test_shortened_bounds(t, limit):
    out = shortened(t, limit)
    assert len(out) <= limit + 3 and (len(t) > limit or out == t)
