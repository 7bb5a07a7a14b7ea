import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting
from docloom.llm.splitting import cut

TOKEN = regex.compile(splitting.TOKEN)


def count(t):
    return len(TOKEN.findall(t))


@settings(max_examples=150, deadline=None)
@given(t=st.text(alphabet=st.sampled_from(list("ab Z9_é日.\n#!-")), max_size=600), limit=st.integers(4, 30), data=st.data())
def test_pieces_cover_and_overlap(t, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = cut(t, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(t)
    for a, b, n in pieces:
        assert 0 <= a <= b <= len(t) and n <= limit and count(t[a:b]) == n
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert count(t[c:b]) == overlap and d > b and a <= c <= b + max(0, c - b)
    if count(t) <= limit:
        assert pieces == [(0, len(t), count(t))]


def test_natural_ends():
    sentence = "The old crane was moved to the quay. "
    paragraph = sentence * 6
    text = "\n\n".join(f"{paragraph}Part {i}." for i in range(10))
    for a, b, _ in cut(text, 120, 10)[:-1]:
        assert text[a:b].endswith(".") and text[b:].lstrip()[:4] in ("The ", "Part")
    assert len(cut("x" * 100, 10, 2)) > 1 and all(n <= 10 for _, _, n in cut("x" * 100, 10, 2))
    assert cut("", 10, 2) == [(0, 0, 0)] and cut("... !!", 10, 2) == [(0, 6, 0)]


def test_rows_with_dirt(rows):
    long_ = "word " * 600
    df = rows([("a", long_, "x", 1), ("b", None, None, 2), ("c", "", "y", 3), (None, long_, "z", 4), ("a", long_, "x", 1)], "id string, text string, tokens string, piece_no int")
    got = splitting.split_oversized(df).collect()
    assert [r.id for r in got].count("a") == 2 * [r.id for r in got].count(None) and {r.id for r in got} == {"a", None}
    assert max(r.piece_no for r in got) == len(cut(long_)) and all(r.piece == long_[r.start : r.end] for r in got)
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_offsets_in_documents(rows):
    body = "word " * 600
    chunks = rows([("c", "d", f"[Source: T]\n[Section: Root]\n{body}", 0), ("m", "gone", body, 5), ("k", "d", "small", 0)], "id string, doc_id string, text string, start_char int")
    docs = rows([("d", f"Head\n{body}")], "id string, raw_text string")
    pieces = splitting.split_oversized(chunks)
    got = splitting.place_in_documents(pieces, chunks, docs).orderBy("id", "piece_no").collect()
    raw = f"Head\n{body}"
    for r in got:
        if r.id == "c":
            assert raw[r.start_char : r.end_char] == r.piece.split("]\n")[-1]
        else:
            assert r.start_char is None and r.end_char is None
