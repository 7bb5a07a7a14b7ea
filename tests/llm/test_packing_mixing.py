import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import mixing, packing, tokens


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 100), max_size=120))
def test_evolved_packings_are_valid(sizes):
    bins = packing.evolve(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    # Never more than best fit of the sorted items, nor than 11/9 of the least and one.
    assert len(bins) <= len(packing.best_fit([], list(range(len(sizes))), sizes, 100)) and len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 60


def test_evolution_beats_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(250, 1000) for _ in range(1000)]
    greedy = len(packing.best_fit([], list(range(1000)), sizes, 2048))
    assert -(-sum(sizes) // 2048) <= len(packing.evolve(sizes)) < greedy


def test_crossover_keeps_every_item():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    a, b = (packing.best_fit([], rng.sample(range(80), 80), sizes, 100) for _ in range(2))
    child = packing.crossover(a, b, sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(sizes[i] for i in x) <= 100 for x in child)


def test_pack(rows, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 50)
    rng = random.Random(2)
    data = [(i, rng.choice((0, 5, 40, 90, 100, 101, 250, 700)), "x", 7) for i in range(400)] + [(999, None, "x", 7)]
    sizes = rows(data, "doc_id long, tokens long, container string, part int")
    got = packing.pack(sizes, capacity=100).collect()
    total, by = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        by[r.container] = by.get(r.container, 0) + r.tokens
    assert total == {k: n for k, n, *_ in data if n} and max(by.values()) <= 100
    assert all(len([r for r in got if r.doc_id == k]) == 1 for k, n, *_ in data if n and n <= 100)
    least = -(-sum(total.values()) // 100)
    report = packing.packing_report(packing.pack(sizes, capacity=100), 100).collect()[0]
    assert report.least == least and report.containers == len(by) <= 1.2 * least
    empty = packing.pack(sizes.limit(0), capacity=100)
    assert empty.count() == 0 and packing.packing_report(empty, 100).collect()[0].containers == 0


def test_with_tokens(rows):
    df = rows([(1, "Hello world, hello.", "s", 9), (2, None, "s", 9), (3, "", None, 9), (4, "a " * 100_000, "s", 9)], "doc_id long, text string, source string, tokens long")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and 100_000 <= got[4] <= 100_002
    assert tokens.with_tokens(df.limit(0)).columns == ["doc_id", "source", "tokens"]


TARGETS = [("small", 0.2, 3), ("big-one", 0.5, 1), ("Mid", 0.3, 2), ("none", 0.1, 4), (None, 0.1, 1)]


def sized(rows, n=3000):
    rng = random.Random(3)
    data = []
    for i in range(n):
        source = rng.choices(("small ", "BIG_ONE", "mid", "untargeted", None), (1, 30, 10, 5, 1))[0]
        data.append((i, source, rng.choice((0, 20, 50, 120, 900)), "x", 0))
    return data, rows(data, "doc_id long, source string, tokens long, bin string, whole int")


def test_mixture_reaches_its_shares(rows):
    data, sizes = sized(rows)
    targets = rows(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    got = mixed.collect()
    assert len({r.doc_id for r in got}) == len(got)
    most = {"small": 3, "big-one": 1, "mid": 2}
    assert all(1 <= r.copies <= most[r.source] for r in got)
    report = {r.source: r for r in mixing.mixture_report(mixed, sizes, targets).collect()}
    for source, share in (("small", 0.2), ("big-one", 0.5), ("mid", 0.3)):
        assert abs(report[source].actual_share - share) < 0.01
    assert report["none"].actual_tokens == 0 and len(report) == 4
    # The source that limits the mixture is used as often as it may be, all of it.
    held = sum(n for _, s, n, *_ in data if s == "small " and n)
    assert report["small"].actual_tokens == 3 * held or report["big-one"].documents == sum(1 for _, s, n, *_ in data if s == "BIG_ONE" and n) or report["mid"].most_copies == 2


def test_given_total_caps_and_reports(rows):
    _, sizes = sized(rows, 600)
    targets = rows(TARGETS, "source string, target_share double, max_repeats int")
    big = {r.source: r for r in mixing.mixture_report(mixing.mix(sizes, targets, total=10**9), sizes, targets, total=10**9).collect()}
    assert big["small"].most_copies == 3 and big["mid"].most_copies == 2 and big["big-one"].most_copies == 1
    assert big["small"].actual_tokens < big["small"].wanted_tokens + 1
    one = mixing.mix(sizes, targets, total=2_000)
    assert abs(one.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] - 2_000) < 400
    assert sorted(one.collect()) == sorted(mixing.mix(sizes, targets, total=2_000).collect())
    assert sorted(one.collect()) != sorted(mixing.mix(sizes, targets, total=2_000, seed=2).collect())


def test_inclusion_grows_with_size(rows):
    data = [(i, "s", 100 if i % 2 else 300) for i in range(4000)]
    sizes = rows(data, "doc_id long, source string, tokens long")
    targets = rows([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(sizes, targets, total=200_000).collect()
    long_ = sum(r.tokens == 300 for r in got)
    assert abs(sum(r.tokens for r in got) - 200_000) <= 300 and 2 < long_ / (len(got) - long_) < 4.5


def test_empty_mixtures(rows):
    _, sizes = sized(rows, 50)
    targets = rows(TARGETS, "source string, target_share double, max_repeats int")
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0
    assert mixing.mixture_report(mixing.mix(sizes.limit(0), targets), sizes.limit(0), targets).count() == 4


def test_a_gap_takes_as_many_fillers_as_fit(rows):
    # One long document ends the sample early; the gap is only filled by hundreds of short ones.
    data = [(i, "s", 5_000 if i < 4 else 11) for i in range(3_000)]
    sizes = rows(data, "doc_id long, source string, tokens long")
    targets = rows([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        got = mixing.mix(sizes, targets, total=9_900, seed=seed).collect()
        assert abs(sum(r.tokens for r in got) - 9_900) <= 5
        assert sum(r.tokens == 11 for r in got) > 64


def test_documents_that_would_pass_one_are_certain(rows):
    data = [(i, "s", 9_000 if i < 2 else 10) for i in range(1_000)]
    sizes = rows(data, "doc_id long, source string, tokens long")
    targets = rows([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    for seed in range(4):
        got = mixing.mix(sizes, targets, total=20_000, seed=seed).collect()
        assert {0, 1} <= {r.doc_id for r in got} and sum(r.tokens for r in got) == 20_000
    odds = mixing.inclusion(sizes, rows([("s", 20_000)], "source string, part long")).collect()
    assert [(r.source, r.certain) for r in odds] == [("s", 11)] and abs(odds[0].rate - 2_000 / (998 * 100)) < 1e-12


def test_islands_are_spread_over_tasks(rows, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 50)
    sizes = rows([(i, 30 + i % 41) for i in range(600)], "doc_id long, tokens long")
    names = {r.container for r in packing.pack(sizes, capacity=100).select("container").distinct().collect()}
    assert len({n.rsplit("-", 1)[0] for n in names if n.startswith("1-")}) > 6
