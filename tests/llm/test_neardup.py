import datetime as dt
import random

import numpy as np

from docloom.llm import neardup

S = "id string, raw_text string, updated_at timestamp, key string, t1 string, node long"


def at(d):
    return dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)


def texts(n, seed=1, words=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(pool) for _ in range(words)) for _ in range(n)]


def edited(text, n, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def brute(data, width, threshold):
    sets = {}
    for key, text in data:
        w = neardup._WORD.findall((text or "").lower())
        if len(w) >= width:
            sets[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_pairs_match_brute_force(rows):
    base = texts(150)
    data = [(f"a{i:03d}", t) for i, t in enumerate(base)]
    data += [(f"b{i:03d}", edited(t, 1 + i % 5, i)) for i, t in enumerate(base[:80])] + [(f"c{i:03d}", t.upper() + " ") for i, t in enumerate(base[:20])]
    data += [("e1", base[0]), ("e2", base[0]), ("s1", "one two"), ("s2", "one two"), ("n", None), ("z", "")]
    df = rows([(k, t, at(1), "x", "y", 1) for k, t in data] + [("a000", base[0], at(2), "x", "y", 1)], S)
    got = {tuple(r) for r in neardup.id_pairs(*neardup.near_duplicates(df, newest="updated_at", width=3, threshold=0.6, recall=0.999)).collect()}
    assert got == brute(data, 3, 0.6) and len(got) > 80


def test_groups(rows):
    base = texts(4, 7, 100)
    chain = [base[0]]
    for i in range(6):
        chain.append(edited(chain[-1], 3, i))
    data = [(f"k{i}", t) for i, t in enumerate(chain)] + [("x", base[1]), ("y", base[1]), ("z", base[2]), ("s", "a b"), ("n", None)]
    df = rows([(k, t, at(1), None, None, None) for k, t in data], S)
    members, links = neardup.near_duplicates(df, width=3, threshold=0.6, recall=0.999)
    got = {r.key: (r.group, r.links) for r in neardup.groups(members, links).collect()}
    assert len({got[f"k{i}"][0] for i in range(7)}) == 1 and got["x"][0] == got["y"][0] != got["z"][0] and got["x"][1] == 0 and got["k1"][1] >= 2
    assert "n" not in got and got["s"][1] == 0


def test_large_nodes_branch_and_meet_in_blocks(monkeypatch, rows):
    monkeypatch.setattr(neardup, "NODE", 5)
    same = texts(1, 3, 80)[0]
    data = [(f"h{i:02d}", edited(same, 1, i)) for i in range(40)] + [(f"o{i}", t) for i, t in enumerate(texts(20, 5))]
    df = rows([(k, t, at(1), "", "", 0) for k, t in data], S)
    got = {tuple(r) for r in neardup.id_pairs(*neardup.near_duplicates(df, width=5, threshold=0.8, recall=0.999)).collect()}
    assert got == brute(data, 5, 0.8) and len(got) > 100


def test_empty_and_long(rows):
    df = rows([], S)
    members, links = neardup.near_duplicates(df)
    assert members.count() == 0 and links.count() == 0 and neardup.groups(members, links).count() == 0
    long_ = " ".join(texts(1, 9, 60_000))
    df = rows([("a", long_, at(1), "", "", 0), ("b", long_ + " tail", at(1), "", "", 0), ("c", "", at(1), "", "", 0)], S)
    assert [tuple(r) for r in neardup.id_pairs(*neardup.near_duplicates(df)).collect()] == [("a", "b")]


def test_later_delivery_counts(rows):
    a, b = texts(2, 11)
    df = rows([("x", a, at(1), "", "", 0), ("x", b, at(2), "", "", 0), ("y", a, at(1), "", "", 0), ("z", b, at(1), "", "", 0)], S)
    pairs = neardup.id_pairs(*neardup.near_duplicates(df, newest="updated_at"))
    assert [tuple(r) for r in pairs.collect()] == [("x", "z")]


def test_embedding_estimates_similarity():
    shingle = neardup.Shingler(3)
    a, b = texts(1, 13, 500)[0], None
    b = edited(a, 25, 1)
    x, y = shingle(a), shingle(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    bits = [np.asarray(neardup.mix(neardup.embed(s)[neardup.COORDINATES :]) & np.uint64(1)) for s in (x, y)]
    assert abs(2 * (bits[0] == bits[1]).mean() - 1 - true) < 0.2
    assert len(shingle("a b")) == 0 and len(shingle(None)) == 0
