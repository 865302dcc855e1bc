"""Groups of documents alike in 0.8 of their five-word shingles, against all pairs."""

import random

from polystore.llm import simhash
from tests.llm import brute


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(40, 300))]
        for edits in (0, 1, 2, 3, 6, 12):
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = word()
            rows.append((len(rows), " ".join(w)))
    crowd = [word() for _ in range(120)]
    for k in range(120):
        w = list(crowd)
        for at in rng.sample(range(len(w)), 1 + k % 6):
            w[at] = word()
        rows.append((len(rows), " ".join(w)))
    return rows


def test_near_copies_go(spark):
    rows = planted()
    roots = brute.components([t for _, t in rows], brute.alike)
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    far = [k for k, r in enumerate(roots) if r != k and (fps[k] ^ fps[r]).bit_count() > simhash.DISTANCE]
    assert len(far) > 50  # more than two bits away, and alike
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_late_texts_of_a_crowd_meet(spark, monkeypatch):
    """Pairs that come after the first of every key they share: each text takes from one base, and has more of its own."""
    from polystore.llm import alike

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for _ in range(60):
        own = base + [word() for _ in range(60)]
        for _ in range(2):  # alike to each other, at 120 / 240 to the others
            rows.append((len(rows), " ".join([*own[:-1], word()])))
    monkeypatch.setattr(alike, "ROUNDS", ((0, 0),))  # the rest is whole by itself
    monkeypatch.setattr(alike, "_stars", lambda low, high: lambda batches: iter([]))
    roots = brute.components([t for _, t in rows], brute.alike)
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert len(set(roots)) == 60
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_small_open_keys_list_no_shingles(spark, monkeypatch):
    """Texts of open keys meet by their sets, a row a text and key; shingles are listed for keys of over a block alone, with the same links."""
    from polystore.llm import alike

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, rows, listed, listing = [word() for _ in range(120)], [], [], alike._with_partners
    for _ in range(30):
        own = base + [word() for _ in range(60)]
        for _ in range(2):
            rows.append((len(rows), " ".join([*own[:-1], word()])))
    monkeypatch.setattr(alike, "ROUNDS", ((0, 0),))
    monkeypatch.setattr(alike, "_stars", lambda low, high: lambda batches: iter([]))
    monkeypatch.setattr(alike, "_with_partners", lambda *x: listed.append(1) or listing(*x))
    for block in (512, 20):
        monkeypatch.setattr(alike, "BLOCK", block)
        kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 60, 2))
        assert bool(listed) == (block < 60)
