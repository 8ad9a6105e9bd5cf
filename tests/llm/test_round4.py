"""What the fourth round mended: hits of windows, near copies in crowds."""

import random

import pytest

from attestra.llm import decontam, near_copies

from test_llm import words


@pytest.mark.parametrize("limit", [0, 500_000])
def test_copies_of_items_make_no_hits_of_their_own(spark, monkeypatch, limit):
    """Items with the same texts are met once, and no hit carries its document; an id with several texts stays one item."""
    seen, write = {}, decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    r = random.Random(4)
    item, other = "Tom has 3 kg of " + words(r, 30), words(r, 40)
    docs = spark.createDataFrame([(1, words(r, 50) + " " + item.replace("3", "7") + " " + words(r, 50)), (2, other), (None, item)], "doc_id long, text string")
    items = [(None if i == 9 else i, item) for i in range(40)] + [(50, item), (50, other), (51, None)]
    one = decontam.contaminated(docs, spark.createDataFrame([(0, item), (50, item), (50, other)], "item_id long, text string"), broadcast_rows=limit).collect()
    pairs, hits = seen["decontam-pairs"].count(), seen["decontam-hits"]
    seen.clear()
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit).collect()
    assert seen["decontam-pairs"].count() == pairs > 0
    assert hits.selectExpr("max(size(doc_vh))").first()[0] == 8
    tell = lambda rows, i: {(x.doc_id, x.n_windows, x.n_hit, x.n_exact) for x in rows if x.item_id == i}
    assert {x[0] for x in tell(one, 0)} == {1, None} and {x[0] for x in tell(one, 50)} <= {1, 2, None}
    assert all(tell(got, i) == tell(one, 0) for i in [*range(9), None, *range(10, 40)]) and tell(got, 50) == tell(one, 50) and not tell(got, 51)
    assert len(got) == len(set(got))


def test_no_link_of_a_crowd_is_lost(spark, monkeypatch):
    """Where the linear pass finds next to nothing, groups are still those of all pairs that share a key."""
    monkeypatch.setattr(near_copies, "NEXT", 0)
    r = random.Random(9)
    base, rows = words(r, 120).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(1, 14)):
            w[r.randrange(len(w))] = words(r, 1)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, words(r, 40)) for i in range(20)]
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    told = {i: near_copies.sketch(h) for i, h in sets.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            near = ((told[a][1] ^ told[b][1]) & (1 << 64) - 1).bit_count() <= 20
            if a < b and near and (told[a][2] == told[b][2]).any() and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    got = {}
    for x in near_copies.groups(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=4, block=16).collect():
        got.setdefault(x.root, set()).add(x.doc_id)
    want = {}
    for i in sets:
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(sets)
