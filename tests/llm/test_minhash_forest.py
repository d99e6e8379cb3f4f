import random
import re

from veracity.llm import minhash_forest as M
from veracity.llm.components import connected_components


def brute(rows, words=5, percent=75):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    """Unrelated texts, groups of near copies of all closeness, a large star group and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(3000)]

    def text(n):
        return [r.choice(vocab) for _ in range(n)]

    passage, out = text(40), []
    for _ in range(60):
        out.append(text(r.randint(3, 120)) + (passage if r.random() < 0.5 else []))
    for _ in range(25):
        base = text(r.randint(30, 200))
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(copy)
    centre = text(150)
    out.append(centre)
    for _ in range(80):  # each close to the centre, few close to each other
        copy = list(centre)
        for _ in range(4):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        out.append(copy)
    out += out[:10]
    r.shuffle(out)
    return [(i, " ".join(w).title() if r.random() < 0.2 else "\t".join(w)) for i, w in enumerate(out)]


def test_equals_brute_force(spark):
    rows = corpus()
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), region=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(seed=11, n=360):
    """Edits of one template that isn't among them: two at a time are just above the threshold, other pairs below it."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base = [r.choice(vocab) for _ in range(600)]
    rows = []
    for i in range(n):
        if i % 2 == 0:
            common = r.sample(range(2, 600, 5), 4)
            own = [r.choice(vocab) if k in common else w for k, w in enumerate(base)]
        copy = list(own)
        for k in r.sample(range(2, 600, 5), 8):
            copy[k] = r.choice(vocab)
        rows.append((i, " ".join(copy)))
    return rows


def test_family_without_its_template(spark):
    rows = family()
    want = brute(rows)
    assert 100 < len({c for _, c in want.values()}) < 200  # many components, many links
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_blocks_of_large_regions(spark, monkeypatch):
    rows = family(12, 120)
    monkeypatch.setattr(M, "BLOCK", 32)
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_rows(spark, odd_docs):
    got = M.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by[i].kept for i in (1, 2, 3))
    assert by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert by[9].n_shingles == 1 and by[10].component_id == 9  # fewer words are one shingle; ASCII case doesn't count


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).collect() == []


def test_case_of_other_letters_counts():
    h = M._WordHashes()
    assert (M.shingle_set("É a".encode(), 5, h) != M.shingle_set("é a".encode(), 5, h)).all()
    assert (M.shingle_set(b"A\x0bB", 5, h) == M.shingle_set(b"a b", 5, h)).all()
    assert len(M.shingle_set("a b c".encode(), 5, h)) == 1  # a no-break space isn't a gap
    assert (M.shingle_set("a b".encode(), 5, h) != M.shingle_set(b"a b", 5, h)).all()


def test_components_of_long_chains(spark):
    r = random.Random(1)
    order = list(range(300))
    r.shuffle(order)
    chain = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}
