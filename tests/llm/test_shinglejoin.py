import random

import numpy as np

import corpus_pipeline
from glidepath.llm import shinglejoin
from glidepath.llm.shinglejoin import near_duplicates, one_of_each


def jaccard(x, y):
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def test_stage_finds_all_pairs_of_similarity_four_fifths(spark, sf_dir, docs):
    rnd, texts = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(60):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(200, 600))]
        copy = list(text)
        for i in rnd.sample(range(len(text)), rnd.randint(1, len(text) // 40)):
            copy[i] = rnd.choice(vocabulary)
        texts += [" ".join(text), " ".join(copy)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()}
    similar = [jaccard(texts[i], texts[i + 1]) for i in range(0, 120, 2)]
    assert sum(0.8 <= s < 0.9 for s in similar) > 10
    assert kept == set(range(0, 120, 2)) | {i + 1 for i, s in zip(range(0, 120, 2), similar) if s < 0.8}


def test_copies_of_a_changed_text_and_unlike_members_of_a_bucket(spark):
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[:i] + ["x"] * 12 + words[i + 12:]) for i in range(0, 288, 16)]
    out = {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")).collect()}
    firsts = sorted({min(d for d in out if out[d] == g) for g in out.values()})
    assert all(jaccard(chain[a], chain[b]) < 0.8 for a in firsts for b in firsts if a < b)


def brute_groups(texts, least=0.8):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    at = list(range(len(texts)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links += 1
                at[top(i)] = top(j)
    return [top(i) for i in range(len(texts))], links


def star_texts(seed, centres, copies, words, changes):
    """Centres and copies with some words changed, so that copies are like their centre but not each other; in random order."""
    rnd, texts = random.Random(seed), []
    for c in range(centres):
        centre = [f"c{c}w{rnd.randrange(10_000)}" for _ in range(words)]
        texts.append(" ".join(centre))
        for _ in range(copies):
            copy = list(centre)
            for i in rnd.sample(range(words), changes):
                copy[i] = f"n{rnd.randrange(10**9)}"
            texts.append(" ".join(copy))
    rnd.shuffle(texts)
    return texts


def test_star_shaped_groups_keep_all_links(spark):
    texts = star_texts(1, 12, 40, 300, 5)
    want, links = brute_groups(texts)
    assert len(set(want)) == 12 and links < 600  # copies are hardly ever alike themselves
    got = {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == 12


def test_components_equal_brute_force(spark, docs):
    """Recall of the stage itself, on documents, chains of changed copies and stars."""
    texts = [r.text for r in docs.collect()] + star_texts(2, 6, 15, 200, 4)
    words = [f"w{i}" for i in range(300)]
    texts += [" ".join(words[:i] + [f"x{i}"] * 8 + words[i + 8:]) for i in range(0, 288, 8)]
    want, _ = brute_groups(texts)
    got = {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want))


def test_edges(edge, empty, crowded):
    out = one_of_each(crowded)
    assert out.columns == crowded.columns and out.count() == len({r.group for r in near_duplicates(edge).collect()})
    assert one_of_each(empty).count() == 0


def test_a_crowd_of_unlike_texts_makes_few_rows_and_loses_no_link(spark, monkeypatch):
    """Texts that share most buckets and are hardly ever alike: rows grow with their number, not its square; whatever the tiles, links stay."""
    rnd, base = random.Random(5), [f"w{i}" for i in range(250)]
    texts = []
    for _ in range(120):
        text = list(base)
        for i in rnd.sample(range(250), 8):
            text[i] = f"n{rnd.randrange(10**9)}"
        texts += [" ".join(text)] + [" ".join(text[:-3] + ["z", str(len(texts)), "y"])] * (len(texts) % 3 == 0)
    want, _ = brute_groups(texts)
    made, real = {}, shinglejoin.stored

    def counted(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(shinglejoin, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (1024, 40):
        made.clear()
        got = {r.doc_id: r.group for r in near_duplicates(df, tile_docs=tile).collect()}
        assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want))
        assert made["pairs"] < 2 * len(texts)


def test_forest_of_links_equals_brute_force():
    rnd = np.random.default_rng(4)
    for n, shared in ((3, 10), (70, 40), (200, 300)):
        base = np.arange(shared, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rnd.choice(base, rnd.integers(shared // 2, shared + 1), replace=False), rnd.integers(10**6, 10**6 + 50, 8).astype(np.uint64)])) for _ in range(n)]
        for sides in (np.zeros(n, int), np.arange(n) % 2):
            at = {(i, j) for i in range(n) for j in range(i) if sides.max() == 0 or sides[i] != sides[j]}
            alike = {(i, j) for i, j in at if (b := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - b) - 1e-9}
            a, b = shinglejoin._forest(sets, sides, 0.8)
            links = {(max(p), min(p)) for p in zip(a, b)}
            assert links <= alike and len(links) == len(a)
            group = list(range(n))
            for i, j in links:
                group = [group[j] if g == group[i] else g for g in group]
            assert all(group[i] == group[j] for i, j in alike)
            assert len(set(group)) == n - len(links)


def test_no_pair_of_a_small_bucket_is_left_out_before_its_sets_are_compared(spark):
    """Pairs of similarity 0.5 to 0.6 that share a band are found at that bound, though most of their smallest values differ."""
    rnd, texts = random.Random(8), []
    for c in range(150):
        text = [f"c{c}w{i}" for i in range(120)]
        copy = list(text)
        for i in (12, 36, 60, 84, 108, *([119] if c % 2 else [])):
            copy[i] = f"n{rnd.randrange(10**9)}"
        texts += [" ".join(text), " ".join(copy)]
    found = [shinglejoin.shingles(t, {}) for t in texts]
    bands = [shinglejoin.band_keys(shinglejoin.least_values(x)) for x in found]
    near = [i for i in range(0, 300, 2) if jaccard(texts[i], texts[i + 1]) >= 0.5 and set(bands[i]) & set(bands[i + 1])]
    assert len(near) > 30 and all(jaccard(texts[i], texts[i + 1]) < 0.7 for i in near)
    got = {r.doc_id: r.group for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=0.5).collect()}
    assert all(got[i] == got[i + 1] for i in near)
