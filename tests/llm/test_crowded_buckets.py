"""Near pairs among pages of one template, which share most of their buckets with all others."""

import random
from itertools import combinations

import pyarrow as pa

from leadline.llm import neardup

PAGES, PAIRS = 2500, 40


def pages():
    """Pages that are 0.77 alike by their template, 40 pairs of them 0.82."""
    rng = random.Random(8)
    template = [f"t{rng.randrange(10 ** 9)}" for _ in range(348)]
    texts = []
    for k in range(PAGES):
        own = [f"o{rng.randrange(10 ** 9)}" for _ in range(52)]
        if PAGES // 2 <= k < PAGES // 2 + PAIRS:
            own[:12] = texts[k - PAGES // 2].split()[348:360]
        texts.append(" ".join(template + own))
    return texts


def test_every_near_pair_of_a_template(spark):
    texts = pages()
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string").repartition(8)).collect()}
    assert found == {k: k - PAGES // 2 if PAGES // 2 <= k < PAGES // 2 + PAIRS else k
                     for k in range(PAGES)}


def test_rare_ends_meet_every_near_pair(spark):
    """All pairs by brute force, of texts with copies cut short, moved and changed."""
    rng = random.Random(14)
    word = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(word) for _ in range(rng.randrange(1, 70))]
        for _ in range(8):
            new = base[rng.randrange(1 + len(base) // 12):]
            for _ in range(rng.randrange(3)):
                new[rng.randrange(len(new))] = rng.choice(word)
            texts.append(" ".join(new + base[:rng.randrange(3)]))
    texts = sorted(set(texts))
    own = neardup.grams(pa.array(texts, pa.large_string()))
    want = {(a, b) for a, b in combinations(range(len(texts)), 2)
            if neardup.alignment(own[a], own[b])}
    rows = spark.createDataFrame(
        [(f"{k:04}", f"{k:04}", t) for k, t in enumerate(texts)],
        "node string, root string, text string")
    pairs = [tuple(sorted((int(r["a"]), int(r["b"])))) for r in neardup._near_ends(rows).collect()]
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and want
    assert len(pairs) < len(texts) * (len(texts) - 1) // 2


def test_pairs_of_a_round_follow_the_nodes(spark, monkeypatch):
    """Pages with half of their words in common beside near copies: the right classes, few pairs."""
    rng = random.Random(21)

    def fresh(n):
        return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]

    line, base, texts = fresh(60), fresh(300), []
    for k in range(400):
        new = line + fresh(60) if k % 4 else list(base)
        if not k % 4:
            for at in rng.sample(range(300), rng.randrange(1, 4)):
                new[at] = fresh(1)[0]
        texts.append(" ".join(new))
    compared, aligned = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, own: (
        compared.append(pairs.count()), aligned(pairs, own))[1])
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string").repartition(8)).collect()}
    own = neardup.grams(pa.array(texts, pa.large_string()))
    want = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if neardup.alignment(own[a], own[b]):
            low, high = sorted((want[a], want[b]))
            want = [low if c == high else c for c in want]
    assert found == dict(enumerate(want)) and len(set(want)) < 310
    assert max(compared) <= neardup.PIVOTS * len(texts)


def test_rare_ends_leave_out_what_outlines_tell_apart(spark):
    """Copies of one text with two words of their own: 0.71 alike, so few of them may meet."""
    rng = random.Random(5)
    base, texts = [f"b{k}" for k in range(120)], []
    for k in range(300):
        new = list(base)
        for at in rng.sample(range(5, 115), 2):
            new[at] = f"o{rng.randrange(10 ** 9)}"
        texts.append(" ".join(new))
    own = neardup.grams(pa.array(texts, pa.large_string()))
    want = {(a, b) for a, b in combinations(range(len(texts)), 2)
            if neardup.alignment(own[a], own[b])}
    rows = spark.createDataFrame(
        [(f"{k:04}", f"{k:04}", t) for k, t in enumerate(texts)],
        "node string, root string, text string")
    pairs = {tuple(sorted((int(r["a"]), int(r["b"])))) for r in neardup._near_ends(rows).collect()}
    assert want <= pairs and want
    assert len(pairs) < 2 * len(want)
