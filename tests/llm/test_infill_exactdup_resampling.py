"""Fill-in-the-middle, exact duplicates and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from leadline.llm import exactdup, infill, resampling

SF = "/root/testdata/sf0.001"
CLASHES = ("form", "n", "output", "kept", "keep_id", "group_size", "_row", "_prefix", "_hash", "_bytes",
           "weight", "rank", "score", "buckets", "times", "_at", "_part", "restored_sha256")


@pytest.fixture(scope="module")
def clashing(odd):
    names = {c.lower() for c in odd.columns}
    return odd.withColumns({c: F.lit("x") for c in CLASHES if c not in names})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_texts(seed, n=400):
    rng = random.Random(seed)
    fixed = [None, "", "\n", "a\n", "\n\n\n", "no end", "holds <P> itself", "<S>", "x<M>", "<P", "P>\n<",
             "é\nü😀\n中文\n", "<\nP>\n<S\n>"]
    return fixed + ["".join(rng.choice(["a", "B7", " ", "\n", "é", "😀", "<", ">", "P", "\t", "\x0b", "\x00"])
                            for _ in range(rng.randrange(60))) for _ in range(n)]


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_infill_by_brute_force(spark):
    texts = random_texts(1)
    rows = infill.fill_in_middle(table_of(spark, texts), verify=True)
    back = {r["doc_id"]: r["text"] for r in infill.restore(rows).collect()}
    forms = Counter()
    for r in rows.collect():
        text = texts[r["doc_id"]] or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        digest = sha(f"7:{r['doc_id']}")
        h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
        low, high = sorted(x % (len(lines) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) else (
            "spm" if h[3] % 100 < 50 else "psm")
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sizes = (None, None) if form == "plain" else (len(p), len(m))
        assert (r["n"], r["form"], r["output"]) == (len(lines), form, want)
        assert (r["prefix_chars"], r["middle_chars"]) == sizes
        assert r["restored_sha256"] == sha(text) and back[r["doc_id"]] == text
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 5


def test_infill_shares_and_other_sentinels(spark):
    docs = table_of(spark, ["one\ntwo\nthree\n"] * 3000)
    how = infill.Infill(seed=3, cut_percent=30, spm_percent=80, prefix=b"[pre]", suffix=b"[suf]",
                        middle=b"[mid]")
    rows = infill.fill_in_middle(docs, how).collect()
    forms = Counter(r["form"] for r in rows)
    assert 0.25 < 1 - forms["plain"] / 3000 < 0.35
    assert 0.72 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.88
    assert all(r["text"] == "one\ntwo\nthree\n" for r in infill.restore(
        infill.fill_in_middle(docs, how), how).collect())
    with pytest.raises(ValueError):
        infill.Infill(prefix=b"<<P>")
    with pytest.raises(ValueError):
        infill.Infill(prefix=b"<S>")


def test_infill_on_odd_rows(clashing, odd):
    rows = infill.fill_in_middle(clashing, verify=True).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["form"] == by_id[3]["form"] == "plain" and by_id[2]["output"] == ""
    assert by_id[None]["restored_sha256"] == sha("a row without an id")
    assert infill.fill_in_middle(odd.selectExpr("concat('k', doc_id) as doc_id", "text")).count() == len(rows)


def groups_of(rows):
    found = defaultdict(list)
    for doc_id, text in rows:
        found[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return found


def test_exact_duplicates_by_brute_force(spark):
    texts = random_texts(2)
    texts += [re.sub(" ", "\t\n ", t) for t in texts if t] + ["a" * 70 + "x", "a" * 70 + "y"] * 3
    random.Random(3).shuffle(texts)
    want = groups_of(enumerate(texts))
    of = {i: g for g in want.values() for i in g}
    rows = exactdup.exact_duplicates(table_of(spark, texts), carry=["text"]).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        own = of[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
        assert r["text"] == texts[r["doc_id"]]


def test_exact_duplicates_with_hot_groups(spark):
    """A third of the rows is one text, another third has one length and prefix."""
    docs = spark.range(30000, numPartitions=16).selectExpr("id as doc_id", """CASE id % 3
        WHEN 0 THEN 'the very same text' WHEN 1 THEN concat(repeat('p', 80), lpad(cast(id div 2 as string), 9, '0'))
        ELSE concat('own text ', id) END as text""")
    rows = exactdup.exact_duplicates(docs)
    sizes = {r["group_size"]: r["n"] for r in rows.groupBy("group_size").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == {10000: 10000, 1: 20000} and rows.where("kept").count() == 20001
    tasks = [r["n"] for r in rows.where("group_size > 1").groupBy(F.spark_partition_id()).agg(
        F.count("*").alias("n")).collect()]
    assert sum(tasks) == 10000 and max(tasks) < 3000


def test_exact_duplicates_on_odd_rows(spark, clashing, odd):
    rows = exactdup.exact_duplicates(clashing.drop("kept", "keep_id", "group_size"), carry=["n_chars", "_row", "_hash"]).collect()
    assert len(rows) == odd.count() and rows[0]["_row"] == rows[0]["_hash"] == "x"
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 1) == [False, True]
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(2, 2)}
    assert exactdup.exact_duplicates(clashing).count() == odd.count()
    copies = spark.createDataFrame([(None, "t"), (None, "t"), (9, "t")], "doc_id bigint, text string")
    kept = exactdup.exact_duplicates(copies).where("kept").collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"]) for r in kept] == [(9, 9, 3)]
    with pytest.raises(ValueError):
        exactdup.exact_duplicates(clashing, carry=["kept"])


def brute_resample(docs, target, runs=1, buckets=10000, least=20, percent=10, seed=2024):
    def own(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs_ = [" ".join(found[k:k + n]) for n in range(1, runs + 1) for k in range(len(found) - n + 1)]
        return len(found), [zlib.crc32(x.encode()) % buckets for x in runs_]

    each = {i: own(t) for i, t in docs}
    s = Counter(b for _, f in each.values() for b in f)
    t = Counter(b for x in target for b in own(x)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
            for b in range(buckets)]
    found = {}
    for i, (n, f) in each.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{i}")[:8], 16)
        found[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    long_ = sorted((-v[2], i) for i, v in found.items() if each[i][0] >= least)
    for place, (_, i) in enumerate(long_[:len(long_) * percent // 100]):
        found[i][3] = place + 1
    return found


@pytest.mark.parametrize("runs, buckets, least, percent", [(1, 10000, 20, 10), (3, 500, 2, 50), (2, 97, 0, 100)])
def test_resampling_by_brute_force(spark, runs, buckets, least, percent):
    texts = random_texts(4, 500)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(10 ** 6 + k, t) for k, t in enumerate(texts)]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    rows = resampling.resample(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(t,) for t in target], "text string"), runs, buckets,
        least_words=least, percent=percent).collect()
    assert {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in rows} == brute_resample(
        docs, target, runs, buckets, least, percent)


def test_pieces_do_not_change_features():
    rng = random.Random(5)
    text = "".join(rng.choice(["Ab", "é", "中", " ", ".", "9", "😀", "\x7f"]) for _ in range(3000)).encode()
    for runs in (1, 2, 4):
        whole = resampling.features(text, runs)
        assert all(resampling.features(text, runs, size) == whole for size in (1, 7, 64, 1000))
    assert resampling.features(b"a" * 5000, 1, 100) == (1, Counter([b"a" * 5000]))


def test_ranking_over_many_ranges_and_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED_ROWS", 50)
    rows = spark.range(3000, numPartitions=7).selectExpr("cast(id % 3 as bigint) as score", "id as _row")
    got = resampling.ranked(rows, 3000, [F.desc("score"), F.asc("_row")]).collect()
    want = sorted(((r["score"], r["_row"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert {(r["score"], r["_row"]): r["rank"] for r in got} == {x: k + 1 for k, x in enumerate(want)}


def test_resampling_on_odd_rows(spark, clashing, odd, nothing):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = resampling.resample(clashing, target, least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, odd.count() + 1))
    assert {(r["n_features"], r["weight"]) for r in rows if r["doc_id"] in (2, 3, 5)} == {(0, 0)}
    assert resampling.resample(odd, target.limit(0)).count() == odd.count()
    assert all(r["rank"] is None for r in resampling.resample(odd, target, least_words=10 ** 9).collect())


def test_empty_tables(nothing, odd):
    assert infill.fill_in_middle(nothing).collect() == []
    assert infill.restore(infill.fill_in_middle(nothing)).collect() == []
    assert exactdup.exact_duplicates(nothing).collect() == []
    assert resampling.resample(nothing, nothing).collect() == []
