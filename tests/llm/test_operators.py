"""The operators against brute force, and on odd rows."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadline.llm import fingerprints as fp
from leadline.llm import neardup, pii, seeds, shards
from leadline.llm.components import components
from leadline.llm.langid import languages
from leadline.llm.packing import pack
from leadline.llm.quality import quality
from leadline.llm.skew import hot_join
from leadline.llm.tokencount import token_counts
from leadline.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
LABELS = "doc_id bigint, quality int, toxic int"


def docs_of(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def operators(spark):
    labels = docs_of(spark, "labels")
    items = docs_of(spark, "benchmark")
    return {
        "quality": lambda d: quality(d, labels), "toxicity": lambda d: toxicity(d, labels),
        "pack": lambda d: pack(d, public_tokenizers.path("word_bpe_49k.json")),
        "near": neardup.near_duplicates, "kept": neardup.drop_near_duplicates,
        "fingerprints": fp.fingerprints, "seeds": lambda d: seeds.contaminated(d, items),
        "clean": lambda d: seeds.drop_contaminated(d, items), "languages": languages,
        "shards": shards.shards, "pii": pii.personal_data, "redact": pii.redact,
        "tokens": lambda d: token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
    }


ONE_TO_ONE = {"quality", "toxicity", "near", "fingerprints", "languages", "shards", "pii",
              "redact", "tokens"}
NAMES = sorted(ONE_TO_ONE | {"pack", "kept", "seeds", "clean"})


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    rows = operators(spark)[name](odd).collect()
    if name in ONE_TO_ONE:
        assert len(rows) == odd.count()
    if name == "kept":  # the repeated row goes
        assert len(rows) == odd.count() - 1
    if name == "clean":
        assert len(rows) == odd.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, nothing, name):
    assert operators(spark)[name](nothing).collect() == []


def brute_spans(text):
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c)
                    for k, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    return [(k, a, b) for k, spans in found.items() for a, b in spans]


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE_KINDS]


def test_personal_data_by_patterns(spark):
    rng = random.Random(5)
    texts = [r["text"] or "" for r in docs_of(spark).collect()]
    texts += ["".join(rng.choice("01259.@+-() aé") for _ in range(rng.randrange(90)))
              for _ in range(6000)]
    for text in texts:
        assert base(text) == brute_spans(text), text


def test_redaction_leaves_nothing():
    assert pii.find(pii.redacted("a@b.cd 4111 1111 1111 1111 and 1.2.3.4")) == []


def test_token_counts_by_library(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = docs_of(spark)
    rows = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for row in rows:
        said = len(library.encode(texts[row["doc_id"]], add_special_tokens=False).ids)
        assert (row["n_tokens"], row["n_bytes"]) == (said, len(texts[row["doc_id"]].encode()))


def test_packing_holds_every_id_once(spark):
    import zlib

    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, docs = Tokenizer.from_file(path), docs_of(spark)
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
           for r in docs.collect()}
    pieces = pack(docs, path).toPandas()
    for doc_id, own in pieces.sort_values("start").groupby("doc_id"):
        assert own["length"].sum() == len(ids[doc_id])
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        for p in own.itertuples():
            part = np.array(ids[doc_id][p.start:p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
        assert own["length"].sum() <= 2048
    assert set(pieces["doc_id"]) == set(ids)


def test_shards_have_exact_sizes(spark):
    rows = shards.shards(docs_of(spark).union(docs_of(spark))).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_matrix_margins():
    drawn = shards.matrix([5, 0, 900, 17], [231, 231, 230, 230])
    assert [sum(r) for r in drawn] == [5, 0, 900, 17]
    assert [sum(c) for c in zip(*drawn)] == [231, 231, 230, 230]


def test_fingerprint_levels_by_brute_force():
    data = np.frombuffer(random.Random(2).randbytes(300) + b"a" * 200 + b"abc" * 90, np.uint8)
    found = fp.window_levels(data)
    for k in range(len(data) - 63):
        _, n = np.unique(data[k:k + 64], return_counts=True)
        assert found[k] == fp.level(np.array([fp.WEIGHT[n].sum()]))[0]


def test_fingerprints_follow_the_next_document(spark):
    docs = docs_of(spark)
    found = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    rank = fp.corpus_ranking(docs)
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        changed = fp.edited(text, other)
        assert found[doc_id]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        alone = fp.digests(pa.array([text, other], pa.large_string()), rank)
        assert found[doc_id]["fingerprint"] == fp.written(alone[0])
        assert found[doc_id]["near_next"] == pytest.approx(fp.likeness(*alone))


def test_every_two_substitutions_leave_a_seed():
    for lost in combinations(range(seeds.WINDOW), 2):
        assert any(all(o + k not in lost for k, c in enumerate(m) if c == "1")
                   for m in seeds.MASKS for o in range(seeds.WINDOW - len(m) + 1))


def test_seeds_by_brute_force():
    rng = random.Random(3)
    word = [f"w{k}" for k in range(300)]
    lines = [[rng.choice(word) for _ in range(n)] for n in (40, 13, 9, 4, 0)]
    texts = []
    for _ in range(150):
        text = [rng.choice(word) for _ in range(rng.randrange(60))]
        own = list(rng.choice(lines))
        for _ in range(rng.randrange(4)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(word)
        texts.append(text + own + text[:5])
    items = seeds.Items.of(list(range(5)), [" ".join(x) for x in lines])
    found = {(t, i) for t, i, *_ in items.search(pa.array([" ".join(x) for x in texts],
                                                         pa.large_string()))}
    want = set()
    for t, text in enumerate(texts):
        for i, own in enumerate(lines):
            w = min(13, len(own))
            need = 11 if w == 13 else w
            if len(own) >= seeds.LEAST and any(
                    sum(x == y for x, y in zip(own[a:a + w], text[b:b + w])) >= need
                    for a in range(len(own) - w + 1) for b in range(len(text) - w + 1)):
                want.add((t, i))
    assert found == want and want


def near_texts():
    rng = random.Random(4)
    word = [f"v{k}" for k in range(2000)]
    texts = []
    for _ in range(25):
        own = [rng.choice(word) for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(own))
        for edits in (0, 1, 1, 2, 3, 40):
            new = list(own)
            for _ in range(edits):
                new[rng.randrange(len(new))] = rng.choice(word)
            texts.append(" ".join(new))
    return texts


def test_near_duplicates_by_brute_force(spark):
    texts = near_texts()
    found = neardup.near_duplicates(spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string")).collect()
    own = neardup.grams(pa.array(texts, pa.large_string()))
    root = list(range(len(texts)))

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if neardup.alignment(own[a], own[b]):
            low, high = sorted((of(a), of(b)))
            root[high] = low
    assert {r["doc_id"]: r["class_id"] for r in found} == {k: of(k) for k in range(len(texts))}


def test_one_row_of_a_class_is_kept(spark):
    long_, other = " ".join(f"w{k}" for k in range(90)), " ".join(f"x{k}" for k in range(90))
    rows = [(1, long_), (1, long_), (2, long_ + " more"), (None, other), (7, other), (7, other), (None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["class_id"]), r["kept"]) for r in got) == [
        ("1", False), ("1", False), ("1", True), ("7", False), ("7", False), ("7", True), ("None", True)]
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(map(str, kept)) == ["1", "7", "None"]


def test_components_by_brute_force(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [
        (k, k + 1) for k in range(200, 240)]
    name = {k: k for pair in pairs for k in pair}
    for _ in range(len(name)):
        for a, b in pairs:
            name[a] = name[b] = min(name[a], name[b])
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in rows} == {
        k: v for k, v in name.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_hot_join_keeps_all_rows(spark):
    big = spark.range(20000).withColumn("k", F.when(F.col("id") % 2 == 0, 7).otherwise(
        F.col("id") % 50))
    small = spark.range(50).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert hot_join(big, small, "k").where("v = 2 * k").count() == 20000


def accuracy(rows, of, key="predicted"):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in of]
    return sum(r[key] == of[r["doc_id"]] for r in held) / len(held)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables hold too few labels to learn from
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    marks = labels.collect()
    assert accuracy(quality(docs, labels).collect(),
                    {r["doc_id"]: r["quality"] for r in marks}) > 0.9
    assert accuracy(toxicity(docs, labels).collect(),
                    {r["doc_id"]: r["toxic"] for r in marks}) > 0.9
    named = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null").collect()}
    assert accuracy(languages(docs).collect(), named, "lang_pred") > 0.99
