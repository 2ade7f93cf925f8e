"""Redaction of assigned secrets, and the pipeline by construction of its documents."""

import random
import signal
import threading
import zlib
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from leadline.llm import pii


@contextmanager
def ends_within(seconds):
    def stop(*_):
        raise TimeoutError(f"not ended after {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


HEX = "0123456789abcdef0123456789abcdef01234567"


@pytest.mark.parametrize("text, want", [
    (f'token = "{HEX}"', 'token = "<SECRET>"'),
    (f"password: {HEX}, next", "password: <SECRET>, next"),
    ("api_key=ann@mail.org;", "api_key=<EMAIL>;"),
    ("secret = +44 20 7946 0958", "secret = <PHONE>"),
    ("token=10.0.0.7 done", "token=<IP> done"),
    (f"token = {HEX[:9]} passwd: AKIA{'7' * 16}", "token = <SECRET> passwd: <SECRET>"),
    ("password = <EMAIL>realsecret", "password = <SECRET>"),
    ("password = <EMAIL><SECRET>", "password = <EMAIL><SECRET>"),
    ("password = <OTHER>", "password = <SECRET>"),
])
def test_assigned_secrets_are_taken_out_once(text, want):
    with ends_within(10):
        assert pii.redacted(text) == want
    assert pii.find(want) == []


def test_redaction_of_random_texts_ends_and_leaves_nothing():
    rng = random.Random(9)
    pieces = ["token", "password", "SECRET", "<SECRET>", "<EMAIL>", "<", ">", "=", ": ", " ", '"',
              "a@b.cd", "1.2.3.4", "+44 20 7946 0958", "://", "ab.c", "AKIA" + "X" * 16, "iban",
              "GB82WEST12345698765432", "account", "4111 1111 1111 1111", "xyz", "7", "\n", ";"]
    with ends_within(60):
        for _ in range(20000):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
            assert pii.find(pii.redacted(text)) == [], text


def documents():
    """(doc_id, text, toxic, text after redaction or None where a stage drops the document)."""
    rng = random.Random(12)
    word = [f"plain{k}" for k in range(4000)]
    vile = [f"vile{k}" for k in range(6)]
    passage = " ".join(f"item{k}" for k in range(30))
    rows = []
    for k in range(240):
        own = [rng.choice(word) for _ in range(120)]
        toxic, after = 0, True
        if k % 4 == 1:
            own, toxic, after = own + vile, 1, False
        elif k % 12 == 2:
            own, after = own[:40] + passage.split() + own[40:], False
        elif k % 12 == 3:  # a near copy of the document before the last
            own, after = rows[-3][1].split(), False
            own[50] = "other"
        text = want = " ".join(own)
        if k % 12 in (4, 6):
            text += f' token = "{HEX[k % 8:]}" end'
            want += ' token = "<SECRET>" end'
        rows.append((k, text, toxic, want if after else None))
    return rows, passage


def test_pipeline_by_construction(spark, tmp_path):
    from tokenizers import Tokenizer
    rows, passage = documents()
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t, *_ in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, toxic) for k, _, toxic, _ in rows],
                          "doc_id bigint, quality int, toxic int"
                          ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    late = threading.Timer(240, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    finally:
        late.cancel()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids + [1]
            for k, _, _, t in rows if t is not None}
    assert set(pieces["doc_id"]) == set(want)
    for doc_id, own in pieces.groupby("doc_id"):
        assert own["length"].sum() == len(want[doc_id])
        for p in own.itertuples():
            part = np.array(want[doc_id][p.start:p.start + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
