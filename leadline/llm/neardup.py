"""Near copies by order MinHash, verified by a banded alignment.

A text is its lower-case words; its grams are runs of five words, each labelled with how
often it occurred before. ``SKETCHES`` times the ``TAKEN`` grams with the smallest hash are
taken and put in the order of the text; texts that agree in one such tuple are candidates.
Two texts of similarity 0.8 whose common grams stand in one order agree in a tuple with
probability about 0.8**3, so all 16 tuples miss them with probability 1e-5.

Candidates are verified: the labelled grams of both are aligned within the band of offsets
that the threshold allows, and the longest common subsequence c gives c / (n1 + n2 - c).

A large bucket of equal tuples is never expanded into pairs. In a round every bucket has a few
pivots, and every node is compared with as many of those that are in another class. Only buckets that still hold several classes go on, as long as a round joins enough of its pairs.
That merges large classes with no more pairs in a round than there are nodes; the rest is
exact: buckets of at most ``SMALL`` nodes test all pairs of different classes, and the nodes of
the larger ones are joined on the rare ends of their gram sets (``_near_ends``). A pair of
different classes that can reach the threshold meets there and is aligned, a few for each node
first, unless others joined its classes; only bounds that hold for every such pair leave any
out. Equal texts are one node from the start.

Defined cases: a null text is a class of its own for each doc_id; texts with fewer than five
words have one gram of all words; texts without a word are near only to equal texts. Extra
columns are ignored. Repeated rows belong to one class; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadline.llm.components import components
from leadline.llm.skew import GROUP_ROWS, hot_join, narrow_join, parts
from leadline.llm.text import BASE, MIX, blocks, hashes, mix, words
from leadline.session import materialise

WORDS, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 16, 3
PIVOTS = 4  # pivots of a bucket, and pairs for a node, in every round but the first
SMALL = 16  # nodes of a bucket up to which all its pairs are tested
FRUITFUL = 50  # rounds go on while one of so many pairs is a link
EACH = 8  # pairs for a node that are tested before others are looked at again, and their growth
BLOCK = 1 << 19  # bytes of text worked on at a time
SLOTS = 1 << 22  # counters that tell rare grams from common ones; any number is right
BITS = 256  # of the outline of a set of grams; any multiple of 64 is right
SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * MIX)


def grams(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Occurrence-labelled hashes of the word runs of each text, in the order of the text."""
    data, starts, ends, first = words(texts)
    each = hashes(data, starts, ends)
    found = []
    for a, b in zip(first[:-1], first[1:]):
        n, own = min(size, b - a), each[a:b]
        if not n:
            found.append(np.zeros(0, np.uint64))
            continue
        count = b - a - n + 1
        value = np.zeros(count, np.uint64)
        for k in range(n):
            value = value * np.uint64(BASE) + own[k:k + count]
        order = np.argsort(value, kind="stable")
        line = value[order]
        new = np.append(True, line[1:] != line[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(count), 0))
        nth = np.empty(count, np.uint64)
        nth[order] = (np.arange(count) - start).astype(np.uint64)
        found.append(mix(value + nth * MIX))
    return found


def sketch(own: np.ndarray) -> list[int]:
    """One key for each tuple of smallest grams in the order of the text."""
    if not len(own):
        return []
    taken = min(TAKEN, len(own))
    line = mix(own[None, :] ^ SEEDS[:, None])
    at = np.argpartition(line, taken - 1, axis=1)[:, :taken]
    at.sort(axis=1)
    key = SEEDS.copy()
    for k in range(taken):
        key = mix(key * np.uint64(BASE) + own[at[:, k]])
    return key.view(np.int64).tolist()


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two gram sequences, or 0 where it is below ``least``."""
    total = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return 0.0
    band = int(total * (1 - least) / (1 + least) + 1e-9)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= band
    order = np.argsort(i[inside])
    line = j[inside][order]
    if len(line) < least * (total - len(line)) - 1e-9:
        return 0.0
    if (np.diff(line) > 0).all():
        common = len(line)
    else:  # longest increasing run of partners
        tails: list[int] = []
        for place in line.tolist():
            at = bisect_left(tails, place)
            tails[at:at + 1] = [place]
        common = len(tails)
    similarity = common / (total - common)
    return similarity if similarity >= least - 1e-9 else 0.0


def _node(docs: DataFrame):
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.concat(
        F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, keys and number of grams of every row."""

    def keys(batches):
        for batch in batches:
            for rows, texts in blocks(batch, "text", BLOCK):
                each = grams(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1),
                     pa.array([sketch(g) for g in each], pa.list_(pa.int64())),
                     pa.array([len(g) for g in each], pa.int32())],
                    names=["doc_id", "node", "keys", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", _node(docs).alias("node"), "text").mapInArrow(
        keys, f"doc_id {kind}, node string, keys array<bigint>, n int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes that align, with their similarity."""
    kind = dict(pairs.dtypes)["a"]
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), "a")
    both = hot_join(left, texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b", pairs)

    def align(batches):
        for batch in batches:
            for rows, one in blocks(batch, "_ta", BLOCK):
                other = rows.column(rows.schema.get_field_index("_tb"))
                coded = other.dictionary_encode()
                known = grams(coded.dictionary.cast(pa.large_string()))
                score = [alignment(g, known[k]) for g, k in zip(
                    grams(one), coded.indices.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(score, pa.float64())],
                    names=["a", "b", "similarity"])

    return both.select("a", "b", "_ta", "_tb").mapInArrow(
        align, f"a {kind}, b {kind}, similarity double").where("similarity > 0")


def _gram_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold a gram of each slot, so no fewer than hold any one of its grams."""

    def count(batches):
        found = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for _, part in blocks(batch, "text", BLOCK):
                for own in grams(part):
                    np.add.at(found, (own % np.uint64(SLOTS)).astype(np.int64), 1)
        at = np.flatnonzero(found)
        for k in range(0, len(at), 1 << 16):
            part = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(found[part].astype(np.int64))], names=["slot", "n"])

    # SLOTS short rows at most
    rows = texts.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    found = np.zeros(SLOTS, np.int32)   # capped at its greatest number, which only orders grams
    found[rows.column("slot").to_numpy()] = np.minimum(
        rows.column("n").to_numpy(), np.iinfo(np.int32).max)
    return found


def outlines(own: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of words for each place of ``at``: the parity of the grams in each of ``BITS`` slots,
    without the grams that come before that place in ``order``.

    Two sets differ in at least as many grams as their outlines differ in bits.
    """
    slot = (mix(own) % np.uint64(BITS)).astype(np.int64)
    gone, now = slot[order], (np.bincount(slot, minlength=BITS) & 1).astype(np.uint8)
    found = [np.zeros((0, BITS // 64), np.int64)]
    for k in range(0, len(order), 4096):   # places of a long text in portions
        part = gone[k:k + 4096]
        odd = np.zeros((len(part) + 1, BITS), np.uint8)
        odd[0] = now
        odd[np.arange(len(part)) + 1, part] = 1
        odd = np.cumsum(odd, axis=0, dtype=np.uint8) & 1
        here = at[(at >= k) & (at < k + 4096)] - k
        found.append(np.packbits(odd[here], axis=1).view(np.int64))
        now = odd[-1]
    return np.concatenate(found)


def rare_end(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, grams and outlines of the prefix of ``own``, in one order of all grams with rare
    ones first. An outline is that of the grams from the place on.

    A text of n grams and one of m <= n have SIMILARITY only if they share SIMILARITY * n
    grams, so the first one they share is among the first n - SIMILARITY * n + 1. Grams that
    no other text holds are left out.
    """
    often = counts[(own % np.uint64(SLOTS)).astype(np.int64)]
    order = np.lexsort((own, often))[:len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-6)) + 1]
    at = np.flatnonzero(often[order] > 1)
    return at, own[order[at]], outlines(own, order, at)


def _near_ends(texts: DataFrame) -> DataFrame:
    """Pairs a, b with their roots ra, rb that differ, of the stored node, root, text.

    Every pair with SIMILARITY is there. It is met at the first gram that both share in the
    order of ``rare_end``; what follows on either side bounds what they can have in common,
    and the shorter text needs a shorter prefix. Of n and m grams that follow, of which the
    outlines tell d apart at least, no more than (n + m - d) / 2 are common.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_gram_counts(texts))
    kind = dict(texts.dtypes)["node"]
    bits = [f"bits{k}" for k in range(BITS // 64)]

    def ends(batches):
        counts = shared.value
        for batch in batches:
            for rows, part in blocks(batch, "text", BLOCK):
                each = grams(part)
                found = [rare_end(own, counts) for own in each]
                size = np.array([len(at) for at, *_ in found], np.int64)
                outline = np.concatenate(
                    [np.zeros((0, len(bits)), np.int64), *(lines for *_, lines in found)])
                of = pa.array(np.repeat(np.arange(len(found)), size))
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(of), rows.column(1).take(of),
                     pa.array(np.repeat([len(own) for own in each], size).astype(np.int64)),
                     pa.array(np.concatenate([empty, *(at for at, *_ in found)])),
                     pa.array(np.concatenate([empty, *(g.view(np.int64) for _, g, _ in found)])),
                     *(pa.array(np.ascontiguousarray(line)) for line in outline.T)],
                    names=["node", "root", "n", "place", "gram", *bits])

    entries = materialise(texts.select("node", "root", "text").mapInArrow(
        ends, f"node {kind}, root {kind}, n bigint, place bigint, gram bigint, "
        + ", ".join(f"{b} bigint" for b in bits)))
    several = entries.groupBy("gram").agg(F.min("root").alias("_low"), F.max("root").alias(
        "_high")).where("_low != _high").select("gram")
    total = entries.count()
    entries = materialise(narrow_join(entries, several, "gram", total))
    share = SIMILARITY / (1 + SIMILARITY)
    apart = " + ".join(f"bit_count(s.{b} ^ l.{b})" for b in bits)
    short = entries.where(F.col("n") - F.col("place") >= 2 * share * F.col("n") - 1e-6)
    return short.alias("s").join(entries.alias("l"), F.expr(f"""
        s.gram = l.gram AND s.root != l.root AND (s.n < l.n OR s.n = l.n AND s.node < l.node)
        AND s.n >= {SIMILARITY}D * l.n - 1e-6D
        AND least(s.n - s.place, l.n - l.place) >= {share}D * (s.n + l.n) - 1e-6D
        AND s.n - s.place + l.n - l.place - ({apart}) >= {2 * share}D * (s.n + l.n) - 1e-6D""")).select(
        F.col("s.node").alias("a"), F.col("l.node").alias("b"),
        F.col("s.root").alias("ra"), F.col("l.root").alias("rb")).distinct()


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: (doc_id, node, _row) of every row, (node, _first, _row) of every node with
    its smallest doc_id and one row that has it, and (_row, root) of every node that shares a
    bucket with another one. A node goes by the number of that row from here on.
    """
    seen = materialise(_sketches(docs).withColumn("_row", F.monotonically_increasing_id()))
    nodes = seen.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row")).alias("_s"),
        F.first("keys").alias("keys"), F.first("n").alias("n"))
    nodes = materialise(nodes.select("node", F.col("_s.doc_id").alias("_first"),
                                     F.col("_s._row").alias("_row"), "keys", "n"))
    every = materialise(nodes.select(
        F.col("_row").alias("node"), "n", F.posexplode("keys").alias("_band", "_key")).select(
        "node", "n", F.xxhash64("_band", "_key").alias("bucket")))
    crowded = materialise(every.groupBy("bucket").agg(
        F.min("node").alias("_low"), F.max("node").alias("_high"), F.count(F.lit(1)).alias("_n")
    ).where("_low != _high").select("bucket", "_n"))
    buckets = materialise(narrow_join(
        every, crowded.select("bucket"), "bucket", every.count(), sizes=crowded))
    rows = buckets.count()
    labels = materialise(buckets.select("node").distinct().select(
        "node", F.col("node").alias("root")))
    if not rows:
        return seen.select("doc_id", "node", "_row"), nodes.select("node", "_first", "_row"), \
            labels.withColumnRenamed("node", "_row")
    own = _texts(docs, labels.join(nodes.withColumnRenamed("node", "_node"), F.col(
        "node") == F.col("_row")).select("node", "_node", "_first"))
    own = materialise(own)   # texts of these nodes, one row each
    tested, turn = None, 0
    while True:
        each = PIVOTS if turn else 1
        buckets = _open(buckets, labels, turn, each)
        pairs = _untested(buckets.select("node", "root", "n", F.explode("pivots").alias("p")).where(
            "root != p.root").select(
            F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("root").alias("ra"),
            F.col("p.root").alias("rb"), "n", F.col("p.n").alias("m")).distinct(), tested)
        near = Window.partitionBy("a").orderBy(F.xxhash64("b", F.lit(turn)), "b")
        pairs = materialise(pairs.withColumn("_turn", F.row_number().over(near)).where(
            F.col("_turn") <= each).select("a", "b", "ra", "rb").coalesce(parts(rows)))
        labels, tested, links = _tested(pairs, own, labels, tested, rows)
        if links * FRUITFUL <= pairs.count():
            break
        turn += 1
    few = _open(buckets, labels).where(F.col("_n") <= SMALL).drop("pivots")
    pairs = few.alias("s").join(few.alias("l"), F.expr(
        "s.bucket = l.bucket AND s.root < l.root")).select(
        F.col("s.node").alias("a"), F.col("l.node").alias("b"), F.col("s.root").alias("ra"),
        F.col("l.root").alias("rb"), F.col("s.n").alias("n"), F.col("l.n").alias("m"))
    pairs = materialise(_untested(pairs.distinct(), tested).select("a", "b", "ra", "rb"))
    labels, tested, _ = _tested(pairs, own, labels, tested, rows)
    rest = materialise(_open(buckets, labels).where(F.col("_n") > SMALL).select(
        "node", "root").distinct())
    if not rest.isEmpty():
        texts = materialise(narrow_join(own, rest, "node", rows).select("node", "root", "text"))
        pairs, each = materialise(_without(_near_ends(texts), tested)), EACH
        while not pairs.isEmpty():
            some = materialise(_some(pairs, labels, each, rest.count()))
            labels, tested, _ = _tested(some, own, labels, tested, rows)
            pairs = materialise(_apart(pairs.join(some.select("a", "b"), ["a", "b"], "left_anti"), labels))
            each *= EACH
    return seen.select("doc_id", "node", "_row"), nodes.select("node", "_first", "_row"), \
        labels.withColumnRenamed("node", "_row")


def _open(buckets: DataFrame, labels: DataFrame, turn: int = 0, each: int = 1) -> DataFrame:
    """The stored rows (node, n, bucket) of buckets with several classes, with their root, the
    pivots of their bucket in this turn (node, root, n), and its number of nodes."""
    first = [F.min(F.struct(F.xxhash64("node", F.lit(f"{turn} {k}")).alias("at"), "node", "root",
                            "n")).alias(f"p{k}") for k in range(each)]
    pivots = F.array_distinct(F.array(*[F.struct(*[F.col(f"p{k}.{c}").alias(c) for c in (
        "node", "root", "n")]) for k in range(each)])).alias("pivots")
    now = buckets.select("node", "n", "bucket").join(labels, "node")
    sizes = materialise(now.groupBy("bucket").agg(
        *first, F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_n")
    ).where(f"_low != _high OR _n >= {GROUP_ROWS}"))   # a large bucket of one class is a hot key, too
    several = sizes.where("_low != _high").select("bucket", pivots, "_n")
    return materialise(narrow_join(now, several, "bucket", buckets.count(), sizes=sizes))


def _some(pairs: DataFrame, labels: DataFrame, each: int, nodes: int) -> DataFrame:
    """``each`` of the pairs for a node, on the side of the smaller class; all if they are few."""
    if pairs.count() <= each * nodes:
        return pairs
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.join(sizes.select(F.col("root").alias("ra"), F.col("_n").alias("_na")), "ra").join(
        sizes.select(F.col("root").alias("rb"), F.col("_n").alias("_nb")), "rb")
    both = both.withColumn("_own", F.expr("IF(_na < _nb OR _na = _nb AND ra < rb, a, b)"))
    turn = F.row_number().over(Window.partitionBy("_own").orderBy(F.xxhash64("a", "b")))
    return both.withColumn("_turn", turn).where(F.col("_turn") <= each).select("a", "b", "ra", "rb")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different classes, with the roots they have now."""
    of = [labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    return pairs.select("a", "b").join(of[0], "a").join(of[1], "b").where("ra != rb")


def _without(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    if tested is None:
        return pairs
    known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(known, ["a", "b"], "left_anti")


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs with ``n`` and ``m`` grams that can align and were not compared before."""
    return _without(pairs.where(F.expr(
        f"least(n, m) >= {SIMILARITY}D * greatest(n, m) - 1e-9D")), tested)


def _tested(pairs: DataFrame, own: DataFrame, labels: DataFrame, tested: DataFrame | None,
            rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The labels and the tested pairs after the stored ``pairs``, and how many were links."""
    if pairs.isEmpty():
        return labels, tested, 0
    ends = pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct()
    new = materialise(verified(pairs.select("a", "b"), narrow_join(own, ends, "node", rows)))
    once, links = pairs.select("a", "b"), new.count()
    tested = once if tested is None else tested.unionByName(once)
    return _joined(labels, new, pairs, rows) if links else labels, tested, links


def _joined(labels: DataFrame, new: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """The labels after the links ``new``; classes known before are single nodes here."""
    links = new.select("a", "b").join(pairs, ["a", "b"]).select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    joined = components(links, rows).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return materialise(narrow_join(labels, joined, "root", rows, "left").select(
        "node", F.coalesce("_to", "root").alias("root")).coalesce(parts(rows)))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes (node, _node, _first), read from rows of the first doc_id."""
    marked = docs.where(F.col("text").isNotNull()).select("doc_id", _node(docs).alias("_mark"), "text")
    return marked.join(wanted, (F.col("_mark") == F.col("_node")) & F.col("doc_id").eqNullSafe(
        F.col("_first"))).groupBy("node").agg(F.first("text").alias("text"))


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows, and (node, _first, _row, root) of every node."""
    seen, nodes, labels = near_classes(docs)
    return seen, materialise(nodes.join(labels, "_row", "left").withColumn(
        "root", F.coalesce("root", "_row")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept of every row; the class is named by its smallest doc_id.

    One row of a class is kept: one with that id, whatever repeats.
    """
    seen, nodes = _rooted(docs)
    named = nodes.groupBy("root").agg(F.min(F.struct(
        F.col("_first").isNull().alias("_none"), "_first", "_row")).alias("_s")).select(
        "root", F.col("_s._first").alias("class_id"), F.col("_s._row").alias("_stays"))
    of = narrow_join(nodes.select("node", "root"), named, "root", nodes.count()).select(
        "node", "class_id", "_stays")
    return narrow_join(seen, materialise(of), "node", seen.count()).select(
        "doc_id", "class_id", (F.col("_row") == F.col("_stays")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with all columns."""
    _, nodes = _rooted(docs)
    stay = nodes.groupBy("root").agg(F.min(F.struct(
        F.col("_first").isNull().alias("_none"), "_first", "node")).alias("s")).select(
        F.col("s._first").alias("_first"), F.col("s.node").alias("_node"))
    marked = docs.select("doc_id", _node(docs).alias("_node"), F.struct(*docs.columns).alias("_doc"))
    kept = marked.join(stay, (F.col("doc_id").eqNullSafe(F.col("_first")))
                       & (marked["_node"] == stay["_node"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_node"]).select("_doc.*")
