"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words (all words of a shorter document). Its weight is its count times its idf, from exact document frequencies over
the whole corpus. Samples of the weighted sets are banded; documents of a bucket are compared with
its leader by weighted Jaccard similarity, which never lists the pairs of a large group. Where that leaves a bucket in several
classes, every two documents of different classes are compared by their samples, block by block in a large bucket, and by whole texts
where the samples allow a link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..storage import materialise, settled
from .blocks import SCHEMA, U64, Block, Sizes, answered, blocked, each_block, mix, reply, send
from .blocks import rows as request_rows
from .common import bounded_batches, fresh, keyed
from .words import Windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Buckets of up to so many documents are joined pair by pair; larger ones are compared in blocks of about so many, or of so many words.
SMALL, BLOCK, WORDS = 32, 1024, 1 << 20
#: Of pairs at the threshold, 4 in 100,000 share fewer of their 48 samples; fewer than banding itself misses.
ALIKE = 28
#: How much more than a shingle of all documents one of a single document weighs.
IDF = 1.0
#: Document frequencies are kept as so many steps for each doubling, in a byte.
STEPS = 8
_SEEDS = np.random.default_rng(971).integers(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(U64) | U64(1)


def all_shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, how often each comes, and its text."""
    w = Windows(texts)
    n = np.bincount(w.doc, minlength=len(texts))
    h, doc = [], []
    for length in range(1, size + 1):  # a text of fewer words is one shingle
        w.grow(length)
        at = w.all() if length == size else np.flatnonzero((n[w.doc] == length) & (np.diff(w.doc, prepend=-1) > 0))
        h.append(w.hash[0][at])
        doc.append(w.doc[at])
    h, doc = np.concatenate(h), np.concatenate(doc)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)])
    return h[start], np.diff([*start, len(h)]), doc[start]


def shingles(raw: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each comes."""
    return all_shingles([raw], size)[:2]


def steps_of(frequency: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.log2(frequency) * STEPS), 255).astype(np.uint8)


class Idf:
    """1 + IDF ln((1 + documents) / (1 + frequency)) / ln(1 + documents), by the steps of the frequency."""

    def __init__(self, documents: int):
        n = max(documents, 1)
        self.table = (1 + IDF * np.log((1 + n) / (1 + np.minimum(2.0 ** (np.arange(256) / STEPS), n))) / np.log(1 + n)).astype(np.float32)

    def weigh(self, steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) * self.table[steps]

    def features(self, packed: list[bytes], steps: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Shingles of packed texts with their weights."""
        if not packed:
            return []
        h, counts, doc = all_shingles([zstandard.decompress(p) for p in packed])
        w, ends = self.weigh(np.frombuffer(b"".join(steps), np.uint8), counts), np.cumsum(np.bincount(doc, minlength=len(packed)))
        return [(h[a:b], w[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (hashes in order, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    low = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / total if total else 0.0


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low


_tables: list[np.ndarray] = []


def samples(h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, a row for each document; ``first`` is where each one's (at least one) shingles begin.

    For each sample a shingle draws r and c from gamma(2, 1) and b uniformly; t = floor(ln w / r + b), and the least
    ln c - r (t - b + 1) wins. The sample is the winner with its t.
    """
    if not _tables:
        q = _gamma_quantiles()
        _tables.extend([q.astype(np.float32), np.log(q).astype(np.float32)])
    gamma, log_gamma = _tables
    lw, index = np.log(w).astype(np.float32), np.arange(len(h), dtype=np.int64)
    out = np.zeros((len(first), len(_SEEDS)), U64)
    for k, seed in enumerate(_SEEDS):
        z = (h ^ seed) * U64(0xD6E8FEB86659FD93)
        z ^= z >> U64(32)
        z *= U64(0xD6E8FEB86659FD93)
        z ^= z >> U64(32)
        part = z.view(np.uint16).reshape(-1, 4)
        r, log_c = gamma[part[:, 0]], log_gamma[part[:, 1]]
        b = part[:, 2].astype(np.float32) * np.float32(2**-16)
        t = np.floor(lw / r + b)
        a = (log_c - r * (t - b + 1)).astype(np.float32).view(np.int32)
        order = ((a ^ ((a >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32) | index
        win = np.minimum.reduceat(order, first) & 0xFFFFFFFF
        out[:, k] = mix(h[win] ^ (t[win].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)) ^ seed)
    return out


def node_of(raw: bytes) -> str | None:
    """One name for all texts of the same words; none without words."""
    words = raw.split()
    return hashlib.md5(b" ".join(words)).hexdigest() if words else None


def _frequencies(blocks: DataFrame, sizes: Sizes) -> DataFrame:
    """For each block the steps of the document frequencies, over all documents, of its distinct shingles."""

    def run(batches):
        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                keys, counts = np.unique(all_shingles(Block(packed).texts)[0], return_counts=True)
                yield request_rows(list(send(number, keys, counts, sizes.bits)))

    return materialise(answered(blocks.mapInArrow(run, SCHEMA), sizes, lambda total, count: steps_of(total)), "frequencies")


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("node", pa.string()), ("weight", pa.float64()), ("bands", pa.list_(pa.int64())), ("sample", pa.list_(pa.int16())), ("text", pa.binary()), ("steps", pa.binary())])


def _signatures(blocks: DataFrame, frequencies: DataFrame, sizes: Sizes, idf: Idf) -> DataFrame:
    """doc_id, node, and for documents with words their weight, the bands, two bytes of every sample, the text and its shingles' steps."""

    def run(number: int, block: Block, known: pa.Table) -> pa.Table:
        nodes = [node_of(t) for t in block.texts]
        h, counts, doc = all_shingles(block.texts)
        own = reply(known)[np.unique(h, return_inverse=True)[1]]
        weights = idf.weigh(own, counts)
        columns: list[list] = [[None] * len(nodes) for _ in range(5)]
        first = np.flatnonzero(np.diff(doc, prepend=-1) > 0)
        ends = np.append(first[1:], len(doc))
        at = 0
        while at < len(first):  # some ten thousand shingles at a time, or a document
            to = max(at + 1, int(np.searchsorted(ends, first[at] + (1 << 16), "right")))
            part = slice(int(first[at]), int(ends[to - 1]))
            s = samples(h[part], weights[part], first[at:to] - first[at])
            b = np.zeros((to - at, BANDS), U64)
            for j in range(ROWS):
                b = mix(b ^ s[:, j::ROWS]) + U64(j)
            sums = np.add.reduceat(weights[part].astype(np.float64), first[at:to] - first[at]).tolist()
            for k, weight, band, short in zip(range(at, to), sums, b.view(np.int64).tolist(), s.view(np.int16)[:, ::4].tolist(), strict=True):
                i = int(doc[first[k]])
                for column, value in zip(columns, (weight, band, short, zstandard.compress(block.texts[i], 1), own[first[k] : ends[k]].tobytes()), strict=True):
                    column[i] = value
            at = to
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((block.doc_ids(), nodes, *columns), _SIGNATURE, strict=True)], schema=_SIGNATURE)

    return each_block(blocks, frequencies, sizes, run, "doc_id long, node string, weight double, bands array<long>, sample array<short>, text binary, steps binary")


def _texts(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text, steps) for each of ``needed`` (node, doc_id)."""
    one = needed.select(F.col("node").alias("n"), F.col("doc_id").alias("d")).hint("merge")  # the same plan at every size
    return rows.join(one, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("node", "text", "steps").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """The pairs (a, b) with a column ``linked``. Each text of a batch is taken apart once."""

    def run(batches):
        for batch in batches:
            texts = {}
            for n in "ab":
                texts.update(zip(batch.column(n).to_pylist(), zip(batch.column(f"t{n}").to_pylist(), batch.column(f"s{n}").to_pylist(), strict=True), strict=True))
            own = dict(zip(texts, idf.features(*map(list, zip(*texts.values(), strict=True))), strict=True)) if texts else {}
            linked = [similarity(own[a], own[b]) >= threshold for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    of = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"), F.col("steps").alias(f"s{n}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "sa", "tb", "sb")
    return materialise(both.mapInArrow(run, "a string, b string, linked boolean"), "links")


def _keys(bands, weight, threshold: float):
    """Bucket keys of a document: each band with the class of its weight and the next class.

    Sets whose similarity reaches the threshold have weights within that ratio, so their classes are equal or adjoining and they
    share a key for every band that they share; documents of other weights, such as those that share a passage, do not meet.
    """
    size = F.floor(F.log(weight) / float(np.log(1 / (threshold - 1e-3))))
    of = lambda b, i: F.array(F.xxhash64(b, i, size), F.xxhash64(b, i, size + 1))
    return F.flatten(F.transform(bands, of))


def _block_links(rows: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links (a, b) in buckets, enough to join what belongs together, from (key, p, bulk, node, c, weight, sample, bands, text, steps).

    The members of a bucket's class ``bulk`` and the rest are dealt to blocks; every block of the rest is compared with every
    block, so no pair is left out, and members of the bulk, which are of one class, are not compared with each other. ``p`` is the
    key's place among those of its document: a pair is compared only in the bucket of the first band that it shares, and not
    at all once links have joined its classes.
    """
    rows = materialise(rows.withColumn("rest", F.col("c") != F.col("bulk")).drop("bulk"), "large")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("weight") / WORDS))
    sizes = rows.groupBy("key", "rest").agg(blocks.alias("n")).groupBy("key").agg(F.max(F.when(F.col("rest"), F.col("n"))).alias("nr"), F.max(F.when(~F.col("rest"), F.col("n"))).alias("nm"))
    own = rows.join(sizes, "key").withColumn("x", F.expr("pmod(xxhash64(node, 'block'), if(rest, nr, nm))"))
    meets = F.expr("""
      if(rest, concat(
          transform(sequence(0L, nr - 1), y -> named_struct('i', least(x, y), 'j', greatest(x, y), 'side', y < x)),
          transform(sequence(0L, nm - 1), z -> named_struct('i', -1 - z, 'j', x, 'side', true))),
        transform(sequence(0L, nr - 1), y -> named_struct('i', -1 - x, 'j', y, 'side', false)))""")

    def compare(table: pa.Table) -> pa.Table:
        column = lambda n: table.column(n).combine_chunks()
        code = column("c").dictionary_encode().indices.to_numpy()
        w, p, side = column("weight").to_numpy(), column("p").to_numpy(), column("side").to_numpy(zero_copy_only=False)
        s, bands = (column(n).flatten().to_numpy().reshape(len(w), -1) for n in ("sample", "bands"))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = (np.arange(len(w)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
        pairs = []
        for at, i in enumerate(left):
            to = right[at + 1 :] if same else right
            to = to[(code[to] != code[i]) & (np.minimum(w[to], w[i]) >= np.maximum(w[to], w[i]) * (threshold - 1e-6)) & ((p[to] & p[i] & 1) == 0)]
            alike = (s[to] == s[i]).sum(1)
            to, alike = to[alike >= ALIKE], alike[alike >= ALIKE]
            first = (bands[to] == bands[i]).argmax(1) == p[i] >> 1
            pairs.append(np.stack([np.full(first.sum(), i), to[first], alike[first]]))
        pairs = np.concatenate(pairs, axis=1)
        parent, found = list(range(int(code.max()) + 1)), []
        some = np.unique(pairs[:2])
        features = dict(zip(some.tolist(), idf.features([column("text")[int(i)].as_py() for i in some], [column("steps")[int(i)].as_py() for i in some]), strict=True))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j, _ in pairs[:, np.argsort(-pairs[2], kind="stable")].T.tolist():  # likely links first
            x, y = root(code[i]), root(code[j])
            if x != y and similarity(features[i], features[j]) >= threshold:
                parent[x] = y
                found.append((i, j))
        node = column("node")
        return pa.table({n: node.take(pa.array([f[k] for f in found], pa.int64())) for k, n in enumerate("ab")})

    met = own.select("*", F.explode(meets).alias("m")).select("key", "m.i", "m.j", "m.side", "p", "node", "c", "weight", "sample", "bands", "text", "steps")
    return materialise(met.groupBy("key", "i", "j").applyInArrow(compare, "a string, b string"), "links")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id for every row of ``docs``: the least doc_id that it is linked to, directly or through others.

    Two documents are linked if they share a bucket of samples and their weighted Jaccard similarity is at least ``threshold``, or
    have the same words, however large the bucket. Null texts and texts without words are classes of their own. A class takes the
    least of its ids that are not null; repeated rows each get their row; other columns are ignored and an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = keyed(docs, "doc_id", "text", doc_id="long")
    sizes = Sizes(docs)
    idf, blocks = Idf(sizes.documents), blocked(docs, sizes)
    rows = materialise(_signatures(blocks, _frequencies(blocks, sizes), sizes, idf), "signatures")
    first_of = lambda *names: [F.first(n).alias(n) for n in names]  # noqa: E731  the same in all rows of a node
    nodes = materialise(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *first_of("weight", "bands", "sample")), "nodes")
    # the leader is the member of least id: copies tend to follow their original, and an original is nearest to all its copies
    members = nodes.select("node", "doc_id", "weight", F.posexplode(_keys(F.col("bands"), F.col("weight"), threshold)).alias("p", "key"))
    leaders = materialise(members.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).getField("node").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    led = materialise(members.drop("doc_id").join(leaders, "key"), "members")
    pairs = materialise(led.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = materialise(ends.join(nodes.select("node", "doc_id"), "node"), "needed")
    texts = materialise(_texts(rows, needed), "texts")
    first = _verified(pairs, texts, idf, threshold)
    edges = first.where("linked").select("a", "b")
    comp = materialise(connected_components(edges, "a", "b"), "components")

    def with_class(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comp.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    inside = materialise(with_class(led, "node", "c").select("key", "p", "n", "leader", "node", "weight", "c"), "inside")
    open_ = inside.groupBy("key").agg(F.min("n").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("node") == F.col("leader"), F.col("c"))).alias("bulk")).where("low <> high")
    open_ = materialise(open_.select("key", "n", "bulk"), "open")
    small = inside.drop("leader").join(open_.where(F.col("n") <= SMALL).select("key"), "key", "left_semi").select("key", "node", "c", "weight")
    small = materialise(small, "small")
    other = small.select("key", F.col("node").alias("other"), F.col("c").alias("oc"), F.col("weight").alias("heft"))
    apart = (F.col("c") != F.col("oc")) & (F.least("weight", "heft") >= F.greatest("weight", "heft") * (threshold - 1e-6))
    pairs = small.join(other, "key").where(apart & (F.col("node") > F.col("other"))).select("node", "other")
    pairs = pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    samples = materialise(nodes.join(needed.select("node"), "node", "left_semi").select("node", "sample"), "samples")
    pairs = pairs.join(samples.select(F.col("node").alias("a"), F.col("sample").alias("sa")), "a").join(samples.select(F.col("node").alias("b"), F.col("sample").alias("sb")), "b")
    alike = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    pairs = pairs.where(alike >= ALIKE).select("a", "b")
    links = _verified(materialise(pairs, "more"), texts, idf, threshold).where("linked").select("a", "b")
    large = inside.drop("n", "leader").join(open_.where(F.col("n") > SMALL).select("key", "bulk"), "key")
    large = large.join(nodes.select("node", "sample", "bands"), "node").join(texts, "node")
    links = links.unionByName(_block_links(large, idf, threshold))
    comp = materialise(connected_components(edges.unionByName(links), "a", "b"), "components")
    named = with_class(nodes.select("node", "doc_id"), "node", "class")
    least = materialise(named.groupBy("class").agg(F.min("doc_id").alias("class_id")), "least")
    by_node = materialise(named.join(least, "class").select(F.col("node").alias("_node"), "class_id"), "classes")
    out = rows.join(by_node, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "node")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class, that of least doc_id; columns unchanged. Rows without words all stay."""
    found = settled(lambda: classes(docs, threshold), "near")
    id_, node, own = fresh(docs, "id", "node", "own")
    kept = found.where("node is null or doc_id <=> class_id").select(F.col("doc_id").cast("long").alias(id_), F.coalesce("node", F.lit("")).alias(node)).distinct()
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.join(kept, same_id, "left_semi")
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.withColumn(own, F.when(F.size(words) > 0, F.md5(F.array_join(words, " "))).otherwise(F.lit("")))
    rows = rows.join(kept, same_id & (F.col(own) == F.col(node)), "left_semi")
    with_words = rows.where(F.col(own) != "").dropDuplicates(["doc_id", own])
    return with_words.unionByName(rows.where(F.col(own) == "")).drop(own)
