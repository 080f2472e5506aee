"""Every stage of the pipeline against a plain version of it, each on what its predecessor kept."""

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessaline.llm import langid, mixing, secrets
from tessaline.storage import materialise

from .cases import odd_docs, odd_rows
from .test_search import brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "source_mixing", "token_packing"]
    stage = dict(corpus_pipeline.STAGES)

    model = langid.train(docs)
    kept = materialise(stage["language_id"](spark, docs, ""), "t")
    assert kept.columns == COLUMNS
    want, rows = {}, docs.collect()
    for r, (lang, score) in zip(rows, langid.Scorer(model).predict([r.text for r in rows]), strict=True):
        if lang != "und" and score >= 0.5:
            want[r.doc_id] = (r.text, lang)
    assert {r.doc_id: (r.text, r.lang) for r in kept.collect()} == want and len(want) > 0.9 * docs.count()

    unique = materialise(stage["near_dedup"](spark, kept, ""), "t")
    rows = kept.collect()
    _, root = brute_classes([(r.doc_id, r.text) for r in sorted(rows, key=lambda r: r.doc_id)], 0.8)
    ids = sorted(r.doc_id for r in rows)
    find = lambda i: ids[root(ids.index(i))]
    assert unique.columns == COLUMNS and sorted(r.doc_id for r in unique.collect()) == [i for i in ids if find(i) == i]

    clean = materialise(stage["secret_scan"](spark, unique, ""), "t")
    net = secrets.train(unique)
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in clean.collect():
        (_, spans, _), = secrets.all_spans([before[r.doc_id]], net)
        assert r.text == secrets.redacted(before[r.doc_id], spans) and r.n_chars == len(r.text)
        assert not secrets.base_spans(r.text)

    mixed = materialise(stage["source_mixing"](spark, clean, ""), "t")
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, clean.collect()))
    order = [r.doc_id for r in mixing.schedule(clean).orderBy("mix_position", "doc_id").collect()]
    parts = mixing.in_order(clean).select("doc_id").rdd.glom().collect()
    assert [r.doc_id for part in parts for r in part] == order

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    tokens = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect()}
    pieces = defaultdict(list)
    for r in stage["token_packing"](spark, mixed, "").collect():
        pieces[r.doc_id].append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == tokens
    assert all([s for s, _ in sorted(p)] == list(np.cumsum([0] + [n for _, n in sorted(p)])[:-1]) for p in pieces.values())


def test_run_and_odd_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").limit(1).count() == 1
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= len(odd_rows()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
