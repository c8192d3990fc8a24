"""The pipeline's stages against plain versions."""

import re

import corpus_pipeline
import numpy as np
import pytest
from marlstone.llm import language_id, secret_scan
from marlstone.llm.common import release
from pyspark.sql import functions as F

from test_operators import CLASH, components_of, fused, library, plain_spans, rows, shingles, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_rows_and_none(spark, docs, name):
    step = dict(corpus_pipeline.STAGES)[name]
    for d in (docs, docs.limit(0), docs.select("doc_id", "text")):
        out = step(spark, d, SF)
        if name != "packing":
            assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
        n = out.count()
        assert (n == 0) == (d.isEmpty())


def test_stages_decide(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    left = {r.doc_id for r in stage["language_id"](spark, docs, SF).collect()}
    model = language_id.fit(docs, "text", "lang", "doc_id")
    plain = fused(model, [(n, None, h, h.rsplit(".", 1)[1] if h and "." in h else None, t) for n, (_, t, _, h, _) in enumerate(rows())])
    assert left - {None} == {rows()[n][0] for n, (_, _, ok) in plain.items() if ok} - {None}
    exact = stage["exact_dedup"](spark, docs, SF).collect()
    assert [r.doc_id for r in exact].count(5) == 1 and not {1, 7, 8, 12} & {r.doc_id for r in exact}
    known = sorted({(i, t) for i, t, *_ in rows() if i is not None}, key=lambda x: x[0])
    want = {known[c][0] for c in components_of([shingles(t, 5) for _, t in known])}
    assert {r.doc_id for r in stage["minhash_near_dedup"](spark, docs, SF).collect()} - {None} == want
    clean = stage["secret_scan"](spark, docs, SF).collect()
    assert len(clean) == len(rows())
    for r in clean:
        assert not r.text or not secret_scan.base_spans(r.text)
        assert r.text is None or r.n_chars == len(r.text)


def redacted(t):
    out, done = [], 0
    for a, _, b in sorted(plain_spans(t)):
        if a >= done:
            out += [t[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join([*out, t[done:]])


def test_run(spark):
    """All stages against a plain version of each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, "text", "lang", "doc_id")
    held = {r.doc_id: r for r in docs.collect()}
    kept = fused(model, [(i, None, r.source, r.source.rsplit(".", 1)[1] if r.source and "." in r.source else None, r.text) for i, r in held.items()])
    texts = {}
    for i in sorted(i for i, (_, _, ok) in kept.items() if ok):
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text(held[i].text)), i)
    first = sorted(texts.values())
    last = sorted({first[c] for c in components_of([shingles(held[i].text, 5) for i in first])})
    assert 0 < len(last) < len(first) < len(held)
    library_ = library()
    want = set()
    for i in last:
        ids = library_.encode(redacted(text(held[i].text)), add_special_tokens=False).ids + [0]
        at = 0
        while at < len(ids):
            n = min(1024, 1 << (len(ids) - at).bit_length() - 1)
            want.add((i, at, n, np.array(ids[at : at + n], "<u4").tobytes(), len(ids)))
            at += n
    found = corpus_pipeline.run(spark, SF).collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(r.offset == 0 for r in found)
    assert {(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in found} == want and len(found) == len(want)


def test_release_gives_the_heap_back(spark):
    """The driver's JVM once kept a heap of three times what lives in it between stages, and another's settings stay as they are."""
    beans = spark._jvm.java.lang.management.ManagementFactory
    kind = spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
    flags = beans.newPlatformMXBeanProxy(beans.getPlatformMBeanServer(), "com.sun.management:type=HotSpotDiagnostic", kind)
    now = lambda: [flags.getVMOption(n).getValue() for n in ("MinHeapFreeRatio", "MaxHeapFreeRatio")]
    held, runtime = now(), spark._jvm.java.lang.Runtime.getRuntime()
    release(spark)
    assert runtime.totalMemory() < 2 * (runtime.totalMemory() - runtime.freeMemory())
    assert now() == held
