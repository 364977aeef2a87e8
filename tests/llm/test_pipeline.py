"""The pipeline, stage by stage, against the plain versions."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from kpiforge.llm.queries import BYTE_BPE  # noqa: E402

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    real = [(r.doc_id + 1000, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    more = [(500 + i, "See also the index page\n" + " ".join(f"own{i}x{j}" for j in range(70)), "shop") for i in range(20)]
    path = tmp_path_factory.mktemp("sf")
    brute.documents(spark, brute.edge_rows() + more + real).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    got = stages[0](spark, docs, folder)
    assert got.columns == docs.columns and set(NAMES) < set(docs.columns)
    verdict = [(v, r) for v, r in zip(brute.quality(rows), rows) if v[7]]
    want = sorted((v[0], v[8], r[2]) for v, r in verdict)
    assert sorted((r.doc_id, r.text, r.source) for r in got.collect()) == want
    assert any("See also" in (r[1] or "") for _, r in verdict) and not any("See also" in t for _, t, _ in want)

    groups = brute.simhash_roots([w[:2] for w in want])[1]
    got = stages[1](spark, got.cache(), folder)
    kept = sorted((r.doc_id, r.text) for r in got.collect())
    assert [k[0] for k in kept] == sorted(groups) and set(kept) <= {w[:2] for w in want} and got.columns == docs.columns

    out = stages[2](spark, got.cache(), folder)
    assert out.columns == docs.columns
    rest = [x[4].decode(errors="ignore") for x in brute.without_repeats([t for _, t in kept])]
    cut = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert cut == [(i, t, len(t)) for (i, _), t in zip(kept, rest)]

    lib = brute.library(BYTE_BPE)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted({p.doc_id for p in pieces}) == [i for i, _, _ in cut]
    for i, t, _ in cut:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)


def test_no_documents(spark, tmp_path):
    brute.documents(spark, []).select(NAMES).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_runs(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    numbers = [next(k for k in queries if k.startswith(f"op{n}_")) for n in range(1, 14)]
    for name in [*numbers, "pipeline"]:
        assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
