"""The stages on a small table: decisions take effect, columns stay, clean documents pass."""

import collections
import hashlib

import corpus_pipeline
from parley.llm import mixing
from parley.spark import read_table
from tests.conftest import SF_SMALL


def test_stages_one_by_one(spark):
    docs = read_table(spark, SF_SMALL, "documents").cache()
    labels = {r.doc_id: r.quality for r in read_table(spark, SF_SMALL, "labels").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF_SMALL).cache()
        assert out.columns == docs.columns, name
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] >= ids[4]
    good = {i for i in ids[0] if labels.get(i) == 1}
    assert len(good & ids[1]) >= 0.97 * len(good)
    assert sum(labels.get(i) == 0 for i in ids[1]) <= 0.2 * sum(v == 0 for v in labels.values())
    texts = collections.Counter(r.text for r in seen[3].collect())
    assert max(texts.values()) == 1  # no copies are left
    copies = collections.Counter(r.doc_id for r in seen[4].collect())
    assert set(copies.values()) <= {1, 2}
    want = {r.doc_id: r.taken for r in mixing.taken_words(seen[3]).collect()}
    size = {r.doc_id: r["size"] for r in mixing.taken_words(seen[3]).collect()}
    assert all(want[i] == copies.get(i, 0) * size[i] for i in want)
    last = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF_SMALL).collect()
    assert len(last) == sum(copies.values())
    plain = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in seen[-1].collect()}
    assert all(r.decoded_sha256 == plain[r.doc_id] and len(r.ids) == r.n_tokens for r in last)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tests.llm.test_operators import CLASHES, ROWS, make_docs, prose

    folder = str(tmp_path)
    rows = ROWS + [(None, None, None, None), (100 + 0, "", None, None)] + [(200 + i, prose(150, 200 + i), "en", "ab"[i % 2]) for i in range(30)]
    spark.createDataFrame([(200 + i, 1, 0) for i in range(30)] + [(11, 0, 0), (12, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    odd = make_docs(spark, rows).withColumns({c: F.lit(-1) for c in CLASHES})
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder).cache()
            n = out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
                docs = out
        assert {r.doc_id for r in docs.collect()} <= {i for i, *_ in rows} and os.path.isdir(folder)
        assert n == docs.count() and (n == 0 or len({r.doc_id for r in docs.collect()} & set(range(200, 230))) >= 20)
