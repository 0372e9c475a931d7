"""The corpus pipeline against a plain pass over a small corpus."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cadenza.llm import quality, secrets
from cadenza.llm.queries import ORACLE_SQL, QUERIES, crc_of, table
from test_near_duplicates import brute as near
from test_tiling import brute as tiled
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/out"
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_return_the_documents_columns(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secret scan", "packing"]


def test_rejected_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages[0]
    ranker = quality.fit_quality(before, table(spark, SF, "labels"), crc_of("doc_id", 5) != 0)
    rows = pairs(before)
    scores = ranker.score(quality.text_features(pa.array([t for _, t in rows])))
    assert pairs(after) == [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()} & {d for d, _ in rows}
    assert len(good & {d for d, _ in pairs(after)}) >= 0.95 * len(good)


def test_one_of_each_near_group_stays(stages):
    before, after = stages[1]
    rows = pairs(before)
    kept = {d for d, _, _, k in near(rows) if k}
    assert pairs(after) == [r for r in rows if r[0] in kept]


def test_benchmark_passages_go(spark, stages):
    before, after = stages[2]
    rows = pairs(before)
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    five = {tuple(w[i : i + 5]) for _, b in items for w in [b.lower().split()] for i in range(len(w) - 4)}
    some = [(d, t) for d, t in rows for w in [t.lower().split()] if any(tuple(w[i : i + 5]) in five for i in range(len(w) - 4))]
    bad = {d for d, *_ in tiled(some, [(k, b) for k, b in items if any(b.lower()[:20] in t.lower() or b.lower()[-20:] in t.lower() for _, t in some)], 5, 0.5)}
    assert pairs(after) == [r for r in rows if r[0] not in bad]


def test_secrets_are_masked_and_every_document_stays(stages):
    before, after = stages[3]
    rows = dict(pairs(before))
    got = after.collect()
    assert {r.doc_id for r in got} == set(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert secrets.secret_report(after).where("spans <> ''").count() == 0
    found = {r.doc_id for r in secrets.secret_report(before).where("spans <> ''").collect()}
    assert {r.doc_id for r in got if r.text != rows[r.doc_id]} == found


def test_all_ids_are_packed(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in before.collect()}
    place, count = defaultdict(int), defaultdict(int)
    for r in after.collect():
        own = want[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        assert bytes(r.ids) == own.tobytes()
        place[r.sequence_id] += r.length
        count[r.doc_id] += r.length
    assert count == {d: len(w) for d, w in want.items()}
    assert max(place.values()) <= 2048 and sum(n == 2048 for n in place.values()) >= len(place) - 1


def test_run_is_all_stages(spark, stages):
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == stages[-1][1].columns
    assert whole.agg({"length": "sum"}).first()[0] == stages[-1][1].agg({"length": "sum"}).first()[0]


def test_each_operator_has_a_query():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)
