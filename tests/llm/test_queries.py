"""Every registered query over whole small tables against plain Python, and over empty tables."""

import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from loomstat.llm import _common, queries, secrets
from tests.llm.test_text_operators import base_spans, brute_katz
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_urls": "page_id host path rule verdict", "op3_quality": "doc_id held_out score predicted", "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_sentencepiece": "doc_id n_tokens ids_crc32 decoded_sha256 round_trip", "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op10_neighbours": "query_id rank vec_id score",
    "pipeline": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
}
ALL = queries.QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def found(spark):
    return lambda name: ALL[name](spark, SF)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def fold(k, parts):
    return zlib.crc32(str(k).encode()) % parts


def lowered(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def test_fingerprints_by_plain_votes(found):
    rows, fps = documents(), {}
    for k, t in rows:
        words = WORD.findall(lowered(t))
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                one, two = sorted((find(a), find(b)))
                root[two] = one
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found("op1_simhash").collect()} == {(k, f"{fps[k]:016x}", find(k)) for k in ids}


def test_archives_equal_their_sql(found):
    assert differences(found("op4_warc"), queries.ORACLES["op4_warc"], SF) == []


def test_pieces_and_quality_cover_all_documents(found):
    rows = dict(documents())
    pieces = {r["doc_id"]: r for r in found("op5_sentencepiece").collect()}
    assert pieces.keys() == rows.keys() and all(r["round_trip"] for r in pieces.values())
    scores = {r["doc_id"]: r for r in found("op3_quality").collect()}
    assert scores.keys() == rows.keys() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (fold(k, 4) == 2) for k, r in scores.items())


def test_packed_pieces_hold_every_token(found):
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for k, t in documents():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for start in range(0, len(ids), 4096):
            want[k, start, len(ids[start : start + 4096]), zlib.crc32(ids[start : start + 4096].tobytes()), len(ids)] += 1
    rows = found("op6_packing").collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    assert sum(r["length"] for r in rows) / 4096 / len({r["sequence_id"] for r in rows}) > 0.9


def test_katz_scores_of_the_query(found):
    docs = [(k, t, fold(k, 7) != 2) for k, t in documents()]
    want = {d[0]: w for d, w in zip(docs, brute_katz(docs)[0], strict=True)}
    got = {r["doc_id"]: r for r in found("op7_katz").collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r["score"], r["base_score"]) == pytest.approx(want[k][:2], abs=1e-6) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[k][2:] and r["held_out"] == (fold(k, 7) == 2)


def test_secret_counts_of_the_query(found):
    rows = {r["doc_id"]: r for r in found("op9_secrets").collect()}
    for k, t in documents():
        spans = base_spans(t or "")
        assert [rows[k][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[1] == kind for s in spans) for kind in range(3)]
        assert {f"{secrets.KINDS[kind]}:{a}:{b}" for a, kind, b in spans} <= set(rows[k]["spans"].split(",") if rows[k]["spans"] else [])


def test_neighbours_of_the_query(found):
    data = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    ids, x = np.array([k for k, _ in data]), np.array([v for _, v in data], float)
    by, hits = defaultdict(list), 0
    for r in found("op10_neighbours").orderBy("query_id", "rank").collect():
        by[r["query_id"]].append(r)
    assert set(by) == {int(k) for k in ids if k % 20 == 0}
    for q, rows in by.items():
        score = x @ x[ids == q][0]
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(abs(r["score"] - score[ids == r["vec_id"]][0]) < 1e-9 for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        score[ids == q] = -np.inf
        hits += len({r["vec_id"] for r in rows} & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits / (20 * len(by)) >= 0.9


@pytest.mark.parametrize("name", ["op2_urls", "op8_fingerprints", "pipeline"])
def test_query_runs_over_the_whole_table(found, name):
    out = found(name)
    source = "pages" if name == "op2_urls" else "documents"
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/{source}.parquet'").fetchall()[0][0]
    assert out.columns == COLUMNS[name].split() and (out.select("doc_id").distinct().count() <= n if name == "pipeline" else out.count() == n)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_of_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = ALL[name](spark, str(tmp_path))
    assert out.columns == COLUMNS[name].split() and out.count() == 0


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows: every stage keeps its columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 60_000, "en", "s", 1), (4, "a b c", None, None, None), (4, "a b c", None, None, None), (None, "no id", "en", "s", 5), (5, 'token = "abcdef123456"', "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {1, 3, 4, None, 5} and kept[5] == "[secret]\""
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == set(kept)


def test_batch_bounds_keep_a_session_s_smaller_ones(spark):
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    try:
        for given, want in ((("10000", "64m"), (str(_common.BATCH_ROWS), str(_common.BATCH_BYTES))), (("7", "1m"), ("7", "1m")), (("0", "123b"), (str(_common.BATCH_ROWS), "123b"))):
            for n, x in zip(names, given, strict=True):
                spark.conf.set(n, x)
            _common.small_batches(spark)
            assert tuple(spark.conf.get(n) for n in names) == want
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)


def test_no_folder_of_one_machine_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master="spark://head:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _common.shared_dir(session)
