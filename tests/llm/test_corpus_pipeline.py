import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from gridloom.llm import sentencepiece
from test_operators import brute_components, edited, prose


def test_pipeline_equals_brute_force(spark, tmp_path):
    base, bench = prose(120, 201, words=3000), prose(6, 202, words=3000)
    texts = base + [base[0].upper(), base[1], edited(base[2], 1, 1), base[5] + " " + bench[0]]
    toxic = set()
    for k in range(0, 120, 6):
        texts[k] += " you idiot moron scum loser"
        toxic.add(k)
    texts += [None, "", "x"]
    ids = list(range(len(texts)))
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(120), pa.int64()), "quality": pa.array([1] * 120, pa.int32()), "toxic": pa.array([int(k in toxic) for k in range(120)], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(6), pa.int64()), "text": bench}), tmp_path / "benchmark.parquet")
    kept = [i for i in ids if not any(w in (texts[i] or "") for w in ("idiot", "moron"))]
    last = {(texts[i] or "").lower(): i for i in kept}
    kept = sorted(last.values())
    want, _ = brute_components([texts[i] for i in kept], 5, 4, 5)
    kept = [i for k, i in enumerate(kept) if want[k] == k]
    kept = [i for i in kept if not any(b in (texts[i] or "") for b in bench)]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == kept
    library = sentencepiece.BacktrackingEncoder(sentencepiece.default_model()).library
    for i, r in got.items():
        ids_ = library.encode(texts[i] or "", add_eos=True)
        assert r["n_tokens"] == len(ids_) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(schema.empty_table(), tmp_path / "documents.parquet")
    pq.write_table(pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]).empty_table(), tmp_path / "labels.parquet")
    pq.write_table(pa.schema([("item_id", pa.int64()), ("text", pa.string())]).empty_table(), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
