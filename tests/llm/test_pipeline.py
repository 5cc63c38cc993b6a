"""The registered corpus queries against their SQL, and the pipeline against a brute-force reading."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from loam.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


def test_pipeline_stages_in_turn(spark, small):
    """Each stage against a plain reading of its own input."""
    import base64

    import pyarrow as pa
    import public_tokenizers as P
    import tiktoken

    from loam.llm import bpe, language, mixing, toxicity
    from tests.llm.test_operators import joined_by_hand, plain_code_length

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], small).cache())
    assert all(s.columns == columns for s in steps[:-1])
    rows = [{r["doc_id"]: r for r in s.collect()} for s in steps]
    ids = [set(r) for r in rows]
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {k: r["text"] for k, r in rows[0].items()}
    assert ids[1] == {k for k, t in texts.items() if model.severity(model.scores(pa.array([t])))[0] < toxicity.REJECT_AT}
    samples: dict = {}
    for k in ids[1]:
        samples.setdefault(rows[1][k]["lang"], []).append(texts[k].encode())
    for k in sorted(ids[1])[:20]:
        data = texts[k].encode()
        if len(data) < 5000:
            known = bool(data) and min(plain_code_length(x, data) for x in samples.values()) <= language.MAX_BITS_PER_BYTE * 256 * len(data)
            assert known == (k in ids[2])
    assert ids[3] == {g for _, _, g in joined_by_hand([(k, texts[k]) for k in ids[2]])[0].values()}
    assert ids[4] == {r["doc_id"] for r in mixing.mix(steps[3]).where("kept").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids[5] == ids[4] and all(r["token_ids"] == exact.encode_ordinary(texts[k]) for k, r in rows[5].items())
    whole = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {k: r["token_ids"] for k, r in rows[5].items()}


def test_pipeline_of_awkward_documents(spark, tmp_path):
    """Nulls, empties, a long text, repeats and clashing columns; and no documents at all."""
    from tests.llm.test_operators import awkward

    for name, docs in (("some", awkward(spark, token_ids="clash", kept=1)), ("none", awkward(spark).limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        found = {r["doc_id"] for r in rows}
        assert len(rows) == len(found) and found <= {1, 5, 6, 7, None} and (name == "some") == bool(rows)
        assert all(r["round_trip"] for r in rows)
