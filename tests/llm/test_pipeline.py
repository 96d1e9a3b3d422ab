"""The pipeline stage by stage against plain versions, and the registered queries' columns."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, brute_components, brute_lines, brute_quality, prose

from sparkleaf.llm import pii, queries, tokencount
from sparkleaf.llm.common import tokenizer_file


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in "abcdefghijklm" for b in ("on", "er", "ish", "ta")] + [f"k{i}" for i in range(300)]
    base = [prose(rng, rng.randint(12, 90), words) for _ in range(50)]
    texts = [*base, *base[:6], *(b + " added" for b in base[10:20]), *(f"{b}\nA footer that returns on many pages\n" for b in base[20:30]), "short", None, "", "again and again it says so " * 20, "mail me: a.b@mail.example.com, or 10.1.2.3 " + base[3][::-1]]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    vectors = [(i, [rng.random() for _ in range(4)], 0) for i in range(120)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def test_stages_against_plain_versions(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = spark.createDataFrame(stages[name](spark, df, path).collect(), DOCS)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        return out, {r["doc_id"]: r["text"] for r in out.collect()}

    df, got = step("quality rules", docs)

    def good(t):
        n, chars, _, _, dup, repeat, _ = brute_quality(t or "")
        shares = [brute_quality(t or "", n)[6] > s * chars for n, s in queries.quality.MAX_NGRAM_SHARE.items()]
        return not (n < 10 or 100 * repeat > 20 * n or dup > queries.quality.MAX_LINE_SHARE * chars or any(shares))

    assert got == {i: t for i, t in texts.items() if good(t)}
    before = got
    df, got = step("line dedup", df)
    lines = brute_lines(before.items())
    assert got == {i: lines[i][2] for i in before if lines[i][1] == 0 or lines[i][2].split()}
    assert all(r["n_chars"] == len(r["text"]) for r in df.collect())
    before = got
    df, got = step("near dedup", df)
    groups = brute_components(list(before.items()), 5, 80)
    assert got == {i: t for i, t in before.items() if groups[i][1] == i}
    before = got
    df, got = step("mask pii", df)
    model = pii.train()
    plain = {i: pii.masked_text(t, [(k, s, e, False) for k, found in enumerate(zip(pii.base_spans(t), pii.added_spans(model, [t], [pii.base_spans(t)], everywhere=True)[0])) for spans in found for s, e in spans]) for i, t in before.items()}
    assert got == plain and not any("@" in t for t in got.values())
    packed = stages["pack"](spark, df, path)
    assert packed.select("doc_id").distinct().count() == len(got)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    library = tokencount.bpe(tokenizer_file("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in got.items()}
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == sizes
    bound = -(-sum(sizes.values()) // 2048)
    assert packed.select("sequence_id").distinct().count() <= bound + 1


def test_stages_of_an_empty_table_and_of_null_ids(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    empty, odd = docs.limit(0), docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).withColumn("DOC", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0, name
        assert stage(spark, odd, folder[0]).count() == 3, name


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_return_all_documents(spark, folder, name):
    df = queries.QUERIES[name](spark, folder[0])
    assert df.count() == (2 * 10 if name == "op1_topk" else len(folder[1]))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_gives_the_same_rows(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    expect = con.execute(queries.SQL[name])
    columns = [c[0] for c in expect.description]
    rows = sorted(map(repr, expect.fetchall()))
    assert sorted(map(repr, (tuple(r) for r in queries.QUERIES[name](spark, folder[0]).select(*columns).collect()))) == rows
