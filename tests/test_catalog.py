"""Every registered document query against its DuckDB SQL on a small scale, and the entry points."""

import os
import re

import duckdb
import pytest

from sparkleaf.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rounded(row):
    return repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():
        assert df.count() >= 0
        return
    expect = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expect.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(rounded, df.select(*columns).collect())) == sorted(map(rounded, expect.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_phrase_recall_reads_every_document(spark, tmp_path):
    rows = catalog.queries()["phrase_recall"](spark, documents(spark, tmp_path, [f"word{i} and more" for i in range(25)] + [None])).collect()
    found = {r["file"]: (r["found"], r["phrases"]) for r in rows}
    assert found == {i: (1, 2 if i % 20 == 0 else 1) for i in range(25)} | {-1: (25, 27)}


def test_greedy_mapping_reads_whole_texts(spark, tmp_path):
    same = "an opening of more than forty characters, then "
    texts = [same + "alpha beta gamma " * 9, same + "0123456789" * 20, same + "the third " * 30]
    turns = [(1, i, "user", x) for i, x in enumerate(texts)] + [(2, 3, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalog.queries()["greedy_mapping"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["label"], r["parsed"], r["score"]) for r in rows if r["doc_id"] == 1) == [(1, "L0", "P0", 1.0), (1, "L1", "P1", 1.0), (1, "L2", "P2", 1.0)]
    assert [(r["label"], r["parsed"], r["score"]) for r in rows if r["doc_id"] == 2] == [("L3", None, 0.0)]


def test_nodes_hold_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x" * 100)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    labels, parsed, _ = catalog._nodes(spark, str(tmp_path))
    assert [r["text"] for r in labels.collect() + parsed.collect()] == ["x" * 100] * 2


LINES = ["Plain words", "12 begins with digits", "(x bracket", "ends in 7", "Élan", '"quoted', "• item", "• item", "", "3. own tag", "b) own tag", "words that go on to be rather long", "words that go on to be very long x", "1. own tag of much the same length"]


def test_list_tags_of_all_lines(spark, tmp_path):
    rows = catalog.queries()["list_tags"](spark, documents(spark, tmp_path, ["\n".join(LINES)])).collect()
    got = {r["line_no"]: (r["list_type"], r["list_tag"]) for r in rows}
    of = {0: ("11", "1. "), 1: ("10", "2.3 "), 2: ("18", "（一）"), 3: ("21", "①"), 4: ("26", "第三章 "), 5: ("★", "★"), 6: ("19", "b) "), 7: (None, None)}
    assert got == {i: of[i % 8] for i in range(len(LINES))}


def test_paragraphs_of_all_lines(spark, tmp_path):
    rows = catalog.queries()["paragraph_split"](spark, documents(spark, tmp_path, ["\n".join(LINES)])).collect()
    tag = re.compile(r"\s*(\d+\s*\.|[a-z]\)|•)")
    expect = {}
    for page in range(0, len(LINES), 4):
        lines = LINES[page : page + 4]
        x0 = [72 + 250 * (i == 3) for i in range(len(lines))]
        x1 = [x + min(2 * len(t), 400) for x, t in zip(x0, lines)]
        n = 0
        for i, t in enumerate(lines):
            n += i == 0 or bool(tag.match(t)) or x0[i] - x0[i - 1] > 9 or (len(t) % 6 == 0) != (len(lines[i - 1]) % 6 == 0) or x1[i - 1] < max(x1) - 12
            expect[page // 4, i] = n
    assert {(r["page"], r["ordinal"]): r["paragraph"] for r in rows} == expect
