import os

import duckdb
import pytest

from foliospark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "clicks"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=repr)


COLUMNS = {
    1: "doc_id bigint, held_out boolean, score double, predicted int",
    2: "page_id bigint, url string, text string, n_chars bigint",
    3: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    4: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    5: "doc_id bigint, held_out boolean, lang_pred string, score double",
    6: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    7: "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    8: "doc_id bigint, n_shingles bigint, component_id bigint",
    9: "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    10: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    11: "funnel string, client_id bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, deepest int, t2 bigint, t3 bigint, t4 bigint, same_depth bigint",
    12: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    13: "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("op")))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for c in COLUMNS[int(name[2:].split("_")[0])].split(", "):
        column, kind = c.split()
        assert kinds[column] == kind
    if name.startswith("op11"):  # a row a funnel and client, compared with SQL
        return
    table = {"op2": "pages", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == rows or name.startswith("op6") and df.count() >= rows
