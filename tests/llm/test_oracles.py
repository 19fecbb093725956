"""The SQL of the registered queries, over the smallest test data and over tables made to be hard."""

import duckdb
import pytest

import brute
import test_near
import test_quotes
import test_substrings
from orfspark.llm import near, queries, quotes, substrings


def _rows(rows, columns):
    return sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


def _sql(name, tables):
    con = duckdb.connect()
    for t, source in tables.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{source}'")
        else:
            con.register(t, source.toPandas())
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    return _rows(cursor.fetchall(), columns), sorted(columns)


def _spark(df):
    return _rows([tuple(r) for r in df.collect()], df.columns), sorted(df.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_test_data(spark, data, name):
    tables = {t: f"{data}/{t}.parquet" for t in ("documents", "conversations", "embeddings")}
    assert _spark(queries.queries()[name](spark, data)) == _sql(name, tables)


def test_near_copies(spark):
    docs = brute.docs(spark, test_near._corpus(5, groups=5, size=8, extra=20))
    assert _spark(near.near_duplicates(docs)) == _sql("op5_minhash_near_dedup", {"documents": docs})


def test_recurring_spans(spark):
    docs = brute.docs(spark, test_substrings._corpus(6))
    assert _spark(substrings.removed_spans(docs)) == _sql("op9_substring_dedup", {"documents": docs})


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I boil an egg?\n\nAnd how long?"), (1, 1, "assistant", "Put it in water."), (1, 2, "user", "> put it   in WATER!\nHow much water?"),
        (1, 3, "assistant", "Ann wrote:\n>> Put it in water.\n> How much water?\nA litre."), (2, 0, "user", "> And how long\n\nI wonder too."), (2, 1, "user", "> never said\nHm."),
        (2, 2, "user", ">> put it in water\nDeep."), (2, 3, "user", "> \n>\nEmpty"), (3, 0, "user", "a > b"), (4, 0, None, None), (4, 1, "x", "> a > b\n>> deeper\n> tail\nok"), (4, 2, "x", "> ok\r\n> \r\nfine"),
    ]
    messages = spark.createDataFrame(rows, test_quotes.MESSAGES)
    assert _spark(quotes.link_quotes(messages)) == _sql("op2_quotation_linking", {"conversations": messages})


def test_quoted_conversations_have_quotations(spark, data):
    rows = queries.quoted_conversations(spark, data).collect()
    assert sum(r.n_linked for r in rows) > len(rows) / 3 and max(r.quote_levels for r in rows) == 2 and max(r.depth for r in rows) > 1
