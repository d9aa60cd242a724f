"""Queries against their SQL on rows that the driver's small tables don't have."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import chars
from quire.plans import ORACLE, QUERIES


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query and its SQL return the same rows of tables given as lists."""
    import duckdb

    con = duckdb.connect()

    def check(names, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        for name in names:
            df = QUERIES[name](spark, str(tmp_path))
            cols = sorted(df.columns)
            sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall()
            assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, sql)), name

    return check


#: Accents behind the first 8192 bytes, as the last of these, as the last of a file, and in both encodings.
ACCENTS = ["a" * 9000 + "é", "a" * 8191 + "é" + "b" * 10, "a" * 8190 + "ñé b", "a" * 8191 + "—" + "b", "café", None, "plain", "a" * 8192 + "é", "é" * 5000, "﻿marked", "a" * 8189 + "😀 é"]


def test_encodings_of_files(agrees):
    docs = [(i, ACCENTS[i % len(ACCENTS)]) for i in range(2 * len(ACCENTS))]
    agrees(["encoding_detect"], documents=(docs, "doc_id long, text string"))


def test_encodings_by_the_first_bytes(agrees):
    docs = [(i, ACCENTS[i % len(ACCENTS)]) for i in range(5 * len(ACCENTS))]
    events = [(i, i % 45, datetime(2024, 1, 1), "click", float(i)) for i in range(60)]
    tables = {"documents": (docs, "doc_id long, text string"), "events": (events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")}
    agrees(["shelf_heads", "shelf_open", "document_open", "document_card"], **tables)


@pytest.mark.parametrize(("data", "whole", "want"), [
    (b"a" * 8191 + b"\xe9b", False, "LATIN1"), (b"a" * 8191 + b"\xe2\x80\x94", False, "UTF8"), (b"a" * 8191 + b"\xe2\x80", False, "UTF8"), (b"a" * 8191 + b"\xe2\x80", True, "LATIN1"),
    (b"a" * 8192 + b"\xe9", True, "UTF8"), (b"caf\xe9", False, "UTF8"), (b"caf\xe9", True, "LATIN1"), (None, True, None), (b"", True, "UTF8"),
])
def test_sequences_at_the_end_of_a_sample(spark, data, whole, want):
    assert spark.createDataFrame([(data,)], "c binary").select(chars.encoding_of(F.col("c"), whole).alias("e")).first()["e"] == want


def test_paragraphs_of_chapters_of_several_units(agrees):
    long = "<html><body>" + "".join(f"<p>One <b>word {i}</b> of many in a line</p><h2>Head {i}</h2>" for i in range(1500)) + "</body></html>"
    bold = "<p>" + "".join(f"<i>word {i}</i> " for i in range(6000)) + "</p><p>last</p>"
    pages = [(i, h) for i, h in enumerate([long, bold, None, "<p>short</p>", "", "<script>" + "x<b>" * 20_000 + "</script><p>after</p>"] * 2)]
    agrees(["epub_paragraphs"], pages=(pages, "page_id long, html string"))
