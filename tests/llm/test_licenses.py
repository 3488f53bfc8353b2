from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from waymesh.llm import licenses as L
from waymesh.llm import queries

MIT = dict(L.KNOWN)["MIT"]
CASES = [
    (1, MIT, "MIT"),
    (2, "The MIT Licence\n" + MIT, None),
    (3, "Copyright (c) 2020 Someone, all of it\n© 2021 Other\n\n" + MIT.upper().replace(" ", "\n").replace(",", ""), "MIT"),
    (4, "Copyright 1999-2003 by X. All rights reserved.\r\n" + MIT.replace("sublicense", "sub-licence"), "MIT"),
    (5, MIT + " Except on Sundays.", None),
    (6, None, None),
    (7, "", None),
    (7, "", None),
    (None, "released under the MIT licence", "notice-MIT"),
    (8, "...", None),
    (9, "long " * 100_000, None),
    (10, dict(L.KNOWN)["BSD-3-Clause"].replace("copyright holder", "copyright owner"), "BSD-3-Clause"),
]


def test_scan_finds_whole_texts(spark):
    df = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string").withColumns({"digest": F.lit(1), "license_id": F.lit("x")})
    got = sorted(((r.doc_id, r.license_id) for r in L.scan(df).collect()), key=str)
    assert got == sorted(((i, k) for i, _, k in CASES), key=str)
    assert L.scan(df.where("false")).collect() == []


def test_sql_gives_the_same(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.execute(L.SCAN_SQL).fetchall(), key=str)
    got = queries.QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.01").select("doc_id", "digest", "license_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    con.execute("CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM (VALUES " + ", ".join("(?::BIGINT, ?::VARCHAR)" for _ in CASES).replace("?::BIGINT", "{}").replace("?::VARCHAR", "{}").format(*[("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'") for c in CASES for v in c[:2]]) + ") t(doc_id, text)")
    df = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    assert sorted(map(tuple, L.scan(df).collect()), key=str) == sorted(con.execute(L.SCAN_SQL).fetchall(), key=str)


def test_a_table_with_licences(spark):
    """Every known text, in capitals, wrapped, with a holder; and every text that this system has of those known by digest."""
    rows = [(k, "Copyright (c) 2001 Some One\n" + t.upper().replace(" ", "\n  ")) for k, t in L.KNOWN]
    folder = Path("/usr/share/common-licenses")
    for name, k in {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        if (folder / name).exists():
            text = (folder / name).read_text()
            rows += [(k, text), (k, text.replace("http:", "https:").lower()), (None, text[:-200])]
    assert len(L.DIGESTS) == len(set(L.DIGESTS)) < 200
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in L.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]
    own = spark.createDataFrame([("mine", "A licence of my own."), ("none", "...")], "license_id string, text string")
    asked = spark.createDataFrame([(1, "a LICENSE of my own"), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.license_id) for r in L.scan(asked, own).collect()} == {(1, "mine"), (2, None)}
