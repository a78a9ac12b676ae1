import re
from pathlib import Path

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_subpackage():
    root = Path(entry.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts and p.name != "__spark_entry__.py" and "tests" not in p.parts:
            assert not re.search(r"pothi\.llm", p.read_text()), p


def test_stream_equals_batch(spark):
    q = entry.queries()
    a = {(r.day, r.n) for r in q["S04_stream_counts"](spark, "/root/testdata/sf0.001").collect()}
    b = {(r.day, r.n) for r in q["S05_daily_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert a == b
