import os
import tempfile

import pytest

from tessera.sources.csv import DatasetError, read_csv


def write(tmp, name, data: bytes):
    p = os.path.join(tmp, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_ragged_rows_tokens_and_types(spark):
    tmp = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = write(tmp, "ragged.csv", b"a,b,c\n1,x,2.5\n2,NA,3.5\n3,y\n4,z,1.0,EXTRA\n5,n/a,\n")
    df = read_csv(spark, p)
    rows = sorted(tuple(r) for r in df.collect())
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double"]
    assert rows == [(1, "x", 2.5), (2, None, 3.5), (3, "y", None), (5, None, None)]   # long row skipped


def test_latin1_fallback(spark):
    tmp = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    p = write(tmp, "l1.csv", "name,city\nJosé,Málaga\n".encode("latin-1"))
    assert read_csv(spark, p).first()["city"] == "Málaga"


def test_guards(spark):
    tmp = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    with pytest.raises(DatasetError):
        read_csv(spark, write(tmp, "one.csv", b"a\n1\n2\n"))
    with pytest.raises(DatasetError):
        read_csv(spark, write(tmp, "empty.csv", b"a,b\n"))
    with pytest.raises(DatasetError):
        read_csv(spark, write(tmp, "x.xlsx", b"a,b\n1,2\n"))
