import base64
import glob
import gzip
import hashlib
import os

import pytest

from railpulse.llm import warc as w

from .conftest import DIRS

SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to), with revisits of the smallest id that has the payload."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out, seen = [], set()
    for i, _, t in rows:
        data = (t or "").encode()
        to = first.get(t or "")
        again = len(data) >= least and to is not None and (i is None or i > to or (i, data) in seen)
        seen.add((i, data))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def back(spark, rows, root, **kw):
    w.write_archive(spark.createDataFrame(rows, SCHEMA).repartition(3), root, **kw)
    return sorted(map(tuple, w.read_archive(spark, root).collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIRS['small']}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, w.op9_warc(spark, DIRS["small"]).collect()), key=str) == brute(rows)


@pytest.fixture
def pages():
    rows = [(i, f"http://h/{i}", "same page" if i % 3 == 0 else f"page {i} é" * (i % 7)) for i in range(120)]
    return rows + [(None, None, "same page"), (None, "u", "only here"), (500, "a b\nc", None), (501, "u", ""), (10 ** 15, "far", "far")]


def test_revisits_and_edges(spark, pages, tmp_path):
    assert back(spark, pages, f"file://{tmp_path}/a") == brute(pages)
    assert back(spark, pages, f"file://{tmp_path}/b", min_bytes=9) == brute(pages, 9)
    twice = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (1, "u", "y")]
    assert back(spark, twice, f"file://{tmp_path}/c") == brute(twice)
    assert back(spark, [], f"file://{tmp_path}/d") == []


def test_files_are_deterministic_and_rolled(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(w, "SHARD_ROWS", 40)
    names = []
    for k, parts in (("a", 1), ("b", 5)):
        w.write_archive(spark.createDataFrame(pages, SCHEMA).repartition(parts), f"file://{tmp_path}/{k}", file_bytes=4000)
        names.append({os.path.basename(f): open(f, "rb").read() for f in glob.glob(f"{tmp_path}/{k}/*.warc.gz")})
        assert not glob.glob(f"{tmp_path}/{k}/.*.tmp")
    assert names[0] == names[1] and len(names[0]) > 3
    assert max(map(len, names[0].values())) <= 4000
    ids = []
    for f in sorted(names[0]):
        text = gzip.decompress(names[0][f]).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        ids += [int(x.split("\r\n")[0]) for x in text.split("X-Page-Id: ")[1:]]
    assert ids == sorted(ids)


def test_damage_is_noticed(spark, pages, tmp_path):
    root = f"file://{tmp_path}/a"
    w.write_archive(spark.createDataFrame(pages, SCHEMA), root)
    file = sorted(glob.glob(f"{tmp_path}/a/*.warc.gz"))[0]
    data = gzip.decompress(open(file, "rb").read()).replace(b"page 1 ", b"page 2 ", 1)
    with open(file, "wb") as f:
        for record in data.split(b"WARC/1.1\r\n")[1:]:
            f.write(gzip.compress(b"WARC/1.1\r\n" + record))
    with pytest.raises(Exception, match="digest"):
        w.read_archive(spark, root).collect()
