import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from donorloom.sources import filings


def member(rows, header=True):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header:
        writer.writerow(["contributor_name", "employer", "unknown", "amount", "form_id"])
    writer.writerows(rows)
    return out.getvalue()


def some(rng, n):
    text = lambda: rng.choice(["", "plain", 'with "quotes"', "two\nlines", "comma, here", "é😀", "\x1f", " x "])
    return [(f"n{rng.randrange(10**9)}", text(), "?", str(rng.randint(0, 999)), text()) for _ in range(n)]


def read(spark, path, size):
    got = filings.read_appended_contributions(spark, path, size)
    assert got.columns == list(filings.RAW_COLUMNS)
    return got


def told(rows):
    return sorted((a, b or None, d, e or None) for a, b, _, d, e in rows)


def seen(df):
    return sorted((r["contributor_name"], r["employer"] or None, r["amount"], r["form_id"] or None) for r in df.collect())


def test_members_are_read_by_several_tasks(spark, tmp_path):
    """Members with and without the header, an empty one, bytes of a header within others' data, quoted line breaks."""
    rng = random.Random(1)
    parts = [some(rng, rng.randint(1, 400)) for _ in range(12)]
    noise = [(f"noise{i}", bytes(rng.randrange(256) for _ in range(300)).decode("latin-1").replace("\r", ""), "?", "1", "x") for i in range(200)]
    parts.append(noise)
    data = b"".join(gzip.compress(member(p, i % 3 == 0).encode(), rng.choice([0, 6, 9])) for i, p in enumerate(parts)) + gzip.compress(b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv.gz").write_bytes(data)
    (tmp_path / "in" / "b.csv.gz").write_bytes(gzip.compress(member(parts[0]).encode()))
    want = told([r for p in [*parts, parts[0]] for r in p])
    for size in (1 << 26, 20_000, 3_001):
        got = read(spark, str(tmp_path / "in"), size)
        assert seen(got) == want
    tasks = [r["p"] for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()]
    assert len(tasks) >= 8
    assert seen(read(spark, str(tmp_path / "in" / "b*"), 500)) == told(parts[0])
    (tmp_path / "empty").mkdir()
    assert read(spark, str(tmp_path / "empty"), 500).count() == 0
    with pytest.raises(FileNotFoundError):
        read(spark, str(tmp_path / "none*"), 500)


def test_bytes_that_are_no_text(spark, tmp_path):
    """A bad byte becomes U+FFFD, here and in the reader of whole files; the row and its neighbours stay."""
    raw = b'contributor_name,employer,amount\n"Sm\xffith, Ann",A\xc3,1\nnext,"a\nb",2\n'
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(raw))
    want = [("Sm�ith, Ann", "A�", "1"), ("next", "a\nb", "2")]
    for rows in (filings.read_appended_contributions(spark, str(tmp_path / "x.csv.gz")), filings.read_raw_contributions(spark, str(tmp_path / "x.csv.gz"))):
        assert sorted((r["contributor_name"], r["employer"], r["amount"]) for r in rows.collect()) == want


def test_members_that_cut_a_record_raise(spark, tmp_path):
    whole = member(some(random.Random(2), 50)).encode()
    at = whole.index(b",", len(whole) // 2)
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(whole[:at]) + gzip.compress(whole[at:]))
    with pytest.raises(Exception, match="ends within a record|Expected 5 columns"):
        read(spark, str(tmp_path / "x.csv.gz"), 1 << 20).collect()
