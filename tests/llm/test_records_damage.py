"""Reading back notices files that changed after they were written."""
from pathlib import Path

import pytest

from scarp.llm import records


def test_changed_files_raise(make_docs, spark, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(make_docs([(i, f"text number {i} " * 20) for i in range(40)]), path)
    assert records.read_records(spark, path).count() == 40
    file = max(Path(path, "records").glob("part-*"), key=lambda p: p.stat().st_size)
    data = file.read_bytes()
    Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    other = bytearray(data)
    other[30] ^= 1
    for changed in (bytes(other), b"", data + data):
        file.write_bytes(changed)
        with pytest.raises(Exception, match="damaged|differs"):
            records.read_records(spark, path).count()
    file.write_bytes(data)
    assert records.read_records(spark, path).count() == 40


def test_files_follow_their_numbers_beyond_five_digits(spark):
    names = [(f"part-{i:05d}-x-c000.txt", n) for i, n in ((99999, 3), (100000, 5), (100001, 7), (2, 11), (1000000, 1))]
    got = {r.file: r.first for r in records._starts(spark.createDataFrame(names, "file string, n_tokens long")).collect()}
    assert [got[n] for n, _ in names] == [11, 14, 19, 0, 26]


def test_a_missing_or_foreign_file_raises(make_docs, spark, tmp_path):
    path = str(tmp_path / "r")
    records.write_records(make_docs([(i, f"text number {i} " * 20) for i in range(40)]), path)
    file = max(Path(path, "records").glob("part-*"), key=lambda p: p.stat().st_size)
    data = file.read_bytes()
    copy = Path(file.parent, file.name.replace("part-0", "part-1"))
    copy.write_bytes(data)
    with pytest.raises(ValueError, match="differs"):
        records.read_records(spark, path)
    copy.unlink()
    file.unlink()
    with pytest.raises(ValueError, match="differs"):
        records.read_records(spark, path)
