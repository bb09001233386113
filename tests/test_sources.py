import struct

import pytest

from lodevec.sources.vecs import read_neighbours, read_vectors, validate_dataset


def put(path, kind, rows):
    path.write_bytes(b"".join(struct.pack("<i", len(r)) + struct.pack(f"<{len(r)}{kind}", *r) for r in rows))
    return str(path)


def test_vector_files(spark, tmp_path):
    rows = [[i + 0.5, 2.0, -3.0] for i in range(5)]
    got = read_vectors(spark, put(tmp_path / "a.fvecs", "f", rows), rows=2).orderBy("row_id").collect()
    assert [(r.row_id, r.embedding) for r in got] == list(enumerate(rows))
    got = read_vectors(spark, put(tmp_path / "a.bvecs", "B", [[0, 255], [7, 128]])).orderBy("row_id").collect()
    assert [r.embedding for r in got] == [[0, 255], [7, 128]]
    got = read_neighbours(spark, put(tmp_path / "a.ivecs", "i", [[4, 2, 9], [1, 0, 3]]), 2).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 4), (0, 2, 2), (1, 1, 1), (1, 2, 0)]
    assert read_vectors(spark, put(tmp_path / "empty.fvecs", "f", [])).count() == 0


def test_damaged_files(spark, tmp_path):
    whole = put(tmp_path / "b.fvecs", "f", [[1.0, 2.0], [3.0, 4.0]])
    data = open(whole, "rb").read()
    for name, bad in (("short", data[:-2]), ("mixed", data[:12] + struct.pack("<i", 3) + data[16:]), ("none", struct.pack("<i", 0) + data[4:])):
        path = tmp_path / f"{name}.fvecs"
        path.write_bytes(bad)
        with pytest.raises(Exception, match="row|dimension"):
            read_vectors(spark, str(path)).collect()
    with pytest.raises(Exception, match="ends in"):
        read_vectors(spark, str(tmp_path / "c.txt")).collect()
    for bad in ([[1]], [[-1, 2]]):
        with pytest.raises(Exception, match="too few ids"):
            read_neighbours(spark, put(tmp_path / "d.ivecs", "i", bad), 2).collect()


def test_validation(spark, tmp_path):
    x = read_vectors(spark, put(tmp_path / "e.fvecs", "f", [[float(i), 1.0] for i in range(12)]))
    good = read_neighbours(spark, put(tmp_path / "e.ivecs", "i", [[i, 0] for i in range(12)]), 2)
    validate_dataset(x, x, x, good, 2, least_learn=12)
    for change in (dict(dimension=3), dict(least_learn=13), dict(k=13)):
        with pytest.raises(ValueError):
            validate_dataset(x, x, x, good, **{"dimension": 2, "least_learn": 12} | change)
    wrong = read_neighbours(spark, put(tmp_path / "f.ivecs", "i", [[i, 12] for i in range(12)]), 2)
    with pytest.raises(ValueError):
        validate_dataset(x, x, x, wrong, 2, least_learn=12)
