"""Apportionment of counts, and matrices on disk."""

from strandflow.operators import matrix
from strandflow.operators.matrix import apportion
from strandflow.sinks import results
from strandflow.sources import tables


def test_equal_remainders_differ_in_the_last_bits(spark):
    """1.6 and 0.6 leave the same remainder, which doubles make 0.6000000000000001 and 0.6."""
    rows = [("c", 1, 0.16, 10), ("c", 2, 0.06, 10), ("c", 3, 0.78, 10)]
    got = apportion(spark.createDataFrame(rows, "barcode string, isoform long, theta double, n long"), ["barcode"])
    assert {r["isoform"]: r["count"] for r in got.collect()} == {1: 1, 2: 1, 3: 8}


def test_columns_of_copies_are_written_once(spark, tmp_path):
    """Sixty isoforms with two different columns: each region's line holds two entries, and is read with sixty."""
    names = [f"t{i:02}" for i in range(60)]
    design = [("1", "g", "P0:P1", n, 0.25 if int(n[1:]) % 2 else 1.0) for n in names] + [("1", "g", "P2:P3", n, 0.75) for n in names if int(n[1:]) % 2]
    d = spark.createDataFrame(design, "chrom string, gene string, region string, isoform string, value double")
    a = spark.createDataFrame([("1", "g", "P0:P1", 2.0)], "chrom string, gene string, region string, abundance double")
    p = spark.createDataFrame([("1", "g", 100 * k, f"P{k}") for k in range(4)], "chrom string, gene string, at long, point string")
    results.write_matrices(*results.matrix_dump(d, a, p, 2), str(tmp_path))
    assert max(len(x["value"]) for x in spark.read.text(f"{tmp_path}/matrix_info").collect()) < 60
    got = {r["region"]: r for r in tables.read_matrices(spark, str(tmp_path)).collect()}
    assert [(k, got[k]["coordinates"], got[k]["abundance"]) for k in sorted(got)] == [("P0:P1", "0:100", 2.0), ("P2:P3", "200:300", None)]
    assert all(r["isoforms"] == ",".join(names) for r in got.values())
    assert got["P0:P1"]["row"] == ",".join(["1.00", "0.25"] * 30) and got["P2:P3"]["row"] == ",".join(["0.00", "0.75"] * 30)


def test_entries_are_ordered_once_and_read_together(spark, tmp_path, monkeypatch):
    """One job of text writes the lines of both matrices; both are ordered, and read without a join by names."""
    written, write = [], matrix._write_lines
    monkeypatch.setattr(matrix, "_write_lines", lambda lines, path: written.append(path.rsplit("/", 1)[1]) or write(lines, path))
    rows = [(f"c{i % 3}", f"t{i % 4}", i + 1) for i in range(12)]
    matrix.write_mex(spark.createDataFrame(rows, "barcode string, isoform string, count long"), str(tmp_path))
    assert written == ["barcodes.tsv", "features.tsv"] and sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["barcodes.tsv", "cpm_matrix.mtx", "features.tsv", "matrix.mtx"]
    for name in ("matrix.mtx", "cpm_matrix.mtx"):
        lines = (tmp_path / name).read_text().splitlines()
        assert lines[0].startswith("%%") and lines[1].startswith("%meta") and lines[2] == "4 3 12"
        assert [x.split()[1::-1] for x in lines[3:]] == [[str(c), str(r)] for c in (1, 2, 3) for r in (1, 2, 3, 4)]
    total = {c: sum(n for b, _, n in rows if b == c) for c in ("c0", "c1", "c2")}
    got = sorted((r["barcode"], r["feature"], r["value"], r["cpm"]) for r in tables.read_mex_pair(spark, str(tmp_path)).collect())
    assert got == sorted((b, t, float(n), round(n / total[b] * 1e6, 4)) for b, t, n in rows)
