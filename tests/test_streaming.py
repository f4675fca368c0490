"""Files that arrive between two runs of the same query."""

from strandflow.streaming.alignments import arriving_molecules, arriving_reads, gather

LINE = "{}\t{}\tchr1\t101\t60\t100M\t*\t0\t0\tA\tI\n"


def test_molecules_are_gathered_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run() -> set:
        q = gather(arriving_molecules(arriving_reads(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        assert q.awaitTermination(120) and q.exception() is None
        rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    (tmp_path / "in" / "a.sam").write_text("@SQ\tSN:chr1\tLN:9\n" + LINE.format("r1_C1_U1", 0) + LINE.format("r2_C1_U1", 0) + LINE.format("r3_C2_U1", 256))
    assert run() == {("C1", "U1")}
    (tmp_path / "in" / "b.sam").write_text(LINE.format("r4_C1_U1", 0) + LINE.format("r5_C2_U2", 16))
    assert run() == {("C1", "U1"), ("C2", "U2")}
