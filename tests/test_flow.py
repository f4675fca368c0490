"""Whole runs over the worked fixture: files in, tables and matrices out, and matrices in again."""

import pytest
from pyspark.sql import functions as F

from strandflow import flow
from strandflow.__main__ import main
from strandflow.config import EmSettings, MapSettings, TeSettings
from strandflow.sources import tables

GTF = """# comment
chr1\tx\tgene\t101\t400\t.\t+\t.\tgene_id "G1";
chr1\tx\texon\t101\t200\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T1";
chr1\tx\texon\t101\t250\t.\t+\t.\tgene_id "G1"; transcript_id "T2";
chr1\tx\texon\t301\t400\t.\t+\t.\tgene_id "G1"; transcript_id "T2";
chr2\tx\texon\t1001\t1200\t.\t-\t.\tgene_id "G2"; transcript_id "T3.1";
"""
READS = [
    ("r1_C1_U1", 0, 101, "100M100N100M"), ("r2_C1_U2", 0, 101, "150M50N100M"), ("r3_C1_U3", 0, 301, "100M"), ("r4_C1_U4", 0, 301, "15M"), ("r5_C1_U5", 256, 101, "100M100N100M"),
]
TE = """chr1\tRepeatMasker\texon\t151\t190\t.\t+\t.\tgene_id "AluY"; transcript_id "AluY.1"; family_id "Alu"; class_id "SINE"; locus "1:151-190";
chr1\tRepeatMasker\texon\t180\t320\t.\t+\t.\tgene_id "L1HS"; transcript_id "L1HS.1"; family_id "L1"; class_id "LINE"; locus "1:180-320";
"""
REPEATMASKER = """   SW  perc perc perc  query      position in query           matching       repeat              position in  repeat
score  div. del. ins.  sequence    begin     end    (left)    repeat         class/family         begin  end (left)   ID

  463   1.3  0.6  1.7  chr1        151     190 (100) +  AluY           SINE/Alu              1   41   (59)      1
  239  29.4  1.9  1.0  chr1        300     340 (100) C  AluY           SINE/Alu             (10) 90   50       2
  100   1.0  0.0  0.0  chr2          5      20 (100) +  (TA)n          Simple_repeat         1   16    (0)      3
 too few fields
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("run")
    sam = "@SQ\tSN:1\tLN:1000\n" + "".join(f"{n}\t{f}\t1\t{p}\t60\t{c}\t*\t0\t0\tA\tI\n" for n, f, p, c in [*READS, ("r6_C1_U3", 0, 301, "100M")])
    for name, text in {"a.gtf": GTF, "r.sam": sam.replace("r6_C1_U3\t0", "r6_C1_U3\t4"), "cells.sam": sam, "te.gtf": TE, "rm.out": REPEATMASKER, "list.txt": "C1\n\nC2\n"}.items():
        (at / name).write_text(text)
    return str(at)


def test_bulk(spark, files):
    out = flow.quantify(spark, f"{files}/a.gtf", f"{files}/r.sam", f"{files}/bulk")
    t = {r["Isoform"]: r for r in out["LR_EM_expression.out"].collect()}
    assert [round(t[k]["theta"], 6) for k in ("T1", "T2", "T3.1")] == [0.58682, 0.41318, 0.0]
    assert [round(t[k]["CPM"]) for k in ("T1", "T2", "T3.1")] == [586820, 413180, 0]
    assert round(t["T1"]["num_expected_LRs"], 5) == 1.76046 and t["T1"]["community_num_LRs"] == 3 and t["T3.1"]["community_num_LRs"] == 0
    history = out["EM_iterations.tsv"].where("Isoform = 'T1'").orderBy("iteration").collect()
    assert round(history[0]["theta"], 6) == 0.563636 and len(history) == 10
    written = tables.read_table(spark, f"{files}/bulk/Isoform_abundance.out")
    assert written.columns == ["Isoform", "Gene", "CPM", "num_expected_LRs"] and written.count() == 3


def test_command_line(spark, files):
    main(["quantify", "--annotation", f"{files}/a.gtf", "--alignments", f"{files}/r.sam", "--output", f"{files}/line"])
    assert tables.read_table(spark, f"{files}/line/LR_EM_expression.out").count() == 3


def test_cells_written_and_read_again(spark, files):
    counts, isos = flow.cell_counts(spark, f"{files}/a.gtf", f"{files}/cells.sam", whitelist=f"{files}/list.txt")
    want = {("C1", "T1"): 2, ("C1", "T2"): 1}  # a second read of the third molecule changes nothing
    assert {(r["barcode"], r["isoform"]): r["count"] for r in counts.collect()} == want
    summary = flow.write_cells(counts, isos, f"{files}/cells").first()
    assert tuple(summary) == (1, 1, 2, 3)
    back = tables.read_mex(spark, f"{files}/cells/SC_output/isoform")
    assert {(r["barcode"], r["feature"], r["alternate"]): r["value"] for r in back.collect()} == {("C1", "T1", "G1"): 2, ("C1", "T2", "G1"): 1}
    lines = [r[0] for r in spark.read.text(f"{files}/cells/SC_output/isoform/cpm_matrix.mtx").collect()]
    assert lines == ["%%MatrixMarket matrix coordinate real general", '%metadata_json: {"software_version": "strandflow"}', "3 1 2", "1 1 666666.6667", "2 1 333333.3333"]
    genes = tables.read_mex(spark, f"{files}/cells/SC_output/gene").collect()
    assert [(r["feature"], r["value"]) for r in genes] == [("G1", 3)]
    counts, _ = flow.assigned_counts(spark, f"{files}/a.gtf", f"{files}/cells.sam", s=EmSettings(umi_distance=1))
    assert {(r["barcode"], r["isoform"]): r["count"] for r in counts.collect()} == {("C1", "T1"): 1, ("C1", "T2"): 1}  # U1 and U3 differ in one place


def test_elements(spark, files):
    tpm = spark.createDataFrame([("T1", 10.0), ("T2", 5.0)], "isoform string, tpm double")
    out = flow.cal_te(spark, f"{files}/a.gtf", f"{files}/te.gtf", f"{files}/te", tpm)
    t = {r["transcript_id"]: r for r in out["transcript_quantification_with_TE.tsv"].collect()}
    assert len(t["T1"]) == 18 and (t["T1"]["transcript_TPM"], t["T1"]["num_TEs"], t["T1"]["TE_class"]) == (10.0, 2, "LINE;SINE")
    assert [t[k]["transcript_classification"] for k in ("T1", "T2", "T3.1")] == ["TE-Gene", "TE-Gene", "Gene-alone"]
    assert (t["T1"]["locus"], t["T1"]["length"], t["T1"]["overlap_length"], t["T3.1"]["locus"]) == ("1:151-190;1:180-320", "40;141", "40;41", "")
    d = {r["transcript_id"]: r for r in out["TE_derived_transcripts.tsv"].collect()}
    assert set(d) == {"T1", "T2"} and (d["T1"]["TE"], d["T2"]["TE"], d["T1"]["dominant_TE_all_repeat_name"]) == ("AluY.1", "L1HS.1", "L1HS.1")
    assert {r[0]: r["TE_expression"] for r in out["TE_family_exp_TPM.tsv"].collect()} == {"Alu": 15.0, "L1": 5.0}
    assert {r[0]: r["TE_expression"] for r in out["TE_loci_exp_TPM.tsv"].collect()} == {"AluY.1": 15.0, "L1HS.1": 5.0}
    assert tables.read_table(spark, f"{files}/te/TE_class_exp_TPM.tsv").count() == 2


def test_elements_by_cell(spark, files):
    flow.write_cells(*flow.cell_counts(spark, f"{files}/a.gtf", f"{files}/cells.sam"), f"{files}/units")
    out = flow.cal_te_units(spark, f"{files}/a.gtf", f"{files}/te.gtf", f"{files}/units/SC_output", f"{files}/units/te", TeSettings(output_loci=True))
    got = {(k, r["label"]): r["count"] for k, v in out.items() for r in v.collect()}
    want = {("class", "SINE"): 3, ("class", "LINE"): 1, ("family", "Alu"): 3, ("family", "L1"): 1, ("locus", "1:151-190"): 3, ("locus", "1:180-320"): 1, ("classification", "TE-Gene"): 3}
    assert want.items() <= got.items()
    assert tables.read_table(spark, f"{files}/units/te/family.tsv").columns == ["barcode", "Alu", "L1"]


def test_repeatmasker(spark, files):
    lines = [r[0].split("\t") for r in flow.repeatmasker_to_gtf(spark, f"{files}/rm.out").collect()]
    assert [x[:8] for x in lines] == [["1", "RepeatMasker", "exon", "151", "190", ".", "+", "."], ["1", "RepeatMasker", "exon", "300", "340", ".", "-", "."], ["2", "RepeatMasker", "exon", "5", "20", ".", "+", "."]]
    assert 'transcript_id "AluY.2"' in lines[1][8] and 'consensus_length "100"; truncated_proportion "0.4"' in lines[1][8]
    assert 'family_id "Simple_repeat"; class_id "Simple_repeat"' in lines[2][8]


def test_identifiability(spark, files):
    out = flow.identifiability(spark, f"{files}/a.gtf", f"{files}/k")
    k = {r["gene"]: r for r in out["kvalues_gene.out"].collect()}
    assert round(k["G1"]["k_value"], 5) == 0.41016 and out["kvalues_isoform.out"].count() == 3


def test_unused_mappings_by_quality(spark, files):
    m = MapSettings(multi_mapping="unique_only")
    reads, _ = flow.mapped_reads(spark, f"{files}/a.gtf", f"{files}/cells.sam", m)
    assert reads.agg(F.countDistinct("read")).first()[0] == 4


def test_a_matrix_too_large_to_copy(spark, tmp_path, monkeypatch):
    """Its parts stay in their order, and are read like a file."""
    from strandflow.operators import matrix

    monkeypatch.setattr(matrix, "COPIED", 0)
    rows = [(f"c{i % 7}", f"t{i % 11}", i + 1) for i in range(77)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        matrix.write_mex(spark.createDataFrame(rows, "barcode string, isoform string, count long"), str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = tables.read_mex(spark, str(tmp_path / "m")).collect()
    assert sorted((r["barcode"], r["feature"], r["value"]) for r in back) == sorted((b, t, float(n)) for b, t, n in rows) and (tmp_path / "m" / "matrix.mtx").is_dir()
