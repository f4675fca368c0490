"""python -m strandflow: runs from files to result tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandflow import flow
from strandflow.config import EmSettings, KSettings, MapSettings, ShortSettings, TeSettings
from strandflow.sources import tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandflow")
    runs = parser.add_subparsers(dest="run", required=True)
    for name in ("quantify", "cells"):
        p = runs.add_parser(name)
        p.add_argument("--annotation", required=True)
        p.add_argument("--alignments", required=True)
        p.add_argument("--multi-mapping", choices=("best", "unique_only", "no_filtering"), default="best")
        p.add_argument("--likelihood", choices=("form_1", "form_2", "no_read_length", "no_isoform_specific"), default="form_2")
        p.add_argument("--initial-theta", choices=("LR", "LR_unique"), default="LR")
        p.add_argument("--iterations", type=int, default=200)
        p.add_argument("--tolerance", type=float, default=1e-6)
        p.add_argument("--end-tolerance", type=int, default=20, help="bases that a read may reach beyond the ends of an isoform")
        p.add_argument("--junction-tolerance", type=int, default=5, help="bases that a read's junction may be off")
        p.add_argument("--least-block", type=int, default=15)
    p.add_argument("--whitelist")
    p.add_argument("--spatial", action="store_true")
    p.add_argument("--positions", help="places of spots, joined with their counts")
    p.add_argument("--by-best-isoform", action="store_true")
    p.add_argument("--umi-distance", type=int, default=0)
    p.add_argument("--barcode-tags", action="store_true", help="barcode and molecule are tags, not parts of read names")
    p = runs.choices["quantify"]
    p.add_argument("--short-alignments", help="short reads on transcripts")
    p.add_argument("--alpha", type=float, default=0.5, help="how much long reads weigh")
    p.add_argument("--alpha-table", help="communities and their alpha")
    p.add_argument("--choice", choices=("SR", "LR", "hybrid"), default="hybrid")
    p.add_argument("--effective-length", choices=("kallisto", "rsem"), default="kallisto")
    p.add_argument("--fragment-mean", type=float)
    p.add_argument("--fragment-deviation", type=float)
    p = runs.add_parser("cal-te")
    p.add_argument("--annotation", required=True)
    p.add_argument("--elements", required=True)
    p.add_argument("--quantified")
    p.add_argument("--matrix")
    p.add_argument("--output-loci", action="store_true")
    t = TeSettings()
    p.add_argument("--first-exon-threshold", type=float, default=t.first_exon_threshold)
    p.add_argument("--total-threshold", type=float, default=t.total_threshold)
    p.add_argument("--overlap-threshold", type=int, default=t.overlap_threshold)
    p.add_argument("--ratio-threshold", type=float, default=t.ratio_threshold)
    p.add_argument("--feature-threshold", type=int, default=t.feature_threshold)
    p.add_argument("--share-threshold", type=float, default=t.share_threshold)
    p = runs.add_parser("k-values")
    p.add_argument("--annotation", required=True)
    p.add_argument("--read-length", type=int, default=150)
    p.add_argument("--alignments", help="K-values of the regions that these reads leave, too")
    p.add_argument("--short", action="store_true", help="the alignments are of short reads")
    p = runs.add_parser("te-gtf")
    p.add_argument("--repeatmasker", required=True)
    for p in runs.choices.values():
        p.add_argument("--output", required=True)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("strandflow").getOrCreate()
    if a.run in ("quantify", "cells"):
        s = EmSettings(iterations=a.iterations, tolerance=a.tolerance, likelihood=a.likelihood, initial_theta=a.initial_theta, umi_distance=getattr(a, "umi_distance", 0))
        m = MapSettings(multi_mapping=a.multi_mapping, barcode_in_name=not getattr(a, "barcode_tags", False), end_tolerance=a.end_tolerance, junction_tolerance=a.junction_tolerance, least_block=a.least_block)
    if a.run == "quantify" and a.short_alignments:
        h = ShortSettings(a.choice, a.effective_length, a.fragment_mean, a.fragment_deviation)
        alpha = tables.read_alpha(spark, a.alpha_table) if a.alpha_table else a.alpha
        flow.quantify_with_short(spark, a.annotation, a.alignments, a.short_alignments, a.output, alpha, m, s, h)
    elif a.run == "quantify":
        flow.quantify(spark, a.annotation, a.alignments, a.output, m, s)
    elif a.run == "cells":
        count = flow.assigned_counts if a.by_best_isoform else flow.cell_counts
        counts, isos = count(spark, a.annotation, a.alignments, m, s, a.whitelist)
        flow.write_cells(counts, isos, a.output, a.spatial)
        if a.positions:
            flow.write_spots(counts, tables.read_positions(spark, a.positions), a.output)
    elif a.run == "cal-te":
        s = TeSettings(a.first_exon_threshold, a.total_threshold, a.overlap_threshold, a.ratio_threshold, a.feature_threshold, a.share_threshold, output_loci=a.output_loci)
        if a.matrix:
            flow.cal_te_units(spark, a.annotation, a.elements, a.matrix, a.output, s)
        else:
            flow.cal_te(spark, a.annotation, a.elements, a.output, tables.read_quantified(spark, a.quantified) if a.quantified else None, s)
    elif a.run == "k-values":
        flow.identifiability(spark, a.annotation, a.output, KSettings(read_length=a.read_length), a.alignments, a.short)
    else:
        flow.repeatmasker_to_gtf(spark, a.repeatmasker, a.output)


if __name__ == "__main__":
    main()
