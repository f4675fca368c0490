"""Settings of the three dataflows, passed explicitly; the defaults are those of the command line."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapSettings:
    end_tolerance: int = 20
    junction_tolerance: int = 5
    least_block: int = 15
    multi_mapping: str = "best"  # best, unique_only (MAPQ >= 10) or no_filtering
    barcode_in_name: bool = True
    separator: str = "_"
    cell_tag: str = "CB"
    umi_tag: str = "UB"


@dataclass(frozen=True)
class EmSettings:
    iterations: int = 200
    tolerance: float = 1e-6
    likelihood: str = "form_2"  # form_1, form_2, no_read_length or no_isoform_specific
    initial_theta: str = "LR"  # LR counts multi-mapped reads in fractions, LR_unique does not
    umi_distance: int = 0  # names of molecules that differ in so many places count as one where reads are given to single isoforms
    #: Rows of a community that one task may hold; larger communities iterate as joins and grouped sums.
    rows_in_task: int = 2_000_000


@dataclass(frozen=True)
class ShortSettings:
    choice: str = "hybrid"  # SR: short reads alone decide, LR: long ones, hybrid: both, by alpha
    eff_len_rule: str = "kallisto"  # or rsem
    fragment_mean: float | None = None  # of all hits' lengths, unless given
    fragment_deviation: float | None = None


@dataclass(frozen=True)
class GlobalSettings:
    """Of the estimators that iterate over all isoforms at once, without communities."""

    iterations: int = 1000
    tolerance: float = 1e-3
    start: str = "LR"  # LR, SR or hybrid, each also with _unique; uniform or random
    seed: int = 0
    pseudo_counts: str = "below"  # below: isoforms whose start is under least_start get them; all: every isoform
    least_start: float = 0.0
    pseudo_long: float = 1.0
    pseudo_short: float | None = None  # one over the largest effective length, unless given
    #: Rows of reads that a task holds.
    rows_in_shard: int = 1_000_000


@dataclass(frozen=True)
class TeSettings:
    first_exon_threshold: float = 50.0
    total_threshold: float = 50.0
    overlap_threshold: int = 10
    ratio_threshold: float = 80.0
    feature_threshold: int = 50
    share_threshold: float = 0.5
    widest_table: int = 500
    output_loci: bool = False


@dataclass(frozen=True)
class KSettings:
    read_length: int = 150
    junction_length: int = 1
    weighted: bool = True
    minus_inner: bool = False  # weights by the bases of a read beyond a region's inner exons, instead of effective lengths
    tolerance: float = 0.0
    keep_isoform_copies: bool = True
