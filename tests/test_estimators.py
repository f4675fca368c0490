"""Estimators over all isoforms at once against plain loops, joint runs from files, and the plan of a round."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow import flow
from strandflow.__main__ import main
from strandflow.config import EmSettings, GlobalSettings, ShortSettings
from strandflow.functions.lengths import with_effective_length
from strandflow.operators import global_em as estimators
from strandflow.operators.hits import effective_lengths, hit_densities, length_model, short_start
from strandflow.operators.likelihood import conditional_probabilities
from strandflow.plans import contract
from strandflow.sources import tables
from tests.test_flow import GTF, READS

SF = "/root/testdata/sf0.001"


def plain_em(p: dict, theta: dict, eff: dict, alpha: float, tolerance: float, rounds: int) -> tuple[dict, int]:
    """p: (side, read, isoform) -> value."""
    by_read = defaultdict(list)
    for (side, read, i), v in p.items():
        by_read[side, read].append((i, v))
    for k in range(1, rounds + 1):
        q = {"L": defaultdict(float), "S": defaultdict(float)}
        for (side, _), hits in by_read.items():
            w = [v * theta[i] * (eff[i] if side == "S" else 1) for i, v in hits]
            for (i, _), x in zip(hits, w, strict=True):
                q[side][i] += x / (sum(w) or 1)
        mass = sum(theta[i] * eff[i] for i in theta)
        total = {s: sum(x.values()) for s, x in q.items()}
        new = {i: ((1 - alpha) * q["S"][i] + alpha * q["L"][i]) / ((1 - alpha) * total["S"] * eff[i] / mass + alpha * total["L"]) for i in theta}
        every = sum(new.values())
        new = {i: x / every for i, x in new.items()}
        moved = any(x > 1e-7 and abs(theta[i] - x) > tolerance * x for i, x in new.items())
        theta = new
        if not moved:
            break
    return theta, k


@pytest.fixture(scope="module")
def kinds(spark):
    """Long and short reads of one small graph, with isoforms that no read fits."""
    rng = np.random.default_rng(5)
    rows = [(s, f"{s}{r}", int(i), float(rng.random())) for s in "LS" for r in range(120) for i in rng.choice(30, rng.integers(1, 4), replace=False)]
    rows += [("L", f"Lagain{r}", *x[2:]) for r in range(40) for x in rows if x[1] == "L0"]  # many reads of the same values
    iso = [(i, float(10 + 7 * (i % 5))) for i in range(33)]
    df = spark.createDataFrame(rows, "side string, read string, isoform long, p double")
    return rows, dict(iso), df.where("side = 'L'").drop("side"), df.where("side = 'S'").drop("side"), spark.createDataFrame(iso, "isoform long, eff_len double")


@pytest.mark.parametrize("alpha", [0.0, 0.35, 1.0])
def test_both_kinds_until_they_settle(kinds, alpha):
    """Shards of a few rows and of all give the same as a plain loop, round for round."""
    rows, eff, long, short, iso = kinds
    start = estimators.start_theta(iso, None, None, GlobalSettings(start="uniform"))
    want, k = plain_em({x[:3]: x[3] for x in rows}, dict.fromkeys(eff, 1 / 33), eff, alpha, 0.5, 5)
    for held in (10, 10**6):
        out = estimators.global_em(iso, start, long, short, alpha, s=GlobalSettings(tolerance=0.5, iterations=5, rows_in_shard=held))
        assert {r["isoform"]: r["theta"] for r in out.expression.collect()} == pytest.approx(want, abs=1e-9) and len(out.rounds) == k
    if alpha == 1.0:
        likely = [x["long"] for x in out.rounds]
        assert likely == sorted(likely)


def test_starts(kinds, spark):
    _, eff, _, _, iso = kinds
    long = spark.createDataFrame([(0, 6.0), (1, 1.0), (2, 3.0)], "isoform long, theta0 double")
    short = spark.createDataFrame([(1, 0.5), (3, 1.5)], "isoform long, theta0 double")

    def start(**s):
        return {r["isoform"]: r["theta0"] for r in estimators.start_theta(iso, long, short, GlobalSettings(**s)).collect() if r["theta0"]}

    assert start(start="LR") == pytest.approx({0: 0.6, 1: 0.1, 2: 0.3}) and start(start="SR") == pytest.approx({1: 0.25, 3: 0.75})
    assert start(start="hybrid_unique") == pytest.approx({0: 0.3, 1: 0.175, 2: 0.15, 3: 0.375})
    assert start(start="LR", least_start=0.2) == pytest.approx({i: x / 41 for i, x in {0: 6, 2: 3, 1: 2, **{j: 1 for j in range(3, 33)}}.items()})
    every = start(start="hybrid", pseudo_counts="all", pseudo_long=1.0, pseudo_short=0.5)
    assert every[32] == pytest.approx((1 / 43 + 0.5 / 18.5) / 2) and sum(every.values()) == pytest.approx(1)
    one, same, other = start(start="random", seed=1), start(start="random", seed=1), start(start="random", seed=2)
    assert one == same != other and len(one) == 33 and sum(one.values()) == pytest.approx(1)
    with pytest.raises(ValueError, match="no start"):
        start(start="nothing")
    none = estimators.global_em(iso, estimators.start_theta(iso, None, None), spark.createDataFrame([], "read string, isoform long, p double"))
    assert none.expression.agg(F.sum("theta")).first()[0] == 0


def test_reads_stay_in_their_shards(spark, kinds):
    """Only numbers of isoforms are shuffled in a round: the reads' side of the cogroup has no exchange."""
    _, _, long, _, iso = kinds
    plans = []
    real = estimators.materialize

    def seen(df, what):
        if what == "sums":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, what)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(estimators, "materialize", seen)
        estimators.global_em(iso, estimators.start_theta(iso, None, None, GlobalSettings(start="uniform")), long, s=GlobalSettings(iterations=1))
    below = plans[0].split("FlatMapCoGroupsInPandas", 1)[1]
    bucketed = [x for x in below.split("\n") if "Bucketed: true" in x]
    assert len(bucketed) == 1 and below[: below.index("Bucketed: true")].count("Exchange hashpartitioning(shard") == 0, below


def test_communities_and_all_at_once_agree(spark):
    """Within a read's community nothing outside it matters: after each round both forms have the same shares of a community."""
    ri, iso = contract._read_isoform(spark, SF), contract._isoforms(spark, SF)
    names = iso.select("isoform", F.col("iso_len").cast("double").alias("eff_len"))
    s = GlobalSettings(iterations=1, tolerance=0.0, start="uniform")
    p = conditional_probabilities(ri, iso).select("read", "isoform", "p")
    out = estimators.global_em(names, estimators.start_theta(names, None, None, s), p, s=s).expression.toPandas().set_index("isoform")["theta"]
    from strandflow.operators.em import bulk_em

    every = bulk_em(contract._communities(spark, SF), EmSettings(iterations=1, tolerance=0.0)).toPandas().set_index("isoform")
    total = every["expected_reads"].sum()
    assert (every["expected_reads"] / total).to_dict() == pytest.approx(out[every.index].to_dict(), abs=1e-9)


def test_effective_lengths_and_densities(spark):
    hits = spark.createDataFrame([("f1", "T1", 100), ("f1", "T2", 120), ("f1", "T1", 90), ("f2", "T2", 140)], "frag string, isoform string, frag_len long")
    isos = spark.createDataFrame([("T1",), ("T2",), ("T9",)], "isoform string")
    refs = spark.createDataFrame([("T1", 300), ("T2", 60), ("T7", 10)], "isoform string, length long")
    mean, sd = length_model(hits)
    assert mean == 112.5 and sd == pytest.approx(np.std([100, 120, 90, 140]))
    eff = {r[0]: r[1] for r in effective_lengths(isos, refs, (mean, sd)).collect()}

    def plain(n: int) -> float:
        w = {i: math.exp(-(((i - mean) / sd) ** 2) / 2) for i in range(1, n + 1)}
        return max(1, n - sum(i * x for i, x in w.items()) / sum(w.values()) + 1)

    assert eff == pytest.approx({"T1": plain(300), "T2": plain(60), "T9": 1})
    lengths = spark.createDataFrame([(10,), (60,), (300,)], "length long")
    both = [{r[0]: r[1] for r in with_effective_length(lengths, 112.5, 10.0, rule).collect()} for rule in ("kallisto", "rsem")]
    assert both[0] == pytest.approx(both[1], abs=1e-6) and both[0][10] == both[0][60] == 1
    assert with_effective_length(lengths, 100.0, 0.0).orderBy("length").collect()[-1]["eff_len"] == 201
    d = hit_densities(hits, effective_lengths(isos, refs, (mean, sd)), (mean, sd))
    got = {(r[0], r[1]): r[2] for r in d.collect()}
    assert set(got) == {("f1", "T1"), ("f1", "T2"), ("f2", "T2")}
    assert got["f1", "T1"] == pytest.approx(math.exp(-(((100 - mean) / sd) ** 2) / 2) / (sd * math.sqrt(math.pi)) / plain(300))
    e = effective_lengths(isos, refs, (mean, sd))
    assert {r[0]: r[1] for r in short_start(d, e).collect()} == pytest.approx({"T1": 0.5 / plain(300), "T2": 1.5 / plain(60)})
    assert {r[0]: r[1] for r in short_start(d, e, unique=True).collect()} == pytest.approx({"T1": 0, "T2": 1 / plain(60)})


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("joint")
    long = "@SQ\tSN:1\tLN:1000\n" + "".join(f"{n}\t{f}\t1\t{p}\t60\t{c}\t*\t0\t0\tA\tI\n" for n, f, p, c in READS)
    short = "@SQ\tSN:T1|g\tLN:200\n@SQ\tSN:T2\tLN:250\n@SQ\tSN:T3.1\tLN:200\n"
    for k, (n, *on) in enumerate([(120, "T1|g", "T2"), (130, "T2"), (110, "T3.1"), (125, "T1|g"), (120, "T1|g", "T2")]):
        short += "".join(f"f{k}\t99\t{t}\t5\t60\t50M\t=\t9\t{x}\tA\tI\n" for t in on for x in (n, -n))
    for name, text in {"a.gtf": GTF, "long.sam": long, "short.sam": short, "alpha.tsv": "id\terror\talpha\nG1\t0.1\t1.0\n"}.items():
        (at / name).write_text(text)
    return str(at)


def test_joint_run(spark, files):
    args = (spark, f"{files}/a.gtf", f"{files}/long.sam", f"{files}/short.sam")
    t = {r["Isoform"]: r for r in flow.quantify_with_short(*args)["Isoform_abundance.out"].collect()}
    assert t["T3.1"]["num_expected_SRs"] == 1 and t["T1"]["num_expected_SRs"] + t["T2"]["num_expected_SRs"] == pytest.approx(4)
    assert sum(r["TPM"] for r in t.values()) == pytest.approx(1e6) and t["T1"]["num_expected_LRs"] + t["T2"]["num_expected_LRs"] == pytest.approx(3)
    by = {c: {r["Isoform"]: r["theta"] for r in flow.quantify_with_short(*args, h=ShortSettings(choice=c))["SR_EM_expression.out"].collect()} for c in ("SR", "LR")}
    alone = {r["Isoform"]: r["theta"] for r in flow.quantify(*args[:3])["LR_EM_expression.out"].collect()}
    assert by["LR"]["T1"] == pytest.approx(alone["T1"], abs=1e-6) and abs(by["SR"]["T1"] - alone["T1"]) > 0.01
    out = f"{files}/out"
    main(["quantify", "--annotation", args[1], "--alignments", args[2], "--short-alignments", args[3], "--alpha-table", f"{files}/alpha.tsv", "--effective-length", "rsem", "--junction-tolerance", "4", "--output", out])
    got = tables.read_table(spark, f"{out}/SR_EM_expression.out")
    assert got.count() == 3 and {r["Isoform"]: r["theta"] for r in got.collect()}["T1"] == pytest.approx(alone["T1"], abs=1e-6)
    assert tables.read_table(spark, f"{out}/Isoform_abundance.out").columns == ["Isoform", "Gene", "Effective length", "TPM", "num_expected_SRs", "num_expected_LRs"]


def test_command_line_of_spots(spark, files, tmp_path):
    (tmp_path / "positions.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nC1,1,2,3,4.5,5.5\n")
    main(["cells", "--annotation", f"{files}/a.gtf", "--alignments", f"{files}/long.sam", "--spatial", "--positions", str(tmp_path / "positions.csv"), "--output", str(tmp_path)])
    rows = tables.read_table(spark, f"{tmp_path}/ST_output/spots.tsv").collect()
    assert rows and all(r["array_row"] == 2 and r["array_col"] == 3 for r in rows)
