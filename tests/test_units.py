"""Operators and functions on small rows with known results."""

import base64
import gzip
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.functions import compositions as comp
from massloom.functions import score
from massloom.functions import sequences as seq
from massloom.operators import cluster, expressions, mixture, ordered, rangejoin, regress, space
from massloom.session import Scratch
from massloom.sources import spectra, text


def value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], list(cells)) if cells else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("rule", "cells", "expected"),
    [
        ("X + 1 + abs(-2Z) * 5", {"X": 5, "Z": 3}, 36),
        ("(2(x + 5)) + 5", {"x": 0}, 15),
        ("a > 1 & b < 2 | c = 3", {"a": 0, "b": 0, "c": 3}, True),
        ("(HexNAc - 1) > NeuAc", {"HexNAc": 3, "NeuAc": 2}, False),
        ("a >= 2b", {"a": 4, "b": 2}, True),
        ("a != b and a <= 3", {"a": 3, "b": 2}, True),
    ],
)
def test_expressions(spark, rule, cells, expected):
    assert value(spark, expressions.compile_rule(rule, F.col), **cells) == expected


@pytest.mark.parametrize("rule", ["a >", "(a", "a b", "1 $ 2"])
def test_broken_expressions(rule):
    with pytest.raises(ValueError):
        expressions.compile_rule(rule, lambda name: F.lit(1))


def test_rules_on_compositions(spark):
    made = F.create_map(F.lit("Hex"), F.lit(5), F.lit("HexNAc"), F.lit(4))
    assert value(spark, expressions.compile_rule("Hex > Fuc", expressions.in_map(made))) is True
    assert value(spark, expressions.ratio_rule(F.lit(1.0), F.lit(0.0), 1.0)) is False
    assert value(spark, expressions.ratio_rule(F.lit(1.0), F.lit(0.0), 1.0, required=False)) is True
    assert value(spark, expressions.range_rule(F.lit(5), 5, None)) is True


@pytest.mark.parametrize("line", ["{Hex:5; HexNAc:4}", "HexNAc(4)Hex(5)", "Hex:5 HexNAc:4"])
def test_composition_dialects(spark, line):
    parsed = comp.parse_any(F.lit(line))
    assert value(spark, parsed) == {"Hex": 5, "HexNAc": 4}
    assert value(spark, comp.to_text(parsed)) == "{Hex:5; HexNAc:4}"
    assert value(spark, comp.parse_any(F.lit("not a composition"))) is None


def test_composition_algebra(spark):
    a, b = comp.parse_any(F.lit("{A:2; B:1}")), comp.parse_any(F.lit("{B:3; C:1}"))
    assert value(spark, comp.distance(a, b)) == 5
    assert value(spark, comp.added(a, b)) == {"A": 2, "B": 4, "C": 1}
    assert value(spark, comp.linearised(a)) == ["A", "A", "B"]
    assert value(spark, comp.edge_weight(F.lit(0))) == 1 and value(spark, comp.edge_weight(F.lit(2))) == 0.5
    assert value(spark, comp.is_decoy_text(comp.to_text(comp.as_decoy(a)))) is True


def test_sequences(spark):
    peptides = value(spark, seq.digest(F.lit("AAKPBBRCCKDD"), seq.PROTEASES["trypsin"], 1, 1, 50))
    assert [(p["peptide"], p["start"], p["end"], p["missed"]) for p in peptides] == [("AAKPBBR", 0, 7, 0), ("AAKPBBRCCK", 0, 10, 1), ("CCK", 7, 10, 0), ("CCKDD", 7, 12, 1), ("DD", 10, 12, 0)]
    assert value(spark, seq.sites(F.lit("ANPTNNSTNG"), seq.N_SEQUON)) == [4, 5]
    assert value(spark, seq.accession(F.lit(">sp|P02763|A1AG1_HUMAN Alpha"))) == "P02763"
    assert value(spark, seq.wrapped(F.lit("ABCDEFG"), 3)) == "ABC\nDEF\nG"
    assert value(spark, seq.digest(F.lit(""), seq.PROTEASES["trypsin"], 1, 1, 50)) == []


def test_binomial_tail_and_its_end(spark):
    exact = lambda last: sum(math.comb(6, i) * 0.3**i * 0.7 ** (6 - i) for i in range(2, last + 1))
    assert value(spark, score.binomial_tail(F.lit(6), F.lit(2), F.lit(0.3))) == pytest.approx(exact(5))
    assert value(spark, score.binomial_tail(F.lit(6), F.lit(2), F.lit(0.3), inclusive=True)) == pytest.approx(exact(6))
    assert value(spark, score.binomial_tail(F.lit(6), F.lit(6), F.lit(0.3))) == 0


def test_counts_of_many(spark):
    counts = [0, 1, 63, 64, 65, 100, 169, 170, 171, 172, 400, 900]
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    n = F.col("n")
    tails = [score.binomial_tail(n, F.floor(n * 0.3).cast("long"), F.lit(0.3)), score.binomial_tail(n, F.floor(n / 2).cast("long"), F.lit(0.6), inclusive=True)]
    rows = df.select("n", score.log_factorial(n), score.decaying_count(n, 0.5, 1.0), score.decaying_count(n, 0.4, 1.5), *tails, score.hyperscore(n, n + 1, F.lit(0.0), F.lit(math.e))).collect()
    tail = lambda n, k, p, last: math.fsum(math.exp(math.log(math.comb(n, i)) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, last + 1))
    decay = lambda n, step, rate: math.fsum(step / (i + rate) for i in range(n))
    for n, *found in rows:
        log = lambda n: math.log(math.factorial(n))
        expected = [log(n), decay(n, 0.5, 1.0), decay(n, 0.4, 1.5), tail(n, n * 3 // 10, 0.3, n - 1), tail(n, n // 2, 0.6, n), log(n) + log(n + 1) + 1]
        assert found == pytest.approx(expected, rel=1e-11, abs=1e-12), n
    large = spark.range(1).select(score.log_factorial(F.lit(10**7)), score.decaying_count(F.lit(10**7), 0.5, 1.0)).first()
    assert list(large) == pytest.approx([math.lgamma(10**7 + 1), decay(10**7, 0.5, 1.0)], rel=1e-12)


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_ppm_join_against_all_pairs(spark, how):
    rng = random.Random(how)
    q = [(i, rng.choice([None, 0.0, rng.uniform(50, 60), rng.uniform(900, 5000)])) for i in range(80)]
    r = [(i, m * (1 + rng.uniform(-2e-3, 2e-3))) for i, (_, m) in enumerate(q) if m]
    queries, refs = spark.createDataFrame(q, "qid long, m double"), spark.createDataFrame(r, "rid long, ref double")
    pairs = {(i, j) for i, m in q if m for j, n in r if n > 0 and abs(n - m) <= m * 1e-3}
    hit = {i for i, _ in pairs}
    rows = rangejoin.ppm_join(queries, refs, "m", "ref", 1e-3, key=["qid"], how=how).collect()
    if how in ("semi", "anti"):
        assert sorted(x["qid"] for x in rows) == sorted(i for i, _ in q if (i in hit) == (how == "semi"))
    else:
        extra = {(i, None) for i, _ in q if i not in hit} if how == "left" else set()
        assert {(x["qid"], x["rid"]) for x in rows} == pairs | extra and len(rows) == len(pairs | extra)


def test_range_joins_plan_without_nested_loops(spark):
    q, r = spark.range(1000).select(F.col("id").alias("q"), F.rand(1).alias("m")), spark.range(1000).select(F.col("id").alias("r"), F.rand(2).alias("ref"))
    plan = rangejoin.ppm_join(q, r, "m", "ref", 1e-5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_overlaps_count_once(spark):
    rng = random.Random(6)
    spans = lambda n: [(i, s, s + rng.uniform(0, 40)) for i, s in ((i, rng.uniform(-50, 200)) for i in range(n))]
    a, b = spans(60), spans(60)
    found = rangejoin.overlap_join(spark.createDataFrame(a, "a long, s double, e double"), spark.createDataFrame(b, "b long, rs double, re double"), "s", "e", "rs", "re", 15.0).collect()
    assert sorted((x["a"], x["b"]) for x in found) == sorted((i, j) for i, s, e in a for j, rs, re in b if s <= re and rs <= e)


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_equal_a_global_window(spark, descending):
    rng = random.Random(7)
    rows = [(i, rng.choice([rng.random(), 0.5]), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k double, v long")
    found = {r["i"]: (r["total"], r["least"]) for r in ordered.running(df, "k", {"total": ("sum", "v"), "least": ("min", "v")}, descending, ["i"], cells=7).collect()}
    total, least = 0, math.inf
    for i, _, v in sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0])):
        total, least = total + v, min(least, v)
        assert found[i] == (total, least)


def test_greedy_clusters_replay(spark):
    rng = random.Random(11)
    rows = [(1, i, rng.choice([100.0, 100.2, 150.0]) + rng.uniform(0, 0.4), rng.uniform(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, i long, m double, w double")
    found = {}
    for r in cluster.greedy_mass_clusters(df, ["k"], "m", "w", "i", 1e-3).collect():
        found.setdefault((r["piece"], r["cluster"]), set()).add(r["i"])
    centres = []
    for _, i, m, w in sorted(rows, key=lambda r: (-r[3], r[1])):
        best = min(centres, key=lambda c: abs(c[0] - m), default=None)
        if best is None or abs(best[0] - m) > 1e-3 * m:
            centres.append([m, w, {i}])
        else:
            best[1] += w
            best[0] += (m - best[0]) * w / best[1]
            best[2].add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c[2]) for c in centres)


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(2 + 3 * a - b)) for a, b in zip(x, z, strict=True)], "x double, z double, y double")
    model = regress.fit_linear(df, {"x": F.col("x"), "z": F.col("z")}, F.col("y"))
    assert model.parameters == pytest.approx([2, 3, -1]) and model.residual_variance == pytest.approx(0, abs=1e-9)


def test_mixture_finds_two_components(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(8, 1, 1000)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    model = mixture.best_gaussians(*mixture.histogram(df, "v"))
    assert len(model.means) == 2
    assert model.means == pytest.approx([0, 8], abs=0.2) and model.weights == pytest.approx([0.75, 0.25], abs=0.02)
    assert mixture.k_means(*mixture.histogram(df, "v"), 2) == pytest.approx([0, 8], abs=0.3)
    gamma = mixture.fit_gammas(*mixture.histogram(df.filter("v > 0"), "v"), 1)
    assert gamma.weights.sum() == pytest.approx(1)


def test_bounded_product_leaves_out_the_empty_one(spark):
    rows = space.bounded_product(spark, {"a": (0, 2), "b": (0, 1)}, F.col("a") >= F.col("b")).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_rule_files():
    rules = text.parse_rules("; comment\nHex 3 12\nHexNAc 2 10\n\nHex > NeuAc\n(HexNAc - 1) > NeuAc\n\nignored")
    assert rules.bounds == {"Hex": (3, 12), "HexNAc": (2, 10)} and rules.constraints == ["Hex > NeuAc", "(HexNAc - 1) > NeuAc"]
    with pytest.raises(ValueError):
        text.parse_rules("Hex 5 3")


def test_mzml_arrays(spark, tmp_path):
    pack = lambda v, kind: base64.b64encode(zlib.compress(np.array(v, kind).tobytes())).decode()
    term = lambda a, v="": f'<cvParam accession="{a}" value="{v}"/>'
    array = lambda name, v, kind, bits: f"<binaryDataArray>{term(name)}{term('MS:1000574')}{term(bits)}<binary>{pack(v, kind)}</binary></binaryDataArray>"
    body = array("MS:1000514", [100.5, 200.25], "<f8", "MS:1000523") + array("MS:1000515", [7.0, 9.0], "<f4", "MS:1000521")
    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="x"><spectrum id="s1" index="0">{term("MS:1000511", "2")}{term("MS:1000016", "12.5")}{body}</spectrum></mzML>')
    row = spectra.read_mzml(spark, str(tmp_path)).first()
    assert (row["scan_id"], row["ms_level"], row["scan_time"], row["mz"], row["intensity"]) == ("s1", 2, 12.5, [100.5, 200.25], [7.0, 9.0])


def test_peff_and_compressed_fasta(spark, tmp_path):
    (tmp_path / "p.peff").write_text("# PEFF 1.0\n>nxp:A1 \\Length=4 \\PName=Some protein\nAC\nDE\n")
    row = text.read_peff(spark, str(tmp_path / "p.peff")).filter("sequence <> ''").first()
    assert row["sequence"] == "ACDE" and row["annotations"]["PName"] == "Some protein"
    (tmp_path / "f.fa.gz").write_bytes(gzip.compress(b">a x\nAC\nDE*\n>b\nFG\n"))
    assert sorted((r["name"], r["sequence"]) for r in text.read_fasta(spark, str(tmp_path / "f.fa.gz")).collect()) == [("a x", "ACDE"), ("b", "FG")]


def test_differing_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(ValueError):
        text.concatenate_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_scratch_tables_are_in_the_shared_folder(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(3), "numbers")
    assert kept._scratch_path.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/")) and kept.count() == 3
    scratch.drop(kept)
