"""What failed on larger tables, in small: scores far out, sites of many compositions, folded fragments, joins on exploded bins."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.operators import fdr, profiles, sites, spectrum
from massloom.plans.catalog import CATALOG

DATA = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{float(value):.9g}") + 0.0 if isinstance(value, float) else value


def test_scores_beyond_all_densities_have_no_error_probability(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 0.5), (0.5, 0.5)], "a double, b double")
    for pep in (fdr.component_pep(F.col("a"), F.col("b")), fdr.separated_pep(F.col("a"), F.col("b"), 0.5), fdr.product_pep(0.5, [F.col("a")], [F.col("b")])):
        found = [r["p"] for r in rows.select(pep.alias("p")).collect()]
        assert math.isnan(found[0]) and found[1:] == pytest.approx([0.0, 0.5])


FOLDED = {
    "F3": "classic_search", "F7": "back_filled_matches", "F8": "binomial_scorer", "F9": "compared_search", "F10": "frequency_scorer", "F11": "glycan_fragment_coverage", "F14": "fragment_frequencies",
    "F15": "log_intensity_scorers", "F16": "signal_utilisation", "F18": "told_apart", "F25": "localisation_scores", "F26": "coverage_weighted_binomial", "F28": "fragment_vectors",
    "F13": "bounded_cross_product", "F27": "distributed_orphans", "F29": "candidate_search", "F30": "signature_coverage_scorer", "F31": "coverage_scorer", "F32": "peptide_coverage_scorer", "": "glycan_scorers",
}


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """The smallest tables with all parts four times under other keys, some keys twice, and orders and lines twice."""
    root = tmp_path_factory.mktemp("copied")
    con = duckdb.connect()
    for name, sql in {
        "part": f"SELECT t.* REPLACE ((p_partkey + i * 300)::BIGINT AS p_partkey) FROM '{DATA}/part.parquet' t, range(4) r(i) UNION ALL SELECT * REPLACE (p_retailprice + 0.1 AS p_retailprice) FROM '{DATA}/part.parquet' WHERE p_partkey % 9 = 0",
        "orders": f"SELECT t.* REPLACE ((o_orderkey + i * 10000)::BIGINT AS o_orderkey) FROM '{DATA}/orders.parquet' t, range(2) r(i)",
        "lineitem": f"SELECT t.* REPLACE ((l_orderkey + i * 10000)::BIGINT AS l_orderkey) FROM '{DATA}/lineitem.parquet' t, range(2) r(i)",
        "nation": f"SELECT * FROM '{DATA}/nation.parquet'",
    }.items():
        con.execute(f"COPY ({sql}) TO '{root}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return str(root), con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", FOLDED.values())
def test_fragments_that_differ_in_name_alone_count_each(spark, copied, name):
    root, con = copied
    query, sql = CATALOG[name]
    found = query(spark, root)
    names = ", ".join(f'"{c}"' for c in sorted(found.columns))
    rows = sorted((tuple(plain(v) for v in r) for r in found.select(*sorted(found.columns)).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in con.execute(f"SELECT {names} FROM ({sql})").fetchall()), key=repr)


def test_matches_grow_with_distinct_fragments_only(spark):
    peaks = spark.createDataFrame([(1, 100.0, 5.0), (1, 200.0, 6.0), (2, 100.0, 7.0)], "scan long, mass double, intensity double")
    rows = [("A", i, 100.0) for i in range(500)] + [("A", 1000, 200.0), ("A", 1000, 100.0), ("B", 7, 200.0)]
    fragments = spark.createDataFrame(rows, "structure string, fragment long, fragment_mass double")
    precursors = spark.createDataFrame([(1, 1000.0), (2, 5000.0)], "scan long, precursor_mass double")
    structures = spark.createDataFrame([("A", 1000.0), ("B", 2000.0)], "structure string, structure_mass double")
    found = spectrum.match_precursors(peaks, spectrum.folded(fragments), precursors, structures).collect()
    assert sorted((r["scan"], r["structure"], r["fragment"], r["mass"], r["copies"], r["names"]) for r in found) == [(1, "A", 0, 100.0, 500, 500), (1, "A", 1000, 100.0, 1, 1), (1, "A", 1000, 200.0, 1, 1)]


def test_exploded_queries_are_not_sent_whole_to_the_driver(spark, copied):
    plan = CATALOG["precursor_probing"][0](spark, copied[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_predicted_candidates_meet_fragments_in_one_row(spark):
    from massloom.plans import predictive

    frame = spark.createDataFrame
    peaks = frame([(1, 100.0, 10.0), (1, 100.5, 100.0), (1, 300.0, 1000.0), (2, 100.0, 10.0)], "scan long, mass double, intensity double")
    candidates = frame([(1, 5, 7, 900.0, 2.0), (1, 6, 7, 900.0, 3.0), (2, 5, 8, 950.0, 1.0)], "scan long, glycan long, peptide long, peptide_mass double, glycan_score double")
    fragments = frame([(7, 1, 100.0, "b"), (7, 2, 300.0, "y"), (7, 3, 500.0, "b"), (8, 1, 400.0, "b"), (9, 1, 100.0, "b")], "peptide long, fragment int, fragment_mass double, series string")
    found = {(r["scan"], r["glycan"], r["peptide"]): r["score"] for r in predictive.score_predicted(peaks, candidates, fragments, 1e-2).collect()}
    own = (1 + 2 * (1 - 0.5**4) + 3) * 2 / 3
    assert found == pytest.approx({(1, 5, 7): own + 2, (1, 6, 7): own + 3})


def test_compositions_above_all_precursors_go_before_the_join(spark):
    from massloom.operators import coresearch

    glycans = spark.range(1, 2001).select(F.col("id").alias("glycan"), (F.col("id") * 100.0).alias("glycan_mass"))
    shifts = glycans.select("glycan", F.lit(0).alias("key"), F.lit(0.0).alias("shift"), F.lit(True).alias("is_core"))
    precursors = spark.createDataFrame([(1, 1000.0)], "scan long, precursor_mass double")
    peaks = spark.createDataFrame([(1, 700.0, 1.0), (1, 950.0, 1.0)], "scan long, mass double, intensity double")
    found = coresearch.ladder_matches(precursors, peaks, coresearch.ladder_index(glycans, shifts), 1e-4, 10.0)
    assert [r["glycan"] for r in found.collect()] == [3]
    read = [f for f in found.inputFiles() if "index" in f]
    assert spark.read.parquet(*read).count() == 10


def test_sites_of_many_compositions_are_solved_in_parts(spark):
    draw = np.random.default_rng(8)
    n = 70
    links = [(i, i + 1) for i in range(n - 1) if i not in (3, 8, 15, 16)] + [(20, 40), (21, 45), (50, 69)]
    a, b = (np.array(side) for side in zip(*links, strict=True))
    w = draw.random(len(a)) + 0.1
    observed = np.where(draw.random(n) < 0.6, draw.gamma(3.0, 3.0, n), np.nan)
    observed[4:9] = np.nan
    belongs = draw.random((n, 3)) * (draw.random((n, 3)) < 0.5)
    laplacian = np.zeros((n, n))
    for i, j, v in zip(a, b, w, strict=True):
        laplacian[[i, j], [i, j]] += v
        laplacian[[i, j], [j, i]] -= v
    values, press = sites.network_smooth(a, b, w, observed, 0.7, 1.0)
    plain, plain_press = sites.block_smooth(laplacian, observed, 0.7, 1.0)
    assert values == pytest.approx(plain) and press == pytest.approx(plain_press)
    means = belongs @ sites.neighbourhood_means(laplacian, observed, belongs, 0.7, 1.0)
    values, press = sites.network_smooth(a, b, w, observed, 0.7, 1.0, belongs)
    plain, plain_press = sites.block_smooth(laplacian, observed - means, 0.7, 1.0)
    assert values == pytest.approx(plain + means) and press == pytest.approx(plain_press)

    many = spark.range(6000).select(F.lit(1).alias("site"), "id", F.when(F.col("id") % 3 > 0, F.col("id") % 10 * 1.0).alias("observed"))
    edges = many.select("site", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight"))
    assert sites.smooth_sites(many, edges, "site", [1.0], [0.0]).count() == 6000  # more than 4000


def test_mzml_is_read_spectrum_by_spectrum(spark, tmp_path):
    from massloom.sources import spectra

    level = '<cvParam accession="MS:1000511" value="2"/>'
    (tmp_path / "a.mzML").write_text(f'<mzML><run><spectrumList><spectrum id="a>/b" index="0">{level}</spectrum>\n<spectrum id="none"/><spectrum\n id=\'s&lt;&amp;\' index="2">{level}</spectrum><spectrum id="last" index="3"/></spectrumList></run></mzML>')
    (tmp_path / "b.mzML").write_text(f'<x:mzML xmlns:x="y"><x:spectrum id="p" index="4">{level}</x:spectrum><x:spectrum id="q" index="5">{level}</x:spectrum></x:mzML>')
    found = spectra.read_mzml(spark, str(tmp_path))
    assert "binaryFile" not in found._jdf.queryExecution().toString()  # a document is not held whole
    assert sorted((r["index"], r["scan_id"], r["ms_level"]) for r in found.collect()) == [(0, "a>/b", 2), (0, "none", 1), (2, "s<&", 2), (3, "last", 1), (4, "p", 2), (5, "q", 2)]


def test_equal_masses_are_looked_up_once(spark):
    """Of 300 lines and 300 orders of one price only one pair is compared."""
    from massloom.plans.search import search_and_rate

    lines = spark.range(300).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(100.0).alias("l_extendedprice"))
    orders = spark.range(1, 301).select(F.col("id").alias("o_orderkey"), F.lit(100.0).alias("o_totalprice"))
    out = search_and_rate(lines, orders, 1e-5)
    assert [(r["targets"], r["decoys"]) for r in out.collect()] == [(300, 0)]


def test_orphans_of_one_mass_and_time_are_looked_up_once(spark):
    orphans = spark.createDataFrame([(i, 100.0, 5.0) for i in range(50)] + [(50, 200.0, 5.0)], "o long, m double, t double")
    features = spark.createDataFrame([(i, 100.0, 1.0, 4.0) for i in range(3, 60)] + [(99, 100.0, 1.0, 9.5)], "feature long, feature_mass double, start double, end double")
    found = profiles.distribute_orphans(orphans, features, "m", "t", ["o", "m", "t"], 1e-5, 2.0).collect()
    assert sorted((r["o"], r["feature"], r["distance"]) for r in found) == [(i, 3, 1.0) for i in range(50)] + [(50, None, None)]
