"""Queries against their SQL twins on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from voxelgraph.operators import phenotype
from voxelgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    return sorted(repr([v for _, v in sorted(zip(columns, r), key=lambda x: x[0])]) for r in rows)


@pytest.mark.parametrize("name", ["organ_surface", "full_adjacency", "edge_features", "boundary_dice", "tumour_components", "tumour_distances", "phenotypes", "threshold_sweep", "label_counts", "beta_sweep", "edge_offsets", "kg_case_nodes", "gradient_by_region", "supernode_boundaries", "tumour_sizes"])
def test_same_rows_as_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    rel = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, rel.fetchall())


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_knowledge_graph_queries_with_all_relations_and_types(spark):
    found = registry._phenotypes(spark, SF).collect()
    slug = lambda prefix, name: f"{prefix}_{name.lower().replace(' ', '_')}"
    want = Counter()
    for r in found:
        t = f"case_{r.case_id}_tumor_{r.tumor_idx}"
        organ, disease = ("liver", "hepatocellular_carcinoma") if r.dataset == "LiTS" else ("pancreas", "pancreatic_adenocarcinoma")
        to = [("part_of", f"organ_{organ}"), ("suggestive_of", f"disease_{disease}"), ("located_in", f"anatomy_{r.subregion}"), ("has_stage", slug("stage", r.t_stage)), ("has_morphology", slug("obs", r.morphology))]
        to += [("has_feature", f"{t}_feat_{c}") for c in phenotype.KG_FEATURES]
        want.update((r.case_id, t, target, relation) for relation, target in to)
    assert Counter(map(tuple, registry.QUERIES["kg_all_edges"](spark, SF).collect())) == want
    stats = {(r.what, r.name): r.n for r in registry.QUERIES["kg_all_stats"](spark, SF).collect()}
    assert {n: k for (what, n), k in stats.items() if what == "edge"} == Counter(relation for *_, relation in want.elements())
    assert stats["node", "Observation"] == len({r.morphology for r in found}) and stats["node", "Tumor"] == len(found)


def test_distributions_of_all_node_features(spark, sql):
    got = entry.queries()["feature_distribution"](spark, SF)
    rel = sql.execute(entry.oracle_sql()["feature_distribution"])
    rows = [tuple(r) for r in got.collect()]
    assert {r[0] for r in rows} == {"volume", "boundary_length", "compactness", "elongation", "dominant_axis", "mean_intensity", "intensity_std"}
    assert _rows(got.columns, rows) == _rows([d[0] for d in rel.description], rel.fetchall())
