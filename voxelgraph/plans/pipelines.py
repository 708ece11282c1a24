"""User-level jobs composed of the operators; every step is a table keyed by case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgraph.functions import scalars
from voxelgraph.operators import contract, evaluate, features, learn, phenotype, report, search, whole
from voxelgraph.operators import edges as E
from voxelgraph.session import staged
from voxelgraph.sources import volumes

SWEEP = [round(0.05 * k, 2) for k in range(1, 20)]


@dataclass(frozen=True)
class Settings:
    """What distinguishes the jobs."""

    window: tuple[float, float]
    method: str = "adaptive"
    psi: float = 0.1
    alpha: float = 0.1
    beta_min: int = 10
    beta_max: int = 500_000
    m_min: float = -1e9
    m_max: float = 1e9
    bins: int = 8
    stride: int = 20


PANCREAS = Settings((20, 180), psi=0.12, alpha=0.12)
LIVER = Settings((0, 200))
RESUMABLE = Settings((-50, 250), psi=0.03, alpha=0.20, beta_min=5, m_min=0.05, m_max=0.95)
LIGHT = Settings((0, 200), psi=0.01, alpha=0.20, beta_min=2)
QUANTIZED = Settings((0, 200), method="quantized", beta_min=50)
GROUPING = Settings((-150, 250), psi=0.05, alpha=0.02)


def windowed(voxels: DataFrame, s: Settings) -> DataFrame:
    return voxels.withColumn("v", scalars.hu_window(F.col("hu"), *s.window)).drop("hu")


def _labelled(voxels: DataFrame, s: Settings) -> DataFrame:
    return contract.labelled(windowed(voxels, s), "v", s.method, s.psi, s.alpha, s.beta_min, s.beta_max, s.m_min, s.m_max, s.bins, s.stride)[1]


def _rows(voxels: DataFrame, s: Settings, around: bool) -> DataFrame | None:
    """``whole.region_rows``, written, where all cases lie in one brick; else None."""
    small, wide = whole.by_extent(windowed(voxels, s))
    if wide is not None or s.method not in ("adaptive", "anchored", "quantized"):
        return None
    return staged(whole.region_rows(small, "v", s.method, s.psi, s.alpha, s.bins, s.stride, (s.beta_min, s.beta_max, s.m_min, s.m_max), around))


def _of_rows(rows: DataFrame, cases: DataFrame, around: bool) -> dict[str, DataFrame]:
    regions = rows.where("n is not null")
    m = {"labels": rows.where("n is null").select("case_id", "x", "y", "z", "lin", "seg", "label")} if around else {}
    return m | {"rows": regions, "counts": staged(features.counts_of_rows(regions)), "nodes": staged(features.nodes_of_rows(regions, cases))}


def measured(voxels: DataFrame, cases: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """``labels``, ``counts`` and ``nodes`` of every case's regions, without their edges.

    Of cases in one brick ``labels`` has the voxels of the organ and of tumour regions alone, which is where grouped
    tumours and their distances are measured.
    """
    rows = _rows(voxels, s, True)
    if rows is not None:
        return _of_rows(rows, cases, True)
    labels = _labelled(voxels, s)
    return {"labels": labels, "counts": staged(features.label_counts(labels)), "nodes": staged(features.node_features(labels, "v", cases))}


def minors(voxels: DataFrame, cases: DataFrame, s: Settings, labels: str = "all") -> dict[str, DataFrame]:
    """The minor of every case with its counts, node and edge features and targets, each staged once.

    labels: ``all`` voxels, those ``around`` tumours as ``measured`` has them, or ``none``. But for ``all``, cases in one
    brick send tables of regions back from Python, not voxels.
    """
    rows = _rows(voxels, s, labels == "around") if labels != "all" else None
    if rows is not None:
        m = _of_rows(rows, cases, labels == "around")
        m["all_edges"] = staged(features.adjacency_of_rows(m["rows"]))
        m["edges"] = m["all_edges"].where(F.col("mean_diff") <= s.alpha)
    else:
        m = contract.build_minor(windowed(voxels, s), "v", s.method, s.psi, s.alpha, s.beta_min, s.beta_max, s.m_min, s.m_max, s.bins, s.stride)
        m["counts"] = staged(features.label_counts(m["labels"]))
        m["nodes"] = staged(features.node_features(m["labels"], "v", cases))
    m["edge_features"] = staged(features.edge_features(m["all_edges"], m["nodes"], m["all_edges"], cases))
    m["targets"] = features.node_target(m["counts"])
    return m


def _classified(graph: DataFrame, counts: DataFrame, splits: DataFrame, sweep: bool, models: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(regions with ``pred``, the sweep or an empty choice), trained on the train split and chosen on validation."""
    marked = staged(graph.join(splits, "case_id"))
    val = marked.where("split = 'val'")
    _, model = learn.train_node_classifier(marked.where("split = 'train'"), val, models)
    scored = staged(learn.predict_probability(model, marked))
    if not sweep:
        return scored.withColumn("pred", F.col("argmax")), scored.limit(0)
    held = counts.join(splits.where("split = 'val'"), "case_id", "left_semi")
    table = staged(learn.threshold_sweep(scored, held, SWEEP))
    best = table.where("best").select("threshold")
    return scored.crossJoin(F.broadcast(best)).withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int")).drop("threshold"), table  # one row


def _scores(pred: DataFrame, counts: DataFrame, splits: DataFrame) -> DataFrame:
    chosen = counts.join(pred.select("case_id", "label", "pred"), ["case_id", "label"], "left")
    return evaluate.count_scores(chosen, F.coalesce(F.col("pred") == 1, F.lit(False))).join(splits, "case_id")


def _classify(m: dict[str, DataFrame], splits: DataFrame, sweep: bool = True, nodes: DataFrame | None = None, columns: tuple[str, ...] = features.NODE_FEATURES, hops: int = 0, models: tuple[str, ...] = ("logistic",)) -> dict[str, DataFrame]:
    graph, links = features.assemble_graph(m["nodes"] if nodes is None else nodes, m["edge_features"], m["targets"], columns)
    graph = staged(learn.khop_features(graph, links, hops) if hops else graph)
    m["pred"], m["sweep"] = _classified(graph, m["counts"], splits, sweep, models)
    m["pred"] = staged(m["pred"])
    m["scores"] = staged(_scores(m["pred"], m["counts"], splits))
    m["summary"] = evaluate.split_summary(m["scores"].drop("split"), splits)
    return m


def _described(m: dict[str, DataFrame], cases: DataFrame, chosen: DataFrame, prefix: str) -> None:
    far = phenotype.min_distance_per_label(m["labels"], cases, chosen)
    m[f"{prefix}_phenotypes"] = staged(phenotype.phenotypes(m["nodes"], chosen, far, cases))


def pancreas_pipeline(voxels: DataFrame, cases: DataFrame, s: Settings = PANCREAS, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Minors, oracle, classifier with threshold sweep, phenotypes from truth and prediction, graph, comparison."""
    splits = volumes.split_cases(cases) if splits is None else splits
    m = minors(voxels, cases, s)
    m["oracle"], m["loss"] = evaluate.oracle(m["counts"]), evaluate.deletion_loss(m["counts"])
    m = _classify(m, splits)
    _described(m, cases, phenotype.select_tumour_nodes(m["counts"]), "gt")
    _described(m, cases, m["pred"].where("pred = 1").select("case_id", "label"), "pred")
    m["kg_nodes"] = phenotype.dedupe_nodes(phenotype.kg_nodes(m["pred_phenotypes"], cases))
    m["kg_edges"] = phenotype.kg_edges(m["pred_phenotypes"])
    m["kg_stats"] = phenotype.kg_stats(m["kg_nodes"], m["kg_edges"])
    m["comparison"] = report.compare_case(phenotype.gt_phenotypes(voxels, cases), m["gt_phenotypes"])
    return m


def liver_pipeline(voxels: DataFrame, cases: DataFrame, reference: DataFrame, s: Settings = LIVER, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Minors, classifier by the larger score, grouped tumours, comparison of means with the reference rows."""
    splits = volumes.split_cases(cases) if splits is None else splits
    m = _classify(minors(voxels, cases, s, "around"), splits, sweep=False)
    _described(m, cases, phenotype.select_tumour_nodes(m["counts"]), "gt")
    m["grouped"] = staged(phenotype.group_tumours(m["labels"], m["nodes"], m["counts"], cases))
    m["means"] = report.compare_means(reference, m["gt_phenotypes"])
    m["categories"] = report.category_distribution(m["gt_phenotypes"], ("morphology", "t_stage", "subregion"))
    return m


def resumable_pipeline(voxels: DataFrame, cases: DataFrame, store: str, s: Settings = RESUMABLE, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """As the liver job without phenotypes; each stage's finished cases are read from ``store``, not rebuilt.

    Finished is what the store's manifest says for these settings; ``m["built"]`` tells how many cases each stage built.
    """
    kept = volumes.Store(voxels.sparkSession, store, repr(s))
    own = lambda todo, df: df.join(todo.select("case_id"), "case_id", "left_semi")

    def contracted(todo: DataFrame) -> DataFrame:
        return _labelled(own(todo, voxels), s)

    labels = kept.stage("labels", cases, contracted)
    m = {"labels": labels}
    m["counts"] = kept.stage("counts", cases, lambda todo: features.label_counts(own(todo, labels)))
    m["all_edges"] = kept.stage("edges", cases, lambda todo: E.full_adjacency(staged(own(todo, labels)), "v"))
    m["nodes"] = kept.stage("nodes", cases, lambda todo: features.node_features(own(todo, labels), "v", cases))
    m["edge_features"] = kept.stage("edge_features", cases, lambda todo: features.edge_features(own(todo, m["all_edges"]), own(todo, m["nodes"]), own(todo, m["all_edges"]), cases))
    m["edges"], m["targets"] = m["all_edges"].where(F.col("mean_diff") <= s.alpha), features.node_target(m["counts"])
    m["oracle"] = evaluate.oracle(m["counts"])
    m = _classify(m, volumes.split_cases(cases) if splits is None else splits, sweep=False)
    m["built"] = kept.built
    return m


def two_stage_pipeline(voxels: DataFrame, cases: DataFrame, s: Settings = LIVER, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Regions mostly in the organ first, then tumours among them; a case without such regions scores 0 (1 if it has no tumour)."""
    splits = volumes.split_cases(cases) if splits is None else splits
    m = minors(voxels, cases, s)
    context = staged(features.context_features(m["labels"], m["nodes"], "v", cases))
    nodes, links = features.organ_subgraph(context, m["edge_features"])
    m["edge_features"] = links
    return _classify(m, splits, nodes=nodes, columns=(*features.NODE_FEATURES, "liver_fraction", "relative_intensity"))


def context_pipeline(voxels: DataFrame, cases: DataFrame, s: Settings = LIVER, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Eleven features: the regions' own and their organ context."""
    m = minors(voxels, cases, s)
    nodes = staged(features.context_features(m["labels"], m["nodes"], "v", cases))
    return _classify(m, volumes.split_cases(cases) if splits is None else splits, nodes=nodes, columns=(*features.NODE_FEATURES, *features.CONTEXT_FEATURES))


def light_deletion_pipeline(voxels: DataFrame, cases: DataFrame, s: Settings = LIGHT, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    return _classify(minors(voxels, cases, s, "none"), volumes.split_cases(cases) if splits is None else splits, hops=1)


def diagnose(voxels: DataFrame, cases: DataFrame, n: int = 20, method: str = "adaptive", splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sweep of named configurations on sampled cases, then the best one's classifier, threshold sweep and scores."""
    sample = staged(volumes.sample_cases(cases, n))
    kept = staged(voxels.join(sample, "case_id", "left_semi"))
    own = cases.join(sample, "case_id", "left_semi")
    sweep = staged(search.config_sweep(windowed(kept, LIVER), "v", method=method))
    name = sweep.where("best").first()["config"]
    psi, alpha, lo, hi, m0, m1 = search.NAMED[name]
    s = Settings(LIVER.window, method, psi, alpha, lo, hi, m0, m1, bins=scalars.psi_bins(psi))
    m = _classify(minors(kept, own, s), volumes.split_cases(own) if splits is None else splits)
    m["configs"] = sweep
    return m


def quantized_pipeline(voxels: DataFrame, cases: DataFrame, s: Settings = QUANTIZED, splits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Components of eight intensity bins, features, classifier, Dice; regions hold at most a third of a case."""
    largest = cases.agg(F.max(F.expr("nx * ny * nz"))).first()[0] or 0
    s = Settings(s.window, s.method, s.psi, s.alpha, s.beta_min, max(1, largest // 3), s.m_min, s.m_max, s.bins, s.stride)
    return _classify(minors(voxels, cases, s, "none"), volumes.split_cases(cases) if splits is None else splits)


def export_masks(voxels: DataFrame, cases: DataFrame, path: str, s: Settings = LIVER) -> DataFrame:
    """Write each case's three-class mask; returns the Dice of both classes."""
    labels = _labelled(voxels, s)
    counts = staged(features.label_counts(labels))
    volumes.write_mask(evaluate.three_class_mask(labels, counts), path)
    return evaluate.class_dice_of_counts(counts)


def grouping_report(voxels: DataFrame, cases: DataFrame, reference: DataFrame, s: Settings = GROUPING) -> dict[str, DataFrame]:
    """Grouped tumours of the cases that have one, beside the reference rows."""
    kept = voxels.join(staged(voxels.where("seg = 2").select("case_id").distinct()), "case_id", "left_semi")
    m = measured(kept, cases, s)
    grouped = staged(phenotype.group_tumours(m["labels"], m["nodes"], m["counts"], cases))
    organ = volumes.case_summary(kept).select("case_id", F.col("organ").alias("o"))
    rows = grouped.join(organ, "case_id").withColumn("coverage_pct", phenotype.coverage("organ", F.col("volume"), organ=F.col("o")))
    return {"grouped": grouped, "means": report.compare_means(reference, rows), "categories": report.category_distribution(grouped, ("morphology", "t_stage", "subregion"))}
