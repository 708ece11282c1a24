"""The subpackage's queries and their SQL twins, by name."""

from __future__ import annotations

from functools import wraps

from voxelgraph.llm import clustering, fim, fingerprints, language, licenses, mixing, packing, pii, quality, sharding, simhash, token_counts, topk
from voxelgraph.session import ship


def _shipped(query):
    """A query whose operator runs Python on the executors."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(ship(spark), sf_dir)

    return run


QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_licenses": licenses.op2_licenses,
    "op3_topk": _shipped(topk.op3_topk),
    "op4_pii": pii.op4_pii,
    "op5_token_counts": _shipped(token_counts.op5_token_counts),
    "op6_fingerprints": _shipped(fingerprints.op6_fingerprints),
    "op7_packing": _shipped(packing.op7_packing),
    "op8_simhash": _shipped(simhash.op8_simhash),
    "op9_mixing": mixing.op9_mixing,
    "op10_quality": _shipped(quality.op10_quality),
    "op11_language": language.op11_language,
    "op12_fim": fim.op12_fim,
    "op13_clusters": clustering.op13_clusters,
}

ORACLES = {
    "op2_licenses": licenses.OP2_SQL,
    "op3_topk": topk.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_fim": fim.OP12_SQL,
    "op13_clusters": clustering.OP13_SQL,
}
