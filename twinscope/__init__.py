"""twinscope: structural similarity and divergence analytics on Spark DataFrames.

The names in PUBLIC are the public surface; modules have more. They are imported when first asked for, so that
a Python worker loads only the module that its task needs.
"""

import importlib

__version__ = "0.2.0"
PUBLIC = {
    "twinscope.functions.imports": "import_findings",
    "twinscope.functions.metrics": "METRICS register_metric residual",
    "twinscope.functions.sketches": "estimate fnv1a32 signatures simhashes",
    "twinscope.operators.asymmetry": "sort_findings",
    "twinscope.operators.calls": "call_edges call_targets",
    "twinscope.operators.diff": "tree_diff",
    "twinscope.operators.families": "consensus families_by_metric label_divergence pool_families twin_families",
    "twinscope.operators.flow": "critical_path flow",
    "twinscope.operators.graph": "components merge_components reach",
    "twinscope.operators.index": "BandIndex",
    "twinscope.operators.pairs": "jaccard_pairs judged_pairs lsh_pairs metric_pairs overlap_pairs simhash_pairs text_sets twin_pairs",
    "twinscope.operators.report": "BatchSink annotate warnings",
    "twinscope.operators.units": "build_units inside register_language shingles units_in_time",
    "twinscope.operators.tables": "register_tables",
    "twinscope.operators.verdicts": "characterise escalations findings resolve",
    "twinscope.sources.corpus": "SUPPORTED cross_file_siblings package_roots read_cases read_files siblings",
    "twinscope.streaming.watch": "analyse analyse_targets compact_units late_files update_units watch watch_events",
}
_MODULE_OF = {name: module for module, names in PUBLIC.items() for name in names.split()}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str) -> object:
    if name not in _MODULE_OF:
        raise AttributeError(f"module 'twinscope' has no attribute {name!r}")
    return getattr(importlib.import_module(_MODULE_OF[name]), name)


def __dir__() -> list[str]:
    return [*__all__, "__version__"]
