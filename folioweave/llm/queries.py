"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_OPS = {
    "op1_hash_tree_sharding": ("sharding", "op1"),
    "op2_block_matrix_neighbours": ("block_join", "op2"),
    "op3_license_compression": ("licenses", "op3"),
    "op4_jaccard_components": ("jaccard_join", "op4"),
    "op5_nearest_toxic_examples": ("toxicity", "op5"),
    "op6_language_id": ("lang_id", "op6"),
    "op7_token_files": ("token_files", "op7"),
    "op8_pfair_mixing": ("mixing", "op8"),
    "op9_template_decontamination": ("decontaminate", "op9"),
    "op10_suffix_array_repeats": ("repeats", "op10"),
    "op11_voronoi_hard_negatives": ("hard_negatives", "op11"),
    "op12_chat_segments": ("chat_format", "op12"),
    "op13_centroid_clustering": ("centroids", "op13"),
}


def queries() -> dict[str, Callable]:
    return {name: getattr(import_module(f"folioweave.llm.{module}"), f) for name, (module, f) in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (module, f) in _OPS.items() if (sql := getattr(import_module(f"folioweave.llm.{module}"), f.upper() + "_SQL", None))}
