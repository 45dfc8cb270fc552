"""Column functions of the engine, gathered for users."""

from tessera.functions.user import of_arrays, of_values, register_transform
from tessera.operators.channels import kind_for, replace_nuclear, uniprot_ok
from tessera.operators.inventory import marker_label, nuclear_reason, parsed_counts, qc_text, real_uniprot, short_label, uniprot_text
from tessera.operators.kernels import picked_markers
from tessera.operators.metadata import drawn, resolution_name
from tessera.operators.stats import clip, clip_log1p, clip_rescale, rgb_preprocess, valid_stats
from tessera.operators.tiles import grade
from tessera.operators.tiling import candidate_starts, grid_extent
from tessera.sources.catalog import canonical_modality

__all__ = [
    "candidate_starts", "canonical_modality", "clip", "clip_log1p", "clip_rescale", "drawn", "grade", "grid_extent", "kind_for", "marker_label", "nuclear_reason", "of_arrays", "of_values", "parsed_counts", "picked_markers", "qc_text", "real_uniprot",
    "register_transform", "replace_nuclear", "resolution_name", "rgb_preprocess", "short_label", "uniprot_ok", "uniprot_text", "valid_stats",
]
