"""Settings of a session: defaults, typed assignment, undo and redo, JSON."""

from __future__ import annotations

import copy
import json
from typing import Any

#: Defaults by dotted key.
DEFAULTS: dict[str, Any] = {
    "normalization.normalize_by": "dont",
    "normalization.normalize_by_coverage": "rpkb",
    "normalization.min_interactions": 0,
    "normalization.color_range": [0.0, 1.0],
    "normalization.log_base": 10.0,
    "normalization.p_accept": 0.05,
    "normalization.ddd": False,
    "normalization.ddd_samples": [1, 200],
    "normalization.ddd_quantile": 80.0,
    "normalization.ddd_all_samples": False,
    "normalization.scale": "max",
    "normalization.ice_sparse_slice_filter": 10.0,
    "normalization.ice_ignore_n_diags": 2,
    "normalization.ice_min_nz": 10,
    "normalization.ice_mad_max": 5,
    "normalization.num_ice_bins": 300,
    "normalization.radicl_seq_samples": 100,
    "normalization.radicl_seq_axis_is_column": True,
    "normalization.grid_seq_samples": 1000,
    "normalization.grid_seq_ignore_cis": True,
    "normalization.grid_seq_axis_is_column": True,
    "normalization.grid_seq_filter_intersection": True,
    "normalization.grid_seq_max_bin_size": 1000,
    "normalization.ploidy_correct": True,
    "normalization.ploidy_keep_distinct_group": True,
    "normalization.ploidy_keep_inter_group": True,
    "normalization.ploidy_remove_others": True,
    "normalization.ploidy_remove_intra_instance_contig": True,
    "replicates.in_group": "sum",
    "replicates.between_group": "sum",
    "interface.max_num_bins": 50,
    "interface.max_num_bins_factor": 1000,
    "interface.min_bin_size": 27,
    "interface.max_undo": 25,
    "interface.add_draw_area": 20.0,
    "interface.squared_bins": True,
    "interface.fixed_number_of_bins": False,
    "interface.fixed_num_bins_x": 256,
    "interface.fixed_num_bins_y": 256,
    "interface.fixed_bin_size": False,
    "interface.fixed_bin_size_x": 100,
    "interface.fixed_bin_size_y": 100,
    "interface.snap_bin_size": False,
    "interface.snap_factors": [1, 1.25, 2.5, 5],
    "interface.color_palette": "Viridis256",
    "filters.mapping_q": [0, 254],
    "filters.incomplete_alignments": True,
    "filters.directionality": "all",
    "filters.symmetry": "all",
    "filters.min_diag_dist": 0,
    "filters.multiple_annos_in_bin": "combine",
    "filters.anno_in_multiple_bins": "stretch",
    "filters.ambiguous_mapping": "enclosed",
    "filters.cut_off_bin": "larger",
    "filters.show_contig_smaller_than_bin": False,
    "export.prefix": "export",
    "export.do_export_full": False,
    "export.export_format": "tsv",
}

#: What the keys with names may be.
CHOICES: dict[str, tuple[str, ...]] = {
    "normalization.normalize_by": ("rpm", "rpk", "radicl-seq", "grid-seq", "dont", "ice", "cool-ice"),
    "normalization.scale": ("abs", "max", "minmax", "dont"),
    "replicates.in_group": ("sum", "min", "max", "dif", "mean"),
    "replicates.between_group": ("sum", "1st", "2nd", "sub", "div", "div+", "dif", "min", "max"),
    "filters.directionality": ("all", "same", "oppo", "forw", "rev"),
    "filters.symmetry": ("all", "sym", "asym", "mirror"),
    "filters.multiple_annos_in_bin": ("combine", "first", "max_fac_pow_two", "force_separate"),
    "filters.anno_in_multiple_bins": ("stretch", "separate", "squeeze"),
    "filters.ambiguous_mapping": ("enclosed", "enclosed_only", "encloses", "overlaps", "overlaps_only", "first", "last", "points_only"),
    "filters.cut_off_bin": ("larger", "skip", "smaller", "fit_chrom_smaller", "fit_chrom_larger", "cover_multiple"),
    "export.export_format": ("tsv", "png", "svg"),
}


def flattened(values: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in values.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict) and "val" in value:
            out[name] = value["val"]
        elif isinstance(value, dict) and "val_min" in value and "val_max" in value:
            out[name] = [value["val_min"], value["val_max"]]
        elif isinstance(value, dict):
            out |= flattened(value, "" if not prefix and key == "settings" else f"{name}.")
        else:
            out[name] = value
    return out


class Session:
    """Values by dotted key over the defaults, with a bounded history."""

    def __init__(self, values: dict[str, Any] | None = None):
        self.values = {**copy.deepcopy(DEFAULTS), **(values or {})}
        self.before: list[dict[str, Any]] = []
        self.after: list[dict[str, Any]] = []
        self.saved = copy.deepcopy(self.values)

    def get(self, key: str) -> Any:
        return self.values[key]

    def has(self, key: str) -> bool:
        return key in self.values

    def set(self, key: str, value: Any) -> None:
        """Strings are read as the type of the present value; an unchanged value is no step."""
        value = self._typed(key, value)
        if key in self.values and self.values[key] == value:
            return
        self.before = [*self.before, copy.deepcopy(self.values)][-int(self.values["interface.max_undo"]) or len(self.before) + 1 :]
        self.after = []
        self.values[key] = value

    def _typed(self, key: str, value: Any) -> Any:
        now = self.values.get(key)
        if isinstance(value, str) and not isinstance(now, str) and now is not None:
            if isinstance(now, bool):
                word = value.lower()
                if word not in ("true", "yes", "1", "t", "y", "false", "no", "0", "f", "n"):
                    raise ValueError(f"{value} is neither true nor false")
                value = word in ("true", "yes", "1", "t", "y")
            else:
                value = json.loads(value) if isinstance(now, list) else type(now)(value)
        if key in CHOICES and value not in CHOICES[key]:
            raise ValueError(f"{key} is one of {CHOICES[key]}")
        return value

    def undo(self) -> bool:
        if not self.before:
            return False
        self.after.append(self.values)
        self.values = self.before.pop()
        return True

    def redo(self) -> bool:
        if not self.after:
            return False
        self.before.append(self.values)
        self.values = self.after.pop()
        return True

    def interface(self) -> dict[str, Any]:
        return {k.removeprefix("interface."): v for k, v in self.values.items() if k.startswith("interface.")}

    def reset(self, prefix: str = "") -> None:
        """Defaults again for all keys that begin with prefix, as one step of the history."""
        wanted = {k: v for k, v in copy.deepcopy(DEFAULTS).items() if k.startswith(prefix)}
        if any(self.values.get(k) != v for k, v in wanted.items()):
            self.before = [*self.before, copy.deepcopy(self.values)][-int(self.values["interface.max_undo"]) or len(self.before) + 1 :]
            self.after = []
            self.values |= wanted

    def can_save(self) -> bool:
        """Whether anything has changed since the last to_json()."""
        return self.values != self.saved

    def to_json(self) -> str:
        self.saved = copy.deepcopy(self.values)
        return json.dumps(self.values, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Session:
        """Keys that an older session lacks have their defaults. Nested objects are read too:
        their keys are joined by dots, without a leading `settings`, an object with `val` is
        that value, and one with `val_min` and `val_max` is the list of both."""
        return cls(flattened(json.loads(text)))
