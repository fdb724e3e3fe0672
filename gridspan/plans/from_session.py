"""The heatmap that a session's settings describe."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridspan.operators import count
from gridspan.plans.heatmap import Associated, Balancing, Decay, Heatmap
from gridspan.session import Session


def heatmap_of(
    session: Session, contacts: DataFrame, contigs: DataFrame, dividend: int, group_a: list[str], group_b: list[str], area: tuple[int, int, int, int], sweep: DataFrame | None = None, kinds: tuple[str, ...] = (), present: tuple = ((), ()), absent: tuple = ((), ())
) -> Heatmap:
    """area is in dividend units over all displayed contigs; sweep holds the intervals that
    associated slices are sampled from. contigs with ploidy groups display their copies."""
    n = lambda key: session.get(f"normalization.{key}")
    f = lambda key: session.get(f"filters.{key}")
    low, high = f("mapping_q")
    least, most = n("ddd_samples")
    columns = contacts.columns
    filters = [count.map_quality(low, high, f("incomplete_alignments"))] if "bucket" in columns else []
    if "same_strand" in columns and "y_strand" in columns:
        filters.append(count.directionality(f("directionality")))
    rules = ("keep_distinct_group", "keep_inter_group", "remove_others")
    ploidy = {k: n(f"ploidy_{k}") for k in rules} | {"correct": n("ploidy_correct"), "remove_intra": n("ploidy_remove_intra_instance_contig")}
    return Heatmap.for_area(
        contacts, contigs, dividend, group_a, area, session.interface(), session.get("interface.add_draw_area"), session.get("export.do_export_full"),
        group_b=group_b, cut_off=f("cut_off_bin"), show_small=f("show_contig_smaller_than_bin"), filters=filters, kinds=kinds, present=present, absent=absent,
        mode=f("ambiguous_mapping"), symmetry=f("symmetry"), least=n("min_interactions"), diagonal=int(1000 * f("min_diag_dist")) // dividend,
        in_group=session.get("replicates.in_group"), between_group=session.get("replicates.between_group"), ploidy_rules=ploidy,
        ddd=Decay(least, None if n("ddd_all_samples") else most, n("ddd_quantile")) if n("ddd") else None,
        normalize=n("normalize_by"), by_column=n("radicl_seq_axis_is_column"), p_accept=n("p_accept"),
        balancing=Balancing(n("ice_min_nz"), n("ice_sparse_slice_filter"), n("ice_mad_max"), n("ice_ignore_n_diags")),
        associated=Associated(sweep, n("grid_seq_samples"), most=n("grid_seq_max_bin_size"), by_column=n("grid_seq_axis_is_column"), intersection=n("grid_seq_filter_intersection"), ignore_cis=n("grid_seq_ignore_cis")),
        scale=n("scale"),
    )
