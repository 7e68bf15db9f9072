"""One name for each operation of an archetypal analysis, in the order of its usual steps.

Everything takes and returns DataFrames: samples are (sample_id, features array<double>), long tables (sample_id,
feature, value), archetypes (arch_id, arch_name, position), distances (sample_id, arch, dist).
"""

from vertexlake.functions.keyed import exponential_rank, key, normal, uniform  # noqa: F401
from vertexlake.functions.names import sanitize, tell_apart  # noqa: F401
from vertexlake.operators.archetypes import align_tables, annotate, extreme_variance, ordered, permutations, permute_features, permute_rows, quality, resample_weighted, zscore  # noqa: F401
from vertexlake.operators.bins import bins_by_cutoff, bins_by_share, choose_bins, equal_bins  # noqa: F401
from vertexlake.operators.distance import arch_dist, merge_distances, rank_distances, weight_distances, wide_distances  # noqa: F401
from vertexlake.operators.fit import (  # noqa: F401
    Fits,
    align_replicates,
    average_positions,
    bootstrap,
    dimension_significance,
    dimension_variance,
    empirical_p,
    fit_matrix,
    fit_table,
    k_sweep,
    left_out,
    permuted,
    position_variance,
    resample,
    significance,
    spark_kmeans,
    variance_ratio,
)
from vertexlake.operators.gam import curve_with_points, derivative_band, find_decreasing, fit_curves, summarise  # noqa: F401
from vertexlake.operators.geometry import align, assign, hull, leaf_order, simplex_volume, table_hull, volume_k3  # noqa: F401
from vertexlake.operators.models import (  # noqa: F401
    classify,
    coefficients,
    confusion,
    deviance,
    fit_softmax,
    fit_softmax_full,
    make_features,
    poisson_regression,
    probabilities,
    soft_confusion,
    split_by_class,
    top_weights,
    weight_table,
)
from vertexlake.operators.neighbours import knn, shared_neighbours  # noqa: F401
from vertexlake.operators.pcha import Fit, distributed_fit, least_squares_weights, pcha, simplex_weights, weights  # noqa: F401
from vertexlake.operators.plotdata import by_k, distribution, embed, lines, panels, points, structure  # noqa: F401
from vertexlake.operators.project import fit_svd, from_components, gram, gram_table, moments, prepare, to_components  # noqa: F401
from vertexlake.operators.ranktest import adjust_p, find_decreasing_wilcox, join_labels, labels, median_differences, rank_statistics, select_top, top_decreasing, tradeoff, upper_tail  # noqa: F401
from vertexlake.operators.sets import (  # noqa: F401
    activity_of,
    add_terms,
    ancestors,
    auc_scores,
    binary_scores,
    catalogue_lookup,
    explode_catalogue,
    filter_by_size,
    filter_go,
    first_match,
    map_annotation,
    map_catalogue,
    map_identifiers,
    map_targets,
    measure_activity,
    otsu_thresholds,
    pinv_scores,
    propagate,
    set_matrix,
)
from vertexlake.operators.sketch import box_of, find_side, sketch  # noqa: F401
from vertexlake.sources.matrix import assay, from_columns, from_long, generate_archetypes, generate_data, read_delimited, read_obo, to_long  # noqa: F401
from vertexlake.streaming.score import nearest  # noqa: F401


def predict(dist, long, weights_, bias, features: list[str], n_bins: int = 10, select=None, combine=None):
    """(arch, bin, example, probabilities, pred_class, class_entropy) of new samples by a fitted softmax, one example for each bin."""
    from pyspark.sql import functions as F

    x = make_features(dist, long, n_bins, 1, select, combine).groupBy("arch", "bin", "example").pivot("feature", features).agg(F.first("value")).na.fill(0.0)
    x = x.select("arch", "bin", "example", F.array(*[F.col(f"`{f}`") for f in features]).alias("features"))
    return classify(x.withColumn("probabilities", probabilities(F.col("features"), weights_, bias))).drop("features")
