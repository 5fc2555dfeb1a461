"""Energy accounting from per-call layer counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.sequence import global_number

# Energy per operation, in units of one dense multiply-accumulate.
DENSE_MAC = 1.000
SPIKE_ACCUMULATE = 0.175
LIF_UPDATE = 0.383
INPUT_PAD = 0.107
WEIGHT_PAD = 1.712
# Layer kinds.
SPARSE_KINDS = ("spiking_conv1d", "spiking_linear_sparse_input")
DENSE_INPUT_KIND = "spiking_linear_dense_input"
DENSE_KIND = "dense_linear"


def rate(nonzero: Column, numel: Column, default: float = float("nan")) -> Column:
    return F.when(numel == 0, F.lit(default)).otherwise(nonzero / numel)


def layer_totals(calls: DataFrame, keys: Sequence[str] = ("run", "layer", "group", "kind")) -> DataFrame:
    """Sum per-call counters per layer. Effective operations scale each call by its own input rate."""
    sparse = F.col("kind").isin(*SPARSE_KINDS)
    sops = F.when(sparse, F.col("macs") * rate(F.col("input_nonzero"), F.col("input_numel"), 0.0)).otherwise(F.col("macs"))
    return calls.groupBy(*keys).agg(
        F.sum(F.col("macs").cast("double")).alias("dense_macs"),
        F.sum(sops.cast("double")).alias("effective_sops"),
        F.sum(F.col("lif_numel").cast("double")).alias("lif_ops"),
        *[F.sum(c).alias(c) for c in ("input_nonzero", "input_numel", "lif_nonzero", "lif_numel")],
        F.count(F.lit(1)).alias("calls"),
    )


def with_energy(layers: DataFrame, data_movement: bool = True) -> DataFrame:
    """Adds compute, data and total energy per layer."""
    kind, macs, sops, lif = (F.col(c) for c in ("kind", "dense_macs", "effective_sops", "lif_ops"))
    compute = (
        F.when(kind.isin(*SPARSE_KINDS), sops * SPIKE_ACCUMULATE + lif * LIF_UPDATE)
        .when(kind == DENSE_INPUT_KIND, macs * DENSE_MAC + lif * LIF_UPDATE)
        .when(kind == DENSE_KIND, macs * DENSE_MAC)
        .otherwise(0.0)
    )
    moved = F.when(kind.isin(*SPARSE_KINDS), sops * (INPUT_PAD + WEIGHT_PAD)).otherwise(0.0) if data_movement else F.lit(0.0)
    return (
        layers.withColumn("energy_compute", compute)
        .withColumn("energy_data", moved)
        .withColumn("energy_total", F.col("energy_compute") + F.col("energy_data"))
        .withColumn("input_rate", rate(F.col("input_nonzero"), F.col("input_numel")))
        .withColumn("lif_output_rate", rate(F.col("lif_nonzero"), F.col("lif_numel")))
    )


TOTALS = ("dense_macs", "effective_sops", "lif_ops", "energy_compute", "energy_data", "energy_total")


def energy_report(layers: DataFrame, samples: DataFrame, run: str = "run") -> DataFrame:
    """Totals per layer, per group and per run from one pass (grouping sets), per sample as well.

    ``samples`` has (run, n_samples); fewer than one sample, or none known, counts as one. ``level`` is layer, group or
    run. Reductions compare with the dense total and are NaN when that is 0.
    """
    g = F.grouping_id()
    out = layers.groupingSets(
        [[F.col(run), F.col("group"), F.col("layer")], [F.col(run), F.col("group")], [F.col(run)]],
        F.col(run), F.col("group"), F.col("layer"),
    ).agg(g.alias("__g"), *[F.sum(c).alias(c) for c in TOTALS])
    out = out.withColumn("level", F.when(F.col("__g") == 0, "layer").when(F.col("__g") == 1, "group").otherwise("run")).drop("__g")
    out = out.join(samples.select(run, "n_samples"), run, "left").withColumn("n_samples", F.greatest(F.coalesce("n_samples", F.lit(1)), F.lit(1)))
    for c in TOTALS:
        out = out.withColumn(f"{c}_per_sample", F.col(c) / F.col("n_samples"))
    for c in ("energy_compute", "energy_total"):
        saved = F.when(F.col("dense_macs") > 0, 1.0 - F.col(c) / F.col("dense_macs")).otherwise(F.lit(float("nan")))
        out = out.withColumn(f"{c}_reduction", saved)
    return out


def ranked_runs(report: DataFrame, by: str = "energy_compute_per_sample") -> DataFrame:
    """Adds ``place``: runs by energy per sample from 1 on, missing values last, equal ones by name."""
    energy = F.when(F.isnan(by), None).otherwise(F.col(by)).asc_nulls_last()
    return global_number(report, [energy, F.col("run").asc()]).withColumn("place", F.col("place") + 1)


def run_comparison(
    reports: DataFrame, config: DataFrame, metrics: DataFrame, config_keys: Sequence[str], run: str = "run", layers: DataFrame | None = None, dataset: str = "dataset"
) -> DataFrame:
    """One row per run: chosen config keys, ``test_`` metrics, run totals, and all totals per group
    (``<group>_<total>``; ``<group>_compute`` and ``<group>_total`` are energies per sample).

    With ``layers`` (rows of ``with_energy``), also ``<layer>_rate``, the layer's output rate. The
    configuration's ``dataset`` comes along where it has one.
    """

    def plain(df: DataFrame, c: str) -> Column:
        nested = df.schema[c].dataType.typeName() in ("array", "struct", "map")
        return F.to_json(c).alias(c) if nested else F.col(c)

    have = [c for c in dict.fromkeys([*config_keys, dataset]) if c in config.columns]
    conf = config.select(run, *[plain(config, c) for c in have])
    test = metrics.select(run, *[plain(metrics, c).alias(c if c.startswith("test_") else f"test_{c}") for c in metrics.columns if c != run])
    totals = reports.filter("level = 'run'").drop("level", "group", "layer")
    groups = (
        reports.filter("level = 'group'")
        .groupBy(run)
        .pivot("group")
        .agg(F.first("energy_compute_per_sample").alias("compute"), F.first("energy_total_per_sample").alias("total"), *[F.first(c).alias(c) for c in TOTALS])
    )
    out = conf.join(test, run, "left").join(totals, run, "left").join(groups, run, "left")
    if layers is not None:
        rates = layers.withColumn("__name", F.concat("layer", F.lit("_rate"))).groupBy(run).pivot("__name").agg(F.first("lif_output_rate"))
        out = out.join(rates, run, "left")
    return out
