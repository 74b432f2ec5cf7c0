"""The standard feature extractors: each a function of tables to one row per unit, registered by name.

All of them take whole tables (every recording at once) and declare aggregates
or windows, so a feature set of thousands of recordings is a few shuffles by
unit, not a loop over files. Fitted and traced features are Arrow structs.

Tables: ``spikes`` has ``dataset_id, unit_id, t_us``; ``units`` has
``dataset_id, unit_id, waveform``; ``traces`` has ``dataset_id, unit_id`` and a
column of mean traces per movie; ``direction_rates`` has ``totals``, eight
directions by three trials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.operators import directions, features, imaging, rates, sta
from spikeloom.operators.ordered import exact_median, with_previous
from spikeloom.plans.registry import Registry

UNIT = ["dataset_id", "unit_id"]
STANDARD = Registry()
# Windows of the step stimulus in microseconds, and the factor over the baseline that makes a response.
STEP_US = {"onset": 5_000_000, "offset": 10_000_000, "transient": 500_000, "sustained": 4_000_000, "baseline": 4_000_000}
RESPONSE_FACTOR = 2.0


def _with_units(got: DataFrame, units: DataFrame | None, defaults: dict[str, object]) -> DataFrame:
    """Units without a spike get the values of a silent unit."""
    if units is None:
        return got
    return units.select(*UNIT).distinct().join(got, UNIT, "left").fillna({k: v for k, v in defaults.items() if v is not None})


def quality_of(rate: Column, cv: Column, n: Column) -> Column:
    """0..1: the mean of scores for a rate of 0.5 to 50 Hz, a regular train and a hundred spikes; 0 for fewer than ten."""
    by_rate = F.when(rate.between(0.5, 50.0), 1.0).when(rate < 0.5, rate / 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - (rate - 50.0) / 50.0))
    by_cv = F.when(cv < 1, 1.0).when(cv < 2, 2.0 - cv).otherwise(0.0)
    return F.when(n < 10, 0.0).otherwise((by_rate + by_cv + F.least(F.lit(1.0), n / 100.0)) / 3)


@STANDARD.register("baseline_127", ("spikes.t_us",), "dataset_id string, unit_id string, mean_firing_rate double, std_firing_rate double, cv_isi double, median_isi_ms double, spike_count long, quality_index double")
def baseline(spikes: DataFrame, units: DataFrame | None = None, start_us: int = 0, end_us: int | None = None) -> DataFrame:
    """Baseline firing: rate, its deviation over seconds, regularity of intervals and a quality index.

    The window ends at ``end_us``, else at a unit's last spike; a window of no
    length leaves the unit silent. Spikes are counted in as many equal bins as
    the window has whole seconds (one at least), the last one closed.
    """
    own = spikes.where(F.col("t_us").isNotNull() & (F.col("t_us") >= start_us))
    own = own.where(F.col("t_us") < end_us) if end_us is not None else own
    n = own.groupBy(*UNIT).agg(F.count("*").alias("spike_count"), (F.lit(end_us).cast("double") if end_us is not None else F.max("t_us").cast("double")).alias("_end"))
    n = n.withColumn("_dur", (F.col("_end") - start_us) / 1e6).where("_dur > 0").withColumn("_bins", F.greatest(F.lit(1), F.floor("_dur")).cast("long"))
    placed = own.join(n.select(*UNIT, "_end", "_bins"), UNIT)
    width = (F.col("_end") - start_us) / F.col("_bins")
    bin_no = F.least(F.floor((F.col("t_us") - start_us) / width), F.col("_bins") - 1).cast("long")
    per_bin = placed.groupBy(*UNIT, bin_no.alias("b")).agg(F.count("*").alias("k")).groupBy(*UNIT).agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    gaps = with_previous(own.select(*UNIT, "t_us"), UNIT, ["t_us"], F.floor(F.col("t_us") / 60_000_000), F.col("t_us"), "_before").withColumn("g", (F.col("t_us") - F.col("_before")) / 1000.0).where("g IS NOT NULL")
    isi = gaps.groupBy(*UNIT).agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("sd")).join(exact_median(gaps, UNIT, "g", 1000.0, "median_isi_ms"), UNIT)
    rate = F.col("spike_count") / F.col("_dur")
    cv = F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0)
    var = F.col("q") / F.col("_bins") - (F.col("s") / F.col("_bins")) * (F.col("s") / F.col("_bins"))
    got = n.join(per_bin, UNIT).join(isi, UNIT, "left").select(
        *UNIT, rate.alias("mean_firing_rate"), F.when(F.col("spike_count") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias("std_firing_rate"),
        cv.alias("cv_isi"), "median_isi_ms", "spike_count", quality_of(rate, cv, F.col("spike_count")).alias("quality_index"),
    )
    return _with_units(got, units, {"mean_firing_rate": 0.0, "std_firing_rate": 0.0, "cv_isi": 0.0, "spike_count": 0, "quality_index": 0.0})


@STANDARD.register(
    "step_up_5s_5i_3x", ("spikes.t_us",),
    "dataset_id string, unit_id string, on_response_flag boolean, off_response_flag boolean, on_peak_value double, off_peak_value double, on_sustained_response double, off_sustained_response double, response_quality double, on_latency_ms double, off_latency_ms double, on_off_ratio double, baseline_rate double",
)
def step_up(spikes: DataFrame, units: DataFrame | None = None, factor: float = RESPONSE_FACTOR, **windows: int) -> DataFrame:
    """ON and OFF responses to a step of light, by counts in five windows: one aggregate by unit.

    A response is a transient rate over ``factor`` times the baseline rate;
    latencies run to the first spike of a transient window, NULL without one.
    """
    w = STEP_US | windows
    t, on, off = F.col("t_us"), w["onset"], w["offset"]
    rate = lambda a, b: F.count_if((t >= a) & (t < b)) / F.lit((b - a) / 1e6) if b > a else F.lit(0.0)
    first = lambda a: (F.min(F.when((t >= a) & (t < a + w["transient"]), t)) - a) / 1000.0
    got = spikes.where(t.isNotNull()).groupBy(*UNIT).agg(
        rate(on - w["baseline"], on).alias("baseline_rate"), rate(on, on + w["transient"]).alias("on_peak_value"), rate(on + w["transient"], off).alias("on_sustained_response"),
        rate(off, off + w["transient"]).alias("off_peak_value"), rate(off + w["transient"], off + w["transient"] + w["sustained"]).alias("off_sustained_response"),
        first(on).alias("on_latency_ms"), first(off).alias("off_latency_ms"),
    )
    base, a, b = F.col("baseline_rate"), F.col("on_peak_value"), F.col("off_peak_value")
    top = F.greatest(a, b)
    got = got.select(
        *UNIT, (a > base * factor).alias("on_response_flag"), (b > base * factor).alias("off_response_flag"), "on_peak_value", "off_peak_value", "on_sustained_response", "off_sustained_response",
        F.when(top > 0, F.least(F.lit(1.0), (top - base) / (base + 1) / 10)).otherwise(0.0).alias("response_quality"), "on_latency_ms", "off_latency_ms",
        F.when(a + b > 0, (a - b) / (a + b)).otherwise(0.0).alias("on_off_ratio"), "baseline_rate",
    )
    silent = {c: 0.0 for c in ("on_peak_value", "off_peak_value", "on_sustained_response", "off_sustained_response", "response_quality", "on_off_ratio", "baseline_rate")}
    return _with_units(got, units, silent | {"on_response_flag": False, "off_response_flag": False})


@STANDARD.register("cell_type_classifier", ("spikes.t_us", "units.waveform"), "dataset_id string, unit_id string, cell_type string, rgc_probability double, has_axon boolean, waveform_width_ms double")
def cell_type(spikes: DataFrame, units: DataFrame, rate: float = 20_000.0) -> DataFrame:
    """A first guess of the cell type: a narrow waveform speaks for an axon, many spikes for a ganglion cell; under fifty spikes nothing is said."""
    n = spikes.where("t_us IS NOT NULL").groupBy(*UNIT).agg(F.count("*").alias("_n"))
    one = units.groupBy(*UNIT).agg(F.max("waveform").alias("waveform")).join(n, UNIT, "left")
    width = F.when(F.size("waveform") > 10, features.waveform_features(F.col("waveform"), rate)["width_ms"])
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= 50
    axon = enough & F.coalesce(width < 0.4, F.lit(False))
    p = F.when(~enough, 0.0).when(axon & (F.col("_n") > 100), 0.8).when(F.col("_n") > 500, 0.6).otherwise(0.3)
    return one.select(*UNIT, F.when(p > 0.5, "RGC").otherwise("unknown").alias("cell_type"), p.alias("rgc_probability"), axon.alias("has_axon"), F.when(enough, width).alias("waveform_width_ms"))


@STANDARD.register("frif", ("spikes.t_us", "frames.t_us"), "dataset_id string, unit_id string, edge_start long, edge_end long, n long, rate double")
def frame_rates(spikes: DataFrame, frames: DataFrame) -> DataFrame:
    """Firing rate in each interval between two frames of the recording, a row per interval that holds a spike."""
    edges = frames.select("dataset_id", F.col("t_us").alias("edge")).where("edge IS NOT NULL").distinct()
    bins = with_previous(edges.withColumn("_o", -F.col("edge")), ["dataset_id"], ["_o"], F.floor(F.col("_o") / 60_000_000), F.col("edge"), "edge_end").where("edge_end IS NOT NULL").select("dataset_id", F.col("edge").alias("edge_start"), "edge_end")
    per = spikes.where("t_us IS NOT NULL").groupBy(*UNIT, "t_us").agg(F.count("*").alias("k"))
    placed = rates.asof_join(per, bins, ["dataset_id"], "t_us", "edge_start", ["edge_start", "edge_end"], bucket=60_000_000.0).where("edge_start IS NOT NULL AND t_us < edge_end")
    got = placed.groupBy(*UNIT, "edge_start", "edge_end").agg(F.sum("k").alias("n"))
    return got.select("*", (F.col("n") * 1e6 / (F.col("edge_end") - F.col("edge_start"))).alias("rate"))


def _struct_columns(df: DataFrame, struct: Column) -> DataFrame:
    return df.select(*UNIT, struct.alias("_f")).select(*UNIT, "_f.*")


@STANDARD.register("step_trace", ("traces.step_up_5s_5i_b0_3x",), "dataset_id string, unit_id string, " + ", ".join(f"{n} double" for n in features.STEP_NAMES))
def step_trace(traces: DataFrame) -> DataFrame:
    """The twelve step features of a mean trace."""
    return _struct_columns(traces, features.step_feature_struct(F.col("step_up_5s_5i_b0_3x")))


@STANDARD.register("green_blue_3s_3i_3x", ("traces.green_blue_3s_3i_3x",), "dataset_id string, unit_id string, " + ", ".join(f"{n} double" for n in features.COLOUR_NAMES))
def green_blue(traces: DataFrame) -> DataFrame:
    """The colour features of a mean trace."""
    return _struct_columns(traces, features.colour_feature_struct(F.col("green_blue_3s_3i_3x")))


@STANDARD.register("freq_step_5st_3x", ("traces.freq_step_5st_3x",), "dataset_id string, unit_id string, " + ", ".join(f"{n} double" for n in features.FREQ_NAMES))
def freq_step(traces: DataFrame) -> DataFrame:
    """Amplitude, phase and fit of the response at five frequencies."""
    return _struct_columns(traces, features.frequency_feature_struct(F.col("freq_step_5st_3x")))


@STANDARD.register("moving_h_bar_s5_d8_3x", ("direction_rates.totals",), "dataset_id string, unit_id string, dsi double, osi double, preferred double, ds_p double, os_p double")
def moving_bar(direction_rates: DataFrame, rounds: int = 2000) -> DataFrame:
    """Direction and orientation indices with permutation tests, seeded by the unit's name."""
    return _struct_columns(direction_rates, directions.selectivity_struct(F.col("totals"), F.concat_ws("/", *UNIT), rounds))



@STANDARD.register("perfect_dense_noise_15x15_15hz_r42_3min", ("stas.cube", "stas.shape"), "dataset_id string, unit_id string, center_row double, center_col double, x0 double, y0 double, sigma_x double, sigma_y double, quality double")
def dense_noise(stas: DataFrame) -> DataFrame:
    """The receptive field of a spike-triggered average: its centre by swing, a Gaussian fit and whether its signal stands out."""

    def kernel(cube):
        row, col = imaging.swing_center(cube)
        fit = sta.gaussian_rf(cube) or {}
        quality, _ = imaging.signal_quality(cube, (row, col))
        return {"center_row": float(row), "center_col": float(col), "x0": fit.get("center_x"), "y0": fit.get("center_y"), "sigma_x": fit.get("sigma_x"), "sigma_y": fit.get("sigma_y"), "quality": float(quality)}

    names = ["center_row", "center_col", "x0", "y0", "sigma_x", "sigma_y", "quality"]
    return _struct_columns(stas, imaging.cube_udf(kernel, names)(F.col("cube"), F.col("shape")))


@STANDARD.register("eimage_sta", ("electrode_sums.sums",), "dataset_id string, unit_id string, shape array<int>, average array<double>, n_spikes long")
def electrode_image(electrode_sums: DataFrame) -> DataFrame:
    """The electrode image of each unit from sums of windows: see ``operators.electrode_sta``."""
    from spikeloom.operators.electrode_sta import averages

    return averages(electrode_sums)
