"""One query per operator over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostwin.functions.scalars import (
    anomaly_to_label, apply_threshold, clean_inf, drop_unparseable, filter_days, null_tokens,
    round_doubles, to_floor, to_int, to_num, window_floor, day_id)
from hostwin.operators import datasets, evaluate, features, order, prep, sampling, splits, text
from hostwin.operators.iforest import fit_iforest, score_iforest
from hostwin.operators.models import (
    MODEL_NAMES, Settings, assemble, by_class, fit_balanced_rf, fit_gbt, fit_linear_svm, fit_logreg,
    fit_rf_smote, importances, scored_rows, train_and_score)
from hostwin.operators.smote import smote
from hostwin.plans.flagship import Study, study_tables
from hostwin.schemas import KEPT_DAYS, KEYS, LOG_COLUMNS, XDR_COLUMNS
from hostwin.session import pin, scratch_path
from hostwin.sources import fixtures
from hostwin.sources.tables import (
    read_log, read_logs, read_master, read_text, write_days, write_sorted, write_split,
    write_table)
from hostwin.streaming.features import (
    compact_partials, compact_windows, read_partials, read_windows, run_partials, run_stream, stream_features)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SIX_HOURS = 21_600
TRAIN_BEFORE = 21
SMALL = Settings(trees=10, depth=8, boost_depth=4)


def query(fn: Query) -> Query:
    """Register a query under the name of its function; DOUBLE results are rounded."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir), 6)
    return fn


def logs_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = fixtures.base(spark, sf_dir)
    return {k: null_tokens(fixtures.view_of(b, k)) for k in fixtures.LOGS}


def log_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return null_tokens(fixtures.view(spark, sf_dir, kind))


def master_of(spark: SparkSession, sf_dir: str, width: int = 300) -> DataFrame:
    return datasets.build_master(logs_of(spark, sf_dir), width)


def edr_of(spark: SparkSession, sf_dir: str, width: int = 300) -> DataFrame:
    return datasets.edr_of(master_of(spark, sf_dir, width))


# Scans and scalar functions

@query
def scan_null_tokens(spark, sf_dir):
    raw = null_tokens(fixtures.view(spark, sf_dir, "coerce_raw"))
    c = F.col("time")
    return raw.select("event_id", "time", to_int(c).alias("as_int"), to_num(c).alias("as_num"),
                      to_floor(c).alias("as_floor"))


@query
def window_day(spark, sf_dir):
    raw = fixtures.view(spark, sf_dir, "coerce_raw")
    rows = raw.select("event_id", to_int(F.col("time")).alias("t")).na.drop(subset=["t"])
    t = F.col("t")
    return rows.select("event_id", "t", window_floor(t, 300).alias("win"), day_id(t).alias("day"))


@query
def unparseable_days(spark, sf_dir):
    raw = fixtures.view(spark, sf_dir, "coerce_raw").withColumnRenamed("time", "day")
    return drop_unparseable(raw, "day")


@query
def clean_infinities(spark, sf_dir):
    return clean_inf(fixtures.view(spark, sf_dir, "dirty"), ["x"])


@query
def threshold_classes(spark, sf_dir):
    scored = fixtures.view(spark, sf_dir, "scored").filter(F.col("score").isNotNull())
    return apply_threshold(scored, 0.5).select("model", "row_id", "pred")


@query
def outlier_labels(spark, sf_dir):
    b = fixtures.base(spark, sf_dir)
    return b.select("event_id", anomaly_to_label(
        F.when(F.col("k") < 7, -1).when(F.col("k") > 95, None).otherwise(1)).alias("label"))


@query
def whole_text(spark, sf_dir):
    path = scratch_path(spark, "texts")
    lines = F.regexp_replace("text", "[\\r\\n]+", " ").alias("value")
    _docs(spark, sf_dir).select(lines).write.option("maxRecordsPerFile", 500).text(path)
    words = text.tokens(read_text(spark, path), key="path")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# Sources and sinks

def _store_logs(spark, sf_dir) -> dict[str, str]:
    """The raw logs as headerless text files."""
    root = scratch_path(spark, "logs")
    paths = {k: f"{root}/{k}" for k in fixtures.LOGS}
    for kind, path in paths.items():
        fixtures.view(spark, sf_dir, kind).select(*LOG_COLUMNS[kind]).write.csv(
            path, compression="gzip" if kind == "dns" else "none")
    return paths


@query
def csv_log_scan(spark, sf_dir):
    path = scratch_path(spark, "auth")
    fixtures.view(spark, sf_dir, "auth").write.csv(path)
    return features.auth_features(read_log(spark, "auth", path))


@query
def csv_master(spark, sf_dir):
    paths = _store_logs(spark, sf_dir)
    return datasets.build_master(read_logs(spark, paths), SIX_HOURS)


@query
def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "master")
    write_table(master_of(spark, sf_dir, SIX_HOURS), path, "csv")
    return read_master(spark, path, "csv", file_columns=XDR_COLUMNS)


@query
def column_subset(spark, sf_dir):
    path = scratch_path(spark, "master")
    write_table(master_of(spark, sf_dir), path, partition_by=["day"])
    return read_master(spark, path, columns=["src_comp", "win", "label"])


@query
def append_partials(spark, sf_dir):
    path = scratch_path(spark, "parts")
    edr = edr_of(spark, sf_dir, SIX_HOURS).select(*KEYS, "auth_total", "label")
    write_table(edr.filter("day < 15"), path)
    write_table(edr.filter("day >= 15"), path, mode="append")
    return spark.read.parquet(path)


@query
def repeated_days(spark, sf_dir):
    """Days delivered one part after the other, some of them twice and with more rows at first."""
    path = scratch_path(spark, "days")
    edr = edr_of(spark, sf_dir, SIX_HOURS).select(*KEYS, "auth_total", "label")
    write_days(edr.filter("day < 15").unionAll(edr.filter("day between 10 and 14")), path)
    write_days(edr.filter("day >= 10"), path)
    write_days(edr.filter("day between 12 and 20"), path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("bigint"))


@query
def typed_csv(spark, sf_dir):
    """A text file with columns of its own: types are those that all values can be read as."""
    path = scratch_path(spark, "typed")
    b = fixtures.base(spark, sf_dir)
    write_table(b.select("event_id", F.col("k").alias("Class"), "value", "host", F.when(
        F.col("k") > 5, F.col("k") > 50).alias("high"), F.when(F.col("k") < 9, "x").otherwise(
        F.col("k").cast("string")).alias("mixed")), path, "csv")
    df = read_master(spark, path, "csv")
    kinds = F.array(*[F.lit(f"{n} {t}") for n, t in df.dtypes])
    # In numeric order 2 comes before 10.
    codes = prep.label_codes(df, "Class")
    return prep.encode_labels(df, "Class", codes).select("*", F.array_join(kinds, ", ").alias("kinds"))


@query
def split_round_trip(spark, sf_dir):
    path = scratch_path(spark, "split")
    write_split(splits.split_days(edr_of(spark, sf_dir).select(*KEYS, "label")), path)
    return read_master(spark, path, columns=[*KEYS, "label", "split"])


@query
def sorted_files(spark, sf_dir):
    path = scratch_path(spark, "sorted")
    rows = edr_of(spark, sf_dir).select(*KEYS, "auth_total")
    write_sorted(rows, path, order.CHRONO)
    return read_master(spark, path)


# Features

@query
def auth_features(spark, sf_dir):
    return features.auth_features(log_of(spark, sf_dir, "auth"))


@query
def proc_features(spark, sf_dir):
    return features.proc_features(log_of(spark, sf_dir, "proc"))


@query
def flow_features(spark, sf_dir):
    return features.flow_features(log_of(spark, sf_dir, "flows"))


@query
def dns_features(spark, sf_dir):
    return features.dns_features(log_of(spark, sf_dir, "dns"))


@query
def auth_features_6h(spark, sf_dir):
    return features.auth_features(log_of(spark, sf_dir, "auth"), SIX_HOURS)


@query
def proc_features_6h(spark, sf_dir):
    return features.proc_features(log_of(spark, sf_dir, "proc"), SIX_HOURS)


@query
def flow_features_6h(spark, sf_dir):
    return features.flow_features(log_of(spark, sf_dir, "flows"), SIX_HOURS)


@query
def dns_distinct_6h(spark, sf_dir):
    return features.dns_features(log_of(spark, sf_dir, "dns"), SIX_HOURS, distinct=True)


@query
def dns_distinct_merged(spark, sf_dir):
    """Distinct names from partial sketches of five deliveries that share windows."""
    dns = log_of(spark, sf_dir, "dns")
    deal = F.pmod(F.xxhash64("time", "resolved", "src_comp"), F.lit(5))
    parts = [pin(features.dns_partials(dns.filter(deal == i), SIX_HOURS)) for i in range(5)]
    return features.finish_dns(features.merge_partials(parts))


@query
def merge_partials(spark, sf_dir):
    auth = log_of(spark, sf_dir, "auth")
    error = F.col("result") == "Failure"
    parts = [features.sums(auth.filter(error), "auth", SIX_HOURS),
             features.sums(auth.filter(~error | error.isNull()), "auth", SIX_HOURS)]
    return features.finish(features.merge_partials(parts), "auth")


@query
def redteam_keys(spark, sf_dir):
    return features.redteam_keys(log_of(spark, sf_dir, "redteam"))


# Datasets

@query
def edr_master(spark, sf_dir):
    return edr_of(spark, sf_dir)


@query
def xdr_master(spark, sf_dir):
    return master_of(spark, sf_dir)


@query
def xdr_master_6h(spark, sf_dir):
    return master_of(spark, sf_dir, SIX_HOURS)


@query
def xdr_network_only(spark, sf_dir):
    return datasets.build_master(logs_of(spark, sf_dir), 300, keep_network_only=True)


def _joined_edr(logs, width):
    edr = datasets.build_edr(features.auth_features(logs["auth"], width),
                             features.proc_features(logs["proc"], width))
    return datasets.attach_label(edr, features.redteam_keys(logs["redteam"], width))


@query
def edr_join(spark, sf_dir):
    return _joined_edr(logs_of(spark, sf_dir), SIX_HOURS)


@query
def xdr_join(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    return datasets.build_xdr(
        _joined_edr(logs, SIX_HOURS), features.flow_features(logs["flows"], SIX_HOURS),
        features.dns_features(logs["dns"], SIX_HOURS))


@query
def semi_keys(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    flows = features.flow_features(logs["flows"]).select(*KEYS)
    return datasets.semi_keys(features.auth_features(logs["auth"]), flows)


@query
def anti_keys(spark, sf_dir):
    logs = logs_of(spark, sf_dir)
    flows = features.flow_features(logs["flows"]).select(*KEYS)
    return datasets.semi_keys(features.auth_features(logs["auth"]), flows, anti=True)


@query
def dataset_summary(spark, sf_dir):
    return datasets.dataset_summary(
        {"EDR": edr_of(spark, sf_dir), "XDR": master_of(spark, sf_dir, SIX_HOURS)})


# Order and splits

@query
def sorted_filtered(spark, sf_dir):
    return order.global_index(order.sort_filter(edr_of(spark, sf_dir)))


@query
def split_last_days(spark, sf_dir):
    return splits.split_last_days(pin(edr_of(spark, sf_dir).select(*KEYS, "label")))


@query
def split_fixed_days(spark, sf_dir):
    return splits.split_days(master_of(spark, sf_dir).select(*KEYS, "dns_queries", "label"))


@query
def split_and_save(spark, sf_dir):
    master = pin(master_of(spark, sf_dir, SIX_HOURS))
    paths = splits.split_and_save(
        {"EDR": datasets.edr_of(master), "XDR": master}, scratch_path(spark, "splits"))
    parts = [spark.read.parquet(p).groupBy("split").agg(
        F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").alias("malicious"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day")) for name, p in paths.items()]
    return parts[0].unionByName(parts[1])


# Balancing

def _indexed(spark, sf_dir):
    """Positions of the kept rows; only keys and label are sorted."""
    return order.global_index(order.sort_filter(edr_of(spark, sf_dir).select(*KEYS, "label")))


@query
def context_candidates(spark, sf_dir):
    return sampling.context_candidates(_indexed(spark, sf_dir))


@query
def draw_sizes(spark, sf_dir):
    return sampling.draw_sizes(_indexed(spark, sf_dir).filter("label = 1").select("idx"))


def _study_master(spark, sf_dir):
    """The stored master of the kept days: balancing reads it more than once."""
    return pin(filter_days(master_of(spark, sf_dir), KEPT_DAYS))


@query
def context_balance_edr(spark, sf_dir):
    master = _study_master(spark, sf_dir)
    return sampling.context_balance(datasets.edr_of(master), master)[0]


@query
def context_balance_xdr(spark, sf_dir):
    master = _study_master(spark, sf_dir)
    return sampling.context_balance(datasets.edr_of(master), master)[1]


@query
def slice_like(spark, sf_dir):
    master = _study_master(spark, sf_dir)
    edr = datasets.edr_of(master)
    chosen, _ = sampling.context_balance(edr, edr, 5, 10, 20, seed=7)
    return sampling.slice_like(master, chosen).select(*KEYS, "flows_count", "label")


@query
def context_balance_tight(spark, sf_dir):
    edr = datasets.edr_of(_study_master(spark, sf_dir))
    kept, _ = sampling.context_balance(edr, edr, 5, 10, 20, seed=7)
    return kept.select("idx", *KEYS, "label")


@query
def study_splits(spark, sf_dir):
    study = Study(balance="context", min_context=5, max_context=20)
    tables = study_tables(logs_of(spark, sf_dir), study)
    parts = [df.groupBy("split").agg(
        F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("label").alias("malicious")) for name, df in tables.items()]
    return parts[0].unionByName(parts[1])


def _numeric_rows(spark, sf_dir):
    """Rows with whole-number features and no gaps."""
    b = fixtures.base(spark, sf_dir)
    return b.select(
        F.col("event_id").alias("row_id"), F.when(F.col("k") < 7, 1).otherwise(0).alias("label"),
        F.floor(F.col("value") * 100).cast("double").alias("x"), F.col("k").cast("double")
        .alias("z"), F.floor(F.col("t") / 3600).cast("double").alias("hour"))


@query
def smote_rows(spark, sf_dir):
    return smote(_numeric_rows(spark, sf_dir), ["x", "z", "hour"], "row_id")


@query
def smote_blocks(spark, sf_dir):
    """The same rows from many small blocks, whose pairs in reach are found in the tree of boxes."""
    return smote(_numeric_rows(spark, sf_dir), ["x", "z", "hour"], "row_id", block_rows=64)


@query
def balanced_bags(spark, sf_dir):
    rows = _numeric_rows(spark, sf_dir).select("row_id", "label")
    return sampling.balanced_bag(rows, "row_id", bags=4)


# Preparation

def _dirty_sides(spark, sf_dir):
    dirty = fixtures.view(spark, sf_dir, "dirty")
    return (dirty.filter(F.col("day") < TRAIN_BEFORE), dirty.filter(F.col("day") >= TRAIN_BEFORE))


@query
def prepare_train_test(spark, sf_dir):
    train, test = _dirty_sides(spark, sf_dir)
    done = prep.prepare(train, test.drop("konst"), keep=["row_id"])
    return done.train.withColumn("split", F.lit("train")).unionByName(
        done.test.withColumn("split", F.lit("test")))


@query
def column_medians(spark, sf_dir):
    train, _ = _dirty_sides(spark, sf_dir)
    return order.exact_quantiles(clean_inf(train, ["x"]), ["x", "z", "konst", "day"], 0.5)


@query
def medians_of_increments(spark, sf_dir):
    """Exact medians with the sketches of each day merged instead of a first pass over all days."""
    train = pin(clean_inf(_dirty_sides(spark, sf_dir)[0], ["x"]))
    cols = ["x", "z", "konst", "day"]
    days = [pin(order.quantile_sketches(train.filter(F.col("day") % 4 == i), cols)) for i in range(4)]
    return order.exact_quantiles(train, cols, 0.5, sketches=order.merge_sketches(days))


@query
def column_quantiles(spark, sf_dir):
    train, _ = _dirty_sides(spark, sf_dir)
    return order.exact_quantiles(clean_inf(train, ["x"]), ["x", "z"], 0.93)


@query
def encode_labels(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    codes = prep.label_codes(events, "event_type")
    return prep.encode_labels(events, "event_type", codes)


@query
def align_columns(spark, sf_dir):
    _, test = _dirty_sides(spark, sf_dir)
    return prep.align(test, ["z", "absent", "day"], ["row_id"])


@query
def class_balance(spark, sf_dir):
    return prep.class_balance(fixtures.view(spark, sf_dir, "dirty"))


@query
def overview(spark, sf_dir):
    return prep.overview(*_dirty_sides(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return prep.class_weights(_dirty_sides(spark, sf_dir)[0])


@query
def baseline_accuracy(spark, sf_dir):
    return prep.baseline_accuracy(*_dirty_sides(spark, sf_dir))


# Evaluation

def _scored(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "scored")


def _ranked(spark, sf_dir):
    return evaluate.rank_scores(_scored(spark, sf_dir))


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(_scored(spark, sf_dir))


@query
def confusion_pct(spark, sf_dir):
    return evaluate.confusion_pct(_scored(spark, sf_dir))


@query
def confusion_multi(spark, sf_dir):
    return evaluate.error_rates(fixtures.view(spark, sf_dir, "scored3"))


@query
def error_rates(spark, sf_dir):
    return evaluate.error_rates(_scored(spark, sf_dir))


@query
def binary_metrics(spark, sf_dir):
    return evaluate.binary_metrics(_scored(spark, sf_dir))


@query
def weighted_metrics(spark, sf_dir):
    return evaluate.weighted_metrics(fixtures.view(spark, sf_dir, "scored3"))


@query
def balanced_accuracy(spark, sf_dir):
    scored3 = fixtures.view(spark, sf_dir, "scored3")
    both = _scored(spark, sf_dir).select("model", "y", "pred").unionByName(
        scored3.select("model", "y", "pred"))
    return evaluate.balanced_accuracy(both)


@query
def class_report(spark, sf_dir):
    return evaluate.class_report(fixtures.view(spark, sf_dir, "scored3"))


@query
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_ranked(spark, sf_dir))


@query
def average_precision(spark, sf_dir):
    return evaluate.average_precision(_ranked(spark, sf_dir))


@query
def roc_auc_ovr(spark, sf_dir):
    scored3 = fixtures.view(spark, sf_dir, "scored3")
    each = scored3.select("model", "y", "pred", F.explode(F.array(*map(F.lit, range(3))))
                          .alias("class"))
    return evaluate.roc_auc_ovr(each.withColumn(
        "score", (F.col("pred") == F.col("class")).cast("double")))


@query
def roc_curve(spark, sf_dir):
    return evaluate.roc_curve(_ranked(spark, sf_dir))


@query
def roc_curve_full(spark, sf_dir):
    return evaluate.roc_curve(_ranked(spark, sf_dir), drop_collinear=False)


@query
def pr_curve(spark, sf_dir):
    return evaluate.pr_curve(_ranked(spark, sf_dir))


@query
def threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_scored(spark, sf_dir))


@query
def score_histogram(spark, sf_dir):
    return evaluate.score_histogram(_scored(spark, sf_dir))


@query
def percent_positive(spark, sf_dir):
    return evaluate.percent_positive(_scored(spark, sf_dir), 0.25)


@query
def tune_threshold_first(spark, sf_dir):
    return evaluate.tune_threshold(_ranked(spark, sf_dir), rule="first")


@query
def tune_threshold_max(spark, sf_dir):
    return evaluate.tune_threshold(_ranked(spark, sf_dir), rule="max_threshold")


@query
def tuned_predictions(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    tuned = evaluate.tune_threshold(_ranked(spark, sf_dir), rule="max_threshold")
    return evaluate.confusion(evaluate.apply_tuning(scored, tuned))


@query
def compare(spark, sf_dir):
    return evaluate.compare(_scored(spark, sf_dir))


@query
def compare_classes(spark, sf_dir):
    scored3 = fixtures.view(spark, sf_dir, "scored3")
    each = scored3.select("model", "y", "pred", F.explode(F.array(*map(F.lit, range(3)))).alias("class"))
    return evaluate.compare_classes(scored3, each.withColumn(
        "score", (F.col("pred") == F.col("class")).cast("double")))


@query
def compare_rounded(spark, sf_dir):
    return round_doubles(evaluate.compare(_scored(spark, sf_dir)))


@query
def best_models(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return evaluate.best_models(evaluate.compare(scored), evaluate.error_rates(scored),
                                ["noise", "blend", "no_score"])


@query
def report_sections(spark, sf_dir):
    tables = evaluate.report_tables(_scored(spark, sf_dir), "EDR", rule="max_threshold")
    parts = [t.groupBy("dataset", "model").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "dataset", F.lit(name).alias("section"), "model", "n_rows") for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def report_values(spark, sf_dir):
    tables = evaluate.report_tables(_scored(spark, sf_dir), "EDR", rule="max_threshold")

    def values(section, measures):
        return tables[section].unpivot(["model"], measures, "measure", "value").select(
            F.lit(section).alias("section"), "model", "measure", "value")

    best = tables["best_models"].select(
        F.lit("best_models").alias("section"), "model", F.col("metric").alias("measure"), F.col("score").alias("value"))
    return (values("comparison", evaluate.METRICS).unionAll(values("errors", evaluate.ERROR_RATES))
            .unionAll(values("tuning", ["threshold"])).unionAll(best).filter("value is not null"))


# Text

def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query
def tokens(spark, sf_dir):
    return text.tokens(_docs(spark, sf_dir))


@query
def successors(spark, sf_dir):
    listed = text.successors(_docs(spark, sf_dir))
    return listed.select("doc_id", "word", F.size("nexts").alias("n"),
                         F.array_join("nexts", " ").alias("nexts"))


@query
def successor_counts(spark, sf_dir):
    return text.successor_counts(_docs(spark, sf_dir))


# Streaming

@query
def stream_many_batches(spark, sf_dir):
    """The same features over the log in four deliveries in time order, one per micro-batch, compacted."""
    auth = log_of(spark, sf_dir, "auth")
    source, out, compact = (scratch_path(spark, n) for n in ("log", "windows", "compact"))
    week = F.floor(F.col("time").try_cast("bigint") / (8 * 86_400)).cast("int")
    # Stored once, as every delivery is taken from it; its files are written by many tasks.
    parts = pin(auth.withColumn("part", F.coalesce(F.least(week, F.lit(3)), F.lit(0))))
    state = scratch_path(spark, "stream")
    for part in range(4):  # the stream goes on where it stopped
        write_table(parts.filter(F.col("part") == part).drop("part"), source, "csv", "append")
        stream = spark.readStream.schema(auth.schema).option("header", True).option("escape", '"').csv(source)
        run_stream(stream_features(stream, "auth", watermark="3 days"), out, state)
    compact_windows(spark, out, compact)
    windows = spark.read.parquet(compact).withColumn("day", F.col("day").cast("bigint"))
    return features.finish(windows.select(*KEYS, *features.row_measures("auth")), "auth")


def _streamed(spark, sf_dir, kind):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return null_tokens(fixtures.view_of(fixtures.base_of(events), kind))


def _stream_features(spark, sf_dir, kind):
    out = scratch_path(spark, "windows")
    run_stream(stream_features(_streamed(spark, sf_dir, kind), kind), out, scratch_path(spark, "stream"))
    return features.finish(read_windows(spark, out), kind)


@query
def stream_auth_features(spark, sf_dir):
    return _stream_features(spark, sf_dir, "auth")


@query
def stream_proc_features(spark, sf_dir):
    return _stream_features(spark, sf_dir, "proc")


@query
def stream_flow_features(spark, sf_dir):
    return _stream_features(spark, sf_dir, "flows")


@query
def stream_dns_features(spark, sf_dir):
    return _stream_features(spark, sf_dir, "dns")


@query
def stream_xdr(spark, sf_dir):
    """The labelled table of all five logs from one stream, compacted."""
    rows = datasets.master_rows({k: _streamed(spark, sf_dir, k) for k in fixtures.LOGS})
    out, compact = scratch_path(spark, "partials"), scratch_path(spark, "compact")
    run_partials(rows, out, scratch_path(spark, "stream"))
    compact_partials(spark, out, compact)
    return datasets.finish_master(spark.read.parquet(compact).withColumn("day", F.col("day").cast("bigint")))


@query
def stream_late_windows(spark, sf_dir):
    """DNS windows of four deliveries of which the third comes last, those in time and those late."""
    dns = log_of(spark, sf_dir, "dns")
    source, out, state = (scratch_path(spark, n) for n in ("log", "partials", "stream"))
    week = F.floor(F.col("time").try_cast("bigint") / (8 * 86_400)).cast("int")
    parts = dns.withColumn("part", F.coalesce(F.least(week, F.lit(3)), F.lit(0)))
    for part in (0, 1, 3, 2):  # the stream goes on where it stopped
        write_table(parts.filter(F.col("part") == part).drop("part"), source, mode="append")
        stream = spark.readStream.schema(dns.schema).parquet(source)
        run_partials(features.keyed_rows(stream, "dns", 300), out, state, delay=3 * 86_400)
    return read_partials(spark, out, late=False).withColumn("late", F.lit(0)).unionByName(
        read_partials(spark, out, late=True).withColumn("late", F.lit(1)))


# Three classes

def _three(spark, sf_dir):
    """Events with three classes that their value and code tell apart with some noise."""
    b = fixtures.base(spark, sf_dir)
    noise = F.pmod(F.col("event_id") * 7919, F.lit(10))
    kind = F.when(F.col("k") + noise < 50, "low").when(F.col("k") + noise < 85, "middle").otherwise("top")
    rows = b.select(F.col("event_id").alias("row_id"), kind.alias("label"), F.col("k").cast("double").alias("k"),
                    "value", F.floor(F.col("t") / 86_400).alias("day"))
    return prep.prepare(rows.filter(F.col("day") < TRAIN_BEFORE), rows.filter(F.col("day") >= TRAIN_BEFORE),
                        include_time=False, keep=["row_id"])


@query
def class_probabilities_auc(spark, sf_dir):
    """One-vs-rest ROC-AUC of given class scores, weighted by support."""
    b = fixtures.base(spark, sf_dir)
    scores = F.array(*[((F.col("k") + 37 * c + F.pmod(F.col("event_id") * 7919, F.lit(20))) % 100).cast("double") / 100
                       for c in range(3)])
    rows = b.select(F.lit("tri").alias("model"), (F.col("k") % 3).cast("int").alias("y"), scores.alias("scores"))
    return evaluate.roc_auc_ovr(by_class(rows))


@query
def train_three_classes(spark, sf_dir):
    """What is true of every model of three classes that learned something."""
    _, scored = train_and_score(_three(spark, sf_dir), "row_id", settings=SMALL)
    scored = pin(scored)
    told = evaluate.class_tables(scored, by_class(scored), "events")["comparison"]
    facts = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pred").alias("answers"),
        F.count_if(F.abs(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).alias("odd_sums"),
        F.count("scores").alias("with_scores"))
    return facts.join(told, "model").select(
        "model", "n_rows", "answers", "odd_sums", "with_scores", (F.col("balanced_accuracy") > 0.5).alias("informed"),
        F.col("roc_auc").isNotNull().alias("with_area"))


# Models. The training rows are the whole XDR table at a width with several events per row.

def _prepared(spark, sf_dir):
    master = master_of(spark, sf_dir, SIX_HOURS).withColumn("row_id", F.concat_ws("|", *KEYS))
    stored = scratch_path(spark, "prepared")
    write_split(splits.split_last_days(master), stored)
    rows = spark.read.parquet(stored)
    return prep.prepare(splits.take(rows, "train"), splits.take(rows, "test"), keep=["row_id"])


def _predictions(spark, sf_dir, name, fit):
    done = _prepared(spark, sf_dir)
    model = fit(done)
    out = model.transform(assemble(done.test, done.features))
    score = None
    if "probability" in out.columns:
        score = vector_to_array(F.col("probability"))[1]
    elif "score" in out.columns:
        score = F.col("score")
    pred = F.col("prediction" if "prediction" in out.columns else "pred")
    return scored_rows(name, out, "row_id", score, pred)


def _summary(scored):
    """What SQL can state of each fit, and what must be true of any that learned something.

    ``answers`` is the number of classes predicted; ``informed`` whether predictions, or scores
    where there are any, are higher on average for positive rows.
    """
    told = F.coalesce("score", F.col("pred").cast("double"))
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("n_ids"),
        F.sum(F.col("y").cast("bigint")).alias("positives"), F.count("score").alias("with_score"),
        F.count_if(~F.col("score").between(0, 1) | F.isnan("score")).alias("outside"),
        F.count_if(~F.col("pred").isin(0, 1) | F.col("pred").isNull()).alias("odd_answers"),
        F.count_if(F.col("score").isNotNull() & (F.abs(F.col("score") - 0.5) > 1e-9)
                   & ((F.col("score") > 0.5).cast("int") != F.col("pred"))).alias("disagree"),
        (F.count_distinct(told) > 1).alias("varied"),
        (F.avg(F.when(F.col("y") == 1, told)) > F.avg(F.when(F.col("y") == 0, told))).alias("informed"))


@query
def fit_logistic(spark, sf_dir):
    return _summary(_predictions(spark, sf_dir, MODEL_NAMES[0], lambda p: fit_logreg(p.train, p.features)))


@query
def fit_forest_smote(spark, sf_dir):
    return _summary(_predictions(spark, sf_dir, MODEL_NAMES[1],
                        lambda p: fit_rf_smote(p.train, p.features, "row_id", SMALL)))


@query
def fit_boosted(spark, sf_dir):
    """Boosted trees of full size: all rounds and the depth of ``Settings()``."""
    return _summary(_predictions(spark, sf_dir, MODEL_NAMES[2],
                        lambda p: fit_gbt(p.train, p.features, Settings())))


@query
def fit_balanced_forest(spark, sf_dir):
    return _summary(_predictions(spark, sf_dir, MODEL_NAMES[3],
                        lambda p: fit_balanced_rf(p.train, p.features, "row_id", SMALL)))


@query
def fit_svm(spark, sf_dir):
    return _summary(_predictions(spark, sf_dir, MODEL_NAMES[4],
                        lambda p: fit_linear_svm(p.train, p.features)))


@query
def iforest_scores(spark, sf_dir):
    done = _prepared(spark, sf_dir)
    forest = fit_iforest(done.train, done.features, "row_id")
    score = F.col("anomaly")
    return score_iforest(done.test, forest).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("y").cast("bigint")).alias("positives"),
        F.count_if((score <= 0) | (score >= 1) | score.isNull()).alias("outside"),
        F.lit(len(forest["trees"])).alias("trees"), (F.count_distinct(score) > 1).alias("varied"))


@query
def train_and_score_all(spark, sf_dir):
    done = _prepared(spark, sf_dir)
    _, scored = train_and_score(done, "row_id", settings=SMALL)
    return _summary(scored)


@query
def top_features(spark, sf_dir):
    done = _prepared(spark, sf_dir)
    fitted = {MODEL_NAMES[0]: fit_logreg(done.train, done.features),
              MODEL_NAMES[2]: fit_gbt(done.train, done.features, SMALL)}
    top = evaluate.top_features(importances(spark, fitted, done.features))
    below = Window.partitionBy("model").orderBy("rank")
    ordered = top.withColumn("before", F.lag("importance").over(below))
    return ordered.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("feature").alias("n_features"),
        F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.count_if(F.col("before") < F.col("importance")).alias("out_of_order"),
        F.count_if(F.col("importance") != F.abs("coefficient")).alias("odd_coefficients"),
        F.count("coefficient").alias("coefficients"), (F.max("importance") > 0).alias("informed"))

