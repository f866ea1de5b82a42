"""The whole chain: raw logs to labelled, balanced and split tables, models and reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwin.functions.scalars import filter_days
from hostwin.operators.datasets import build_master, edr_of
from hostwin.operators.evaluate import class_tables, report_tables, top_features
from hostwin.operators.models import MODEL_NAMES, Settings, by_class, importances, train_and_score
from hostwin.operators.prep import baseline_accuracy, class_balance, overview, prepare
from hostwin.operators.sampling import MAX_CONTEXT, MIN_CONTEXT, class_counts, context_balance
from hostwin.operators.splits import split_days, take
from hostwin.schemas import KEPT_DAYS, KEYS, TEST_DAYS, TRAIN_DAYS, WINDOW_SECONDS
from hostwin.session import pin, scratch_scope
from hostwin.sources.tables import write_table


@dataclass
class Study:
    """Parameters of a study; the defaults are the usual ones."""

    width: int = WINDOW_SECONDS
    keep_days: list[int] = field(default_factory=lambda: list(KEPT_DAYS))
    train_days: list[int] = field(default_factory=lambda: list(TRAIN_DAYS))
    test_days: list[int] = field(default_factory=lambda: list(TEST_DAYS))
    # Training days used to choose cut-offs, not to fit; with none, the test rows choose.
    validation_days: list[int] = field(default_factory=list)
    balance: str = "none"  # or "context"
    min_context: int = MIN_CONTEXT
    max_context: int = MAX_CONTEXT
    include_time: bool = True
    target_recall: float = 0.80
    tuning_rule: str = "first"
    models: list[str] = field(default_factory=lambda: list(MODEL_NAMES))
    settings: Settings = field(default_factory=Settings)
    seed: int = 0


def study_tables(logs: dict[str, DataFrame], study: Study) -> dict[str, DataFrame]:
    """EDR and XDR rows of the study days with their ``split``, balanced if asked for."""
    # Days that are not studied are dropped from the logs, before anything is shuffled.
    master = pin(filter_days(build_master(logs, study.width), study.keep_days))
    edr, xdr = edr_of(master), master
    if study.balance == "context":
        edr, xdr = context_balance(
            edr, xdr, study.min_context, study.max_context, study.max_context, study.seed)
        edr = edr.drop("idx")
    elif study.balance != "none":
        raise ValueError(f"unknown balance '{study.balance}'")
    return {name: split_days(df, study.train_days, study.test_days)
            for name, df in (("EDR", edr), ("XDR", xdr))}


def evaluate_dataset(name: str, train: DataFrame, test: DataFrame,
                     study: Study) -> dict[str, DataFrame]:
    """Prepare, train and score one dataset; all report tables and the feature importances."""
    def keyed(df: DataFrame, fold: str) -> DataFrame:
        return df.withColumn("row_id", F.concat_ws("|", F.lit(fold), *KEYS))

    held = F.col("day").isin(study.validation_days) if study.validation_days else F.lit(False)
    fit_on = keyed(train.filter(~held), "train")
    to_score = keyed(test, "test")
    if study.validation_days:
        to_score = to_score.unionByName(keyed(train.filter(held), "valid"))
    prep = prepare(fit_on, to_score, study.include_time, keep=["row_id"])
    if len(class_counts(prep.train, "y")) < 2:
        raise ValueError(f"{name} has a single class")
    fitted, scored = train_and_score(prep, "row_id", study.models, study.settings)
    scored = pin(scored)
    valid = F.startswith("row_id", F.lit("valid|"))
    if prep.binary:
        tables = report_tables(
            scored.filter(~valid), name, study.models, study.target_recall, study.tuning_rule,
            scored.filter(valid) if study.validation_days else None)
    else:
        # There is no cut-off to tune between more than two classes.
        tables = class_tables(scored.filter(~valid), by_class(scored.filter(~valid)), name)
    weights = importances(train.sparkSession, fitted, prep.features)
    more = {"overview": overview(train, test, study.include_time),
            "class_balance": data_balance(train, test),
            "baseline": baseline_accuracy(train, test),
            "importances": weights, "top_features": top_features(weights)}
    return tables | {n: t.select(F.lit(name).alias("dataset"), "*") for n, t in more.items()}


def data_balance(train: DataFrame, test: DataFrame) -> DataFrame:
    """Class balance of both sides, with the warning where one is extremely unbalanced."""
    sides = [class_balance(df).withColumn("split", F.lit(side))
             for df, side in ((train, "train"), (test, "test"))]
    return sides[0].unionByName(sides[1])


def run_study(logs: dict[str, DataFrame], path: str, study: Study | None = None) -> list[str]:
    """Build, split, train and evaluate EDR and XDR; write the tables under ``path``.

    Tables go to ``path/tables/<dataset>`` by split, reports to
    ``path/report/<section>`` with one folder per dataset. What was stored on the way is removed.
    """
    study = study or Study()
    spark = next(iter(logs.values())).sparkSession
    written = []
    with scratch_scope(spark):
        for name, df in study_tables(logs, study).items():
            target = f"{path}/tables/{name}"
            write_table(df, target, partition_by=["split"])
            stored = spark.read.parquet(target).select(*df.columns)
            reports = evaluate_dataset(name, take(stored, "train"), take(stored, "test"), study)
            for section, table in reports.items():
                out = f"{path}/report/{section}/dataset={name}"
                write_table(table.drop("dataset"), out)
                written.append(out)
    return written
