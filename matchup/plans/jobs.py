"""End-to-end jobs on the stand-in tables.

* ``feature_dataset`` (E1): meetings + each side's history through the
  previous period + per-side dimension (median-filled) + pair lookup +
  targets, as one lazy plan.
* ``training_matrix`` (E3/S8): labelled rows, leakage dropped, class
  exclusion, the cleaning policy; written partitioned by season to the
  shared folder and read back, which also cuts the lineage for the fits.
* ``train`` (E8): early-stopped winner and margin models, isotonic
  calibration kept only when it helps the holdout Brier, production refit
  with the frozen round count, holdout report, contract.
* ``score_and_publish`` (E4/E5): the open slate (``open_slate``) scored,
  calibrated, rounded and published per (season, week).
"""

from __future__ import annotations

import os
import threading
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.functions import scalar
from matchup.operators import calibrate, clean, contract, enrich, labels, learn, metrics, reshape
from matchup.plans import physical
from matchup.plans import standins as st
from matchup.session import drop_folder, folder_exists, scratch_path
from matchup.sources import models

# Stand-in season constants: train <= 1998, early stop / calibration 1999,
# honest holdout 2000, production refit <= 2000.
TRAIN_MAX, CALIB, HOLDOUT, PROD_MAX = 1998, 1999, 2000, 2000
STAT_COLS = [f"{side}_{s}" for side in ("home", "away") for s in st.STAT_NAMES]
MARKET_COLS = ["p_home", "p_away", "p_differential"]
CATEGORICALS = ["home_segment"]
FEATURES = (
    ["period", "home_segment"] + STAT_COLS
    + ["home_has_stats", "away_has_stats", "home_talent", "away_talent", "talent_differential"]
)
TARGETS = ["home_points", "away_points", "home_win", "point_differential"]

POLICY = clean.CleaningPolicy(
    class_columns=["flag"],
    class_patterns=("n",),
    drop_columns=["flag", "completed", "start_ts"],
    zero_fill=STAT_COLS,
    zero_fill_patterns=("talent",),
    nested_columns=(),
    essentials=("season", "period", "home", "away"),
    keep_null=tuple(MARKET_COLS),
    targets=tuple(TARGETS),
    categorical=CATEGORICALS,
)


def history_cumulative(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    wide = reshape.pivot_first(
        st.history_long(spark, sf_dir, facts), ["entity", "season", "period"], "stat_name", "stat_value",
        st.STAT_NAMES, "ord",
    )
    return reshape.cumulate(wide, "entity", "season", "period", st.STAT_NAMES, st.MAX_PERIOD)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = st.meetings(spark, sf_dir)
    return (
        m.groupBy("season", "home", "away")
        .agg(F.count_if(F.col("discount") >= 0.05).alias("k"), F.count(F.lit(1)).alias("n"))
        .withColumn("p_home", F.col("k") / F.col("n"))
        .where(st.kept_pair("season", "home", "away"))
        .select(F.col("season").alias("ps"), F.col("home").alias("ph"), F.col("away").alias("pa"), "p_home")
    )


def feature_dataset(
    spark: SparkSession, sf_dir: str, meetings: DataFrame | None = None, market: bool = True, season: int | None = None,
    shown: bool = False,
) -> DataFrame:
    """One lazy plan from meetings to the wide feature rows.

    ``market=False`` skips the pair (market) lookup: the models exclude those
    columns, so scoring does not pay for them. ``season``: the meetings are all
    of that season, so the history and the dimension read its orders only.
    ``shown``: the history's values have 2 decimals and the pair's 6, rounded in
    those small tables and not again in every meeting that looks them up.
    """
    m = meetings if meetings is not None else st.meetings(spark, sf_dir)
    m = m.select(
        "order_key", "line", "season", "period", "home", "away", "completed",
        "home_points", "away_points", "flag", "home_segment", "start_ts",
    )
    sides = {"home": "home", "away": "away"}
    # One bounded aggregate of orders x customers feeds both the history and the
    # season dimension (one pass over orders instead of two).
    facts, _ = physical.small_side(st.nation_period_facts(spark, sf_dir, season))
    history = history_cumulative(spark, sf_dir, facts)
    if shown:
        history = history.withColumns({s: scalar.round_half_away(s, 2) for s in st.STAT_NAMES})
    j = enrich.join_point_in_time(
        m, history, "season", "period", sides, "entity", st.STAT_NAMES
    )
    # Probed and cached once: the lookup and the season medians both read it.
    dim, _ = physical.small_side(st.nation_season_dim(spark, sf_dir, facts))
    j = enrich.join_sides(j, dim, "season", sides, "entity", ["talent"])
    j = enrich.fill_group_median(j, dim, "season", "season", "talent", ["home_talent", "away_talent"])
    j = enrich.differential(j, "home_talent", "away_talent", "talent_differential")
    if market:
        p = pairs(spark, sf_dir).withColumn("p_away", scalar.complement("p_home"))
        p = p.withColumn("p_differential", F.col("p_home") - F.col("p_away"))
        if shown:
            p = p.withColumns({c: scalar.round_half_away(c, 6) for c in MARKET_COLS})
        j = enrich.join_pair(j, p, {"season": "ps", "home": "ph", "away": "pa"}, MARKET_COLS)
    return labels.add_targets(j, "home_points", "away_points")


def clean_features(df: DataFrame) -> DataFrame:
    """E2 with the stand-in policy (class exclusion applied early too, P5)."""
    df = clean.exclude_classes(df, POLICY.class_columns, POLICY.class_patterns)
    return clean.clean(df, POLICY)


def training_matrix(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Labelled, cleaned matrix written by season and read back."""
    fd = feature_dataset(spark, sf_dir)
    labelled = clean.require_non_null(fd, ["home_points", "away_points"])
    matrix = clean_features(clean.drop_present(labelled, ["home_points", "away_points"]))
    path = path or scratch_path(spark, "training-matrix")
    physical.write_layout(matrix, ["season"]).write.mode("overwrite").partitionBy("season").parquet(path)
    return spark.read.parquet(path)


_MATRICES: dict = {}


def shared_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training matrix written once per session and data folder, then
    re-read by the training job and by the search (as both read one matrix)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _MATRICES:
            _MATRICES[key] = training_matrix(spark, sf_dir)
        return _MATRICES[key]


@dataclass
class Trained:
    """A stored version: what a scoring run and the reports need."""

    contract: contract.FeatureContract
    margin_contract: contract.FeatureContract | None
    winner: dict
    margin: dict
    winner_prod: PipelineModel
    margin_prod: PipelineModel | None
    report: DataFrame
    path: str
    contract_path: str


REPORT_SCHEMA = (
    "model string, variant string, n long, accuracy double, auc double, brier double, logloss double, "
    "mae double, rmse double, sign_accuracy double"
)
TRAINING_TABLES = ("orders", "lineitem", "customer", "supplier")
#: Raised when the features, targets or the stored layout change: older versions are not read.
STORE_FORMAT = 1
_LOADED: dict = {}
_LOCK = threading.RLock()


def training_key(spark: SparkSession, sf_dir: str, **settings) -> str:
    """Signature of the tables and of everything that decides what is trained on them."""
    own = {"format": STORE_FORMAT, "features": FEATURES, "winner": learn.WINNER_PARAMS, "margin": learn.MARGIN_PARAMS,
           "seed": learn.SEED, "seasons": [TRAIN_MAX, CALIB, HOLDOUT, PROD_MAX], **settings}
    return models.signature(spark, [f"{sf_dir}/{t}.parquet" for t in TRAINING_TABLES], own)


def train(
    spark: SparkSession, sf_dir: str, max_rounds: int = learn.MAX_ROUNDS, patience: int = learn.PATIENCE, root: str | None = None
) -> Trained:
    """The newest stored version for these tables and settings; trained and stored first if there is none.

    Booster settings are the library's (``learn.WINNER_PARAMS``, ``MARGIN_PARAMS``).
    """
    with _LOCK:
        key = "models-" + training_key(spark, sf_dir, rounds=max_rounds, patience=patience)
        path = models.current(spark, key, root)
        if path is None:
            progress = os.path.join(root or models.store_root(spark), key, "progress")
            path = models.publish(spark, key, lambda to: _train(spark, sf_dir, max_rounds, patience, to, progress), root)
        at = (spark.sparkContext.applicationId, path)
        if at not in _LOADED:
            _LOADED[at] = load_trained(spark, path)
        return _LOADED[at]


def load_trained(spark: SparkSession, path: str) -> Trained:
    """Models and contracts of a stored version; a version without a margin model has None there."""
    history = models.read_document(spark, os.path.join(path, "history"))
    margin = os.path.join(path, "margin")
    has_margin = folder_exists(spark, margin)
    contract_path = os.path.join(path, "contract")
    return Trained(
        contract=contract.load_contract(spark, contract_path),
        margin_contract=contract.load_contract(spark, os.path.join(path, "margin_contract")) if has_margin else None,
        winner=history["winner"], margin=history["margin"],
        winner_prod=PipelineModel.load(os.path.join(path, "winner")),
        margin_prod=PipelineModel.load(margin) if has_margin else None,
        report=spark.createDataFrame([tuple(r) for r in history["report"]], REPORT_SCHEMA),
        path=path, contract_path=contract_path,
    )


def _train(spark: SparkSession, sf_dir: str, max_rounds: int, patience: int, path: str, progress: str) -> None:
    """Train both models and write a version (models, contracts, history) to ``path``."""
    matrix = shared_matrix(spark, sf_dir)
    data = labels.split_by_season(matrix, "season", TRAIN_MAX, CALIB, HOLDOUT, prod_max=PROD_MAX)
    data = data.withColumn("home_win", F.col("home_win").cast("double"))
    labels.require_splits(labels.split_counts(data))
    # The model sees features and target only; rows without a target go.
    data = data.where(F.col("home_win").isNotNull() & F.col("point_differential").isNotNull())
    train_df = data.where(F.col("split") == "train")
    calib_df = data.where(F.col("split") == "calib")
    hold_df = data.where(F.col("split") == "holdout")
    prod_df = data.where(F.col("split_prod"))
    ctr = contract.fit_contract(train_df, FEATURES, CATEGORICALS, essentials=["talent_differential"])
    ctr.excluded_features = MARKET_COLS

    # Assembled once. The two fits and their production refits (M5, M6: more seasons, the rounds of the evaluated fit) go
    # on together and keep their progress beside the versions, so a run that is lost is gone on with.
    kinds = {"winner": "home_win", "margin": "point_differential"}
    ready = learn.prepared({"train": train_df, "calib": calib_df}, "train", FEATURES, CATEGORICALS, list(kinds.values()))
    prod_ready = learn.prepared({"prod": prod_df}, "prod", FEATURES, CATEGORICALS, list(kinds.values()))
    evaluated: dict = {}

    def evaluate(fits: dict[str, learn.FitResult]) -> None:
        winner, margin = fits["winner"], fits["margin"]
        # Calibration: isotonic on the calibration season, judged on the holdout.
        calib_scored = learn.predict(winner.model, physical.spread(calib_df), "p_raw")
        xs, ys = calibrate.fit_isotonic(calib_scored, "p_raw", "home_win")
        hold_scored = learn.predict(winner.model, physical.spread(hold_df), "p_raw")
        hold_scored = calibrate.interpolate(hold_scored, "p_raw", xs, ys, "p_iso")
        hold_scored = learn.predict(margin.model, hold_scored, "margin", kind="margin")
        scored_path = scratch_path(spark, "holdout-scored")
        hold_scored.select("home_win", "point_differential", "p_raw", "p_iso", "margin").write.parquet(scored_path)
        hold_scored = spark.read.parquet(scored_path)
        variants = hold_scored.select("home_win", F.col("p_raw").alias("p"), F.lit("raw").alias("variant")).unionByName(
            hold_scored.select("home_win", F.col("p_iso").alias("p"), F.lit("isotonic").alias("variant"))
        )
        bm = metrics.binary_metrics(variants, "home_win", "p", by=["variant"])
        am = metrics.auc(variants, "home_win", "p", by=["variant"])
        rm = metrics.regression_metrics(hold_scored, "point_differential", "margin")
        none = F.lit(None).cast("double")
        report = (
            bm.join(am.select("variant", "auc"), "variant")
            .select(F.lit("winner").alias("model"), "variant", "n", "accuracy", "auc", "brier", "logloss",
                    *[none.alias(c) for c in ("mae", "rmse", "sign_accuracy")])
            .unionByName(
                rm.select(F.lit("margin").alias("model"), F.lit("raw").alias("variant"), "n",
                          *[none.alias(c) for c in ("accuracy", "auc", "brier", "logloss")],
                          "mae", "rmse", "sign_accuracy")
            )
        ).collect()  # a row a model and variant
        evaluated.update(knots=(xs, ys), report=report)
        drop_folder(spark, scored_path)

    trained = learn.fit_and_refit(ready, prod_ready, kinds, max_rounds, patience, progress, evaluate)
    (winner, winner_prod), (margin, margin_prod) = trained["winner"], trained["margin"]
    (xs, ys), report = evaluated["knots"], evaluated["report"]
    rows = {(r["model"], r["variant"]): r.asDict() for r in report}
    ship = bool(metrics.calibration_decision(spark.createDataFrame(
        [(v, rows["winner", v]["brier"]) for v in ("raw", "isotonic")], "variant string, brier double")).first()["ship_calibration"])
    ctr.calibration = {"method": "isotonic" if ship else "none", "X_thresholds": xs, "y_thresholds": ys}
    ctr.honest_holdout_metrics = {
        "uncalibrated": {k: rows[("winner", "raw")][k] for k in ("accuracy", "auc", "brier", "logloss", "n")},
        "calibrated": {k: rows[("winner", "isotonic")][k] for k in ("accuracy", "auc", "brier", "logloss", "n")},
        "margin": {k: rows[("margin", "raw")][k] for k in ("mae", "rmse", "sign_accuracy", "n")},
        "best_iteration": winner.best_iteration,
        "margin_best_iteration": margin.best_iteration,
    }

    prod_ctr = contract.fit_contract(prod_df, FEATURES, CATEGORICALS)
    contract.same_categoricals(ctr, prod_ctr)
    ctr.categorical_values = prod_ctr.categorical_values
    ctr.production_model_metrics = {"rows": prod_df.count(), "features": len(FEATURES)}
    # The margin model has a contract of its own, with its own metrics and no calibration.
    margin_ctr = contract.FeatureContract(
        feature_columns=list(FEATURES), categorical_features=list(CATEGORICALS), categorical_values=prod_ctr.categorical_values,
        excluded_features=list(MARKET_COLS), honest_holdout_metrics={"margin": ctr.honest_holdout_metrics["margin"]},
        production_model_metrics=ctr.production_model_metrics,
    )

    contract.save_contract(spark, ctr, os.path.join(path, "contract"))
    contract.save_contract(spark, margin_ctr, os.path.join(path, "margin_contract"))
    winner_prod.write().overwrite().save(os.path.join(path, "winner"))
    margin_prod.write().overwrite().save(os.path.join(path, "margin"))
    models.write_document(spark, {
        "winner": {"losses": winner.losses, "best_iteration": winner.best_iteration},
        "margin": {"losses": margin.losses, "best_iteration": margin.best_iteration},
        "report": [list(r) for r in report],
    }, os.path.join(path, "history"))


def search(
    spark: SparkSession, sf_dir: str, n_trials: int = learn.TRIALS, parallelism: int = 3, root: str | None = None
) -> tuple[list[dict], float]:
    """The trials of the sweep and the holdout log-loss of the best one, refit with its rounds.

    Trials are recorded in the store as they finish; the same sweep started
    again goes on from there.
    """
    data = labels.split_by_season(shared_matrix(spark, sf_dir), "season", TRAIN_MAX, CALIB, HOLDOUT)
    data = data.withColumn("home_win", F.col("home_win").cast("double"))
    splits = {name: data.where(F.col("split") == name) for name in ("train", "calib")}
    ready = learn.prepared(splits, "train", FEATURES, CATEGORICALS, ["home_win"])
    trials = learn.draw_params(n_trials, seed=learn.SEED)
    ledger = os.path.join(root or models.store_root(spark), "search-" + training_key(spark, sf_dir))
    results, model = learn.search_and_refit(ready, "home_win", trials, parallelism=parallelism, ledger=ledger)
    hold = learn.predict(model, physical.spread(data.where(F.col("split") == "holdout")), "p")
    return results, float(metrics.binary_metrics(hold, "home_win", "p").first()["logloss"])


def model_meta(ctr: contract.FeatureContract) -> dict:
    """Header fields of a published run (F32): the effective holdout metrics are
    the calibrated ones when isotonic calibration shipped, else the raw ones."""
    method = ctr.calibration.get("method", "none")
    h = ctr.honest_holdout_metrics
    variant = "calibrated" if method == "isotonic" else "uncalibrated"
    eff = h.get(variant, {})
    margin = h.get("margin", {})
    return {
        "calibration_method": method,
        "holdout_variant": variant,
        "holdout_accuracy": eff.get("accuracy"),
        "holdout_auc": eff.get("auc"),
        "holdout_brier": eff.get("brier"),
        "spread_holdout_mae": margin.get("mae"),
        "spread_holdout_rmse": margin.get("rmse"),
        "spread_holdout_sign_accuracy": margin.get("sign_accuracy"),
        "market_independent": True,
    }


def open_slate(meetings: DataFrame) -> DataFrame:
    """The meetings to score: not completed, and not of an excluded class (as in training)."""
    return clean.exclude_classes(
        clean.not_completed_rows(meetings, "completed"), POLICY.class_columns, POLICY.class_patterns
    )


def week_slate(spark: SparkSession, sf_dir: str, season: int, period: int) -> DataFrame:
    """The open meetings of one period of one season whose sides are both of the top class.

    The period is a range on the raw order date, so it reaches the orders scan
    (row groups are skipped) instead of filtering after the join.
    """
    first = F.make_timestamp_ntz(F.lit(season), F.lit(period), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    m = st.meetings(spark, sf_dir)
    m = m.where((F.col("start_ts") >= first) & (F.col("start_ts") < F.add_months(first, 1).cast("timestamp_ntz")))
    m = clean.slate(st.with_classes(spark, sf_dir, m), "period", period, "completed", ["home_class", "away_class"], st.TOP_CLASS)
    return clean.exclude_classes(m, POLICY.class_columns, POLICY.class_patterns)


def week_features(spark: SparkSession, sf_dir: str, season: int, period: int) -> DataFrame:
    """Cleaned features of ``week_slate`` from that season's orders, with the start as ``kickoff_ts``."""
    fd = feature_dataset(spark, sf_dir, week_slate(spark, sf_dir, season, period), market=False, season=season)
    return clean_features(fd.withColumn("kickoff_ts", F.col("start_ts")))


def score(spark: SparkSession, sf_dir: str, trained: Trained, week: tuple[int, int] | None = None) -> DataFrame:
    """The open slate, keyed by id, scored and rounded.

    ``week=(season, period)`` scores one ``week_slate`` (the weekly run);
    otherwise every meeting of ``open_slate`` is scored. Open meetings of an excluded class
    (flag N) are not part of it: the models are trained without that class.
    """
    if week is not None:
        feats = week_features(spark, sf_dir, *week)
    else:
        fd = feature_dataset(spark, sf_dir, open_slate(st.meetings(spark, sf_dir)), market=False)
        feats = clean_features(fd.withColumn("kickoff_ts", F.col("start_ts")))
    ids = ["order_key", "line", "season", "home", "away", "kickoff_ts"]
    ctr, margin_ctr = trained.contract, trained.margin_contract
    # The margin model is aligned to its own contract, from the features as they came.
    own = [c for c in (margin_ctr.feature_columns if margin_ctr else []) if c in feats.columns and c not in ids]
    feats = feats.withColumn("for_margin", F.struct(*own)) if own else feats.withColumn("for_margin", F.lit(None))
    p = learn.predict(trained.winner_prod, contract.align(feats, ctr, keep=[*ids, "for_margin"]), "p_raw")
    p = calibrate.apply_calibration(p, "p_raw", ctr.calibration, "p_home").select(*ids, "period", "p_home", "for_margin")
    p = p.select(*(F.col(c) for c in [*ids, "p_home"]), F.col("period").alias("week"), *(F.col(f"for_margin.{c}").alias(c) for c in own if c != "season"))
    if margin_ctr is not None and trained.margin_prod is not None:
        p = contract.align(p, margin_ctr, keep=[*ids, "p_home", "week"])
        p = learn.predict(trained.margin_prod, p, "margin", kind="margin")
    else:
        p = p.withColumn("margin", F.lit(None).cast("double"))
    winner, conf = scalar.pick_winner("p_home", F.concat(F.lit("N"), F.col("home").cast("string")),
                                      F.concat(F.lit("N"), F.col("away").cast("string")))
    slate = p.select(
        "order_key", "line", "season", F.col("week").cast("int").alias("week"), "kickoff_ts",
        scalar.iso_timestamp("kickoff_ts").alias("kickoff"),
        F.concat(F.lit("N"), F.col("home").cast("string")).alias("home_team"),
        F.concat(F.lit("N"), F.col("away").cast("string")).alias("away_team"),
        scalar.round_half_up("p_home", 4).alias("home_win_probability"),
        winner.alias("predicted_winner"),
        scalar.round_half_up(conf, 4).alias("confidence"),
        scalar.round_half_up("margin", 1).alias("predicted_margin"),
    )
    # Slate order inside each week: kickoff (unknown first), rounded
    # confidence descending, then the id.
    order = [F.col("kickoff_ts").asc_nulls_first(), F.col("confidence").desc(), F.col("order_key"), F.col("line")]
    return physical.position_within(slate, ["season", "week"], order, out="slate_position").drop("kickoff_ts")
