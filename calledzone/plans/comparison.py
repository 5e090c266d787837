"""The comparison of models as one job: from fits to scores, curves and areas.

    run = Comparison(tables, store, "s3a://lake/comparison", "2018-11")
    run.fit()                  # nets and buckets that are missing
    areas = run.areas()        # scores season by season, then the areas under the curves

A run notes in its ledger which versions of the model and bucket tables it scores with, and every season it has
scored. Started again under its id, after a lost driver or a year later, it goes on where it stopped and gives the same rows,
whatever has been fitted, repaired or removed in the store meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calledzone import schema as S
from calledzone.operators.pitches import judged_pitches
from calledzone.operators.scoring import compare_models, roc_dataset
from calledzone.plans import evaluation, training
from calledzone.session import materialise
from calledzone.sources import sinks
from calledzone.sources.ledger import RunLedger
from calledzone.sources.published import PublishedTable, Versions
from calledzone.sources.sinks import ModelStore
from calledzone.sources.tables import GameTables

AREA_COLUMNS = "model string, auc double, strikes long, balls long, label string"


@dataclass
class Comparison:
    """A run of the comparison under `root`; `run_id` names it for good."""

    tables: GameTables
    store: ModelStore
    root: str
    run_id: str
    last_season: int
    after_season: int = 2007
    after_month: int = 4
    by_season: bool = False
    individual: bool = True
    # Scores are kept to so many digits, so that ties on the curves do not hang on a plan's last bits.
    digits: int | None = None
    # Seasons scored in one job; what a lost driver has to do again at most.
    seasons_per_step: int = 1
    # The lake's version the tables are of, if they come from one.
    data_version: int | None = None
    _listed: DataFrame | None = field(default=None, repr=False)
    _judged: DataFrame | None = field(default=None, repr=False)
    _pinned: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.spark = self.store.spark
        run = f"{self.root}/runs/{self.run_id}"
        self.ledger = RunLedger(self.spark, f"{run}/steps")
        self.scores_table = sinks.scores_table(self.spark, f"{run}/scores", S.UMPIRE_ROC)
        self.settings = self.ledger.step("settings", lambda: {
            "last_season": self.last_season, "after_season": self.after_season, "after_month": self.after_month,
            "by_season": self.by_season, "individual": self.individual, "digits": self.digits,
            "data_version": self.data_version})
        asked = {name: getattr(self, name) for name in self.settings}
        if asked != self.settings:
            raise ValueError(f"run {self.run_id} was begun with {self.settings}, not {asked}")

    @property
    def judged(self) -> DataFrame:
        """All called pitches, written once for the whole run."""
        if self._judged is None:
            columns = ("pitch_id", "umpire", "game_date", "season", "month", "stand", "known_height", "has_zone", "c", "pz")
            self._judged = materialise(judged_pitches(self.tables).select(*columns, *S.MOVEMENT_FEATURES))
        return self._judged

    @property
    def listed(self) -> DataFrame:
        """Pitches of the umpire-months on the scoring list."""
        if self._listed is None:
            self._listed = materialise(evaluation.comparison_fact(
                self.tables, evaluation.scored_rows(self.judged), self.settings["last_season"],
                self.settings["after_month"], self.judged))
        return self._listed

    def fit(self, **options) -> None:
        """Nets the store has not yet, and the buckets of all windows; a fitted net stays as it is."""
        fact = self.judged.where("has_zone AND known_height")
        games = self.tables.games
        if self.settings["by_season"]:
            kinds = [(training.POOLED, training.yearly_tasks(games)),
                     (training.MOVEMENT, training.yearly_tasks(games, training.MOVEMENT.name))]
        else:
            kinds = [(training.POOLED, training.monthly_tasks(games)),
                     (training.MOVEMENT, training.monthly_tasks(games, training.MOVEMENT.name))]
        if self.settings["individual"]:
            tasks = training.individual_tasks(self.tables, self.settings["last_season"], self.judged)
            kinds.append((training.INDIVIDUAL, tasks))
        for kind, tasks in kinds:
            self.ledger.step(f"fit-{kind.name}", lambda kind=kind, tasks=tasks: training.train_and_save(
                self.store, fact, tasks, kind, overwrite=False, **options))
        self.fit_buckets()

    def fit_buckets(self) -> None:
        span = training.yearly_tasks if self.settings["by_season"] else training.monthly_tasks
        rows = evaluation.scored_rows(self.judged)
        self.ledger.step("fit-buckets", lambda: training.save_buckets(self.store, rows, span(self.tables.games)))

    def models(self) -> dict[str, int]:
        """Versions of the tables this run scores with, fixed when it first asks."""
        return self.ledger.step("models", lambda: {
            "models": self.store.version() or 0, "buckets": self.store.bucket_models.version() or 0})

    def pinned(self) -> tuple[DataFrame, DataFrame]:
        """Nets and buckets of the noted versions; the nets' newest rows are picked out once for all seasons."""
        if self._pinned is None:
            fixed = self.models()
            self._pinned = materialise(self.store.current(fixed["models"])), self.store.buckets(fixed["buckets"])
        return self._pinned

    def _score(self, seasons: list[int]) -> dict:
        nets, buckets = self.pinned()
        # Models of the month before may be of the season before.
        near = F.col("season").between(seasons[0] - 1, seasons[-1])
        scores = compare_models(
            self.listed.where(F.col("season").isin(*seasons)), nets.where(near), buckets.where(near),
            by_season=self.settings["by_season"], individual=self.settings["individual"])
        if self.digits is not None:
            names = [name for name in S.UMPIRE_ROC.fieldNames() if name.startswith("nn_") or name == "roeg"]
            scores = scores.withColumns({name: F.round(name, self.digits) for name in names})
        # Replaced, not added: a season scored twice after a lost driver is there once.
        sinks.overwrite_seasons(scores.select(*S.UMPIRE_ROC.fieldNames()), self.scores_table)
        return {"seasons": seasons, "scored_with": self.models()}

    def scores(self) -> DataFrame:
        """Scores of all listed pitches; seasons the ledger has are not scored again."""
        self.models()
        seasons = self.ledger.step("seasons", lambda: sorted(
            row["season"] for row in self.judged.where(F.col("season") <= self.settings["last_season"])
            .select("season").distinct().collect()))
        for start in range(0, len(seasons), self.seasons_per_step):
            some = seasons[start:start + self.seasons_per_step]
            self.ledger.step(f"scores-{some[0]}-{some[-1]}", lambda some=some: self._score(some))
        return self.scores_table.read()

    def dataset(self) -> DataFrame:
        """Scores every model could give, with the fixed-box rule."""
        return roc_dataset(self.scores(), self.tables.pitches, self.settings["after_month"], self.settings["after_season"])

    def areas(self) -> DataFrame:
        """Areas under the curves; the run then becomes the one that readers of `root` see."""
        table = PublishedTable(self.spark, f"{self.root}/runs/{self.run_id}/areas", area_schema(self.spark), ())
        version = self.ledger.step("areas", lambda: table.replace(evaluation.areas_under_curves(self.dataset())))
        self.ledger.step("published", lambda: Versions(self.spark, self.root).publish(
            lambda old: {}, {"run": self.run_id, **self.models()}))
        return table.read(version)


def area_schema(spark):
    return spark.createDataFrame([], AREA_COLUMNS).schema


def newest_run(spark, root: str) -> dict:
    """The finished run readers are to use, and the model versions it scored with; empty before the first."""
    return Versions(spark, root).notes()


def newest_scores(spark, root: str) -> DataFrame:
    run = newest_run(spark, root)["run"]
    return sinks.scores_table(spark, f"{root}/runs/{run}/scores", S.UMPIRE_ROC).read()
