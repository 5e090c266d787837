"""Game tables taken in game by game, all four switched by one manifest.

`ingest` takes in the games that no version holds yet: their rows are written aside, then one manifest names them
for all tables at once. A lost driver leaves folders nobody reads, and the next run takes the same games in again; a
game is never there twice. Parts are seasons, so that a job opens the folders of the seasons it needs and no others.
"""

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from calledzone import schema as S
from calledzone.session import materialise, small_side
from calledzone.sources.published import PublishedTable, Versions, added
from calledzone.sources.tables import GameTables, with_calendar

CALENDAR = (StructField("game_date", DateType()), StructField("season", IntegerType()), StructField("month", IntegerType()))
TABLES = {"games": S.GAMES, "umpires": S.UMPIRES, "atbats": S.ATBATS, "pitches": S.PITCHES}


@dataclass(frozen=True)
class Ingested:
    """What one `ingest` added: the version that holds it, how many games, and the seasons they are of."""

    version: int | None
    games: int
    seasons: tuple[int, ...]


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, self.root)
        self.stored = {
            name: PublishedTable(spark, f"{self.root}/{name}", StructType([*schema, *CALENDAR]))
            for name, schema in TABLES.items()
        }

    def version(self) -> int | None:
        return self.versions.newest()

    def table(self, name: str, version: int | None = None, seasons: Iterable[int] | None = None) -> DataFrame:
        """Rows of one table; with `seasons` only their folders are opened."""
        wanted = None if seasons is None else {f"{name}/season={season}" for season in seasons}
        folders = [
            folder for part, held in sorted(self.versions.parts(version).items())
            if part.startswith(f"{name}/") and (wanted is None or part in wanted) for folder in held
        ]
        return self.stored[name].open(folders)

    def tables(self, zones: DataFrame | None = None, version: int | None = None,
               seasons: Iterable[int] | None = None) -> GameTables:
        version = self.version() if version is None else version
        seasons = None if seasons is None else tuple(seasons)
        return GameTables(**{name: self.table(name, version, seasons) for name in TABLES}, zones=zones)

    def seasons(self, version: int | None = None) -> list[int]:
        return sorted(int(part.rpartition("=")[2]) for part in self.versions.parts(version) if part.startswith("games/"))

    def changed_seasons(self, since: dict[int, int], version: int | None = None) -> list[int]:
        """Seasons whose rows are not those of the version a job last saw them in (`since`: season to version)."""
        now = self.versions.parts(version)

        def parts(held, season):
            return {name: held.get(f"{name}/season={season}") for name in TABLES}

        return [s for s in self.seasons(version)
                if s not in since or parts(self.versions.parts(since[s]), s) != parts(now, s)]

    def new_games(self, games: DataFrame) -> DataFrame:
        """Games of `games` that are not held yet; only the folders of their seasons are read for it."""
        dated = with_calendar(games.select(*S.GAMES.fieldNames(), *[c for c in ("game_date", "season", "month") if c in games.columns]))
        dated = materialise(dated.dropDuplicates(["gameName"]))
        seasons = [r["season"] for r in dated.select("season").distinct().collect()]
        held = self.table("games", seasons=seasons).select("gameName")
        return materialise(dated.join(held, "gameName", "left_anti"))

    def ingest(self, raw: GameTables) -> Ingested:
        """Take in the games of `raw` that are new, with their umpires, at-bats and pitches."""
        fresh = self.new_games(raw.games)
        found = fresh.groupBy("season").count().collect()
        if not found:
            return Ingested(self.version(), 0, ())
        seasons = tuple(sorted(row["season"] for row in found))
        names = fresh.select("gameName")
        staged = self._staged("games", fresh)
        for name in ("umpires", "atbats", "pitches"):
            rows = getattr(raw, name)
            if "season" in rows.columns:
                rows = rows.where(F.col("season").isin(*seasons))
            rows = rows.join(small_side(names), "gameName", "left_semi")
            staged |= self._staged(name, with_calendar(rows))
        games = sum(row["count"] for row in found)
        version = self.versions.publish(lambda old: added(old, staged), {"games": games, "seasons": list(seasons)})
        return Ingested(version, games, seasons)

    def _staged(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        return {f"{name}/{part}": folders for part, folders in self.stored[name].stage(rows).items()}
