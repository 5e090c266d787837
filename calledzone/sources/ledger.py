"""What a run has done so far, as one small file a step, so that a run can be taken up again."""

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from calledzone.sources.published import Files


class RunLedger:
    """Steps of the run kept under `root`. A step's result is written once and then always the same."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.files = Files(spark, root)

    def _path(self, step: str) -> str:
        return f"{self.root}/{step}.json"

    def done(self) -> list[str]:
        return sorted(n.removesuffix(".json") for n in self.files.names(self.root) if n.endswith(".json") and not n.startswith("."))

    def result(self, step: str):
        """What a finished step came to."""
        return json.loads(self.files.read(self._path(step)))

    def step(self, name: str, work: Callable[[], object]):
        """Result of the step, from the ledger if it is done already.

        `work` must be safe to repeat: a driver may be lost after it and before its result is written. If
        two drivers run the same step, the result that is written first counts for both.
        """
        if name not in self.done():
            self.files.create(self._path(name), json.dumps(work(), sort_keys=True))
        return self.result(name)
