"""Work that must not be done twice: numbered pitches, and cells that cannot hold a limit."""

import pytest
from pyspark.sql import functions as F

from calledzone.operators import grids as G
from calledzone.operators.models import usable_models
from harness import queries as Q


@pytest.mark.parametrize("query", ["roc_data", "ingested_pitches"])
def test_pitches_are_numbered_once_for_several_readers(spark, small, monkeypatch, query):
    """Readers of the pitches take them from a table: their own plans hold no line items."""
    seen = []
    if query == "roc_data":
        inner = Q.roc_dataset
        monkeypatch.setattr(Q, "roc_dataset", lambda roc, pitches, **more: (seen.append(pitches), inner(roc, pitches, **more))[1])
        Q.roc_data(spark, small)
    else:
        inner = Q.Lake.ingest
        monkeypatch.setattr(Q.Lake, "ingest", lambda self, raw: (seen.append(raw.pitches), inner(self, raw))[1])
        Q.ingested_pitches(spark, small)
    assert seen and not any("lineitem" in file for pitches in seen for file in pitches.inputFiles())


def test_zone_extents_open_few_cells(spark, tables):
    """Limits are those of all strike cells, found in a small part of them."""
    nets = Q._batter_nets(tables)
    every = G._strike_cells(nets, G.BATTER_GRID, ">= 0")
    some = G._strike_cells(nets, G.BATTER_GRID, ">= 0", ends=True)
    assert 0 < 3 * some.count() < every.count()
    limits = every.groupBy("model_key").agg(F.max("z").alias("sz_top"), F.min("z").alias("sz_bot"))
    wanted = usable_models(nets).select("model_key").join(limits, "model_key", "left")
    found = G.zone_extents(nets)
    assert wanted.count() == found.count() > 0 and wanted.exceptAll(found).isEmpty()
