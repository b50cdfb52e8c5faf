"""Incremental landing run of the item load into the stored table."""

import os

from gacetilla.sinks.table import read_table
from gacetilla.streaming.landing import start_landing
from test_feeds_rss import HARBOUR, VALLEY


def test_landing_inserts_once(spark, workdir):
    landing = os.path.join(workdir, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "a.xml"), "w") as f:
        f.write(HARBOUR)
    table = os.path.join(workdir, "table")
    ckpt = os.path.join(workdir, "ckpt")
    q = start_landing(spark, landing, table, ckpt, once=True)
    q.awaitTermination(120)
    assert read_table(spark, table).count() == 2
    with open(os.path.join(landing, "b.xml"), "w") as f:
        f.write(VALLEY)
    with open(os.path.join(landing, "c.xml"), "w") as f:
        f.write(HARBOUR)  # same links again: not inserted twice
    q = start_landing(spark, landing, table, ckpt, once=True)
    q.awaitTermination(120)
    assert read_table(spark, table).count() == 3
