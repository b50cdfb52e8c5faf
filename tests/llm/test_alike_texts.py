"""Texts that weak hashes take for equal, and tasks without the package."""

import os
import subprocess
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pytest

from gacetilla.llm import decontaminate, line_dedup, ngram_join, repeats
from gacetilla.llm.words import Lines, Words

from . import helpers as H

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


@pytest.fixture(scope="module")
def alike():
    """Pairs of different words that sums of powers modulo 2**64 can't tell apart."""
    out = []
    for n in (1024, 4096, 16384):
        out += [thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), thue_morse(n, "ab", "ba"), thue_morse(n, "ba", "ab")]
    return out


def test_hashes_tell_patterns_apart(alike):
    assert len(set(Words(pa.array(alike)).hash.tolist())) == len(set(alike))
    both = Words(pa.array(["x " + " ".join(alike), *alike])).hash
    assert np.array_equal(both[1:len(alike) + 1], both[len(alike) + 1:])  # the same wherever a word stands
    lines = Lines(pa.array(["\n".join(["", *alike, "", " "]), *alike]))
    for hashes in lines.hashes(np.arange(len(lines.start))):
        assert len(set(hashes.tolist())) == len(set(alike)) + 1
        assert np.array_equal(hashes[1:len(alike) + 1], hashes[-len(alike):])


def test_operators_tell_patterns_apart(spark, alike):
    rows = [(i, f"{x}") for i, x in enumerate(alike)] + [(50 + i, f"common words here {x} and there") for i, x in enumerate(alike)]
    docs = H.documents(spark, rows)
    H.same(ngram_join.near_copies(docs, k=4, threshold=85), H.near_copies(rows))
    lines = line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
    H.same(lines, H.kept_lines(rows))
    items = [(1, alike[0]), (2, f"common words here {alike[5]} and there")]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    H.same(found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256"), H.contamination(rows, items))
    long = [(i, " ".join(["w"] * 30 + [x] + ["v"] * 30)) for i, x in enumerate(alike)]
    got = repeats.remove_repeats(H.documents(spark, long)).select("doc_id", "n_words", "n_removed")
    H.same(got, [x[:3] for x in H.repeats(long)])


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).mapInArrow(lambda bs: (b for b in bs if __import__("gacetilla")), "id long").count()
    print("the package can be imported")
except Exception:
    print("without")
for name, query in E.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_executors_need_no_package():
    folder = tempfile.mkdtemp(prefix="gacetilla-test-elsewhere-")
    with open(f"{folder}/run.py", "w") as f:
        f.write(SCRIPT.format(root=ROOT, shared=f"{folder}/shared"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "run.py"], cwd=folder, env=env, capture_output=True, text=True, timeout=900)
    lines = done.stdout.split("\n")
    assert done.returncode == 0, done.stderr[-2000:]
    assert "without" in lines and len([x for x in lines if x.startswith(("op", "pipeline"))]) == 14


def test_frequency_classes_count_every_document(spark):
    """A shingle of some documents is as frequent as they are, whichever they are."""
    rows = [(i, f"one two three four five tail{i} end{i}") for i in range(40)]
    docs = H.documents(spark, rows).repartition(3)
    words = Words(pa.array(["one two three four five"]))
    slot = int(ngram_join.shingles(words, 5)[0][0] & np.uint64((1 << ngram_join.SKETCH_BITS) - 1))
    classes = ngram_join.frequency_classes(docs.select("text"), 5)
    assert classes[slot] == np.floor(np.log2(40 / 2)) + 1 and np.count_nonzero(classes) == 1
