import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]")
         .appName("gacetilla-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ckpt = tempfile.mkdtemp(prefix="gacetilla-test-ckpt-")
    s.sparkContext.setCheckpointDir(ckpt)
    yield s


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="gacetilla-test-")


# Unicode White_Space property
WHITE_SPACE = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {
    chr(c) for c in range(0x2000, 0x200B)}


def dice(a: str, b: str, unit: str = "byte") -> float:
    """Brute-force Sørensen–Dice, the definition the library implements."""
    a = "".join(ch for ch in a if ch not in WHITE_SPACE)
    b = "".join(ch for ch in b if ch not in WHITE_SPACE)
    if a == b:
        return 1.0
    la = len(a.encode()) if unit == "byte" else len(a)
    lb = len(b.encode()) if unit == "byte" else len(b)
    if la < 2 or lb < 2:
        return 0.0
    from collections import Counter
    ga = Counter(a[i:i + 2] for i in range(len(a) - 1))
    gb = Counter(b[i:i + 2] for i in range(len(b) - 1))
    inter = sum(min(c, gb[g]) for g, c in ga.items())
    return 2 * inter / (la + lb - 2)
