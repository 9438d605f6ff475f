import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cdcmart.llm.common import ship_package  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts or (doc_id, text, source) rows, with further columns whose names clash with inner ones."""
    ship_package(spark)

    def make(rows, clashing=False):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, f"s{i % 3}")
            full.append((doc_id, text, None, source, None))
        df = spark.createDataFrame(full, COLUMNS)
        if clashing:
            for name in ("size", "kept", "_key", "_row", "_sha", "n", "copies", "_copy", "_dropped", "score", "component_id", "part"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def words():
    import random

    rng = random.Random(7)
    syllables = "ba ke li mo nu ra se ti vo zu qua xen pry".split()
    return lambda n, seed=None: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for r in [random.Random(seed) if seed is not None else rng] for _ in range(n))
