import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagework.operators import rows  # noqa: E402
from pagework.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"file://{shared}/warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of four pages, so that short documents already span several."""
    monkeypatch.setattr(rows, "BLOCK", 4)


@pytest.fixture
def table(spark):
    """``table("a int, b string", [(1, "x")])``"""

    def make(schema, data):
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def docs(table):
    """Documents 1 to 6 with 1, 3, 9, 12, 17 and 30 pages."""
    counts = {1: 1, 2: 3, 3: 9, 4: 12, 5: 17, 6: 30}
    return table(
        "doc_id bigint, file_path string, base string, file_size bigint, page_count int",
        [(d, f"/in/d{d}.pdf", f"d{d}", 10, n) for d, n in counts.items()],
    )


@pytest.fixture
def pages(docs):
    return docs.selectExpr(
        "doc_id", "explode(sequence(1, page_count)) as page_no", "page_count", "base", "0 as rotation",
        "0D as x1", "0D as y1", "612D as x2", "792D as y2",
    )


def tuples(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())
