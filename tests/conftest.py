import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from verbatrix.session import ensure_checkpoint_dir, local_session, make_importable

    session = make_importable(local_session(4, 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def canonical(frame):
    """Rows of a pandas frame as sorted tuples of text, for comparing engines."""
    out = []
    columns = sorted(frame.columns)
    for row in frame[columns].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
                cells.append("NULL")
            elif isinstance(v, float) or hasattr(v, "dtype") and "float" in str(getattr(v, "dtype", "")):
                cells.append(f"{float(v):.6g}")
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return columns, sorted(out)
