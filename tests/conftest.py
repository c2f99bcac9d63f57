import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]

from docsnap.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        spark__master="local[8]",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="3",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def tree(tmp_path):
    """A directory to fill, and a function that writes a file in it at a given mtime."""
    root = tmp_path / "data"
    root.mkdir()

    def write(name, text="x", mtime=None):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        if mtime is not None:
            os.utime(path, (mtime, mtime))
        return str(path)

    write.root = str(root)
    return write
