"""Make this package importable on the executors when the session was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ensure_importable(spark) -> None:
    """Send the package with ``addPyFile`` unless the workers' search path holds it already."""
    app = spark.sparkContext.applicationId
    paths = [Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]]
    if app in _shipped or any((p / "lexispark" / "__init__.py").exists() for p in paths):
        return
    target = Path(tempfile.mkdtemp()) / "lexispark.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted((_ROOT / "lexispark").rglob("*.py")):
            out.write(file, file.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
