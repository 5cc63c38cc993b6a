"""Standard library and installed distributions of a Python interpreter, asked in a subprocess."""

from __future__ import annotations

import json
import subprocess
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SECONDS, MOST_BYTES = 10, 8 << 20
PROBE = """
import importlib.metadata as m, json, sys
own = {}
for d in m.distributions():
    top = (d.read_text("top_level.txt") or "").split() or {str(f).split("/")[0].removesuffix(".py") for f in d.files or () if str(f).endswith(".py")}
    for n in top:
        if n.isidentifier():
            if d.metadata["Name"]:
                own.setdefault(n, {})[d.metadata["Name"]] = d.version
print(json.dumps({"version": list(sys.version_info[:3]), "venv": sys.prefix != sys.base_prefix, "stdlib": sorted(getattr(sys, "stdlib_module_names", sys.builtin_module_names)), "providers": own}))
"""


class ProbeError(RuntimeError):
    """An interpreter that can't be asked."""


def said(command: list[str]) -> bytes:
    """Output of a command; it is killed after SECONDS, or once either of its streams has more than MOST_BYTES."""
    kept: dict[str, bytes] = {"out": b"", "err": b""}
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as running:

        def read(name: str, stream) -> None:
            while piece := stream.read(1 << 16):
                kept[name] += piece
                if len(kept[name]) > MOST_BYTES:
                    running.kill()
                    return

        readers = [threading.Thread(target=read, args=x, daemon=True) for x in (("out", running.stdout), ("err", running.stderr))]
        for r in readers:
            r.start()
        try:
            running.wait(SECONDS)
        except subprocess.TimeoutExpired:
            running.kill()
            raise
        finally:
            for r in readers:
                r.join(1)
    if max(map(len, kept.values())) > MOST_BYTES:
        raise ProbeError("the interpreter said too much")
    if running.returncode:
        raise subprocess.CalledProcessError(running.returncode, command)
    return kept["out"]


def probe(interpreter: str | None = None, venv: str | None = None) -> dict:
    """Version, standard library names and import providers; Python 3.8 at least, within 10 s and 8 MiB."""
    if venv is not None:
        if not Path(venv, "pyvenv.cfg").is_file():
            raise ProbeError(f"{venv} holds no pyvenv.cfg")
        interpreter = str(Path(venv, "bin", "python"))
    try:
        found = json.loads(said([interpreter or "python3", "-I", "-c", PROBE]))
    except (OSError, ValueError, subprocess.SubprocessError) as e:
        raise ProbeError(f"{interpreter}: {e}") from None
    if tuple(found["version"]) < (3, 8):
        raise ProbeError("Python 3.8 or later is needed")
    return found


def environment_tables(spark: SparkSession, found: dict) -> tuple[DataFrame, DataFrame]:
    """Standard library (name) and providers (import_name, distribution, version); distribution names are normalised."""
    import re

    rows = [(n, re.sub(r"[-_.]+", "-", d).lower(), v) for n, ds in found["providers"].items() for d, v in ds.items() if d and d != "null"]
    return spark.createDataFrame([(n,) for n in found["stdlib"]], "name string"), spark.createDataFrame(rows, "import_name string, distribution string, version string")
