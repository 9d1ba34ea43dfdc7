"""Submitting an application: python -m tessera.submit [--master M] [--name N] [--conf key=value ...] script.py [arguments].

Settings may have this engine's short names; spark-submit does the rest."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from .session import translate


def command(args: list[str]) -> list[str]:
    """The command line of spark-submit for these arguments."""
    parser = argparse.ArgumentParser(prog="tessera.submit")
    parser.add_argument("--master")
    parser.add_argument("--name")
    parser.add_argument("--conf", action="append", default=[], metavar="key=value")
    parser.add_argument("--py-files")
    parser.add_argument("script")
    parser.add_argument("arguments", nargs=argparse.REMAINDER)
    a = parser.parse_args(args)
    if bad := [c for c in a.conf if "=" not in c]:
        parser.error(f"{bad[0]} isn't key=value")
    from pyspark.find_spark_home import _find_spark_home

    out = [os.path.join(_find_spark_home(), "bin", "spark-submit")]
    for flag, value in (("--master", a.master), ("--name", a.name), ("--py-files", a.py_files)):
        out += [flag, value] if value else []
    for k, v in translate(dict(c.split("=", 1) for c in a.conf)).items():
        out += ["--conf", f"{k}={v}"]
    return [*out, a.script, *a.arguments]


def main(args: list[str] | None = None) -> int:
    return subprocess.run(command(sys.argv[1:] if args is None else args), env=os.environ | {"PYSPARK_PYTHON": sys.executable}).returncode


if __name__ == "__main__":
    sys.exit(main())
