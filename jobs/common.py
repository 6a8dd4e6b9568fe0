"""What the jobs' command lines share: a config file whose values options override, a log and a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def command(run: Callable[..., object], description: str, default_config: str, paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """Parses ``argv``, makes a session, calls ``run(spark, **settings)`` and stops the session.

    Settings are those of the JSON file ``--config``; an option of the same name goes before them. ``paths`` must come from either.
    """
    with open(default_config) as f:
        known = json.load(f)
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", default=default_config, help="JSON file of settings")
    for name in dict.fromkeys([*paths, *known]):
        parser.add_argument("--" + name.replace("_", "-"))
    given = vars(parser.parse_args(argv))
    with open(given.pop("config")) as f:
        settings = {**known, **json.load(f)}
    kinds = {k: type(v) for k, v in known.items() if v is not None}
    settings |= {k: kinds.get(k, str)(v) for k, v in given.items() if v is not None}
    if missing := [p for p in paths if not settings.get(p)]:
        parser.error("missing: " + ", ".join(missing))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    from editspark.session import session

    spark = session(None)
    try:
        run(spark, **settings)
    finally:
        spark.stop()
