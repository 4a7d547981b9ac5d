"""python -m threadloom [SETTINGS] --store DIR [--copy-media]: ingest the snapshot that a settings file names.

SETTINGS is a JSON file as of sources.snapshot.Settings, `settings.json` in the current folder by default. The
archive and its search index lie in DIR; the same snapshot again adds nothing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from threadloom.common import list_names, write_text
from threadloom.operators.ingest import DuplicateKeys, ingest
from threadloom.sources.archive import write_archive
from threadloom.sources.snapshot import Settings
from threadloom.streaming.snapshots import current

DEFAULT_SETTINGS = "settings.json"


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom", description=__doc__.splitlines()[0])
    parser.add_argument("settings", nargs="?", default=DEFAULT_SETTINGS)
    parser.add_argument("--store", required=True)
    parser.add_argument("--copy-media", action="store_true")
    given = parser.parse_args(arguments)
    try:
        settings = Settings.read(given.settings)
    except (OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("threadloom").getOrCreate()
    version = f"v{len(list_names(spark, f'{given.store}/published')):08d}"
    try:
        archive, report = ingest(spark, settings, current(spark, given.store), copy_media=given.copy_media, index=f"{given.store}/search/run={version}")
    except DuplicateKeys as e:
        print(f"repeated keys: {e}", file=sys.stderr)
        return 1
    write_archive(archive, f"{given.store}/{version}", mode="overwrite")
    write_text(spark, f"{given.store}/published/{version}", "")
    print(f"added {report.added}, rejected files {report.rejected_count}, sums of ids {report.sum_post_id} and {report.sum_board_post_id}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
