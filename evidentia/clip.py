"""python -m evidentia.clip --input FILE --output FILE --start-seconds S --duration-seconds D: the subtitles of a stretch, counted from its start."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .session import local_session
from .sources import subtitles as sb


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--start-seconds", required=True, type=float)
    p.add_argument("--duration-seconds", required=True, type=float)
    args = p.parse_args(argv)
    cues = sb.read_srt(local_session(4), args.input).withColumn("file", F.lit(args.input))
    texts = sb.clip_srt(cues, ["file"], args.start_seconds, args.duration_seconds).collect()  # a row, as there is one file
    Path(args.output).parent.mkdir(parents=True, exist_ok=True)
    Path(args.output).write_text("".join(r.text for r in texts), encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
