"""Text and JSON of a container.

    python -m tilewright info FILE [--read-dataset PATH]
    python -m tilewright json FILE [-d PATH] [-H]
"""

from __future__ import annotations

import argparse
import json
import sys

from tilewright.container.reader import Container
from tilewright.operators import render
from tilewright.sources.arrays import plain


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tilewright", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    info = commands.add_parser("info", help="the structure, a line for each object")
    info.add_argument("file")
    info.add_argument("--read-dataset", metavar="PATH", help="only this dataset's first values")
    dump = commands.add_parser("json", help="a group or dataset as JSON")
    dump.add_argument("file")
    dump.add_argument("-d", "--dataset", metavar="PATH", default="/")
    dump.add_argument("-H", "--header", action="store_true", help="without the values")
    asked = parser.parse_args(args)
    try:
        c = Container.open(asked.file)
        if asked.command == "json":
            print(json.dumps(render.to_json(c, asked.dataset, not asked.header), ensure_ascii=False, indent=2))
        elif asked.read_dataset:
            print(json.dumps(plain(render.first_values(c.dataset(c.resolve(asked.read_dataset)), 5)), ensure_ascii=False))
        else:
            print("\n".join(render.info(c)))
    except (OSError, ValueError, KeyError, EOFError) as e:
        print(f"{asked.file}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
