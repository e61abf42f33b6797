"""Print a schema file as JSON: python -m tableguard.cli SCHEMA."""

from __future__ import annotations

import sys

from .log import get_logger
from .schema import SchemaModel

USAGE = "usage: python -m tableguard.cli SCHEMA   (a .json, .yaml or .yml file)"


def main(argv: list[str] | None = None) -> None:
    """Write the schema to standard output; what cannot be read ends with a message."""
    given = sys.argv[1:] if argv is None else argv
    if len(given) != 1 or given[0] in ("-h", "--help"):
        raise SystemExit(USAGE)
    try:
        model = SchemaModel.from_file(given[0])
    except ValueError as e:
        raise SystemExit(str(e)) from e
    get_logger("cli").info("%s describes %d columns", given[0], len(model.columns))
    sys.stdout.write(model.model_dump_json(indent=2) + "\n")


if __name__ == "__main__":
    main()
