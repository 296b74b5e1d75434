"""Write COVERAGE.md: which registered queries exercise each inventory item.

    python tools/coverage_table.py > COVERAGE.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runlens.plans import REGISTRY  # noqa: E402

PREFIXES = "S P F I G R Q N J M C K U E X T".split()


def key(item: str):
    head = item[0]
    rest = item[1:]
    digits = "".join(ch for ch in rest if ch.isdigit())
    return PREFIXES.index(head), int(digits or 0), rest


def main() -> None:
    by_item: dict[str, list] = {}
    for q in REGISTRY.values():
        for item in q.ids.split():
            by_item.setdefault(item, []).append(q)
    checked = sum(q.sql is not None for q in REGISTRY.values())
    print("# Coverage of the operator inventory\n")
    print(f"{len(REGISTRY)} registered queries, {checked} with an SQL twin. Written by `tools/coverage_table.py`.\n")
    print("| Item | Queries (without SQL twin: *italic*) |\n|---|---|")
    for item in sorted(by_item, key=key):
        names = ", ".join(f"`{q.name}`" if q.sql else f"*`{q.name}`*" for q in by_item[item])
        print(f"| {item} | {names} |")


if __name__ == "__main__":
    main()
