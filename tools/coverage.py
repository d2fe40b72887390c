"""Print the survey-row -> query table from the registry (markdown)."""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridhazard.plans import REGISTRY  # noqa: E402

rows = defaultdict(list)
for q in REGISTRY.values():
    for r in q.rows.split():
        rows[r].append(q.name if q.sql else f"{q.name} (no SQL)")
print("| row | queries |\n|---|---|")
for r in sorted(rows):
    print(f"| {r} | {', '.join(rows[r])} |")
